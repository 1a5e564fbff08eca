"""Usage accounting over the ``usage_log``, ``users``, ``uploads`` and ``reports`` views."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.catalog.base import query
from feedloom.functions.numbers import sql_half_even
from feedloom.functions.text import credit_year_start as year_start
from feedloom.plans import usage
from feedloom.views import table, view

AS_OF = "2024-01-20"
YEAR = "created_at >= TIMESTAMP '2024-01-01'"
COST = "sum(CAST(cost_usd AS DECIMAL(20,10))) FILTER (NOT used_own_key)"


def usd(x: str) -> str:
    return sql_half_even(f"coalesce(CAST({x} AS DOUBLE), 0.0::DOUBLE)", 4)


@query(
    "spend_this_year",
    f"""SELECT user_id, grouping(user_id) = 1 AS is_total, {usd(COST)} AS spent_usd FROM usage_log WHERE {YEAR} GROUP BY ROLLUP (user_id)""",
)
def spend_this_year(spark, sf):
    return usage.spend_this_year(view(spark, sf, "usage_log"), AS_OF)


SPEND = f"spend AS (SELECT user_id, {usd(COST)} AS spent FROM usage_log WHERE {YEAR} GROUP BY user_id)"


@query(
    "credit_status",
    f"""WITH {SPEND}, s AS (SELECT id AS user_id, credit_mode, CASE WHEN credit_mode = 'our_key_capped' THEN yearly_cap_usd END AS cap_usd,
  coalesce(spent, 0.0::DOUBLE) AS spent_usd FROM users LEFT JOIN spend ON user_id = id)
SELECT *, CASE WHEN cap_usd IS NOT NULL THEN {sql_half_even('greatest(0.0::DOUBLE, cap_usd - spent_usd)', 4)} END AS remaining_usd FROM s""",
)
def credit_status(spark, sf):
    return usage.credit_status(view(spark, sf, "users"), view(spark, sf, "usage_log"), AS_OF)


@query(
    "usage_overview",
    f"""WITH a AS (SELECT user_id, grouping(user_id) = 1 AS is_total, count(*) AS runs, {usd(COST)} AS lab_cost_usd,
  CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens
  FROM usage_log WHERE {YEAR} GROUP BY ROLLUP (user_id))
SELECT a.user_id, is_total, name, credit_mode, yearly_cap_usd, runs, lab_cost_usd, input_tokens, output_tokens FROM a LEFT JOIN users u ON u.id = a.user_id""",
)
def usage_overview(spark, sf):
    return usage.usage_overview(view(spark, sf, "usage_log"), view(spark, sf, "users"), AS_OF)


@query(
    "cap_exceeded",
    f"""WITH {SPEND} SELECT u.id AS user_id, 'own cap' AS reason, coalesce(spent, 0.0::DOUBLE) AS spent_usd FROM users u LEFT JOIN spend s ON s.user_id = u.id
WHERE credit_mode = 'our_key_capped' AND coalesce(spent, 0.0::DOUBLE) >= coalesce(yearly_cap_usd, 20.0::DOUBLE)""",
)
def cap_exceeded(spark, sf):
    return usage.cap_exceeded(view(spark, sf, "users"), view(spark, sf, "usage_log"), AS_OF, budget=1e9)


BUDGET = 1.0


@query(
    "shared_budget_exceeded",
    f"""WITH {SPEND} SELECT u.id AS user_id, 'shared budget' AS reason, coalesce(spent, 0.0::DOUBLE) AS spent_usd FROM users u LEFT JOIN spend s ON s.user_id = u.id
WHERE credit_mode <> 'own_key' AND (SELECT sum(spent) FROM spend) >= {BUDGET}""",
)
def shared_budget_exceeded(spark, sf):
    """A budget that the year's runs have used up."""
    return usage.cap_exceeded(view(spark, sf, "users"), view(spark, sf, "usage_log"), AS_OF, budget=BUDGET)


@query(
    "budget_remaining",
    f"""WITH t AS (SELECT {usd(COST)} AS total_usd FROM usage_log WHERE {YEAR})
SELECT total_usd, {BUDGET}::DOUBLE AS budget_usd, {sql_half_even(f"{BUDGET}::DOUBLE - total_usd", 4)} AS budget_remaining_usd FROM t""",
)
def budget_remaining(spark, sf):
    return usage.budget_summary(view(spark, sf, "usage_log"), AS_OF, BUDGET)


@query(
    "cap_crossing",
    """WITH c AS (SELECT l.user_id, l.id, l.created_at, CAST(yearly_cap_usd AS DECIMAL(20,10)) AS cap,
  sum(CAST(cost_usd AS DECIMAL(20,10))) OVER (PARTITION BY l.user_id ORDER BY created_at, l.id ROWS UNBOUNDED PRECEDING) AS cum
  FROM usage_log l JOIN users u ON u.id = l.user_id WHERE credit_mode = 'our_key_capped' AND NOT used_own_key)
SELECT user_id, id AS run_id, created_at AS crossed_at, CAST(cum AS DOUBLE) AS cumulative_usd, CAST(cap AS DOUBLE) AS cap_usd FROM c
WHERE cum >= cap QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at, id) = 1""",
)
def cap_crossing(spark, sf):
    return usage.cap_crossing(view(spark, sf, "usage_log"), view(spark, sf, "users"))


@query(
    "usage_rows",
    """SELECT user_id, id AS report_id, used_own_key, input_tokens, cached_input_tokens, output_tokens,
 CASE WHEN used_own_key OR user_id % 5 = 0 THEN 0.0::DOUBLE ELSE cost_usd END AS cost_usd FROM usage_log""",
)
def usage_rows(spark, sf):
    runs = view(spark, sf, "usage_log").select(
        "user_id", F.col("id").alias("report_id"), "used_own_key", "input_tokens", "cached_input_tokens", "output_tokens",
        F.when(F.col("user_id") % 5 == 0, "local").otherwise("openai").alias("model_choice"),
        F.col("cost_usd").alias("estimated_cost_usd"),
    )
    return usage.usage_rows(runs)


@query(
    "users_with_counts",
    """SELECT u.id, name, credit_mode, yearly_cap_usd, status, coalesce(n, 0) AS report_count FROM users u
LEFT JOIN (SELECT owner_id, count(*) AS n FROM reports GROUP BY owner_id) r ON r.owner_id = u.id""",
)
def users_with_counts(spark, sf):
    return usage.users_with_counts(view(spark, sf, "users"), view(spark, sf, "reports"))


@query(
    "status_summary",
    """SELECT s.status, count(u.id) AS users FROM (VALUES ('pending'), ('approved'), ('rejected'), ('disabled')) s(status)
LEFT JOIN users u ON u.status = s.status GROUP BY ALL""",
)
def status_summary(spark, sf):
    return usage.status_summary(view(spark, sf, "users"))


@query(
    "storage_quota",
    """SELECT owner_id, CAST(sum(size_bytes) AS BIGINT) AS used_bytes, sum(size_bytes) > 19000000 AS over_quota FROM uploads GROUP BY owner_id""",
)
def storage_quota(spark, sf):
    return usage.storage_quota(view(spark, sf, "uploads"), 19_000_000)


@query("orphan_uploads", "SELECT * FROM uploads u WHERE NOT EXISTS (SELECT 1 FROM reports r WHERE r.upload_id = u.id)")
def orphan_uploads(spark, sf):
    return usage.orphan_uploads(view(spark, sf, "uploads"), view(spark, sf, "reports"))


@query(
    "delete_report",
    """WITH doomed AS (SELECT r.id, r.upload_id FROM reports r JOIN users u ON u.id = r.owner_id WHERE u.status = 'disabled'),
kept AS (SELECT * FROM reports WHERE id NOT IN (SELECT id FROM doomed)),
gone AS (SELECT DISTINCT upload_id FROM doomed WHERE upload_id NOT IN (SELECT upload_id FROM kept))
SELECT 'report' AS kind, id, owner_id AS ref FROM kept
UNION ALL SELECT 'usage', id, CASE WHEN id IN (SELECT id FROM doomed) THEN NULL ELSE id END FROM usage_log
UNION ALL SELECT 'upload', id, owner_id FROM uploads WHERE id NOT IN (SELECT upload_id FROM gone)""",
)
def delete_report(spark, sf):
    """Reports of disabled users go; usage row n was written for report n."""
    reports, users = view(spark, sf, "reports"), view(spark, sf, "users")
    disabled = users.filter(F.col("status") == "disabled").select(F.col("id").alias("owner_id"))
    log = view(spark, sf, "usage_log").withColumn("report_id", F.col("id"))
    kept, cleared, uploads = usage.delete_reports(reports, log, view(spark, sf, "uploads"), reports.join(disabled, "owner_id", "left_semi"))
    return (
        kept.select(F.lit("report").alias("kind"), "id", F.col("owner_id").alias("ref"))
        .unionByName(cleared.select(F.lit("usage").alias("kind"), "id", F.col("report_id").alias("ref")))
        .unionByName(uploads.select(F.lit("upload").alias("kind"), "id", F.col("owner_id").alias("ref")))
    )


@query(
    "credit_year_start",
    """SELECT o_orderkey AS id, CASE WHEN make_date(year(o_orderdate), 7, 1) <= CAST(o_orderdate AS DATE) THEN make_date(year(o_orderdate), 7, 1)
 ELSE make_date(year(o_orderdate) - 1, 7, 1) END AS year_start FROM orders""",
)
def credit_year_start(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), year_start(F.col("o_orderdate").cast("date"), "07-01").alias("year_start")
    )
