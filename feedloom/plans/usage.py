"""Usage accounting and account tables. Money is summed as decimals, so results do not depend on task order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom import dims
from feedloom.functions.numbers import half_even
from feedloom.functions.text import credit_year_start
from feedloom.operators.ordered import running_sum

MONEY = "decimal(20,10)"


def _usd(x: Column) -> Column:
    return half_even(F.coalesce(x.cast("double"), F.lit(0.0)), 4)


def this_year(usage: DataFrame, as_of: str) -> DataFrame:
    start = credit_year_start(F.lit(as_of).cast("date")).cast("timestamp_ntz")
    return usage.filter(F.col("created_at") >= start)


def lab_cost() -> Column:
    """Cost that counts against the lab: runs with a user's own key count 0."""
    return F.when(~F.col("used_own_key"), F.col("cost_usd").cast(MONEY))


def spend_by_user(usage: DataFrame, as_of: str) -> DataFrame:
    return this_year(usage, as_of).groupBy("user_id").agg(_usd(F.sum(lab_cost())).alias("spent_usd"))


def spend_this_year(usage: DataFrame, as_of: str) -> DataFrame:
    """Per user, and the total in the row whose user_id is null."""
    rolled = this_year(usage, as_of).rollup("user_id").agg(F.grouping("user_id").alias("g"), F.sum(lab_cost()).alias("s"))
    return rolled.select("user_id", (F.col("g") == 1).alias("is_total"), _usd(F.col("s")).alias("spent_usd"))


def total_spend(usage: DataFrame, as_of: str) -> DataFrame:
    return this_year(usage, as_of).agg(_usd(F.sum(lab_cost())).alias("total_usd"))


def credit_status(users: DataFrame, usage: DataFrame, as_of: str) -> DataFrame:
    spend = spend_by_user(usage, as_of).withColumnRenamed("user_id", "id")
    cap = F.when(F.col("credit_mode") == "our_key_capped", F.col("yearly_cap_usd"))
    spent = F.coalesce("spent_usd", F.lit(0.0))
    return users.join(spend, "id", "left").select(
        F.col("id").alias("user_id"),
        "credit_mode",
        cap.alias("cap_usd"),
        spent.alias("spent_usd"),
        F.when(cap.isNotNull(), half_even(F.greatest(F.lit(0.0), cap - spent), 4)).alias("remaining_usd"),
    )


def usage_overview(usage: DataFrame, users: DataFrame, as_of: str) -> DataFrame:
    """Runs, lab cost and tokens per user, dearest first, and one total row (user_id null)."""
    agg = (
        this_year(usage, as_of)
        .rollup("user_id")
        .agg(
            F.grouping("user_id").alias("g"),
            F.count("*").alias("runs"),
            F.sum(lab_cost()).alias("s"),
            F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
            F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        )
    )
    names = users.select(F.col("id").alias("user_id"), "name", "credit_mode", "yearly_cap_usd")
    return (
        agg.join(names, "user_id", "left")
        .select("user_id", (F.col("g") == 1).alias("is_total"), "name", "credit_mode", "yearly_cap_usd", "runs",
                _usd(F.col("s")).alias("lab_cost_usd"), "input_tokens", "output_tokens")
        .orderBy(F.desc("is_total"), F.desc("lab_cost_usd"), "user_id")
    )


def budget_summary(usage: DataFrame, as_of: str, budget: float) -> DataFrame:
    left = F.when(F.lit(budget) > 0, half_even(F.lit(float(budget)) - F.col("total_usd"), 4))
    return total_spend(usage, as_of).select("total_usd", F.lit(float(budget)).alias("budget_usd"), left.alias("budget_remaining_usd"))


def cap_exceeded(users: DataFrame, usage: DataFrame, as_of: str, budget: float = 0.0) -> DataFrame:
    """Users who may not run now: the shared budget is used up, or their own cap is."""
    spend = spend_by_user(usage, as_of).withColumnRenamed("user_id", "id")
    total = total_spend(usage, as_of).scalar()
    cap = F.coalesce("yearly_cap_usd", F.lit(dims.DEFAULT_CAP_USD))
    spent = F.coalesce("spent_usd", F.lit(0.0))
    all_used = (F.lit(budget) > 0) & (total >= budget)
    own_used = (F.col("credit_mode") == "our_key_capped") & (spent >= cap)
    return (
        users.filter(F.col("credit_mode") != "own_key")
        .join(spend, "id", "left")
        .filter(all_used | own_used)
        .select(F.col("id").alias("user_id"), F.when(all_used, "shared budget").otherwise("own cap").alias("reason"), spent.alias("spent_usd"))
    )


def cap_crossing(usage: DataFrame, users: DataFrame) -> DataFrame:
    """First run at which a capped user's cumulative lab spend reached the cap. Hours are the blocks of the sum."""
    caps = users.filter(F.col("credit_mode") == "our_key_capped").select(
        F.col("id").alias("user_id"), F.coalesce("yearly_cap_usd", F.lit(dims.DEFAULT_CAP_USD)).cast(MONEY).alias("cap")
    )
    rows = usage.filter(~F.col("used_own_key")).join(caps, "user_id")
    summed = running_sum(
        rows, ["user_id"], ["created_at", "id"], F.col("cost_usd").cast(MONEY), F.date_trunc("hour", "created_at"), "cumulative"
    )
    hit = summed.filter(F.col("cumulative") >= F.col("cap"))
    return (
        hit.groupBy("user_id")
        .agg(F.min_by(F.struct("id", "created_at", "cumulative", "cap"), F.struct("created_at", "id")).alias("h"))
        .select("user_id", F.col("h.id").alias("run_id"), F.col("h.created_at").alias("crossed_at"),
                F.col("h.cumulative").cast("double").alias("cumulative_usd"), F.col("h.cap").cast("double").alias("cap_usd"))
    )


def usage_rows(runs: DataFrame) -> DataFrame:
    """Log rows of finished runs: own-key and local runs cost the lab nothing; missing counts are 0."""
    free = F.col("used_own_key") | (F.col("model_choice") == "local")

    def count(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)

    return runs.select(
        "user_id", "report_id", "used_own_key", count("input_tokens"), count("cached_input_tokens"), count("output_tokens"),
        F.when(free, 0.0).otherwise(F.coalesce("estimated_cost_usd", F.lit(0.0))).alias("cost_usd"),
    )


def users_with_counts(users: DataFrame, reports: DataFrame, status: str | None = None, newest: str = "id") -> DataFrame:
    counts = reports.groupBy(F.col("owner_id").alias("id")).agg(F.count("*").alias("report_count"))
    chosen = users if status is None else users.filter(F.col("status") == status)
    return (
        chosen.join(counts, "id", "left")
        .withColumn("report_count", F.coalesce("report_count", F.lit(0)))
        .orderBy(F.desc(newest))
    )


STATUSES = ["pending", "approved", "rejected", "disabled"]


def status_summary(users: DataFrame) -> DataFrame:
    """Count per status; an unused status is 0. One pass, one row per status."""
    one = users.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
    return one.select(F.explode(F.array(*[F.struct(F.lit(s).alias("status"), F.col(s).alias("users")) for s in STATUSES])).alias("r")).select("r.*")


def storage_quota(uploads: DataFrame, quota_bytes: int = dims.STORAGE_QUOTA_BYTES) -> DataFrame:
    used = uploads.groupBy("owner_id").agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("used_bytes"))
    return used.withColumn("over_quota", F.col("used_bytes") > quota_bytes)


def orphan_uploads(uploads: DataFrame, reports: DataFrame) -> DataFrame:
    return uploads.join(reports.select(F.col("upload_id").alias("id")), "id", "left_anti")


def delete_reports(reports: DataFrame, usage: DataFrame, uploads: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remaining reports, usage rows with the link cleared, and uploads minus those only the removed reports used."""
    ids = doomed.select("id").distinct()
    kept = reports.join(ids, "id", "left_anti")
    cleared = (
        usage.join(ids.select(F.col("id").alias("report_id"), F.lit(True).alias("_gone")), "report_id", "left")
        .withColumn("report_id", F.when(F.col("_gone").isNull(), F.col("report_id")))
        .drop("_gone")
    )
    released = reports.join(ids, "id", "left_semi").select(F.col("upload_id").alias("id")).distinct()
    unused = released.join(kept.select(F.col("upload_id").alias("id")), "id", "left_anti")
    return kept, cleared, uploads.join(unused, "id", "left_anti")
