"""Gating and report aggregation over the ``assignments`` view."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom import dims
from feedloom.catalog.base import query
from feedloom.functions.numbers import sql_exact_mean, sql_round2
from feedloom.plans import report
from feedloom.plans.report import KEYS
from feedloom.views import view

K = "course_no, term_year, season"


def load(spark, sf):
    return view(spark, sf, "assignments"), dims.topics(spark)


def gated_rows(spark, sf):
    a, t = load(spark, sf)
    return report.passed(a, t)


GATED = """
gated AS (
  SELECT a.*, CASE WHEN scoring_status = 'model_error' THEN 'model_error' WHEN NOT topic_supported THEN 'unsupported'
              WHEN confidence < threshold THEN 'low_confidence' ELSE 'passed' END AS gate
  FROM assignments a JOIN topics USING (topic_no)),
ok AS (SELECT * FROM gated WHERE gate = 'passed')"""

RELIABILITY = """CASE WHEN topic_no = 13 THEN 'not_scored' WHEN scored = 0 THEN 'unscored' WHEN errors > 0 THEN 'needs_review'
 WHEN scored < 5 THEN 'low_sample' WHEN low > 0 THEN 'mixed_confidence' ELSE 'reliable' END"""

FACTS = f"""SELECT {K}, topic_no, count(*) AS n, count(score) AS scored, avg(score) AS mean,
  count(*) FILTER (scoring_status = 'model_error') AS errors,
  count(*) FILTER (score IS NOT NULL AND confidence < 0.35) AS low,
  count(*) FILTER (score IS NULL AND scoring_status IS DISTINCT FROM 'model_error') AS unscored,
  count(*) FILTER (score >= 4) AS positive, count(*) FILTER (score = 3) AS neutral, count(*) FILTER (score <= 2) AS negative"""


@query("confidence_gate", f"WITH {GATED} SELECT {K}, ord, topic_no, gate FROM gated")
def confidence_gate(spark, sf):
    return report.gate_status(*load(spark, sf)).select(*KEYS, "ord", "topic_no", "gate")


@query(
    "drop_counts",
    f"""WITH {GATED}, c AS (
  SELECT {K}, ord, count(*) FILTER (gate = 'unsupported') u, count(*) FILTER (gate = 'low_confidence') l,
         count(*) FILTER (gate = 'model_error') e, count(*) FILTER (gate = 'passed') p
  FROM gated WHERE topic_no <> 13 GROUP BY ALL)
SELECT {K}, CAST(sum(u) AS BIGINT) AS topic_unsupported, CAST(sum(l) AS BIGINT) AS low_confidence,
       CAST(sum(e) AS BIGINT) AS scoring_errors, count(*) FILTER (p = 0) AS all_topics_rejected FROM c GROUP BY ALL""",
)
def drop_counts(spark, sf):
    return report.drop_counts(report.gate_status(*load(spark, sf)), KEYS)


@query("topic_average", f"WITH {GATED}, f AS ({FACTS} FROM ok GROUP BY ALL) SELECT {K}, topic_no, {sql_round2('mean')} AS average_score FROM f")
def topic_average(spark, sf):
    return report.topic_average(gated_rows(spark, sf), KEYS)


@query(
    "topic_counts",
    f"WITH {GATED}, f AS ({FACTS} FROM ok GROUP BY ALL) SELECT {K}, topic_no, n AS comment_count, scored AS scored_comment_count FROM f",
)
def topic_counts(spark, sf):
    return report.topic_counts(gated_rows(spark, sf), KEYS)


@query(
    "overall_score",
    f"""WITH {GATED}, t AS (SELECT {K}, feedback, avg(score) AS m FROM ok WHERE score IS NOT NULL GROUP BY ALL),
s AS (SELECT {K}, {sql_exact_mean('m')} AS x, count(*) AS n FROM t GROUP BY ALL)
SELECT {K}, {sql_round2('x')} AS overall_score, n AS scored_comments FROM s""",
)
def overall_score(spark, sf):
    return report.overall_score(gated_rows(spark, sf), KEYS)


# Overall scores over the topics that count.
OVERALL = f"""ot AS (SELECT {K}, feedback, avg(score) AS m FROM ok WHERE score IS NOT NULL AND topic_no <> 13 GROUP BY ALL),
os AS (SELECT {K}, {sql_exact_mean('m')} AS x FROM ot GROUP BY ALL), ov AS (SELECT {K}, {sql_round2('x')} AS overall_score FROM os)"""
DENSE = f"""f AS ({FACTS} FROM ok GROUP BY ALL), r AS (SELECT DISTINCT {K} FROM ok),
dense AS (SELECT r.course_no, r.term_year, r.season, t.topic_no, t.topic, coalesce(n, 0) AS n, coalesce(scored, 0) AS scored,
  mean, coalesce(errors, 0) AS errors, coalesce(low, 0) AS low, coalesce(unscored, 0) AS unscored,
  coalesce(positive, 0) AS positive, coalesce(neutral, 0) AS neutral, coalesce(negative, 0) AS negative
  FROM r CROSS JOIN topics t LEFT JOIN f ON f.course_no = r.course_no AND f.term_year = r.term_year
   AND f.season = r.season AND f.topic_no = t.topic_no)"""


@query(
    "dense_topics",
    f"""WITH {GATED}, {DENSE} SELECT {K}, topic_no, topic, {sql_round2('mean')} AS average_score, n AS comment_count,
  scored AS scored_comment_count, {RELIABILITY} AS reliability FROM dense""",
)
def dense_topics(spark, sf):
    return report.topic_report(*load(spark, sf), KEYS)


@query(
    "reliability",
    f"""WITH f AS ({FACTS} FROM assignments GROUP BY ALL) SELECT {K}, topic_no, {RELIABILITY} AS reliability,
 CASE WHEN topic_no = 13 THEN '' ELSE array_to_string(list_filter([
  CASE WHEN scored = 0 THEN 'No scored rubric comments.'
       WHEN scored < 5 THEN concat('Low sample: ', scored, ' scored comments; use as directional evidence only.') END,
  CASE WHEN errors > 0 THEN concat(errors, ' model scoring errors excluded from averages.') END,
  CASE WHEN low > 0 THEN concat(low, ' low-confidence scored comments.') END], lambda x: x IS NOT NULL), ' | ') END AS notes FROM f""",
)
def reliability(spark, sf):
    """Ungated rows, so that every label can occur."""
    a, _ = load(spark, sf)
    return report.reliability(a, KEYS).withColumn("notes", F.array_join("notes", " | "))


@query(
    "pace_directions",
    f"""WITH {GATED}, p AS (SELECT {K}, count(*) FILTER (direction = 'too_fast') AS too_fast,
  count(*) FILTER (direction = 'too_slow') AS too_slow, count(*) FILTER (direction = 'appropriate') AS appropriate
  FROM ok WHERE topic_no = 2 GROUP BY ALL) SELECT *, too_fast + too_slow + appropriate AS total FROM p""",
)
def pace_directions(spark, sf):
    return report.pace_directions(gated_rows(spark, sf), KEYS)


@query(
    "report_warnings",
    f"""WITH {GATED}, {DENSE}, e AS (
  SELECT {K}, count(*) FILTER (gate = 'model_error') AS se, count(*) FILTER (topic_no = 13) AS gc,
         count(*) FILTER (gate = 'unsupported') AS ce FROM gated GROUP BY ALL),
w AS (SELECT {K}, string_agg(topic, ', ' ORDER BY topic_no)
        FILTER (topic_no <> 13 AND n > 0 AND ({RELIABILITY}) IN ('low_sample', 'unscored')) AS weak FROM dense GROUP BY ALL)
SELECT {K}, array_to_string(list_filter([
  'Low-sample category scores should not be treated as stable professor metrics: ' || weak,
  CASE WHEN ce = 1 THEN '1 feedback item failed classification and was excluded from rubric scoring.'
       WHEN ce > 0 THEN ce || ' feedback items failed classification and were excluded from rubric scoring.' END,
  CASE WHEN se = 1 THEN '1 topic assignment failed scoring and was excluded.'
       WHEN se > 0 THEN se || ' topic assignments failed scoring and were excluded.' END,
  CASE WHEN gc = 1 THEN '1 generic or uncategorized comment is summarized but excluded from rubric averages.'
       WHEN gc > 0 THEN gc || ' generic or uncategorized comments are summarized but excluded from rubric averages.' END],
  lambda x: x IS NOT NULL), ' | ') AS warnings
FROM w JOIN e USING ({K})""",
)
def report_warnings(spark, sf):
    a, t = load(spark, sf)
    gated = report.gate_status(a, t)
    errors = gated.groupBy(*KEYS).agg(
        F.count_if(F.col("gate") == "unsupported").alias("classification_errors"),
        F.count_if(F.col("gate") == "model_error").alias("scoring_errors"),
        F.count_if(F.col("topic_no") == dims.OTHER_NO).alias("generic_comments"),
    )
    dense = report.dense_topics(gated.filter(F.col("gate") == "passed"), KEYS)
    return report.report_warnings(dense, errors, t, KEYS).withColumn("warnings", F.array_join("warnings", " | "))


@query(
    "summary_prefix",
    f"""WITH {GATED}, {DENSE}, lone AS (SELECT {K}, topic_no, min(feedback) AS fb, min(score) AS sc FROM ok GROUP BY ALL HAVING count(*) = 1)
SELECT d.course_no, d.term_year, d.season, d.topic_no, 'Summary of ' || topic || ': ' || CASE
  WHEN n = 0 THEN 'No comments were assigned to this topic.'
  WHEN n = 1 THEN concat('One assigned comment was ', CASE WHEN d.topic_no = 13 THEN 'unscored' WHEN sc <= 2 THEN 'negative'
       WHEN sc >= 4 THEN 'positive' ELSE 'neutral' END,
       CASE WHEN sc IS NOT NULL THEN concat(' with a score of ', sc, '/5') ELSE '' END, ', citing: "',
       CASE WHEN length(fb) > 180 THEN rtrim(substr(fb, 1, 177)) || '...' ELSE fb END, '"')
  WHEN d.topic_no = 13 THEN concat(n, ' generic or uncategorized comments; excluded from rubric averages.')
  ELSE concat(n, ' assigned comments; ', scored, ' scored; ',
       CASE WHEN mean IS NULL THEN 'no rubric average' ELSE concat('average ', {sql_round2('mean')}, '/5') END,
       '; ', positive, ' positive, ', neutral + unscored, ' neutral, ', negative, ' negative.') END AS summary
FROM dense d LEFT JOIN lone l ON l.course_no = d.course_no AND l.term_year = d.term_year AND l.season = d.season AND l.topic_no = d.topic_no""",
)
def summary_prefix(spark, sf):
    _, t = load(spark, sf)
    return report.summary_prefix(gated_rows(spark, sf), t, KEYS)


# Usage of each user as one run; the run's provider and model follow from the user id, some of them unknown.
CALLS = """
calls AS (SELECT user_id, user_id % 97 = 0 AS is_local, (input_tokens // 100) % 5 = 0 AS cache_hit, input_tokens, cached_input_tokens, output_tokens,
  CASE user_id % 4 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' WHEN 2 THEN 'gemini' ELSE 'elsewhere' END AS provider,
  CASE user_id % 3 WHEN 0 THEN 'gpt-5.6-sol' WHEN 1 THEN 'claude-haiku-5-5' ELSE 'gemini-2.5-pro' END AS model_id FROM usage_log)"""
_PRICES = ", ".join(f"({p}, '{a}', '{b}', {x}, {y}, {z}, {str(d).lower()})" for p, a, b, x, y, z, d in dims.MODEL_PRICES)
PRICED = f"""
prices AS (SELECT pos, provider, model_id, CAST(p_in AS DOUBLE) AS p_in, CAST(p_cached AS DOUBLE) AS p_cached, CAST(p_out AS DOUBLE) AS p_out, d
  FROM (VALUES {_PRICES}) v(pos, provider, model_id, p_in, p_cached, p_out, d)),
usual AS (SELECT * FROM prices QUALIFY row_number() OVER (PARTITION BY provider ORDER BY d DESC, pos) = 1),
priced AS (SELECT c.*, coalesce(e.provider, u.provider, f.provider) AS used_provider, coalesce(e.model_id, u.model_id, f.model_id) AS used_model,
  coalesce(e.p_in, u.p_in, f.p_in) AS p_in, coalesce(e.p_cached, u.p_cached, f.p_cached) AS p_cached, coalesce(e.p_out, u.p_out, f.p_out) AS p_out
  FROM calls c LEFT JOIN prices e ON e.provider = c.provider AND e.model_id = c.model_id
  LEFT JOIN usual u ON u.provider = c.provider CROSS JOIN (SELECT * FROM usual WHERE provider = 'openai') f)"""


def calls(spark, sf):
    u = view(spark, sf, "usage_log")
    i = F.col("user_id")
    return u.select(
        "user_id",
        (i % 97 == 0).alias("is_local"),
        (F.floor(F.col("input_tokens") / 100) % 5 == 0).alias("cache_hit"),
        "input_tokens",
        "cached_input_tokens",
        "output_tokens",
        F.when(i % 4 == 0, "openai").when(i % 4 == 1, "anthropic").when(i % 4 == 2, "gemini").otherwise("elsewhere").alias("provider"),
        F.when(i % 3 == 0, "gpt-5.6-sol").when(i % 3 == 1, "claude-haiku-5-5").otherwise("gemini-2.5-pro").alias("model_id"),
    )


@query(
    "token_cost",
    f"""WITH {CALLS}, {PRICED}, s AS (SELECT user_id, count(*) FILTER (NOT cache_hit) AS calls, count(*) FILTER (cache_hit) AS cache_hits,
  CAST(coalesce(sum(input_tokens) FILTER (NOT cache_hit), 0) AS BIGINT) AS input_tokens,
  CAST(coalesce(sum(cached_input_tokens) FILTER (NOT cache_hit), 0) AS BIGINT) AS cached_input_tokens,
  CAST(coalesce(sum(output_tokens) FILTER (NOT cache_hit), 0) AS BIGINT) AS output_tokens,
  bool_or(NOT cache_hit AND NOT is_local) AS billable, max(p_in) AS p_in, max(p_cached) AS p_cached, max(p_out) AS p_out FROM priced GROUP BY user_id)
SELECT user_id, calls, cache_hits, input_tokens, cached_input_tokens, output_tokens, CASE WHEN billable THEN
  round((greatest(0, input_tokens - cached_input_tokens) * p_in + cached_input_tokens * p_cached + output_tokens * p_out) / 1000000, 6)
  ELSE 0.0::DOUBLE END AS cost_usd FROM s""",
)
def token_cost(spark, sf):
    return report.token_cost(report.price_lookup(calls(spark, sf), dims.model_prices(spark)), ["user_id"])


@query(
    "price_lookup",
    f"WITH {CALLS}, {PRICED} SELECT provider, model_id, used_provider, used_model, p_in, p_cached, p_out, count(*) AS calls FROM priced GROUP BY ALL",
)
def price_lookup(spark, sf):
    out = report.price_lookup(calls(spark, sf), dims.model_prices(spark))
    return out.groupBy("provider", "model_id", "used_provider", "used_model", "p_in", "p_cached", "p_out").agg(F.count("*").alias("calls"))
