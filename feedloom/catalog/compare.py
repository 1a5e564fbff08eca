"""Comparison across terms: the reports of one course and season, ordered by year."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom import dims
from feedloom.catalog.base import query
from feedloom.catalog.reports import DENSE, GATED, K, gated_rows
from feedloom.functions.numbers import sql_exact_mean, sql_half_even, sql_round2
from feedloom.plans import compare as cmp
from feedloom.plans import report
from feedloom.plans.report import KEYS
from feedloom.views import view

GROUP = ["course_no", "season"]
G = "course_no, season"
POSITIONS = list(range(1, 9))


def reports_of(ok):
    """One row per report with its overall score, its term (ten years on, so that it is in this century) and a
    course name and scoring version that follow from the year."""
    y = F.col("term_year")
    r = report.overall_score(ok, KEYS).withColumn("term", F.concat_ws(" ", "season", (y + 10).cast("string")))
    r = r.withColumn(
        "prompt_version", F.when(y % 3 == 0, "2026-10-08.2").when(y % 3 == 1, "2026-10-08.4")
    ).withColumn("course", F.when(y < 1995, F.concat(F.lit("Course "), F.col("course_no").cast("string"))).otherwise("course 7 "))
    r = r.withColumn("created_at", F.lit(None).cast("timestamp")).withColumn("has_pace", F.lit(True))
    return cmp.order_by_term(r, GROUP, tie="term_year")


def summary_of(spark, ok, reports):
    dense = report.dense_topics(ok, KEYS).select(*KEYS, "topic_no", "average_score", "scored_comment_count")
    return cmp.report_summary(dense).join(reports.select(*KEYS, "pos"), KEYS)


def both(spark, sf):
    ok = gated_rows(spark, sf)
    reports = reports_of(ok)
    return reports, summary_of(spark, ok, reports)


COMPARE = f"""{GATED}, {DENSE},
tx AS (SELECT {K}, feedback, avg(score) AS m FROM ok WHERE score IS NOT NULL GROUP BY ALL),
ov AS (SELECT {K}, {sql_exact_mean('m')} AS x FROM tx GROUP BY ALL),
rep AS (SELECT {K}, {sql_round2('x')} AS overall_score, row_number() OVER (PARTITION BY {G} ORDER BY term_year) AS pos,
  CASE term_year % 3 WHEN 0 THEN '2026-10-08.2' WHEN 1 THEN '2026-10-08.4' END AS prompt_version,
  CASE WHEN term_year < 1995 THEN concat('Course ', course_no) ELSE 'course 7 ' END AS course FROM ov),
summ AS (SELECT {K}, topic_no, {sql_round2('mean')} AS average_score, scored, scored < 5 AS low_sample, pos
  FROM dense JOIN rep USING ({K}) WHERE topic_no <> 13),
chg AS (SELECT {G}, topic_no, min(pos) AS first_pos, count(average_score) AS n,
  arg_min(average_score, pos) FILTER (average_score IS NOT NULL) AS a, arg_max(average_score, pos) FILTER (average_score IS NOT NULL) AS b,
  arg_min(low_sample, pos) FILTER (average_score IS NOT NULL) AS la, arg_max(low_sample, pos) FILTER (average_score IS NOT NULL) AS lb
  FROM summ GROUP BY ALL),
changes AS (SELECT {G}, topic_no, first_pos, CASE WHEN n >= 2 THEN {sql_half_even('b - a', 2)} END AS change,
  coalesce(n >= 2 AND NOT la AND NOT lb, false) AS change_is_reliable FROM chg)"""


@query("report_summary", f"WITH {COMPARE} SELECT {K}, topic_no, average_score, scored AS scored_comment_count, low_sample, pos FROM summ")
def report_summary(spark, sf):
    return both(spark, sf)[1]


@query(
    "order_by_term",
    """WITH k AS (SELECT course, id, term, created_at, CASE WHEN term IS NULL THEN 1 ELSE 0 END AS u,
 coalesce(CAST(regexp_extract(term, '(20\\d{2})', 1) AS STRING), '') AS y20, regexp_extract(term, '(^|[^\\d])(\\d{2})([^\\d]|$)', 2) AS y2,
 CASE WHEN lower(term) LIKE '%spring%' THEN 2 WHEN lower(term) LIKE '%fall%' THEN 4 ELSE 0 END AS s FROM reports),
z AS (SELECT *, CASE WHEN y20 <> '' THEN CAST(y20 AS INT) WHEN coalesce(y2, '') <> '' THEN 2000 + CAST(y2 AS INT) END AS y FROM k)
SELECT course, id, row_number() OVER (PARTITION BY course ORDER BY CASE WHEN y IS NULL THEN 1 ELSE 0 END, coalesce(y, 0),
 CASE WHEN y IS NULL THEN 0 ELSE s END, created_at NULLS FIRST, id) AS pos FROM z""",
)
def order_by_term(spark, sf):
    return cmp.order_by_term(view(spark, sf, "reports"), ["course"]).select("course", "id", "pos")


CELLS = ", ".join(f"max(average_score) FILTER (pos = {p}) AS r{p}" for p in POSITIONS)


@query("topic_matrix", f"WITH {COMPARE} SELECT {G}, topic_no, min(pos) AS first_pos, {CELLS} FROM summ GROUP BY ALL")
def topic_matrix(spark, sf):
    return cmp.topic_matrix(both(spark, sf)[1], GROUP, POSITIONS)


@query("topic_change", f"WITH {COMPARE} SELECT {G}, topic_no, first_pos, change, change_is_reliable FROM changes")
def topic_change(spark, sf):
    return cmp.topic_change(both(spark, sf)[1], GROUP)


@query(
    "improved_declined",
    f"""WITH {COMPARE}, n AS (SELECT * FROM changes WHERE change_is_reliable AND abs(change) >= 0.3),
u AS (SELECT {G}, 'improved' AS direction, topic_no, change, row_number() OVER (PARTITION BY {G} ORDER BY change DESC, first_pos DESC, topic_no DESC) AS r FROM n WHERE change > 0),
d AS (SELECT {G}, 'declined' AS direction, topic_no, change, row_number() OVER (PARTITION BY {G} ORDER BY change, first_pos, topic_no) AS r FROM n WHERE change < 0)
SELECT {G}, direction, CAST(r AS INT) AS rank, topic_no, change FROM (SELECT * FROM u UNION ALL SELECT * FROM d) WHERE r <= 3""",
)
def improved_declined(spark, sf):
    return cmp.improved_declined(cmp.topic_change(both(spark, sf)[1], GROUP), GROUP)


def ratings_of(ok, reports):
    """A rating table per report and pace direction, its mean taken from the scores."""
    q = F.concat(F.lit("How was it:  "), F.coalesce("direction", F.lit("Overall")), F.lit("?"))
    r = ok.withColumn("question", q).groupBy(*KEYS, "question").agg(report.round2(F.avg("score")).alias("mean"))
    return r.join(reports.select(*KEYS, "pos"), KEYS).withColumn("table_no", F.lit(1))


@query(
    "rating_changes",
    f"""WITH {COMPARE}, q AS (SELECT {K}, concat('How was it:  ', coalesce(direction, 'Overall'), '?') AS question, avg(score) AS m FROM ok GROUP BY ALL),
rt AS (SELECT {G}, pos, question, {sql_round2('m')} AS mean FROM q JOIN rep USING ({K}) WHERE m IS NOT NULL)
SELECT {G}, min(question) AS question, {', '.join(f'max(mean) FILTER (pos = {p}) AS r{p}' for p in POSITIONS)},
 {sql_half_even('arg_max(mean, pos) - arg_min(mean, pos)', 2)} AS change
FROM rt GROUP BY {G}, trim(regexp_replace(regexp_replace(lower(question), '\\s+', ' ', 'g'), '[^a-z0-9 ]', '', 'g')) HAVING count(*) >= 2""",
)
def rating_changes(spark, sf):
    ok = gated_rows(spark, sf)
    return cmp.rating_changes(ratings_of(ok, reports_of(ok)), GROUP, POSITIONS)


@query(
    "comparison_warnings",
    f"""WITH {COMPARE}, a AS (SELECT {G}, count(DISTINCT lower(trim(course))) AS c, bool_or(prompt_version IS NULL OR prompt_version < '{dims.PACE_SCALE_FIXED_IN}') AS old,
 count(DISTINCT prompt_version) AS v FROM rep GROUP BY ALL), b AS (SELECT {G}, bool_or(change IS NOT NULL AND NOT change_is_reliable) AS weak FROM changes GROUP BY ALL)
SELECT {G}, array_to_string(list_filter([CASE WHEN c > 1 THEN '{cmp.WARNING_TEXT["different courses"]}' END, CASE WHEN old THEN '{cmp.WARNING_TEXT["old pace scale"]}' END,
 CASE WHEN v > 1 THEN '{cmp.WARNING_TEXT["mixed prompt versions"]}' END, CASE WHEN weak THEN '{cmp.WARNING_TEXT["low sample changes"]}' END], lambda x: x IS NOT NULL), ' ') AS warnings
FROM a LEFT JOIN b USING ({G})""",
)
def comparison_warnings(spark, sf):
    reports, summary = both(spark, sf)
    out = cmp.comparison_warnings(reports, cmp.topic_change(summary, GROUP), GROUP)
    texts = F.create_map(*[F.lit(x) for pair in cmp.WARNING_TEXT.items() for x in pair])
    return out.withColumn("warnings", F.array_join(F.transform("warnings", lambda w: texts[w]), " "))


@query(
    "overall_change",
    f"""WITH {COMPARE} SELECT {G}, CASE WHEN count(*) >= 2 THEN {sql_half_even('arg_max(overall_score, pos) - arg_min(overall_score, pos)', 2)} END AS overall_change
FROM rep GROUP BY {G}""",
)
def overall_change(spark, sf):
    return cmp.overall_change(reports_of(gated_rows(spark, sf)), GROUP)


@query(
    "trend_rows",
    f"""WITH {COMPARE} SELECT r.course_no, r.season, r.pos, r.overall_score AS overall, max(average_score) FILTER (topic_no = 2) AS topic_2,
 max(average_score) FILTER (topic_no = 5) AS topic_5 FROM rep r LEFT JOIN summ s USING ({G}, pos) GROUP BY ALL""",
)
def trend_rows(spark, sf):
    reports, summary = both(spark, sf)
    return cmp.trend_rows(reports, summary, GROUP, [2, 5])


REQUESTS = """
req AS (SELECT owner_id AS request_id, CASE WHEN owner_id % 10 = 0 THEN owner_id + 1 ELSE owner_id END AS user_id,
  CASE WHEN owner_id % 7 = 0 THEN concat(min(id), ',x') ELSE concat(max(id), ', ', min(id), ',', max(id), ',') END AS ids FROM reports GROUP BY owner_id)"""


def requests(reports):
    o = F.col("owner_id")
    lo, hi = F.min("id").cast("string"), F.max("id").cast("string")
    return reports.groupBy("owner_id").agg(
        F.when(o % 7 == 0, F.concat(lo, F.lit(",x"))).otherwise(F.concat(hi, F.lit(", "), lo, F.lit(","), hi, F.lit(","))).alias("ids")
    ).select(o.alias("request_id"), F.when(o % 10 == 0, o + 1).otherwise(o).alias("user_id"), "ids")


@query(
    "compare_selection",
    f"""WITH {REQUESTS}, p AS (SELECT request_id, user_id, ids, ids LIKE '%x' AS bad,
  CASE WHEN ids LIKE '%x' THEN NULL ELSE list_filter(string_split(ids, ','), lambda x: x <> '') END AS l FROM req),
u AS (SELECT *, CASE WHEN CAST(l[1] AS BIGINT) = CAST(trim(l[2]) AS BIGINT) THEN [CAST(l[1] AS BIGINT)] ELSE [CAST(l[1] AS BIGINT), CAST(trim(l[2]) AS BIGINT)] END AS w FROM p)
SELECT request_id, user_id, CASE WHEN bad THEN 'not a list of numbers' WHEN len(w) < 2 THEN 'wrong number of reports'
  WHEN user_id <> request_id THEN 'not found' ELSE 'ok' END AS status,
  CASE WHEN bad OR len(w) < 2 OR user_id <> request_id THEN NULL ELSE array_to_string(w, ',') END AS report_ids FROM u""",
)
def compare_selection(spark, sf):
    r = view(spark, sf, "reports")
    out = cmp.compare_selection(requests(r), r)
    return out.withColumn("report_ids", F.array_join(F.transform("report_ids", lambda x: x.cast("string")), ","))
