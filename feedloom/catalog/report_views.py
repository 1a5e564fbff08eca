"""Reader-side views over the ``assignments`` view."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom import dims
from feedloom.catalog.base import query
from feedloom.catalog.reports import K
from feedloom.catalog.text import BULLETED, sql_bullets
from feedloom.functions.numbers import sql_exact_mean, sql_round2
from feedloom.plans import report_views as rv
from feedloom.plans.report import KEYS
from feedloom.views import table, view

# Texts that got a 1 on any topic are ignored for topic 5.
IGNORED = f"""
lst AS (SELECT DISTINCT {K}, feedback FROM assignments WHERE score = 1),
cur AS (SELECT a.* EXCLUDE (ignored), CASE WHEN topic_no = 5 THEN l.feedback IS NOT NULL ELSE ignored END AS ignored
  FROM assignments a LEFT JOIN lst l USING ({K}, feedback))"""


def edited(spark, sf):
    a = view(spark, sf, "assignments")
    return rv.apply_ignored(a, a.filter(F.col("score") == 1), 5, KEYS)


@query("apply_ignored", f"WITH {IGNORED} SELECT {K}, ord, topic_no, score, ignored FROM cur")
def apply_ignored(spark, sf):
    return edited(spark, sf).select(*KEYS, "ord", "topic_no", "score", "ignored")


RECALC = f"""
t AS (SELECT {K}, topic_no, count(*) AS comment_count, avg(score) FILTER (NOT ignored) AS mean, count(score) FILTER (NOT ignored) AS scored,
  count(*) FILTER (NOT ignored AND scoring_status = 'model_error') AS e,
  count(*) FILTER (NOT ignored AND score IS NOT NULL AND confidence < 0.35) AS w,
  avg(score) AS old_mean FROM cur WHERE topic_no <> 13 GROUP BY ALL),
x AS (SELECT {K}, feedback, avg(score) AS a, avg(score) FILTER (NOT ignored) AS b FROM cur WHERE topic_no <> 13 AND score IS NOT NULL GROUP BY ALL),
o AS (SELECT {K}, {sql_exact_mean('a')} AS a, {sql_exact_mean('b')} AS b FROM x GROUP BY ALL)"""


@query(
    "recalculate",
    f"""WITH {IGNORED}, {RECALC} SELECT {K}, topic_no, {sql_round2('mean')} AS average_score, comment_count, scored AS scored_comment_count,
 CASE WHEN scored = 0 THEN 'unscored' WHEN e > 0 THEN 'needs_review' WHEN scored < 5 THEN 'low_sample' WHEN w > 0 THEN 'mixed_confidence'
 ELSE 'reliable' END AS reliability, {sql_round2('b')} AS overall_score FROM t LEFT JOIN o USING ({K})""",
)
def recalculate(spark, sf):
    return rv.recalculate(edited(spark, sf), KEYS)


@query(
    "recalc_delta",
    f"""WITH {IGNORED}, {RECALC} SELECT {K}, topic_no, {sql_round2('old_mean')} AS old_average, {sql_round2('mean')} AS new_average,
 {sql_round2('a')} AS old_overall, {sql_round2('b')} AS new_overall FROM t LEFT JOIN o USING ({K})""",
)
def recalc_delta(spark, sf):
    return rv.recalc_delta(edited(spark, sf), KEYS)


VIEW = f"""
p AS (SELECT {K}, feedback, topic_no, max(score) AS s, bool_or(ignored) AS i, min(ord) AS o FROM assignments GROUP BY ALL),
v AS (SELECT {K}, feedback, min(o) AS idx, list(topic_no ORDER BY topic_no) AS topics,
  coalesce(string_agg(topic_no || ':' || s, ',' ORDER BY topic_no) FILTER (s IS NOT NULL), '') AS scores,
  coalesce(string_agg(CAST(topic_no AS STRING), ',' ORDER BY topic_no) FILTER (i), '') AS ignored_in,
  CAST(floor(avg(s) + 0.5) AS INT) AS score, max(s) FILTER (topic_no = 3) AS s3 FROM p GROUP BY ALL)"""


def viewed(spark, sf):
    return rv.comment_view(view(spark, sf, "assignments"), KEYS)


def joined(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query("comment_view", f"WITH {VIEW} SELECT {K}, feedback, idx, array_to_string(topics, ',') AS topics, scores, ignored_in FROM v")
def comment_view(spark, sf):
    scores = F.array_join(
        F.transform(F.map_entries("scores"), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))), ","
    )
    return viewed(spark, sf).select(
        *KEYS, "feedback", "idx", joined("topics").alias("topics"), scores.alias("scores"), joined("ignored_in").alias("ignored_in")
    )


@query("comment_mean", f"WITH {VIEW} SELECT {K}, feedback, array_to_string(list_filter(topics, lambda x: x <> 13), ',') AS topics, score FROM v")
def comment_mean(spark, sf):
    return rv.comment_mean(viewed(spark, sf)).select(*KEYS, "feedback", joined("topics").alias("topics"), "score")


@query(
    "score_distribution",
    f"SELECT {K}, topic_no, " + ", ".join(f"count(*) FILTER (NOT ignored AND score = {i}) AS score_{i}" for i in range(1, 6)) + " FROM assignments GROUP BY ALL",
)
def score_distribution(spark, sf):
    return rv.score_distribution(view(spark, sf, "assignments"), KEYS)


@query(
    "sentiment_split",
    f"""SELECT {K}, topic_no, count(*) FILTER (NOT ignored AND score >= 4) AS positive, count(*) FILTER (NOT ignored AND score = 3) AS neutral,
 count(*) FILTER (NOT ignored AND score <= 2) AS negative FROM assignments GROUP BY ALL""",
)
def sentiment_split(spark, sf):
    return rv.sentiment_split(view(spark, sf, "assignments"), KEYS)


@query(
    "sentiment_labels",
    f"""SELECT {K}, topic_no, {', '.join(f"count(*) FILTER (CASE WHEN score >= 4 THEN 'positive' WHEN score <= 2 THEN 'negative' WHEN score = 3 THEN 'neutral' END = '{s}') AS {s}" for s in dims.SENTIMENTS)}
FROM assignments GROUP BY ALL""",
)
def sentiment_labels(spark, sf):
    """The older reports, whose rows carry a label."""
    label = F.expr("CASE WHEN score >= 4 THEN 'positive' WHEN score <= 2 THEN 'negative' WHEN score = 3 THEN 'neutral' END")
    return rv.label_split(view(spark, sf, "assignments").withColumn("sentiment", label), KEYS)


@query(
    "filter_comments",
    f"""WITH {VIEW}, w AS (SELECT {K}, feedback, coalesce(s3, score) AS score FROM v WHERE list_contains(topics, 3) AND contains(lower(feedback), 'comment 1'))
SELECT 'low' AS filter, * FROM w WHERE score <= 2 UNION ALL SELECT 'none', * FROM w WHERE score IS NULL
UNION ALL SELECT 'classic high', {K}, feedback, score FROM v WHERE score >= 3""",
)
def filter_comments(spark, sf):
    v = rv.comment_mean(viewed(spark, sf))
    cols = [*KEYS, "feedback", "score"]
    parts = [
        ("low", rv.filter_comments(v, "low", 3, " Comment 1")),
        ("none", rv.filter_comments(v, "none", 3, "comment 1")),
        ("classic high", rv.filter_comments_classic(v, "high")),
    ]
    out = None
    for name, part in parts:
        p = part.select(F.lit(name).alias("filter"), *cols)
        out = p if out is None else out.unionByName(p)
    return out


@query(
    "sort_comments",
    f"""WITH {VIEW} SELECT {K}, feedback, score, row_number() OVER (PARTITION BY {K} ORDER BY coalesce(score, 6), idx) AS position FROM v""",
)
def sort_comments(spark, sf):
    v = rv.comment_mean(viewed(spark, sf))
    return rv.sort_comments(v, KEYS, "low").select(*KEYS, "feedback", "score", "position")


@query(
    "page_comments",
    f"""WITH {VIEW}, n AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY -coalesce(score, 0), idx) AS position,
  count(*) OVER (PARTITION BY {K}) AS c FROM v)
SELECT {K}, feedback, position FROM n WHERE (position - 1) // 20 = least(3, CAST(greatest(1, ceil(c / 20)) AS BIGINT)) - 1""",
)
def page_comments(spark, sf):
    v = rv.sort_comments(rv.comment_mean(viewed(spark, sf)), KEYS, "high")
    return rv.page_comments(v, 3, 20).select(*KEYS, "feedback", "position")


@query(
    "shared_question",
    """SELECT course_id, CASE WHEN count(DISTINCT nullif(question, '')) = 1 THEN max(nullif(question, '')) END AS shared_question
FROM comments GROUP BY ALL""",
)
def shared_question(spark, sf):
    return rv.shared_question(view(spark, sf, "comments"), ["course_id"])


@query(
    "relabel_legacy",
    f"""SELECT doc_id, CASE WHEN lang = 'de' THEN '{dims.OTHER}' ELSE source END AS topic, replace({sql_bullets(BULLETED)}, '�', '''') AS feedback FROM documents""",
)
def relabel_legacy(spark, sf):
    d = table(spark, sf, "documents").selectExpr(
        "doc_id", f"CASE WHEN lang = 'de' THEN '{dims.LEGACY_OTHER}' ELSE source END AS topic", f"{BULLETED} AS feedback"
    )
    return rv.relabel_legacy(d)


@query(
    "report_quality_checks",
    f"""WITH p AS (SELECT {K}, topic_no, count(*) AS n, sum(strlen(feedback)) AS b FROM assignments GROUP BY ALL),
r AS (SELECT {K}, count(*) AS topics, CAST(sum(n) AS BIGINT) AS comments, sum(b) AS b FROM p GROUP BY ALL)
SELECT {K}, topics, comments, array_to_string(list_filter([CASE WHEN topics > 12 THEN 'too many topics' END,
 CASE WHEN comments > 100 THEN 'too many comments' END, CASE WHEN b > 1500 THEN 'too large' END], lambda x: x IS NOT NULL), ',') AS reasons FROM r""",
)
def report_quality_checks(spark, sf):
    """Limits are lowered so that reports of the test data reach them."""
    out = rv.report_quality_checks(view(spark, sf, "assignments"), KEYS, max_topics=12, max_comments=100, max_bytes=1500)
    return out.withColumn("reasons", F.array_join("reasons", ","))


@query(
    "list_reports",
    """SELECT r.owner_id, r.id, r.course, r.term, r.overall_score, r.created_at, u.original_filename
FROM reports r LEFT JOIN uploads u ON u.id = r.upload_id""",
)
def list_reports(spark, sf):
    out = rv.list_reports(view(spark, sf, "reports"), view(spark, sf, "uploads"))
    return out.select("owner_id", "id", "course", "term", "overall_score", "created_at", "original_filename")


@query(
    "group_history",
    "SELECT course, id, created_at, row_number() OVER (PARTITION BY course ORDER BY created_at, id) AS position FROM reports",
)
def group_history(spark, sf):
    h = view(spark, sf, "reports").select("course", "id", "created_at")
    return rv.group_history(h, "course", ["created_at", "id"], F.date_trunc("day", "created_at"))


@query(
    "scored_topic_count",
    f"""WITH p AS (SELECT {K}, topic_no, count(score) AS n FROM assignments WHERE topic_no <> 13 GROUP BY ALL)
SELECT {K}, count(*) FILTER (n > 0) AS scored_topics FROM p GROUP BY ALL""",
)
def scored_topic_count(spark, sf):
    return rv.scored_topic_count(view(spark, sf, "assignments"), KEYS)
