"""What a query needs more than once is worked out once."""

from pyspark.sql import functions as F

from feedloom.plans import report_views as rv
from feedloom.plans import scoring


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_fields_of_a_reply_are_read_once(spark):
    rows = spark.createDataFrame([(1, '{"topics": []}')], "ord int, reply_json string")
    plan = optimized(scoring.parse_replies(rows).select("results"))
    assert plan.count(".score") == 1 and plan.count(".confidence") == 1 and plan.count(".evidence_quote") == 1


def test_a_text_is_lowered_once(spark):
    rows = spark.createDataFrame([(1, "ab")], "ord int, text string")
    assert optimized(scoring.score_comments(rows)).count("lower(") == 1


def test_sorted_comments_form_their_rows_once(spark):
    rows = spark.createDataFrame([("c", "a", 1, 3), ("c", "b", 2, None), ("c", "a", 1, 4)], "course string, feedback string, ord long, score int")
    v = rows.groupBy("course", "feedback").agg(F.min("ord").alias("idx"), F.max("score").alias("score"))
    out = rv.sort_comments(v, ["course"], "low")
    assert "max(score" not in optimized(out)
    assert sorted((r["position"], r["feedback"], r["total"]) for r in out.collect()) == [(1, "a", 2), (2, "b", 2)]
