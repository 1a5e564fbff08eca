"""The chain from comments to reports: stored answers are not asked for again, every field has its place."""

import json

import pytest
from pyspark.sql import functions as F

from feedloom import dims
from feedloom.plans import chain, scoring

ROWS = [
    ("c", 1, "The midterm was unfair and dragging", "What did you think?", False), ("c", 2, "The midterm was unfair and  dragging", None, False), ("c", 3, "great teacher, great class", None, False),
    ("c", 4, "perhaps the slides", None, False), ("c", 5, "torn page", None, False), ("c", 6, "well prepared", "Did you feel prepared?", True), ("c", 7, "", None, False),
    ("d", 1, "great teacher, great class", None, False),
]


@pytest.fixture(scope="module")
def comments(spark):
    return spark.createDataFrame(ROWS, "course_id string, ord long, text string, question string, non_teaching boolean")


def scorer(seen):
    def score(rows):
        seen.append(rows.count())
        cues = [(10, ["midterm"], None), (2, ["dragging"], "too_slow"), (12, ["slides"], None)]
        return scoring.score_comments(rows, cues, positive=["great", "teacher"], negative=["unfair"], unsure=["perhaps"], unreadable=["torn"])

    return score


def test_a_second_run_asks_nothing(spark, comments):
    seen, topics = [], dims.topics(spark)
    first = chain.course_reports(comments, topics, ["course_id"], scorer(seen), created=1)
    cache = spark.createDataFrame(first.cache.collect(), chain.CACHE)
    second = chain.course_reports(comments, topics, ["course_id"], scorer(seen), cache, created=2)
    # one request for the text of both courses; the skipped and the empty one are not asked for
    assert seen == [4, 0]
    assert sorted(map(str, first.rows.collect())) == sorted(map(str, second.rows.collect()))
    assert {r["created"] for r in second.cache.collect()} == {1}


def test_documents_have_every_field(spark, comments):
    got = chain.course_reports(comments, dims.topics(spark), ["course_id"], scorer([]))
    ratings = spark.createDataFrame([("c", "clear?", 3, 4.5, {"5": 2, "4": 1})], "course_id string, question string, n long, mean double, distribution map<string,long>")
    parsed = spark.createDataFrame([("c", "pdf", ["skipped some"])], "course_id string, parser string, warnings array<string>")
    docs = {(r["course_id"], r["chunk"]): json.loads(r["report_json"]) for r in chain.documents(got, ["course_id"], "m", ratings, parsed, {"pipeline_mode": "single"}, 2).collect()}
    head, meta = docs["c", 0], docs["c", 0]["metadata"]
    assert head["overall_score"] == 2.0 and head["general_sentiment"] == {"average_score": 5.0, "scored_comments": 1, "positive": 1, "neutral": 0, "negative": 0}
    assert len(head["categories"]) == len(head["topic_summaries"]) == 13 and len(head["category_scores"]) == 12
    pace = head["categories"][dims.PACE_NO - 1]
    assert pace["comment_count"] == 1 and pace["direction_counts"] == {"too_fast": 0, "too_slow": 1, "appropriate": 0}
    assert head["categories"][12]["comment_count"] == 4 and head["categories"][12]["reliability"] == "not_scored"
    assert head["quantitative"][0]["mean"] == 4.5 and meta["parser"] == "pdf" and meta["extraction_warnings"] == ["skipped some"] and meta["pipeline_mode"] == "single"
    want = {"input_comments": 7, "processed_comments": 5, "duplicates_removed": 1, "non_teaching_skipped": 1, "scored_comments": 1, "generic_comments": 4, "classification_errors": 1, "scoring_errors": 0}
    assert {k: meta[k] for k in want} == want and len(meta["warnings"]) == 3
    assert meta["dropped_topic_assignments"] == {"topic_unsupported": 0, "low_confidence": 1, "all_topics_rejected": 1}
    listed = [c for (course, chunk), d in docs.items() if course == "c" and chunk for c in d["comments"]]
    assert len(listed) == 6 and all(set(c) == {"topic", *chain.PUBLIC} for c in listed) and max(len(d.get("comments", [])) for d in docs.values()) == 2
    other = {c["feedback"]: c for c in listed if c["topic"] == dims.TOPICS[12][1]}
    assert other["great teacher, great class"]["general_score"] == "5" and other["well prepared"]["classification_status"] == "skipped_question"
    assert docs["d", 0]["quantitative"] in (None, []) and docs["d", 0]["overall_score"] is None


def test_export_has_17_columns(spark, comments):
    got = chain.course_reports(comments, dims.topics(spark), ["course_id"], scorer([]))
    rows = chain.export_rows(got, ["course_id"])
    assert rows.columns == [name for name, _ in chain.EXPORT] and len(rows.columns) == 17
    table = rows.where(F.col("Course ID") == "c").collect()
    assert len(table) == 6 + 13 - 3  # listed comments, and one row for each topic without any
    assert sum(r["Topic Summary"] != "" for r in table) == 13
