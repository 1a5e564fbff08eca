"""From comments to reports in one function: prepare, look up the reply cache, score what is missing, read, gate, aggregate.

Only texts without a stored answer reach the scorer, each once; the cache that comes back has their answers, so a second run calls
the scorer for nothing. Everything after the replies stays in the row or in aggregates with map-side partials.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom import dims
from feedloom.operators import prepare
from feedloom.operators.ordered import block_of, row_numbers
from feedloom.operators.stages import written
from feedloom.plans import report, scoring

CACHE = "key string, answer string, created bigint"
PUBLIC = [
    "feedback", "classification_status", "topic_supported", "evidence_quote", "sentiment", "score", "confidence", "scoring_status",
    "reasoning", "question", "direction", "general_score",
]


class Reports(NamedTuple):
    rows: DataFrame  # (keys, ord, topic_no, public fields): what each topic lists, Other included
    figures: DataFrame  # (keys, topic_no, ...): 13 topics of every report
    head: DataFrame  # (keys, overall_score, general_sentiment, metadata, warnings)
    cache: DataFrame  # (key, answer, created) after the run


def answered(comments: DataFrame, cache: DataFrame, scorer: Callable[[DataFrame], DataFrame], created: int, examples: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(``comments`` with ``reply_json``, the new cache). ``scorer`` gets one row per request without an answer, with the columns of
    ``comments``, and adds ``reply_json``. Empty answers are used but not stored."""
    requests = scoring.analysis_requests(comments, examples).withColumn("key", F.sha2("request", 256)).drop("request")
    requests = written(requests)
    looked = scoring.cache_lookup(requests.select("key").distinct(), cache)
    missing = looked.filter(~F.col("hit")).select("key")
    numbered = requests.withColumn("_row", F.xxhash64(*[c for c in comments.columns if c != "text"]))
    first = numbered.join(missing, "key").groupBy("key").agg(F.min("_row").alias("_row"))  # texts stay where they are
    todo = numbered.join(first, ["key", "_row"], "left_semi").drop("_row").dropDuplicates(["key"])
    new = written(scorer(todo).select("key", F.col("reply_json").alias("answer"), F.lit(created).cast("bigint").alias("created")))
    known = looked.filter("hit").select("key", "answer").unionByName(new.select("key", "answer"))
    replies = requests.join(known, "key", "left").withColumnRenamed("answer", "reply_json").drop("key")
    return replies, scoring.cache_upsert(cache, new)


def _public(topic_rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    have = topic_rows.columns
    kinds = {"topic_supported": "boolean", "score": "int", "confidence": "double", "general_score": "int"}
    return topic_rows.select(*keys, "ord", "topic_no", *[(F.col(c) if c in have else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in PUBLIC])


def course_reports(
    comments: DataFrame,
    topics: DataFrame,
    keys: Sequence[str],
    scorer: Callable[[DataFrame], DataFrame] = scoring.score_comments,
    cache: DataFrame | None = None,
    created: int = 0,
    gate: bool = True,
) -> Reports:
    """Reports of ``comments`` (keys, ord, text, question, non_teaching). Answers about the student are never scored; comments without
    a topic that passes the gate, and errors, are listed under Other, where generic ones keep a score of their own."""
    spark = comments.sparkSession
    cache = cache if cache is not None else spark.createDataFrame([], CACHE)
    items = written(prepare.unify_inputs(comments, keys))
    unique = written(prepare.dedupe_comments(items, keys))
    ask, skipped = prepare.split_skipped(unique)
    replies, cache = answered(ask, cache, scorer, created)
    parsed = written(scoring.parse_replies(replies.unionByName(skipped.withColumn("reply_json", F.lit(None).cast("string")))).drop("reply_json"))
    assessed = written(scoring.assess(parsed, gate))
    found = scoring.topic_rows(parsed.filter(~F.col("non_teaching")), [*keys, "ord", F.col("text").alias("feedback"), "question"])
    gated = report.gate_status(found, topics, gate)
    passed = gated.filter(F.col("gate") == "passed").withColumn("classification_status", F.col("status"))
    other = report.route_other(assessed)
    rest = other.withColumn("topic_no", F.lit(dims.OTHER_NO)).withColumn("feedback", F.col("text"))
    rows = written(_public(passed, keys).unionByName(_public(rest, keys)))

    figures = report.dense_topics(rows, keys).join(report.bound(topics.select("topic_no", "topic")), "topic_no")
    figures = written(figures.join(report.summary_prefix(rows, topics, keys), [*keys, "topic_no"]))
    dropped = report.drop_counts(gated, keys).select(*keys, "topic_unsupported", "scoring_errors")
    metadata = report.report_metadata(prepare.duplicate_counts(items, keys, comments), assessed, keys).join(dropped, list(keys), "left")
    metadata = written(metadata.na.fill(0, ["topic_unsupported", "scoring_errors"]))
    warnings = report.report_warnings(figures.drop("topic"), metadata, topics, keys)
    overall = report.overall_score(rows.filter(F.col("topic_no") != dims.OTHER_NO), keys).drop("scored_comments")
    tone = report.general_sentiment(other, keys)
    fields = [c for c in tone.columns if c not in keys]
    tone = tone.select(*keys, F.struct(*fields).alias("general_sentiment"))
    silent = F.struct(*[F.lit(None if f == "average_score" else 0).cast(tone.schema["general_sentiment"].dataType[f].dataType).alias(f) for f in fields])
    counts = F.struct(*[c for c in metadata.columns if c not in keys])
    head = (
        metadata.select(*keys, counts.alias("metadata")).join(overall, list(keys), "left").join(tone, list(keys), "left").join(warnings, list(keys), "left")
        .withColumn("general_sentiment", F.coalesce("general_sentiment", silent)).withColumn("warnings", F.coalesce("warnings", F.array().cast("array<string>")))
    )
    return Reports(rows, figures, head, cache)


def documents(reports: Reports, keys: Sequence[str], model: str | None = None, quantitative: DataFrame | None = None, extraction: DataFrame | None = None,
              settings: dict | None = None, chunk_rows: int = report.COMMENT_CHUNK) -> DataFrame:
    """(keys, chunk, report_json) with every field of a report. Chunk 0 has the figures, the others its comments, ``chunk_rows`` each.

    ``quantitative`` has (keys, question, n, mean, distribution), ``extraction`` (keys, parser, warnings); both may be missing.
    ``settings`` go into the metadata as they are."""
    course = F.concat_ws("_", *[F.col(k).cast("string") for k in keys]).alias("course_id")
    written_form = {"ignoreNullFields": "false"}
    pace = report.pace_directions(reports.rows, keys).drop("total")
    figures = reports.figures.join(pace, list(keys), "left")
    directions = F.when(F.col("topic_no") == dims.PACE_NO, F.struct(*[F.coalesce(d, F.lit(0)).alias(d) for d in dims.PACE_DIRECTIONS]))
    one = F.struct(
        "topic_no", F.struct(F.col("topic").alias("category"), "average_score", "comment_count").alias("score"), F.struct("topic", "summary").alias("summary"),
        F.struct("topic", "average_score", "comment_count", "scored_comment_count", "reliability", directions.alias("direction_counts")).alias("category"),
    )
    per_report = figures.groupBy(*keys).agg(F.sort_array(F.collect_list(one)).alias("_t"))  # 13 topics
    part = lambda f: F.transform("_t", lambda x: x[f])
    scores = F.transform(F.filter("_t", lambda x: x["topic_no"] != dims.OTHER_NO), lambda x: x["score"])
    head = reports.head.join(per_report, list(keys))
    if quantitative is not None:
        asked = F.sort_array(F.collect_list(F.struct("question", "n", "mean", F.to_json("distribution").alias("distribution"))))  # questions of a form
        head = head.join(quantitative.groupBy(*keys).agg(asked.alias("quantitative")), list(keys), "left")
    else:
        head = head.withColumn("quantitative", F.array())
    if extraction is not None:
        head = head.join(extraction.select(*keys, "parser", F.col("warnings").alias("_found")), list(keys), "left")
    else:
        head = head.withColumn("parser", F.lit("")).withColumn("_found", F.array().cast("array<string>"))
    m = F.col("metadata")
    drops = F.struct(m["topic_unsupported"].alias("topic_unsupported"), m["low_confidence"].alias("low_confidence"), m["all_topics_rejected"].alias("all_topics_rejected"))
    plain = ["input_comments", "processed_comments", "non_teaching_skipped", "duplicates_removed", "scored_comments", "generic_comments", "classification_errors", "scoring_errors"]
    meta = F.struct(
        *[m[c].alias(c) for c in plain], drops.alias("dropped_topic_assignments"), "warnings", F.coalesce("parser", F.lit("")).alias("parser"),
        F.coalesce("_found", F.array().cast("array<string>")).alias("extraction_warnings"), F.lit(dims.PROMPT_VERSION).alias("prompt_version"),
        F.lit(model).cast("string").alias("model_id"), *[F.lit(v).alias(k) for k, v in (settings or {}).items()], F.lit(0).alias("chunk"),
    )
    body = F.struct(
        course, F.lit(model).cast("string").alias("model"), "overall_score", scores.alias("category_scores"), part("summary").alias("topic_summaries"),
        part("category").alias("categories"), "quantitative", "general_sentiment", meta.alias("metadata"),
    )
    head = head.select(*keys, F.lit(0).cast("long").alias("chunk"), F.to_json(body, written_form).alias("report_json"))
    named = reports.rows.join(report.bound(reports.figures.select("topic_no", "topic").distinct()), "topic_no")
    numbered = row_numbers(named, keys, ["ord", "topic_no"], block_of(F.col("ord")), "_n")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    comment = F.struct("topic", *[text(c) for c in PUBLIC])
    chunk = (F.floor((F.col("_n") - 1) / chunk_rows) + 1).cast("long").alias("chunk")
    listed = numbered.groupBy(*keys, chunk).agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", comment.alias("c")))), lambda x: x["c"]).alias("comments"))
    meta = F.struct(F.lit(dims.PROMPT_VERSION).alias("prompt_version"), F.col("chunk"))
    listed = listed.select(*keys, "chunk", F.to_json(F.struct(course, "comments", meta.alias("metadata")), written_form).alias("report_json"))
    return head.unionByName(listed)


# The columns of the flat export.
EXPORT = [
    ("Course ID", "course_id"), ("Overall Score", "overall_score"), ("Topic", "topic"), ("Topic Average Score", "average_score"),
    ("Scored Comment Count", "scored_comment_count"), ("Reliability", "reliability"), ("Feedback", "feedback"), ("Question", "question"),
    ("Classification Status", "classification_status"), ("Topic Supported", "topic_supported"), ("Evidence Quote", "evidence_quote"), ("Sentiment", "sentiment"),
    ("Score", "score"), ("Confidence", "confidence"), ("Scoring Status", "scoring_status"), ("Reasoning", "reasoning"), ("Topic Summary", "summary"),
]


def export_rows(reports: Reports, keys: Sequence[str]) -> DataFrame:
    """The flat export, 17 columns: a row per (topic, comment), one blank row for an empty topic, the summary on a topic's first row."""
    numbered = row_numbers(reports.rows, [*keys, "topic_no"], ["ord"], block_of(F.col("ord")), "_n")
    figures = reports.figures.join(reports.head.select(*keys, "overall_score"), list(keys), "left")
    joined = figures.join(numbered, [*keys, "topic_no"], "left").withColumn("course_id", F.concat_ws("_", *[F.col(k).cast("string") for k in keys]))
    joined = joined.withColumn("summary", F.when(F.coalesce("_n", F.lit(1)) == 1, F.col("summary")).otherwise(""))

    def cell(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("")) if c in PUBLIC else F.col(c)

    return joined.select(*[cell(c).alias(name) for name, c in EXPORT])
