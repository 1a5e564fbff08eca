"""Gate, route and aggregate (comment, topic) rows into course reports.

A report is identified by ``keys`` (any columns). All aggregates are hash aggregates with map-side partials, so a
report that holds a large share of the rows is reduced before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom import dims
from feedloom.functions.numbers import exact_mean, round2
from feedloom.operators.ordered import block_of, row_numbers

KEYS = ["course_no", "term_year", "season"]


COMMENT_CHUNK = 500  # comments per document of a stored report


def bound(dim: DataFrame) -> DataFrame:
    """Broadcast a topic dimension: 13 rows by definition."""
    return F.broadcast(dim)


def gate_status(assignments: DataFrame, topics: DataFrame, gate: bool = True) -> DataFrame:
    """Add ``gate``: model errors first (they carry confidence 0), then support, then the topic's threshold."""
    low = F.coalesce("confidence", F.lit(0.0)) < F.coalesce("threshold", F.lit(dims.DEFAULT_THRESHOLD))
    status = F.when(F.col("scoring_status") == "model_error", "model_error").when(~F.col("topic_supported"), "unsupported")
    if gate:
        status = status.when(low, "low_confidence")
    return assignments.join(bound(topics.select("topic_no", "threshold")), "topic_no", "left").withColumn(
        "gate", status.otherwise("passed")
    )


def passed(assignments: DataFrame, topics: DataFrame, gate: bool = True) -> DataFrame:
    return gate_status(assignments, topics, gate).filter(F.col("gate") == "passed").drop("threshold", "gate")


def drop_counts(gated: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Reasons why rows were dropped, and comments whose every topic was dropped."""
    per_comment = (
        gated.filter(F.col("topic_no") != dims.OTHER_NO)
        .groupBy(*keys, "ord")
        .agg(
            F.count_if(F.col("gate") == "unsupported").alias("u"),
            F.count_if(F.col("gate") == "low_confidence").alias("l"),
            F.count_if(F.col("gate") == "model_error").alias("e"),
            F.count_if(F.col("gate") == "passed").alias("p"),
        )
    )
    return per_comment.groupBy(*keys).agg(
        F.sum("u").alias("topic_unsupported"),
        F.sum("l").alias("low_confidence"),
        F.sum("e").alias("scoring_errors"),
        F.count_if(F.col("p") == 0).alias("all_topics_rejected"),
    )


def reliability_label(scored: Column, errors: Column, low: Column) -> Column:
    return (
        F.when(scored == 0, "unscored")
        .when(errors > 0, "needs_review")
        .when(scored < dims.MIN_RELIABLE, "low_sample")
        .when(low > 0, "mixed_confidence")
        .otherwise("reliable")
    )


def reliability_notes(scored: Column, errors: Column, low: Column) -> Column:
    notes = F.array(
        F.when(scored == 0, F.lit(dims.SENTENCES["no_scored"])).when(
            scored < dims.MIN_RELIABLE,
            F.format_string(dims.SENTENCES["low_sample"], scored),
        ),
        F.when(errors > 0, F.format_string(dims.SENTENCES["errors_excluded"], errors)),
        F.when(low > 0, F.format_string(dims.SENTENCES["low_confidence"], low)),
    )
    return F.filter(notes, lambda n: n.isNotNull())


def topic_facts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One aggregate per (report, topic) that the other topic figures are projections of."""
    return rows.groupBy(*keys, "topic_no").agg(
        F.count("*").alias("comment_count"),
        F.count("score").alias("scored_comment_count"),
        F.avg("score").alias("mean"),
        F.count_if(F.col("scoring_status") == "model_error").alias("errors"),
        F.count_if(F.col("score").isNotNull() & (F.col("confidence") < dims.LOW_CONFIDENCE)).alias("low"),
        F.count_if(F.col("score").isNull() & ~F.col("scoring_status").eqNullSafe("model_error")).alias("unscored"),
        F.count_if(F.col("score") >= 4).alias("positive"),
        F.count_if(F.col("score") == 3).alias("neutral"),
        F.count_if(F.col("score") <= 2).alias("negative"),
    )


def topic_average(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return topic_facts(rows, keys).select(*keys, "topic_no", round2(F.col("mean")).alias("average_score"))


def topic_counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return topic_facts(rows, keys).select(*keys, "topic_no", "comment_count", "scored_comment_count")


def reliability(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    s, e, w = F.col("scored_comment_count"), F.col("errors"), F.col("low")
    other = F.col("topic_no") == dims.OTHER_NO
    return topic_facts(rows, keys).select(
        *keys,
        "topic_no",
        F.when(other, "not_scored").otherwise(reliability_label(s, e, w)).alias("reliability"),
        F.when(other, F.array().cast("array<string>")).otherwise(reliability_notes(s, e, w)).alias("notes"),
    )


def pace_directions(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Always the three counts and their total, for every report that has a Pace row."""
    pace = rows.filter(F.col("topic_no") == dims.PACE_NO)
    counts = pace.groupBy(*keys).agg(*[F.count_if(F.col("direction") == d).alias(d) for d in dims.PACE_DIRECTIONS])
    return counts.withColumn("total", sum((F.col(d) for d in dims.PACE_DIRECTIONS), F.lit(0)).cast("long"))


def overall_score(rows: DataFrame, keys: Sequence[str], text: str = "feedback") -> DataFrame:
    """Mean over distinct texts of each text's unrounded mean score; equal texts share one mean."""
    per_text = rows.filter(F.col("score").isNotNull()).groupBy(*keys, text).agg(F.avg("score").alias("m"))
    return per_text.groupBy(*keys).agg(
        round2(exact_mean(F.col("m"))).alias("overall_score"), F.count("*").alias("scored_comments")
    )


def dense_topics(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every report lists all 13 topics; a topic without rows has zero counts and no average."""
    facts = topic_facts(rows, keys)
    figures = [c for c in facts.columns if c not in (*keys, "topic_no")]
    # One pass: fold the topics of a report (at most 13) into a map, then unfold it densely.
    per_report = facts.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("topic_no", F.struct(*figures)))).alias("by_topic")
    )
    dense = per_report.select(
        *keys,
        "by_topic",
        F.explode(F.array(*[F.lit(no) for no, *_ in dims.TOPICS])).alias("topic_no"),
    ).withColumn("f", F.try_element_at("by_topic", F.col("topic_no")))
    out = dense.select(
        *keys,
        "topic_no",
        *[
            (F.col(f"f.{c}") if c == "mean" else F.coalesce(F.col(f"f.{c}"), F.lit(0)).cast("long")).alias(c)
            for c in figures
        ],
    )
    return out.withColumn("average_score", round2(F.col("mean"))).withColumn(
        "reliability",
        F.when(F.col("topic_no") == dims.OTHER_NO, "not_scored").otherwise(
            reliability_label(F.col("scored_comment_count"), F.col("errors"), F.col("low"))
        ),
    )


def topic_report(assignments: DataFrame, topics: DataFrame, keys: Sequence[str], gate: bool = True) -> DataFrame:
    """The flagship report: gate, aggregate, fill in empty topics, name them."""
    return topic_report_of(passed(assignments, topics, gate), topics, keys)


def summary_prefix(rows: DataFrame, topics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count sentence of each topic; a lone comment is quoted; an empty topic says so; Other has its own form."""
    dense = dense_topics(rows, keys)
    lone = (
        rows.groupBy(*keys, "topic_no")
        .agg(F.count("*").alias("n"), F.max_by(F.struct("feedback", "score"), "ord").alias("only"))
        .filter(F.col("n") == 1)
        .select(*keys, "topic_no", "only")
    )
    head = F.concat(F.lit("Summary of "), F.col("topic"), F.lit(": "))
    s = F.col("only.score")
    word = (
        F.when(s.isNull(), F.lit("neutral")).when(s <= 2, "negative").when(s >= 4, "positive").otherwise("neutral")
    )
    body = (
        F.when(F.col("comment_count") == 0, F.lit(dims.SENTENCES["no_comments"]))
        .when(
            (F.col("comment_count") == 1) & (F.col("topic_no") != dims.OTHER_NO),
            F.concat(
                F.lit(dims.SENTENCES["one_comment"]),
                word,
                F.when(s.isNotNull(), F.format_string(dims.SENTENCES["with_score"], s)).otherwise(""),
                F.lit(', citing: "'),
                quote_text(F.col("only.feedback"), 180),
                F.lit('"'),
            ),
        )
        .when(
            (F.col("comment_count") == 1),
            F.concat(F.lit(dims.SENTENCES["one_unscored"]), quote_text(F.col("only.feedback"), 180), F.lit('"')),
        )
        .when(
            F.col("topic_no") == dims.OTHER_NO,
            F.format_string(
                dims.SENTENCES["generic_count"], F.col("comment_count")
            ),
        )
        .otherwise(
            F.concat(
                F.format_string(dims.SENTENCES["assigned"], "comment_count", "scored_comment_count"),
                F.when(
                    F.col("average_score").isNotNull(), F.format_string("average %s/5", F.col("average_score").cast("string"))
                ).otherwise(dims.SENTENCES["no_average"]),
                F.format_string(
                    dims.SENTENCES["moods"],
                    F.col("positive"),
                    F.col("neutral") + F.col("unscored"),  # an unscored supported row is neutral
                    F.col("negative"),
                ),
                F.when(
                    F.col("errors") > 0,
                    F.format_string(dims.SENTENCES["errors_were"], "errors"),
                ).otherwise(""),
            )
        )
    )
    return (
        dense.join(bound(topics.select("topic_no", "topic")), "topic_no")
        .join(lone, [*keys, "topic_no"], "left")
        .select(*keys, "topic_no", F.concat(head, body).alias("summary"))
    )


def quote_text(text: Column, limit: int) -> Column:
    """Cut to ``limit`` characters with dots; the part before the dots is right-trimmed."""
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit - 3)), F.lit("..."))).otherwise(text)


def report_warnings(dense: DataFrame, errors: DataFrame, topics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``errors`` has classification_errors, scoring_errors and generic_comments per report."""
    weak = (F.col("topic_no") != dims.OTHER_NO) & (F.col("comment_count") > 0) & F.col("reliability").isin(
        "low_sample", "unscored"
    )
    per_report = (
        dense.join(bound(topics.select("topic_no", "topic")), "topic_no")
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.when(weak, F.struct("topic_no", "topic")))).alias("weak"))  # <= 13 entries
    )

    def counted(n: str, one: str, many: str, verb_one: str, verb_many: str, tail: str) -> Column:
        c = F.col(n)
        return F.when(
            c > 0,
            F.concat_ws(
                " ",
                c.cast("string"),
                F.when(c == 1, one).otherwise(many),
                F.when(c == 1, verb_one).otherwise(verb_many),
                F.lit(tail),
            ),
        )

    generic = F.when(
        F.col("generic_comments") > 0,
        F.concat_ws(
            " ",
            F.col("generic_comments").cast("string"),
            F.when(F.col("generic_comments") == 1, dims.SENTENCES["generic_one"]).otherwise(
                dims.SENTENCES["generic_many"]
            ),
            F.lit(dims.SENTENCES["generic_tail"]),
        ),
    )
    warnings = F.array(
        F.when(
            F.size("weak") > 0,
            F.concat(
                F.lit(dims.SENTENCES["low_sample_topics"]),
                F.array_join(F.col("weak.topic"), ", "),
            ),
        ),
        counted(
            "classification_errors", dims.SENTENCES["failed_item"], dims.SENTENCES["failed_items"],
            "was", "were", dims.SENTENCES["failed_tail"],
        ),
        counted(
            "scoring_errors", dims.SENTENCES["failed_topic"], dims.SENTENCES["failed_topics"],
            "was", "were", "excluded.",
        ),
        generic,
    )
    return per_report.join(errors, list(keys)).select(
        *keys, F.filter(warnings, lambda w: w.isNotNull()).alias("warnings")
    )


def route_other(assessed: DataFrame) -> DataFrame:
    """Comments that belong to Other, with status and reason.

    ``assessed`` has one row per comment: non_teaching, status, n_topics, n_passed, general_score, reasoning. The four
    reasons exclude each other, so this is one projection over one scan.
    """
    skipped = F.col("non_teaching")
    error = ~skipped & (F.col("status") == "model_error")
    generic = ~skipped & ~error & (F.col("n_topics") == 0)
    rejected = ~skipped & ~error & (F.col("n_topics") > 0) & (F.col("n_passed") == 0)
    return assessed.filter(skipped | error | generic | rejected).select(
        *[c for c in assessed.columns if c not in ("non_teaching", "status", "n_topics", "n_passed", "general_score", "reasoning")],
        F.when(skipped, "skipped_question").otherwise(F.col("status")).alias("classification_status"),
        F.when(error, "classification_error").otherwise("not_applicable").alias("scoring_status"),
        F.when(skipped, dims.SENTENCES["skipped"])
        .when(error, F.col("reasoning"))
        .when(generic, dims.SENTENCES["generic"])
        .otherwise(dims.SENTENCES["rejected"])
        .alias("reasoning"),
        F.when(generic, F.col("general_score")).alias("general_score"),
    )


def general_sentiment(other: DataFrame, keys: Sequence[str]) -> DataFrame:
    g = F.col("general_score")
    return other.filter(g.isNotNull()).groupBy(*keys).agg(
        round2(F.avg(g)).alias("average_score"),
        F.count("*").alias("scored_comments"),
        F.count_if(g >= 4).alias("positive"),
        F.count_if(g == 3).alias("neutral"),
        F.count_if(g <= 2).alias("negative"),
    )


def report_metadata(prepared: DataFrame, assessed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``prepared`` has input_comments, processed_comments, duplicates_removed per report (from preparation)."""
    counted = assessed.groupBy(*keys).agg(
        F.count_if("non_teaching").alias("non_teaching_skipped"),
        F.count_if(~F.col("non_teaching") & (F.col("n_scored") > 0)).alias("scored_comments"),
        F.count_if(F.col("non_teaching") | (F.col("status") == "model_error") | (F.col("n_passed") == 0)).alias("generic_comments"),
        F.count_if(~F.col("non_teaching") & (F.col("status") == "model_error")).alias("classification_errors"),
        F.sum(F.when(~F.col("non_teaching"), F.col("n_low")).otherwise(0)).alias("low_confidence"),
        F.count_if(
            ~F.col("non_teaching") & (F.col("status") != "model_error") & (F.col("n_topics") > 0) & (F.col("n_passed") == 0)
        ).alias("all_topics_rejected"),
    )
    return prepared.join(counted, list(keys), "left").na.fill(0)


def price_lookup(requests: DataFrame, prices: DataFrame) -> DataFrame:
    """Price row by (provider, model), else the provider's default, else the first listed default provider's."""
    exact = prices.select("provider", "model_id", F.struct("provider", "model_id", "p_in", "p_cached", "p_out").alias("hit"))
    usual = (
        prices.groupBy("provider")
        .agg(
            F.min_by(
                F.struct("provider", "model_id", "p_in", "p_cached", "p_out"),
                F.struct((~F.col("is_default")).cast("int"), F.col("pos")),
            ).alias("dflt")
        )
        .withColumnRenamed("provider", "dp")
    )
    fallback = usual.filter(F.col("dp") == "openai").select("dflt").scalar()
    r = requests.withColumn("_p", F.coalesce("provider", F.lit("openai")))
    out = (
        r.join(F.broadcast(exact.withColumnRenamed("provider", "ep").withColumnRenamed("model_id", "em")),
               (F.col("_p") == F.col("ep")) & (F.col("model_id") == F.col("em")), "left")
        .join(F.broadcast(usual), F.col("_p") == F.col("dp"), "left")
        .withColumn("_hit", F.coalesce(F.col("hit"), F.col("dflt"), fallback))
    )
    return out.select(
        *requests.columns,
        F.col("_hit.provider").alias("used_provider"),
        F.col("_hit.model_id").alias("used_model"),
        F.col("_hit.p_in").alias("p_in"),
        F.col("_hit.p_cached").alias("p_cached"),
        F.col("_hit.p_out").alias("p_out"),
    )


def token_cost(calls: DataFrame, run: Sequence[str]) -> DataFrame:
    """Calls, cache hits, tokens and cost per run.

    ``calls`` has cache_hit, is_local, tokens and the price columns (one price per run). Cost uses the run's sums:
    max(0, in - cached) * p_in + cached * p_cached + out * p_out per million, 0 for local runs, 6 places.
    """
    live = ~F.col("cache_hit")

    def s(c: str) -> Column:
        return F.coalesce(F.sum(F.when(live, F.col(c))), F.lit(0)).cast("long")

    agg = calls.groupBy(*run).agg(
        F.count_if(live).alias("calls"),
        F.count_if("cache_hit").alias("cache_hits"),
        s("input_tokens").alias("input_tokens"),
        s("cached_input_tokens").alias("cached_input_tokens"),
        s("output_tokens").alias("output_tokens"),
        F.bool_or(live & ~F.col("is_local")).alias("billable"),
        F.max("p_in").alias("p_in"),
        F.max("p_cached").alias("p_cached"),
        F.max("p_out").alias("p_out"),
    )
    cost = (
        F.greatest(F.lit(0), F.col("input_tokens") - F.col("cached_input_tokens")) * F.col("p_in")
        + F.col("cached_input_tokens") * F.col("p_cached")
        + F.col("output_tokens") * F.col("p_out")
    ) / 1_000_000
    return agg.select(
        *run, "calls", "cache_hits", "input_tokens", "cached_input_tokens", "output_tokens",
        F.when(F.col("billable"), F.round(cost, 6)).otherwise(0.0).alias("cost_usd"),
    )


def nested_report(rows: DataFrame, topics: DataFrame, keys: Sequence[str], model: str | None = None, chunk_rows: int = COMMENT_CHUNK) -> DataFrame:
    """(keys, chunk, report_json): a report as JSON documents of one form at any size.

    Chunk 0 has the figures of the report, once. The comments follow in input order, ``chunk_rows`` to a document, each with
    its topic. So no document outgrows a task, and readers of figures never meet them twice.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    course = F.concat_ws("_", *[F.col(k).cast("string") for k in keys]).alias("course_id")
    written = {"ignoreNullFields": "false"}

    figures = topic_report_of(rows, topics, keys).join(pace_directions(rows, keys).drop("total"), list(keys), "left")
    directions = F.when(F.col("topic_no") == dims.PACE_NO, F.struct(*[F.coalesce(d, F.lit(0)).alias(d) for d in dims.PACE_DIRECTIONS]))
    category = F.struct(
        "topic_no",
        F.struct("topic", "average_score", "comment_count", "scored_comment_count", "reliability", directions.alias("direction_counts")).alias("c"),
    )
    cats = figures.groupBy(*keys).agg(  # 13 topics
        F.transform(F.sort_array(F.collect_list(category)), lambda x: x["c"]).alias("categories"), F.sum("comment_count").alias("_n")
    )
    head = cats.join(overall_score(rows.filter(F.col("topic_no") != dims.OTHER_NO), keys), list(keys), "left")
    meta = F.struct(F.lit(dims.PROMPT_VERSION).alias("prompt_version"), F.col("_n").alias("processed_comments"), F.lit(model).cast("string").alias("model_id"), F.lit(0).alias("chunk"))
    head = head.select(*keys, F.lit(0).cast("long").alias("chunk"), F.to_json(F.struct(course, "overall_score", "categories", meta.alias("metadata")), written).alias("report_json"))

    named = rows.join(bound(topics.select("topic_no", "topic")), "topic_no")
    numbered = row_numbers(named, keys, ["ord", "topic_no", "score", "confidence"], block_of(F.col("ord")), "_n")
    comment = F.struct("topic", "feedback", *[text(c).alias(c) for c in ("scoring_status", "score", "confidence", "direction")])
    chunks = (
        numbered.withColumn("chunk", (F.floor((F.col("_n") - 1) / chunk_rows) + 1).cast("long"))
        .groupBy(*keys, "chunk")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", comment.alias("c")))), lambda x: x["c"]).alias("comments"))
    )
    meta = F.struct(F.lit(dims.PROMPT_VERSION).alias("prompt_version"), F.col("chunk"))
    chunks = chunks.select(*keys, "chunk", F.to_json(F.struct(course, "comments", meta.alias("metadata")), written).alias("report_json"))
    return head.unionByName(chunks)


def topic_report_of(rows: DataFrame, topics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The topic figures of rows that have already passed the gate."""
    dense = dense_topics(rows, keys)
    return dense.join(bound(topics.select("topic_no", "topic")), "topic_no").select(
        *keys, "topic_no", "topic", "average_score", "comment_count", "scored_comment_count", "reliability"
    )
