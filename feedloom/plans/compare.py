"""Compare the reports of a group (a course, an owner's selection) across terms.

``group`` names the columns of one comparison. Report rows carry a position ``pos`` from ``order_by_term``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom import dims
from feedloom.functions.numbers import half_even
from feedloom.functions.text import norm_question, term_sort_key
from feedloom.operators.ordered import row_numbers


def report_summary(topic_rows: DataFrame) -> DataFrame:
    """Per-topic figures of rubric topics, with the low-sample flag."""
    return topic_rows.filter(F.col("topic_no") != dims.OTHER_NO).withColumn(
        "low_sample", F.coalesce("scored_comment_count", F.lit(0)) < dims.MIN_RELIABLE
    )


def order_by_term(reports: DataFrame, group: Sequence[str], created: str = "created_at", tie: str = "id") -> DataFrame:
    """Position of each report in calendar order within its group."""
    r = reports.withColumn("_k", term_sort_key(F.col("term")))
    order = [F.col("_k"), F.col(created).asc_nulls_first(), F.col(tie)]
    block = F.struct("_k", F.date_trunc("day", created))
    return row_numbers(r, group, order, block, "pos").drop("_k")


def topic_matrix(summary: DataFrame, group: Sequence[str], positions: Sequence[int]) -> DataFrame:
    """One row per topic, one column per report position; topics numbered in first-seen order."""
    cells = summary.groupBy(*group, "topic_no").agg(
        F.min("pos").alias("first_pos"),
        *[F.max(F.when(F.col("pos") == p, F.col("average_score"))).alias(f"r{p}") for p in positions],
    )
    return cells


def topic_change(summary: DataFrame, group: Sequence[str]) -> DataFrame:
    """Last minus first known average; reliable when both ends have enough scored comments."""
    known = F.col("average_score").isNotNull()
    cell = F.when(known, F.struct("average_score", "low_sample"))
    agg = summary.groupBy(*group, "topic_no").agg(
        F.count_if(known).alias("n"),
        F.min("pos").alias("first_pos"),
        F.min_by(cell, F.when(known, F.col("pos"))).alias("a"),
        F.max_by(cell, F.when(known, F.col("pos"))).alias("b"),
    )
    two = F.col("n") >= 2
    return agg.select(
        *group,
        "topic_no",
        "first_pos",
        F.when(two, half_even(F.col("b.average_score") - F.col("a.average_score"), 2)).alias("change"),
        F.when(two, ~F.col("a.low_sample") & ~F.col("b.low_sample")).otherwise(False).alias("change_is_reliable"),
    )


def improved_declined(changes: DataFrame, group: Sequence[str], top: int = 3) -> DataFrame:
    """The largest reliable changes in each direction. At most 12 topics exist per group, so the lists are short."""
    notable = changes.filter(F.col("change_is_reliable") & (F.abs("change") >= dims.NOTABLE_CHANGE))
    entry = F.struct("change", "first_pos", "topic_no")
    agg = notable.groupBy(*group).agg(F.sort_array(F.collect_list(entry)).alias("e"))
    up = F.slice(F.filter(F.reverse("e"), lambda x: x["change"] > 0), 1, top)
    down = F.slice(F.filter("e", lambda x: x["change"] < 0), 1, top)

    def listed(entries: Column, direction: str) -> Column:
        return F.transform(
            entries,
            lambda x, i: F.struct(F.lit(direction).alias("direction"), (i + 1).alias("rank"), x["topic_no"].alias("topic_no"), x["change"].alias("change")),
        )

    return agg.select(*group, F.inline(F.concat(listed(up, "improved"), listed(down, "declined"))))


def rating_changes(ratings: DataFrame, group: Sequence[str], positions: Sequence[int]) -> DataFrame:
    """Rating questions found in at least two reports: means in order, last minus first, name from the first."""
    r = ratings.filter(F.col("mean").isNotNull() & (F.col("question") != "")).withColumn("key", norm_question(F.col("question")))
    # a later table of the same report replaces an earlier one with the same key
    one = r.groupBy(*group, "pos", "key").agg(F.max_by(F.struct("question", "mean"), "table_no").alias("c"))
    agg = one.groupBy(*group, "key").agg(
        F.count("*").alias("n"),
        F.min_by("c", "pos").alias("a"),
        F.max_by("c", "pos").alias("b"),
        *[F.max(F.when(F.col("pos") == p, F.col("c.mean"))).alias(f"r{p}") for p in positions],
    )
    return agg.filter(F.col("n") >= 2).select(
        *group,
        F.col("a.question").alias("question"),
        *[f"r{p}" for p in positions],
        half_even(F.col("b.mean") - F.col("a.mean"), 2).alias("change"),
    )


def comparison_warnings(reports: DataFrame, changes: DataFrame, group: Sequence[str]) -> DataFrame:
    """``reports`` has course, prompt_version and has_pace per report."""
    version = F.col("prompt_version")
    a = reports.groupBy(*group).agg(
        F.min(F.lower(F.trim("course"))).alias("c1"),
        F.max(F.lower(F.trim("course"))).alias("c2"),
        F.bool_or(version.isNull() | (version < dims.PACE_SCALE_FIXED_IN)).alias("old"),
        F.bool_or("has_pace").alias("pace"),
        F.min(F.nullif(version, F.lit(""))).alias("v1"),
        F.max(F.nullif(version, F.lit(""))).alias("v2"),
    )
    b = changes.groupBy(*group).agg(
        F.bool_or(F.col("change").isNotNull() & ~F.col("change_is_reliable")).alias("weak")
    )
    found = F.array(
        F.when(F.col("c1") != F.col("c2"), "different courses"),
        F.when(F.col("old") & F.col("pace"), "old pace scale"),
        F.when(F.col("v1") != F.col("v2"), "mixed prompt versions"),
        F.when(F.coalesce("weak", F.lit(False)), "low sample changes"),
    )
    return a.join(b, list(group), "left").select(*group, F.filter(found, lambda x: x.isNotNull()).alias("warnings"))


WARNING_TEXT = {
    "different courses": "The compared reports belong to different courses; part of a difference may come from the course.",
    "old pace scale": "At least one report uses the earlier Pace scale, so Pace scores cannot be compared.",
    "mixed prompt versions": "The reports were scored with different instructions; small differences may come from that.",
    "low sample changes": "Topics with fewer than 5 scored comments are marked; their changes are rough indications.",
}


def overall_change(reports: DataFrame, group: Sequence[str]) -> DataFrame:
    agg = reports.groupBy(*group).agg(
        F.count("*").alias("n"),
        F.min_by(F.struct("overall_score"), "pos").alias("a"),
        F.max_by(F.struct("overall_score"), "pos").alias("b"),
    )
    return agg.select(
        *group,
        F.when(F.col("n") >= 2, half_even(F.col("b.overall_score") - F.col("a.overall_score"), 2)).alias("overall_change"),
    )


def trend_rows(reports: DataFrame, summary: DataFrame, group: Sequence[str], topics: Sequence[int]) -> DataFrame:
    """One row per report: the overall score and the chosen topics as columns."""
    chosen = (
        summary.filter(F.col("topic_no").isin(list(topics)))
        .groupBy(*group, "pos")
        .agg(*[F.max(F.when(F.col("topic_no") == t, F.col("average_score"))).alias(f"topic_{t}") for t in topics])
    )
    return reports.select(*group, "pos", F.col("overall_score").alias("overall")).join(chosen, [*group, "pos"], "left")


def compare_selection(requests: DataFrame, reports: DataFrame, max_reports: int = dims.MAX_COMPARE) -> DataFrame:
    """Check id lists (``request_id, user_id, ids``): whole numbers, unique in order, 2 to 8, all owned by the user."""
    parts = F.filter(F.transform(F.split("ids", ","), lambda p: F.trim(p)), lambda p: p != "")
    numbers = F.transform(parts, lambda p: p.try_cast("bigint"))
    r = requests.withColumn("_bad", F.exists(numbers, lambda n: n.isNull())).withColumn("_ids", F.array_distinct(numbers))
    wanted = r.filter(~F.col("_bad")).select(
        "request_id", "user_id", F.explode("_ids").alias("report_id")
    )
    owned = wanted.join(
        reports.select(F.col("id").alias("report_id"), F.col("owner_id").alias("user_id")), ["report_id", "user_id"], "left_semi"
    )
    count = owned.groupBy("request_id").agg(F.count("*").alias("_owned"))
    n = F.size("_ids")
    status = (
        F.when(F.col("_bad"), "not a list of numbers")
        .when((n < 2) | (n > max_reports), "wrong number of reports")
        .when(F.coalesce("_owned", F.lit(0)) < n, "not found")
        .otherwise("ok")
    )
    out = r.join(count, "request_id", "left").withColumn("status", status)
    return out.select("request_id", "user_id", "status", F.when(F.col("status") == "ok", F.col("_ids")).alias("report_ids"))
