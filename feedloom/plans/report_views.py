"""What a reader does with a report: ignore comments, recalculate, filter, sort, page, check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom import dims
from feedloom.functions.numbers import exact_mean, round2
from feedloom.functions.text import strip_bullets
from feedloom.operators.ordered import block_of, row_numbers
from feedloom.operators.stages import written
from feedloom.plans.report import reliability_label


def apply_ignored(rows: DataFrame, ignore: DataFrame, topic_no: int, keys: Sequence[str]) -> DataFrame:
    """In one topic, ignore exactly the listed texts of each report; other topics keep their flags."""
    listed = ignore.select(*keys, "feedback").distinct().withColumn("_hit", F.lit(True))
    here = F.col("topic_no") == topic_no
    return (
        rows.join(listed, [*keys, "feedback"], "left")
        .withColumn("ignored", F.when(here, F.col("_hit").isNotNull()).otherwise(F.col("ignored")))
        .drop("_hit")
    )


def recalculate_topics(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rubric topics only: figures from rows that are not ignored; comment_count keeps all rows."""
    on = ~F.col("ignored")
    score = F.when(on, F.col("score"))
    agg = (
        rows.filter(F.col("topic_no") != dims.OTHER_NO)
        .groupBy(*keys, "topic_no")
        .agg(
            F.count("*").alias("comment_count"),
            F.avg(score).alias("mean"),
            F.count(score).alias("scored_comment_count"),
            F.count_if(on & (F.col("scoring_status") == "model_error")).alias("e"),
            F.count_if(on & F.col("score").isNotNull() & (F.col("confidence") < dims.LOW_CONFIDENCE)).alias("w"),
        )
    )
    return agg.select(
        *keys,
        "topic_no",
        round2(F.col("mean")).alias("average_score"),
        "comment_count",
        "scored_comment_count",
        reliability_label(F.col("scored_comment_count"), F.col("e"), F.col("w")).alias("reliability"),
    )


def _overall(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Overall score of all rows and of the rows that are not ignored, in one pass."""
    per_text = (
        rows.filter((F.col("topic_no") != dims.OTHER_NO) & F.col("score").isNotNull())
        .groupBy(*keys, "feedback")
        .agg(F.avg("score").alias("a"), F.avg(F.when(~F.col("ignored"), F.col("score"))).alias("b"))
    )
    return per_text.groupBy(*keys).agg(
        round2(exact_mean(F.col("a"))).alias("old_overall"), round2(exact_mean(F.col("b"))).alias("new_overall")
    )


def recalculate(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    overall = _overall(rows, keys).select(*keys, F.col("new_overall").alias("overall_score"))
    return recalculate_topics(rows, keys).join(overall, list(keys), "left")


def recalc_delta(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    topics = (
        rows.filter(F.col("topic_no") != dims.OTHER_NO)
        .groupBy(*keys, "topic_no")
        .agg(
            round2(F.avg("score")).alias("old_average"),
            round2(F.avg(F.when(~F.col("ignored"), F.col("score")))).alias("new_average"),
        )
    )
    return topics.join(_overall(rows, keys), list(keys), "left")


def comment_view(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per text. Rows are first reduced to (text, topic), so each list has at most 13 entries. A text that a topic lists
    more than once has the last score there; ``question`` and ``general_score``, where rows have them, are those of its first row."""
    own = [c for c in ("question", "general_score") if c in rows.columns]
    last = F.max_by("score", F.when(F.col("score").isNotNull(), F.struct("ord", "score")))
    per_topic = rows.groupBy(*keys, "feedback", "topic_no").agg(
        last.alias("s"), F.bool_or("ignored").alias("i"), F.min("ord").alias("o"), *[F.min_by(c, "ord").alias(c) for c in own]
    )
    entry = F.sort_array(F.collect_list(F.struct("topic_no", "s", "i")))
    return (
        per_topic.groupBy(*keys, "feedback")
        .agg(F.min("o").alias("idx"), entry.alias("e"), *[F.min_by(c, "topic_no").alias(c) for c in own])
        .select(
            *keys,
            "feedback",
            "idx",
            *own,
            F.col("e.topic_no").alias("topics"),
            F.map_from_entries(
                F.transform(
                    F.filter("e", lambda x: x["s"].isNotNull()), lambda x: F.struct(x["topic_no"], x["s"])
                )
            ).alias("scores"),
            F.transform(F.filter("e", lambda x: x["i"]), lambda x: x["topic_no"]).alias("ignored_in"),
        )
    )


def comment_mean(view: DataFrame) -> DataFrame:
    """Mean of a comment's topic scores, halves up; Other leaves its topic list."""
    values = F.map_values("scores")
    total = F.aggregate(values, F.lit(0), lambda a, x: a + x)
    return view.withColumn(
        "score", F.when(F.size(values) > 0, F.floor(total / F.size(values) + 0.5).cast("int"))
    ).withColumn("topics", F.array_remove("topics", F.lit(dims.OTHER_NO)))


def score_distribution(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    active = rows.withColumn("score", F.when(~F.col("ignored"), F.col("score")))
    return active.groupBy(*keys, "topic_no").agg(*[F.count_if(F.col("score") == k).alias(f"score_{k}") for k in range(1, 6)])


def sentiment_split(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    on = ~F.col("ignored")
    return rows.groupBy(*keys, "topic_no").agg(
        F.count_if(on & (F.col("score") >= 4)).alias("positive"),
        F.count_if(on & (F.col("score") == 3)).alias("neutral"),
        F.count_if(on & (F.col("score") <= 2)).alias("negative"),
    )


def label_split(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The older view: counts by the stored sentiment label."""
    return rows.groupBy(*keys, "topic_no").agg(
        *[F.count_if(F.col("sentiment") == s).alias(s) for s in dims.SENTIMENTS]
    )


def _chosen_score(topic_no: int | None) -> Column:
    own = F.try_element_at("scores", F.lit(topic_no)) if topic_no is not None else F.lit(None).cast("int")
    return F.coalesce(own, F.col("score"))


def filter_comments(
    view: DataFrame, score: str = "all", topic_no: int | None = None, search: str = ""
) -> DataFrame:
    """Score class (all, low, mid, high, none), topic membership and a case-blind search."""
    v = view.withColumn("score", _chosen_score(topic_no))
    s = F.col("score")
    keep = {
        "all": F.lit(True),
        "low": s <= 2,
        "mid": s == 3,
        "high": s >= 4,
        "none": s.isNull(),
    }[score]
    if topic_no is not None:
        keep = keep & F.array_contains("topics", topic_no)
    if search.strip():
        keep = keep & F.lower("feedback").contains(search.strip().lower())
    return v.filter(keep)


def filter_comments_classic(
    view: DataFrame, score: str = "all", topic_no: int | None = None, search: str = ""
) -> DataFrame:
    """The older classes: high is 3 and more, low is below 3 but scored, '0' unscored, a digit is that star."""
    v = view.withColumn("score", F.coalesce(_chosen_score(topic_no), F.lit(0)))
    s = F.col("score")
    keep = {"all": F.lit(True), "high": s >= 3, "low": (s < 3) & (s > 0), "0": s == 0}.get(score)
    if keep is None:
        keep = s == int(score)
    if topic_no is not None:
        keep = keep & F.array_contains("topics", topic_no)
    if search.strip():
        keep = keep & F.lower("feedback").contains(search.strip().lower())
    return v.filter(keep)


def sort_comments(view: DataFrame, keys: Sequence[str], how: str = "original", index: str = "idx") -> DataFrame:
    """Add ``position`` and ``total`` per report: original order, lowest or highest score first, unscored last."""
    rank = {
        "original": F.lit(0),
        "low": F.coalesce("score", F.lit(6)),
        "high": -F.coalesce("score", F.lit(0)),
    }[how]
    v = written(view.withColumn("_rank", rank.cast("int")))  # positions read the rows twice
    block = F.struct(F.col("_rank"), block_of(F.col(index)))
    return row_numbers(v, keys, ["_rank", index], block, "position", "total").drop("_rank")


def page_comments(sorted_view: DataFrame, page: int, size: int) -> DataFrame:
    """Page ``page`` of every report; a page past the end is the last page."""
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / size))
    first = (F.least(F.lit(max(page, 1)), pages) - 1) * size
    return sorted_view.filter((F.col("position") > first) & (F.col("position") <= first + size))


def shared_question(comments: DataFrame, keys: Sequence[str], question: str = "question") -> DataFrame:
    q = F.nullif(F.col(question), F.lit(""))
    return comments.groupBy(*keys).agg(F.when(F.min(q) == F.max(q), F.max(q)).alias("shared_question"))


def relabel_legacy(rows: DataFrame, topic: str = "topic", text: str = "feedback") -> DataFrame:
    return rows.withColumn(
        topic, F.when(F.col(topic) == dims.LEGACY_OTHER, dims.OTHER).otherwise(F.col(topic))
    ).withColumn(text, F.replace(strip_bullets(F.col(text)), F.lit("�"), F.lit("'")))


def report_quality_checks(
    rows: DataFrame,
    keys: Sequence[str],
    max_topics: int = dims.MAX_CATEGORIES,
    max_comments: int = dims.MAX_REPORT_COMMENTS,
    max_bytes: int = dims.MAX_REPORT_BYTES,
) -> DataFrame:
    """Reasons to refuse each stored report, from its flat rows: size and not-a-number checks."""
    per_topic = rows.groupBy(*keys, "topic_no").agg(
        F.count("*").alias("n"),
        F.sum(F.octet_length("feedback")).alias("b"),
        F.bool_or(F.isnan("confidence") | F.col("confidence").isin(float("inf"), float("-inf"))).alias("x"),
    )
    agg = per_topic.groupBy(*keys).agg(
        F.count("*").alias("topics"), F.sum("n").alias("comments"), F.sum("b").alias("bytes"), F.bool_or("x").alias("bad")
    )
    reasons = F.array(
        F.when(F.col("topics") > max_topics, "too many topics"),
        F.when(F.col("comments") > max_comments, "too many comments"),
        F.when(F.coalesce("bad", F.lit(False)), "invalid number"),
        F.when(F.col("bytes") > max_bytes, "too large"),
    )
    return agg.select(*keys, "topics", "comments", F.filter(reasons, lambda r: r.isNotNull()).alias("reasons"))


def check_report_json(reports: DataFrame, column: str = "report_json") -> DataFrame:
    """The same checks on stored documents; also refuses documents that are not reports at all."""
    v = F.try_parse_json(column)
    cats = F.try_variant_get(v, "$.categories", "array<variant>")
    kind = F.schema_of_variant(v)
    per_cat = F.transform(
        cats,
        lambda c: F.struct(
            F.schema_of_variant(c).alias("t"),
            F.coalesce(F.schema_of_variant(F.try_variant_get(c, "$.topic", "variant")), F.lit("VOID")).alias("topic"),
            F.coalesce(F.schema_of_variant(F.try_variant_get(c, "$.comments", "variant")), F.lit("ARRAY<")).alias("listed"),
            F.coalesce(F.size(F.try_variant_get(c, "$.comments", "array<variant>")), F.lit(0)).alias("n"),
        ),
    )
    odd = F.exists(
        per_cat,
        lambda c: ~c["t"].startswith("OBJECT") | ~c["topic"].isin("STRING", "VOID") | ~c["listed"].startswith("ARRAY"),
    )
    comments = F.aggregate(per_cat, F.lit(0), lambda a, c: a + F.greatest(c["n"], F.lit(0)))
    tables = F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.quantitative", "variant")), F.lit("VOID"))
    n_tables = F.size(F.try_variant_get(v, "$.quantitative", "array<variant>"))
    reasons = F.array(
        F.when(v.isNull() | ~kind.startswith("OBJECT") | cats.isNull() | odd, "not a report"),
        F.when(F.size(cats) > dims.MAX_CATEGORIES, "too many topics"),
        F.when(comments > dims.MAX_REPORT_COMMENTS, "too many comments"),
        F.when(((tables != "VOID") & ~tables.startswith("ARRAY")) | (n_tables > dims.MAX_TABLES), "too many tables"),
        F.when(F.octet_length(column) > dims.MAX_REPORT_BYTES, "too large"),
    )
    return reports.withColumn("reasons", F.filter(reasons, lambda r: r.isNotNull()))


def list_reports(reports: DataFrame, uploads: DataFrame, owner_id: int | None = None) -> DataFrame:
    """Reports with their upload's name if any, newest first per owner."""
    mine = reports if owner_id is None else reports.filter(F.col("owner_id") == owner_id)
    names = uploads.select(F.col("id").alias("upload_id"), "original_filename")
    return mine.join(names, "upload_id", "left").orderBy("owner_id", F.desc("created_at"), "id")


def group_history(history: DataFrame, group: str, order: Sequence[str], block: Column) -> DataFrame:
    """Records with their 1-based position in their group: one row per record at any size of a group."""
    return row_numbers(history, [group], list(order), block, "position")


def scored_topic_count(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    per_topic = (
        rows.filter(F.col("topic_no") != dims.OTHER_NO).groupBy(*keys, "topic_no").agg(F.count("score").alias("n"))
    )
    return per_topic.groupBy(*keys).agg(F.count_if(F.col("n") > 0).alias("scored_topics"))
