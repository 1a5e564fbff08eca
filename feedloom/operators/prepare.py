"""Bring answers into one form, drop repeats and apply limits before any scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom import dims
from feedloom.functions import text as tx
from feedloom.operators.ordered import first_rows


def unify_inputs(rows: DataFrame, keys: Sequence[str], order: str = "ord") -> DataFrame:
    """Text from ``text`` or ``feedback``, question or null, flag default false; empty texts are dropped."""

    def col(name: str, kind: str):
        return F.col(name) if name in rows.columns else F.lit(None).cast(kind)

    raw = F.coalesce(F.nullif(col("text", "string"), F.lit("")), col("feedback", "string"), F.lit(""))
    rest = rows.select(
        *keys,
        order,
        raw.alias("text"),
        F.nullif(tx.norm_whitespace(F.coalesce(col("question", "string"), F.lit(""))), F.lit("")).alias("question"),
        F.coalesce(col("non_teaching", "boolean"), F.lit(False)).alias("non_teaching"),
    )
    return tx.with_once(rest, "text", tx.prepare_text(F.col("text"))).filter(F.col("text") != "")


def plain_lines(files: DataFrame, keys: Sequence[str], text: str = "text", longer_than: int = 10) -> DataFrame:
    """The legacy form: one answer per line longer than ten characters."""
    lines = files.select(*keys, F.posexplode(F.split(text, "\n")).alias("ord", "text"))
    return lines.withColumn("text", tx.strip_space(F.col("text"))).filter(F.length("text") > longer_than).select(
        *keys, F.col("ord").cast("long").alias("ord"), "text", F.lit(None).cast("string").alias("question"),
        F.lit(False).alias("non_teaching"),
    )


def dedupe_comments(items: DataFrame, keys: Sequence[str], order: str = "ord") -> DataFrame:
    """First answer of each equal text per course.

    A map-side combined aggregate, so copies are not gathered. Texts are grouped by digest and length: long answers
    are neither sorted nor compared.
    """
    keyed = items.withColumn("_d", F.md5("text")).withColumn("_l", F.length("text"))
    return first_rows(keyed, [*keys, "_d", "_l"], [order]).drop("_d", "_l")


def duplicate_counts(items: DataFrame, keys: Sequence[str], input_rows: DataFrame | None = None) -> DataFrame:
    """Per course: answers kept and repeats removed (and rows read, when the raw rows are given)."""
    per_text = items.groupBy(*keys, F.md5("text").alias("d"), F.length("text").alias("l")).agg(F.count("*").alias("n"))
    out = per_text.groupBy(*keys).agg(
        F.count("*").alias("processed_comments"), (F.sum("n") - F.count("*")).alias("duplicates_removed")
    )
    if input_rows is None:
        return out
    return input_rows.groupBy(*keys).agg(F.count("*").alias("input_comments")).join(out, list(keys), "left").na.fill(0)


def split_skipped(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to assess, skipped): answers about the student never reach the scorer."""
    return items.filter(~F.col("non_teaching")), items.filter("non_teaching")


def size_limit(items: DataFrame, keys: Sequence[str], limit: int = dims.MAX_COMMENTS) -> DataFrame:
    """Courses refused because they have more comments than one analysis takes."""
    return items.groupBy(*keys).agg(F.count("*").alias("comments")).filter(F.col("comments") > limit)


def eval_comment_set(first: DataFrame, second: DataFrame, limit: int | None = None) -> DataFrame:
    """Comments of both label sets (``pos, feedback``), unique by canonical key in first-seen order, first ``limit``."""
    both = first.select(F.lit(0).alias("src"), "pos", "feedback").unionByName(second.select(F.lit(1).alias("src"), "pos", "feedback"))
    keyed = both.withColumn("key", tx.canonical_key(F.col("feedback")))
    unique = first_rows(keyed, ["key"], ["src", "pos"])
    return unique if limit is None else unique.orderBy("src", "pos").limit(limit)


def restrict_labels(labels: DataFrame, comments: DataFrame) -> DataFrame:
    keyed = labels.withColumn("key", tx.canonical_key(F.col("feedback")))
    return keyed.join(comments.select("key"), "key", "left_semi")
