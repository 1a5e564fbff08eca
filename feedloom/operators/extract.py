"""Profile wide survey tables and turn them into answers and rating tables.

A wide table has one row per student (``row_id`` columns) and one string column per question.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom import dims
from feedloom.functions import text as tx
from feedloom.functions.numbers import half_even
from feedloom.operators.ordered import block_of, carry_forward
from feedloom.operators.stages import checkpointed, written


def long_cells(wide: DataFrame, ids: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(ids, column, value) for the given question columns, read as strings."""
    as_text = wide.select(*ids, *[F.col(f"`{c}`").cast("string").alias(c) for c in columns])
    return as_text.unpivot(list(ids), list(columns), "column", "value")


def is_meta_column(name: Column) -> Column:
    return name.rlike(f"(?i){dims.META_COLUMN}")


def drop_meta_columns(cells: DataFrame) -> DataFrame:
    return cells.filter(~is_meta_column(F.col("column")))


def profile_columns(cells: DataFrame, file_id: Sequence[str]) -> DataFrame:
    """Shape of each column and whether it holds free text.

    Values are reduced to (column, value) counts first; a value travels as its length and digest, so long answers are
    not shuffled and a value repeated by a third of all rows arrives as one row per task.
    """
    v = tx.strip_space(F.col("value"))
    filled = tx.with_once(cells, "v", v).filter(F.col("v") != "")
    counts = filled.groupBy(*file_id, "column", F.length("v").alias("len"), F.md5("v").alias("digest")).agg(
        F.count("*").alias("n"), F.bool_or(F.col("v").rlike(r"^[\d.\-/: ]+$")).alias("number_like")
    )
    agg = counts.groupBy(*file_id, "column").agg(
        F.sum("n").alias("filled"),
        (F.sum(F.when(F.col("number_like"), F.col("n")).otherwise(0)) / F.sum("n")).alias("number_like"),
        F.percentile("len", F.lit(0.5), F.col("n")).alias("median_length"),
        (F.count("*") / F.sum("n")).alias("distinct_ratio"),
    )
    free = (
        (F.col("filled") >= 3) & (F.col("number_like") <= 0.5) & (F.col("median_length") >= 12) & (F.col("distinct_ratio") >= 0.3)
    )
    return agg.withColumn("free_text", free)


def detect_layout(shape: DataFrame, profile: DataFrame, file_id: Sequence[str]) -> DataFrame:
    """``shape`` has one row per (file, column) with the file's row count; a file is tidy or report-style."""
    cols = shape.join(profile.select(*file_id, "column", "free_text"), [*file_id, "column"], "left")
    agg = cols.groupBy(*file_id).agg(
        F.max("rows").alias("rows"),
        F.count("*").alias("columns"),
        F.count_if(F.col("column").startswith("Unnamed")).alias("unnamed"),
        F.bool_or(~is_meta_column(F.col("column")) & F.coalesce("free_text", F.lit(False))).alias("free"),
    )
    tidy = (F.col("rows") >= 3) & (F.col("columns") >= 3) & (F.col("unnamed") <= F.col("columns") / 2) & F.col("free")
    return agg.select(*file_id, "rows", "columns", F.when(tidy, "tabular-export").otherwise("report-table").alias("parser"))


def keep_text(text: Column) -> Column:
    """Rule part of keeping an answer: not noise, not an empty answer, not a prompt, two words or more."""
    return tx.let(
        text, lambda t: ~tx.is_noise(t) & ~tx.is_no_answer(t) & ~tx.is_question(t) & (tx.word_count(t) >= 2)
    )


def tidy_responses(cells: DataFrame, profile: DataFrame, dictionary: DataFrame, ids: Sequence[str], file_id: Sequence[str]) -> DataFrame:
    """Cells of free-text columns with ``status`` response, garbage or dropped; the question is the cleaned header."""
    free = profile.filter("free_text").select(*file_id, "column")
    texts = drop_meta_columns(cells).join(free, [*file_id, "column"], "left_semi")
    texts = (
        tx.with_once(texts, "text", tx.clean_text(F.col("value")))
        .filter(F.col("text") != "")
        .withColumn("cell", F.concat_ws("\x1f", *[F.col(c).cast("string") for c in ids], "column"))
    )
    texts = written(texts)  # the words of the ratio and the rows are read from here
    rated = tx.english_ratio(texts, dictionary, "cell")
    garbage = tx.is_garbage(F.col("english_ratio")) & ~tx.is_no_answer(F.col("text"))
    status = F.when(garbage, "garbage").when(keep_text(F.col("text")), "response").otherwise("dropped")
    return rated.select(*ids, *[c for c in file_id if c not in ids], "column",
                        tx.question_header(F.col("column")).alias("question"), "text", status.alias("status"))


def rating_distribution(cells: DataFrame, profile: DataFrame, file_id: Sequence[str], max_values: int = 12) -> DataFrame:
    """Columns that are not free text and have few distinct values: n, counts per label, mean if all are numbers."""
    free = profile.filter("free_text").select(*file_id, "column")
    v = drop_meta_columns(cells).join(free, [*file_id, "column"], "left_anti")
    v = tx.with_once(v, "v", tx.clean_text(F.col("value")))
    counts = v.filter(F.col("v") != "").groupBy(*file_id, "column", "v").agg(F.count("*").alias("n"))
    # drop columns with many values before any list is built
    few = counts.groupBy(*file_id, "column").agg(F.count("*").alias("d")).filter(F.col("d") <= max_values).drop("d")
    num = F.col("v").try_cast("double")
    kept = counts.join(few, [*file_id, "column"], "left_semi")
    return kept.groupBy(*file_id, "column").agg(
        F.sum("n").alias("n"),
        F.when(F.bool_and(num.isNotNull()), half_even(F.sum(num * F.col("n")) / F.sum("n"), 2)).alias("mean"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("v", "n")))).alias("distribution"),
    )


def question_reference(questions: DataFrame, file_id: Sequence[str], question: str = "question", order: str = "ordinal") -> DataFrame:
    """"... answer to Question 19" gets question 19's text appended, from the same file."""
    q = F.col(question)
    numbered = (
        questions.withColumn("_n", F.regexp_extract(q, r"^(\d+)\.\s", 1))
        .filter(F.col("_n") != "")
        .groupBy(*file_id, "_n")
        .agg(F.max_by(question, order).alias("_target"))
    )
    ref = F.regexp_extract(q, r"(?i)answer to question (\d+)", 1)
    joined = questions.withColumn("_n", F.nullif(ref, F.lit(""))).join(numbered, [*file_id, "_n"], "left")
    text = F.when(F.col("_target").isNotNull(), F.concat(q, F.lit(" (Question "), F.col("_target"), F.lit(")"))).otherwise(q)
    return joined.withColumn(question, text).select(*questions.columns)


def grid_rows(cells: DataFrame, sheet: Sequence[str]) -> DataFrame:
    """One row per sheet row with its filled cells in column order (a row is as wide as the sheet)."""
    c = tx.with_once(cells, "text", tx.clean_text(F.col("text"))).filter(F.col("text") != "")
    rows = c.groupBy(*sheet, "row_no").agg(F.sort_array(F.collect_list(F.struct("col", "text"))).alias("cells"))
    is_percent = lambda x: x["text"].rlike(dims.PERCENT_CELL)
    scale = F.filter("cells", lambda x: tx.scale_value(x["text"]).isNotNull() | tx.squish(x["text"]).isin(dims.NOISE_WORDS))
    rows = rows.withColumn("scale", scale).withColumn("percent", F.filter("cells", is_percent))
    header = (F.size("scale") >= 2) & (F.size("scale") >= F.size("cells") - 1)
    kind = F.when(header, "header").when(F.size("percent") >= 2, "percent").otherwise("text")
    own = F.filter("cells", lambda x: ~is_percent(x) & ~x["text"].rlike(r"^[\d.]+$"))
    return rows.withColumn("kind", kind).withColumn("own_label", F.try_element_at(own, F.lit(1))["text"])


def scale_header_rows(rows: DataFrame, sheet: Sequence[str], block_rows: int = 100_000) -> DataFrame:
    """Add the scale header in force and the last long row label, both carried down the sheet."""
    rows = checkpointed(rows)  # carrying reads its input twice
    long_label = F.when((F.col("kind") == "percent") & (F.length("own_label") >= 40), F.col("own_label"))
    return carry_forward(
        rows,
        sheet,
        ["row_no"],
        {"header": F.when(F.col("kind") == "header", F.col("scale")), "long_label": long_label},
        block_of(F.col("row_no"), block_rows),
    )


def rating_row_label(own: Column, long_label: Column) -> Column:
    """A short row label is prefixed with the last long label above; a missing one is replaced by it."""
    short = (F.length(own) < 40) & long_label.isNotNull() & (own != long_label)
    return F.when(own.isNull(), long_label).when(short, F.concat_ws(" — ", long_label, own)).otherwise(own)


def percent_rows(rows: DataFrame, sheet: Sequence[str]) -> DataFrame:
    """Rows of ``50% (5)`` cells as rating tables. Works inside each row; nothing is exploded or shuffled."""
    header = F.coalesce("header", F.expr("cast(array() as array<struct<col:int,text:string>>)"))

    def named(cell: Column) -> Column:
        # nearest header column; on a tie the left one
        best = F.array_min(
            F.transform(
                F.col("_h"),
                lambda h: F.struct(F.abs(h["col"] - cell["col"]).alias("d"), h["col"].alias("c"), h["text"].alias("t"), h["v"].alias("v")),
            )
        )
        count = F.regexp_extract(cell["text"], dims.PERCENT_CELL, 2).cast("bigint")
        plain = F.concat(F.lit("column "), cell["col"].cast("string"))
        return tx.let(
            best,
            lambda b: F.struct(
                F.when(b["d"] <= 1, b["t"]).otherwise(plain).alias("name"), count.alias("n"), F.when(b["d"] <= 1, b["v"]).alias("v")
            ),
        )

    # the value of each label is looked up once per header, not once per cell
    valued = F.transform(header, lambda h: F.struct(h["col"].alias("col"), h["text"].alias("text"), tx.scale_value(h["text"]).alias("v")))
    p = rows.filter(F.col("kind") == "percent").withColumn("_h", valued)
    p = tx.with_once(p, "_c", F.transform("percent", named))

    def total(pairs: Column) -> Column:
        return F.aggregate(pairs, F.lit(0).cast("bigint"), lambda a, x: a + x)

    dist = F.transform(
        F.array_distinct(F.col("_c.name")),
        lambda n: F.struct(n, total(F.transform(F.filter("_c", lambda x: x["name"] == n), lambda x: x["n"])).alias("n")),
    )
    scored = F.filter("_c", lambda x: x["v"].isNotNull())
    weight = total(F.transform(scored, lambda x: x["n"] * x["v"]))
    count = total(F.transform(scored, lambda x: x["n"]))
    return p.select(
        *sheet,
        "row_no",
        rating_row_label(F.col("own_label"), F.col("long_label")).alias("question"),
        total(F.col("_c.n")).alias("n"),
        F.when(count > 0, half_even(weight / F.nullif(count, F.lit(0)), 2)).alias("mean"),
        F.map_from_entries(dist).alias("distribution"),
    )
