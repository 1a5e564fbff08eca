"""Lines of a report to whole answers with their questions.

Lines are ``(doc_id, col, pos, text)`` with non-empty cleaned text. Within a column order is ``pos``; cells of one sheet
row share a position, so across columns order is ``(pos, col)``. Sequential rules
are split into breaks that depend on two neighbouring lines only (found for all lines at once) and a short fold
inside each stretch between such breaks, so a document is never handled as one group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom import dims
from feedloom.functions import text as tx
from feedloom.operators.extract import keep_text
from feedloom.operators.ordered import block_of, carry_forward, first_rows
from feedloom.operators.stages import checkpointed


def _stretches(lines: DataFrame, keys: Sequence[str], flags: dict[str, Column], breaks, extra: Sequence[str] = ()) -> DataFrame:
    """Gather the lines between breaks (a stretch is one wrapped paragraph), in two shuffles and one reading.

    ``flags`` are properties of a line; ``breaks(before, line)`` decides from the flags of two neighbours. Lines are
    cut into blocks of positions and gathered inside each block. Only the first and the last stretch of a block may
    go on across its border; these, two per block, meet in one window per document. All other stretches stay alone
    in that window, so a document of any length is spread over many tasks.
    """
    l = lines.withColumn("_f", F.struct(*[v.alias(k) for k, v in flags.items()])).withColumn("_blk", block_of(F.col("pos")))
    inside = Window.partitionBy(*keys, "_blk").orderBy("pos")
    l = l.withColumn("_before", F.lag("_f").over(inside))
    l = l.withColumn("_start", F.coalesce(breaks(F.col("_before"), F.col("_f")), F.lit(True)).cast("long"))
    l = l.withColumn("_part", F.sum("_start").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    parts = l.groupBy(*keys, "_blk", "_part").agg(
        F.sort_array(F.collect_list(F.struct("pos", *extra, "text"))).alias("_l"),
        F.min_by("_f", "pos").alias("_first"),
        F.max_by("_f", "pos").alias("_last"),
    )
    n = F.max("_part").over(Window.partitionBy(*keys, "_blk"))
    seam = (F.col("_part") == 1) | (F.col("_part") == n)
    # seam stretches share one window partition per document, the others have one each
    parts = parts.withColumn("_seam", seam).withColumn(
        "_w", F.when(F.col("_seam"), F.lit("")).otherwise(F.concat_ws(":", "_blk", "_part"))
    )
    across = Window.partitionBy(*keys, "_w").orderBy("_blk", "_part")
    joinable = (F.col("_part") == 1) & ~F.coalesce(breaks(F.lag("_last").over(across), F.col("_first")), F.lit(True))
    parts = parts.withColumn("_new", (~joinable).cast("long"))
    parts = parts.withColumn("_run", F.sum("_new").over(across.rowsBetween(Window.unboundedPreceding, 0)))
    return parts.groupBy(*keys, "_w", "_run").agg(F.flatten(F.array_sort(F.collect_list("_l"))).alias("_l"))


def _fold(joins, extra: Sequence[str] = ()) -> Column:
    """Fold the lines of a stretch into blocks; ``joins(block, line)`` says whether the line continues the block."""
    first = F.element_at("_l", 1)
    fields = ["pos", *extra, "text"]
    one = lambda x: F.struct(*[x[f].alias(f) for f in fields])
    start = F.struct(F.slice(F.array(one(first)), 1, 0).alias("done"), one(first).alias("cur"))

    def step(state, x):
        cur = state["cur"]
        grown = F.struct(*[cur[f].alias(f) for f in fields[:-1]], F.concat_ws(" ", cur["text"], x["text"]).alias("text"))
        more = joins(cur, x)
        return F.struct(
            F.when(more, state["done"]).otherwise(F.concat(state["done"], F.array(cur))).alias("done"),
            F.when(more, grown).otherwise(one(x)).alias("cur"),
        )

    folded = F.aggregate(F.slice("_l", 2, F.greatest(F.size("_l") - 1, F.lit(0))), start, step,
                         lambda s: F.concat(s["done"], F.array(s["cur"])))
    return F.when(F.size("_l") == 1, F.array(one(first))).otherwise(folded)


def segment_lines(lines: DataFrame, keys: Sequence[str] = ("doc_id", "col")) -> DataFrame:
    """Join wrapped lines of one column into blocks.

    A line starts a block when it is noise, a prompt or a rating header, when the line before is noise or a prompt,
    or when the line before ended a sentence and this one is not lower-case. Inside the remaining stretches the
    joined text is tested as it grows.
    """
    t = F.col("text")
    flags = {
        "lone": tx.is_noise(t) | tx.is_question(t),
        "header": tx.is_rating_section(t),
        "end": tx.ends_sentence(t),
        "low": tx.starts_lower(t),
    }
    g = _stretches(
        lines, keys, flags, lambda a, b: a.isNull() | b["lone"] | b["header"] | a["lone"] | (a["end"] & ~b["low"])
    )
    blocks = _fold(lambda cur, x: ~tx.is_noise(cur["text"]) & ~tx.is_question(cur["text"]))
    return g.select(*keys, F.explode(blocks).alias("b")).select(*keys, "b.pos", "b.text")


def _unfinished(text: Column) -> Column:
    return text.rlike(r"^\d+\.\s") & ~F.regexp_replace(text, f"{tx.WS}+$", "").rlike(r"[:?.)]$")


def merge_paragraphs(lines: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Join a paragraph to the one before when it goes on in lower case after an unfinished sentence in the same
    column, or continues an unfinished numbered question."""
    t = F.col("text")
    flags = {"end": tx.ends_sentence(t), "low": tx.starts_lower(t)}
    g = _stretches(lines, keys, flags, lambda a, b: a.isNull() | a["end"] | ~b["low"], ["col"])

    def joins(cur, x):
        question = tx.is_question(cur["text"])
        open_question = question & _unfinished(cur["text"])
        return ((x["col"] == cur["col"]) | open_question) & (~question | open_question)

    blocks = _fold(joins, ["col"])
    return g.select(*keys, F.explode(blocks).alias("b")).select(*keys, "b.pos", "b.col", "b.text")


def column_bucket(blocks: DataFrame, keep: Sequence[str], x: str = "x0", text: str = "text") -> DataFrame:
    """Text blocks to lines: leading label lines go to column 0, the rest is one line in column ``x / 60 + 1``."""
    cleaned = F.filter(F.transform(F.split(tx.strip_bullets(F.col(text)), "\n"), tx.clean_text), lambda l: l != "")

    def peel(lines: Column) -> Column:
        label = lambda l: tx.is_noise(l) | tx.is_question(l) | (tx.squish(l) == "comments")
        at = F.array_position(F.transform(lines, label), False)
        k = F.least(F.when(at == 0, F.size(lines)).otherwise(at - 1), F.size(lines) - 1).cast("int")
        return F.struct(lines.alias("l"), k.alias("k"))

    # explode of one element: a generator is a barrier, so the lines are computed once and not pushed into filters
    b = blocks.select(*blocks.columns, F.explode(F.array(tx.let(cleaned, peel))).alias("_b"))
    b = b.select(*blocks.columns, F.col("_b.l").alias("_l"), F.col("_b.k").alias("_k")).filter(F.size("_l") > 0)
    labels = F.transform(F.slice("_l", 1, F.col("_k")), lambda l, i: F.struct(i.alias("part"), F.lit(0).cast("bigint").alias("col"), l.alias("line")))
    body = F.struct(
        F.col("_k").alias("part"),
        (F.floor(F.col(x) / 60) + 1).alias("col"),
        F.array_join(F.slice("_l", F.col("_k") + 1, F.size("_l")), " ").alias("line"),
    )
    return b.select(*keep, F.explode(F.concat(labels, F.array(body))).alias("r")).select(*keep, "r.part", "r.col", F.col("r.line").alias("text"))


def classify_blocks(blocks: DataFrame) -> DataFrame:
    """Clean each block, drop a glued "Comments" label and say what it is: rating, question, item or text."""

    def unglued(cleaned: Column) -> Column:
        return tx.let(
            F.regexp_replace(cleaned, rf"(?i)^comments{tx.WS}*:?{tx.WS}*-?{tx.WS}+", ""),
            lambda bare: F.when((bare != cleaned) & (tx.word_count(bare) >= 2), bare).otherwise(cleaned),
        )

    def kind(t: Column) -> Column:
        rating = (F.length(t) < 120) & tx.is_rating_section(t)
        return F.when(rating, "rating").when(tx.is_question(t), "question").when(
            tx.strip_space(t).rlike(tx.NUMBERED), "item"
        ).otherwise("text")

    both = tx.let(tx.let(tx.clean_text(F.col("text")), unglued), lambda t: F.struct(t.alias("text"), kind(t).alias("kind")))
    rest = [c for c in blocks.columns if c != "text"]
    return blocks.select(*rest, F.explode(F.array(both)).alias("_b")).select(*rest, "_b.text", "_b.kind")


def assign_question(blocks: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Each text block with the latest question above it, in the order of ``pos`` and ``col``.

    A rating header or a numbered item clears the question; short lines of a rating section are left out. There is at
    most one block at a position of a column.
    """
    at = ["pos", "col"]
    c = checkpointed(classify_blocks(blocks))
    t, kind = F.col("text"), F.col("kind")
    own = F.when(kind == "question", F.regexp_replace(t, "[ -]+$", "")).when(kind == "item", t)
    c = c.withColumn("_own", own)
    # prompts that point at an earlier numbered question: both sides meet in one window per (document, number)
    number = F.nullif(F.regexp_extract("_own", r"^(\d+)\.\s", 1), F.lit(""))
    wanted = F.when(kind == "question", F.nullif(F.regexp_extract("_own", r"(?i)answer to question (\d+)", 1), F.lit("")))
    sides = F.array(
        F.struct(number.alias("num"), F.lit(0).alias("side"), F.col("_own").alias("own")),
        F.struct(wanted.alias("num"), F.lit(1).alias("side"), F.lit(None).cast("string").alias("own")),
    )
    asked = c.filter(kind.isin("question", "item")).select(*keys, *at, F.explode(sides).alias("s"))
    above = Window.partitionBy(*keys, "num").orderBy(*at, "side").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        asked.select(*keys, *at, "s.*")
        .filter(F.col("num").isNotNull())
        .withColumn("_target", F.last("own", ignorenulls=True).over(above))
        .filter((F.col("side") == 1) & F.col("_target").isNotNull())
        .select(*keys, *at, "_target")
    )
    c = c.join(found, [*keys, *at], "left")
    question = F.when(
        F.col("_target").isNotNull(), F.concat("_own", F.lit(" (Question "), "_target", F.lit(")"))
    ).otherwise(F.col("_own"))
    setting = F.when(kind == "question", question).when(kind.isin("rating", "item"), F.lit(""))
    section = F.when(kind == "rating", True).when(kind == "question", False)
    carried = carry_forward(c, keys, at, {"_q": setting, "_sec": section}, block_of(F.col("pos")))
    skip = F.coalesce("_sec", F.lit(False)) & (tx.word_count(t) < 15)
    return carried.filter((kind == "text") & ~skip).select(
        *[x for x in blocks.columns], F.nullif("_q", F.lit("")).alias("question")
    )


def keep_response(rows: DataFrame, margins: DataFrame | None = None, id_col: str = "doc_id", floor: float = -0.8) -> DataFrame:
    """Answers that pass the rules and, when classifier margins are given, its floor (unknown texts pass)."""
    kept = rows.filter(keep_text(F.col("text")))
    if margins is None:
        return kept
    return kept.join(margins.select(id_col, "margin"), id_col, "left").filter(
        F.col("margin").isNull() | (F.col("margin") > floor)
    ).drop("margin")


def dedupe_responses(rows: DataFrame, file_id: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First of each (question, text) of a file; a missing question equals a missing question."""
    return first_rows(rows, [*file_id, "question", "text"], order)


def flag_non_teaching(rows: DataFrame, parser: Column) -> DataFrame:
    """Answers about the student; believed only for column headers and numbered questions."""
    q = F.coalesce("question", F.lit(""))
    trusted = (parser == "tabular-export") | q.rlike(r"^\d+\.\s")
    return rows.withColumn("non_teaching", trusted & q.rlike(f"(?i){dims.NON_TEACHING}"))


def extraction_warnings(counts: DataFrame) -> DataFrame:
    """``counts`` has garbage and responses per file."""
    g, r = F.col("garbage"), F.col("responses")
    many = (g >= 10) & (g >= r)
    warnings = F.array(
        F.when(
            many,
            F.format_string(
                dims.SENTENCES["unreadable_file"],
                g,
            ),
        ).when(g > 0, F.format_string(dims.SENTENCES["unreadable_some"], g)),
        F.when(r == 0, dims.SENTENCES["no_answers"]),
    )
    return counts.withColumn("warnings", F.filter(warnings, lambda w: w.isNotNull()))


def scan_detection(blocks: DataFrame, files: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """Files with almost no text per page are likely scans. ``files`` has the ``pages`` of every file, also of those
    without any text block."""
    chars = blocks.groupBy(*keys).agg(F.sum(F.length(tx.strip_space(F.col(text)))).alias("c"))
    agg = files.select(*keys, "pages").join(chars, list(keys), "left").withColumn("text_chars", F.coalesce("c", F.lit(0).cast("long"))).drop("c")
    return agg.withColumn("likely_scan", F.col("text_chars") < F.floor(50 * F.greatest(F.lit(1), F.col("pages")) / 10))
