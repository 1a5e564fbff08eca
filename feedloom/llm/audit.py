"""Interaction audit of five filters: what each removes in every order, and its fair share of all that is removed.

A document either fails a filter or not, so it is one of 32 patterns. Per part of the table the removals of all 32
coalitions of filters are tabulated: v(S) counts the documents that fail a filter of S. A step of an order removes
v(S + filter) - v(S), whatever the order of S was, so 120 orders need no more than the coalitions.

Shares are the Shapley values, got as a constrained least-squares fit: an additive model of the coalitions, weighted by the
Shapley kernel and held to the removals of all filters together. The normal equations with their Lagrange row are solved
exactly in rationals, once for each coalition as the right side (the solution is linear in v); what is left per part is a sum
of integers.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.words import doc_of_word, mix, pieces, text_bytes, words_in

FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT = 50  # different words in a hundred
MOST_CAPITALS = 2  # capitals in a hundred characters
SYMBOLS = b"#$%&*|"
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def _solved(a: list[list[Fraction]], b: list[Fraction]) -> list[Fraction]:
    """x with a x = b, by elimination in rationals."""
    rows = [[*r, y] for r, y in zip(a, b)]
    n = len(rows)
    for i in range(n):
        pivot = next(j for j in range(i, n) if rows[j][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for j in range(n):
            if j != i and rows[j][i]:
                rows[j] = [x - rows[j][i] * y for x, y in zip(rows[j], rows[i])]
    return [r[n] for r in rows]


def share_weights(m: int = len(FILTERS)) -> list[list[Fraction]]:
    """For each of ``m`` players the factors of v(S), S from 0 to 2**m - 1, that give its share."""
    everyone = (1 << m) - 1
    kernel = {s: Fraction(m - 1, comb(m, s.bit_count()) * s.bit_count() * (m - s.bit_count())) for s in range(1, everyone)}
    a = [[sum((w for s, w in kernel.items() if s >> i & 1 and s >> j & 1), Fraction()) for j in range(m)] for i in range(m)]
    bordered = [[*r, Fraction(1)] for r in a] + [[Fraction(1)] * m + [Fraction()]]
    columns = []
    for s in range(everyone + 1):
        right = [kernel[s] if s in kernel and s >> i & 1 else Fraction() for i in range(m)]
        columns.append(_solved(bordered, [*right, Fraction(int(s == everyone))])[:m])
    return [[c[i] for c in columns] for i in range(m)]


def _counts_by_text(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the marked bytes each text has."""
    return np.diff(np.searchsorted(np.flatnonzero(marks), offsets))


def patterns_of(texts: pa.Array) -> np.ndarray:
    """For each text the bits of the filters A to D that it fails."""
    data, offsets = text_bytes(texts)
    words = words_in(data, offsets, lower=False)
    n_words = np.diff(words.bounds)
    doc = doc_of_word(words)
    order = np.argsort(mix(words.hashes + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), kind="stable")
    h, d = words.hashes[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    distinct = np.bincount(d[new], minlength=len(n_words))
    capitals = _counts_by_text((data >= 65) & (data <= 90), offsets)
    characters = _counts_by_text((data & 0xC0) != 0x80, offsets)
    symbol = np.zeros(256, dtype=bool)
    symbol[list(SYMBOLS)] = True
    fails = [n_words < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * n_words, 100 * capitals > MOST_CAPITALS * characters, _counts_by_text(symbol[data], offsets) > 0]
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


def patterns(docs: DataFrame, doc: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(_id, _part, _h1, _h2, _mask) per row: the text by a 128-bit hash, and the filters A to D that it fails."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(doc).cast("long").alias("_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("_part"),
        F.xxhash64(body).alias("_h1"), F.xxhash64(F.lit(1), body).alias("_h2"), body.alias("_text"),
    )

    def run(batches):
        for piece in pieces(batches):
            yield pa.record_batch([*piece.columns[:4], pa.array(patterns_of(piece.column(4)), pa.int32())], ["_id", "_part", "_h1", "_h2", "_mask"])

    return rows.mapInArrow(run, "_id long, _part string, _h1 long, _h2 long, _mask int")


def pattern_counts(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, _mask, _good, _toxic, _n): documents per part, pattern of the five filters and labels.

    Texts are compared by counts, not by rows: equal texts of one part and label are one row before any of them meet.
    """
    rated = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_rated")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("_g"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("_t")
    )
    rows = patterns(docs, doc, text, part)
    rows = rows.join(rated, F.col("_id") == F.col("_rated"), "left").select(
        "_id", "_part", "_h1", "_h2", "_mask", F.coalesce("_g", F.lit(False)).alias("_good"), F.coalesce("_t", F.lit(False)).alias("_toxic")
    )
    keys = ["_h1", "_h2", "_part", "_good", "_toxic"]
    each = rows.groupBy("_id", *keys, "_mask").agg(F.count("*").alias("_n"))
    # a text's smallest id in each cell, with its rows: those of the smallest of all cells do not fail E, nor do rows without id
    cells = each.groupBy(*keys, "_mask").agg(
        F.sum("_n").alias("_n"), F.coalesce(F.sum(F.when(F.col("_id").isNull(), F.col("_n"))), F.lit(0)).alias("_unnamed"),
        F.min(F.when(F.col("_id").isNotNull(), F.struct("_id", "_n"))).alias("_least"),
    )
    first = cells.groupBy("_h1", "_h2").agg(F.min("_least._id").alias("_first"))
    cells = cells.join(first, ["_h1", "_h2"])
    passing = F.col("_unnamed") + F.when(F.col("_least._id") == F.col("_first"), F.col("_least._n")).otherwise(0)
    split = F.array(F.struct(F.col("_mask").alias("m"), passing.alias("n")), F.struct((F.col("_mask") + 16).alias("m"), (F.col("_n") - passing).alias("n")))
    halves = cells.select(F.col("_part").alias("part"), "_good", "_toxic", F.explode(split).alias("_x")).where("_x.n > 0")
    return halves.groupBy("part", F.col("_x.m").alias("_mask"), "_good", "_toxic").agg(F.sum("_x.n").alias("_n"))


def _removals(only: Column | None) -> Column:
    """v(S) for S from 0 to 31 as an array."""
    counted = F.col("_n") if only is None else F.when(only, F.col("_n"))
    return F.array(*[F.coalesce(F.sum(F.when(F.col("_mask").bitwiseAND(s) != 0, counted)), F.lit(0)) for s in range(1 << len(FILTERS))])


def audited(counts: DataFrame) -> DataFrame:
    """One row per part, order and step from the counts of ``pattern_counts``."""
    bits = range(len(FILTERS))
    per_part = counts.groupBy("part").agg(
        F.sum("_n").alias("_all"), _removals(None).alias("_v"), _removals(F.col("_good")).alias("_vg"), _removals(F.col("_toxic")).alias("_vt"),
        F.array(*[F.coalesce(F.sum(F.when(F.col("_mask") == 1 << i, F.col("_n"))), F.lit(0)) for i in bits]).alias("_only"),
    )
    times = factorial(len(FILTERS))
    factors = [[w * times for w in row] for row in share_weights()]
    if any(w.denominator != 1 for row in factors for w in row):
        raise ArithmeticError("shares times the number of orders are not whole")
    share = [sum((F.col("_v")[s] * int(w) for s, w in enumerate(row) if w), F.lit(0).cast("long")) for row in factors]
    per_part = per_part.withColumn("_share", F.array(*share))
    orders = per_part.select("*", F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order"))
    steps = orders.select("*", F.explode(F.array(*[F.lit(i + 1) for i in bits])).alias("step"))
    letter = F.ascii(F.substring("filter_order", F.col("step"), F.lit(1))) - ord("A")
    before = F.expr(f"aggregate(sequence(1, {len(FILTERS)}), 0, (s, i) -> s | if(i < step, shiftleft(1, ascii(substring(filter_order, i, 1)) - {ord('A')}), 0))")
    steps = steps.withColumn("_i", letter).withColumn("_before", before)
    steps = steps.withColumn("_own", F.expr("shiftleft(1, _i)")).withColumn("_after", F.col("_before").bitwiseOR(F.col("_own")))

    def difference(v: str) -> Column:
        return F.col(v)[F.col("_after")] - F.col(v)[F.col("_before")]

    return steps.select(
        "part", "filter_order", "step",
        (F.col("_all") - F.col("_v")[F.col("_after")]).alias("kept"), difference("_v").alias("removed"),
        (F.col("_v")[F.col("_own")] - difference("_v")).alias("redundant"), F.col("_only")[F.col("_i")].alias("unique_fails"),
        difference("_vg").alias("good_lost"), difference("_vt").alias("toxic_lost"), F.col("_share")[F.col("_i")].alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    A null text is empty and a null part is the empty string. A row without an id never fails E, nor makes another fail, and
    has no label. Rows that repeat an id are counted each; E looks only for smaller ids. An id with several labels is good (toxic)
    if one of them says so. An empty table has no parts and gives no rows. Further columns are not read.
    """
    return audited(pattern_counts(docs, labels, doc, text, part))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


_WORDS = r"regexp_extract_all(body, '[^\x20\x09-\x0D]+')"
OP11_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body FROM documents
), firsts AS (
  SELECT body, min(doc_id) AS first_id FROM d GROUP BY body
), rated AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), failing AS (
  SELECT d.part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    [len({_WORDS}) < 200, 100 * len(list_distinct({_WORDS})) < 50 * len({_WORDS}),
     100 * (length(body) - length(regexp_replace(body, '[A-Z]', '', 'g'))) > 2 * length(body),
     regexp_matches(body, '[#$%&*|]'), coalesce(d.doc_id > first_id, false)] AS f
  FROM d JOIN firsts USING (body) LEFT JOIN rated ON d.doc_id = rated.doc_id
), parts AS (SELECT part, good, toxic, f, count(*) AS n FROM failing GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l
), orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), runs AS (  -- the step at which each order removes a pattern, 0 if none does
  SELECT p.*, filter_order, coalesce(list_position(list_transform(range(1, 6), lambda i: f[ascii(filter_order[i]) - 64]), true), 0) AS gone
  FROM parts p, orders
), steps AS (
  SELECT part, filter_order, step::INTEGER AS step, ascii(filter_order[step]) - 64 AS i,
    sum(CASE WHEN gone = 0 OR gone > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone = step THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN f[i] AND gone < step THEN n ELSE 0 END) AS redundant, sum(CASE WHEN f[i] AND len(list_filter(f, lambda x: x)) = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN gone = step AND good = 1 THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN gone = step AND toxic = 1 THEN n ELSE 0 END) AS toxic_lost
  FROM runs, (SELECT unnest(range(1, 6)) AS step) GROUP BY ALL
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, i))::BIGINT AS shapley
FROM steps
"""
