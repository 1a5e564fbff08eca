"""Near-duplicates by SimHash, found with covering locality-sensitive hashing.

Fingerprints take a majority vote over the hashes of a text's word shingles. Documents with equal fingerprints form a
class, and only distinct fingerprints are compared. For radius r every bit position gets one of the 2**(r+1) - 1 non-zero
vectors of r + 1 bits, in turn; table v keeps the positions whose vector has an odd product with v. Any r positions span
at most r dimensions, so some v is orthogonal to all of them: two fingerprints that differ in r positions or fewer
agree under that table's mask, whatever the positions are. No pair within the radius can be missed.

Fingerprints that agree under a mask are not paired with one another. For radius 2, each of them names the fingerprints
one bit away (in the positions the mask leaves out); two are within the radius exactly if they name a common one, and at
most 65 can name the same one. So the work is linear in the size of a bucket however many near copies there are.
Links go to the smallest fingerprint of such a meeting point; components follow by star contraction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import shingles
from feedloom.llm.components import components
from feedloom.llm.rows import packed, unpacked
from feedloom.llm.scratch import Scratch
from feedloom.operators.stages import written

SHINGLE = 3
RADIUS = 2
SEED = 42
BLOCK = 1 << 18  # bytes of a text whose words are held at a time
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def shingle_hashes(text: bytes, k: int = SHINGLE) -> Iterator[list[int]]:
    """XXH64 of all windows of k words, repeats included, of a text with A-Z lowered; of all words if they are fewer.
    The hashes come in blocks, cut between words, so a very long text is never held as words at once."""
    digest = xxhash.xxh64_intdigest
    words: list[bytes] = []
    at, whole = 0, False
    while at < len(text):
        cut = _GAP.search(text, at + BLOCK) if at + BLOCK < len(text) else None
        end = cut.start() if cut else len(text)
        words += text[at:end].lower().split()
        at, n = end, len(words)
        if n < k:
            continue
        joined = b" ".join(words)
        ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
        starts = [0, *[e + 1 for e in ends[: n - k]]]
        yield [digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :])]
        whole, words = True, words[n - k + 1 :]
    if words and not whole:
        yield [digest(b" ".join(words), SEED)]


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """64 bits, of which one is set if over half the shingle hashes have it. Zero for a text without words."""
    votes, count = np.zeros(64, dtype=np.int64), 0
    for hashes in shingle_hashes((text or "").encode(), k):
        h = np.array(hashes, dtype=np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8)
        count += len(h)
        for i in range(0, len(h), 1 << 15):
            votes += np.unpackbits(h[i : i + (1 << 15)], axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(votes * 2 > count).tobytes(), "big")


def fingerprints(docs: DataFrame, doc: str = "doc_id", text: str = "text", k: int = SHINGLE) -> DataFrame:
    """(_doc, _fp): one row per row of ``docs``; the fingerprint as a signed long."""
    rows = docs.select(F.col(doc).alias("_doc"), F.col(text).cast("string").alias("_text"))

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t.as_py(), k) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], ["_doc", "_fp"])

    return rows.mapInArrow(run, f"_doc {rows.schema['_doc'].dataType.simpleString()}, _fp long")


def masks(radius: int) -> list[int]:
    """Bit masks of the covering tables (position 0 is the lowest bit)."""
    count = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(64) if ((i % count + 1) & v).bit_count() % 2) for v in range(1, count + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(fps: DataFrame) -> DataFrame:
    """(a, b) with a > b: links whose components are those of all pairs of distinct fingerprints within radius 2."""
    tables = masks(RADIUS)
    keyed = fps.select("_fp", F.explode(F.array(*[F.struct(F.lit(v).alias("_v"), F.col("_fp").bitwiseAND(_signed(m)).alias("_key")) for v, m in enumerate(tables)])).alias("_t"))
    keyed = keyed.select("_fp", "_t._v", "_t._key")
    shared = keyed.groupBy("_v", "_key").agg(F.min("_fp").alias("_lo"), F.max("_fp").alias("_hi")).where("_lo <> _hi")
    members = keyed.join(shared.select("_v", "_key"), ["_v", "_key"], "left_semi")
    free = F.array(*[F.array(F.lit(0), *[F.lit(_signed(1 << i)) for i in range(64) if not m >> i & 1]) for m in tables])
    near = members.select("_fp", F.explode(F.element_at(free, F.col("_v") + 1)).alias("_bit"))
    near = near.select("_fp", F.col("_fp").bitwiseXOR(F.col("_bit")).alias("_at")).distinct()
    # at most 65 fingerprints are one bit or less away from any point, so the set is bounded
    meets = near.groupBy("_at").agg(F.collect_set("_fp").alias("_set")).where(F.size("_set") > 1)
    pairs = meets.select(F.array_min("_set").alias("b"), F.explode("_set").alias("a")).where("a <> b")
    return pairs.select("a", "b").distinct()


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", k: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of ``docs``.

    ``component_id`` is the smallest id reachable over links. A null or blank text has fingerprint zero and is linked
    like any other. A row with a null id takes part; a component without any id has a null ``component_id``.
    Repeated rows stay. An empty table gives an empty result.
    """
    fps = written(fingerprints(docs, doc, text, k))
    classes = fps.groupBy("_fp").agg(F.min("_doc").alias("_first"))
    classes = written(classes)
    roots = components(links(classes.select("_fp")))
    joined = classes.join(roots, classes["_fp"] == roots["node"], "left").select("_fp", "_first", F.coalesce("root", "_fp").alias("_root"))
    firsts = joined.groupBy("_root").agg(F.min("_first").alias("component_id"))
    named = joined.join(firsts, "_root").select("_fp", "component_id")
    return fps.join(named, "_fp").select(
        F.col("_doc").alias("doc_id"), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def near_copies(docs: DataFrame, doc: str = "doc_id", text: str = "text", k: int = shingles.SHINGLE, similarity: float = shingles.SIMILARITY) -> DataFrame:
    """(doc_id, text_hash, component_id, first) per row of ``docs``: texts are linked if their sets of ``k``-word shingles have a
    Jaccard similarity of ``similarity`` or more, which no 64-bit fingerprint can tell, and, as in ``near_duplicates``, if their
    fingerprints are within the radius. ``first`` tells whether the row's id and text are those of the component's first row by id
    (null last), then text. Odd rows are treated as in ``near_duplicates``; rows that share an id are told apart by their texts."""
    rows = docs.select(F.col(doc).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")).withColumn("_doc", F.struct("_id", F.xxhash64("_text").alias("_t")))
    with Scratch(docs.sparkSession) as scratch:
        named, pairs = shingles.similar_pairs(rows.select("_doc", "_text"), scratch, k, similarity)
        named = scratch(named.select("_doc._id", "_doc._t", "_set"))
        prints = fingerprints(rows.select(F.col("_doc._t").alias("_t"), "_text"), "_t", "_text").distinct()
        classes = scratch(named.select(F.col("_t").alias("_doc"), "_set").distinct().join(prints, "_doc").select("_fp", "_set").distinct())
        lead = classes.groupBy("_fp").agg(F.min("_set").alias("_lead"))
        equal = classes.join(lead, "_fp").select(F.col("_set").alias("a"), F.col("_lead").alias("b"))
        near = links(lead.select("_fp")).join(lead.select(F.col("_fp").alias("a"), F.col("_lead").alias("_a")), "a").join(lead.select(F.col("_fp").alias("b"), F.col("_lead").alias("_b")), "b")
        edges = pairs.unionByName(equal).unionByName(near.select(F.col("_a").alias("a"), F.col("_b").alias("b"))).where("a <> b")
        roots = components(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        joined = named.join(roots, F.col("_set") == F.col("node"), "left").select("_id", "_t", F.coalesce("root", "_set").alias("_root"))
        place = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_t").alias("t"))
        firsts = joined.groupBy("_root").agg(F.min("_id").alias("component_id"), F.min(place).alias("_first"))
        out = joined.join(firsts, "_root").select(F.col("_id").alias("doc_id"), F.col("_t").alias("text_hash"), "component_id", (place == F.col("_first")).alias("first"))
        return written(out)


def one_of_each(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each group of near copies: that with the smallest id, and of rows that share it the one with the
    smallest hash of its text. Rows of one id with different texts are rows of their own. A row without an id stays only if its group
    has no row with one. Rows that repeat id and text are one."""
    found = near_copies(docs, doc, text).where("first")
    keep = found.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_h")).agg(F.count("*").alias("_n"))
    hashed = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    joined = packed(docs, F.col(doc).alias("_key"), hashed.alias("_text")).join(keep, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_h")))
    single = joined.where("_n = 1")
    repeated = joined.where("_n > 1").dropDuplicates(["_key", "_text"])
    return unpacked(single.unionByName(repeated))


def op7_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
