"""Texts that share most of their word shingles, found by an exact set-similarity join.

Shingles have one order that holds for all texts. Of two sets with Jaccard similarity t, the first n - ceil(t n) + 1 shingles
of either (its prefix) have one in common, so texts that share no prefix shingle need no comparison and no similar pair is
missed. Frequent shingles come last in the order, so a passage that many texts carry is in few prefixes; which ones are late is
kept as a bitmap of fixed size over hashes, since any common order will do. Equal sets are one class. Classes that share a
prefix shingle are compared with one of them first; of the rest, only pairs that are not yet connected are compared.

Texts are read and hashed once. Prefix rows carry the place of their shingle, which bounds what the two sets can share; parities of
counts bound what they differ in; only pairs that pass both fetch their sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.components import components
from feedloom.llm.scratch import Scratch
from feedloom.llm.words import mix, pieces, windows, words_of

SHINGLE = 5
SIMILARITY = 0.8
FREQUENT = 50  # sets with a shingle in their prefix beyond which it goes to the end of the order
LATE_BITS = 27  # a bitmap of 16 MB
ROUNDS = 2  # in which the sets of a shingle meet one of them; after these all that are not connected meet
BLOCK = 1 << 19  # bytes of parities of one shingle's sets that are compared with as many others in one piece
CELLS = 1024  # at least; a larger set has as many cells as shingles or more
PIECE = 1 << 20  # bytes that a task works on at a time


def _sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted different hashes of each text's windows of ``k`` words; of all its words if they are fewer."""
    w = words_of(column)
    h, at = windows(w.hashes, w.bounds, k)
    cuts = np.searchsorted(at, w.bounds)
    out = []
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        own = w.hashes[w.bounds[i] : w.bounds[i + 1]]
        out.append(np.unique(h[a:b]) if b > a else windows(own, np.array([0, len(own)]), len(own))[0] if len(own) else own)
    return out


def _prefix(s: np.ndarray, late: np.ndarray | None, similarity: float) -> np.ndarray:
    n = len(s) - int(np.ceil(similarity * len(s) - 1e-9)) + 1 if len(s) else 0
    if late is not None and len(s):
        is_late = _is_set(late, s)
        s = np.concatenate((s[~is_late], s[is_late]))
    return s[:n]


def _parities(s: np.ndarray) -> bytes:
    """The parities of how many shingles fall into each cell: two sets differ in as many shingles at least as their parities differ
    in bits. The cells are a power of two that grows with the set, so that parities tell sets of any size apart."""
    cells = max(CELLS, 1 << (len(s) - 1).bit_length()) if len(s) else CELLS
    return np.packbits((np.bincount((s & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1).astype(np.uint8)).tobytes()


def _folded(rows: np.ndarray, width: int) -> np.ndarray:
    """Parities (one row of bytes per set) over fewer cells."""
    while rows.shape[1] > width:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def _differing(x: pa.Array, y: pa.Array) -> np.ndarray:
    """In how many bits the parities of each pair differ, over the cells of the smaller one."""
    widths = [np.asarray(pc.binary_length(c), dtype=np.int64) for c in (x, y)]
    out = np.zeros(len(x), dtype=np.int64)
    for p, q in np.unique(np.stack(widths, axis=1), axis=0):
        rows = pa.array(np.flatnonzero((widths[0] == p) & (widths[1] == q)))
        one, two = (np.frombuffer(b"".join(c.take(rows).to_pylist()), np.uint8).reshape(-1, w) for c, w in ((x, p), (y, q)))
        out[rows] = np.bitwise_count(_folded(one, min(p, q)) ^ _folded(two, min(p, q))).sum(axis=1, dtype=np.int64)
    return out


def _named_sets(rows: DataFrame, k: int) -> DataFrame:
    """(_doc, _set, _n, _bits, _hashes) per (_doc, _text) row: the name and size of its set of shingles. A task gives the set itself and
    its parities with the first of its texts that has it (it forgets which ones it has given when they are many)."""
    kind = rows.schema["_doc"].dataType.simpleString()

    def run(batches):
        given: set[int] = set()
        for part in pieces(batches, PIECE):
            sets = _sets(part.column(1), k)
            # a sum of mixed hashes does not depend on their order
            names = [int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) for s in sets]
            new = []
            for name in names:
                new.append(name not in given)
                given.add(name)
            if len(given) > 1 << 17:
                given.clear()
            yield pa.record_batch(
                [
                    part.column(0), pa.array(np.array(names, dtype=np.uint64).view(np.int64)), pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([_parities(s) if own else None for s, own in zip(sets, new)], pa.binary()), pa.array([s.tobytes() if own else None for s, own in zip(sets, new)], pa.binary()),
                ],
                ["_doc", "_set", "_n", "_bits", "_hashes"],
            )

    return rows.mapInArrow(run, f"_doc {kind}, _set long, _n int, _bits binary, _hashes binary")


def _prefixes(named: DataFrame, similarity: float, late=None, shared=None) -> DataFrame:
    """(_set, _n, _h, _at, _k): the prefix of each set, with the place of each shingle in the order. ``shared``: only shingles whose
    bit is set in this bitmap; ``_k`` is the number of those before it."""

    def run(batches):
        bitmap = late.value if late is not None else None
        for part in pieces(batches, PIECE):
            names, sizes = part.column(0).to_numpy(), part.column(1).to_numpy()
            shown = [_prefix(np.frombuffer(x.as_py(), np.uint64), bitmap, similarity) for x in part.column(2)]
            count = np.array([len(s) for s in shown], dtype=np.int64)
            flat = np.concatenate(shown) if len(shown) else np.zeros(0, np.uint64)
            owner, at = np.repeat(np.arange(len(shown)), count), np.arange(len(flat)) - np.repeat(np.cumsum(count) - count, count)
            before = at
            if shared is not None:
                keep = np.flatnonzero(_is_set(shared.value, flat))
                owner, at, flat = owner[keep], at[keep], flat[keep]
                left = np.bincount(owner, minlength=len(shown))
                before = np.arange(len(flat)) - np.repeat(np.cumsum(left) - left, left)
            columns = [pa.array(names[owner]), pa.array(sizes[owner]), pa.array(flat.view(np.int64)), pa.array(at.astype(np.int32)), pa.array(before.astype(np.int32))]
            yield pa.record_batch(columns, ["_set", "_n", "_h", "_at", "_k"])

    return named.where("_hashes IS NOT NULL").select("_set", "_n", "_hashes").mapInArrow(run, "_set long, _n int, _h long, _at int, _k int")


def _is_set(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = h & np.uint64((1 << LATE_BITS) - 1)
    return (bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63)) & np.uint64(1)).astype(bool)


def _bitmap(hashes: DataFrame) -> np.ndarray | None:
    """A bitmap over the low bits of the hashes ``_h``; none if there are none. It reaches the driver as the words of the bitmap that
    are not zero: 2**LATE_BITS / 64 rows at most, whatever the size of the data. Other shingles with the same bits are in it too, so
    it only orders or thins out rows; it decides nothing."""
    place = F.col("_h").bitwiseAND((1 << LATE_BITS) - 1)
    words = hashes.groupBy(F.shiftright(place, 6).alias("_w")).agg(F.bit_or(F.expr("shiftleft(1L, int(_h & 63))")).alias("_b")).toArrow()
    if not words.num_rows:
        return None
    out = np.zeros(1 << (LATE_BITS - 6), dtype=np.int64)
    out[words.column("_w").to_numpy()] = words.column("_b").to_numpy()
    return out.view(np.uint64)


def _sizes_fit(a: str, b: str, similarity: float) -> Column:
    return F.least(a, b) >= F.greatest(a, b) * F.lit(similarity) - 1e-9


def _places_fit(similarity: float) -> Column:
    """Whether sets of sizes _n, _n2 that share the shingle at the places _at, _at2 can share enough. After it they share at most as many
    as the smaller side has. What they share before it is in both prefixes, so at most as many as are in several prefixes."""
    most = F.least("_k", "_k2") + F.least(F.col("_n") - F.col("_at"), F.col("_n2") - F.col("_at2"))
    return most >= (F.col("_n") + F.col("_n2")) * F.lit(similarity / (1 + similarity)) - 1e-6


def _differ_little(pairs: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of the rows (a, b, _na, _nb, _bitsa, _bitsb) whose parities allow the similarity."""

    def run(batches):
        for part in pieces(batches, PIECE):
            most = (part.column(2).to_numpy().astype(np.int64) + part.column(3).to_numpy()) * ((1 - similarity) / (1 + similarity)) + 1e-6
            keep = _differing(part.column(4), part.column(5)) <= most
            yield pa.record_batch([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(keep))

    return pairs.select("a", "b", "_na", "_nb", "_bitsa", "_bitsb").mapInArrow(run, "a long, b long")


def _share_enough(pairs: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of the rows (a, b, _x, _y) whose sets are similar."""

    def run(batches):
        for part in pieces(batches, PIECE):
            keep = []
            for x, y in zip(part.column(2), part.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                at = np.minimum(np.searchsorted(x, y), max(len(x) - 1, 0))
                same = int((x[at] == y).sum()) if len(x) else 0
                keep.append(same >= (len(x) + len(y) - same) * similarity - 1e-9)
            yield pa.record_batch([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "_x", "_y").mapInArrow(run, "a long, b long")


def _fitting(named: DataFrame, similarity: float, pairs: DataFrame) -> DataFrame:
    """(a, b) of the rows of ``pairs`` (two prefix rows of one shingle) whose sets may be similar by size, place and parities."""
    fit = pairs.where(_sizes_fit("_n", "_n2", similarity) & _places_fit(similarity))
    fit = fit.select(F.greatest("_set", "_set2").alias("a"), F.least("_set", "_set2").alias("b")).distinct()
    bits = named.where("_bits IS NOT NULL").select("_set", "_n", "_bits").dropDuplicates(["_set"])
    each = [bits.select(F.col("_set").alias(c), F.col("_n").alias(f"_n{c}"), F.col("_bits").alias(f"_bits{c}")) for c in "ab"]
    return _differ_little(fit.join(each[0], "a").join(each[1], "b"), similarity)


def _similar(named: DataFrame, scratch: Scratch, similarity: float, pairs: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets are similar."""
    near = scratch(pairs)
    wanted = near.select(F.explode(F.array("a", "b")).alias("_set")).distinct()
    whole = scratch(named.where("_hashes IS NOT NULL").select("_set", "_hashes").join(wanted, "_set", "left_semi").dropDuplicates(["_set"]))
    one = near.join(whole.select(F.col("_set").alias("a"), F.col("_hashes").alias("_x")), "a")
    both = one.join(whole.select(F.col("_set").alias("b"), F.col("_hashes").alias("_y")), "b")
    out = scratch(_share_enough(both, similarity))
    scratch.drop(near, whole)
    return out


def _near_in_block(group: pa.Table, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of names, of sets with different roots whose sizes and parities allow the similarity. The rows are in order of size; if they are of two
    blocks, only pairs with one of each count."""
    names, sizes, roots, own = (group[c].to_numpy() for c in ("_set", "_n", "_root", "_own"))
    one_block = group["_lo"][0].as_py() == group["_hi"][0].as_py()
    widths = pc.binary_length(group["_bits"]).to_numpy()
    for width in np.unique(widths):
        base = np.flatnonzero(widths == width)
        ends = np.searchsorted(sizes, sizes / similarity + 1e-6, side="right")
        reach = np.arange(base[0], ends[base[-1]])  # wider rows too, if their sizes fit
        bits = np.zeros((len(reach), width), np.uint8)
        for w in np.unique(widths[reach]):
            of = np.flatnonzero(widths[reach] == w)
            bits[of] = _folded(np.frombuffer(b"".join(group["_bits"].take(pa.array(reach[of])).to_pylist()), np.uint8).reshape(-1, w), width)
        bits = bits.view(np.uint64)
        for i in base:
            others = np.arange(i + 1, ends[i])
            others = others[roots[others] != roots[i]] if one_block else others[(roots[others] != roots[i]) & (own[others] != own[i])]
            differ = np.bitwise_count(bits[others - base[0]] ^ bits[i - base[0]]).sum(axis=1, dtype=np.int64)
            others = others[differ <= (sizes[others].astype(np.int64) + sizes[i]) * ((1 - similarity) / (1 + similarity)) + 1e-6]
            if len(others):
                yield np.maximum(names[others], names[i]), np.minimum(names[others], names[i])


def _near_in_blocks(left: DataFrame, named: DataFrame, scratch: Scratch, similarity: float) -> DataFrame:
    """(a, b): the pairs of sets with a shingle in common and different roots whose sizes and parities allow the similarity. The sets of a shingle
    meet in blocks of bounded size, each with each: a pair costs a comparison of bits, and a row only if it passes."""
    bits = named.where("_bits IS NOT NULL").select("_set", "_bits").dropDuplicates(["_set"])
    rows = scratch(left.select("_h", "_set", "_n", "_root").join(bits, "_set"))
    blocks = rows.groupBy("_h").agg(F.ceil(F.sum(F.octet_length("_bits")) / BLOCK).alias("_blocks"))
    rows = rows.join(blocks, "_h").withColumn("_own", F.pmod(F.xxhash64("_set"), F.col("_blocks")))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    rows = rows.select("_h", F.least("_own", "_other").alias("_lo"), F.greatest("_own", "_other").alias("_hi"), "_own", "_set", "_n", "_root", "_bits")

    def run(batches):
        held = None

        def near(group):
            for a, b in _near_in_block(group, similarity):
                yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

        for part in batches:
            held = pa.concat_tables([held, pa.Table.from_batches([part])]) if held is not None else pa.Table.from_batches([part])
            keys = [held[c].to_numpy() for c in ("_h", "_lo", "_hi")]
            cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            for a, b in zip([0, *cuts], cuts):
                yield from near(held.slice(a, b - a))
            held = held.slice(cuts[-1]) if len(cuts) else held  # the last group may go on
        if held is not None and held.num_rows:
            yield from near(held)

    return rows.repartition("_h", "_lo", "_hi").sortWithinPartitions("_h", "_lo", "_hi", "_n").mapInArrow(run, "a long, b long")


def _open(keyed: DataFrame, found: DataFrame) -> DataFrame:
    """Prefix rows with the ``_root`` of their set over the links ``found``, of shingles whose sets are not all connected."""
    roots = components(found)
    rooted = keyed.drop("_root").join(roots, F.col("_set") == F.col("node"), "left").withColumn("_root", F.coalesce("root", "_set")).drop("node", "root")
    several = rooted.groupBy("_h").agg(F.min("_root").alias("_lo"), F.max("_root").alias("_hi")).where("_lo <> _hi").select("_h")
    return rooted.join(several, "_h", "left_semi")


def similar_pairs(texts: DataFrame, scratch: Scratch, k: int = SHINGLE, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """For (_doc, _text) rows: the (_doc, _set) of each row, and (a, b) with a > b, pairs of sets that are similar. The pairs
    connect exactly what all similar pairs connect. Texts without words have one set, that of no shingles."""
    spark = texts.sparkSession
    named = scratch(_named_sets(texts, k))
    late = _bitmap(_prefixes(named, similarity).groupBy("_h").count().where(F.col("count") > FREQUENT))
    late = spark.sparkContext.broadcast(late) if late is not None else None
    # most shingles are in one set only: those that are not are found first, and only their rows are kept
    several = _prefixes(named, similarity, late).groupBy("_h").agg(F.min("_set").alias("_lo"), F.max("_set").alias("_hi")).where("_lo <> _hi")
    bitmap = _bitmap(several)
    if bitmap is None:
        return named.select("_doc", "_set"), spark.createDataFrame([], "a long, b long")
    keyed = scratch(_prefixes(named, similarity, late, spark.sparkContext.broadcast(bitmap)))
    similar = partial(_similar, named, scratch, similarity)
    # a set may be given by several tasks
    left = scratch(keyed.distinct().withColumn("_root", F.col("_set")))
    scratch.drop(keyed)
    found = spark.createDataFrame([], "a long, b long")
    for number in range(ROUNDS):
        # one set for each shingle, another each time: in one round a set meets as many as it has open shingles
        pivot = F.col("_set") if number == 0 else F.xxhash64("_set", "_h", F.lit(number))
        row = F.struct(*[F.col(c) for c in ("_set", "_n", "_at", "_k", "_root")])
        ends = left.groupBy("_h").agg(F.min("_root").alias("_lo"), F.max("_root").alias("_hi"), F.min_by(row, pivot).alias("_p")).where("_lo <> _hi")
        met = left.join(ends.select("_h", *[F.col(f"_p.{c}").alias(c + "2") for c in ("_set", "_n", "_at", "_k", "_root")]), "_h")
        found = found.unionByName(similar(_fitting(named, similarity, met.where("_root <> _root2"))))
        before, left = left, scratch(_open(left, found))
        scratch.drop(before)
    # all that are not connected meet: as rows if few have the shingle, else in blocks
    size = left.groupBy("_h").count()
    few, many = (left.join(size.where(which), "_h", "left_semi") for which in (F.col("count") <= FREQUENT, F.col("count") > FREQUENT))
    other = few.select("_h", *[F.col(c).alias(c + "2") for c in ("_set", "_n", "_at", "_k", "_root")])
    met = few.join(other, "_h").where((F.col("_set") > F.col("_set2")) & (F.col("_root") != F.col("_root2")))
    rest = similar(_fitting(named, similarity, met).unionByName(_near_in_blocks(many, named, scratch, similarity)).distinct())
    return named.select("_doc", "_set"), found.unionByName(rest)
