"""Fuzzy passages that documents share, found by collinear chaining of k-mer seeds.

Seeds are windows of ``K`` words, of which the smallest hash in every ``WINDOW`` neighbours is kept, so a common run of
K + WINDOW - 1 words always shares one. Every seed that several documents have links its occurrences to the first
document that has it, not to one another; a passage in thousands of documents costs as many links as it has copies.
The links of two documents are chained in order of both positions: a chain pays for the words it skips on either side,
and a Fenwick tree over the second position gives each link its best predecessor. Chains are aligned word by word
between their seeds and beyond their ends, and an alignment is a passage if it is long and similar enough.

Documents meet through the first document of a passage; ``passages`` gives pairs with that document. Places of a seed where
that found nothing meet the first of themselves, and what is left meets every other place of the seed: by the pairs of words
around them, in blocks of bounded size, so that a line in many documents costs a comparison of bits a pair and no row. Seeds, links and
chains are keyed rows; no document or group is ever in one row as a whole but a document's own words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedloom.llm.words import mix, pieces, windows, words_of
from feedloom.operators.stages import written

K = 8
WINDOW = 16
LEAST_WORDS = 50
SIMILARITY = 0.8
SKIP_COST = 0.12  # of a skipped word on either side; a seed is worth K
REACH = 64  # words that an alignment may grow beyond the ends of its chain
CUTS = (24, 6)  # gaps in words at which a chain is cut whose alignment is not similar enough
_RUN = np.uint64(0x5851F42D4C957F2D)
DROP = 8  # an end grows until its score has fallen by this much
SIGNATURE = 4096  # bits for the pairs of words within REACH of a seed
USUAL = 128  # bits that most places of a block have are compared as words
STRIP = 64  # places that are compared with all others of a block at once
ROWS = 2048  # rows whose ends or signatures are worked out together
BLOCK = 2048  # places of one seed that are compared with as many others in one piece


def minimisers(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word position, hash) of the seeds of texts given as word hashes. A text below K words has none."""
    seeds, at = windows(hashes, bounds, K)
    if not len(seeds):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), seeds
    text = np.searchsorted(bounds, at, side="right") - 1
    chosen = np.zeros(len(seeds), dtype=bool)
    starts = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
    ends = np.concatenate((starts[1:], [len(seeds)]))
    if len(seeds) >= WINDOW:
        views = np.lib.stride_tricks.sliding_window_view(seeds, WINDOW)
        inside = np.flatnonzero(text[: len(views)] == text[WINDOW - 1 :])
        for i in range(0, len(inside), 1 << 16):
            w = inside[i : i + (1 << 16)]
            chosen[w + views[w].argmin(axis=1)] = True
    for a, b in zip(starts[ends - starts < WINDOW], ends[ends - starts < WINDOW]):  # texts with fewer windows keep their least
        chosen[a + seeds[a:b].argmin()] = True
    keep = np.flatnonzero(chosen)
    runs = _run_seeds(hashes, bounds, seeds, at)
    found = np.concatenate((keep, runs))
    value = np.concatenate((seeds[keep], mix(seeds[runs] ^ _RUN)))
    order = np.lexsort((at[found], text[found]))
    found, value = found[order], value[order]
    return text[found], at[found] - bounds[text[found]], value


def _run_seeds(hashes: np.ndarray, bounds: np.ndarray, seeds: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One seed (an index into ``seeds``) for each stretch of more than LEAST_WORDS words that repeats a pattern of at most K
    words: the least of the pattern's first occurrence. Its hash is marked, so that long runs meet runs as long; by
    ordinary seeds they would meet the first document that has the pattern, however short it is there."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    known = np.zeros(len(hashes), dtype=bool)
    out = []
    for p in range(1, min(K, len(hashes) - 1) + 1):
        same = np.concatenate(([False], (hashes[p:] == hashes[:-p]) & (doc[p:] == doc[:-p]), [False]))
        edge = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
        for start, end in edge[edge[:, 1] - edge[:, 0] + p > LEAST_WORDS].tolist():
            if not known[start : end + p].all():  # else it repeats a shorter pattern already
                known[start : end + p] = True
                first = np.searchsorted(at, start)
                out.append(first + int(seeds[first : first + p].argmin()))
    return np.array(out, dtype=np.int64)


def prepared(docs: DataFrame) -> DataFrame:
    """Per (_doc, _text) row: its words as 16-bit hashes (for alignment only), and the hashes and positions of its seeds."""
    kind = docs.schema["_doc"].dataType.simpleString()

    def run(batches):
        for part in pieces(batches):
            w = words_of(part.column(1))
            text, at, seed = minimisers(w.hashes, w.bounds)
            bounds = pa.array(np.searchsorted(text, np.arange(part.num_rows + 1)).astype(np.int32))
            words = pa.ListArray.from_arrays(pa.array(w.bounds.astype(np.int32)), pa.array((w.hashes >> np.uint64(48)).astype(np.uint16).view(np.int16)))
            yield pa.record_batch(
                [part.column(0), words, pa.ListArray.from_arrays(bounds, pa.array(seed.view(np.int64))), pa.ListArray.from_arrays(bounds, pa.array(at.astype(np.int32)))],
                ["_doc", "_words", "_seeds", "_at"],
            )

    return docs.mapInArrow(run, f"_doc {kind}, _words array<smallint>, _seeds array<long>, _at array<int>")


def chains(a: list[int], b: list[int]) -> list[list[int]]:
    """Chains of the links (a[i], b[i]), as lists of indices; ``a`` is sorted, then ``b``.

    A link's score is K plus that of its best predecessor (smaller in both positions) less SKIP_COST for each word between
    them on either side; below K it starts a chain of its own. As the cost is a sum over both sides, a predecessor's
    score plus SKIP_COST times its own positions is all that a maximum over a prefix of ``b`` has to hold: a Fenwick tree.
    """
    n = len(a)
    score, before = [float(K)] * n, [-1] * n
    if all(x < y for x, y in zip(b, b[1:])) and all(x < y for x, y in zip(a, a[1:])):
        for i in range(1, n):  # all in order: the link before is the best predecessor
            s = score[i - 1] - SKIP_COST * max(0, a[i] - a[i - 1] - K) - SKIP_COST * max(0, b[i] - b[i - 1] - K)
            if s > 0:
                score[i], before[i] = s + K, i - 1
    else:
        rank = {v: r + 1 for r, v in enumerate(sorted(set(b)))}
        size = len(rank)
        tree: list[tuple[float, int]] = [(float("-inf"), -1)] * (size + 1)
        i = 0
        while i < n:
            j = i
            while j < n and a[j] == a[i]:  # links at one place cannot follow one another
                r, best = rank[b[j]] - 1, (float("-inf"), -1)
                while r > 0:
                    best = max(best, tree[r])
                    r -= r & -r
                if best[1] >= 0:
                    k = best[1]
                    s = score[k] - SKIP_COST * max(0, a[j] - a[k] - K) - SKIP_COST * max(0, b[j] - b[k] - K)
                    if s > 0:
                        score[j], before[j] = s + K, k
                j += 1
            for m in range(i, j):
                r, value = rank[b[m]], (score[m] + SKIP_COST * (a[m] + b[m]), m)
                while r <= size:
                    if tree[r] < value:
                        tree[r] = value
                    r += r & -r
            i = j
    out, used = [], [False] * n
    for i in sorted(range(n), key=lambda i: -score[i]):
        path = []
        while i >= 0 and not used[i]:
            used[i] = True
            path.append(i)
            i = before[i]
        if path:
            out.append(path[::-1])
    return out


def _chained(links: DataFrame) -> DataFrame:
    """(_doc, _first, _a, _b): one row per chain with its links' positions; ``links`` is sorted within its partitions."""
    kind = links.schema["_doc"].dataType.simpleString()

    def of_pair(pair, a, b):
        return [(pair, [a[i] for i in c], [b[i] for i in c]) for c in chains(a, b)]

    def batch(rows):
        return pa.record_batch(
            [pa.array([r[0][0] for r in rows]), pa.array([r[0][1] for r in rows]), pa.array([r[1] for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.list_(pa.int32()))],
            ["_doc", "_first", "_a", "_b"],
        )

    def run(batches):
        pair, a, b, out = None, [], [], []
        for part in batches:
            for d, f, x, y in zip(*[c.to_pylist() for c in part.columns]):
                if (d, f) != pair:
                    if a:
                        out += of_pair(pair, a, b)
                        if len(out) >= 5000:
                            yield batch(out)
                            out = []
                    pair, a, b = (d, f), [], []
                a.append(x)
                b.append(y)
        if a:
            out += of_pair(pair, a, b)
        if out:
            yield batch(out)

    return links.mapInArrow(run, f"_doc {kind}, _first {kind}, _a array<int>, _b array<int>")


def _grown(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """How many leading words of both to add (where the score, +1 for equal and -2 for different words, is greatest), and how many are equal."""
    n = min(len(x), len(y), REACH)
    if not n:
        return 0, 0
    same = x[:n] == y[:n]
    score = np.cumsum(np.where(same, 1, -2))
    low = np.flatnonzero(np.maximum.accumulate(np.maximum(score, 0)) - score > DROP)
    if len(low):
        score = score[: low[0]]
    best = int(score.argmax()) if len(score) else 0
    return (best + 1, int(same[: best + 1].sum())) if len(score) and score[best] > 0 else (0, 0)


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the longest common subsequence of two short stretches between seeds."""
    if len(x) == len(y):
        direct = int((x == y).sum())
        if direct >= len(x) - 1 or len(x) > 400:
            return direct
    row = np.zeros(len(y) + 1, dtype=np.int64)
    for w in x:
        step = row.copy()
        step[1:] = np.maximum(row[1:], row[:-1] + (y == w))
        row = np.maximum.accumulate(step)
    return int(row[-1])


def align(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[int, int, int, int, int]:
    """(start, end, other start, other end, equal words) of the alignment along the links (a[i], b[i]) of texts ``x``, ``y``."""
    equal, p, q = 0, a[0], b[0]
    for s, t in zip(a, b):
        if s >= p and t >= q:
            if s > p and t > q:
                equal += _common(x[p:s], y[q:t])
            equal += K
            p, q = s + K, t + K
        elif s - p == t - q:  # overlapping seeds in step
            equal += max(0, s + K - p)
            p, q = max(p, s + K), max(q, t + K)
    left, more = _grown(x[: a[0]][::-1][:REACH], y[: b[0]][::-1][:REACH])
    right, most = _grown(x[p : p + REACH], y[q : q + REACH])
    return a[0] - left, p + right, b[0] - left, q + right, equal + more + most


def alignments(a: list[int], b: list[int], x: np.ndarray, y: np.ndarray, least_words: int, similarity: float) -> list[tuple[int, int, int, int, int, float]]:
    """Long and similar enough alignments of a chain: as a whole, or else of its parts between wide gaps, then less wide ones."""
    found, todo = [], [(a, b, 0)]
    while todo:
        a, b, level = todo.pop()
        s, e, t, f, equal = align(a, b, x, y)
        n = max(e - s, f - t)
        if n >= least_words and equal >= similarity * n:
            found.append((s, e, t, f, n, equal / n))
        elif n >= least_words and level < len(CUTS):
            cuts = [0, *[i for i in range(1, len(a)) if max(a[i] - a[i - 1], b[i] - b[i - 1]) - K > CUTS[level]], len(a)]
            todo += [(a[i:j], b[i:j], level + 1) for i, j in zip(cuts, cuts[1:])]
    return found


def grown_ends(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_grown`` of many ends at once: of row i, the first n[i] words of ``x`` and ``y`` count."""
    if not x.shape[1]:
        return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    score = np.cumsum(np.where(x == y, np.int16(1), np.int16(-2)), axis=1, dtype=np.int16)
    over = np.maximum.accumulate(np.maximum(score, 0), axis=1) - score > DROP
    over |= np.arange(x.shape[1]) >= n[:, None]
    score[np.logical_or.accumulate(over, axis=1)] = -1
    best = score.argmax(axis=1)
    top = score[np.arange(len(best)), best].astype(np.int64)
    words = np.where(top > 0, best + 1, 0)
    return words, np.where(top > 0, (2 * words + top) // 3, 0)  # the score is 3 for each equal word less 2 for each word


def _ends(values: np.ndarray, low: np.ndarray, high: np.ndarray, at: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """The words from place ``at`` on, in steps of 1 or -1 and up to REACH of them, of texts values[low:high]; and how many there are."""
    there = np.clip(high - at if step > 0 else at - low + 1, 0, REACH)
    places = np.clip(at[:, None] + step * np.arange(REACH), 0, max(len(values) - 1, 0))
    return (values[places] if len(values) else np.zeros(places.shape, values.dtype)), there


def single_alignments(a: np.ndarray, b: np.ndarray, x: pa.Array, y: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words to the left, words to the right, equal words) of the alignments of chains that have one link, (a[i], b[i]) of texts x[i], y[i]."""
    sides = []
    for lists, at in ((x, a), (y, b)):
        offsets, values = lists.offsets.to_numpy().astype(np.int64), np.asarray(lists.values)
        low, high = offsets[:-1], offsets[1:]
        sides.append((_ends(values, low, high, low + at - 1, -1), _ends(values, low, high, low + at + K, 1)))
    (left, right), (other_left, other_right) = sides
    before, more = grown_ends(left[0], other_left[0], np.minimum(left[1], other_left[1]))
    after, most = grown_ends(right[0], other_right[0], np.minimum(right[1], other_right[1]))
    return before, after, K + more + most


def passages(docs: DataFrame, doc: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, other_id, start, end, other_start, other_end, n_words, similarity): passages in word positions, end excluded.

    ``other_id`` is the first document (by id) that has the passage's seeds; where that one shares no passage, the smaller id of two that
    do. ``n_words`` is the longer side, and
    ``similarity`` the share of it that is equal in order. Rows that share an id count as separate texts of that id and are
    not compared with each other; rows with a null id, text or fewer than K words take no part. An empty table gives an
    empty result.
    """
    table = written(prepared(docs.select(F.col(doc).alias("_doc"), F.col(text).cast("string").alias("_text")).where("_doc IS NOT NULL AND _text IS NOT NULL")).withColumn("_row", F.monotonically_increasing_id()))
    seeds = table.select("_doc", "_row", F.explode(F.arrays_zip("_seeds", "_at")).alias("_s")).select("_doc", F.col("_s._seeds").alias("_seed"), "_row", F.col("_s._at").alias("_at"))
    words = table.select("_row", F.col("_doc").alias("_id"), "_words")
    known = written(_shared(seeds))
    found = written(_met(_to_first(known), words, least_words, similarity))
    state = written(_settled(known, found, 1))
    # the first document of a seed may hold only a part, or a poor copy, of what others share: places of the seed that it left open
    # meet the first of themselves, then all others
    open_ = written(_shared(_run_starts(state.where("_class = 0").drop("_first", "_class"))))
    more = written(_met(_not_in(_to_first(open_), found), words, least_words, similarity))
    found = found.unionByName(more)
    second = _settled(open_, more, 2).where("_class = 2").select("_seed", "_row", "_at", F.col("_class").alias("_second"))
    state = written(state.join(second, ["_seed", "_row", "_at"], "left").withColumn("_class", F.coalesce("_second", "_class")).drop("_second"))
    rest = _met(_not_in(written(_all_links(state, words, least_words, similarity)), found), words, least_words, similarity)
    return found.unionByName(rest).drop("_doc", "_to")


def _shared(seeds: DataFrame) -> DataFrame:
    """The (_doc, _seed, _row, _at) rows of seeds that several documents have, with the first of them."""
    shared = seeds.groupBy("_seed").agg(F.min("_doc").alias("_first"), F.max("_doc").alias("_last")).where("_first < _last").select("_seed", "_first")
    return seeds.join(shared, "_seed")


def _firsts(known: DataFrame) -> DataFrame:
    """(_seed, _to, _b): the first place of each seed in its first document."""
    origin = known.where("_doc = _first").groupBy("_seed").agg(F.min(F.struct("_row", "_at")).alias("_o"))
    return origin.select("_seed", F.col("_o._row").alias("_to"), F.col("_o._at").alias("_b"))


def _to_first(known: DataFrame) -> DataFrame:
    """Links (_row, _to, _a, _b) of all places of a seed to the first."""
    return known.where("_doc <> _first").join(_firsts(known), "_seed").select("_row", "_to", F.col("_at").alias("_a"), "_b")


def _run_starts(places: DataFrame) -> DataFrame:
    """A run of one pattern has the seed at each repeat: the first place stands for those that touch it."""
    before = F.lag("_at").over(Window.partitionBy("_seed", "_row").orderBy("_at"))  # places in one document
    return places.withColumn("_before", before).where(f"_before IS NULL OR _at - _before > {K}").drop("_before")


def _spans(found: DataFrame) -> DataFrame:
    """The passages of each pair of rows; no more than their texts hold."""
    return found.groupBy(F.col("_doc").alias("_row"), "_to").agg(F.collect_list(F.struct("start", "end", "other_start", "other_end")).alias("_spans"))


def _settled(known: DataFrame, found: DataFrame, number: int) -> DataFrame:
    """``known`` with ``_class``: ``number`` for the first place of a seed and those that share a passage around it with the first, else 0."""
    own = (F.col("_row") == F.col("_to")) & (F.col("_at") == F.col("_b"))
    shares = F.exists("_spans", lambda p: (p["start"] <= F.col("_at")) & (F.col("_at") + K <= p["end"]))
    rows = known.join(_firsts(known), "_seed").join(_spans(found), ["_row", "_to"], "left")
    return rows.withColumn("_class", F.when(own | F.coalesce(shares, F.lit(False)), number).otherwise(0)).drop("_to", "_b", "_spans")


def _not_in(links: DataFrame, found: DataFrame) -> DataFrame:
    """``links`` that lie in no passage found for their rows."""
    inside = F.exists("_spans", lambda p: (p["start"] <= F.col("_a")) & (F.col("_a") + K <= p["end"]) & (p["other_start"] <= F.col("_b")) & (F.col("_b") + K <= p["other_end"]))
    return links.join(_spans(found), ["_row", "_to"], "left").where(~F.coalesce(inside, F.lit(False))).drop("_spans")


def signatures(words: pa.Array, at: np.ndarray) -> np.ndarray:
    """Bits, a row for each of the lists ``words``, of the pairs of neighbouring words outside the seed at ``at``; a pair that comes again
    has another bit each time."""
    offsets, values = words.offsets.to_numpy().astype(np.int64), np.asarray(words.values).view(np.uint16).astype(np.uint64)
    bits = np.zeros((len(at), SIGNATURE), dtype=np.uint8)
    if len(values) > 1:
        first = np.arange(offsets[0], offsets[-1] - 1)
        row = np.searchsorted(offsets, first, side="right") - 1
        inside = first - offsets[row] - at[row]
        first = first[(first + 1 < offsets[row + 1]) & ((inside < 0) | (inside >= K - 1))]
        row = np.searchsorted(offsets, first, side="right") - 1
        pair = (values[first] << np.uint64(16)) | values[first + 1]
        order = np.lexsort((pair, row))
        row, pair = row[order], pair[order]
        place = np.arange(len(pair))
        new = np.ones(len(pair), dtype=bool)
        new[1:] = (pair[1:] != pair[:-1]) | (row[1:] != row[:-1])
        again = place - np.maximum.accumulate(np.where(new, place, 0))
        bits[row, (mix(pair + (again.astype(np.uint64) << np.uint64(32))) % np.uint64(SIGNATURE)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1)


def alike(bits: np.ndarray, least: int):
    """(i, j) in pieces: the pairs i < j of rows of bits (as ``signatures`` packs them) that have ``least`` bits in common. Bits that many rows have
    are compared as words; a row meets the others that have one of its rare bits through the list of them."""
    n = len(bits)
    flat = np.unpackbits(bits, axis=1)
    usual = np.sort(np.argsort(-flat.sum(axis=0, dtype=np.int64), kind="stable")[:USUAL])
    dense = np.ascontiguousarray(np.packbits(flat[:, usual], axis=1)).view(np.uint64)
    flat[:, usual] = 0
    row, column = np.nonzero(flat)
    del flat
    holders = np.argsort(column, kind="stable")
    begin = np.concatenate(([0], np.cumsum(np.bincount(column, minlength=SIGNATURE))))
    place = np.empty(len(column), dtype=np.int64)
    place[holders] = np.arange(len(column))
    rest = begin[column + 1] - place - 1  # holders of the bit that come after the row itself
    ends = np.searchsorted(row, np.arange(n + 1))
    for a in range(0, n - 1, STRIP):
        b = min(a + STRIP, n)
        wide = n - a
        entry = np.arange(ends[a], ends[b])
        times = rest[entry]
        total = int(times.sum())
        other = np.arange(total) + np.repeat(place[entry] + 1 - (np.cumsum(times) - times), times)
        common = np.bincount(np.repeat((row[entry] - a) * wide, times) + row[holders[other]] - a, minlength=(b - a) * wide).reshape(b - a, wide)
        for w in range(dense.shape[1]):
            common += np.bitwise_count(dense[a:b, w, None] & dense[None, a:, w])
        i, j = np.nonzero(common >= least)
        later = j > i
        yield i[later] + a, j[later] + a


def least_common(least_words: int, similarity: float) -> int:
    """Bits that two signatures must share. A word that differs breaks two pairs of words at most, so passages of ``least_words`` share all but
    twice as many outside the seed. A quarter less is asked for, as a longer passage may differ most near this seed."""
    return max(0, (least_words - 1 - 2 * int((1 - similarity) * least_words + 1e-9) - (K - 1)) * 3 // 4)


def _all_links(state: DataFrame, words: DataFrame, least_words: int, similarity: float) -> DataFrame:
    """Links (_row, _to, _a, _b) of places of one seed in different documents that no common first place has settled, if their
    surroundings are alike. Places with equal surroundings are linked to the first of them, which is compared for all."""
    kind = state.schema["_doc"].dataType.simpleString()
    several = state.groupBy("_seed").agg(F.count_if(F.col("_class") == 0).alias("_open"), F.count("*").alias("_n")).where("_open > 0 AND _n > 2").select("_seed")
    around = _run_starts(state.join(several, "_seed")).join(words.select("_row", "_words"), "_row").withColumn("_from", F.greatest(F.col("_at") - REACH, F.lit(0)))
    around = around.select("_doc", "_seed", "_row", "_at", "_class", F.expr(f"slice(_words, _from + 1, _at + {K + REACH} - _from)").alias("_x"), (F.col("_at") - F.col("_from")).alias("_in"))
    around = around.withColumn("_same", F.xxhash64("_x", "_in"))

    def sign(batches):
        for part in pieces(batches, 1 << 20):
            bits = [row.tobytes() for i in range(0, part.num_rows, ROWS) for row in signatures(part.column(5)[i : i + ROWS], part.column(6)[i : i + ROWS].to_numpy())]
            yield pa.record_batch([*part.columns[:5], part.column(7), pa.array(bits, pa.binary())], ["_doc", "_seed", "_row", "_at", "_class", "_same", "_bits"])

    signed = written(around.mapInArrow(sign, f"_doc {kind}, _seed long, _row long, _at int, _class int, _same long, _bits binary"))
    one = signed.groupBy("_seed", "_same", "_class").agg(F.min(F.struct("_doc", "_row", "_at")).alias("_o"))
    copies = signed.where("_class = 0").drop("_bits").join(one, ["_seed", "_same", "_class"]).where("_doc <> _o._doc")
    copies = copies.select("_row", F.col("_o._row").alias("_to"), F.col("_at").alias("_a"), F.col("_o._at").alias("_b"))
    one = one.select("_seed", F.col("_o._row").alias("_row"), F.col("_o._at").alias("_at"))
    # an exact way for seeds at any number of places: blocks of them, in pairs
    blocks = one.groupBy("_seed").agg(F.ceil(F.count("*") / BLOCK).alias("_blocks"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    rows = signed.join(one, ["_seed", "_row", "_at"]).join(blocks, "_seed").withColumn("_own", F.pmod(F.xxhash64("_row", "_at"), F.col("_blocks")))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    rows = rows.select("_seed", F.least("_own", "_other").alias("_lo"), F.greatest("_own", "_other").alias("_hi"), "_own", "_class", "_doc", "_row", "_at", "_bits")
    rows = rows.repartition("_seed", "_lo", "_hi").sortWithinPartitions("_seed", "_lo", "_hi")
    least = least_common(least_words, similarity)

    def compared(group: pa.Table):
        lo, hi = group["_lo"][0].as_py(), group["_hi"][0].as_py()
        bits = np.frombuffer(b"".join(group["_bits"].to_pylist()), np.uint8).reshape(group.num_rows, -1)
        own, number = group["_own"].to_numpy(), group["_class"].to_numpy()
        doc = group["_doc"].combine_chunks().dictionary_encode().indices.to_numpy()
        for one, two in alike(bits, least):
            meet = ((number[one] != number[two]) | (number[one] == 0)) & (doc[one] != doc[two])
            if lo < hi:
                meet &= own[one] != own[two]
            if meet.any():
                yield group, one[meet], two[meet]

    def pair(batches):
        names = ["_doc", "_row", "_at"]

        def out(found):
            for group, one, two in found:
                sides = [group.select(names).take(pa.array(at)) for at in (one, two)]
                both = pa.table([c for side in sides for c in side.columns], [f"{n}{i}" for i in (1, 2) for n in names])
                yield from both.combine_chunks().to_batches()

        held = None
        for part in batches:
            held = pa.concat_tables([held, pa.Table.from_batches([part])]) if held is not None else pa.Table.from_batches([part])
            keys = [held[c].to_numpy() for c in ("_seed", "_lo", "_hi")]
            cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            for a, b in zip([0, *cuts], cuts):
                if b - a > 1:
                    yield from out(compared(held.slice(a, b - a)))
            held = held.slice(cuts[-1]) if len(cuts) else held  # the last group may go on
        if held is not None and held.num_rows > 1:
            yield from out(compared(held))

    met = rows.mapInArrow(pair, f"_doc1 {kind}, _row1 long, _at1 int, _doc2 {kind}, _row2 long, _at2 int").where("_doc1 <> _doc2")
    later = F.col("_doc1") > F.col("_doc2")
    links = met.select(*[F.when(later, F.col(f"{n}{i}")).otherwise(F.col(f"{n}{3 - i}")).alias(c) for n, i, c in (("_row", 1, "_row"), ("_row", 2, "_to"), ("_at", 1, "_a"), ("_at", 2, "_b"))])
    return copies.unionByName(links).distinct()


def _met(links: DataFrame, words: DataFrame, least_words: int, similarity: float) -> DataFrame:
    """Passages along links (_row, _to, _a, _b), with the rows of both (_doc, _to)."""
    links = links.repartition("_row", "_to").sortWithinPartitions("_row", "_to", "_a", "_b")
    found = _chained(links.select(F.col("_row").alias("_doc"), F.col("_to").alias("_first"), "_a", "_b"))
    # a stretch may hold one seed only, and an alignment grows at most REACH words at either end
    span = F.greatest(F.element_at("_a", -1) - F.element_at("_a", 1), F.element_at("_b", -1) - F.element_at("_b", 1)) + K
    found = written(found.where(span + 2 * REACH >= least_words))
    one = found.join(words.select(F.col("_row").alias("_doc"), F.col("_id").alias("doc_id"), F.col("_words").alias("_x")), "_doc")
    one = one.withColumn("_x0", F.greatest(F.element_at("_a", 1) - REACH, F.lit(0))).withColumn("_x", F.expr(f"slice(_x, _x0 + 1, element_at(_a, -1) + {K + REACH} - _x0)"))
    both = one.join(words.select(F.col("_row").alias("_first"), F.col("_id").alias("other_id"), F.col("_words").alias("_y")), "_first")
    both = both.withColumn("_y0", F.greatest(F.element_at("_b", 1) - REACH, F.lit(0))).withColumn("_y", F.expr(f"slice(_y, _y0 + 1, element_at(_b, -1) + {K + REACH} - _y0)"))
    kind = words.schema["_id"].dataType.simpleString()

    def run(batches):
        for part in pieces(batches, 2 << 20):
            rows = []
            x, y, a, b = [part.column(i) for i in (2, 3, 4, 5)]
            x0, y0 = part.column(6).to_numpy(), part.column(7).to_numpy()
            links = np.diff(a.offsets.to_numpy())
            for start in range(0, part.num_rows, ROWS):
                # nearly all chains have one link: their ends grow together
                one = start + np.flatnonzero(links[start : start + ROWS] == 1)
                take = pa.array(one)
                p, q = (np.asarray(c.take(take).flatten()) - o[one] for c, o in ((a, x0), (b, y0)))
                left, right, equal = single_alignments(p, q, x.take(take), y.take(take))
                n = left + K + right
                for k in np.flatnonzero((n >= least_words) & (equal >= similarity * n)).tolist():
                    i, s, t, words = int(one[k]), int(p[k] - left[k]), int(q[k] - left[k]), int(n[k])
                    s, t = s + int(x0[i]), t + int(y0[i])
                    rows.append((i, s, s + words, t, t + words, words, int(equal[k]) / words))
            for i in np.flatnonzero(links > 1).tolist():
                xs, ys = np.asarray(x[i].values), np.asarray(y[i].values)
                u, v = int(x0[i]), int(y0[i])
                for s, e, t, f, n, share in alignments((np.asarray(a[i].values) - u).tolist(), (np.asarray(b[i].values) - v).tolist(), xs, ys, least_words, similarity):
                    rows.append((i, s + u, e + u, t + v, f + v, n, share))
            if rows:
                at, *columns = zip(*rows)
                at = pa.array(at)
                yield pa.record_batch(
                    [*[part.column(c).take(at) for c in (0, 1)], *[pa.array(c, pa.int32()) for c in columns[:5]], pa.array(columns[5], pa.float64()), *[part.column(c).take(at) for c in (8, 9)]],
                    ["doc_id", "other_id", "start", "end", "other_start", "other_end", "n_words", "similarity", "_doc", "_to"],
                )

    rows = both.select("doc_id", "other_id", "_x", "_y", "_a", "_b", "_x0", "_y0", "_doc", F.col("_first").alias("_to"))
    return rows.mapInArrow(run, f"doc_id {kind}, other_id {kind}, start int, end int, other_start int, other_end int, n_words int, similarity double, _doc long, _to long")


def op10_shared_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
