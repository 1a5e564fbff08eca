"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question that was re-used with other parameters keeps its
template. Windows of the templates are hashed. A task looks its documents' windows up in the sorted hashes of the
benchmark and passes on those that occur; they meet the benchmark's windows in a hash join. Matches of one document and
item at one displacement form an alignment. It counts if it covers enough of the item and its slots are consistent:
each value of the item stands for one value of the document throughout, and no two for the same.

Texts are cut in three ways, and the best alignment of any counts: into words; with runs of placeholders as one, so a value
may have another number of words; and without placeholders and case, by characters where a script has no blanks, so
verbatim copies of items that are dense in numbers or names, and copies in other case, are found.
"""

from __future__ import annotations

import re
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.rows import packed, unpacked
from feedloom.llm.scratch import small_batches
from feedloom.llm.words import LENGTH, mix, power_tables, text_bytes, windows, word_hash, words_in
from feedloom.operators.stages import written

WINDOW = 5
LEAST_LITERALS = 3  # words in a window that are no placeholders
COVERAGE = 0.6  # part of the item's words that one alignment has to cover
MOST_TOKENS = 1 << 16  # different odd tokens that a worker remembers
NEAR = 8  # displacements that align together
BLOCK = 2_000_000  # window hashes of the benchmark that one pass over the documents carries (16 MB)

# Fixed values.
UNITS = frozenset(
    """mm cm dm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz gram grams kilogram kilograms ton tons
    pound pounds ounce ounces ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours
    day days week weeks month months year years k c f degree degrees w kw kwh mw v a ma ohm hz khz mhz ghz b kb mb gb tb n j kj cal kcal
    pa kpa bar mph kmh kph percent usd eur gbp dollar dollars euro euros cent cents""".split()
)
_FIRST = frozenset("+-$€£¥")
_EDGE = " .,;:!?\"'`()[]{}<>«»„“”‘’…*#&|~^_=+/\\-–—"
_NUMBER = re.compile(r"[+-]?[$€£¥]?\d[\d.,:/]*%?")
_MEASURE = re.compile(r"[+-]?[$€£¥]?\d[\d.,]*([^\W\d]+|°[^\W\d]?)")
NUMBER, UNIT, NAME, MEASURE, LITERAL = 1, 2, 3, 4, 16
TEMPLATE, RUNS, VERBATIM = 0, 1, 2  # ways to cut a text into units
_CHARS = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"  # written without blanks
_UNSPACED = re.compile(f"[{_CHARS}]")
_UNIT = re.compile(f"[{_CHARS}]|[^\\W{_CHARS}]+")


def _literal(word: str) -> int:
    """The hash of a word, as ``words_in`` would give it."""
    return max(LITERAL, word_hash(word.encode("utf-8", "replace")))


def token_id(token: str) -> int:
    """0 for bare punctuation, the kind of placeholder, or a 64-bit hash for a literal word."""
    bare = token.strip(_EDGE)
    if not bare:
        return 0
    if bare[0] in _FIRST or bare[0].isdigit():
        if _NUMBER.fullmatch(bare):
            return NUMBER
        m = _MEASURE.fullmatch(bare)
        if m and (m[1].lower() in UNITS or m[1][0] == "°"):
            return MEASURE
    if bare[0].isupper():
        return NAME
    low = bare.lower()
    if low in UNITS and len(low) > 1:
        return UNIT
    return _literal(low)


class _Vocabulary(dict):
    """Remembers (id, hash) of tokens: the hash of a token as it stands but for case and edges, 0 if it has to be cut into characters."""

    def __missing__(self, token: str) -> tuple[int, int]:
        if len(self) > MOST_TOKENS:
            self.clear()
        code = token_id(token)
        if not token.isascii() and _UNSPACED.search(token):
            plain = 0
        else:  # that of a literal is its id
            plain = code if code >= LITERAL else _literal(token.strip(_EDGE).lower())
        self[token] = code, plain
        return code, plain


_vocabulary = _Vocabulary()  # a worker's tasks share what it has seen
_IS_EDGE, _SPLITS, _IS_FIRST = (np.isin(np.arange(256), list(x)) for x in (_EDGE.encode("ascii", "ignore"), b"\x1c\x1d\x1e\x1f", b"0123456789$"))
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def _stripped(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words without the edges that are ASCII."""
    s, e = s.copy(), e.copy()
    live = np.arange(len(s))
    while len(live := live[(s[live] < e[live]) & _IS_EDGE[data[np.minimum(s[live], len(data) - 1)]]]):
        s[live] += 1
    live = np.arange(len(s))
    while len(live := live[(s[live] < e[live]) & _IS_EDGE[data[e[live] - 1]]]):
        e[live] -= 1
    return s, e


class _Batch:
    """The words of a batch of texts (punctuation left out), cut into units in three ways. ``units(mode)`` gives the codes of the units,
    the word each starts at, and the offsets of the texts. TEMPLATE: words. RUNS: the same with runs of names, of numbers, and
    of a number with its unit as one. VERBATIM: words as they stand, and characters of scripts without blanks.

    Words of ASCII and Latin-1 letters are told from their bytes, many at once; numbers and all other words one by one.
    """

    def __init__(self, texts: pa.Array):
        data, offsets = text_bytes(texts)
        found = words_in(data, offsets)
        self.data, n = data, len(found.start)
        codes, plain, slow = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, bool)
        for i in range(0, n, 1 << 17):
            part = slice(i, min(i + (1 << 17), n))
            codes[part], plain[part], slow[part] = self._read(data, found.start[part], found.end[part])
        start, end, owner = found.start, found.end, None
        self.odd: dict[int, str] = {}
        if slow.any():
            places = np.flatnonzero(slow)
            # such a word may hold blanks of other kinds
            tokens = [bytes(data[a:b]).decode("utf-8", "replace").split() for a, b in zip(start[places].tolist(), end[places].tolist())]
            count = np.ones(n, np.int64)
            count[places] = [len(t) for t in tokens]
            owner = np.repeat(np.arange(n), count)
            codes, plain, odd = codes[owner], plain[owner], np.flatnonzero(slow[owner])
            flat = list(chain.from_iterable(tokens))
            if flat:
                pairs = np.array([_vocabulary[t] for t in flat], dtype=np.uint64)
                codes[odd], plain[odd] = pairs[:, 0], pairs[:, 1]
            self.odd = dict(zip(odd.tolist(), flat))
        kept = np.flatnonzero(codes)
        bounds = found.bounds if owner is None else np.searchsorted(owner, found.bounds)
        self.kept, self.owner, self.start, self.end = kept, owner, start, end
        self.codes, self.hashes, self.bounds = codes[kept], plain[kept], np.searchsorted(kept, bounds)

    @staticmethod
    def _read(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, hashes, whether the word has to be looked at by itself) of words next to each other."""
        base, part = int(s[0]), data[s[0] : e[-1]]
        s, e = s - base, e - base
        n = len(part)
        low, lead = _LOW[part], np.flatnonzero(part[:-1] == 0xC3)
        second = part[lead + 1]
        lead = lead[(second >= 0x80) & (second <= 0xBF)]
        capital = lead[(part[lead + 1] <= 0x9E) & (part[lead + 1] != 0x97)]
        low[capital + 1] += 0x20
        other = (part >= 0x80) | _SPLITS[part]
        other[lead] = other[lead + 1] = False
        many = np.concatenate(([0], np.cumsum(other)))
        a, b = _stripped(part, s, e)
        filled = b > a
        first = part[np.minimum(a, n - 1)]
        slow = (many[e] > many[s]) | filled & _IS_FIRST[first]
        up, down = power_tables(n + 1)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        h = np.maximum(mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64) * LENGTH), np.uint64(LITERAL))
        starts_high = np.zeros(n, dtype=bool)
        starts_high[capital] = True
        name = (first >= 65) & (first <= 90) | starts_high[np.minimum(a, n - 1)]
        codes = np.where(name, np.uint64(NAME), h)
        codes[_unit_hashes().among(codes)] = UNIT
        codes[~filled] = 0
        return codes, h, slow

    def word(self, i: int) -> str:
        at = int(self.kept[i])
        if at in self.odd:
            return self.odd[at]
        at = at if self.owner is None else self.owner[at]
        return bytes(self.data[self.start[at] : self.end[at]]).decode("utf-8", "replace")

    def units(self, mode: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(self.codes)
        if mode == TEMPLATE:
            return self.codes, np.arange(n + 1), self.bounds
        if mode == RUNS:
            c, first = self.codes, np.zeros(n + 1, dtype=bool)
            first[self.bounds] = True
            one, two = c[:-1], c[1:]
            same = (one == two) & ((one == NAME) | (one == NUMBER)) | (one == NUMBER) & (two == UNIT)
            starts = np.flatnonzero(first[:-1] | np.concatenate(([True], ~same))[:n]) if n else np.zeros(0, np.int64)
            last = c[np.append(starts[1:], n) - 1] if n else c
            codes = np.where((c[starts] == NUMBER) & (last == UNIT), np.uint64(MEASURE), c[starts])
            return codes, np.append(starts, n), np.searchsorted(starts, self.bounds)
        cut = np.flatnonzero(self.hashes == 0)
        if not len(cut):
            return self.hashes, np.arange(n + 1), self.bounds
        parts = [[_literal(u.lower()) for u in _UNIT.findall(self.word(i))] for i in cut.tolist()]
        count = np.ones(n, dtype=np.int64)
        count[cut] = [len(p) for p in parts]
        starts = np.repeat(np.arange(n), count)
        codes = self.hashes[starts]
        codes[self.hashes[starts] == 0] = np.array(list(chain.from_iterable(parts)), dtype=np.uint64)
        return codes, np.append(starts, n), np.searchsorted(starts, self.bounds)


class Wanted:
    """Hashes to look for: a bitmap over their low bits turns most others away before the sorted hashes are searched."""

    def __init__(self, hashes: np.ndarray):
        self.hashes, self.bitmap = np.sort(hashes), np.zeros(1 << 22, dtype=bool)
        self.bitmap[hashes & np.uint64((1 << 22) - 1)] = True

    def among(self, h: np.ndarray) -> np.ndarray:
        """Places of ``h`` whose hash is wanted."""
        at = np.flatnonzero(self.bitmap[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
        if not len(at):
            return at
        place = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        return at[self.hashes[place] == h[at]]


@cache
def _unit_hashes() -> Wanted:
    return Wanted(np.array([_literal(u) for u in UNITS if len(u) > 1], dtype=np.uint64))


def _slot(kind: int, words: list[str]) -> str:
    return f"{kind}{('' if kind == MEASURE else ' ').join(w.strip(_EDGE) for w in words)}"


def _matches(batch: _Batch, mode: int, sizes, wanted: Wanted | None, item_sizes: bool):
    """(text number, position, window size, hash, slots, number of words, values, first word, end) of windows of the texts'
    units. ``wanted``: hashes to pass on, all if None. ``item_sizes``: a text shorter than the window is one window, and
    slots are the numbers of their values among the text's different ones, which come with its first window.
    """
    out = ([], [], [], [], [], [], [], [], [])
    numbers: dict[int, dict[str, int]] = {}
    code, starts, bounds = batch.units(mode)
    literal = np.concatenate(([0], np.cumsum(code >= LITERAL)))
    for size in sizes:
        h, at = windows(code, bounds, size)
        if not len(h):
            continue
        h = h ^ np.uint64(size + 16 * mode)
        if wanted is not None:
            hit = wanted.among(h)
            at, h = at[hit], h[hit]
        good = literal[at + size] - literal[at] >= LEAST_LITERALS
        at, h = at[good], h[good]
        text = np.searchsorted(bounds, at, side="right") - 1
        if item_sizes:
            n = np.diff(bounds)[text]
            own = (n == size) | ((size == WINDOW) & (n > WINDOW))
            at, h, text = at[own], h[own], text[own]
        for a, x, i in zip(at.tolist(), h.view(np.int64).tolist(), text.tolist()):
            base, word = int(bounds[i]), int(batch.bounds[i])
            n_units = int(bounds[i + 1]) - base

            def slots_of(lo, hi):
                return [_slot(int(code[j]), [batch.word(w) for w in range(starts[j], starts[j + 1])]) for j in range(lo, hi) if code[j] < LITERAL]

            slots = slots_of(a, a + size)
            values = None
            if item_sizes:
                if i not in numbers:
                    values = list(dict.fromkeys(slots_of(base, base + n_units)))
                    numbers[i] = {v: n for n, v in enumerate(values)}
                slots = [str(numbers[i][v]) for v in slots]
            # in scripts without blanks the measure is characters, else words
            by_unit = mode == VERBATIM
            first, end = int(starts[a]) - word, (int(starts[a + size]) if a + size < base + n_units else int(batch.bounds[i + 1])) - word
            row = (i, a - base, size, x, slots, n_units if by_unit else int(batch.bounds[i + 1]) - word, values)
            span = (a - base, a - base + size) if by_unit and item_sizes else (first, end)
            for column, value in zip(out, (*row, *span)):
                column.append(value)
    return out


_SCHEMA = "_mode int, _at int, _size int, _hash long, _slots array<string>, _words int, _own array<string>, _from int, _end int"


def _windows_of(rows: DataFrame, sizes, wanted, item_sizes: bool) -> DataFrame:
    """Template windows of (_id, _text) rows."""
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            step = max(1, int(batch.num_rows * (1 << 21) // max(batch.nbytes, 1)))
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                cut = _Batch(part.column(1))
                for mode in (TEMPLATE, RUNS, VERBATIM):
                    text, at, size, h, slots, words, own, start, end = _matches(cut, mode, sizes, wanted.value if wanted is not None else None, item_sizes)
                    if text:
                        columns = [pa.array([mode] * len(text), pa.int32()), pa.array(at, pa.int32()), pa.array(size, pa.int32()), pa.array(h, pa.int64()), pa.array(slots, pa.list_(pa.string())), pa.array(words, pa.int32()), pa.array(own, pa.list_(pa.string())), pa.array(start, pa.int32()), pa.array(end, pa.int32())]
                        yield pa.record_batch([part.column(0).take(pa.array(text)), *columns], ["_id", "_mode", "_at", "_size", "_hash", "_slots", "_words", "_own", "_from", "_end"])

    return rows.mapInArrow(run, f"_id {kind}, {_SCHEMA}")


def contaminated(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", repeats: bool = False) -> DataFrame:
    """(doc_id, item_id, coverage, at, changed): documents that contain a benchmark item, one row per pair.

    ``coverage`` is the part of the item's words in the best consistent alignment, ``at`` the document word it starts at,
    ``changed`` the number of slot values that differ. Items with fewer than three words (literal ones, unless the copy is verbatim), and
    null or empty texts, match nothing. A copy may have words more or less than the item in places, as long as its displacements stay within
    ``NEAR`` of each other. Items of one template are compared once and each named; of items with equal texts the one with the
    smallest id is named, or all with ``repeats``. Rows with a null document id are
    found under a null id. Coverage counts characters where verbatim text has no blanks. An empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    named = benchmark.select(F.col(item).alias("_id"), F.col(item_text).cast("string").alias("_text")).where("_text IS NOT NULL").distinct()
    items = named.groupBy("_text").agg(F.min("_id").alias("_id")).select(F.struct("_id", F.xxhash64("_text").alias("_t")).alias("_id"), "_text")
    known = written(_windows_of(items, range(1, WINDOW + 1), None, True))
    # items with equal windows and equal slots at equal places form a class; its first item stands for it
    form = known.groupBy("_id", "_mode").agg(F.sum(F.xxhash64("_at", "_size", "_hash", F.concat_ws(" ", "_slots"), "_words").cast("decimal(38,0)")).alias("_form"), F.count("*").alias("_n"), F.first("_own", ignorenulls=True).alias("_own"))
    first = form.groupBy("_mode", "_form", "_n").agg(F.min("_id").alias("_class"))
    members = written(form.join(first, ["_mode", "_form", "_n"]).select("_mode", "_class", F.col("_id").alias("_member"), "_own"))
    known = written(known.drop("_own").join(members.select("_mode", F.col("_class").alias("_id")).distinct(), ["_mode", "_id"], "left_semi"))
    sizes = sorted(r["_size"] for r in known.select("_size").distinct().collect())  # WINDOW values at most
    hashes = known.select("_hash").distinct()
    blocks = max(1, -(-hashes.count() // BLOCK))
    rows = docs.select(F.col(doc).alias("_id"), F.col(text).cast("string").alias("_text"))
    found = None
    for b in range(blocks):  # one block unless the benchmark has millions of windows
        block = hashes.where(F.pmod("_hash", F.lit(blocks)) == b).toArrow()["_hash"].to_numpy()
        wanted = spark.sparkContext.broadcast(Wanted(block.astype(np.int64).view(np.uint64)))
        part = _windows_of(rows, sizes, wanted, False)
        found = part if found is None else found.unionByName(part)
    found = found.select(F.col("_id").alias("_doc"), "_mode", F.col("_at").alias("_pos"), F.col("_from").alias("_start"), "_size", "_hash", F.col("_slots").alias("_values"))
    both = found.join(known, ["_mode", "_hash", "_size"])
    # a copy may have words more or less than the item: beside one exact displacement, those in a stretch of them align together, and
    # stretches overlap by half
    shift = F.col("_pos") - F.col("_at")
    near = F.array(F.struct(F.lit(0).alias("k"), shift.alias("s")), *[F.struct(F.lit(k).alias("k"), F.floor((shift + half) / NEAR).cast("int").alias("s")) for k, half in ((1, 0), (2, NEAR // 2))])
    both = both.withColumn("_shift", F.explode(near))
    both = both.select("_doc", "_mode", "_id", "_shift", "_pos", "_start", "_from", "_end", "_words", F.expr("zip_with(_slots, _values, (a, b) -> struct(a AS a, b AS b))").alias("_pairs"))
    # an alignment has at most NEAR times as many windows and slots as its item has words
    aligned = both.groupBy("_doc", "_mode", "_id", "_shift").agg(
        F.sort_array(F.collect_set(F.struct("_from", "_end", "_pos"))).alias("_at"),
        F.min("_start").alias("at"),
        F.array_distinct(F.flatten(F.collect_set("_pairs"))).alias("_pairs"),
        F.first("_words").alias("_words"),
    )
    # windows count in the order of both sides
    covered = F.expr("""aggregate(_at, struct(0 AS n, -1 AS e, -1 AS p), (s, w) -> if(w._pos < s.p, s, struct(
        s.n + greatest(0, w._end - greatest(s.e, w._from)) AS n, greatest(s.e, w._end) AS e, w._pos AS p))).n""")
    values = [F.size(F.array_distinct(F.col(f"_pairs.{f}"))) for f in ("a", "b")]
    aligned = aligned.select(
        "_doc", "_mode", "_id", "_shift", (covered / F.col("_words")).alias("coverage"), "at",
        "_pairs", ((F.size("_pairs") == values[0]) & (F.size("_pairs") == values[1])).alias("_consistent"), "_words",
    ).where(F.col("coverage") >= COVERAGE)
    each = aligned.join(members.withColumnRenamed("_class", "_id"), ["_mode", "_id"]).withColumn("changed", F.size(F.expr("filter(_pairs, p -> _own[int(p.a)] <> p.b)")))
    each = written(each.drop("_own", "_pairs"))
    # a copy with inconsistent slots also repeats the words between them, and does not count for those
    bad = each.where(~F.col("_consistent") & (F.col("_mode") == TEMPLATE) & (F.col("_shift.k") == 0)).select(F.col("_doc").alias("_doc2"), F.col("_member").alias("_member2"), F.col("coverage").alias("_more"), F.col("at").alias("_at2"))
    unfit = F.col("_doc").eqNullSafe(F.col("_doc2")) & (F.col("_member") == F.col("_member2")) & (F.col("_more") > F.col("coverage")) & (F.abs(F.col("at") - F.col("_at2")) < F.col("_words"))
    each = each.where("_consistent").join(bad, unfit & (F.col("_mode") == VERBATIM), "left_anti")
    best = each.groupBy("_doc", "_member").agg(F.min(F.struct((-F.col("coverage")).alias("c"), "changed", "at")).alias("_best"))
    best = best.select("_doc", F.col("_member._id").alias("_id"), F.col("_member._t").alias("_t"), "_best")
    if repeats:
        again = named.select(F.col("_id").alias("_each"), F.xxhash64("_text").alias("_t"))
        best = best.join(again, "_t").groupBy("_doc", F.col("_each").alias("_id")).agg(F.min("_best").alias("_best"))
    else:  # an id may have several texts
        best = best.groupBy("_doc", "_id").agg(F.min("_best").alias("_best"))
    return best.select(F.col("_doc").alias("doc_id"), F.col("_id").alias("item_id"), (-F.col("_best.c")).alias("coverage"), F.col("_best.at").alias("at"), F.col("_best.changed").alias("changed"))


def clean(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that contain a benchmark item. A row is known by its id and the hash of its text, so rows without an id
    are judged like others, and of rows that share an id only those with the item go."""
    key = F.struct(F.col(doc).alias("i"), F.xxhash64(F.col(text).cast("string")).alias("t"))
    with small_batches(docs.sparkSession):  # texts are read inside
        found = contaminated(docs.select(key.alias("_row"), F.col(text).alias("_body")), benchmark, "_row", "_body")
    bad = found.select(F.col("doc_id.i").alias("_i"), F.col("doc_id.t").alias("_t")).distinct()
    rows = packed(docs, key.alias("_key"))
    return unpacked(rows.join(bad, F.col("_key.i").eqNullSafe(F.col("_i")) & (F.col("_key.t") == F.col("_t")), "left_anti"))


def op3_benchmark_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), repeats=True)
