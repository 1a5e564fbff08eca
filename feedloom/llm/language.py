"""Language identification with interpolated Kneser-Ney models over characters, one per language.

A text is lowered, everything but letters becomes one blank, and each character is predicted from the three before it. The
highest order uses counts; lower orders use the number of different characters seen before a sequence. A model is a set
of sorted arrays of 64-bit hashes with the discounted probabilities and back-off weights of each order. The language
with the lowest cross-entropy per character wins; a temperature fitted on texts kept out of the counts turns the
differences into a probability, and texts whose cross-entropy is above nearly all of those texts are marked rejected.

Counts come from a bounded sample: about ``per_lang`` texts of each language, drawn by a hash of the id. So the models
have a bounded size and can be sent to every task. Every text is read whole; one above a million characters is scored
in stretches of that length.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.words import mix
from feedloom.operators.stages import written

ORDER = 4
PER_LANG = 3000
STRETCH = 1 << 20
REJECT_SHARE = 0.001  # part of held-back texts that the rejection limit may exclude
_letters: list[np.ndarray] = []


class Level(NamedTuple):
    """One order of one language: discounted probabilities of seen sequences, back-off weights of seen contexts."""

    keys: np.ndarray
    alpha: np.ndarray
    contexts: np.ndarray
    gamma: np.ndarray


class Models(NamedTuple):
    langs: list[str]
    levels: list[list[Level]]  # by language, then order from 1
    floor: list[float]  # by language: probability that order 1 shares out evenly
    keys: np.ndarray  # hashes of all sequences of the highest order that any language has
    logp: np.ndarray  # their log-probabilities, one row per language
    temperature: float
    limits: np.ndarray


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, letters lowered and all else one blank, and the text that each belongs to."""
    low = [(t or "").lower() for t in texts]
    all_codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    doc = np.repeat(np.arange(len(low)), np.array([len(t) for t in low], dtype=np.int64))
    letter = _is_letter()[all_codes]
    c = np.where(letter, all_codes, 32).astype(np.uint64)
    again = np.zeros(len(c), dtype=bool)
    again[1:] = ~letter[1:] & ~letter[:-1] & (doc[1:] == doc[:-1])
    return c[~again], doc[~again]


def grams(c: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Columns: the three characters before (blanks before a text), nearest last, and the character itself."""
    out = np.full((ORDER, len(c)), 32, dtype=np.uint64)
    out[ORDER - 1] = c
    for back in range(1, ORDER):
        same = doc[back:] == doc[:-back]
        out[ORDER - 1 - back, back:][same] = c[:-back][same]
    return out


def _key(g: np.ndarray) -> np.ndarray:
    """A hash of each column."""
    h = np.zeros(g.shape[1], dtype=np.uint64)
    for row in g:
        h = mix(h + row + np.uint64(0x9E3779B97F4A7C15))
    return h


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), default)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


def _level(g: np.ndarray, n: np.ndarray) -> Level:
    """Absolute discounting of the counts ``n`` of the different columns of ``g``."""
    once, twice = (n == 1).sum(), (n == 2).sum()
    discount = once / (once + 2 * twice) if once and once + 2 * twice > once else 0.5
    context = _key(g[:-1])
    contexts, at = np.unique(context, return_inverse=True)
    total = np.bincount(at, weights=n)
    types = np.bincount(at)
    keys = _key(g)
    order = np.argsort(keys)
    return Level(keys[order], ((n - discount) / total[at])[order], contexts, discount * types / total)


def _unique(g: np.ndarray) -> np.ndarray:
    _, first = np.unique(_key(g), return_index=True)
    return g[:, first]


def build(g: np.ndarray, n: np.ndarray) -> tuple[list[Level], float]:
    """All orders of one language from its different sequences and their counts."""
    levels = [_level(g, n)]
    for _ in range(ORDER - 1):
        shorter = g[1:]
        _, first, at = np.unique(_key(shorter), return_index=True, return_inverse=True)
        g, n = shorter[:, first], np.bincount(at).astype(float)  # how many different characters precede it
        levels.append(_level(g, n))
    return levels[::-1], 1.0 / (g.shape[1] + 1)


def probability(levels: list[Level], floor: float, g: np.ndarray) -> np.ndarray:
    """Interpolated probability of each column's last character after the others."""
    p = np.full(g.shape[1], floor)
    for order, level in enumerate(levels, 1):
        tail = g[ORDER - order :]
        p = _find(level.keys, level.alpha, _key(tail), 0.0) + _find(level.contexts, level.gamma, _key(tail[:-1]), 1.0) * p
    return p


def _loglik(models: Models, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihood of each text in each language, its number of characters, and whether it has a letter."""
    total = np.zeros((len(texts), len(models.langs)))
    size = np.zeros(len(texts), dtype=np.int64)
    letters = np.zeros(len(texts), dtype=bool)
    group: list[tuple[int, str]] = []
    held = 0

    def add() -> None:
        c, part = codes([t for _, t in group])
        if not len(c):
            return
        owner = np.array([i for i, _ in group])
        g = grams(c, part)
        key = _key(g)
        at = np.minimum(np.searchsorted(models.keys, key), len(models.keys) - 1)
        new = models.keys[at] != key
        starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        docs = owner[part[starts]]
        strange = _unique(g[:, new]) if new.any() else None
        if strange is not None:
            keys = _key(strange)
            order = np.argsort(keys)
            where = np.searchsorted(keys[order], key[new])
        for k in range(len(models.langs)):
            value = models.logp[k][at].astype(np.float64)
            if strange is not None:
                value[new] = np.log(probability(models.levels[k], models.floor[k], strange))[order][where]
            np.add.at(total[:, k], docs, np.add.reduceat(value, starts))
        np.add.at(size, docs, np.diff(np.concatenate((starts, [len(c)]))))
        np.logical_or.at(letters, docs, np.logical_or.reduceat(c != 32, starts))

    for i, t in enumerate(texts):
        for a in range(0, len(t or ""), STRETCH):
            piece = t[a : a + STRETCH]
            if held + len(piece) > STRETCH and group:
                add()
                group, held = [], 0
            group.append((i, piece))
            held += len(piece)
    if group:
        add()
    return total, size, letters


def _counts(rows: DataFrame) -> DataFrame:
    """(_lang, c0..c3, n) of the (_lang, _text) rows."""

    def run(batches):
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                own = [t for k, t in zip(langs, texts) if k == lang and t]
                own = [t[a : a + STRETCH] for t in own for a in range(0, len(t), STRETCH)]
                first = 0
                while first < len(own):
                    size, last = 0, first
                    while last < len(own) and (last == first or size + len(own[last]) <= STRETCH):
                        size += len(own[last])
                        last += 1
                    g = grams(*codes(own[first:last]))
                    first = last
                    if not g.shape[1]:
                        continue
                    _, at, n = np.unique(_key(g), return_index=True, return_counts=True)
                    yield pa.record_batch([pa.array([lang] * len(at)), *[pa.array(row[at].astype(np.int32)) for row in g], pa.array(n)], ["_lang", "c0", "c1", "c2", "c3", "n"])

    found = rows.mapInArrow(run, "_lang string, c0 int, c1 int, c2 int, c3 int, n long")
    return found.groupBy("_lang", "c0", "c1", "c2", "c3").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, lang: str = "lang", doc: str = "doc_id", text: str = "text", per_lang: int = PER_LANG) -> Models | None:
    """Models from about ``per_lang`` texts of each language, of which a fifth fits temperature and limits. None without texts."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("_lang"), F.col(doc).alias("_id"), F.col(text).cast("string").alias("_text"))
    counts = rows.groupBy("_lang").agg(F.count("*").alias("_n"))
    draw = F.pmod(F.xxhash64("_id", F.lit("lang")), F.lit(1 << 30))
    sample = rows.join(F.broadcast(counts), "_lang").where(draw / float(1 << 30) * F.col("_n") < per_lang)  # a row per language
    sample = sample.select("_lang", "_text", F.pmod(F.xxhash64("_id", F.lit("held back")), F.lit(5)).alias("_part"))
    sample = written(sample)
    table = _counts(sample.where("_part > 0").select("_lang", "_text")).toArrow()  # bounded by the sample
    names = sorted(set(table["_lang"].to_pylist()))
    if not names:
        table = _counts(sample.select("_lang", "_text")).toArrow()
        names = sorted(set(table["_lang"].to_pylist()))
    if not names:
        return None
    owner = np.array(table["_lang"].to_pylist())
    g = np.stack([table[f"c{i}"].to_numpy().astype(np.uint64) for i in range(ORDER)])
    n = table["n"].to_numpy().astype(float)
    levels, floor = [], []
    for name in names:
        at = np.flatnonzero(owner == name)
        at = at[np.argsort(_key(g[:, at]))]
        own, share = build(g[:, at], n[at])
        levels.append(own)
        floor.append(share)
    known = _unique(g)
    logp = np.stack([np.log(probability(levels[k], floor[k], known)) for k in range(len(names))]).astype(np.float32)
    keys = _key(known)
    order = np.argsort(keys)
    models = Models(names, levels, floor, keys[order], logp[:, order], 1.0, np.full(len(names), np.inf))
    return _calibrated(models, sample.where("_part = 0").select("_lang", "_text"))


def _calibrated(models: Models, rows: DataFrame) -> Models:
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for batch in batches:
            total, size, letters = _loglik(shared.value, batch.column(1).to_pylist())
            yield pa.record_batch([batch.column(0), pa.array(list(total), pa.list_(pa.float64())), pa.array(size), pa.array(letters)], ["_lang", "total", "size", "letters"])

    held = rows.mapInArrow(run, "_lang string, total array<double>, size long, letters boolean").toArrow().to_pylist()  # bounded by the sample
    held = [r for r in held if r["letters"] and r["_lang"] in models.langs]
    if not held:
        return models
    total = np.array([r["total"] for r in held])
    size = np.array([r["size"] for r in held])
    truth = np.array([models.langs.index(r["_lang"]) for r in held])
    best = (1.0, np.inf)
    for t in 0.5 ** np.arange(0, 12):
        z = (total - total.max(axis=1, keepdims=True)) * t
        p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        loss = -np.log(np.maximum(p[np.arange(len(truth)), truth], 1e-12)).mean()
        if loss < best[1]:
            best = (float(t), loss)
    entropy = -total[np.arange(len(truth)), truth] / size
    limits = [float(np.quantile(entropy[truth == k], 1 - REJECT_SHARE)) if (truth == k).any() else np.inf for k in range(len(models.langs))]
    return models._replace(temperature=best[0], limits=np.array(limits))


def identify(docs: DataFrame, models: Models | None, text: str = "text") -> DataFrame:
    """``docs`` with ``_language``: a struct of lang_pred, score, cross_entropy (nats a character) and rejected.

    Texts that are null or have no letter, and all texts if there is no model, are ``und`` with score 0 and rejected. Equal
    cross-entropies go to the first language by name.
    """
    kind = "struct<lang_pred string, score double, cross_entropy double, rejected boolean>"
    if models is None:
        return docs.withColumn("_language", F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected")))
    shared = docs.sparkSession.sparkContext.broadcast(models)

    @F.arrow_udf(kind)
    def name(texts: pa.Array) -> pa.Array:
        m = shared.value
        out = []
        for i in range(0, len(texts), 256):
            total, size, letters = _loglik(m, texts.slice(i, 256).to_pylist())
            best = total.argmax(axis=1)
            z = (total - total.max(axis=1, keepdims=True)) * m.temperature
            score = 1 / np.exp(z).sum(axis=1)
            entropy = -total[np.arange(len(best)), best] / np.maximum(size, 1)
            rejected = ~letters | (entropy > m.limits[best])
            out.append((np.where(letters, np.array(m.langs, dtype=object)[best], "und"), np.where(letters, score, 0.0), entropy, rejected, ~letters))
        lang, score, entropy, rejected, blank = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0)] * 5
        return pa.StructArray.from_arrays(
            [pa.array(list(lang), pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64(), mask=blank.astype(bool)), pa.array(rejected.astype(bool))],
            ["lang_pred", "score", "cross_entropy", "rejected"],
        )

    return docs.withColumn("_language", name(F.col(text).cast("string")))


def remainder(doc: Column, n: int) -> Column:
    return F.crc32(doc.cast("string")) % n


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    models = train(docs.where(remainder(F.col("doc_id"), 4) != 2))
    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return identify(docs.select("doc_id", "text"), models).select("doc_id", held.alias("held_out"), "_language.*")
