"""Quality classifier: ordinal regression with cumulative links on graded ratings.

A text's features are hashed: its words, the beginnings and endings of its words, and a few measures of the whole text in
steps. One weight per hashed feature is shared by all grades; grades differ by ordered thresholds only:
P(grade > k) = sigmoid(score - threshold[k]). The expected grade ranks texts, and the probability of reaching the top
grade selects them.

The weights are fitted on a bounded sample of rated rows (``per_grade``, each grade drawn by a hash of its id and weighted
back to its share); a fifth of it sets the cut. Every text is scored as a whole.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.words import mix, pieces, words_of

BITS = 18
GRADES = 3
PER_GRADE = 3000
KEEP_SHARE = 0.99  # of held-out texts of the top grade, the part that the cut has to keep
LEAST_CUT = 0.2  # for few held-out texts
PIECE = 1 << 20  # bytes of text that a task takes apart at a time
_SALTS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89, 0x452821E638D01377], dtype=np.uint64)
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>!{}[]=_~^\\/@+")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True


class Model(NamedTuple):
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float  # texts whose probability of the top grade is below are rejected


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashed features of each text as (index, value, bounds): feature ids of text i are index[bounds[i]:bounds[i+1]]."""
    w = words_of(column)
    n = len(w.bounds) - 1
    doc = np.repeat(np.arange(n, dtype=np.uint64), np.diff(w.bounds))
    length = w.end - w.start
    low = np.where(_UPPER[w.data], w.data + 32, w.data).astype(np.uint8)
    padded = np.concatenate((np.zeros(8, np.uint8), low, np.zeros(8, np.uint8)))
    eight = np.lib.stride_tricks.as_strided(np.frombuffer(padded, dtype="<u8", count=1), shape=(len(padded) - 7,), strides=(1,))
    head, tail = eight[w.start + 8], eight[w.end]
    parts = [(doc, w.hashes ^ _SALTS[0])]
    for size, salt in ((4, _SALTS[1]), (5, _SALTS[2])):
        at = length > size
        parts.append((doc[at], mix((head[at] & np.uint64((1 << (8 * size)) - 1)) ^ salt)))
    at = length > 2
    parts.append((doc[at], mix((tail[at] >> np.uint64(48)) ^ _SALTS[3])))
    size = np.diff(w.bounds)
    some = np.flatnonzero(size)
    count = np.zeros((4, n))
    if len(some):
        starts = w.bounds[some]
        for row, kind in ((0, _UPPER), (1, _LETTER), (2, _SYMBOL)):
            total = np.concatenate(([0], np.cumsum(kind[w.data], dtype=np.int64)))
            count[row, some] = np.add.reduceat(total[w.end] - total[w.start], starts)
        count[3, some] = np.add.reduceat(length, starts)
        same = np.zeros(len(w.hashes), dtype=np.int64)
        same[1:] = (w.hashes[1:] == w.hashes[:-1]) & (doc[1:] == doc[:-1])
        repeats = np.zeros(n)
        repeats[some] = np.add.reduceat(same, starts)
        measures = [count[0] / np.maximum(count[1], 1), count[2] / np.maximum(count[3], 1), repeats / np.maximum(size, 1)]
        for k, m in enumerate(measures):
            step = np.minimum(np.floor(m * 20), 10)[some].astype(np.uint64)
            parts.append((some.astype(np.uint64), mix(step + np.uint64(1000 * (k + 1)) ^ _SALTS[4])))
        parts.append((some.astype(np.uint64), mix(np.minimum(np.log2(size[some]), 7).astype(np.uint64) + np.uint64(9000) ^ _SALTS[4])))
    owner, h = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    key = np.unique((owner << np.uint64(BITS)) | (h >> np.uint64(64 - BITS)))
    owner = (key >> np.uint64(BITS)).astype(np.int64)
    bounds = np.searchsorted(owner, np.arange(n + 1))
    index = (key & np.uint64((1 << BITS) - 1)).astype(np.int32)
    value = (1 / np.sqrt(np.maximum(np.diff(bounds), 1))).astype(np.float64)
    return index, value, bounds


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values)))
    return total[bounds[1:]] - total[bounds[:-1]]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(index, value, bounds, grade, weight, rounds: int = 150, ridge: float = 1e-5, rate: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds that maximise the weighted likelihood of the grades (Adam over the whole sample).

    ``value`` is that of all features of a text, one per text. Texts are gone through in blocks, so beyond the feature lists
    little memory is needed."""
    weight = weight / weight.sum()
    share = np.array([weight[grade > k].sum() for k in range(GRADES - 1)]).clip(1e-3, 1 - 1e-3)
    first = -np.log(share / (1 - share))
    free = np.concatenate((first[:1], np.log(np.maximum(np.diff(first), 0.1))))  # first threshold, logs of the gaps
    w = np.zeros(1 << BITS)
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(free), np.zeros_like(free)]
    blocks = [(a, min(a + 256, len(grade))) for a in range(0, len(grade), 256)]
    for t in range(1, rounds + 1):
        theta = free[0] + np.concatenate(([0], np.cumsum(np.exp(free[1:]))))
        d_w, d_theta = ridge * w, np.zeros(GRADES - 1)
        for a, b in blocks:
            own, ends, g, part = index[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], grade[a:b], weight[a:b]
            score = _sums(w[own], ends) * value[a:b]
            above = np.hstack((np.ones((b - a, 1)), _sigmoid(score[:, None] - theta[None, :]), np.zeros((b - a, 1))))
            slope, eye = above * (1 - above), np.arange(b - a)
            p = np.maximum(above[eye, g] - above[eye, g + 1], 1e-9)
            d_score = -part * (slope[eye, g] - slope[eye, g + 1]) / p
            for k in range(GRADES - 1):
                pull = part * slope[:, k + 1] / p
                d_theta[k] += pull[g == k + 1].sum() - pull[g == k].sum()
            d_w += np.bincount(own, weights=np.repeat(d_score * value[a:b], np.diff(ends)), minlength=1 << BITS)
        d_free = np.concatenate(([d_theta.sum()], [d_theta[k:].sum() * np.exp(free[k]) for k in range(1, GRADES - 1)]))
        for x, g, m, v in ((w, d_w, moments[0], moments[1]), (free, d_free, moments[2], moments[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-10)
    return w, free[0] + np.concatenate(([0], np.cumsum(np.exp(free[1:]))))


def predict(model: Model, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Expected grade (0 to 2) and probability of the top grade."""
    index, value, bounds = features(column)
    score = _sums(model.weights[index] * np.repeat(value, np.diff(bounds)), bounds)
    above = _sigmoid(score[:, None] - model.thresholds[None, :])
    return above.sum(axis=1), above[:, -1]


def rated(labels: DataFrame) -> DataFrame:
    """(_id, _grade): toxic 0, not toxic but of low quality 1, good 2. Rows without an id or without both ratings are left out."""
    good = F.when(F.col("toxic") != 0, 0).when(F.col("quality") == 0, 1).otherwise(2)
    return labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").alias("_id"), good.alias("_grade"))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc: str = "doc_id", per_grade: int = PER_GRADE) -> Model | None:
    """Fit on about ``per_grade`` rated rows of each grade. None if nothing is rated."""
    grades = rated(labels)
    counts = {r["_grade"]: r["n"] for r in grades.groupBy("_grade").agg(F.count("*").alias("n")).collect()}  # three rows at most
    if not counts:
        return None
    draw = F.pmod(F.xxhash64("_id", F.lit("rated")), F.lit(1 << 20)) / float(1 << 20)
    part = F.coalesce(*[F.when(F.col("_grade") == g, F.lit(min(1.0, per_grade / n))) for g, n in counts.items()])
    sample = grades.withColumn("_part", part).where(draw < F.col("_part"))
    rows = docs.select(F.col(doc).alias("_id"), F.col(text).cast("string").alias("_text"))
    rows = rows.join(F.broadcast(sample), "_id")  # about per_grade rows of each of three grades
    rows = rows.select("_text", "_grade", "_part", "_id")

    def run(batches):
        for batch in pieces(batches, PIECE):
            index, _, bounds = features(batch.column(0))
            yield pa.record_batch(
                [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(index)), batch.column(1), batch.column(2), batch.column(3).cast(pa.string())],
                ["index", "grade", "part", "id"],
            )

    found = rows.mapInArrow(run, "index array<int>, grade int, part double, id string").toArrow().combine_chunks()  # bounded by per_grade
    found = found.sort_by([("id", "ascending"), ("grade", "ascending")])
    if not found.num_rows:
        return None
    size = np.array(found["index"].combine_chunks().value_lengths())
    bounds = np.concatenate(([0], np.cumsum(size)))
    index = np.array(found["index"].combine_chunks().flatten())
    value = 1 / np.sqrt(np.maximum(size, 1))
    grade, part = np.array(found["grade"]), np.array(found["part"])
    del found
    pa.default_memory_pool().release_unused()
    held = np.arange(len(grade)) % 5 == 4
    weight = 1 / part
    weights, thresholds = fit(index, value, bounds, grade, np.where(held, 0, weight) if (~held).any() else weight)
    model = Model(weights.astype(np.float32), thresholds, 0.5)
    score = _sums(weights.astype(np.float32)[index], bounds) * value
    tail = np.sort(_sigmoid(score - thresholds[-1])[held & (grade == GRADES - 1)])
    cut = float(np.clip(tail[int((1 - KEEP_SHARE) * len(tail))], LEAST_CUT, 0.5)) if len(tail) else 0.5
    return model._replace(cut=cut)


def scored(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with ``_quality``: a struct of expected_grade, tail_probability and kept.

    A null or empty text has no features; it is scored by the thresholds alone. Without a model grades are null and every
    row is kept.
    """
    if model is None:
        none = F.lit(None).cast("double")
        return docs.withColumn("_quality", F.struct(none.alias("expected_grade"), none.alias("tail_probability"), F.lit(True).alias("kept")))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a weight per hashed feature: a fixed size

    @F.arrow_udf("struct<expected_grade double, tail_probability double>")
    def grade(texts: pa.Array) -> pa.Array:
        parts, step = [], max(1, int(len(texts) * PIECE // max(texts.nbytes, 1)))
        for i in range(0, len(texts), step):
            parts.append(predict(shared.value, texts.slice(i, step)))
        both = [np.concatenate(p) for p in zip(*parts)] if parts else [np.zeros(0)] * 2
        return pa.StructArray.from_arrays([pa.array(both[0]), pa.array(both[1])], ["expected_grade", "tail_probability"])

    found = docs.withColumn("_quality", grade(F.col(text).cast("string")))
    kept: Column = F.col("_quality.tail_probability") >= model.cut
    return found.withColumn("_quality", F.struct("_quality.expected_grade", "_quality.tail_probability", kept.alias("kept")))


def op6_quality_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select("doc_id", "_quality.*")
