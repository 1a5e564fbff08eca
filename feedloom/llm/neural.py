"""Language-model scoring with a log-bilinear neural model, trained in numpy by noise-contrastive estimation.

Token counts of the whole training corpus are taken first. The most frequent words form the model's classes, together
with the end of a text and one class for all other words. The model predicts a class from the two before it: each has a
vector, position weights add them up, and the product with the class's vector plus a bias is its score. Given its class,
a rare word has the smoothed share of its count among all rare words. So the probabilities of all words sum to one.

Training goes over all training texts in ``ROUNDS`` passes over disjoint parts. In a pass every task starts from the
shared parameters, learns from its texts in batches against noise drawn from the classes' frequencies, and hands back
parameters weighted by its tokens; their mean starts the next pass. The parameters have a fixed size.

Scoring needs the normaliser of a context. There are (classes + 1)**2 contexts, so all normalisers are formed once by
matrix products and sent along as one table of fixed size.

Counts are unbounded. The most frequent (``HEAD``) travel as sorted hash arrays and cover most tokens; the others are
joined by hash, once per text and different word, so every token is looked up in the counts of the whole corpus.
Words are told apart by a 64-bit hash.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.language import remainder
from feedloom.llm.words import pieces, words_of
from feedloom.operators.stages import written

CLASSES = 512  # most frequent tokens with a class of their own
HEAD = 1 << 18  # counts that travel with the tasks: 4 MB
DIM = 16
NOISE = 24
BATCH = 2048
ROUNDS = 3
RATE = 0.3
END_HASH = np.uint64(0xE0DE0DE0DE0DE0DE)
DELTA = 0.1


class Head(NamedTuple):
    keys: np.ndarray  # sorted hashes
    counts: np.ndarray
    classes: np.ndarray  # class of each, or -1
    end: int  # class of the end token
    rest: int  # class of all tokens without one; the context before a text is rest + 1
    class_counts: np.ndarray


class Totals(NamedTuple):
    tokens: int
    types: int
    rest_tokens: int  # of tokens without a class
    rest_types: int


def token_counts(texts: DataFrame) -> DataFrame:
    """(_hash, n) over the tokens of the (_text) rows: words with A-Z lowered, and one end per text."""

    def run(batches):
        keys, counts, held, ends = [], [], 0, 0

        def merged():
            k, at = np.unique(np.concatenate(keys), return_inverse=True)
            return k, np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)

        for part in pieces(batches):
            k, n = np.unique(words_of(part.column(0)).hashes, return_counts=True)
            ends += part.num_rows
            keys.append(k)
            counts.append(n)
            held += len(k)
            if held > 4_000_000:
                k, n = merged()
                keys, counts, held = [k], [n], len(k)
                if held > 2_000_000:  # as many different words as a task should hold
                    yield pa.record_batch([pa.array(k.view(np.int64)), pa.array(n)], ["_hash", "n"])
                    keys, counts, held = [], [], 0
        keys.append(np.array([END_HASH] if ends else [], dtype=np.uint64))
        counts.append(np.array([ends] if ends else [], dtype=np.int64))
        k, n = merged()
        for i in range(0, len(k), 200_000):
            yield pa.record_batch([pa.array(k[i : i + 200_000].view(np.int64)), pa.array(n[i : i + 200_000])], ["_hash", "n"])

    return texts.select("_text").mapInArrow(run, "_hash long, n long").groupBy("_hash").agg(F.sum("n").alias("n"))


def head_of(counts: DataFrame, classes: int = CLASSES, most: int = HEAD) -> tuple[Head, int]:
    """The most frequent tokens, at most ``most``, and the least count among them: every token with it or more is included."""
    step = F.floor(F.log2(F.col("n")) * 8)  # a few hundred steps whatever the counts are
    steps = sorted(((r["s"], r["k"], r["least"]) for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("k"), F.min("n").alias("least")).collect()), reverse=True)
    total, least = 0, None
    for _, k, low in steps:
        if total + k > most:
            break
        total, least = total + k, low
    if least is None:
        table = counts.limit(0).toArrow()
        least = 1 << 62
    else:
        table = counts.where(F.col("n") >= least).toArrow()  # at most ``most`` rows
    keys = table["_hash"].to_numpy().astype(np.int64).view(np.uint64)
    n = table["n"].to_numpy().astype(np.int64)
    if END_HASH not in keys:  # the end always has its class
        end = counts.where(F.col("_hash") == int(END_HASH.view(np.int64))).first()
        if end:
            keys, n = np.append(keys, END_HASH), np.append(n, end["n"])
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    ranked = [i for i in np.lexsort((keys, -n)) if keys[i] != END_HASH][:classes]
    kind = np.full(len(keys), -1, dtype=np.int16)
    kind[ranked] = np.arange(len(ranked))
    kind[keys == END_HASH] = len(ranked)
    return Head(keys, n, kind, len(ranked), len(ranked) + 1, n[ranked]), least


def prepared(docs: DataFrame, head: Head) -> DataFrame:
    """Per (_doc, _held, _text) row: number of tokens, classes, and logs of counts that the head knows; other words by hash."""
    kind = docs.schema["_doc"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(head)

    def run(batches):
        h = shared.value
        log_count = np.log10(h.counts + DELTA)
        for part in pieces(batches):
            w = words_of(part.column(2))
            n = part.num_rows
            size = np.diff(w.bounds)
            doc = np.repeat(np.arange(n), size)
            if len(h.keys):
                at = np.minimum(np.searchsorted(h.keys, w.hashes), len(h.keys) - 1)
                known = h.keys[at] == w.hashes
                classes = np.where(known, h.classes[at], -1)
                logs = np.where(known, log_count[at], 0.0)
                end = np.flatnonzero(h.keys == END_HASH)
                end_log, end_known = (log_count[end[0]], 1) if len(end) else (np.log10(DELTA), 0)
            else:
                known, classes, logs = np.zeros(len(doc), bool), np.full(len(doc), -1), np.zeros(len(doc))
                end_log, end_known = np.log10(DELTA), 0
            rest = classes < 0
            sums = lambda x: np.bincount(doc, weights=x, minlength=n)
            ids = np.full(len(doc) + n, h.end, dtype=np.int16)  # the words of a text, then its end
            ids[np.arange(len(doc)) + doc] = np.where(rest, h.rest, classes)
            lists = pa.ListArray.from_arrays(pa.array((w.bounds + np.arange(n + 1)).astype(np.int32)), pa.array(ids))
            far = np.flatnonzero(~known)
            owner, words = doc[far], w.hashes[far]
            order = np.lexsort((words, owner))
            owner, words = owner[order], words[order]
            new = np.ones(len(owner), dtype=bool)
            new[1:] = (owner[1:] != owner[:-1]) | (words[1:] != words[:-1])
            first = np.flatnonzero(new)
            times = np.diff(np.concatenate((first, [len(owner)])))
            bounds = pa.array(np.searchsorted(owner[first], np.arange(n + 1)).astype(np.int32))
            yield pa.record_batch(
                [
                    part.column(0), part.column(1), pa.array(size + 1), pa.array((sums(known) + end_known).astype(np.int64)), pa.array(sums(logs) + end_log),
                    pa.array(sums(logs * (known & rest))), pa.array(sums(rest).astype(np.int64)), lists,
                    pa.ListArray.from_arrays(bounds, pa.array(words[first].view(np.int64))), pa.ListArray.from_arrays(bounds, pa.array(times.astype(np.int32))),
                ],
                ["_doc", "_held", "n_tokens", "_known", "_logs", "_rest_logs", "_rest", "_ids", "_far", "_times"],
            )

    schema = f"_doc {kind}, _held boolean, n_tokens long, _known long, _logs double, _rest_logs double, _rest long, _ids array<smallint>, _far array<long>, _times array<int>"
    return docs.mapInArrow(run, schema)


class Net(NamedTuple):
    context: np.ndarray  # a vector per class, and one for the place before a text
    position: np.ndarray  # weights of the two places
    target: np.ndarray
    bias: np.ndarray


def start_net(head: Head, totals: Totals, seed: int = 1) -> Net:
    rng = np.random.default_rng(seed)
    n = head.rest + 1
    share = np.concatenate((head.class_counts, [max(1, totals.tokens - totals.rest_tokens - head.class_counts.sum()), max(1, totals.rest_tokens)])).astype(np.float64)
    draw = lambda k: rng.normal(0, 0.3, (k, DIM))
    return Net(draw(n + 1), np.ones((2, DIM)), draw(n) * 0.1, np.log(share / share.sum()))


def contexts(ids: np.ndarray, starts: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
    """For each id the one before it and the one before that; ``before`` where a text has none."""
    one = np.concatenate(([before], ids[:-1])).astype(np.int64)
    one[starts] = before
    two = np.concatenate(([before], one[:-1]))
    two[starts] = before
    return one, two


def _scatter(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    at = (rows[:, None] * DIM + np.arange(DIM)).ravel()
    return np.bincount(at, weights=values.ravel(), minlength=n * DIM).reshape(n, DIM)


class Trainer:
    """Noise-contrastive learning from a stream of class ids, with a step size per parameter that shrinks as it moves."""

    def __init__(self, net: Net, noise: np.ndarray, seed: int):
        self.net = Net(*[x.copy() for x in net])
        self.squares = Net(*[np.full_like(x, 1e-2) for x in net])
        self.noise, self.log_noise = np.cumsum(noise), np.log(noise)
        self.rng = np.random.default_rng(seed)
        self.seen = 0

    def learn(self, target: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        c, p, q, b = self.net
        drawn = np.minimum(np.searchsorted(self.noise, self.rng.random(NOISE) * self.noise[-1]), len(b) - 1)
        r1, r2 = c[one], c[two]
        h = r1 * p[0] + r2 * p[1]
        log_k = np.log(NOISE)
        s_true = (h * q[target]).sum(axis=1) + b[target] - log_k - self.log_noise[target]
        s_noise = h @ q[drawn].T + (b[drawn] - log_k - self.log_noise[drawn])
        g_true = 1 / (1 + np.exp(np.clip(s_true, -30, 30)))
        g_noise = -1 / (1 + np.exp(-np.clip(s_noise, -30, 30)))
        d_h = g_true[:, None] * q[target] + g_noise @ q[drawn]
        d_q = _scatter(target, g_true[:, None] * h, len(q))
        np.add.at(d_q, drawn, g_noise.T @ h)
        d_b = np.bincount(target, weights=g_true, minlength=len(b))
        np.add.at(d_b, drawn, g_noise.sum(axis=0))
        d_c = _scatter(one, d_h * p[0], len(c)) + _scatter(two, d_h * p[1], len(c))
        d_p = np.stack(((d_h * r1).sum(axis=0), (d_h * r2).sum(axis=0)))
        scale = 1 / len(target)
        for x, s, g in zip(self.net, self.squares, (d_c, d_p, d_q, d_b)):
            g *= scale
            s += g * g
            x += RATE * g / np.sqrt(s)
        self.seen += len(target)


def _flat(net: Net) -> np.ndarray:
    return np.concatenate([x.ravel() for x in net])


def _shaped(flat: np.ndarray, like: Net) -> Net:
    ends = np.cumsum([x.size for x in like])
    return Net(*[part.reshape(x.shape) for part, x in zip(np.split(flat, ends[:-1]), like)])


def train(rows: DataFrame, head: Head, totals: Totals, rounds: int = ROUNDS) -> Net:
    """Parameters learned from the (_ids) rows; the starting ones if there are none."""
    net = start_net(head, totals)
    spark = rows.sparkSession
    noise = np.exp(net.bias)
    before = head.rest + 1
    for r in range(rounds):
        shared = spark.sparkContext.broadcast((net, noise))

        def run(batches, shared=shared, r=r):
            start, share = shared.value
            t = Trainer(start, share, 7 + r)
            for part in pieces(batches, 1 << 20):
                ids = np.asarray(part.column(0).flatten()).astype(np.int64)
                if not len(ids):
                    continue
                size = np.asarray(part.column(0).value_lengths())
                starts = np.concatenate(([0], np.cumsum(size)))[:-1][size > 0]
                one, two = contexts(ids, starts, before)
                order = t.rng.permutation(len(ids))
                for i in range(0, len(order), BATCH):
                    at = order[i : i + BATCH]
                    t.learn(ids[at], one[at], two[at])
            if t.seen:
                flat = np.concatenate((_flat(t.net) * t.seen, [t.seen]))
                yield pa.record_batch([pa.array(np.arange(len(flat))), pa.array(flat)], ["i", "v"])

        part = rows.where(F.pmod(F.xxhash64("_ids"), F.lit(rounds)) == r).select("_ids")
        found = part.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow().sort_by("i")["v"].to_numpy()  # one row per parameter
        if len(found):
            net = _shaped(found[:-1] / found[-1], net)
    return net


def normalisers(net: Net) -> np.ndarray:
    """Log of the sum over classes of exp(score), for every pair of context classes [one before, two before]."""
    out = np.empty((len(net.context),) * 2, dtype=np.float32)
    near, far = net.context * net.position[0], net.context * net.position[1]
    for i in range(len(near)):
        s = (near[i] + far) @ net.target.T + net.bias
        top = s.max(axis=1, keepdims=True)
        out[i] = (top + np.log(np.exp(s - top).sum(axis=1, keepdims=True)))[:, 0]
    return out


def class_logs(net: Net, log_z: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each id in its context."""
    one, two = contexts(ids, starts, len(net.context) - 1)
    out = np.empty(len(ids))
    near, far = net.context * net.position[0], net.context * net.position[1]
    for i in range(0, len(ids), 1 << 16):
        s = slice(i, i + (1 << 16))
        out[s] = ((near[one[s]] + far[two[s]]) * net.target[ids[s]]).sum(axis=1) + net.bias[ids[s]] - log_z[one[s], two[s]]
    return out


def score_texts(docs: DataFrame, doc: str = "doc_id", text: str = "text", held_out=None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row per row of ``docs``.

    ``held_out`` is a column expression; rows where it is not false are not learned from (default: a tenth by the id's
    CRC32). A null text is an empty one: its only token is the end. Without training texts all counts are zero and the
    network keeps its starting parameters. Repeated rows count each.
    """
    held = F.coalesce(remainder(F.col(doc), 10) == 0, F.lit(True)) if held_out is None else F.coalesce(held_out, F.lit(True))
    rows = docs.select(F.col(doc).alias("_doc"), held.alias("_held"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    counts = written(token_counts(rows.where("NOT _held")))
    head, least = head_of(counts)
    n_all = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    classed = head.classes >= 0
    totals = Totals(n_all["n"], n_all["v"], n_all["n"] - int(head.counts[classed].sum()), n_all["v"] - int(classed.sum()))
    table = written(prepared(rows, head).withColumn("_row", F.monotonically_increasing_id()))
    net = train(table.where("NOT _held").select("_ids"), head, totals)
    shared = docs.sparkSession.sparkContext.broadcast((net, normalisers(net)))

    def run(batches):
        model, log_z = shared.value
        for part in pieces(batches, 1 << 20):
            ids = np.asarray(part.column(1).flatten()).astype(np.int64)
            size = np.asarray(part.column(1).value_lengths())
            starts = np.concatenate(([0], np.cumsum(size)))[:-1]
            logs = np.add.reduceat(class_logs(model, log_z, ids, starts), starts) / np.log(10)
            yield pa.record_batch([part.column(0), pa.array(logs)], ["_row", "_classes"])

    classes = table.select("_row", "_ids").mapInArrow(run, "_row long, _classes double")
    # words beyond the head: their counts are joined, one row per text and word
    far = table.select("_row", F.explode(F.arrays_zip("_far", "_times")).alias("_w")).select("_row", F.col("_w._far").alias("_hash"), F.col("_w._times").alias("_times"))
    low = counts.where(F.col("n") < least)
    found = far.join(low, "_hash", "left").groupBy("_row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("_times")).otherwise(0)).alias("_far_known"), F.sum(F.col("_times") * F.log10(F.coalesce("n", F.lit(0)) + DELTA)).alias("_far_logs")
    )
    base = float(np.log10(totals.tokens + DELTA * (totals.types + 1)))
    rest = float(np.log10(totals.rest_tokens + DELTA * (totals.rest_types + 1)))
    numbers = table.select("_row", "_doc", "_held", "n_tokens", "_known", "_logs", "_rest_logs", "_rest")
    far_logs = F.coalesce("_far_logs", F.lit(0.0))
    return numbers.join(classes, "_row").join(found, "_row", "left").select(
        F.col("_doc").alias("doc_id"), F.col("_held").alias("held_out"), "n_tokens", (F.col("_known") + F.coalesce("_far_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(totals.tokens)).cast("long").alias("train_tokens"), (F.col("_logs") + far_logs - F.col("n_tokens") * base).alias("base_score"),
        (F.col("_classes") + F.col("_rest_logs") + far_logs - F.col("_rest") * rest).alias("score"),
    )


def op8_neural_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
