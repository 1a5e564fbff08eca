"""Language-model scores, outlier rules, passages and the pipeline against plain versions."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from feedloom.llm import neural, passages, rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- language-model scores

def small_net(classes=5, seed=3):
    head = neural.Head(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int16), classes, classes + 1, np.arange(1, classes + 1))
    net = neural.start_net(head, neural.Totals(100, 10, 30, 4), seed)
    return head, net


def test_class_probabilities_sum_to_one():
    head, net = small_net()
    z = neural.normalisers(net)
    n = head.rest + 1
    for one in range(n + 1):
        for two in range(n + 1):
            s = (net.context[one] * net.position[0] + net.context[two] * net.position[1]) @ net.target.T + net.bias
            assert np.exp(s - z[one, two]).sum() == pytest.approx(1, rel=1e-5)


def test_learning_finds_a_pattern():
    head, net = small_net()
    rng = np.random.default_rng(1)
    ids = np.tile([0, 1, 2, 3], 4000)
    t = neural.Trainer(net, np.exp(net.bias), 2)
    one, two = neural.contexts(ids, np.array([0]), head.rest + 1)
    for _ in range(3):
        for at in np.array_split(rng.permutation(len(ids)), 40):
            t.learn(ids[at], one[at], two[at])
    logs = neural.class_logs(t.net, neural.normalisers(t.net), ids, np.array([0]))
    before = neural.class_logs(net, neural.normalisers(net), ids, np.array([0]))
    assert logs.mean() > before.mean() + 0.7


@pytest.mark.parametrize("head", [4, 1 << 18])
def test_scores(spark, docs, monkeypatch, head):
    monkeypatch.setattr(neural, "HEAD", head)
    monkeypatch.setattr(neural.head_of, "__defaults__", (6, head))
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(80)], k=rng.randint(1, 90)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "NEVER seen neverseen " * 400), (503, "w1 \t W1\nw2"), (503, "w1 \t W1\nw2"), (None, "w3 w4")]
    got = neural.score_texts(docs(rows)).collect()
    assert len(got) == len(rows)
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    count = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    total = sum(count.values())
    want = {}
    for i, t in rows:
        w = tokens(t)
        want[i] = (held(i), len(w), sum(count[x] > 0 for x in w), total, sum(math.log10((count[x] + 0.1) / (total + 0.1 * (len(count) + 1))) for x in w))
    for r in got:
        assert tuple(r)[:-1] == (r.doc_id, *want[r.doc_id][:4], pytest.approx(want[r.doc_id][4], rel=1e-9))
        assert r.score < 0
    assert neural.score_texts(docs([])).count() == 0
    alone = neural.score_texts(docs([(None, "a b")])).first()
    assert (alone.held_out, alone.n_known, alone.train_tokens) == (True, 0, 0)


def test_rare_words_share_their_class(spark, docs, monkeypatch):
    """After the same words, rare words and an unknown one divide the probability of their class, which adds up to one."""
    monkeypatch.setattr(neural.head_of, "__defaults__", (3, 6))
    rng = random.Random(8)
    words = [f"w{i}" for i in range(12)]
    train = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(12)], k=30)), "t") for i in range(40)]
    count = Counter(w for _, t, _ in train for w in t.split())
    classed = {w for w, _ in count.most_common(3)}
    rare = [w for w in words if w not in classed]
    ask = [(1000 + k, f"w0 w1 {w}", "q") for k, w in enumerate([*rare, "unknown"])]
    got = {r.doc_id: r.score for r in neural.score_texts(docs(train + ask), held_out=F.col("lang") == "q").collect()}
    total = sum(count[w] for w in rare)
    unknown = 0.1 / (total + 0.1 * (len(rare) + 1))
    assert sum(10 ** (got[1000 + k] - got[1000 + len(rare)]) * unknown for k in range(len(rare) + 1)) == pytest.approx(1)


def test_network_beats_counts(spark):
    got = neural.op8_neural_scores(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


# ---- outlier rules

def plain_statistics(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    covered = {j for i, v in enumerate(windows) if n[v] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_word_statistics(spark, docs):
    rng = random.Random(9)
    texts = ["", None, " \n ", "a", "a b", "a b c", "a b c a b c", "x x x x", "é|ü # é|ü # é|ü #\n\n \nl\nl", "line\nline\r\nline", "𝔘 𝔘 𝔘 𝔘"]
    texts += [" ".join(rng.choices("abcd", k=rng.randint(1, 80))) for _ in range(60)] + ["word other " * 200_000]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in rules.word_statistics(docs(rows).select("doc_id", "text", "_hash")).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_statistics(t)


def test_estimate_ignores_outliers(spark):
    rng = np.random.default_rng(4)
    mix = np.array([[1, 0.5, 0, 0, 0], [0, 1, 0.3, 0, 0], [0, 0, 1, 0, 0.4], [0, 0, 0, 1, 0], [0, 0, 0, 0, 1]])
    good = rng.normal(size=(1800, 5)) @ mix
    bad = rng.normal(size=(200, 5)) * 0.1 + 12
    x = np.vstack((good, bad))
    long = spark.createDataFrame([("g", *map(float, r)) for r in x], "_g string, " + ", ".join(f"_x{i} double" for i in range(5)))
    scale, estimate = rules.estimates(long)
    s, e = scale.first(), estimate.first()
    width = np.array([s[f"_w{i}"] for i in range(5)])
    centre = np.array([s[f"_c{i}"] for i in range(5)]) + width * np.array([e[f"_m{i}"] for i in range(5)])
    low = np.array([[e[f"_l{i}{j}"] if j <= i else 0 for j in range(5)] for i in range(5)])
    cov = (low @ low.T - rules.RIDGE * np.eye(5)) * np.outer(width, width)
    assert np.abs(centre - good.mean(axis=0)).max() < 0.15
    assert np.abs(cov - np.cov(good.T)).max() < 0.35

    # the same steps in numpy
    z = (x - np.array([s[f"_c{i}"] for i in range(5)])) / width
    d = (z**2).sum(axis=1)
    for _ in range(rules.STEPS + 1):
        h = z[d <= np.quantile(d, rules.HALF)]
        m, c = h.mean(axis=0), np.cov(h.T, bias=True) + rules.RIDGE * np.eye(5)
        d = np.einsum("ij,jk,ik->i", z - m, np.linalg.inv(c), z - m)
    f = max(1.0, np.median(d) / rules.MEDIAN_CHI2)
    h = z[d <= rules.CUT_CHI2 * f]
    assert np.abs(h.mean(axis=0) - np.array([e[f"_m{i}"] for i in range(5)])).max() < 0.02


def test_judge(spark, docs):
    rng = random.Random(10)
    words = [f"word{i}" for i in range(4000)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(60, 300))), "en", "a" if i % 3 else "b") for i in range(500)]
    rows += [(900, " ".join(w + "***###" for w in rng.choices(words, k=120)), "en", "a"), (901, None, "en", "a"), (902, "short", None, None)]
    rows += [(903, " ".join(rng.choices(words, k=80)), None, None), (None, rows[0][1], "en", "a"), (1, rows[1][1], "en", "a")]
    got = rules.judge(docs(rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert np.mean([by[i].kept for i in range(500)]) > 0.99
    assert not by[900].kept and not by[900].base_failed and not by[901].kept and by[901].base_failed and not by[902].kept
    assert by[903].kept and by[903].distance is None
    assert rules.judge(docs([])).count() == 0


# ---- passages

def plain_chain(a, b):
    """Best chain score by trying every predecessor."""
    score = []
    for i in range(len(a)):
        best = 0.0
        for j in range(i):
            if a[j] < a[i] and b[j] < b[i]:
                s = score[j] - passages.SKIP_COST * max(0, a[i] - a[j] - passages.K) - passages.SKIP_COST * max(0, b[i] - b[j] - passages.K)
                best = max(best, s)
        score.append(best + passages.K)
    return max(score)


def chain_score(a, b, chain):
    s = float(passages.K)
    for i, j in zip(chain, chain[1:]):
        assert a[i] < a[j] and b[i] < b[j]
        s += passages.K - passages.SKIP_COST * (max(0, a[j] - a[i] - passages.K) + max(0, b[j] - b[i] - passages.K))
    return s


def test_fenwick_chains():
    rng = random.Random(11)
    for n in (1, 2, 5, 40, 80):
        for _ in range(10):
            # seeds at least K apart, so that skipped words are counted from the end of a seed
            links = sorted({(rng.randrange(40) * passages.K, rng.randrange(40) * passages.K) for _ in range(n)})
            a, b = [x for x, _ in links], [y for _, y in links]
            found = passages.chains(a, b)
            assert sorted(i for c in found for i in c) == list(range(len(a)))
            assert chain_score(a, b, found[0]) == pytest.approx(plain_chain(a, b))


def test_every_common_run_has_a_seed():
    rng = np.random.default_rng(12)
    for n in (8, 10, 23, 60):
        run = rng.integers(1, 1 << 62, n).astype(np.uint64)
        x = np.concatenate((rng.integers(1, 1 << 62, 50).astype(np.uint64), run, rng.integers(1, 1 << 62, 9).astype(np.uint64)))
        y = np.concatenate((rng.integers(1, 1 << 62, 5).astype(np.uint64), run, rng.integers(1, 1 << 62, 70).astype(np.uint64)))
        text, at, seed = passages.minimisers(np.concatenate((x, y)), np.array([0, len(x), len(x) + len(y), len(x) + len(y)]))
        common = set(seed[text == 0].tolist()) & set(seed[text == 1].tolist())
        assert common or n < passages.K + passages.WINDOW - 1


def test_passages(spark, docs):
    rng = random.Random(13)
    new = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    shared = new(60)
    fuzzy = list(shared)
    for at in (20, 41):
        fuzzy[at] = "changed"
    rows = [(i, " ".join(new(rng.randint(0, 80)) + shared + new(30))) for i in range(10, 40)]
    rows += [(50, " ".join(new(10) + fuzzy)), (51, " ".join(fuzzy[:30] + ["more", "words"] + fuzzy[30:]))]
    rows += [(60, " ".join(new(100))), (61, " ".join(shared[:40])), (62, None), (63, ""), (None, " ".join(shared)), (10, " ".join(shared))]
    copy = " ".join(new(200))
    rows += [(70, copy), (71, copy.upper()), (71, copy)]
    got = passages.passages(docs(rows)).collect()
    found = {r.doc_id for r in got} | {r.other_id for r in got}
    assert found == {*range(10, 40), 50, 51, 70, 71}
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append((t or "").lower().split())
    for r in got:
        assert r.n_words >= passages.LEAST_WORDS and 0.8 <= r.similarity <= 1 and r.other_id < r.doc_id
        if r.similarity == 1:
            assert any(x[r.start : r.end] == y[r.other_start : r.other_end] for x in texts[r.doc_id] for y in texts[r.other_id])
    assert next(r for r in got if r.doc_id == 50).similarity == pytest.approx(58 / 60, abs=0.02)
    assert passages.passages(docs([])).count() == 0


def test_long_runs_meet_long_runs(spark, docs):
    """The first document has the pattern, but not for long: the other two still meet."""
    new = lambda n, k: " ".join(f"u{k}x{i}" for i in range(n))
    rows = [(1, f"{new(20, 1)} {'mit ' * 20} {new(20, 2)}"), (2, f"{new(30, 3)} {'mit ' * 80} {new(9, 4)}"), (3, f"{'mit ' * 60} {new(30, 5)}")]
    rows += [(4, f"{new(5, 6)} {'la li lu ' * 10}"), (5, f"{new(5, 7)} {'la li lu ' * 30}"), (6, f"{new(3, 8)} {'la li lu ' * 25} {new(5, 9)}")]
    found = [(r.doc_id, r.other_id) for r in passages.passages(docs(rows)).collect()]
    assert (3, 2) in found and (6, 5) in found
    assert {i for pair in found for i in pair} == {2, 3, 5, 6}


def test_documents_meet_beyond_the_first_of_a_seed(spark, docs):
    """Two documents hold the halves of what two others share, which also share something else with a third each."""
    rng = random.Random(31)
    new = lambda n: [f"m{rng.randrange(10**9)}" for _ in range(n)]
    both, q, r = new(60), new(60), new(60)
    fuzzy = [*both[:12], "other", *both[13:45], "more", *both[45:]]
    rows = [(1, new(20) + both[:34] + new(20)), (2, new(20) + both[26:] + new(20)), (3, q + new(5) + both), (4, r + new(9) + fuzzy), (5, q), (6, r + new(9))]
    line = new(12)  # a line that many have is no passage
    rows += [(i, new(rng.randrange(30)) + line + new(40)) for i in range(10, 40)]
    got = passages.passages(docs([(i, " ".join(w)) for i, w in rows])).collect()
    assert sorted((r.doc_id, r.other_id) for r in got) == [(4, 3), (5, 3), (6, 4)]


def test_places_of_a_seed_in_blocks(spark, docs, monkeypatch):
    """Families whose members differ from the first document meet whatever the size of the blocks."""
    monkeypatch.setattr(passages, "BLOCK", 3)
    rng = random.Random(32)
    new = lambda n: [f"n{rng.randrange(10**9)}" for _ in range(n)]
    line, rows = new(30), []
    tails = [new(40) for _ in range(8)]
    rows = [(100 - i, new(10) + line + tails[i % 8]) for i in range(16)]
    got = passages.passages(docs([(i, " ".join(w)) for i, w in rows])).collect()
    assert {(r.doc_id, r.other_id) for r in got} == {(100 - i, 92 - i) for i in range(8)}


def test_ends_and_common_bits_in_arrays():
    """Many ends grow as one does, and rows of bits meet as they do one by one, whether a bit is rare or nearly all rows have it."""
    r = np.random.default_rng(33)
    x = r.integers(0, 4, (400, passages.REACH))
    y, n = np.where(r.random(x.shape) < 0.85, x, 9), r.integers(0, passages.REACH + 1, len(x))
    words, equal = passages.grown_ends(x, y, n)
    assert list(zip(words, equal)) == [passages._grown(a[:k], b[:k]) for a, b, k in zip(x, y, n)]
    texts = [r.integers(-6 if i % 2 else -30000, 6 if i % 2 else 30000, int(a) + passages.K + int(b)).astype(np.int16) for i, (a, b) in enumerate(r.integers(0, 65, (300, 2)))]
    at = np.array([len(t) // 2 - passages.K // 2 for t in texts])
    bits = passages.signatures(pa.array([texts[0], *texts], pa.list_(pa.int16()))[1:], at)
    assert [int(b) for b in np.bitwise_count(bits).sum(axis=1)] == pytest.approx([len(t) - passages.K for t, a in zip(texts, at)], abs=8)
    usual = np.zeros(passages.SIGNATURE, dtype=np.uint8)
    usual[:40] = 1
    bits[::3] |= np.packbits(usual)
    for least in (1, 16, 40):
        got = {(int(i), int(j)) for one, two in passages.alike(bits, least) for i, j in zip(one, two)}
        assert got == {(i, j) for i in range(len(bits)) for j in range(i + 1, len(bits)) if np.bitwise_count(bits[i] & bits[j]).sum() >= least}


def test_all_long_repeats_are_found(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, (r.text or "").encode().lower().split()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    where = {}
    for i, w in rows:
        for j in range(len(w) - 50):
            where.setdefault(tuple(w[j : j + 51]), set()).add(i)
    want = set().union(*[s for s in where.values() if len(s) > 1])
    got = passages.op10_shared_passages(spark, sf).collect()
    assert want and want <= {r.doc_id for r in got} | {r.other_id for r in got}


# ---- pipeline

def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "1 AS _id", "2 AS _key")
    names = docs.columns
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.written(stage(spark, docs, sf))
        assert out.columns[: len(names)] == names
        before = {tuple(r) for r in docs.select("doc_id", "text", "source").collect()}
        assert {tuple(r) for r in out.select("doc_id", "text", "source").collect()} <= before
        docs = out
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    assert len(corpus_pipeline.STAGES) == 5 and docs.columns[-4:] == ["shard", "depth", "shard_bytes", "shard_rows"]
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_pipeline_keeps_one_clean_copy(spark):
    sf = "/root/testdata/sf0.001"
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    base = " ".join(f"word{i}" for i in range(120))
    rows = [(3, base, "en", "s"), (2, base.upper(), "en", "s"), (5, f"{base} {item}", "en", "s"), (6, " ".join(f"term{i}" for i in range(90)), "de", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    one = corpus_pipeline.keep_one_copy(spark, docs, sf)
    assert sorted(r.doc_id for r in one.collect()) == [2, 5, 6]
    assert sorted(r.doc_id for r in corpus_pipeline.keep_clean(spark, one, sf).collect()) == [2, 6]
