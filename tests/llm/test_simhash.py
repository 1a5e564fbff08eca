import itertools
import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Row

from feedloom.llm import simhash
from feedloom.llm.components import components


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    ids = list(range(len(fps)))
    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 2:
            a, b = ids[i], ids[j]
            ids = [min(a, b) if x in (a, b) else x for x in ids]
    return ids


def test_masks_cover_every_pair_of_positions():
    for r in (1, 2, 3):
        masks = simhash.masks(r)
        assert len(masks) == 2 ** (r + 1) - 1
        for at in itertools.islice(itertools.combinations(range(64), r), 0, None, 7):
            assert any(all(not m >> i & 1 for i in at) for m in masks)


def test_fingerprint_blocks_change_nothing(monkeypatch):
    rng = random.Random(3)
    texts = ["", None, "one", "One TWO", "a b c", " \t\n", "é Ü x É"] + [" ".join(rng.choices(["a", "Bb", "ccc", "ß", "\n"], k=n)) for n in (3, 4, 50, 400)]
    for block in (1, 7, 1 << 18):
        monkeypatch.setattr(simhash, "BLOCK", block)
        assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def test_links_reach_what_brute_force_reaches(spark):
    rng = random.Random(5)
    fps = {0}
    for _ in range(12):
        seed = rng.getrandbits(64)
        for _ in range(12):
            fps.add(seed)
            seed ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 2, 3])))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    roots = components(simhash.links(spark.createDataFrame([Row(_fp=s) for s in signed]))).collect()
    found = {r.node: r.root for r in roots}
    want = plain_components(fps)
    groups = {}
    for s, w in zip(signed, want):
        groups.setdefault(w, set()).add(found.get(s, s))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_documents(spark, docs):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(7, base), (3, base.upper()), (9, base + " tail"), (4, ""), (2, None), (8, "  \n"), (5, "other words here now"), (5, "other words here now"), (None, base), (None, "alone in here")]
    got = simhash.near_duplicates(docs(rows)).collect()
    assert len(got) == len(rows)
    fps = [plain_fingerprint(t) for _, t in rows]
    groups = plain_components(fps)
    want = sorted((i, f"{f:016x}", min((rows[k][0] for k in range(len(rows)) if groups[k] == g and rows[k][0] is not None), default=None)) for (i, _), f, g in zip(rows, fps, groups) if i is not None)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got if r.doc_id is not None) == want
    assert sorted(str(r.component_id) for r in got if r.doc_id is None) == ["3", "None"]
    left = simhash.one_of_each(docs(rows)).collect()
    assert sorted(r.doc_id for r in left if r.doc_id is not None) == sorted({i for i, _, c in want if i == c})
    assert all(r._key == "x" for r in left)
    assert simhash.near_duplicates(docs([])).count() == 0


def test_one_copy_stays_of_texts_that_share_their_shingles(spark, docs):
    rng = random.Random(8)

    def changed(words, *at):
        return " ".join(f"new{i}x{rng.random()}" if i in at else w for i, w in enumerate(words))

    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {()}

    rows, passage = [(None, "")], " ".join(f"common{i}" for i in range(30))
    for g in range(40):
        words = [f"w{g}x{i}" for i in range(100)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, changed(words, 50)), (len(rows) + 2, changed(words, 20, 70)), (len(rows) + 3, changed(words, 10, 30, 50, 70))]
        rows += [(len(rows), f"{passage} " + " ".join(f"own{g}x{i}" for i in range(60)))]  # a passage that many share
        rows += [(len(rows), " ".join(rng.choices("abc", k=rng.randint(2, 9)))), (len(rows) + 1, changed(words, 50, 98, 99))]
    sets = [grams(t) for _, t in rows]
    ids = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
            a, b = sorted((ids[i], ids[j]))
            ids = [a if x == b else x for x in ids]
    left = {r.doc_id for r in simhash.one_of_each(docs(rows)).collect()}
    assert left == {rows[i][0] for i in range(len(rows)) if ids[i] == i}
    assert 2 not in left and 3 not in left and {1, 4, 5} <= left


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(200, 100), (150, 100)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[200] == got[150] == got[100] == 100


def test_rows_that_share_an_id_keep_their_texts(spark, docs):
    a, b = (" ".join(f"{x}{i}" for i in range(120)) for x in "ab")
    left = simhash.one_of_each(docs([(5, a), (5, b), (5, a), (9, b), (None, a), (None, "alone " * 3), (None, "alone " * 3), (7, "")])).collect()
    assert sorted((str(r.doc_id), r.text) for r in left) == sorted([("5", a), ("5", b), ("7", ""), ("None", "alone " * 3)])
    assert simhash.one_of_each(docs([])).count() == 0


def test_very_long_texts_and_late_shingles(spark, docs, monkeypatch):
    from feedloom.llm import shingles

    monkeypatch.setattr(shingles, "FREQUENT", 1)
    long = [f"w{i}" for i in range(60000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:30000] + ["new"] + long[30000:])), (3, " ".join(long[:40000])), (4, " ".join(long[20000:]))]
    rows += [(10 + i, " ".join(f"s{j}" for j in range(i, i + 80))) for i in range(30)]  # neighbours share most, ends share nothing
    left = {r.doc_id for r in simhash.one_of_each(docs(rows)).collect()}
    assert left == {1, 3, 4, 10}


def test_batches_are_small_only_inside_the_block(spark):
    from feedloom.llm.scratch import BATCH_BYTES, BATCH_KEY, Scratch

    def rows(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows])], ["n"])

    before = spark.conf.get(BATCH_KEY, None)
    with Scratch(spark) as scratch:
        long = spark.range(400).coalesce(1).selectExpr("id", "repeat('x', 100000) AS t")
        most = scratch(long.mapInArrow(rows, "n long")).selectExpr("max(n)").first()[0]
    assert 1 <= most <= 2 * BATCH_BYTES // 100000
    assert spark.conf.get(BATCH_KEY, None) == before


def test_parities_never_exceed_the_difference_and_part_large_sets():
    from feedloom.llm.shingles import _differing, _parities

    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 40000, dtype=np.uint64)
    sets = [np.unique(base[a:b]) for a, b in ((0, 0), (0, 1), (0, 900), (0, 1024), (0, 1025), (100, 1300), (0, 9000), (500, 9500), (9000, 18000), (0, 40000), (4000, 40000))]
    pairs = list(itertools.product(range(len(sets)), repeat=2))
    got = _differing(*(pa.array([_parities(sets[p[k]]) for p in pairs], pa.binary()) for k in (0, 1)))
    differ = [len(np.setxor1d(sets[i], sets[j])) for i, j in pairs]
    assert all(g <= d and (g - d) % 2 == 0 for g, d in zip(got, differ))
    assert got[pairs.index((6, 8))] > (len(sets[6]) + len(sets[8])) / 9  # 9,000 shingles each, none shared: told apart
    assert list(_differing(pa.array([], pa.binary()), pa.array([], pa.binary()))) == []


def test_sets_of_a_frequent_shingle_meet_in_blocks(spark, monkeypatch):
    from feedloom.llm import shingles
    from feedloom.llm.scratch import SHUFFLE_KEY, Scratch

    monkeypatch.setattr(shingles, "FREQUENT", 5)
    monkeypatch.setattr(shingles, "BLOCK", 128 * 7)  # some dozen blocks, and rows wider than others
    rng = random.Random(5)
    base = [f"w{i}" for i in range(1100)]
    rows = [(0, "alone " * 3), (1, "")]
    for i in range(2, 70):  # most are further from one another than from the base, which is not there
        words = list(base[: rng.choice((60, 60, 70, 950, 1100))])
        for at in rng.sample(range(len(words)), len(words) // rng.choice((12, 20, 40, 80))):
            words[at] = f"own{i}x{at}"
        rows.append((i, " ".join(words)))

    def grams(t):
        w = t.split()
        return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or {tuple(w)}

    sets = [grams(t) for _, t in rows]
    want = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
            a, b = sorted((want[i], want[j]))
            want = [a if x == b else x for x in want]
    seen, near = [], shingles._near_in_blocks

    def noted(*args):
        out = near(*args).localCheckpoint()
        seen.append((args[0].groupBy("_h").count().selectExpr("sum(count * count)").first()[0] or 0, out.count()))
        return out

    monkeypatch.setattr(shingles, "_near_in_blocks", noted)
    with Scratch(spark) as scratch:
        assert spark.conf.get(SHUFFLE_KEY) == "true"
        named, pairs = shingles.similar_pairs(spark.createDataFrame(rows, "_doc long, _text string"), scratch)
        name = {r._doc: r._set for r in named.collect()}
        links = [(r.a, r.b) for r in pairs.collect()]
    got = {n: n for n in name.values()}
    for a, b in links:
        a, b = got[a], got[b]
        got = {n: a if r == b else r for n, r in got.items()}
    same = {(i, j) for i, j in itertools.combinations(name, 2) if got[name[i]] == got[name[j]]}
    assert same == {(i, j) for i, j in itertools.combinations(name, 2) if want[i] == want[j]}
    (all_rows, passed), = seen
    assert all_rows > 5000 and passed < all_rows / 20  # a pair is a row only if it may be similar
