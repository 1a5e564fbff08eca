"""Raking, templates, grades, languages, revisits: defined results for odd input, and plain versions."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedloom.llm import decontaminate, language, mixing, quality, warc, words


def test_words_and_windows(monkeypatch):
    monkeypatch.setattr(words, "STRETCH", 50)
    texts = ["Hello  wORLD\n é x", None, "", "   ", "a", "b\tc " * 50, "z" * 300, "Hello"]
    got = words.words_of(pa.array(texts))
    want = [(t or "").encode().lower().split() for t in texts]
    assert np.diff(got.bounds).tolist() == [len(w) for w in want]
    assert got.hashes.tolist() == [words.hash_of(w) for d in want for w in d]
    h, at = words.windows(got.hashes, got.bounds, 3)
    assert len(h) == sum(max(0, len(w) - 2) for w in want)
    assert words.words_of(pa.array(["x", "a b", "Hello"]).slice(1)).hashes.tolist() == [words.hash_of(w) for w in (b"a", b"b", b"hello")]


# ---- mixing

def test_raking_meets_given_targets(spark):
    rng = random.Random(1)
    cells = spark.createDataFrame([(f"s{a}", f"l{b}", f"t{c}", rng.randint(500, 5000)) for a in range(4) for b in range(3) for c in range(2)], "source string, lang string, topic string, tokens long")
    targets = {"source": {"s0": 1, "s1": 1, "s2": 2, "s3": 1}, "lang": {"l0": 3, "l1": 2, "l2": 2}, "topic": {"t0": 1, "t1": 1}}
    done = mixing.rake(cells, targets, budget=0.2, rounds=12)
    assert done.agg(F.max("rate")).first()[0] <= 1
    for r in mixing.shares(done).collect():
        want = targets[r.dimension]
        assert r.share == pytest.approx(want[r.value] / sum(want.values()), abs=1e-3)


def test_mix_odd_rows(spark, docs):
    rows = [(i, "some words here " * (i % 7), "en" if i % 3 else None, "big" if i % 2 else None) for i in range(200)]
    rows += [(5, None, "en", "big"), (5, None, "en", "big"), (None, "License text", "de", "s"), (None, None, None, None)]
    got = mixing.mix(docs(rows).drop("_mix")).collect()
    assert len(got) == len(rows)
    assert all(r._mix.kept is not None and 0 <= r._mix.rate <= 1 for r in got)
    assert len({r._mix.kept for r in got if r.doc_id == 5 and r.text is None}) == 1
    assert mixing.mix(docs([])).count() == 0


# ---- templates

def plain_contaminated(doc, item):
    """Best alignment at one displacement, by going over all of them."""
    def cut(t):
        return [(x, c) for x in (t or "").split() if (c := decontaminate.token_id(x))]

    d, b = cut(doc), cut(item)
    w, best = decontaminate.WINDOW, None
    size = w if len(b) >= w else len(b)
    for shift in range(-len(b), len(d) + 1):
        at = [j for j in range(len(b) - size + 1) if size and 0 <= j + shift and j + shift + size <= len(d)
              and [c for _, c in b[j : j + size]] == [c for _, c in d[j + shift : j + shift + size]]
              and sum(c >= decontaminate.LITERAL for _, c in b[j : j + size]) >= decontaminate.LEAST_LITERALS]
        covered = {k for j in at for k in range(j, j + size)}
        pairs = {(f"{c}{b[k][0].strip(decontaminate._EDGE)}", f"{c}{d[k + shift][0].strip(decontaminate._EDGE)}") for k in covered if (c := b[k][1]) < decontaminate.LITERAL}
        ok = len({x for x, _ in pairs}) == len(pairs) == len({y for _, y in pairs})
        if ok and b and len(covered) >= decontaminate.COVERAGE * len(b) and (best is None or len(covered) / len(b) > best):
            best = len(covered) / len(b)
    return best


ITEMS = [
    (1, "Alice has 12 apples and gives 5 apples to Bob before walking 3 km home."),
    (2, "the train from Oslo leaves at 9:30 and carries 4kg of mail to Oslo again today"),
    (3, "why is it so"), (4, ""), (5, None), (6, "Alice has 12 apples and gives 5 apples to Bob before walking 3 km home."), (7, "yes"),
]
TEXTS = [
    "intro words. Carol has 99 apples and gives 7 apples to Dave before walking 8 km home. end",  # other names and numbers
    "Carol has 99 apples and gives 7 apples to Carol before walking 8 km home.",  # one value for two
    "x y the train from Rome leaves at 8:15 and carries 3kg of mail to Rome again today z",
    "x y the train from Rome leaves at 8:15 and carries 3kg of mail to Pisa again today z",  # two values for one
    "nothing to see here at all, only plain words without any question",
    "Alice has 12 apples and gives 5", "so why is it so then", "", None, "yes",
]


def test_templates_against_brute_force(spark, docs):
    rows = list(enumerate(TEXTS)) + [(0, TEXTS[0]), (None, TEXTS[0])]
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 AS _id", "2 AS _text")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs(rows), bench).collect()}
    want = {(i, k): c for i, t in rows for k, q in ITEMS if k != 6 and (c := plain_contaminated(t, q)) is not None}
    assert set(got) == set(want) and {k: pytest.approx(r.coverage) for k, r in got.items()} == want
    assert (0, 1) in got and (1, 1) not in got and got[2, 2].coverage == 1 and got[0, 1].changed == 5
    kept = decontaminate.clean(docs(rows), bench).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(i) for i, _ in rows if not any(d == i for d, _ in got if d is not None))
    assert decontaminate.contaminated(docs([]), bench).count() == 0
    assert decontaminate.contaminated(docs(rows), bench.limit(0)).count() == 0


def test_items_of_one_template_are_all_found(spark, docs):
    ask = "the farmer buys {} eggs on monday and then sells {} eggs to the old mill on friday".format
    items = [(1, ask(12, 12)), (2, ask(12, 15)), (3, ask(3, 4)), (4, ask(12, 15))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, ask(12, 15)), (2, ask(7, 7)), (3, "well " + ask(3, 4))]
    got = {(r.doc_id, r.item_id): r.changed for r in decontaminate.contaminated(docs(rows), bench, repeats=True).collect()}
    # 12 -> 12 and 12 -> 15 would be two values for one
    assert got == {(1, 2): 0, (1, 3): 2, (1, 4): 0, (2, 1): 1, (3, 2): 2, (3, 3): 0, (3, 4): 2}
    assert decontaminate.clean(docs(rows), bench).count() == 0


def test_copies_without_enough_literals_are_found(spark, docs):
    items = [
        (1, "12 + 15 = 27 and 13 + 14 = 27 so 27 - 3 = 24"), (2, "The Great Fire Of London Began In Pudding Lane"), (3, "the red fox of Anna Berg met Carl Dahl near Lake Vern"),
        (4, "一个农民有十二个鸡蛋他卖掉了五个还剩几个"), (5, "yesterday Bob walked slowly past the mill and then over 5 km of sand"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [
        (1, "see " + items[0][1]), (2, items[1][1]), (3, items[1][1].upper()), (4, items[2][1].lower()), (5, "前面" + items[3][1] + "。"),
        (6, "yesterday Mary Ann walked slowly past the mill and then over 7km of sand"), (7, "12 + 15 and 3"), (8, "The Great Mill Of Bergen Began In Old Lane"),
    ]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs(rows), bench).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 2), (4, 3), (5, 4), (6, 5)}
    assert got[3, 2].coverage == got[5, 4].coverage == got[6, 5].coverage == 1 and got[6, 5].changed == 2


# ---- grades

def test_grades_follow_ratings(spark, docs):
    rng = random.Random(2)
    plain = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(360):
        text = rng.choices(plain, k=60)
        kind = i % 3
        if kind == 0:
            text[rng.randrange(60)] = "nastyword"
        if kind == 1:
            text = [w + "***" for w in text]
        rows.append((i, " ".join(text)))
        labels.append((i, int(kind != 1), int(kind == 0)))
    labels += [(1, None, 0), (None, 1, 0), (10**6, 1, 1)]
    rows += [(900, None), (901, ""), (902, "word1 " * 300_000), (None, "word5 word6")]
    rated = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.train(docs(rows), rated)
    got = quality.scored(docs(rows), model).collect()
    assert len(got) == len(rows)
    right = [r._quality.kept == (r.doc_id % 3 == 2) for r in got if r.doc_id is not None and r.doc_id < 360]
    assert np.mean(right) > 0.9
    assert np.all(np.diff(model.thresholds) > 0)
    assert all(0 <= r._quality.tail_probability <= 1 and 0 <= r._quality.expected_grade <= 2 for r in got)
    assert quality.train(docs(rows), rated.limit(0)) is None
    assert all(r._quality.kept for r in quality.scored(docs(rows), None).collect())


def test_held_out_grades(spark):
    sf = "/root/testdata/sf0.1"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(d, labels.where("doc_id % 4 <> 0"))
    held = quality.scored(d.join(quality.rated(labels), F.col("doc_id") == F.col("_id")).where("doc_id % 4 = 0"), model)
    good = [r._quality.kept for r in held.where("_grade = 2").collect()]
    poor = [r._quality.kept for r in held.where("_grade < 2").collect()]
    assert np.mean(good) >= 0.98 and np.mean(poor) <= 0.2


# ---- languages

def test_kneser_ney_sums_to_one():
    texts = ["abracadabra", "banana band", "cab ban"]
    g = language.grams(*language.codes(texts))
    _, at, n = np.unique(language._key(g), return_index=True, return_counts=True)
    levels, floor = language.build(g[:, at], n.astype(float))
    letters = sorted({int(c) for c in g[-1]})
    for context in ([32, 32, 32], [97, 98, 114], [120, 121, 122], [32, 98, 97]):
        every = np.array([[*context, c] for c in letters], dtype=np.uint64).T
        p = language.probability(levels, floor, every).sum()
        assert p == pytest.approx(1 - floor * _unseen(levels, context), abs=1e-9)


def _unseen(levels, context):
    """Weight that reaches the even share: the product of the back-off weights of the context's suffixes."""
    w = 1.0
    for order, level in enumerate(levels, 1):
        tail = np.array([[c] for c in context[len(context) - order + 1 :]], dtype=np.uint64).reshape(order - 1, 1)
        w *= float(language._find(level.contexts, level.gamma, language._key(tail), 1.0)[0])
    return w


def test_languages(spark, docs):
    rows = [(i, "the quick brown fox and the dog " * (1 + i % 3), "en") for i in range(40)] + [(100 + i, "der schnelle braune fuchs und hund " * (1 + i % 4), "de") for i in range(40)]
    rows += [(200, None, "en"), (201, "", "de"), (202, "123 ... 456", "en"), (203, "the dog and the fox", None), (None, "und der hund", None), (204, "the fox " * 200_000, None)]
    models = language.train(docs(rows))
    got = {r.doc_id: r._language for r in language.identify(docs(rows), models).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang_pred == "en" for i in range(40)) and all(got[100 + i].lang_pred == "de" for i in range(40))
    assert [got[i].lang_pred for i in (200, 201, 202, 203, None, 204)] == ["und", "und", "und", "en", "de", "en"]
    assert got[200].score == 0 and all(0 <= x.score <= 1 for x in got.values())
    none = language.train(docs([(1, None, "en"), (2, "x", None)]))
    assert none is None
    assert [r._language.lang_pred for r in language.identify(docs([(1, "abc")]), none).collect()] == ["und"]
    assert language.identify(docs([]), models).count() == 0


def test_held_out_languages(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = [r for r in language.op4_language(spark, sf).collect() if r.held_out]
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in got]) > 0.97


# ---- revisits

RECORDS = "record_id long, url string, t long, kind string, etag string, last_modified string, headers array<struct<name:string,value:string>>"


def records(spark, rows):
    return spark.createDataFrame(rows, RECORDS).selectExpr("*", "timestamp_seconds(t) AS fetched_at", "'x' AS _ref", "'y' AS _me")


def test_revisits(spark):
    H = [("Date", "1"), ("Content-Type", "a"), ("X", "full")]
    N = [("date", "2"), ("Content-Length", "0"), ("X", "new"), (None, "q")]
    rows = [
        (1, "http://www.A.com:80/p/?b=2&a=1&utm_source=x#f", 100, "response", '"e1"', "m1", H),
        (2, "https://a.com/p?a=1&b=2", 200, "revisit", 'W/"e1"', None, N),  # weak comparison
        (3, "a.com/p", 300, "revisit", None, None, N),  # no URL: another resource
        (4, "http://a.com/p?a=1&b=2", 300, "response", '"e2"', "m2", H),
        (5, "http://a.com/p?a=1&b=2", 400, "revisit", '"e1"', "m2", N),  # the latest is another version
        (6, "http://a.com/p?a=1&b=2", 400, "revisit", None, "m2", N),  # by time
        (7, "http://a.com/p?a=1&b=2", 401, "revisit", None, None, None),
        (8, "http://a.com/p?a=1&b=2", 100, "revisit", '"e1"', None, None),  # same time, later id
        (0, "http://a.com/p?a=1&b=2", 100, "revisit", '"e1"', None, None),  # same time, earlier id
        (9, None, 500, "revisit", None, None, None), (10, "http://b.org/", None, "revisit", "x", None, None),
        (2, "https://a.com/p?a=1&b=2", 200, "revisit", 'W/"e1"', None, N),  # repeated
    ]
    got = warc.resolve_revisits(records(spark, rows)).collect()
    outcome = sorted((r.record_id, r.outcome, r.refers_to) for r in got if r.record_id not in (9, 10))
    assert outcome == [
        (0, "missing", None), (2, "resolved", 1), (2, "resolved", 1), (3, "missing", None), (5, "mismatch", 4), (6, "resolved", 4), (7, "unvalidated", 4), (8, "resolved", 1),
    ]
    assert sorted((r.record_id, r.outcome) for r in got if r.record_id in (9, 10)) == [(9, "missing"), (10, "missing")]
    merged = next(r for r in got if r.record_id == 2)
    assert sorted((h.name, h.value) for h in merged.headers) == [("content-type", "a"), ("date", "2"), ("x", "new")]
    assert warc.resolve_revisits(records(spark, [])).count() == 0


def test_hot_address_over_many_days(spark):
    rng = random.Random(4)
    rows = [(i, "http://hot.org/x", rng.randrange(40 * 86400), rng.choice(["response", "revisit", "revisit"]), f'"{rng.randrange(2)}"', None, None) for i in range(1500)]
    got = {r.record_id: (r.outcome, r.refers_to) for r in warc.resolve_revisits(records(spark, rows)).collect()}
    full = sorted((r[2], r[0], r[4]) for r in rows if r[3] == "response")
    for r in rows:
        if r[3] == "revisit":
            before = [f for f in full if (f[0], f[1]) < (r[2], r[0])]
            want = ("missing", None) if not before else ("resolved" if before[-1][2] == r[4] else "mismatch", before[-1][1])
            assert got[r[0]] == want


def test_clean_reads_texts_in_small_batches(spark, docs, monkeypatch):
    from feedloom.llm import scratch

    seen, windows_of = [], decontaminate._windows_of
    monkeypatch.setattr(decontaminate, "_windows_of", lambda *a: seen.append(spark.conf.get(scratch.BATCH_KEY)) or windows_of(*a))
    before = spark.conf.get(scratch.BATCH_KEY)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.clean(docs(list(enumerate(TEXTS))), bench).count() < len(TEXTS)
    assert seen and set(seen) == {str(scratch.BATCH_BYTES)} and spark.conf.get(scratch.BATCH_KEY) == before
