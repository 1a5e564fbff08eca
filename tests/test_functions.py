"""Text and number functions on literal inputs."""

import random
import unicodedata
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.functions import text as tx
from feedloom.functions.numbers import round2
from feedloom.operators import retrieval as rt


def values(spark, fn, inputs, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r["y"] for r in rows.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_round2_follows_the_binary_value(spark):
    xs = [2.675, 2.125, 1.005, 1.015, 3.335, 4.5, 0.125, 0.375, 0.0, 5.0, 2.665, 7.995]
    rng = random.Random(3)
    xs += [rng.randrange(1, 2000) / rng.randrange(1, 400) % 8 for _ in range(3000)]
    assert values(spark, round2, xs, "double") == [round(x, 2) for x in xs]


def test_bullets_and_cleaning(spark):
    cases = {
        "\ufffd Bring a lamp.": "Bring a lamp.",
        "packing\n\ufffd two ropes\n\ufffd dry socks": "packing; two ropes; dry socks",
        "Packing:\n• ropes\n• socks": "Packing: ropes; socks",
        "- Cold\n- No stove": "Cold; No stove",
        "thick soup • thin tea ● old bread": "thick soup; thin tea; old bread",
        "They won\ufffdt climb": "They won't climb",
        "The wall is steep - but dry": "The wall is steep - but dry",
        "the moun- tain": "the mountain",
    }
    assert values(spark, tx.clean_text, list(cases)) == list(cases.values())


def test_noise_and_questions(spark):
    noise = ["12.50% |", "1-2 days 40 8.25%", "Fair n=9 av.=.5 md= dev.=1.2", "0 - Cold, 1 - Mild, 2 - Hot", "Page 12 of 40", "Poor Fair Excellent", "Disagree/N/Agree", "n/about right", "n/a", "NA dna M"]
    plain = ["Too steep!", "The view was wide.", "n/gree", "Disagree/N/Agreed"]
    assert values(spark, tx.is_noise, noise + plain) == [True] * len(noise) + [False] * len(plain)
    prompts = ["3. Please list all of the huts where you found the stove broken.", "Please describe the paths that you would take again and those that you would not. (maximum 900 characters)", "Comments: -"]
    others = ["Hut wardens: soup and bread ran out too early.", "The view was wide."]
    assert values(spark, tx.is_question, prompts + others) == [True] * 3 + [False] * 2
    long_scale = "poor excellent " * 20_000  # a printed scale of any length must not exhaust the regex stack
    assert values(spark, tx.is_noise, [long_scale, long_scale + "x"]) == [True, False]


def test_parsing(spark):
    assert values(spark, tx.parse_score, ["grade 2!", "none", "NA", "37", "", None]) == [2, None, None, None, None, None]
    numbers = [6.5, -4.0, 2.9, None, float("nan"), float("inf"), float("-inf"), 1e12, -1e300]
    assert values(spark, tx.parse_score_number, numbers, "double") == [5, 1, 2, None, None, 5, 1, 5, 1]
    assert values(spark, tx.parse_confidence, ["35%", "90", "0.25", "null", None]) == [0.35, 0.9, 0.25, 0.0, 0.0]
    assert values(spark, tx.clamp_score_default, ["11", "-7", "2.0", "?", None, "9" * 30]) == [5, 1, 3, 3, 3, 5]
    assert values(spark, tx.integer_score_only, ["3", "2.0", "2.5", "", "1e12", "-1e300", "NaN", "Infinity"]) == [3, 2, None, None, None, None, None, None]


def test_unicode_folding_matches_the_standard(spark):
    chars = [chr(c) for c in range(0x80, 0x3000) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Mn", "Mc", "Me")]
    chars += ["ﬁ", "①", "Ｆ", "𝐀", "½", "…", "é", "ño"]
    want = [unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode() for c in chars]
    assert values(spark, tx.nfkd_ascii, chars) == want
    assert values(spark, tx.nfkc, chars) == [unicodedata.normalize("NFKC", c) for c in chars]


def test_terms_sort_in_calendar_order(spark):
    terms = ["Fall 2031", "Spring 2031", "F30", "Winter 2032", None, "Summer 2031"]
    rows = spark.createDataFrame([(t,) for t in terms], "term string")
    got = [r["term"] for r in rows.orderBy(tx.term_sort_key(F.col("term"))).collect()]
    assert got == ["F30", "Spring 2031", "Summer 2031", "Fall 2031", "Winter 2032", None]


def brute_similarity(a, b, ta, tb):
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    common = len(ta & tb)
    tokens = 0.55 * common / min(len(ta), len(tb)) + 0.25 * common / len(ta | tb) if ta and tb else 0.0
    return tokens + 0.20 * SequenceMatcher(None, a, b).ratio()


@pytest.mark.parametrize("chunk", [20_000, 7])
def test_topk_examples_equals_brute_force(spark, monkeypatch, chunk):
    """Also with the examples cut into several chunks."""
    monkeypatch.setattr(rt, "CHUNK_ROWS", chunk)
    rng = random.Random(5)
    words = "exam pace slide notes lab clear fast slow quiz essay group talk week point grade".split()
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(0, 7)))
    comments = [(i, text()) for i in range(60)] + [(60, "zzz qqq"), (61, "xyz")]
    examples = [(i, text(), 1 + i % 3, 3) for i in range(25)] + [(25, "zzz zqq", 1, 3), (26, "", 1, 3)]
    c = spark.createDataFrame(comments, "ord bigint, text string")
    e = spark.createDataFrame(examples, "ex_id bigint, feedback string, topic_no int, score int")
    got = {}
    for r in rt.topk_examples(c, e, 3).collect():
        got.setdefault(r["ord"], []).append((r["rank"], r["ex_id"], r["similarity"]))
    stop = set(tx.dims.STOP_WORDS)
    tok = lambda t: {w for w in t.split() if len(w) > 2 and w not in stop}
    for i, t in comments:
        scored = [(brute_similarity(t, f, tok(t), tok(f)), x) for x, f, _, _ in examples if f != t]
        best = sorted([s for s in scored if s[0] >= 0.06], key=lambda s: (-s[0], s[1]))[:3]
        have = sorted(got.get(i, []))
        assert [x for _, x, _ in have] == [x for _, x in best], t
        assert [s for _, _, s in have] == pytest.approx([s for s, _ in best], abs=1e-3)


def greedy(pairs, n):
    used, out = set(), {}
    for b in range(n):
        best = sorted((-s, p) for bb, p, s in pairs if bb == b and p not in used)
        if best:
            out[b] = best[0][1]
            used.add(best[0][1])
    return out


@pytest.mark.parametrize("seed", range(4))
def test_one_to_one_matching_equals_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    pairs = sorted({(rng.randrange(12), rng.randrange(12), rng.choice([0.8, 0.9, 1.0])) for _ in range(50)})
    pairs = list({(b, p): (b, p, s) for b, p, s in pairs}.values())
    df = spark.createDataFrame(pairs, "b_idx bigint, p_idx bigint, similarity double")
    assert {r["b_idx"]: r["p_idx"] for r in rt.match_one_to_one(df).collect()} == greedy(pairs, 12)


def test_similar_pairs_equal_brute_force(spark):
    from feedloom.functions.matching import text_match

    rng = random.Random(9)
    words = "exam pace slide notes lab clear fast slow".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 6))) for _ in range(40)]
    texts[21:25] = [texts[1]] * 4  # copies
    b = spark.createDataFrame(list(enumerate(texts[:20])), "b_idx bigint, text string")
    p = spark.createDataFrame(list(enumerate(texts[20:])), "p_idx bigint, text string")
    got = {(r["b_idx"], r["p_idx"]): r["similarity"] for r in rt.similar_pairs(b, p).collect()}
    want = {(i, j): text_match(x, y) for i, x in enumerate(texts[:20]) for j, y in enumerate(texts[20:])}
    assert got == {k: v for k, v in want.items() if v >= 0.8}


def plain_text_match(left, right):
    if not left or not right:
        return 0.0
    if left in right or right in left:
        return 1.0
    short, long_ = (left, right) if len(left) <= len(right) else (right, left)
    pairs = ((left, right), (short, long_[: len(short)]), (short, long_[-len(short) :]))
    return max(SequenceMatcher(None, a, b).ratio() for a, b in pairs)


def test_text_match_and_its_bounds():
    from feedloom.functions import matching

    rng = random.Random(2)
    for _ in range(3000):
        a = "".join(rng.choice("abc é") for _ in range(rng.randrange(0, 25)))
        b = "".join(rng.choice("abc é") for _ in range(rng.randrange(0, 25))) if rng.random() < 0.3 else "".join(c for c in a if rng.random() > 0.1) + rng.choice(["", "x", "xyz"])
        assert matching.text_match(a, b) == plain_text_match(a, b)
        if a and b and matching.text_match(a, b) >= 0.8:
            tables = (np.array([f(b)]) for f in (matching.character_counts, matching.bigram_counts))
            assert list(matching.could_match(a, *tables, np.array([len(b)]), 0.8)) == [0]


def plain_match(benchmark, predictions):
    used, out = set(), {}
    for b, t in benchmark:
        best = (0.0, None)
        for p, x in predictions:
            if p not in used and plain_text_match(t, x) > best[0]:
                best = (plain_text_match(t, x), p)
        if best[0] >= 0.8:
            used.add(best[1])
        out[b] = (best[0] >= 0.8, best[1], best[0])
    return out


@pytest.mark.parametrize("block", [2_000, 3])
def test_match_report_equals_the_sequential_rule(spark, monkeypatch, block):
    monkeypatch.setattr(rt, "CHUNK_ROWS", block)
    rng = random.Random(block)
    words = "exam pace slide notes lab clear fast slow".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 6))) for _ in range(36)] + ["", "zz"]
    texts[21:27] = [texts[1]] * 6  # more copies of one text than the benchmark has
    texts[3] = texts[4] = texts[1]
    b, p = list(enumerate(texts[:16] + ["", "qqqq", "xx"])), list(enumerate(texts[16:]))
    got = rt.match_report(spark.createDataFrame(b, "b_idx bigint, text string"), spark.createDataFrame(p, "p_idx bigint, text string")).collect()
    assert {r["b_idx"]: (r["matched"], r["p_idx"], r["similarity"]) for r in got} == plain_match(b, p)


def test_topk_examples_of_many_copies(spark):
    c = spark.createDataFrame([(i, "slow pace exam") for i in range(200)] + [(200, "pace of the exam")], "ord bigint, text string")
    e = spark.createDataFrame([(i, "exam pace", 1, 3) for i in range(50)] + [(99, "slow pace exam", 1, 3)], "ex_id bigint, feedback string, topic_no int, score int")
    got = rt.topk_examples(c, e, 3).collect()
    assert len(got) == 201 * 3
    assert {(r["ex_id"], r["rank"]) for r in got if r["ord"] < 200} == {(0, 1), (1, 2), (2, 3)}
    both = rt.topk_examples(c, e, 3, skip_equal=False).where("ord = 7").collect()
    assert sorted((r["rank"], r["ex_id"], r["similarity"]) for r in both)[0] == (1, 99, 1.0)
