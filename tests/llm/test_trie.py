import hashlib
import random
import re
import zlib

import pytest

from feedloom.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def _plain(rows):
    turns = {}
    for c, t, r, x in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [v[2:] for v in sorted(ts)] for c, ts in turns.items()}
    whole = {}
    for c, own in turns.items():
        h = (zlib.crc32(str(c).encode()) & 0xFFFFFFFF) % 4
        base = c - int(c - 20 * int(c / 20))
        whole[c] = turns.get(base, [])[:h] + own[h:]
    members = {}
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    out = []
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        childless = [q for q in below if not any(x[:-1] == q for x in members if len(x) == len(q) + 1)]
        saved = sum((len(members[q]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) if q else 0) for q in below)
        ended = ",".join(str(c) for c in sorted(c for c in cs if len(whole[c]) == len(p)))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), sum(len(q) == len(p) + 1 for q in below), len(childless), saved, hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=str)


def _found(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS _key", "'x' AS depth", "2 AS _conv").repartition(4)
    return sorted(map(tuple, trie.trie(df, **options).collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"subtree": 6, "levels": 2, "queue": 3}, {"subtree": 0, "levels": 3, "queue": 1}])
def test_equals_a_plain_trie(spark, options):
    rng = random.Random(7)
    rows = [(c, t, rng.choice(["user", "assistant"]) if t % 3 else "user", rng.choice(["a", "b c", "b  c\x0bd e", ""])) for c in range(-30, 60) if c % 7 for t in range(rng.randint(1, 7))]
    rows += [(c, t, "user", f"deep {t}") for c in (100, 101, 102) for t in range(12)]
    assert _found(spark, rows, **options) == _plain(rows)


def test_odd_rows(spark):
    rows = [
        (0, None, None, None), (0, None, "user", "b"), (0, 1, "user", "a"), (0, 1, "user", "a"), (0, 1, None, "c"), (None, 1, "user", "lost"), (1, 5, "x", "y " * 50000),
        (2, 1, "user", None), (2, 1, "user", ""), (41, 0, "user", "no base"), (-1, 3, "a", "b"), (-1, 2, "ab", ""),
    ]
    assert _found(spark, rows) == _plain(rows)
    assert trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_lists_of_ends_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 20)
    rows = [(c, 0, "user", "same") for c in range(0, 2000, 20)] + [(c, 0, "user", "same") for c in range(5, 300)]
    assert _found(spark, rows) == _plain(rows)


def test_queue_spills_and_sums():
    rng = random.Random(1)
    queue, want = trie.SpillingQueue(5, 3), {}
    for _ in range(200):
        key, amount = (rng.randint(-5, 5), str(rng.randint(0, 3))), rng.randint(0, 9)
        queue.push(key, amount, 1)
        a, b = want.get(key, (0, 0))
        want[key] = (a + amount, b + 1)
    assert queue.spilled > 0
    assert queue.pop((-9, "")) is None
    for key in sorted(want):
        if key[0] != 2:  # messages that nothing waits for are passed over
            assert tuple(queue.pop(key)) == want[key]
    assert queue.pop((9, "")) is None
