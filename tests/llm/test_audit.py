import re
from fractions import Fraction
from itertools import permutations
from math import factorial

from feedloom.llm import audit

LABELS = "doc_id long, quality int, toxic int"


def _plain(rows, labels):
    """The audit by walking every order over every document."""
    docs = [(i, s or "", t or "") for i, t, _, s in rows]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    fails = []
    for i, part, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        f = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}
        f["E"] = i is not None and any(j is not None and j < i and t == text for j, _, t in docs)
        fails.append((part, i in good, i in toxic, {x for x in f if f[x]}))
    out = {}
    for part in {p for p, *_ in fails}:
        own = [x for x in fails if x[0] == part]
        shares = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = list(own)
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[3]]
                left = [d for d in left if x not in d[3]]
                failing = sum(x in d[3] for d in own)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(d[3] == {x} for d in own), sum(d[1] for d in gone), sum(d[2] for d in gone)]
                shares[x] += len(gone)
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shares[order[step - 1]])
    return out


def test_shares_equal_the_permutation_formula():
    for m in (2, 3, 5):
        weights = audit.share_weights(m)
        for i in range(m):
            for s in range(1 << m):
                size = s.bit_count()
                if s >> i & 1:
                    want = Fraction(factorial(size - 1) * factorial(m - size), factorial(m))
                else:
                    want = -Fraction(factorial(size) * factorial(m - size - 1), factorial(m))
                # v of no players is zero by itself, so the fit gives it no weight
                assert weights[i][s] == (want if s else 0)


def test_audit_equals_walking_every_order(spark, docs):
    long = " ".join(f"w{i}" for i in range(210))
    rows = [
        (5, long, "en", "a"), (3, long, "en", "b"), (9, long, "en", "a"), (9, long, "en", "a"), (None, long, "en", "a"), (None, None, None, None),
        (1, "", "en", "a"), (2, None, "en", None), (4, "same " * 300, "en", "a"), (6, "Loud " * 300, "en", ""), (7, long + " #", "en", "a"),
        (8, "ÄÖ é\x0bü\x85x y " * 120, "de", "c"), (10, " ".join(f"Up{i} |" for i in range(20000)), "en", "c"), (11, "\n\t ", "en", "c"),
    ]
    labels = [(5, 1, 0), (9, 1, 1), (9, None, None), (4, 0, 1), (None, 1, 1), (77, 1, 1), (10, 1, 0)]
    got = audit.audit(docs(rows), spark.createDataFrame(labels, LABELS)).collect()
    assert {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in got} == _plain([(*r[:2], *r[2:]) for r in rows], labels)
    assert len(got) == 600 * 4


def test_audit_of_nothing(spark, docs):
    none = spark.createDataFrame([], LABELS)
    assert audit.audit(docs([(1, "a", "en", "s")]).where("false"), none).count() == 0
    assert {r["kept"] for r in audit.audit(docs([(1, "a", "en", "s")]), none).where("step = 5").collect()} == {0}
