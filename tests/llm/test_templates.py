import random

import pyarrow as pa

from feedloom.llm import decontaminate
from feedloom.llm.words import hash_of, word_hash

WORDS = "river stone field paper window garden winter letter market engine bottle mirror ladder candle saddle copper meadow harbor kettle basket valley pillow ribbon thunder".split()


def test_words_are_read_as_one_by_one():
    rng = random.Random(1)
    parts = ["a", "B", "é", "É", "ß", "×", "Ø", "“", "”", "«", "-", "+", "$", "5", "7", ".", ",", "km", " ", "　", "東", "\x1c", " ", " ", "İ", "Ж", "ж", "%", "€", "…", "_", "Ünder", "12km", "µ", "x\x1fy"]
    texts = [None, "", " \n"] + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(500)]
    batch = decontaminate._Batch(pa.array(texts, pa.string()))
    want = [[(w, c) for w in (t or "").split() if (c := decontaminate.token_id(w))] for t in texts]
    assert [len(w) for w in want] == [b - a for a, b in zip(batch.bounds, batch.bounds[1:])]
    flat = [x for w in want for x in w]
    assert batch.codes.tolist() == [c for _, c in flat]
    assert [batch.word(i).strip(decontaminate._EDGE) for i in range(len(flat))] == [w.strip(decontaminate._EDGE) for w, _ in flat]
    assert all(word_hash(w.encode()) == hash_of(w, lower=False) for w in ("a", "é", "longer-word", "x" * 90))


def test_copies_with_words_more_or_less(spark, docs):
    bench = spark.createDataFrame([(1, " ".join(WORDS))], "item_id long, text string")

    def with_more(*at):
        return " ".join(w for i, x in enumerate(WORDS) for w in (["extra", x] if i in at else [x]))

    rows = [
        (1, " ".join(WORDS)), (2, with_more(12)), (3, with_more(8, 16)), (4, with_more(6, 12, 18)), (5, " ".join(WORDS[:11] + WORDS[12:])),
        (6, "so " * 4000 + with_more(12) + " and" * 4000), (None, with_more(12)), (7, " ".join(WORDS[:9])), (8, " ".join(WORDS[:8]) + " other" * 30 + " " + " ".join(WORDS[16:])),
        (9, " ".join(WORDS[12:] + WORDS[:12])), (10, None), (10, " ".join(WORDS)), (10, "nothing of it"),
    ]
    found = {r.doc_id: r.coverage for r in decontaminate.contaminated(docs(rows), bench).collect()}
    assert set(found) == {1, 2, 3, 4, 5, 6, None, 10} and found[2] == found[3] == 1
    left = decontaminate.clean(docs(rows + [(None, "harmless")]), bench).collect()
    assert sorted((str(r.doc_id), r.text) for r in left if r.doc_id != 10) == sorted((str(i), t) for i, t in [*rows[7:10], (None, "harmless")])
    assert sorted(str(r.text) for r in left if r.doc_id == 10) == ["None", "nothing of it"]
