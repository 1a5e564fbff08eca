import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from feedloom.llm import sharding


def insert_all(rows, limit):
    """Extendible hashing by insertion: split a bucket that is too large until it fits or holds one row."""
    def bits(k):
        return format(int(hashlib.md5(str("" if k is None else k).encode()).hexdigest()[:15], 16), "060b")

    buckets = {"": []}
    for k, size in rows:
        b = bits(k)
        at = next(b[:d] for d in range(61) if b[:d] in buckets)
        buckets[at].append((b, size))
        todo = [at]
        while todo:
            p = todo.pop()
            if sum(s for _, s in buckets[p]) > limit and len(buckets[p]) > 1:
                own = buckets.pop(p)
                for c in "01":
                    buckets[p + c] = [x for x in own if x[0][len(p)] == c]
                    todo.append(p + c)
    return buckets, bits


def test_equals_insertion(spark, docs):
    rows = [(i, "x" * (7 * i % 90)) for i in range(400)] + [(900, "y" * 5000), (901, ""), (902, None)]
    got = sharding.assign_shards(docs(rows), "doc_id", F.octet_length("text"), 600).collect()
    assert len(got) == len(rows)
    buckets, bits = insert_all([(i, len(t or "")) for i, t in rows], 600)
    sizes, counts = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.shard] += len(r.text or "")
        counts[r.shard] += 1
        assert bits(r.doc_id).startswith(r.shard) and len(r.shard) == r.depth
        assert r.shard in buckets
    for r in got:
        assert (r.shard_bytes, r.shard_rows) == (sizes[r.shard], counts[r.shard])
        assert r.shard_bytes <= 600 or r.shard_rows == 1
        assert r._id == "x" and r._in == "x"


def test_hot_key_is_spread_and_rows_are_kept(spark, docs):
    rows = [(5, "same text")] * 300 + [(None, "z" * 40)] * 50 + [(6, "b")]
    got = sharding.assign_shards(docs(rows), "doc_id", F.octet_length("text"), 200).collect()
    assert len(got) == len(rows)
    assert all(r.shard_bytes <= 200 or r.shard_rows == 1 for r in got)
    assert len({r.shard for r in got if r.doc_id == 5}) > 10


def test_empty_and_single(spark, docs):
    assert sharding.assign_shards(docs([]), "doc_id", F.octet_length("text"), 10).count() == 0
    one = sharding.assign_shards(docs([(1, "abc")]), "doc_id", F.octet_length("text"), 10).first()
    assert (one.shard, one.depth, one.shard_bytes, one.shard_rows) == ("", 0, 3, 1)


def test_directory_covers_all_slots(spark, docs):
    placed = sharding.assign_shards(docs([(i, "x" * 30) for i in range(200)]), "doc_id", F.octet_length("text"), 300)
    slots = sharding.directory(placed).collect()
    deepest = max(len(r.shard) for r in slots)
    assert len(slots) == len({r.slot for r in slots}) == 2**deepest
    assert all(r.slot.startswith(r.shard) and len(r.slot) == deepest for r in slots)
