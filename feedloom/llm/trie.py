"""Prefix trie of conversations with subtree totals by time-forward processing.

A node is a distinct sequence of first turns. It is named by its depth and the running sum of 90-bit hashes of (position, role,
text), so names of all prefixes of a conversation come from sums over blocks of turns, however long it is.

Totals travel towards the root: nodes are sorted by reverse level order, and each sends its totals forward to its parent through a
priority queue in that order, which writes sorted runs to a file of its task when it is full (private to the task and gone with
it, as Spark's own spills are). Shards keep this local. A node below which there are ``SUBTREE`` turns or fewer is light: the
highest light node on a path roots a shard, which holds its whole subtree, and hands its totals on as one message. Messages to a
node are summed before they meet it. What is left, the nodes above, is cut into bands of ``LEVELS`` levels: a first pass totals each
band by itself, a second one passes totals across the band tops, and a third repeats the bands with what their lower bands sent.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.operators.ordered import block_of, row_numbers, running_sum
from feedloom.operators.stages import written

GROUP = 20  # conversations that are rebuilt from the first of them
HEADS = 4  # the first 0 to HEADS - 1 turns are copied
SUBTREE = 20_000
LEVELS = 4_096
QUEUE = 200_000  # messages that a queue holds in memory
PIECE = 1 << 16  # bytes of a piece of a list of ids
ROOT = "0.0"
_WORD = r"[^\x20\x09-\x0D]+"


class SpillingQueue:
    """Messages (key, *amounts) in order of their keys; equal keys come out as one sum. Beyond ``most`` messages in memory,
    they are written as a sorted run, of which one block at a time is read back."""

    def __init__(self, most: int = QUEUE, block: int = 4096):
        self.most, self.block = most, block
        self.held: list[tuple] = []
        self.heads: list[tuple] = []  # (first message of a run, number of the run)
        self.runs: list = []
        self.spilled = 0

    def push(self, key: tuple, *amounts: int) -> None:
        heapq.heappush(self.held, (key, *amounts))
        if len(self.held) > self.most:
            self._spill()

    def _spill(self) -> None:
        file = tempfile.TemporaryFile()
        self.held.sort()
        for i in range(0, len(self.held), self.block):
            pickle.dump(self.held[i : i + self.block], file)
        self.spilled += len(self.held)
        self.held = []
        file.seek(0)
        self.runs.append((self._read(file), file))
        self._advance(len(self.runs) - 1)

    @staticmethod
    def _read(file):
        while True:
            try:
                yield from pickle.load(file)
            except EOFError:
                file.close()
                return

    def _advance(self, run: int) -> None:
        message = next(self.runs[run][0], None)
        if message is not None:
            heapq.heappush(self.heads, (message, run))

    def pop(self, key: tuple) -> list[int] | None:
        """The sums of the messages to ``key``; messages to smaller keys, which nothing waits for, are dropped."""
        total = None
        while True:
            inside, outside = self.held and self.held[0][0] <= key, self.heads and self.heads[0][0][0] <= key
            if not inside and not outside:
                return total
            if inside and (not outside or self.held[0] <= self.heads[0][0]):
                message = heapq.heappop(self.held)
            else:
                message, run = heapq.heappop(self.heads)
                self._advance(run)
            if message[0] == key:
                total = [a + b for a, b in zip(total, message[1:])] if total else list(message[1:])

    def close(self) -> None:
        for _, file in self.runs:
            file.close()


_NODE = "_shard string, _depth long, _key string, _parent string, _conv long, _n long, _leaves long, _saved long, _kids long"


def forward(nodes: DataFrame, queue: int = QUEUE) -> DataFrame:
    """``nodes`` (columns as in ``_NODE``) with ``_leaves``, ``_saved`` summed over the subtree within the shard and ``_kids`` over
    the children within the shard, beside what they had before."""

    def run(batches):
        waiting, shard = None, None
        for batch in batches:
            columns = batch.to_pydict()
            sums = ([], [], [])
            for s, depth, key, parent, *own in zip(*(columns[c] for c in ("_shard", "_depth", "_key", "_parent", "_leaves", "_saved", "_kids"))):
                if s != shard:
                    if waiting:
                        waiting.close()
                    waiting, shard = SpillingQueue(queue), s
                for total, a, b in zip(sums, own, waiting.pop((-depth, key)) or (0, 0, 0)):
                    total.append(a + b)
                if parent is not None:
                    waiting.push((1 - depth, parent), sums[0][-1], sums[1][-1], 1)
            yield pa.record_batch([*batch.columns[:6], *[pa.array(x, pa.int64()) for x in sums]], batch.schema.names)
        if waiting:
            waiting.close()

    ordered = nodes.select(*[x.split()[0] for x in _NODE.split(", ")]).repartition("_shard").sortWithinPartitions("_shard", F.col("_depth").desc(), "_key")
    return ordered.mapInArrow(run, _NODE)


def rebuilt(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """((_conv, _pos, _len, _h1, _h2, _words) per rebuilt turn, (_conv, _len) per rebuilt conversation)."""
    order = ["_conv", F.col("_turn").asc_nulls_first(), "_role", "_text"]
    rows = conversations.select(
        F.col(conv).cast("long").alias("_conv"), F.col(turn).alias("_turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("_role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"),
    ).where("_conv IS NOT NULL")
    # the texts move once; after that a turn is its hashes and its place in the whole order
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "_conv", F.monotonically_increasing_id().alias("_at"), F.xxhash64("_role", "_text").alias("_h1"),
        F.xxhash64(F.lit(1), "_text", "_role").alias("_h2"), F.regexp_count("_text", F.lit(_WORD)).cast("long").alias("_words"),
    )
    own = row_numbers(written(rows), ["_conv"], ["_at"], F.shiftright("_at", 33), "_ord", "_own_len").drop("_at")
    head = F.crc32(F.col("_conv").cast("string").cast("binary")) % HEADS
    own = written(own.withColumn("_base", F.col("_conv") - F.col("_conv") % GROUP).withColumn("_h", head))
    heads = own.where("_ord = 1").select("_conv", "_base", "_h", "_own_len")
    bases = heads.where("_conv = _base").select("_base", F.least(F.col("_own_len"), F.lit(HEADS - 1)).alias("_has"))
    is_base, taken = F.col("_conv") == F.col("_base"), F.least(F.col("_h"), F.coalesce("_has", F.lit(0)))
    length = F.when(is_base, F.col("_own_len")).otherwise(taken + F.greatest(F.col("_own_len") - F.col("_h"), F.lit(0)))
    heads = written(heads.join(bases, "_base", "left").select("_conv", "_base", "_h", length.alias("_len")))
    place = F.when(is_base, F.col("_ord")).otherwise(taken + F.col("_ord") - F.col("_h"))
    kept = own.where(is_base | (F.col("_ord") > F.col("_h"))).join(bases, "_base", "left")
    kept = kept.select("_conv", place.alias("_pos"), length.alias("_len"), "_h1", "_h2", "_words")
    first = own.where(is_base & (F.col("_ord") < HEADS)).select("_base", F.col("_ord").alias("_pos"), "_h1", "_h2", "_words")
    # GROUP - 1 conversations at most take the turns of one
    copied = heads.where("_conv <> _base").join(first, "_base").where("_pos <= _h").select("_conv", "_pos", "_len", "_h1", "_h2", "_words")
    return kept.unionByName(copied), heads.select("_conv", "_len")


def _paths(turns: DataFrame, heads: DataFrame) -> DataFrame:
    """(_conv, _depth, _len, _key, _parent, _words): each conversation's nodes from the root on."""
    part = [F.xxhash64(*c).bitwiseAND((1 << 45) - 1).cast("decimal(28,0)") for c in (("_pos", "_h1", "_h2"), ("_h2", "_pos", "_h1"))]
    value = (part[0] * F.lit(1 << 45).cast("decimal(15,0)") + part[1]).cast("decimal(28,0)")
    summed = running_sum(written(turns.withColumn("_value", value)), ["_conv"], ["_pos"], F.col("_value"), block_of(F.col("_pos")), "_sum")

    def name(depth: Column, total: Column) -> Column:
        return F.concat_ws(".", depth.cast("string"), total.cast("string"))

    below = summed.select(
        "_conv", F.col("_pos").cast("long").alias("_depth"), "_len", name(F.col("_pos"), F.col("_sum")).alias("_key"),
        name(F.col("_pos") - 1, F.col("_sum") - F.col("_value")).alias("_parent"), "_words",
    )
    roots = heads.select("_conv", F.lit(0).cast("long").alias("_depth"), "_len", F.lit(ROOT).alias("_key"), F.lit(None).cast("string").alias("_parent"), F.lit(0).cast("long").alias("_words"))
    return below.unionByName(roots)


def ends(paths: DataFrame) -> DataFrame:
    """(_key, _sha): SHA-256 over the ids of the conversations that end at a node. A node's ids are sorted and joined by many
    tasks; only one row per piece of the list meets the hash, which is fed piece by piece."""
    ending = paths.where("_depth = _len").select("_key", "_conv").repartitionByRange("_key", "_conv").sortWithinPartitions("_key", "_conv")

    def joined(batches):
        task = TaskContext.get().partitionId()
        key, ids, size, number = None, [], 0, 0

        def piece():
            return pa.record_batch([pa.array([key]), pa.array([task], pa.int32()), pa.array([number], pa.int64()), pa.array([",".join(ids)])], ["_key", "_task", "_no", "_ids"])

        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != key or size > PIECE:
                    if ids:
                        yield piece()
                    key, ids, size, number = k, [], 0, number + 1
                ids.append(str(c))
                size += len(ids[-1]) + 1
        if ids:
            yield piece()

    def hashed(batches):
        key, state = None, None
        for batch in batches:
            out = []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                if k == key:
                    state.update(b",")
                else:
                    if state:
                        out.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                state.update(ids.encode())
            if out:
                yield pa.record_batch([pa.array([x[0] for x in out]), pa.array([x[1] for x in out])], ["_key", "_sha"])
        if state:
            yield pa.record_batch([pa.array([key]), pa.array([state.hexdigest()])], ["_key", "_sha"])

    pieces = ending.mapInArrow(joined, "_key string, _task int, _no long, _ids string")
    return pieces.repartition("_key").sortWithinPartitions("_key", "_task", "_no").mapInArrow(hashed, "_key string, _sha string")


def _sent(nodes: DataFrame, leaves: str, saved: str, kids: str) -> DataFrame:
    """One message per parent from the nodes' totals."""
    return nodes.groupBy("_parent").agg(F.sum("_leaves").alias(leaves), F.sum("_saved").alias(saved), F.count("*").alias(kids)).withColumnRenamed("_parent", "_to")


def _received(nodes: DataFrame, messages: DataFrame) -> DataFrame:
    leaves, saved, kids = (F.coalesce(F.col(m), F.lit(0)) for m in ("_l", "_s", "_k"))
    joined = nodes.join(messages, nodes["_key"] == messages["_to"], "left")
    return joined.withColumn("_leaves", F.col("_leaves") + leaves).withColumn("_saved", F.col("_saved") + saved).withColumn("_kids", F.col("_kids") + kids).drop("_to", "_l", "_s", "_k")


def totals(paths: DataFrame, subtree: int = SUBTREE, levels: int = LEVELS, queue: int = QUEUE) -> DataFrame:
    """The nodes (columns as in ``_NODE``) of ``paths`` with their subtree totals."""
    nodes = paths.groupBy("_key", "_depth", "_parent", "_words").agg(
        F.min("_conv").alias("_conv"), F.count("*").alias("_n"), F.sum(F.col("_len") - F.col("_depth")).alias("_below")
    )
    nodes = written(nodes.select(
        "_key", "_depth", "_parent", "_conv", "_n", "_below", F.when(F.col("_below") == 0, 1).otherwise(0).cast("long").alias("_leaves"),
        ((F.col("_n") - 1) * F.col("_words")).alias("_saved"), F.lit(0).cast("long").alias("_kids"),
    ))
    heavy = nodes.where(F.col("_below") > subtree)
    # a node's smallest conversation goes through all nodes above it
    marked = paths.select("_conv", "_depth", "_key").join(heavy.select("_key", F.lit(True).alias("_heavy")), "_key", "left")
    tops = marked.where("_heavy IS NULL").groupBy("_conv").agg(F.min(F.struct("_depth", "_key")).alias("_top")).select("_conv", F.col("_top._key").alias("_shard"))
    light = written(forward(nodes.where(F.col("_below") <= subtree).join(tops, "_conv"), queue))
    sent = _sent(light.where("_key = _shard AND _parent IS NOT NULL"), "_l", "_s", "_k")
    bands = paths.where(F.col("_depth") % levels == 0).select("_conv", F.floor(F.col("_depth") / levels).alias("_band"), F.col("_key").alias("_shard"))
    upper = heavy.withColumn("_band", F.floor(F.col("_depth") / levels)).join(bands, ["_conv", "_band"])
    upper = written(_received(upper, sent))
    local = written(forward(upper, queue))
    over = local.where("_key = _shard AND _parent IS NOT NULL")
    across = over.join(local.select(F.col("_key").alias("_parent"), F.col("_shard").alias("_up")), "_parent")
    root = local.where("_key = _shard AND _parent IS NULL").withColumn("_up", F.lit(None).cast("string"))
    contracted = across.unionByName(root).select(
        F.lit("tops").alias("_shard"), F.floor(F.col("_depth") / levels).alias("_depth"), "_key", F.col("_up").alias("_parent"), "_conv", "_n", "_leaves", "_saved", "_kids",
    )
    whole = forward(contracted, queue).select("_key", "_leaves", "_saved")
    sent = _sent(over.select("_key", "_parent").join(whole, "_key"), "_l", "_s", "_k")
    return light.unionByName(forward(_received(upper, sent), queue))


def trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
         subtree: int = SUBTREE, levels: int = LEVELS, queue: int = QUEUE) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (columns in the order of the result below).

    Turns are ordered by turn, null first; turns of one number by role, then text; repeated rows are turns of their own. A null role or
    text is empty. Rows without a conversation id belong to none and take no part. A conversation that is left without turns ends
    at the root. An empty table has no conversations, so no root either, and gives an empty result. Further columns are not read.
    """
    turns, heads = rebuilt(conversations, conv, turn, role, text)
    paths = written(_paths(turns, heads))
    nodes = written(totals(paths, subtree, levels, queue))
    above = nodes.select(F.col("_key").alias("_parent"), F.col("_conv").alias("parent_conv_id"))
    out = nodes.join(above, "_parent", "left").join(ends(paths), "_key", "left")
    return out.select(
        F.col("_conv").alias("conv_id"), F.col("_depth").alias("depth"), "parent_conv_id", F.col("_n").alias("n_convs"), F.col("_kids").alias("n_children"),
        F.col("_leaves").alias("n_leaves"), F.col("_saved").alias("saved_tokens"), F.coalesce("_sha", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def _crc_table() -> list[int]:
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


OP13_SQL = rf"""
WITH crc AS (SELECT {_crc_table()}::BIGINT[] AS t
), turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS ord
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id AS c, conv_id - conv_id % 20 AS b,
    (4294967295 - list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda s, x: xor(s >> 8, t[(xor(s, x) & 255) + 1]))) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), crc
), parts AS (
  SELECT c, ord AS pos, role, text FROM convs JOIN turns ON conv_id = b WHERE ord <= h
  UNION ALL SELECT c, ord, role, text FROM convs JOIN turns ON conv_id = c WHERE ord > h
), whole AS (
  SELECT c, list(md5(length(role) || ':' || role || text) ORDER BY pos) AS l, list(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) ORDER BY pos) AS w FROM parts GROUP BY c
), seqs AS (
  SELECT c, coalesce(l, []) AS l, coalesce(w, []) AS w FROM convs LEFT JOIN whole USING (c)
), members AS (
  SELECT c, d, l[1:d] AS p, len(l) AS n, CASE WHEN d = 0 THEN 0 ELSE w[d] END AS words FROM seqs, LATERAL (SELECT unnest(range(0, len(l) + 1)) AS d)
), nodes AS (
  SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(words) AS saved, max(n) = d AS leaf,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256
  FROM members GROUP BY p, d
), ups AS (
  SELECT p[1:k] AS p, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved_tokens, count(*) FILTER (d = k + 1) AS n_children
  FROM nodes, LATERAL (SELECT unnest(range(0, d + 1)) AS k) GROUP BY 1
)
SELECT n.conv_id, n.d::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN ups USING (p) LEFT JOIN nodes up ON n.d > 0 AND up.d = n.d - 1 AND up.p = n.p[1:n.d - 1]
"""
