"""Sharding by extendible hashing.

A row's place is given by the leading bits of a hash of its key. The directory starts with one bucket; a bucket above
the byte limit is split on the next bit, and only such buckets are. The result is the state that inserting all rows into
an extendible hash table reaches, but formed bottom-up: bytes are summed per cell (a prefix longer than most buckets
need), summed again for all shorter prefixes of the cells, and a cell belongs to the shortest prefix that fits. Cells
that do not fit by themselves are divided further, reading only their rows.

Rows that share a key share all 60 bits of the key's hash. If they exceed the limit together, the bits that follow come
from a hash of the row, so a hot key is spread too. A row above the limit gets a shard of its own.

Everything is DataFrame functions; what is shuffled before the last join is one row per cell and task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.rows import IN, packed, unpacked
from feedloom.operators.stages import checkpointed

KEY_BITS = 60
MORE_BITS = 8  # bits by which a cell that does not fit is divided at a time


def hash_bits(value: Column) -> Column:
    """The leading 60 bits of MD5 of the value's text as a string of 0 and 1."""
    number = F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit(""))), 1, KEY_BITS // 4), 16, 10)
    return F.lpad(F.bin(number.cast("long")), KEY_BITS, "0")


def _leaves(cells: DataFrame, length: int, known: int, max_bytes: int) -> DataFrame:
    """(_cell, shard, depth, shard_bytes, shard_rows, _fits): of every cell the shortest prefix that fits, if any.
    Prefixes shorter than ``known`` bits are known not to fit."""
    up = cells.select("*", F.explode(F.sequence(F.lit(known), F.lit(length))).alias("depth"))
    up = up.withColumn("shard", F.expr("substring(_cell, 1, depth)"))
    nodes = up.groupBy("shard", "depth").agg(F.sum("_bytes").alias("shard_bytes"), F.sum("_rows").alias("shard_rows"))
    fits = (F.col("shard_bytes") <= max_bytes) | (F.col("shard_rows") <= 1)
    found = up.select("_cell", "shard", "depth").join(nodes.where(fits), ["shard", "depth"])
    first = found.groupBy("_cell").agg(F.min(F.struct("depth", "shard", "shard_bytes", "shard_rows")).alias("_leaf"))
    return cells.join(first, "_cell", "left").select(
        "_cell", "_leaf.shard", "_leaf.depth", "_leaf.shard_bytes", "_leaf.shard_rows", F.col("_leaf").isNotNull().alias("_fits")
    )


def assign_shards(rows: DataFrame, key: str, size: Column, max_bytes: int) -> DataFrame:
    """``rows`` with ``shard`` (its bits, '' if there is one shard), ``depth`` (their number), ``shard_bytes`` and ``shard_rows``.

    ``rows`` must be a table or a checkpoint, as it is read again. A null key is a key like any other; a null size counts
    zero bytes; an empty table gives an empty result; repeated rows are all kept. Columns of the input with the names
    of the result are replaced.
    """
    if max_bytes < 1:
        raise ValueError("max_bytes must be positive")
    out = ["shard", "depth", "shard_bytes", "shard_rows"]
    rows = rows.drop(*out)
    # xxhash64 of the row number tells repeated rows apart; both are only used where one key exceeds the limit
    own = hash_bits(F.xxhash64(size, F.monotonically_increasing_id()))
    full = packed(rows, F.concat(hash_bits(F.col(key)), own).alias("_bits"), F.coalesce(size, F.lit(0)).cast("long").alias("_size"))
    total = full.agg(F.sum("_size")).first()[0] or 0
    length = min(KEY_BITS, max(4, math.ceil(math.log2(max(1, total / max_bytes))) + 4))
    known, maps, rest = 0, [], full.select("_bits", "_size")
    while True:
        cells = rest.groupBy(F.substring("_bits", 1, length).alias("_cell")).agg(F.sum("_size").alias("_bytes"), F.count("*").alias("_rows"))
        leaves = checkpointed(_leaves(checkpointed(cells), length, known, max_bytes))
        maps.append((length, leaves.where("_fits").drop("_fits")))
        large = leaves.where("NOT _fits").select("_cell")
        if length >= 2 * KEY_BITS or not large.take(1):
            break
        rest = rest.join(large, F.substring("_bits", 1, length) == F.col("_cell"), "left_semi")
        known, length = length + 1, min(2 * KEY_BITS, length + MORE_BITS)
    placed = full
    for n, (bits, leaves) in enumerate(maps):
        leaf = leaves.select(F.col("_cell").alias(f"_cell{n}"), F.struct(*out).alias(f"_leaf{n}"))
        placed = placed.join(leaf, F.substring("_bits", 1, bits) == F.col(f"_cell{n}"), "left")
    leaf = F.coalesce(*[F.col(f"_leaf{n}") for n in range(len(maps))])
    return unpacked(placed.select(IN, leaf.alias("_leaf")), *[F.col(f"_leaf.{c}").alias(c) for c in out])


def directory(placed: DataFrame) -> DataFrame:
    """(slot, shard): the directory of the assigned rows, one slot for each prefix of the deepest shard's length.

    A shard of fewer bits has several slots; slots of prefixes without rows are left out. For directories of a bounded
    depth: it has up to 2**depth slots."""
    shards = placed.select("shard", "depth").distinct()
    deepest = placed.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    slots = shards.withColumn("_most", F.lit(deepest))
    more = F.expr("sequence(0L, shiftleft(1L, _most - depth) - 1)")
    slots = slots.select("*", F.explode(more).alias("_i"))
    tail = F.when(F.col("_most") > F.col("depth"), F.expr("lpad(bin(_i), _most - depth, '0')")).otherwise("")
    return slots.select(F.concat("shard", tail).alias("slot"), "shard")


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder per shard, one task and so one file per shard; a shard is bounded by its byte limit."""
    placed.repartition("shard").write.partitionBy("shard").mode("overwrite").parquet(path)


MAX_BYTES = 1 << 20  # small enough that the smallest test table needs several shards


def op1_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.octet_length("text").alias("n_bytes"))
    return assign_shards(docs, "doc_id", F.col("n_bytes"), MAX_BYTES)


OP1_SQL = f"""
WITH rows AS (SELECT doc_id, strlen(text) AS n_bytes,
                     lpad(bin(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT), 60, '0') AS bits
              FROM documents),
nodes AS (SELECT substr(bits, 1, CAST(d AS INT)) AS shard, CAST(d AS INT) AS depth,
                 CAST(sum(coalesce(n_bytes, 0)) AS BIGINT) AS shard_bytes, count(*) AS shard_rows
          FROM rows, range(0, 61) AS t(d) GROUP BY 1, 2),
leaves AS (SELECT * FROM nodes WHERE shard_bytes <= {MAX_BYTES} OR shard_rows <= 1)
SELECT doc_id, CAST(n_bytes AS INT) AS n_bytes, shard, depth, shard_bytes, shard_rows
FROM (SELECT r.doc_id, r.n_bytes, l.*, row_number() OVER (PARTITION BY r.bits ORDER BY l.depth) AS i
      FROM rows r JOIN leaves l ON substr(r.bits, 1, l.depth) = l.shard)
WHERE i = 1
"""
