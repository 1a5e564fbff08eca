"""Continuous forms of three flows. State lives in Spark; sources are streams of files or any other stream."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions import text as tx


def replay(rows: DataFrame, batch: Column, count: int, folder: str) -> Iterator[DataFrame]:
    """Deliver a table in ``count`` batches: write the rows of the next one to ``folder``, then hand out a stream over the folder.
    Running a job on each stream with one checkpoint is a job that is stopped and started again after every batch."""
    spark = rows.sparkSession
    numbered = rows.withColumn("_batch", batch)
    for i in range(count):
        numbered.where(F.col("_batch") == i).drop("_batch").write.mode("append").parquet(folder)
        yield spark.readStream.schema(rows.schema).parquet(folder)


DEDUPE_GROUPS = 512


def stream_dedupe(items: DataFrame, keys: Sequence[str], time: str, delay: str, groups: int = DEDUPE_GROUPS) -> DataFrame:
    """Each text once per course within ``delay`` of the copy that was kept before it, in order of event time across batches. State has
    one time per digest of course, text and length, and expires when the watermark has passed it by ``delay``; what arrives later than
    that is a new text. It lies in ``groups`` parts by digest, as a call of Python for each text would cost far more than its rows.
    Columns come out as they went in."""
    prepared = tx.with_once(items, "text", tx.prepare_text(F.col("text"))).filter((F.col("text") != "") & F.col(time).isNotNull())
    of_course = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    digest = F.md5(F.concat(of_course, F.lit("\x1f"), F.md5("text"), F.length("text").cast("string")))
    keyed = prepared.withWatermark(time, delay).withColumn("_d", digest).withColumn("_group", F.pmod(F.xxhash64("_d"), F.lit(groups)))
    wait, columns = int(pd.Timedelta(delay).total_seconds() * 1e6), items.columns

    def keep_first(_, frames, state):
        if state.hasTimedOut:  # the latest of the group's times has expired
            state.remove()
            return
        rows = pd.concat(frames).sort_values(time, kind="stable")
        last = {}
        if state.exists:
            packed, times = state.get
            last = dict(zip((packed[i : i + 32] for i in range(0, len(packed), 32)), np.frombuffer(times, dtype="int64").tolist()))
        keep = []
        for i, (d, at) in enumerate(zip(rows["_d"], rows[time].astype("datetime64[us]").astype("int64").tolist())):
            if d not in last or at > last[d] + wait:
                keep.append(i)
                last[d] = at
        mark = state.getCurrentWatermarkMs()
        last = {d: at for d, at in last.items() if (at + wait) // 1000 + 1 > mark}
        if last:
            state.update(("".join(last), np.array(list(last.values()), dtype="int64").tobytes()))
            state.setTimeoutTimestamp(max((max(last.values()) + wait) // 1000 + 1, mark + 1))
        elif state.exists:
            state.remove()
        yield rows.iloc[keep][columns]

    return keyed.groupBy("_group").applyInPandasWithState(keep_first, prepared.schema, "digests string, last binary", "append", "EventTimeTimeout")


def stream_usage_windows(usage: DataFrame, window: str = "1 day", slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """Runs, lab cost and tokens per user and window. Money is summed as decimals."""
    timed = usage.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", delay)
    w = F.window("created_at", window, slide) if slide else F.window("created_at", window)
    agg = timed.groupBy(w.alias("w"), "user_id").agg(
        F.count("*").alias("runs"),
        F.sum(F.when(~F.col("used_own_key"), F.col("cost_usd").cast("decimal(20,10)"))).alias("cost"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
    )
    return agg.select(
        F.col("w.start").alias("window_start"), "user_id", "runs", F.coalesce(F.col("cost").cast("double"), F.lit(0.0)).alias("cost_usd"),
        "input_tokens", "output_tokens",
    )


def run_to_table(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is available now into a Parquet folder and read it back (append mode)."""
    spark = stream.sparkSession
    q = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{path}-state")
        .trigger(availableNow=True)
        .format("parquet")
        .start(path)
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_latest(stream: DataFrame, path: str, key: Sequence[str]) -> DataFrame:
    """Run an updating aggregate now: every micro-batch appends its changed rows, the newest row per key counts."""
    spark = stream.sparkSession

    def save(batch: DataFrame, batch_id: int) -> None:
        # overwriting the batch's own folder makes a repeated batch harmless
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    q = (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", f"{path}-state")
        .trigger(availableNow=True)
        .foreachBatch(save)
        .start()
    )
    q.awaitTermination()
    rows = spark.read.parquet(path)
    rest = [c for c in stream.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch_id").alias("r"))
    return best.select(*key, *[F.col(f"r.{c}").alias(c) for c in rest])


BUCKETS = 16


def _committed(spark: SparkSession, path: str, before: int | None = None) -> tuple[int | None, dict[int, int]]:
    """The last committed batch (below ``before``) and the version of each bucket as of then: one row per bucket at most."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [int(f.getPath().getName().removeprefix("batch=")) for f in fs.listStatus(folder)] if fs.exists(folder) else []
    found = [i for i in found if (before is None or i < before) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits/batch={i}/_SUCCESS"))]
    if not found:
        return None, {}
    rows = spark.read.schema("bucket int, version long").parquet(f"{path}/commits/batch={max(found)}").collect()
    return max(found), {r["bucket"]: r["version"] for r in rows}


def _bucket_rows(spark: SparkSession, path: str, versions: dict[int, int], schema: str) -> DataFrame:
    files = [f"{path}/state/version={v}/bucket={b}" for b, v in sorted(versions.items())]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def upsert_sums(batch: DataFrame, batch_id: int, path: str, keys: Sequence[str], sums: Sequence[str]) -> None:
    """Add a batch of (keys, sums) to the state at ``path``, as part ``batch_id`` of a stream.

    State lies in buckets of its keys. A batch rewrites only the buckets that it touches, as a new version beside the old one, and
    commits the versions of all buckets with its id. A batch that is repeated starts from the commit before its own, so it changes
    nothing; versions that no commit but the last two name are deleted.
    """
    spark = batch.sparkSession
    add = [F.sum(c).alias(c) for c in sums]
    facts = batch.groupBy(*keys).agg(*add).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")).persist()
    touched = [r["bucket"] for r in facts.select("bucket").distinct().collect()]
    last, versions = _committed(spark, path, batch_id)
    schema = facts.drop("bucket").schema
    old = _bucket_rows(spark, path, {b: v for b, v in versions.items() if b in touched}, schema)
    old = old.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
    merged = old.unionByName(facts).groupBy("bucket", *keys).agg(*add)
    merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/state/version={batch_id}")
    now = versions | dict.fromkeys(touched, batch_id)
    spark.createDataFrame(sorted(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/batch={batch_id}")
    facts.unpersist()
    _clean(spark, path, {batch_id, last}, {*now.items(), *versions.items()})


def _clean(spark: SparkSession, path: str, commits: set[int | None], used: set[tuple[int, int]]) -> None:
    """Delete the commits and the (bucket, version) folders that the last two commits do not name."""
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    fs = path_of(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def numbered(folder: str) -> dict[int, str]:
        names = [f.getPath() for f in fs.listStatus(path_of(folder)) if "=" in f.getPath().getName()]
        return {int(n.getName().split("=")[1]): n.toString() for n in names}

    for batch, folder in numbered(f"{path}/commits").items():
        if batch not in commits:
            fs.delete(path_of(folder), True)
    for version, folder in numbered(f"{path}/state").items():
        buckets = numbered(folder)
        stale = [f for b, f in buckets.items() if (b, version) not in used]
        for f in [folder] if len(stale) == len(buckets) else stale:
            fs.delete(path_of(f), True)


def stream_topic_upsert(assignments: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Keep topic figures of reports current as rows arrive: each micro-batch is reduced to (report, topic) sums and added to
    the state. Reading the figures costs the state as it is, not its history."""

    def save(batch: DataFrame, batch_id: int) -> None:
        facts = batch.select(*keys, "topic_no", F.lit(1).cast("long").alias("comments"), F.col("score").isNotNull().cast("long").alias("scored"), F.coalesce("score", F.lit(0)).cast("long").alias("total"))
        upsert_sums(facts, batch_id, path, [*keys, "topic_no"], ["comments", "scored", "total"])

    q = (
        assignments.writeStream.option("checkpointLocation", f"{path}-state").trigger(availableNow=True).foreachBatch(save).start()
    )
    q.awaitTermination()
    kinds = {c: assignments.schema[c].dataType.simpleString() for c in [*keys, "topic_no"]}
    return topic_state(assignments.sparkSession, path, keys, ", ".join(f"{c} {t}" for c, t in kinds.items()))


def topic_state(spark: SparkSession, path: str, keys: Sequence[str], key_schema: str) -> DataFrame:
    from feedloom.functions.numbers import round2

    s = _bucket_rows(spark, path, _committed(spark, path)[1], f"{key_schema}, comments long, scored long, total long")
    s = s.withColumnsRenamed({"comments": "comment_count", "scored": "scored_comment_count", "total": "t"})
    mean = F.col("t") / F.nullif(F.col("scored_comment_count"), F.lit(0))
    return s.select(*keys, "topic_no", "comment_count", "scored_comment_count", round2(mean).alias("average_score"))
