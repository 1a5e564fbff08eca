"""Jobs that are stopped and started again between batches, late rows, repeated batches, space."""

import datetime as dt
import glob

from pyspark.sql import functions as F

from feedloom.streaming import jobs

START = dt.datetime(2024, 1, 1)


def at(hours):
    return START + dt.timedelta(hours=hours)


def test_a_text_is_kept_once_per_delay(spark, tmp_path):
    rows = [(0, "c", 0, "x"), (0, "c", 5, "x"), (0, "c", 30, "x"), (1, "c", 31, " x "), (1, "c", 55, "x"), (1, "c", 54, "x"), (2, "c", 200, "x"), (2, "d", 200, "x"), (2, "d", 201, " ")]
    items = spark.createDataFrame([(b, c, at(h), x) for b, c, h, x in rows], "b int, course_id string, at timestamp, text string")
    kept = []
    for stream in jobs.replay(items, F.col("b"), 3, str(tmp_path / "in")):
        out = jobs.run_to_table(jobs.stream_dedupe(stream.drop("b"), ["course_id"], "at", "1 day"), str(tmp_path / "out"))
        kept.append(sorted((r["course_id"], (r["at"] - START).total_seconds() / 3600) for r in out.collect()))
    # 54 is within a day of 30; 55 is not; each restart goes on with the state of the one before
    assert kept == [[("c", 0), ("c", 30)], [("c", 0), ("c", 30), ("c", 55)], [("c", 0), ("c", 30), ("c", 55), ("c", 200), ("d", 200)]]


def test_texts_share_few_groups_of_state(spark, tmp_path):
    rows = [(c, at(h), f"x{i}") for c in ("c", None) for i in range(20) for h in (0, 3, 30)]
    items = spark.createDataFrame(rows, "course_id string, at timestamp, text string")
    stream = next(iter(jobs.replay(items, F.lit(0), 1, str(tmp_path / "in"))))
    out = jobs.stream_dedupe(stream, ["course_id"], "at", "1 day", groups=2)
    q = out.writeStream.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out"))
    q.awaitTermination()
    kept = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(((r["at"] - START).total_seconds() / 3600, r["text"], r["course_id"] or "") for r in kept) == sorted((h, t, c or "") for c, a, t in rows for h in [(a - START).total_seconds() / 3600] if h != 3)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) <= 2  # not one for each of 40 texts


def test_late_usage_counts_within_the_delay(spark, tmp_path):
    rows = [(0, 1, 1), (0, 50, 2), (1, 2, 1), (1, 60, 2), (1, 26, 1), (2, 3, 1), (2, 30, 5), (2, 120, 2), (3, 70, 9)]
    usage = spark.createDataFrame([(b, at(h), u, False, 1.0, 1, 1) for b, h, u in rows], "b int, created_at timestamp, user_id int, used_own_key boolean, cost_usd double, input_tokens long, output_tokens long")
    for stream in jobs.replay(usage, F.col("b"), 4, str(tmp_path / "in")):
        out = jobs.run_latest(jobs.stream_usage_windows(stream, delay="1 day"), str(tmp_path / "out"), ["window_start", "user_id"])
    got = {(r["window_start"].day, r["user_id"]): r["runs"] for r in out.collect()}
    # 2 and 3 are behind the watermarks 26 and 36, and 70 is behind 96; 26 and 30 are late and count
    assert got == {(1, 1): 1, (3, 2): 2, (2, 1): 1, (2, 5): 1, (6, 2): 1}


def test_upserts_are_fenced_and_compact(spark, tmp_path):
    path = str(tmp_path / "state")
    frame = lambda i: spark.createDataFrame([(k, 1, k * i) for k in range(i % 7, 40, 7)], "k long, n long, total long")
    want = {}
    for i in range(12):
        jobs.upsert_sums(frame(i), i, path, ["k"], ["n", "total"])
        if i % 5 == 4:
            jobs.upsert_sums(frame(i), i, path, ["k"], ["n", "total"])  # the same batch again
        for k in range(i % 7, 40, 7):
            n, total = want.get(k, (0, 0))
            want[k] = (n + 1, total + k * i)
    last, versions = jobs._committed(spark, path)
    rows = jobs._bucket_rows(spark, path, versions, "k long, n long, total long").collect()
    assert last == 11 and {r["k"]: (r["n"], r["total"]) for r in rows} == want and len(rows) == len(want)
    assert len(glob.glob(f"{path}/commits/batch=*")) == 2
    assert len(glob.glob(f"{path}/state/*/bucket=*")) <= 2 * jobs.BUCKETS
