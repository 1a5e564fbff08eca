"""Sources, sinks and streams. A query here writes a table in the format under test and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom import dims
from feedloom.catalog.base import query
from feedloom.catalog.reports import DENSE, GATED, K, OVERALL, RELIABILITY, gated_rows, load
from feedloom.catalog.text import sql_strip, sql_ws
from feedloom.functions.numbers import sql_round2
from feedloom.plans import report
from feedloom.plans.report import KEYS
from feedloom.sources import files
from feedloom.streaming import jobs
from feedloom.views import table, view


@query("src_csv_survey", "SELECT doc_id, nullif(text, '') AS answer, lang FROM documents")
def src_csv_survey(spark, sf):
    path = files.scratch(spark, "survey")
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("SubjectID"), "text", "lang")
    files.write_csv(d, path)
    rows = files.read_csv_survey(spark, path)
    return rows.select(F.col("SubjectID").cast("bigint").alias("doc_id"), F.col("text").alias("answer"), "lang")


@query("src_csv_grid", "SELECT col, text, count(*) AS n FROM (SELECT 1 AS col, o_orderstatus AS text FROM orders UNION ALL SELECT 2, o_orderpriority FROM orders) GROUP BY ALL")
def src_csv_grid(spark, sf):
    path = files.scratch(spark, "grid")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    o.write.option("header", False).csv(path)
    cells = files.read_csv_grid(spark, path).filter(F.col("col") > 0)
    return cells.groupBy("col", "text").agg(F.count("*").alias("n"))


MARK = "CASE WHEN (doc_id + {no}) % {m} = 0 THEN 'x' WHEN (doc_id + {no}) % {m} = 1 THEN 'no' ELSE '' END"


def _mark(no):
    return MARK.format(no=no, m=5 + no)


@query(
    "src_topic_labels",
    f"""WITH m AS (SELECT doc_id, {sql_ws('text')} AS feedback, list_filter([{', '.join(f"CASE WHEN ({_mark(no)}) = 'x' THEN {no} END" for no, *_ in dims.TOPICS)}], lambda x: x IS NOT NULL) AS l FROM documents)
SELECT doc_id, feedback, array_to_string(CASE WHEN len(l) = 0 THEN [13] WHEN len(l) > 1 THEN list_filter(l, lambda x: x <> 13) ELSE l END, ',') AS topic_nos FROM m WHERE feedback <> ''""",
)
def src_topic_labels(spark, sf):
    wide = table(spark, sf, "documents").selectExpr("doc_id", "text AS Feedback", *[f"{_mark(no)} AS `{name}`" for no, name, _, _ in dims.TOPICS])
    path = files.scratch(spark, "topic-labels")
    files.write_csv(wide, path)
    out = files.topic_labels(files.read_csv_survey(spark, path)).withColumn("doc_id", F.col("doc_id").cast("bigint")).drop("file")
    return out.withColumn("topic_nos", F.array_join(F.transform("topic_nos", lambda x: x.cast("string")), ","))


LABEL_ROWS = """SELECT l_orderkey AS ord, concat(' item ', CAST(l_partkey AS STRING), ' ') AS Feedback, CASE WHEN l_linenumber = 7 THEN 'Weather' ELSE topic END AS Topic,
 CASE l_returnflag WHEN 'A' THEN ' Positive ' WHEN 'N' THEN 'mixed' ELSE NULL END AS Sentiment, CASE WHEN l_linenumber = 1 THEN 'n/a' ELSE CAST(CAST(l_quantity AS INT) % 9 AS STRING) END AS Score,
 'because' AS Reasoning FROM {lineitem} JOIN {topics} ON topic_no = 1 + l_partkey % 13"""


@query(
    "src_score_labels",
    f"""WITH v AS ({LABEL_ROWS.format(lineitem='lineitem', topics='topics')})
SELECT ord, trim(v.Feedback) AS feedback, topic_no, CASE WHEN lower(trim(Sentiment)) IN ('positive', 'negative', 'neutral') THEN lower(trim(Sentiment)) ELSE 'neutral' END AS sentiment,
 CASE WHEN Score = 'n/a' THEN 3 ELSE CAST(least(greatest(CAST(Score AS INT), 1), 5) AS INT) END AS score, Reasoning AS reasoning FROM v JOIN topics t ON t.topic = v.Topic WHERE topic_no <> 13""",
)
def src_score_labels(spark, sf):
    t = dims.topics(spark)
    path = files.scratch(spark, "score-labels")
    files.write_csv(spark.sql(LABEL_ROWS, lineitem=table(spark, sf, "lineitem"), topics=t), path)
    return files.score_labels(files.read_csv_survey(spark, path), t).withColumn("ord", F.col("ord").cast("bigint")).drop("file")


def documents_of(spark, sf):
    a, t = load(spark, sf)
    return report.nested_report(report.passed(a, t), t, KEYS)


@query(
    "src_report_json",
    f"""WITH {GATED}, {DENSE} SELECT concat_ws('_', course_no, term_year, season) AS course_id, topic, {sql_round2('mean')} AS average_score, scored AS scored_comment_count, scored < 5 AS low_sample
FROM dense WHERE topic_no <> 13""",
)
def src_report_json(spark, sf):
    parsed = files.parse_reports(documents_of(spark, sf).select("report_json"))
    return files.report_topics(parsed, ["course_id"]).drop("direction_counts")


@query(
    "sink_report_json",
    f"WITH {GATED} SELECT concat_ws('_', {K}) AS course_id, topic, feedback, score, confidence, direction FROM ok JOIN topics USING (topic_no)",
)
def sink_report_json(spark, sf):
    """Write every report, read the files back and flatten them again."""
    path = files.scratch(spark, "reports")
    docs = documents_of(spark, sf).select("report_json", F.col("course_no").cast("string").alias("course"))
    files.write_reports(docs, path, ["course"])
    back = files.read_reports(spark, path)
    rows = files.report_comments(back, ["course_id"]).filter(F.col("feedback").isNotNull())
    return rows.select("course_id", "topic", "feedback", "score", "confidence", "direction")


@query("src_prediction_json", "SELECT CAST(course_no AS STRING) AS model, topic, feedback AS text, coalesce(score, 3) AS score FROM assignments JOIN topics USING (topic_no)")
def src_prediction_json(spark, sf):
    """Prediction files, the rows of a model dealt over some by key."""
    path = files.scratch(spark, "predictions")
    a, t = load(spark, sf)
    rows = a.join(F.broadcast(t.select("topic_no", "topic")), "topic_no").withColumn("part", F.pmod(F.xxhash64("ord"), F.lit(64)))
    item = F.struct(F.col("feedback").alias("text"), F.col("score"))
    per_topic = rows.groupBy("course_no", "part", "topic").agg(F.collect_list(item).alias("feedback_with_sentiment"))
    out = per_topic.groupBy("course_no", "part").agg(F.collect_list(F.struct("topic", "feedback_with_sentiment")).alias("topics"))
    out.select(F.col("course_no").cast("string").alias("model"), "topics").write.json(path)
    return files.read_predictions(spark, path).select("model", "topic", "text", "score")


COMBINED = f"""{GATED}, {DENSE},
cf AS (SELECT {K}, topic_no, {sql_round2('mean')} AS average_score, scored AS scored_comment_count, {RELIABILITY} AS reliability, concat('Summary of ', topic, ':') AS summary FROM dense),
cn AS (SELECT *, row_number() OVER (PARTITION BY {K}, topic_no ORDER BY ord, score NULLS FIRST, confidence) AS n FROM ok)"""


@query(
    "sink_report_csv",
    f"""WITH {COMBINED}, {OVERALL} SELECT c.course_no, c.term_year, c.season, c.topic_no, overall_score, average_score, scored_comment_count, reliability, coalesce(feedback, '') AS feedback,
 coalesce(CAST(score AS STRING), '') AS score, coalesce(CAST(confidence AS STRING), '') AS confidence, coalesce(scoring_status, '') AS scoring_status, CASE WHEN n IS NULL OR n = 1 THEN summary ELSE '' END AS summary
FROM cf c LEFT JOIN ov USING (course_no, term_year, season) LEFT JOIN cn n ON n.course_no = c.course_no AND n.term_year = c.term_year AND n.season = c.season AND n.topic_no = c.topic_no""",
)
def sink_report_csv(spark, sf):
    a, t = load(spark, sf)
    ok = report.passed(a, t)
    overall = report.overall_score(ok.filter(F.col("topic_no") != dims.OTHER_NO), KEYS).drop("scored_comments")
    figures = report.topic_report_of(ok, t, KEYS).join(overall, KEYS, "left")
    figures = figures.withColumn("summary", F.concat(F.lit("Summary of "), "topic", F.lit(":")))
    path = files.scratch(spark, "combined")
    files.write_csv(files.combined_rows(ok, figures, KEYS), path)
    return files.read_combined(spark, path)


@query(
    "sink_versioned",
    "SELECT owner_id, course, id, term, overall_score, created_at FROM reports QUALIFY row_number() OVER (PARTITION BY owner_id, course ORDER BY created_at DESC, id DESC) = 1",
)
def sink_versioned(spark, sf):
    """Two runs are appended (earlier and later reports); the newest per owner and course is shown."""
    path = files.scratch(spark, "versions")
    r = view(spark, sf, "reports").select("owner_id", "course", "id", "term", "overall_score", "created_at")
    early = F.col("created_at") < F.lit("1998-01-01").cast("timestamp_ntz")
    files.append_version(r.filter(early), path, "run1")
    files.append_version(r.filter(~early), path, "run2")
    return files.latest_version(spark.read.parquet(path), ["owner_id", "course"], ["created_at", "id"]).drop("run_ts")


@query("export_selected", "SELECT id, course, term FROM reports WHERE owner_id IN (SELECT id FROM users WHERE status = 'approved')")
def export_selected(spark, sf):
    ids = view(spark, sf, "users").filter(F.col("status") == "approved").select(F.col("id").alias("owner_id"))
    path = files.scratch(spark, "export")
    files.export_selected(view(spark, sf, "reports"), ids, "owner_id").select("id", "course", "term").write.json(path)
    return spark.read.schema("id bigint, course string, term string").json(path)


@query("run_history", "SELECT o_orderkey AS id, o_orderpriority AS course_id, o_orderdate AS date, 'Success' AS status FROM orders WHERE o_orderstatus = 'F'")
def run_history(spark, sf):
    h = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("course_id"), F.col("o_orderdate").alias("date"),
        F.when(F.col("o_orderstatus") == "F", "Success").otherwise("Failed").alias("status"),
    )
    path = files.scratch(spark, "history")
    files.append_history(h.filter("id % 2 = 0"), path)  # two runs of a service, appended one after the other
    files.append_history(h.filter("id % 2 = 1"), path)
    return files.run_history(spark.read.schema(h.schema).parquet(path), ["date", "id"], success_only=True)


SHORT = [(no, s) for no, _, s, _ in dims.TOPICS]


@query(
    "sheet_topics_wide",
    "SELECT feedback, " + ", ".join(f"""max(CASE WHEN topic_no = {no} THEN '✓' ELSE '' END) AS "{s}\"""" for no, s in SHORT) + " FROM assignments GROUP BY feedback",
)
def sheet_topics_wide(spark, sf):
    return files.sheet_topics_wide(view(spark, sf, "assignments"), SHORT)


@query(
    "sheet_scores_long",
    """SELECT feedback AS "Feedback", topic AS "Topic", coalesce(direction, 'neutral') AS "Sentiment", coalesce(score, 2) AS "Score", scoring_status AS "Reasoning" FROM assignments JOIN topics USING (topic_no)""",
)
def sheet_scores_long(spark, sf):
    a, t = load(spark, sf)
    sheet = files.sheet_scores_long(a.withColumn("sentiment", F.col("direction")).withColumn("reasoning", F.col("scoring_status")), t)
    path = files.scratch(spark, "sheet")
    files.write_csv(sheet, path)
    return spark.read.schema(sheet.schema).option("header", True).option("escape", '"').csv(path)


@query("sink_eval_run", "SELECT ord, topic_no, score AS human_score FROM gold_scores")
def sink_eval_run(spark, sf):
    path = files.scratch(spark, "eval")
    g = view(spark, sf, "gold_scores").select("ord", "topic_no", F.col("score").alias("human_score"))
    files.write_eval_run(g.agg(F.count("*").alias("pairs")), g, path, "a")
    return spark.read.schema("ord bigint, topic_no int, human_score int").option("header", True).csv(f"{path}/run=a/scores")


@query(
    "sink_comparison",
    "SELECT model, topic_no, count(*) AS items, max(CASE WHEN model = 'b' THEN score END) AS top FROM pred_scores GROUP BY model, topic_no",
)
def sink_comparison(spark, sf):
    p = view(spark, sf, "pred_scores")
    a = p.filter(F.col("model") == "a").groupBy("topic_no").agg(F.count("*").alias("items"))
    b = p.filter(F.col("model") == "b").groupBy("topic_no").agg(F.count("*").alias("items"), F.max("score").alias("top"))
    return files.stack_models({"a": a, "b": b})


@query("schema_evolve", "SELECT id, name, NULL::DOUBLE AS yearly_cap_usd FROM users WHERE status <> 'approved' UNION ALL SELECT id, name, yearly_cap_usd FROM users WHERE status = 'approved'")
def schema_evolve(spark, sf):
    u = view(spark, sf, "users")
    old = u.filter(F.col("status") != "approved").select("id", "name")
    return files.evolve(old, u.filter(F.col("status") == "approved").select("id", "name", "yearly_cap_usd"))


# --- streams -------------------------------------------------------------------------------
def time_slice(rows, time, count):
    """0 to count - 1 by time, from the first row's to the last one's."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    low, high = rows.agg(F.min(at)).scalar(), rows.agg(F.max(at)).scalar()
    return F.floor((at - low) * count / (high - low + 1)).cast("int")


@query(
    "stream_dedupe",
    f"""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS course_id, {sql_ws('event_type')} AS text, ts FROM events WHERE {sql_strip('event_type')} <> ''),
l AS (SELECT course_id, text, list_reduce(list([ts] ORDER BY ts), lambda a, b: CASE WHEN b[1] > a[len(a)] + INTERVAL '1 day' THEN list_concat(a, b) ELSE a END) AS kept FROM e GROUP BY ALL)
SELECT course_id, text, unnest(kept) AS at FROM l""",
)
def stream_dedupe(spark, sf):
    """Answers of each user, delivered in three batches; the job is started again for each."""
    events = table(spark, sf, "events")
    items = events.select(F.col("user_id").cast("string").alias("course_id"), F.col("event_type").alias("text"), F.col("ts").cast("timestamp").alias("at"))
    path = files.scratch(spark, "dedupe")
    for stream in jobs.replay(items, time_slice(items, "at", 3), 3, f"{path}-in"):
        out = jobs.run_to_table(jobs.stream_dedupe(stream, ["course_id"], "at", "1 day"), path)
    return out.select("course_id", "text", F.col("at").cast("timestamp_ntz").alias("at"))


USAGE = "count(*) AS runs, coalesce(CAST(sum(CAST(cost_usd AS DECIMAL(20,10))) FILTER (NOT used_own_key) AS DOUBLE), 0.0::DOUBLE) AS cost_usd, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens"
# rows whose id ends in 07 (13) of 40 are delivered one batch (two batches) late
DELAY = 12


def sql_windows(days: int) -> str:
    """Usage per window of ``days`` days, one starting each day. A row counts in a window that ends after the watermark of the batches
    before its own."""
    return f"""WITH span AS (SELECT min(epoch_us(created_at)) AS lo, max(epoch_us(created_at)) AS hi FROM usage_log),
b AS (SELECT u.*, CAST(floor((epoch_us(created_at) - lo) * 3 / (hi - lo + 1)) AS INT) + CASE id % 40 WHEN 7 THEN 1 WHEN 13 THEN 2 ELSE 0 END AS batch FROM usage_log u, span),
seen AS (SELECT batch, max(max(created_at)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL {DELAY} DAY AS mark FROM b GROUP BY batch),
w AS (SELECT b.*, mark, date_trunc('day', created_at) - to_days(CAST(k AS INT)) AS window_start FROM b JOIN seen USING (batch), LATERAL (SELECT unnest(range(0, {days})) AS k))
SELECT CAST(window_start AS TIMESTAMP) AS window_start, user_id, {USAGE} FROM w WHERE mark IS NULL OR window_start + INTERVAL {days} DAY > mark GROUP BY ALL"""


def usage_windows(spark, sf, name, window, slide):
    """Rows arrive in batches by time, some of them late: within the delay they count, beyond it they are dropped."""
    usage = view(spark, sf, "usage_log")
    late = F.when(F.col("id") % 40 == 7, 1).when(F.col("id") % 40 == 13, 2).otherwise(0)
    path = files.scratch(spark, name)
    for stream in jobs.replay(usage, time_slice(usage, "created_at", 3) + late, 5, f"{path}-in"):
        out = jobs.stream_usage_windows(stream, window, slide, f"{DELAY} days")
        latest = jobs.run_latest(out, path, ["window_start", "user_id"])
    return latest.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("stream_usage_windows", sql_windows(1))
def stream_usage_windows(spark, sf):
    return usage_windows(spark, sf, "usage", "1 day", None)


@query("stream_usage_sliding", sql_windows(7))
def stream_usage_sliding(spark, sf):
    return usage_windows(spark, sf, "sliding", "7 days", "1 day")


@query(
    "stream_topic_upsert",
    f"WITH s AS (SELECT {K}, topic_no, count(*) AS comment_count, count(score) AS scored_comment_count, avg(score) AS m FROM assignments GROUP BY ALL) SELECT {K}, topic_no, comment_count, scored_comment_count, {sql_round2('m')} AS average_score FROM s",
)
def stream_topic_upsert(spark, sf):
    """Assignments arrive in three batches by order number."""
    rows, path = view(spark, sf, "assignments"), files.scratch(spark, "topics")
    for stream in jobs.replay(rows, F.pmod("ord", F.lit(3)), 3, f"{path}-in"):
        out = jobs.stream_topic_upsert(stream, path, KEYS)
    return out
