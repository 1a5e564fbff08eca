"""Readers and writers: survey CSV files, label files, stored reports, prediction files, report and sheet exports."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom import dims
from feedloom.functions import text as tx
from feedloom.operators.ordered import block_of, row_numbers
from feedloom.operators.stages import shared_folder, written

# Field names of the interchange format.
REPORT_SCHEMA = """course_id string, model string, overall_score double,
 categories array<struct<topic:string, average_score:double, comment_count:bigint, scored_comment_count:bigint, reliability:string,
  direction_counts:map<string,bigint>, comments:array<struct<feedback:string, question:string, score:string, confidence:string, sentiment:string,
   direction:string, scoring_status:string, classification_status:string, ignored:boolean, general_score:string>>>>,
 quantitative array<struct<question:string, n:bigint, mean:double, distribution:map<string,bigint>>>,
 general_sentiment struct<average_score:double, scored_comments:bigint>,
 comments array<struct<topic:string, feedback:string, question:string, score:string, confidence:string, direction:string, scoring_status:string, ignored:boolean>>,
 metadata struct<prompt_version:string, processed_comments:bigint, model_id:string, chunk:bigint>"""


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for files, beside the checkpoints in the folder that all executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- CSV ----------------------------------------------------------------------------------


def _counted(lines: DataFrame) -> DataFrame:
    """Adds, in the order in which a task reads the lines of a split: ``_before``, the quotes before a line, and ``_n0`` and ``_n1``, the
    lines up to it that are not blank and have an even or an odd number of quotes before them. A split is never read by two tasks."""
    names = lines.columns

    def run(batches):
        last, quotes, counts = None, 0, [0, 0]
        for part in batches:
            if not part.num_rows:
                continue
            files, split, q, blank = [part.column(names.index(c)) for c in ("file", "_split", "_q", "_blank")]
            coded = files.dictionary_encode()
            at, q, full = split.to_numpy(), q.to_numpy(), ~blank.to_numpy(zero_copy_only=False)
            code = coded.indices.to_numpy()
            edges = np.flatnonzero((at[1:] != at[:-1]) | (code[1:] != code[:-1])) + 1
            before, found = np.zeros(len(q), np.int64), np.zeros((2, len(q)), np.int64)
            for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(q)]):
                name = (coded.dictionary[code[i]].as_py(), at[i])
                if name != last:
                    last, quotes, counts = name, 0, [0, 0]
                total = quotes + np.cumsum(q[i:j])
                before[i:j] = total - q[i:j]
                for p in (0, 1):
                    found[p, i:j] = counts[p] + np.cumsum(full[i:j] & (before[i:j] % 2 == p))
                    counts[p] = int(found[p, j - 1])
                quotes = int(total[-1])
            yield pa.record_batch([*part.columns, pa.array(before), pa.array(found[0]), pa.array(found[1])], [*names, "_before", "_n0", "_n1"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lines.schema)
    return lines.mapInArrow(run, f"{kinds}, _before long, _n0 long, _n1 long")


def _records(spark: SparkSession, path: str) -> DataFrame:
    """(file, row_no, record): the records of CSV files, quoted line breaks included, numbered from 0 in each file. Blank lines between
    records have no number. A file that is not UTF-8 throughout is read as Latin-1.

    Files are read as lines, split like any text. Whether a line starts a record depends on the quotes before it: each split is
    summed up by its quotes and by how many records start in it after an even and after an odd number of quotes; one row per split
    goes through a window of its file, and the lines of a split need nothing but that row.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_id"), F.col("value").cast("binary").alias("_raw"),
        (F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))).cast("long").alias("_q"), (F.regexp_replace("value", "\r$", "") == "").alias("_blank"),
    )
    lines = written(_counted(lines))
    value, before = F.col("_raw").cast("string"), F.col("_before")
    splits = lines.groupBy("file", "_split").agg(
        F.sum("_q").alias("_q"), F.bool_or(~F.is_valid_utf8(value)).alias("_odd"),
        *[F.count_if((before % 2 == p) & ~F.col("_blank")).alias(f"_s{p}") for p in (0, 1)],
    )
    by_file, earlier = Window.partitionBy("file"), Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_in", F.coalesce(F.sum("_q").over(earlier), F.lit(0)) % 2).withColumn("_latin", F.bool_or("_odd").over(by_file))
    splits = splits.withColumn("_starts", F.when(F.col("_in") == 0, F.col("_s0")).otherwise(F.col("_s1")))
    splits = splits.select("file", "_split", "_in", "_latin", F.coalesce(F.sum("_starts").over(earlier), F.lit(0)).alias("_rows"))
    lines = lines.join(F.broadcast(splits), ["file", "_split"])  # a row per split, so no line is shuffled for it
    outside = (before + F.col("_in")) % 2 == 0
    lines = lines.withColumn("_new", outside & ~F.col("_blank")).filter(~(outside & F.col("_blank")))
    text = F.when(F.col("_latin"), F.decode("_raw", "ISO-8859-1")).otherwise(value)
    number = F.when(F.col("_in") == 0, F.col("_n0")).otherwise(F.col("_n1"))
    lines = lines.select(
        "file", (F.col("_rows") + number - 1).alias("row_no"), "_split", "_id",
        text.alias("_line"), (F.col("_new") & (F.col("_q") % 2 == 0)).alias("_alone"),
    )
    # only records over several lines are put together; each is as long as its cell
    joined = lines.filter(~F.col("_alone")).groupBy("file", "row_no").agg(F.array_sort(F.collect_list(F.struct("_split", "_id", "_line"))).alias("_l"))
    records = lines.filter("_alone").select("file", "row_no", F.col("_line").alias("record"))
    records = records.unionByName(joined.select("file", "row_no", F.array_join(F.col("_l._line"), "\n").alias("record")))
    return records.withColumn("record", F.regexp_replace(F.regexp_replace("record", "\r$", ""), "^\ufeff", ""))


def _fields(records: DataFrame, names: Sequence[str]) -> DataFrame:
    """(file, row_no, fields): rows with too many fields are skipped, rows with too few are filled with nulls."""
    schema = T.StructType([T.StructField(f"f{i}", T.StringType()) for i in range(len(names))] + [T.StructField("_extra", T.StringType()), T.StructField("_bad", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"}
    # a row of the right width is one field short of the schema, hence flagged and without an extra field
    parsed = records.select("file", "row_no", F.from_csv("record", schema.simpleString(), options).alias("_f"))
    return parsed.filter(F.col("_f._extra").isNull()).select("file", "row_no", F.array(*[F.col(f"_f.f{i}") for i in range(len(names))]).alias("fields"))


def read_csv_survey(spark: SparkSession, path: str) -> DataFrame:
    """A headed CSV as strings, with the file each row came from."""
    names = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path).columns
    rows = _fields(_records(spark, path), names).filter(F.col("row_no") > 0)
    return rows.select(*[F.col("fields")[i].alias(n) for i, n in enumerate(names)], "file")


def read_csv_grid(spark: SparkSession, path: str) -> DataFrame:
    """The same files headless, as cells ``(file, row_no, col, text)``. A skipped row keeps its number."""
    names = spark.read.option("header", False).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path).columns
    cells = _fields(_records(spark, path), names).select("file", "row_no", F.posexplode("fields").alias("col", "text"))
    return cells.filter(F.col("text").isNotNull())


# --- label files --------------------------------------------------------------------------


def topic_labels(wide: DataFrame, text: str = "Feedback") -> DataFrame:
    """Wide label rows to topics per feedback; none set means Other, Other leaves when another topic is set."""
    marks = [F.when(tx.truthy_label(F.col(f"`{name}`")), F.lit(no)) for no, name, _, _ in dims.TOPICS if name in wide.columns]
    found = F.filter(F.array(*marks), lambda n: n.isNotNull())
    other = F.array(F.lit(dims.OTHER_NO))
    topics = tx.let(
        found,
        lambda t: F.when(F.size(t) == 0, other).when(F.size(t) > 1, F.array_remove(t, F.lit(dims.OTHER_NO))).otherwise(t),
    )
    rest = [c for c in wide.columns if c not in [n for _, n, _, _ in dims.TOPICS] and c != text]
    out = wide.select(*rest, tx.norm_whitespace(F.coalesce(text, F.lit(""))).alias("feedback"), topics.alias("topic_nos"))
    return out.filter(F.col("feedback") != "")


def score_labels(rows: DataFrame, topics: DataFrame) -> DataFrame:
    """Long label rows: known rubric topics, sentiment neutral unless in the set, score clamped, default 3."""
    names = topics.filter(F.col("topic_no") != dims.OTHER_NO).select("topic_no", "topic")
    s = F.lower(tx.strip_space(F.coalesce("Sentiment", F.lit("neutral"))))
    out = rows.withColumn("topic", tx.strip_space(F.coalesce("Topic", F.lit(""))))
    rest = [c for c in rows.columns if c not in ("Feedback", "Topic", "Sentiment", "Score", "Reasoning")]
    return out.join(F.broadcast(names), "topic").select(
        *rest,
        tx.norm_whitespace(F.coalesce("Feedback", F.lit(""))).alias("feedback"),
        "topic_no",
        F.when(s.isin(dims.SENTIMENTS), s).otherwise("neutral").alias("sentiment"),
        tx.clamp_score_default(F.col("Score")).alias("score"),
        tx.norm_whitespace(F.coalesce("Reasoning", F.lit(""))).alias("reasoning"),
    ).filter(F.col("feedback") != "")


# --- stored reports and prediction files -----------------------------------------------------


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Stored reports, one JSON document per line or file; missing and odd parts become null."""
    return spark.read.schema(REPORT_SCHEMA).option("mode", "PERMISSIVE").json(path)


def parse_reports(rows: DataFrame, column: str = "report_json") -> DataFrame:
    """The same for documents in a string column. Each part is read by itself, so an odd part spoils only itself."""
    v = F.try_parse_json(column)
    return rows.withColumn("_v", v).select(
        *[c for c in rows.columns if c != column],
        F.try_variant_get("_v", "$.course_id", "string").alias("course_id"),
        F.try_variant_get("_v", "$.overall_score", "double").alias("overall_score"),
        F.try_variant_get("_v", "$.metadata.prompt_version", "string").alias("prompt_version"),
        F.try_variant_get("_v", "$.metadata.processed_comments", "bigint").alias("processed_comments"),
        F.try_variant_get("_v", "$.general_sentiment.average_score", "double").alias("general_sentiment"),
        F.coalesce(F.try_variant_get("_v", "$.categories", "array<variant>"), F.array().cast("array<variant>")).alias("categories"),
        F.coalesce(F.try_variant_get("_v", "$.quantitative", "array<variant>"), F.array().cast("array<variant>")).alias("quantitative"),
    )


def _is(v: Column, kind: str) -> Column:
    return F.schema_of_variant(v).startswith(kind)


def report_topics(parsed: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Topic figures of parsed reports; entries that are not objects or have no text topic are skipped."""
    x = parsed.select(*keep, F.explode("categories").alias("c")).filter(_is(F.col("c"), "OBJECT"))
    t = F.try_variant_get("c", "$.topic", "variant")
    x = x.filter(_is(t, "STRING")).withColumn("topic", F.try_variant_get("c", "$.topic", "string"))
    scored = F.coalesce(F.try_variant_get("c", "$.scored_comment_count", "bigint"), F.lit(0))
    average = F.try_variant_get("c", "$.average_score", "variant")
    number = F.when(~_is(average, "STRING") & ~_is(average, "BOOLEAN"), F.try_variant_get("c", "$.average_score", "double"))
    return x.filter((F.col("topic") != "") & ~F.col("topic").isin(dims.OTHER, dims.LEGACY_OTHER)).select(
        *keep, "topic", number.alias("average_score"), scored.alias("scored_comment_count"),
        (scored < dims.MIN_RELIABLE).alias("low_sample"),
        F.try_variant_get("c", "$.direction_counts", "map<string,bigint>").alias("direction_counts"),
    )


def report_ratings(parsed: DataFrame, keep: Sequence[str]) -> DataFrame:
    x = parsed.select(*keep, F.posexplode("quantitative").alias("table_no", "q")).filter(_is(F.col("q"), "OBJECT"))
    text = _is(F.try_variant_get("q", "$.question", "variant"), "STRING")
    mean = F.try_variant_get("q", "$.mean", "variant")
    return x.filter(text & ~_is(mean, "STRING")).select(
        *keep, "table_no", F.try_variant_get("q", "$.question", "string").alias("question"),
        F.try_variant_get("q", "$.mean", "double").alias("mean"), F.try_variant_get("q", "$.n", "bigint").alias("n"),
    ).filter(F.col("mean").isNotNull() & (F.col("question") != ""))


def report_comments(reports: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Flat comment rows of stored reports, whether comments stand under their topics or in documents of their own; empty
    strings of a written report are null again."""
    fields = ("feedback", "question", "score", "confidence", "direction", "scoring_status", "ignored")
    under = F.flatten(F.transform("categories", lambda c: F.transform(c["comments"], lambda r: F.struct(c["topic"].alias("topic"), *[r[f].alias(f) for f in fields]))))
    own = F.transform("comments", lambda r: F.struct(r["topic"].alias("topic"), *[r[f].alias(f) for f in fields]))
    none = F.array().cast("array<struct<topic:string,feedback:string,question:string,score:string,confidence:string,direction:string,scoring_status:string,ignored:boolean>>")
    both = F.filter(F.concat(F.coalesce(under, none), F.coalesce(own, none)), lambda r: r.isNotNull())
    r = reports.select(*keep, F.explode(both).alias("r")).withColumn("topic", F.col("r.topic"))
    empty = lambda f: F.nullif(F.col(f"r.{f}"), F.lit(""))
    return r.select(
        *keep, "topic", empty("feedback").alias("feedback"), empty("question").alias("question"),
        tx.integer_score_only(F.col("r.score")).alias("score"), empty("confidence").try_cast("double").alias("confidence"),
        empty("direction").alias("direction"), empty("scoring_status").alias("scoring_status"),
        F.coalesce("r.ignored", F.lit(False)).alias("ignored"),
    )


PREDICTION_SCHEMA = """model string, topics array<struct<topic:string, feedback:array<struct<text:string>>,
 feedback_with_sentiment:array<struct<text:string, sentiment:string, score:string, reasoning:string, processing_time:double>>>>,
 metadata struct<total_time:double, num_feedbacks:bigint>"""


def read_predictions(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Model outputs of both layouts as rows (model, topic, text, sentiment, score, reasoning)."""
    raw = spark.read.schema(PREDICTION_SCHEMA).option("multiLine", multi_line).json(path)
    t = raw.select("model", F.explode("topics").alias("t"))
    empty = F.expr("cast(null as array<struct<text:string, sentiment:string, score:string, reasoning:string, processing_time:double>>)")
    plain = F.transform(
        "t.feedback",
        lambda f: F.struct(
            f["text"].alias("text"), F.lit(None).cast("string").alias("sentiment"), F.lit(None).cast("string").alias("score"),
            F.lit(None).cast("string").alias("reasoning"), F.lit(None).cast("double").alias("processing_time"),
        ),
    )
    items = F.coalesce("t.feedback_with_sentiment", plain, empty)
    x = t.select("model", F.col("t.topic").alias("topic"), F.col("t.feedback_with_sentiment").isNotNull().alias("scored"), F.explode(items).alias("i"))
    return x.select(
        "model", "topic", F.col("i.text").alias("text"),
        F.when(F.col("scored"), F.lower(tx.strip_space(F.coalesce("i.sentiment", F.lit("neutral"))))).alias("sentiment"),
        F.when(F.col("scored"), tx.clamp_score_default(F.col("i.score"))).alias("score"), "i.reasoning",
    )


# --- sinks --------------------------------------------------------------------------------


def write_reports(documents: DataFrame, path: str, by: Sequence[str] = ("course_id",), mode: str = "overwrite") -> None:
    """One JSON document per line, in a folder per course."""
    documents.select(*by, F.col("report_json").alias("value")).write.mode(mode).partitionBy(*by).text(path)


def combined_rows(rows: DataFrame, figures: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Flat export: a row per (topic, comment), one blank row for an empty topic; the summary stands on the first row.

    ``figures`` is dense (every topic of every report) and carries overall_score and summary.
    """
    numbered = row_numbers(rows, [*keys, "topic_no"], ["ord", "score", "confidence"], block_of(F.col("ord")), "_n")
    joined = figures.join(numbered, [*keys, "topic_no"], "left")
    leads = F.coalesce(F.col("_n"), F.lit(1)) == 1  # by position, so that equal rows do not repeat the summary
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return joined.select(
        *keys, "topic_no", "overall_score", "average_score", "scored_comment_count", "reliability",
        *[blank(c) for c in ("feedback", "score", "confidence", "scoring_status")],
        F.when(leads, F.col("summary")).otherwise("").alias("summary"),
    )


def write_csv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    rows.write.mode(mode).option("header", True).option("escape", '"').csv(path)


COMBINED_SCHEMA = """course_no int, term_year int, season string, topic_no int, overall_score double, average_score double, scored_comment_count bigint,
 reliability string, feedback string, score string, confidence string, scoring_status string, summary string"""


def read_combined(spark: SparkSession, path: str) -> DataFrame:
    """A written flat export; empty texts stay empty."""
    rows = spark.read.schema(COMBINED_SCHEMA).option("header", True).option("escape", '"').option("multiLine", False).csv(path)
    return rows.na.fill("", ["feedback", "score", "confidence", "scoring_status", "summary"])


def append_version(rows: DataFrame, path: str, run_ts: str) -> None:
    """Keep earlier reports: every run appends under its own time."""
    rows.withColumn("run_ts", F.lit(run_ts)).write.mode("append").partitionBy("run_ts").parquet(path)


def latest_version(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row per key."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*key, *[F.col(f"r.{c}").alias(c) for c in rest])


def export_selected(reports: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Reports named in the key list; unknown keys are skipped, finding none is an error."""
    found = reports.join(wanted.select(key).distinct(), key, "left_semi")
    if found.isEmpty():
        raise ValueError("No matching reports to export")
    return found


def append_history(record: DataFrame, path: str) -> None:
    record.write.mode("append").parquet(path)


def run_history(history: DataFrame, order: Sequence[str], success_only: bool = False) -> DataFrame:
    chosen = history.filter(F.col("status") == "Success") if success_only else history
    return chosen.orderBy(*[F.desc(c) for c in order])


def sheet_topics_wide(rows: DataFrame, topics: Sequence[tuple[int, str]], text: str = "feedback") -> DataFrame:
    """One row per feedback, a check mark per assigned topic."""
    marks = [F.max(F.when(F.col("topic_no") == no, "✓").otherwise("")).alias(name) for no, name in topics]
    return rows.groupBy(text).agg(*marks)


def sheet_scores_long(rows: DataFrame, topics: DataFrame) -> DataFrame:
    named = rows.join(F.broadcast(topics.select("topic_no", "topic")), "topic_no")
    return named.select(
        F.col("feedback").alias("Feedback"), F.col("topic").alias("Topic"), F.coalesce("sentiment", F.lit("neutral")).alias("Sentiment"),
        F.coalesce("score", F.lit(2)).alias("Score"), F.coalesce("reasoning", F.lit("")).alias("Reasoning"),
    )


def write_eval_run(summary: DataFrame, scores: DataFrame, path: str, run: str) -> None:
    """Summary as JSON and the per-pair scores as CSV, under ``run=<name>``."""
    summary.write.mode("overwrite").json(f"{path}/run={run}/summary")
    write_csv(scores, f"{path}/run={run}/scores")


def stack_models(parts: dict[str, DataFrame]) -> DataFrame:
    """Tables of several models under one ``model`` column; columns a model lacks are null."""
    out = None
    for name, part in parts.items():
        p = part.withColumn("model", F.lit(name))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def evolve(old: DataFrame, new: DataFrame) -> DataFrame:
    """Older rows gain the newer nullable columns."""
    return old.unionByName(new, allowMissingColumns=True)
