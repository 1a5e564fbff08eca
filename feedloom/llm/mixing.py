"""Mixing sources to target weights by raking (iterative proportional fitting).

Tokens are counted per cell of source, language and topic. Sampling rates of the cells start equal and are fitted to the
targets of one marginal after the other; a rate above one is cut to one, as no document is taken twice, and the next
steps hand what was cut to the other cells. Documents are then drawn by their cell's rate with a hash of the id, so a
draw does not depend on the order or placement of rows.

The corpus is read twice (counting, drawing); the fitting works on the table of cells, one row per combination that
occurs, entirely as DataFrame aggregates and joins.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.rows import packed, unpacked
from feedloom.operators.stages import written

DIMENSIONS = ("source", "lang", "topic")
BUDGET = 0.7  # part of all tokens that the mix shall have
EVENNESS = 0.7  # without given targets, a share s of the corpus has the target s ** EVENNESS, up to scale
ROUNDS = 8
NONE = "(none)"

# Fixed for Spark and DuckDB alike.
_WORD = r"[^\x20\x09-\x0D]+"
_TOPIC = """CASE WHEN text LIKE '%icense%' OR text LIKE '%ICENSE%' THEN 'licensed'
     WHEN text LIKE '%|%|%|%' THEN 'tabular'
     WHEN length(text) - length({bare}) > 0.02 * length(text) THEN 'marked'
     WHEN length(text) < 300 THEN 'brief' ELSE 'prose' END"""


def topic(text: Column) -> Column:
    """A coarse topic by form: licensed, tabular, marked, brief or prose. A null text is prose."""
    bare = text
    for c in "#*$%&":
        bare = F.replace(bare, F.lit(c), F.lit(""))
    n = F.length(text)
    return (
        F.when(text.contains("icense") | text.contains("ICENSE"), "licensed")
        .when(text.like("%|%|%|%"), "tabular")
        .when(n - F.length(bare) > 0.02 * n, "marked")
        .when(n < 300, "brief")
        .otherwise("prose")
    )


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, budget: float = BUDGET, rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with ``rate``, the sampling rate of each cell.

    ``targets`` gives per dimension the weights of its values; a dimension without them follows the corpus, evened out.
    A value without a weight in given targets gets none of the mix. Values are not null.
    """
    cells = written(cells.select(*DIMENSIONS, "tokens"))
    total = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    state = cells.withColumn("rate", F.lit(float(budget)))
    for d in DIMENSIONS:  # every cell gets the tokens that the mix shall have of its value
        share = cells.groupBy(d).agg((F.sum("tokens") / F.lit(float(max(total, 1)))).alias("_share"))
        if targets and d in targets:
            given = cells.sparkSession.createDataFrame([(str(k), float(v)) for k, v in targets[d].items()], "_value string, _weight double")
            share = share.join(given, F.col(d) == F.col("_value"), "left").select(d, F.coalesce("_weight", F.lit(0.0)).alias("_weight"))
        else:
            share = share.select(d, F.pow("_share", F.lit(EVENNESS)).alias("_weight"))
        share = written(share)
        weights = share.agg(F.sum("_weight")).first()[0] or 1.0
        state = state.join(share.select(d, (F.col("_weight") / F.lit(float(weights)) * F.lit(float(total * budget))).alias(f"_want_{d}")), d)
    state = written(state)
    for _ in range(rounds):
        for d in DIMENSIONS:
            now = state.groupBy(d).agg(F.sum(F.col("tokens") * F.col("rate")).alias("_now"))
            fitted = F.when(F.col("_now") > 0, F.least(F.lit(1.0), F.col("rate") * F.col(f"_want_{d}") / F.col("_now"))).otherwise(F.col("rate"))
            state = state.join(now, d).withColumn("rate", fitted).drop("_now")
        state = written(state)
    return state.select(*DIMENSIONS, "tokens", "rate")


def draw(doc: Column, text: Column) -> Column:
    """A number in [0, 1) from the id; from the text where the id is null."""
    key = F.concat(F.coalesce(doc.cast("string"), F.md5(text), F.lit("")), F.lit("|mix"))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def mix(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, budget: float = BUDGET, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``_mix``: a struct of topic, rate and kept (an input column of that name is replaced).

    Null sources and languages are values like any other. Rows that share an id are kept or left out together. A cell
    without tokens keeps the starting rate. An empty table stays empty.
    """
    body = F.col(text).cast("string")
    keys = [F.coalesce(F.col("source").cast("string"), F.lit(NONE)).alias("source"), F.coalesce(F.col("lang").cast("string"), F.lit(NONE)).alias("lang"), topic(body).alias("topic")]
    cells = docs.select(*keys, n_tokens(body).alias("_n")).groupBy(*DIMENSIONS).agg(F.sum("_n").alias("tokens"))
    rates = rake(cells, targets, budget).select(F.struct(*DIMENSIONS).alias("_cell"), F.col("rate").alias("_rate"))
    found = packed(docs.drop("_mix"), F.struct(*keys).alias("_key"), draw(F.col(doc), body).alias("_draw")).join(rates, F.col("_key") == F.col("_cell"), "left")
    kept = F.col("_draw") < F.col("_rate")
    return unpacked(found, F.struct(F.col("_key.topic").alias("topic"), F.col("_rate").alias("rate"), kept.alias("kept")).alias("_mix"))


def shares(cells: DataFrame) -> DataFrame:
    """(dimension, value, share): expected shares of the mix after raking, to be held against the targets."""
    total = cells.agg(F.sum(F.col("tokens") * F.col("rate")).alias("_all"))
    parts = [cells.groupBy(F.lit(d).alias("dimension"), F.col(d).alias("value")).agg(F.sum(F.col("tokens") * F.col("rate")).alias("_part")) for d in DIMENSIONS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).join(F.broadcast(total)).select("dimension", "value", (F.col("_part") / F.col("_all")).alias("share"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    found = mix(docs)
    return found.select("doc_id", "_mix.topic", F.round("_mix.rate", 6).alias("rate"), "_mix.kept")


def _sql() -> str:
    bare = "text"
    for c in "#*$%&":
        bare = f"replace({bare}, '{c}', '')"
    steps = [
        f"""d AS MATERIALIZED (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang,
  {_TOPIC.format(bare=bare)} AS topic, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0) AS n,
  ('0x' || substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), md5(text), ''), '|mix')), 1, 13))::BIGINT / {1 << 52}.0 AS u
FROM documents)""",
        f"c0 AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n) AS DOUBLE) AS tokens, CAST({BUDGET} AS DOUBLE) AS rate FROM d GROUP BY ALL)",
        "a AS (SELECT sum(tokens) AS total FROM c0)",
    ]
    for d in DIMENSIONS:
        steps.append(f"w_{d} AS MATERIALIZED (SELECT {d}, w / sum(w) OVER () * total * {BUDGET} AS want FROM (SELECT {d}, pow(sum(tokens) / any_value(total), {EVENNESS}) AS w, any_value(total) AS total FROM c0, a GROUP BY 1))")
    last = "c0"
    for i in range(ROUNDS * len(DIMENSIONS)):
        d = DIMENSIONS[i % len(DIMENSIONS)]
        name = f"c{i + 1}"
        steps.append(
            f"{name} AS MATERIALIZED (SELECT source, lang, topic, tokens, CASE WHEN now > 0 THEN least(1.0, rate * want / now) ELSE rate END AS rate "
            f"FROM (SELECT *, sum(tokens * rate) OVER (PARTITION BY {d}) AS now FROM {last}) JOIN w_{d} USING ({d}))"
        )
        last = name
    return "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, topic, round(rate, 6) AS rate, u < rate AS kept FROM d JOIN {last} USING (source, lang, topic)"


OP2_SQL = _sql()
