"""Domain tables derived from the driver's tables, as SQL that Spark and DuckDB both read.

``view(spark, sf_dir, name)`` gives the DataFrame; ``with_views(sql)`` puts the same definitions in front of a
query text as common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from feedloom import dims

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_text_list(values) -> str:
    return ", ".join(_q(v) for v in values)


_TOPIC_ROWS = ", ".join(f"({no}, {_q(t)}, {_q(s)}, {th})" for no, t, s, th in dims.TOPICS)

VIEWS: dict[str, str] = {
    "assignments": """
SELECT CAST(l_suppkey % 20 AS INT) AS course_no,
       CAST(year(l_shipdate) AS INT) AS term_year,
       CASE WHEN month(l_shipdate) <= 3 THEN 'Winter' WHEN month(l_shipdate) <= 6 THEN 'Spring'
            WHEN month(l_shipdate) <= 9 THEN 'Summer' ELSE 'Fall' END AS season,
       l_orderkey AS ord,
       concat('comment ', CAST(l_orderkey AS STRING)) AS feedback,
       CAST(1 + l_partkey % 13 AS INT) AS topic_no,
       CASE WHEN l_partkey % 13 = 12 OR CAST(l_quantity AS INT) % 6 = 0 THEN NULL
            ELSE CAST(CAST(l_quantity AS INT) % 6 AS INT) END AS score,
       round(l_discount * 10, 2) AS confidence,
       CASE WHEN l_partkey % 13 <> 1 THEN NULL WHEN l_returnflag = 'A' THEN 'too_fast'
            WHEN l_returnflag = 'R' THEN 'too_slow' ELSE 'appropriate' END AS direction,
       CASE WHEN l_tax > 0.075 THEN 'model_error' ELSE 'scored' END AS scoring_status,
       l_linenumber <> 7 AS topic_supported,
       l_tax < 0.005 AS ignored
FROM lineitem""",
    "topics": f"""
SELECT CAST(t.n AS INT) AS topic_no, t.topic, t.short_name, CAST(t.th AS DOUBLE) AS threshold
FROM (VALUES {_TOPIC_ROWS}) AS t(n, topic, short_name, th)""",
    "comments": """
SELECT source AS course_id, doc_id AS ord, text, concat('Question ', lang) AS question, lang = 'de' AS non_teaching
FROM documents""",
    "report_lines": {
        "spark": """
SELECT doc_id, CAST(pos AS BIGINT) AS pos, line FROM documents LATERAL VIEW posexplode(split(text, '\\n')) x AS pos, line""",
        "duckdb": """
SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, parts[i] AS line
FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) d, LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i) r""",
    },
    "examples": """
SELECT item_id AS ex_id, text AS feedback, CAST(1 + item_id % 12 AS INT) AS topic_no, CAST(1 + item_id % 5 AS INT) AS score
FROM benchmark""",
    "noise_labels": """
SELECT d.doc_id, d.text, CAST(l.quality AS INT) AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "usage_log": {
        "spark": """
SELECT event_id AS id, user_id, ts AS created_at, event_type = 'signup' AS used_own_key,
       CAST(get_json_object(props, '$.k') AS BIGINT) * 100 AS input_tokens,
       CAST(get_json_object(props, '$.k') AS BIGINT) * 80 AS cached_input_tokens,
       CAST(get_json_object(props, '$.k') AS BIGINT) * 10 AS output_tokens, value / 1000 AS cost_usd
FROM events""",
        "duckdb": """
SELECT event_id AS id, user_id, ts AS created_at, event_type = 'signup' AS used_own_key,
       CAST(json_extract_string(props, '$.k') AS BIGINT) * 100 AS input_tokens,
       CAST(json_extract_string(props, '$.k') AS BIGINT) * 80 AS cached_input_tokens,
       CAST(json_extract_string(props, '$.k') AS BIGINT) * 10 AS output_tokens, value / 1000 AS cost_usd
FROM events""",
    },
    "users": """
SELECT c_custkey AS id, c_name AS name,
       CASE WHEN c_mktsegment IN ('MACHINERY', 'BUILDING') THEN 'our_key_capped'
            WHEN c_mktsegment = 'FURNITURE' THEN 'our_key_unlimited' ELSE 'own_key' END AS credit_mode,
       CASE WHEN c_mktsegment IN ('MACHINERY', 'BUILDING') THEN CAST(c_custkey % 5 AS DOUBLE) ELSE NULL END AS yearly_cap_usd,
       CASE WHEN c_nationkey < 20 THEN 'approved' WHEN c_nationkey < 23 THEN 'pending' ELSE 'disabled' END AS status
FROM customer""",
    "uploads": """
SELECT p_partkey AS id, p_partkey % 150 AS owner_id, p_name AS original_filename, CAST(p_retailprice * 1000 AS BIGINT) AS size_bytes
FROM part""",
    "reports": """
SELECT o_orderkey AS id, o_custkey AS owner_id, (o_orderkey * 2) % 5000 AS upload_id, o_orderpriority AS course,
       CASE WHEN o_orderstatus = 'P' THEN NULL
            ELSE concat(CASE WHEN month(o_orderdate) <= 6 THEN 'Spring ' ELSE 'Fall ' END, CAST(year(o_orderdate) AS STRING)) END AS term,
       o_totalprice / 100000 AS overall_score, o_orderdate AS created_at
FROM orders""",
    # Labels over the whole table; the same (ord, topic) may occur more than once.
    "gold_scores": """
SELECT l_orderkey AS ord, CAST(1 + l_partkey % 12 AS INT) AS topic_no, l_linenumber AS rep,
       CAST(1 + CAST(l_quantity AS INT) % 5 AS INT) AS score
FROM lineitem""",
    "pred_scores": {
        "spark": """
SELECT m.model, l_orderkey AS ord, CAST(1 + l_partkey % 12 AS INT) AS topic_no, l_linenumber AS rep,
       CASE WHEN l_linenumber = 7 THEN NULL
            WHEN m.model = 'a' THEN CAST(greatest(1, least(5, CAST(l_quantity AS INT) % 5 + CAST(l_suppkey % 3 AS INT))) AS INT)
            ELSE CAST(1 + l_suppkey % 5 AS INT) END AS score
FROM lineitem LATERAL VIEW explode(array('a', 'b')) m AS model""",
        "duckdb": """
SELECT m.model, l_orderkey AS ord, CAST(1 + l_partkey % 12 AS INT) AS topic_no, l_linenumber AS rep,
       CASE WHEN l_linenumber = 7 THEN NULL
            WHEN m.model = 'a' THEN CAST(greatest(1, least(5, CAST(l_quantity AS INT) % 5 + CAST(l_suppkey % 3 AS INT))) AS INT)
            ELSE CAST(1 + l_suppkey % 5 AS INT) END AS score
FROM lineitem CROSS JOIN (VALUES ('a'), ('b')) AS m(model)""",
    },
    # Human and predicted topic sets over the whole table: the prediction differs on late line numbers.
    "gold_topics": """
SELECT DISTINCT l_orderkey AS ord, CAST(1 + l_partkey % 13 AS INT) AS topic_no FROM lineitem""",
    "pred_topics": """
SELECT DISTINCT l_orderkey AS ord,
       CAST(1 + (CASE WHEN l_linenumber >= 4 THEN l_suppkey ELSE l_partkey END) % 13 AS INT) AS topic_no FROM lineitem""",
}


def view_sql(name: str, engine: str) -> str:
    body = VIEWS[name]
    return (body[engine] if isinstance(body, dict) else body).strip()


# A caller whose text file has fewer row groups than the machine has cores may ask for its rows to be dealt out by key
# (the benchmark does; its file has one). Unless asked for, tables are read as they are, at any size.
TEXT_TABLES = {"documents": "doc_id"}
SPREAD = "spark.feedloom.spreadTexts"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    tasks = spark.conf.get(SPREAD, None)
    if tasks and name in TEXT_TABLES:
        return df.repartition(int(tasks), TEXT_TABLES[name])
    return df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = view_sql(name, "spark")
    used = [t for t in BASE_TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", text)]
    for t in used:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})


def with_views(sql: str) -> str:
    """Prefix a DuckDB query with the views it names."""
    sql = sql.strip()
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    if not used:
        return sql
    ctes = ", ".join(f"{n} AS ({view_sql(n, 'duckdb')})" for n in used)
    recursive = bool(re.match(r"WITH RECURSIVE\b", sql, re.I))
    rest = re.sub(r"^WITH (RECURSIVE )?", ", ", sql, count=1, flags=re.I) if re.match(r"WITH\b", sql, re.I) else " " + sql
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}{rest}"
