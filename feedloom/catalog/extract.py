"""Profiling, wide-table extraction and line segmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom import dims
from feedloom.catalog.base import query
from feedloom.catalog.text import (
    DICT, LINES_SQL, SENTENCE_END, WS, dictionary, lines, rr, sql_bullets, sql_clean, sql_key, sql_noise, sql_question,
    sql_ratio_cte, sql_scale, sql_squish, sql_strip, sql_ws,
)
from feedloom.functions import text as tx
from feedloom.functions.numbers import sql_half_even
from feedloom.operators import extract as ex
from feedloom.operators import lines as ln
from feedloom.operators import prepare as pr
from feedloom.views import sql_text_list, table, view

COLUMNS = ["text", "lang", "source of dataset", "n_chars", "rating"]


def wide(spark, sf):
    """Documents as a survey export: one file per source, one row per document."""
    return table(spark, sf, "documents").select(
        F.col("source").alias("file"),
        "doc_id",
        "text",
        "lang",
        F.col("source").alias("source of dataset"),
        "n_chars",
        (1 + F.col("doc_id") % 5).alias("rating"),
    )


def cells(spark, sf):
    return ex.long_cells(wide(spark, sf), ["file", "doc_id"], COLUMNS)


_UNPIVOT = " UNION ALL ".join(
    f"SELECT source AS file, doc_id, '{c}' AS col, CAST({e} AS STRING) AS v FROM documents"
    for c, e in zip(COLUMNS, ["text", "lang", "source", "n_chars", "1 + doc_id % 5"])
)
CELLS = f"""
cells AS ({_UNPIVOT}),
filled AS (SELECT file, doc_id, col, {sql_strip('v')} AS v FROM cells),
prof AS (SELECT file, col, count(*) AS filled, avg(CASE WHEN regexp_full_match(v, '[\\d.\\-/: ]+') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS number_like,
  CAST(median(length(v)) AS DOUBLE) AS median_length, CAST(count(DISTINCT v) AS DOUBLE) / count(*) AS distinct_ratio FROM filled WHERE v <> '' GROUP BY ALL),
profile AS (SELECT *, filled >= 3 AND number_like <= 0.5 AND median_length >= 12 AND distinct_ratio >= 0.3 AS free_text FROM prof)"""
META = f"regexp_matches(col, '(?i){dims.META_COLUMN}')"


@query("profile_columns", f'WITH {CELLS} SELECT file, col AS "column", filled, number_like, median_length, distinct_ratio, free_text FROM profile')
def profile_columns(spark, sf):
    return ex.profile_columns(cells(spark, sf), ["file"])


@query(
    "detect_layout",
    f"""WITH {CELLS}, s AS (SELECT file, col, count(*) AS rows FROM cells GROUP BY ALL)
SELECT s.file, max(rows) AS rows, count(*) AS columns, CASE WHEN max(rows) >= 3 AND count(*) >= 3 AND count(*) FILTER (col LIKE 'Unnamed%') <= count(*) / 2
 AND bool_or(NOT {META} AND coalesce(free_text, false)) THEN 'tabular-export' ELSE 'report-table' END AS parser FROM s LEFT JOIN profile USING (file, col) GROUP BY s.file""",
)
def detect_layout(spark, sf):
    c = cells(spark, sf)
    shape = c.groupBy("file", "column").agg(F.count("*").alias("rows"))
    return ex.detect_layout(shape, ex.profile_columns(c, ["file"]), ["file"])


@query("drop_meta_columns", f'WITH {CELLS} SELECT file, doc_id, col AS "column" FROM cells WHERE NOT {META}')
def drop_meta_columns(spark, sf):
    return ex.drop_meta_columns(cells(spark, sf)).select("file", "doc_id", "column")


def sql_keep(x: str) -> str:
    no_answer = f"{rr(f'lower({x})', '^[ !.]+|[ !.]+$', '')} IN ({sql_text_list(dims.NO_ANSWER)})"
    return f"(NOT {sql_noise(x)} AND NOT {no_answer} AND NOT {sql_question(x)} AND len(list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')) >= 2)"


TIDY = f"""{CELLS}, {DICT},
src AS (SELECT c.file, c.doc_id AS id, c.col, {sql_clean('v')} AS x FROM cells c JOIN profile p ON p.file = c.file AND p.col = c.col AND free_text WHERE NOT regexp_matches(c.col, '(?i){dims.META_COLUMN}')),
{sql_ratio_cte('src', 'er')},
tidy AS (SELECT e.id, e.x, s.file, s.col, CASE WHEN ratio < 0.6 AND NOT ({rr('lower(e.x)', '^[ !.]+|[ !.]+$', '')} IN ({sql_text_list(dims.NO_ANSWER)})) THEN 'garbage' WHEN {sql_keep('e.x')} THEN 'response' ELSE 'dropped' END AS status
  FROM er e JOIN src s USING (id))"""


@query("tidy_responses", f"""WITH {TIDY} SELECT file, id AS doc_id, col AS "column", col AS question, x AS text, status FROM tidy WHERE x <> ''""")
def tidy_responses(spark, sf):
    c = cells(spark, sf)
    return ex.tidy_responses(c, ex.profile_columns(c, ["file"]), dictionary(spark, sf), ["doc_id"], ["file"])


def joined_map(c: str):
    return F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")


@query(
    "rating_distribution",
    f"""WITH {CELLS}, v AS (SELECT c.file, c.col, {sql_clean('v')} AS v FROM cells c JOIN profile p ON p.file = c.file AND p.col = c.col WHERE NOT free_text AND NOT regexp_matches(c.col, '(?i){dims.META_COLUMN}')),
n AS (SELECT file, col, v, count(*) AS n FROM v WHERE v <> '' GROUP BY ALL)
SELECT file, col AS "column", CAST(sum(n) AS BIGINT) AS n, CASE WHEN bool_and(TRY_CAST(v AS DOUBLE) IS NOT NULL) THEN {sql_half_even('sum(TRY_CAST(v AS DOUBLE) * n) / CAST(sum(n) AS DOUBLE)', 2)} END AS mean,
 string_agg(v || '=' || n, ',' ORDER BY v) AS distribution FROM n GROUP BY file, col HAVING count(*) <= 12""",
)
def rating_distribution(spark, sf):
    c = cells(spark, sf)
    out = ex.rating_distribution(c, ex.profile_columns(c, ["file"]), ["file"])
    return out.withColumn("distribution", joined_map("distribution"))


QUESTIONS = """CASE WHEN lang = 'en' THEN concat(CAST(doc_id AS STRING), '. How was the part ', source, '?')
 ELSE concat(CAST(doc_id AS STRING), '. Please restate your answer to Question ', CAST(doc_id + 20 AS STRING), ' here.') END"""


@query(
    "question_reference",
    f"""WITH q AS (SELECT source AS file, doc_id, {QUESTIONS} AS question, CASE WHEN lang = 'en' THEN NULL ELSE doc_id + 20 END AS ref FROM documents)
SELECT a.file, a.doc_id, CASE WHEN b.doc_id IS NOT NULL THEN concat(a.question, ' (Question ', b.question, ')') ELSE a.question END AS question
FROM q a LEFT JOIN q b ON a.file = b.file AND a.ref = b.doc_id""",
)
def question_reference(spark, sf):
    q = table(spark, sf, "documents").selectExpr("source AS file", "doc_id", f"{QUESTIONS} AS question")
    return ex.question_reference(q, ["file"], order="doc_id")


# A rating grid: one sheet per hundred orders, one row per order, one cell per line.
GRID = """SELECT CAST(floor(l_orderkey / 100) AS BIGINT) AS sheet, l_orderkey AS row_no, CAST(l_linenumber AS INT) AS col,
 min(CASE WHEN l_orderkey % 8 = 0 THEN CASE l_linenumber WHEN 1 THEN 'Outstanding' WHEN 2 THEN 'Very good' WHEN 4 THEN 'Satisfactory' WHEN 5 THEN 'Poor' WHEN 6 THEN 'Responses' ELSE 'Good' END
  WHEN l_linenumber = 1 THEN CASE WHEN l_orderkey % 3 = 0 THEN concat('Assess the overall organization of course number ', CAST(l_orderkey AS STRING), ':')
   WHEN l_orderkey % 3 = 1 THEN concat('Item ', CAST(l_orderkey AS STRING)) ELSE '3.5' END
  ELSE concat(CAST(CAST(l_quantity AS INT) AS STRING), '% (', CAST(CAST(l_quantity AS INT) AS STRING), ')') END) AS text
FROM {src} GROUP BY CAST(floor(l_orderkey / 100) AS BIGINT), l_orderkey, l_linenumber"""


def grid(spark, sf):
    g = spark.sql(GRID, src=table(spark, sf, "lineitem"))
    return ex.scale_header_rows(ex.grid_rows(g, ["sheet"]), ["sheet"])


GRID_SQL = f"""
grid AS ({GRID.replace('{src}', 'lineitem')}),
marked AS (SELECT *, {sql_scale('text')} IS NOT NULL OR {sql_squish('text')} IN ({sql_text_list(dims.NOISE_WORDS)}) AS is_scale,
  regexp_full_match(text, '\\d+(\\.\\d+)?%\\s*\\(\\d+\\)') AS is_pct FROM grid),
gr AS (SELECT sheet, row_no, count(*) AS c, count(*) FILTER (is_scale) AS s, count(*) FILTER (is_pct) AS p,
  arg_min(text, col) FILTER (NOT is_pct AND NOT regexp_full_match(text, '[\\d.]+')) AS own FROM marked GROUP BY ALL),
gk AS (SELECT *, CASE WHEN s >= 2 AND s >= c - 1 THEN 'header' WHEN p >= 2 THEN 'percent' ELSE 'text' END AS kind FROM gr),
gh AS (SELECT *, max(CASE WHEN kind = 'header' THEN row_no END) OVER (PARTITION BY sheet ORDER BY row_no) AS header_row,
  last_value(CASE WHEN kind = 'percent' AND length(own) >= 40 THEN own END IGNORE NULLS) OVER (PARTITION BY sheet ORDER BY row_no ROWS UNBOUNDED PRECEDING) AS long_label FROM gk)"""


@query(
    "scale_header_rows",
    f"""WITH {GRID_SQL} SELECT h.sheet, h.row_no, kind, long_label, coalesce(t.labels, '') AS header FROM gh h
LEFT JOIN (SELECT row_no, string_agg(col || '=' || text, ',' ORDER BY col) AS labels FROM marked WHERE is_scale GROUP BY row_no) t ON t.row_no = h.header_row""",
)
def scale_header_rows(spark, sf):
    labels = F.array_join(F.transform("header", lambda h: F.concat(h["col"].cast("string"), F.lit("="), h["text"])), ",")
    return grid(spark, sf).select("sheet", "row_no", "kind", "long_label", F.coalesce(labels, F.lit("")).alias("header"))


LABEL_SQL = """CASE WHEN own IS NULL THEN long_label WHEN length(own) < 40 AND long_label IS NOT NULL AND own <> long_label THEN concat(long_label, ' — ', own) ELSE own END"""


@query("rating_row_label", f"WITH {GRID_SQL} SELECT sheet, row_no, {LABEL_SQL} AS question FROM gh WHERE kind = 'percent'")
def rating_row_label(spark, sf):
    g = grid(spark, sf).filter(F.col("kind") == "percent")
    return g.select("sheet", "row_no", ex.rating_row_label(F.col("own_label"), F.col("long_label")).alias("question"))


@query(
    "percent_rows",
    f"""WITH {GRID_SQL}, pc AS (SELECT h.sheet, h.row_no, {LABEL_SQL} AS question, m.col, CAST(regexp_extract(m.text, '\\((\\d+)\\)', 1) AS BIGINT) AS n,
  (SELECT arg_min(CASE WHEN abs(s.col - m.col) <= 1 THEN s.text END, abs(s.col - m.col) * 1000 + s.col) FROM marked s WHERE s.row_no = h.header_row AND s.is_scale) AS near
  FROM gh h JOIN marked m ON m.row_no = h.row_no AND m.is_pct WHERE kind = 'percent'),
pn AS (SELECT *, coalesce(near, concat('column ', col)) AS name FROM pc), pv AS (SELECT *, {sql_scale('name')} AS v FROM pn),
d AS (SELECT sheet, row_no, question, name, min(col) AS first_col, sum(n) AS n, sum(n * v) AS w, sum(n) FILTER (v IS NOT NULL) AS c FROM pv GROUP BY ALL)
SELECT sheet, row_no, question, CAST(sum(n) AS BIGINT) AS n, CASE WHEN sum(c) > 0 THEN {sql_half_even('CAST(sum(w) AS DOUBLE) / CAST(sum(c) AS DOUBLE)', 2)} END AS mean,
 string_agg(name || '=' || n, ',' ORDER BY first_col) AS distribution FROM d GROUP BY ALL""",
)
def percent_rows(spark, sf):
    return ex.percent_rows(grid(spark, sf), ["sheet"]).withColumn("distribution", joined_map("distribution"))


# --- lines ---------------------------------------------------------------------------------
# Two columns of cells: odd lines stand in the second column, two lines share a row.
PLACED = "doc_id, CAST(floor(pos / 20) * 2 + pos % 2 AS BIGINT) AS row_no, CAST(floor(pos / 10) % 2 AS BIGINT) AS col, pos"
LNS = f"""{LINES_SQL},
cl AS (SELECT {PLACED}, {sql_clean('x')} AS text FROM lines),
ln0 AS (SELECT *, {sql_noise('text')} AS noise, {sql_question('text')} AS quest,
  regexp_matches(text, '(?i){dims.RATING_SECTION}') AS rating, regexp_matches(text, '^\\p{{Ll}}') AS low FROM cl WHERE text <> ''),
lns AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM ln0),
cells AS (SELECT *, row_number() OVER (PARTITION BY doc_id, col ORDER BY row_no) AS n FROM ln0)"""


def clean_lines(spark, sf):
    """Cleaned lines with their position, and their row and column as cells."""
    l = lines(spark, sf).selectExpr(*[c.strip() for c in PLACED.split(", ")], "x AS text")
    return tx.with_once(l, "text", tx.clean_text(F.col("text"))).filter(F.col("text") != "")


SEG = f"""{LNS},
seg AS (SELECT doc_id, col, n, row_no AS bpos, text AS acc FROM cells WHERE n = 1
 UNION ALL SELECT doc_id, col, n, CASE WHEN cont THEN bpos ELSE row_no END, CASE WHEN cont THEN concat(acc, ' ', text) ELSE text END
 FROM (SELECT l.doc_id, l.col, l.n, l.row_no, l.text, s.bpos, s.acc, NOT noise AND NOT quest AND NOT rating AND NOT {sql_noise('s.acc')} AND NOT {sql_question('s.acc')}
   AND (low OR NOT regexp_matches(s.acc, '{SENTENCE_END}')) AS cont FROM seg s JOIN cells l ON l.doc_id = s.doc_id AND l.col = s.col AND l.n = s.n + 1)),
blocks AS (SELECT doc_id, col, bpos AS pos, arg_max(acc, n) AS text FROM seg GROUP BY doc_id, col, bpos)"""


def blocks(spark, sf):
    return ln.segment_lines(clean_lines(spark, sf).drop("pos").withColumnRenamed("row_no", "pos"))


@query("segment_lines", f"WITH RECURSIVE {SEG} SELECT doc_id, col, pos, text FROM blocks")
def segment_lines(spark, sf):
    return blocks(spark, sf)


@query(
    "merge_paragraphs",
    f"""WITH RECURSIVE {LNS}, seg AS (SELECT doc_id, n, pos AS bpos, col AS bcol, text AS acc FROM lns WHERE n = 1
 UNION ALL SELECT doc_id, n, CASE WHEN cont THEN bpos ELSE pos END, CASE WHEN cont THEN bcol ELSE col END, CASE WHEN cont THEN concat(acc, ' ', text) ELSE text END
 FROM (SELECT *, (col = bcol OR uq) AND low AND NOT regexp_matches(acc, '{SENTENCE_END}') AND (NOT pq OR uq) AS cont
  FROM (SELECT *, pq AND regexp_matches(acc, '^\\d+\\.\\s') AND NOT regexp_matches(rtrim(acc), '[:?.)]$') AS uq
   FROM (SELECT l.*, s.bpos, s.bcol, s.acc, {sql_question('s.acc')} AS pq FROM seg s JOIN lns l ON l.doc_id = s.doc_id AND l.n = s.n + 1))))
SELECT doc_id, bpos AS pos, any_value(bcol) AS col, arg_max(acc, n) AS text FROM seg GROUP BY doc_id, bpos""",
)
def merge_paragraphs(spark, sf):
    return ln.merge_paragraphs(clean_lines(spark, sf).drop("row_no"), ["doc_id"])


BLOCK = "concat('Comments', chr(10), 'What helped?', chr(10), text)"


@query(
    "column_bucket",
    f"""WITH b AS (SELECT doc_id, n_chars % 600 AS x0, {sql_bullets(BLOCK)} AS t FROM documents),
u AS (SELECT doc_id, x0, {sql_clean('l')} AS l, i FROM (SELECT doc_id, x0, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM b)),
n AS (SELECT doc_id, x0, l, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, count(*) OVER (PARTITION BY doc_id) AS c,
  {sql_noise('l')} OR {sql_question('l')} OR {sql_squish('l')} = 'comments' AS lab FROM u WHERE l <> ''),
k AS (SELECT *, least(c - 1, coalesce(min(n) FILTER (NOT lab) OVER (PARTITION BY doc_id) - 1, c)) AS k FROM n)
SELECT doc_id, CAST(n - 1 AS INT) AS part, 0::BIGINT AS col, l AS text FROM k WHERE n <= k
UNION ALL SELECT doc_id, CAST(any_value(k) AS INT), CAST(floor(any_value(x0) / 60) + 1 AS BIGINT), string_agg(l, ' ' ORDER BY n) FROM k WHERE n > k GROUP BY doc_id""",
)
def column_bucket(spark, sf):
    b = table(spark, sf, "documents").selectExpr("doc_id", "n_chars % 600 AS x0", "concat('Comments\\nWhat helped?\\n', text) AS text")
    return ln.column_bucket(b, ["doc_id"])


ASSIGN = f"""{SEG},
k0 AS (SELECT doc_id, col, pos, text AS t0, regexp_replace(text, '(?i)^comments{WS}*:?{WS}*-?{WS}+', '') AS bare FROM blocks),
k1 AS (SELECT doc_id, col, pos, CASE WHEN bare <> t0 AND len(list_filter(regexp_split_to_array(bare, '{WS}+'), lambda w: w <> '')) >= 2 THEN bare ELSE t0 END AS text FROM k0),
k2 AS (SELECT *, CASE WHEN regexp_matches(text, '(?i){dims.RATING_SECTION}') AND length(text) < 120 THEN 'rating' WHEN {sql_question('text')} THEN 'question'
  WHEN regexp_matches({sql_strip('text')}, '{tx.NUMBERED}') THEN 'item' ELSE 'text' END AS kind FROM k1),
own AS (SELECT *, CASE kind WHEN 'question' THEN {rr('text', '[ -]+$', '')} WHEN 'item' THEN text END AS own FROM k2),
nums AS (SELECT *, nullif(regexp_extract(own, '^(\\d+)\\.\\s', 1), '') AS num, CASE WHEN kind = 'question' THEN nullif(regexp_extract(own, '(?i)answer to question (\\d+)', 1), '') END AS wanted FROM own),
aims AS (SELECT a.doc_id, a.pos, a.col, arg_max(b.own, b.pos * 10 + b.col) AS target FROM nums a JOIN nums b ON a.doc_id = b.doc_id AND a.wanted = b.num AND (b.pos, b.col) <= (a.pos, a.col) GROUP BY ALL),
k3 AS (SELECT *, last_value(CASE kind WHEN 'question' THEN own || coalesce(' (Question ' || target || ')', '') WHEN 'rating' THEN '' WHEN 'item' THEN '' END IGNORE NULLS) OVER w AS q,
  last_value(CASE kind WHEN 'rating' THEN true WHEN 'question' THEN false END IGNORE NULLS) OVER w AS sec FROM nums LEFT JOIN aims USING (doc_id, pos, col)
  WINDOW w AS (PARTITION BY doc_id ORDER BY pos, col ROWS UNBOUNDED PRECEDING)),
assigned AS (SELECT doc_id, col, pos, text, nullif(q, '') AS question FROM k3 WHERE kind = 'text'
  AND NOT (coalesce(sec, false) AND len(list_filter(regexp_split_to_array(text, '{WS}+'), lambda w: w <> '')) < 15))"""


def assigned(spark, sf):
    return ln.assign_question(blocks(spark, sf), ["doc_id"])


@query("assign_question", f"WITH RECURSIVE {ASSIGN} SELECT doc_id, col, pos, text, question FROM assigned")
def assign_question(spark, sf):
    return assigned(spark, sf)


@query("keep_response", f"WITH RECURSIVE {ASSIGN} SELECT doc_id, col, pos, text, question FROM assigned WHERE {sql_keep('text')}")
def keep_response(spark, sf):
    return ln.keep_response(assigned(spark, sf))


def with_source(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("file"))
    return ln.keep_response(assigned(spark, sf)).join(d, "doc_id")


DEDUPED = f"""{ASSIGN}, dr AS (SELECT source AS file, doc_id, col, pos, a.text, question FROM assigned a JOIN documents d USING (doc_id) WHERE {sql_keep('a.text')}
  QUALIFY row_number() OVER (PARTITION BY source, question, a.text ORDER BY doc_id, pos, col) = 1)"""


@query("dedupe_responses", f"WITH RECURSIVE {DEDUPED} SELECT file, doc_id, col, pos, text, question FROM dr")
def dedupe_responses(spark, sf):
    return ln.dedupe_responses(with_source(spark, sf), ["file"], ["doc_id", "pos", "col"])


@query(
    "flag_non_teaching",
    f"""WITH q AS (SELECT doc_id, lang, CASE WHEN n_chars % 3 = 0 THEN concat(CAST(doc_id AS STRING), '. Did you feel prepared by ', source, '?') WHEN n_chars % 3 = 1 THEN 'Your expected grade' ELSE NULL END AS question FROM documents)
SELECT doc_id, question, (lang = 'en' OR regexp_matches(coalesce(question, ''), '^\\d+\\.\\s')) AND regexp_matches(coalesce(question, ''), '(?i){dims.NON_TEACHING}') AS non_teaching FROM q""",
)
def flag_non_teaching(spark, sf):
    q = table(spark, sf, "documents").selectExpr(
        "doc_id", "lang",
        """CASE WHEN n_chars % 3 = 0 THEN concat(CAST(doc_id AS STRING), '. Did you feel prepared by ', source, '?') WHEN n_chars % 3 = 1 THEN 'Your expected grade' ELSE NULL END AS question""",
    )
    parser = F.when(F.col("lang") == "en", "tabular-export").otherwise("pdf")
    return ln.flag_non_teaching(q, parser).select("doc_id", "question", "non_teaching")


@query(
    "extraction_warnings",
    f"""WITH {TIDY}, c AS (SELECT file, count(*) FILTER (status = 'garbage') AS garbage, count(*) FILTER (status = 'response') AS responses FROM tidy WHERE x <> '' GROUP BY file)
SELECT file, garbage, responses, array_to_string(list_filter([CASE WHEN garbage >= 10 AND garbage >= responses THEN
 concat(garbage, ' text fragments were unreadable (the PDF''s font has no text mapping). Export this evaluation as Excel/CSV, or re-save the PDF with readable text.')
 WHEN garbage > 0 THEN concat(garbage, ' unreadable text fragments were skipped.') END,
 CASE WHEN responses = 0 THEN 'No written student comments were found in this file.' END], lambda x: x IS NOT NULL), '|') AS warnings FROM c""",
)
def extraction_warnings(spark, sf):
    c = cells(spark, sf)
    t = ex.tidy_responses(c, ex.profile_columns(c, ["file"]), dictionary(spark, sf), ["doc_id"], ["file"])
    counts = t.groupBy("file").agg(
        F.count_if(F.col("status") == "garbage").alias("garbage"), F.count_if(F.col("status") == "response").alias("responses")
    )
    return ln.extraction_warnings(counts).withColumn("warnings", F.array_join("warnings", "|"))


FILES = """SELECT doc_id, 1 + n_chars % 100 AS pages FROM documents UNION ALL SELECT -1 - doc_id, 1 + n_chars % 100 FROM documents"""


@query(
    "scan_detection",
    f"""WITH f AS ({FILES}), c AS (SELECT doc_id, CAST(sum(length({sql_strip('line')})) AS BIGINT) AS c FROM report_lines GROUP BY ALL)
SELECT doc_id, pages, coalesce(c, 0) AS text_chars, coalesce(c, 0) < floor(50 * greatest(1, pages) / 10) AS likely_scan FROM f LEFT JOIN c USING (doc_id)""",
)
def scan_detection(spark, sf):
    """Page counts come from the file. Beside each file stands a scan of it, under a negative number, with no text block at all."""
    files = table(spark, sf, "documents").selectExpr("doc_id", "1 + n_chars % 100 AS pages")
    scans = files.select((-1 - F.col("doc_id")).alias("doc_id"), "pages")
    return ln.scan_detection(view(spark, sf, "report_lines"), files.unionByName(scans), ["doc_id"], text="line")


# --- preparation ---------------------------------------------------------------------------
def sql_prepare(x: str) -> str:
    return sql_ws(f"replace({sql_bullets(x)}, '�', '''')")


ITEMS = f"""items AS (SELECT course_id, ord, {sql_prepare('text')} AS text, nullif({sql_ws('question')}, '') AS question, non_teaching FROM comments),
kept AS (SELECT * FROM items WHERE text <> '')"""


def items(spark, sf):
    return pr.unify_inputs(view(spark, sf, "comments"), ["course_id"])


@query(
    "dedupe_comments",
    f"""WITH {ITEMS} SELECT course_id, ord, text, question, non_teaching FROM kept QUALIFY row_number() OVER (PARTITION BY course_id, text ORDER BY ord) = 1""",
)
def dedupe_comments(spark, sf):
    return pr.dedupe_comments(items(spark, sf), ["course_id"])


@query(
    "duplicate_counts",
    f"""WITH {ITEMS} SELECT course_id, (SELECT count(*) FROM comments c WHERE c.course_id = k.course_id) AS input_comments, count(DISTINCT text) AS processed_comments,
 count(*) - count(DISTINCT text) AS duplicates_removed FROM kept k GROUP BY course_id""",
)
def duplicate_counts(spark, sf):
    return pr.duplicate_counts(items(spark, sf), ["course_id"], view(spark, sf, "comments"))


@query(
    "unify_inputs",
    f"""WITH {ITEMS}, l AS (SELECT source AS course_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord, unnest(string_split(text, chr(10))) AS t FROM documents)
SELECT 'items' AS form, course_id, CAST(ord AS BIGINT) AS ord, text, question, non_teaching FROM kept
UNION ALL SELECT 'lines', course_id, CAST(ord AS BIGINT), {sql_strip('t')}, NULL, false FROM l WHERE length({sql_strip('t')}) > 10""",
)
def unify_inputs(spark, sf):
    files = table(spark, sf, "documents").select(F.col("source").alias("course_id"), "text")
    legacy = pr.plain_lines(files, ["course_id"])
    return items(spark, sf).withColumn("form", F.lit("items")).unionByName(legacy.withColumn("form", F.lit("lines")))


@query(
    "split_skipped",
    f"""WITH {ITEMS} SELECT course_id, count(*) FILTER (NOT non_teaching) AS to_assess, count(*) FILTER (non_teaching) AS skipped FROM kept GROUP BY course_id""",
)
def split_skipped(spark, sf):
    todo, skipped = pr.split_skipped(items(spark, sf))
    both = todo.select("course_id", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        skipped.select("course_id", F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    return both.groupBy("course_id").agg(F.sum("a").alias("to_assess"), F.sum("b").alias("skipped"))


@query("size_limit", f"WITH {ITEMS} SELECT course_id, count(*) AS comments FROM kept GROUP BY course_id HAVING count(*) > 45")
def size_limit(spark, sf):
    """The limit is lowered so that courses of the test data reach it."""
    return pr.size_limit(items(spark, sf), ["course_id"], 45)


@query(
    "restrict_labels",
    f"""SELECT ex_id, feedback, topic_no, {sql_key('feedback')} AS key FROM (SELECT * FROM examples UNION ALL SELECT doc_id + 1000000, text, 1, 1 FROM documents)
WHERE {sql_key('feedback')} IN (SELECT {sql_key('text')} FROM documents WHERE lang = 'en')""",
)
def restrict_labels(spark, sf):
    """Labels of the comments that are evaluated: here those of English documents."""
    d = table(spark, sf, "documents")
    labels = view(spark, sf, "examples").unionByName(d.selectExpr("doc_id + 1000000 AS ex_id", "text AS feedback", "1 AS topic_no", "1 AS score"))
    comments = d.filter("lang = 'en'").select(tx.canonical_key(F.col("text")).alias("key"))
    return pr.restrict_labels(labels, comments).select("ex_id", "feedback", "topic_no", "key")


@query(
    "eval_comment_set",
    f"""WITH u AS (SELECT 0 AS src, ex_id AS pos, feedback FROM examples UNION ALL SELECT 1, doc_id, text FROM documents),
k AS (SELECT *, {sql_key('feedback')} AS key FROM u)
SELECT key, src, pos, feedback FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY src, pos) = 1""",
)
def eval_comment_set(spark, sf):
    first = view(spark, sf, "examples").select(F.col("ex_id").alias("pos"), "feedback")
    second = table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), F.col("text").alias("feedback"))
    return pr.eval_comment_set(first, second)


@query(
    "eval_limited_labels",
    f"""WITH u AS (SELECT 0 AS src, ex_id AS pos, feedback FROM examples UNION ALL SELECT 1, doc_id, text FROM documents),
k AS (SELECT *, {sql_key('feedback')} AS key FROM u), f AS (SELECT key FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY src, pos) = 1 ORDER BY src, pos LIMIT 25)
SELECT ex_id, topic_no FROM examples WHERE {sql_key('feedback')} IN (SELECT key FROM f)""",
)
def eval_limited_labels(spark, sf):
    """An evaluation of the first 25 comments keeps only their labels."""
    first = view(spark, sf, "examples").select(F.col("ex_id").alias("pos"), "feedback")
    second = table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), F.col("text").alias("feedback"))
    comments = pr.eval_comment_set(first, second, 25)
    return pr.restrict_labels(view(spark, sf, "examples"), comments).select("ex_id", "topic_no")
