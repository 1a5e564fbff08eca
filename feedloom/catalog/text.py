"""Scalar functions over documents, assignments, reports and usage rows.

Inputs that the tables lack (bullets, percentages, scale labels) are built from table columns by an expression that
both engines read.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom import dims
from feedloom.catalog.base import query
from feedloom.functions import text as tx
from feedloom.functions.numbers import round2, sql_round2
from feedloom.views import sql_text_list, table, view

WS = tx.WS
B = dims.BULLETS


def docs(spark, sf, expr: str = "text"):
    return table(spark, sf, "documents").selectExpr("doc_id", f"{expr} AS x")


def dd(expr: str = "text") -> str:
    return f"d AS (SELECT doc_id, {expr} AS x FROM documents)"


def rr(x: str, pattern: str, to: str) -> str:
    pattern, to = pattern.replace("'", "''"), to.replace("'", "''")
    return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"


def sql_ws(x: str) -> str:
    return f"trim({rr(x, WS + '+', ' ')})"


def sql_strip(x: str) -> str:
    return rr(x, f"^{WS}+|{WS}+$", "")


SPACED = "concat(' ', replace(text, ' ', ' \t '), '  end　')"


@query("norm_whitespace", f"WITH {dd(SPACED)} SELECT doc_id, {sql_ws('x')} AS y FROM d")
def norm_whitespace(spark, sf):
    return docs(spark, sf, SPACED).select("doc_id", tx.norm_whitespace(F.col("x")).alias("y"))


def sql_key(x: str) -> str:
    return f"trim({rr(f'lower({rr(f"strip_accents({x})", "[^\\x00-\\x7F]", "")})', '[^a-z0-9]+', ' ')})"


@query("canonical_key", f"WITH {dd()} SELECT doc_id, {sql_key('x')} AS y FROM d")
def canonical_key(spark, sf):
    return docs(spark, sf).select("doc_id", tx.canonical_key(F.col("x")).alias("y"))


DASHED = "concat(lang, ' - ', source, '_|', text)"


def sql_squish(x: str) -> str:
    return rr(f"lower({x})", f"[{dims.SPACE_CLASS}\\-\\x{{2010}}_|]", "")


@query("squish", f"WITH {dd(DASHED)} SELECT doc_id, {sql_squish('x')} AS y FROM d")
def squish(spark, sf):
    return docs(spark, sf, DASHED).select("doc_id", tx.squish(F.col("x")).alias("y"))


def sql_bullets(x: str) -> str:
    """RE2 has no look-ahead: a dash bullet takes the blank after it along, which the next step would remove anyway."""
    x = rr(x, f"\\n[ \\t]*(?:[{B}*][ \\t]*|-[ \\t]+|-({WS}))", "; \\1")
    x = rr(x, f"^[ \\t]*(?:[{B}*][ \\t]*|-[ \\t]+|-({WS}))", "\\1")
    x = rr(x, f"[ \\t]+[{B}][ \\t]+", "; ")
    x = rr(x, f":{WS}*;{WS}*", ": ")
    return rr(x, f"(;{WS}*)+", "; ")


BULLETED = "concat('• Good: ', replace(text, '. ', '.\n- '), '\n * one', '\n-two', ' ● three � four:; five;; six')"


@query("strip_bullets", f"WITH {dd(BULLETED)} SELECT doc_id, {sql_bullets('x')} AS y FROM d")
def strip_bullets(spark, sf):
    return docs(spark, sf, BULLETED).select("doc_id", tx.strip_bullets(F.col("x")).alias("y"))


# Wide blanks, a ligature, an ellipsis, full-width digits, a decomposed letter, an apostrophe stored as a bullet.
RAW = "concat('• oﬁce… １２ café wouldn�t instruc- tor\n', text)"
SQL_NFKC = "replace(replace(replace(replace(nfc_normalize(x), 'ﬁ', 'fi'), '…', '...'), '１２', '12'), ' ', ' ')"


def sql_clean(nfkc: str) -> str:
    x = f"replace({sql_bullets(nfkc)}, '�', '''')"
    return sql_ws(rr(x, "([a-z])- ([a-z])", "\\1\\2"))


@query("clean_text", f"WITH {dd(RAW)} SELECT doc_id, {sql_clean(SQL_NFKC)} AS y FROM d")
def clean_text(spark, sf):
    return docs(spark, sf, RAW).select("doc_id", tx.clean_text(F.col("x")).alias("y"))


CURLY = "concat('“So” – it’s； ', text)"


@query(
    "norm_typography",
    f"""WITH {dd(CURLY)} SELECT doc_id, {sql_ws("lower(translate(x, '" + dims.TYPOGRAPHY_FROM + "', '" + dims.TYPOGRAPHY_TO.replace("'", "''") + "'))")} AS y FROM d""",
)
def norm_typography(spark, sf):
    return docs(spark, sf, CURLY).select("doc_id", tx.norm_typography(F.col("x")).alias("y"))


def sql_truncate(x: str, n: int) -> str:
    w = sql_ws(x)
    return f"CASE WHEN length({w}) <= {n} THEN {w} ELSE concat({rr(f'substr({w}, 1, {n - 3})', f'{WS}+$', '')}, '...') END"


@query("truncate_text", f"WITH {dd()} SELECT doc_id, {sql_truncate('x', 420)} AS y FROM d")
def truncate_text(spark, sf):
    return docs(spark, sf).select("doc_id", tx.truncate_text(F.col("x")).alias("y"))


HEADER = "concat('Q', CAST(doc_id AS STRING), '_', lang, '. How?_ ', source, ' __', lang, '. How?')"


@query(
    "question_header",
    f"""SELECT doc_id, concat(lang, '. How? — ', source) AS y FROM documents""",
)
def question_header(spark, sf):
    return docs(spark, sf, HEADER).select("doc_id", tx.question_header(F.col("x")).alias("y"))


def sql_norm_question(x: str) -> str:
    return f"trim({rr(rr(f'lower({x})', WS + '+', ' '), '[^a-z0-9 ]', '')})"


@query("norm_question", f"WITH {dd()} SELECT doc_id, {sql_norm_question('x')} AS y FROM d")
def norm_question(spark, sf):
    return docs(spark, sf).select("doc_id", tx.norm_question(F.col("x")).alias("y"))


COURSE = "CASE WHEN lang = 'en' THEN concat(source, '_', lang, '_Fall', CAST(n_chars AS STRING)) ELSE concat(source, '_', lang) END"


PATH = "concat('in/', source, '/', lang, '.', CAST(doc_id AS STRING), CASE doc_id % 3 WHEN 0 THEN '.csv' WHEN 1 THEN '' ELSE '.tar.gz' END)"


@query("file_stem", f"WITH {dd(PATH)} SELECT doc_id, regexp_replace(regexp_replace(x, '^.*/', ''), '(.)\\.[^.]*$', '\\1') AS y FROM d")
def file_stem(spark, sf):
    return docs(spark, sf, PATH).select("doc_id", tx.file_stem(F.col("x")).alias("y"))


@query(
    "course_term_parts",
    f"""WITH {dd(COURSE)}, p AS (SELECT doc_id, x, string_split(x, '_') AS p FROM d)
SELECT doc_id, CASE WHEN len(p) >= 3 THEN concat(p[1], ' ', p[2]) ELSE x END AS course, CASE WHEN len(p) >= 3 THEN p[3] ELSE 'Imported' END AS term FROM p""",
)
def course_term_parts(spark, sf):
    return docs(spark, sf, COURSE).select("doc_id", tx.course_term_parts(F.col("x")).alias("p")).select("doc_id", "p.*")


TERM = """CASE id % 5 WHEN 0 THEN term WHEN 1 THEN concat('F', CAST(10 + id % 20 AS STRING)) WHEN 2 THEN concat(CAST(10 + id % 20 AS STRING), '-Summer')
 WHEN 3 THEN concat('autumn 20', CAST(10 + id % 20 AS STRING)) ELSE course END"""


@query(
    "term_sort_key",
    f"""WITH t AS (SELECT id, lower(coalesce({TERM}, '')) AS t FROM reports),
y AS (SELECT id, t, coalesce(TRY_CAST(nullif(regexp_extract(t, '(20\\d{{2}})', 1), '') AS INT), 2000 + TRY_CAST(nullif(regexp_extract(t, '(^|[^\\d])(\\d{{2}})([^\\d]|$)', 2), '') AS INT)) AS y,
 CASE WHEN contains(t, 'winter') THEN 1 WHEN contains(t, 'spring') THEN 2 WHEN contains(t, 'summer') THEN 3 WHEN contains(t, 'fall') OR contains(t, 'autumn') THEN 4
  ELSE CASE regexp_extract(t, '(^|[^a-z])([wsuf])\\s*-?\\s*\\d{{2}}', 2) WHEN 'w' THEN 1 WHEN 's' THEN 2 WHEN 'u' THEN 3 WHEN 'f' THEN 4 ELSE 0 END END AS s FROM t)
SELECT id, CASE WHEN y IS NULL THEN 1 ELSE 0 END AS unknown, coalesce(y, 0) AS year, CASE WHEN y IS NULL THEN 0 ELSE s END AS season FROM y""",
)
def term_sort_key(spark, sf):
    t = view(spark, sf, "reports").selectExpr("id", f"{TERM} AS x")
    return t.select("id", tx.term_sort_key(F.col("x")).alias("k")).select("id", "k.*")


# A summary with counts, its label twice and a closing note; topic by document number.
SUMMARY = """concat('Draft. summary of ', topic, ' : old', chr(10), 'Summary of ', topic, ':  ', replace(text, chr(10), ' '), chr(10), ' more  themes. Note: ignore')"""
COUNTED = """concat('Summary of ', topic, ': 8 assigned comments; 6 scored; average 4/5; 3 positive, 1 neutral, 2 negative. Themes of ', source, ' here.')"""


def with_topic(spark, sf):
    d = table(spark, sf, "documents").withColumn("topic_no", (1 + F.col("doc_id") % 13).cast("int"))
    return d.join(F.broadcast(dims.topics(spark)), "topic_no")


@query(
    "theme_text",
    f"""WITH d AS (SELECT doc_id, source, text, topic FROM documents JOIN topics ON topic_no = 1 + doc_id % 13)
SELECT doc_id, concat('Summary of ', topic, ': ', trim({rr("concat(replace(text, chr(10), ' '), ' more themes.')", "[ \\t]+", " ")})) AS cleaned,
 concat('Themes of ', source, ' here.') AS themes FROM d""",
)
def theme_text(spark, sf):
    d = with_topic(spark, sf).selectExpr("doc_id", "topic", f"{SUMMARY} AS s", f"{COUNTED} AS c")
    t = F.col("topic")
    return d.select("doc_id", tx.topic_summary(t, F.col("s")).alias("cleaned"), tx.theme_text(F.col("c"), t).alias("themes"))


@query(
    "short_topic",
    """SELECT doc_id, coalesce(short_name, x) AS short_topic FROM (SELECT doc_id, CASE WHEN lang = 'fr' THEN source ELSE topic END AS x
FROM documents JOIN topics ON topic_no = 1 + doc_id % 13) LEFT JOIN topics ON topic = x""",
)
def short_topic(spark, sf):
    d = with_topic(spark, sf).select("doc_id", F.when(F.col("lang") == "fr", F.col("source")).otherwise(F.col("topic")).alias("topic"))
    return tx.short_topic(d, dims.topics(spark)).select("doc_id", "short_topic")


@query(
    "score_band",
    """SELECT id, CASE WHEN s IS NULL THEN 'none' WHEN s < 2.5 THEN 'low' WHEN s < 3.75 THEN 'mid' ELSE 'high' END AS band,
 CASE WHEN s IS NULL THEN 'none' WHEN s < 1.5 THEN 'red' WHEN s < 3 THEN 'orange' WHEN s < 4 THEN 'amber' ELSE 'green' END AS classic
FROM (SELECT id, CASE WHEN term IS NULL THEN NULL ELSE overall_score END AS s FROM reports)""",
)
def score_band(spark, sf):
    s = F.when(F.col("term").isNotNull(), F.col("overall_score"))
    return view(spark, sf, "reports").select(
        "id", tx.score_band(s).alias("band"), tx.score_band(s, tx.CLASSIC_BANDS, "green").alias("classic")
    )


@query(
    "sentiment_from_score",
    "SELECT ord, topic_no, score, CASE WHEN score <= 2 THEN 'negative' WHEN score >= 4 THEN 'positive' ELSE 'neutral' END AS sentiment FROM assignments WHERE score IS NOT NULL",
)
def sentiment_from_score(spark, sf):
    a = view(spark, sf, "assignments").filter(F.col("score").isNotNull())
    return a.select("ord", "topic_no", "score", tx.sentiment_from_score(F.col("score")).alias("sentiment"))


SCORE_TEXT = """CASE l_linenumber WHEN 1 THEN concat('score: ', CAST(CAST(l_quantity AS INT) % 10 AS STRING)) WHEN 2 THEN ' N/A ' WHEN 3 THEN ''
 WHEN 4 THEN concat(CAST(CAST(l_quantity AS INT) % 7 AS STRING), '/5') WHEN 5 THEN CAST(CAST(l_quantity AS INT) AS STRING)
 WHEN 6 THEN concat('about ', CAST(CAST(l_quantity AS INT) % 10 AS STRING), '.5') ELSE NULL END"""


@query(
    "parse_score",
    f"""WITH v AS (SELECT l_orderkey AS ord, {SCORE_TEXT} AS x, l_quantity, l_linenumber FROM lineitem), t AS (SELECT *, lower(trim(x)) AS t FROM v)
SELECT ord, x, CASE WHEN t IN ('', 'null', 'none', 'n/a', 'na') THEN NULL ELSE TRY_CAST(nullif(regexp_extract(t, '\\b[1-5]\\b'), '') AS INT) END AS from_text,
 CAST(least(greatest(l_quantity * CASE l_linenumber WHEN 7 THEN 1e12 WHEN 6 THEN -1e300 ELSE 1 END, 1), 5) AS INT) AS from_number FROM t""",
)
def parse_score(spark, sf):
    v = table(spark, sf, "lineitem").selectExpr("l_orderkey AS ord", f"{SCORE_TEXT} AS x", "l_quantity * CASE l_linenumber WHEN 7 THEN 1e12 WHEN 6 THEN -1e300 ELSE 1 END AS q")
    return v.select("ord", "x", tx.parse_score(F.col("x")).alias("from_text"), tx.parse_score_number(F.col("q")).alias("from_number"))


CONF_TEXT = """CASE l_linenumber WHEN 1 THEN concat(CAST(CAST(l_quantity AS INT) AS STRING), '%') WHEN 2 THEN concat('0.', CAST(CAST(l_quantity AS INT) AS STRING))
 WHEN 3 THEN 'n/a' WHEN 4 THEN concat('sure: ', CAST(CAST(l_quantity AS INT) AS STRING)) WHEN 5 THEN 'high' WHEN 6 THEN concat(CAST(CAST(l_quantity AS INT) * 5 AS STRING), ' %') ELSE NULL END"""


@query(
    "parse_confidence",
    f"""WITH v AS (SELECT l_orderkey AS ord, {CONF_TEXT} AS x, l_quantity FROM lineitem), t AS (SELECT *, lower(trim(coalesce(x, ''))) AS t FROM v),
n AS (SELECT *, TRY_CAST(nullif(regexp_extract(t, '(\\d+(?:\\.\\d+)?)\\s*%', 1), '') AS DOUBLE) AS p, TRY_CAST(nullif(regexp_extract(t, '\\d+(?:\\.\\d+)?'), '') AS DOUBLE) AS n FROM t)
SELECT ord, x, greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(p / 100, CASE WHEN n > 1 THEN n / 100 ELSE n END, 0.0::DOUBLE))) AS from_text,
 CASE WHEN l_quantity > 1 THEN l_quantity / 100 ELSE l_quantity END AS from_number FROM n""",
)
def parse_confidence(spark, sf):
    v = table(spark, sf, "lineitem").selectExpr("l_orderkey AS ord", f"{CONF_TEXT} AS x", "l_quantity")
    return v.select(
        "ord", "x", tx.parse_confidence(F.col("x")).alias("from_text"), tx.parse_confidence_number(F.col("l_quantity")).alias("from_number")
    )


LABEL = """CASE l_linenumber WHEN 1 THEN 'x' WHEN 2 THEN ' No ' WHEN 3 THEN '' WHEN 4 THEN '0' WHEN 5 THEN 'NaN' WHEN 6 THEN l_returnflag ELSE NULL END"""


@query(
    "truthy_label",
    f"""SELECT l_orderkey AS ord, {LABEL} AS x, lower(trim(coalesce({LABEL}, ''))) NOT IN ('', '0', 'false', 'n', 'nan', 'no', 'none') AS y FROM lineitem""",
)
def truthy_label(spark, sf):
    v = table(spark, sf, "lineitem").selectExpr("l_orderkey AS ord", f"{LABEL} AS x")
    return v.withColumn("y", tx.truthy_label(F.col("x")))


NUM_TEXT = """CASE l_linenumber WHEN 1 THEN CAST(CAST(l_quantity AS INT) % 8 AS STRING) WHEN 2 THEN concat('-', CAST(CAST(l_quantity AS INT) % 8 AS STRING)) WHEN 3 THEN '4.0'
 WHEN 4 THEN 'good' WHEN 5 THEN ' 3 ' WHEN 6 THEN '2.5' ELSE CASE CAST(l_quantity AS INT) % 5 WHEN 0 THEN '1000000000000' WHEN 1 THEN '-1e300' WHEN 2 THEN 'NaN' WHEN 3 THEN 'Infinity' END END"""


@query(
    "clamp_score_default",
    f"""WITH v AS (SELECT l_orderkey AS ord, {NUM_TEXT} AS x FROM lineitem) SELECT ord, x,
 CASE WHEN regexp_full_match(trim(x), '[+-]?\\d+') THEN CAST(least(greatest(TRY_CAST(trim(x) AS HUGEINT), 1), 5) AS INT) ELSE 3 END AS y FROM v""",
)
def clamp_score_default(spark, sf):
    v = table(spark, sf, "lineitem").selectExpr("l_orderkey AS ord", f"{NUM_TEXT} AS x")
    return v.withColumn("y", tx.clamp_score_default(F.col("x")))


@query(
    "integer_score_only",
    f"""WITH v AS (SELECT l_orderkey AS ord, {NUM_TEXT} AS x FROM lineitem), n AS (SELECT *, TRY_CAST(nullif(trim(x), '') AS DOUBLE) AS d FROM v)
SELECT ord, x, CASE WHEN isfinite(d) AND d = floor(d) THEN TRY_CAST(d AS INT) END AS y FROM n""",
)
def integer_score_only(spark, sf):
    v = table(spark, sf, "lineitem").selectExpr("l_orderkey AS ord", f"{NUM_TEXT} AS x")
    return v.withColumn("y", tx.integer_score_only(F.col("x")))


@query(
    "round_half_even",
    f"""WITH m AS (SELECT l_orderkey AS ord, avg(CAST(l_quantity AS INT) % 8) AS x, avg(CAST(l_quantity AS INT) % 2) AS z FROM lineitem GROUP BY ALL)
SELECT ord, {sql_round2('x')} AS y, {sql_round2('z')} AS w FROM m""",
)
def round_half_even(spark, sf):
    q = F.col("l_quantity").cast("int")
    m = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("ord")).agg(F.avg(q % 8).alias("x"), F.avg(q % 2).alias("z"))
    return m.select("ord", round2(F.col("x")).alias("y"), round2(F.col("z")).alias("w"))


DICT = "dict AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS word FROM benchmark)"


def sql_ratio_cte(src: str, out: str) -> str:
    """English ratio of ``src(id, x)``."""
    return f"""
{out}_w AS (SELECT id, lower(w) AS word FROM (SELECT id, unnest(regexp_extract_all(x, '[A-Za-z]+')) AS w FROM {src}) WHERE length(w) >= 3),
{out}_s AS (SELECT id, CAST(count(d.word) AS DOUBLE) / count(*) AS share FROM {out}_w w LEFT JOIN dict d ON d.word = w.word GROUP BY id),
{out}_v AS (SELECT id, x, {rr('x', WS + '+', '')} AS v FROM {src}),
{out} AS (SELECT v.id, x, CASE WHEN length(v) > 0 AND CAST(length({rr('v', '[^\\p{L}]+', '')}) AS DOUBLE) / length(v) < 0.6 THEN 0.0::DOUBLE
  WHEN share IS NULL THEN CASE WHEN length(v) <= 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ELSE share END AS ratio FROM {out}_v v LEFT JOIN {out}_s s USING (id))"""


def dictionary(spark, sf):
    """Words of the benchmark texts stand for the dictionary."""
    b = table(spark, sf, "benchmark")
    return b.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word")).select(F.lower("word").alias("word")).distinct()


@query(
    "english_ratio",
    f"""WITH src AS (SELECT doc_id AS id, text AS x FROM documents), {DICT}, {sql_ratio_cte('src', 'er')}
SELECT id AS doc_id, ratio AS english_ratio, ratio < 0.6 AS garbage FROM er""",
)
def english_ratio(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    out = tx.english_ratio(d, dictionary(spark, sf), "doc_id")
    return out.select("doc_id", "english_ratio", tx.is_garbage(F.col("english_ratio")).alias("garbage"))


# All report lines whole, at tenfold positions, and beside some of them lines of the kinds a report prints around answers.
LINES = {
    "spark": """SELECT doc_id, pos * 10 AS pos, line AS x FROM {src} UNION ALL
SELECT doc_id, pos * 10 + 1, CASE CAST(pos % 23 AS INT) WHEN 1 THEN concat('Page ', CAST(pos AS STRING), ' of 9') WHEN 2 THEN 'Very good Good / Fair'
 WHEN 3 THEN concat(CAST(doc_id AS STRING), '. What about ', line, '?') WHEN 4 THEN concat('Comments: ', '-') WHEN 5 THEN ' None! '
 WHEN 6 THEN concat('Please describe the part named ', line, ' (maximum 500 characters)') WHEN 7 THEN concat('7-9 hours ', CAST(doc_id AS STRING), ' 39.02%')
 WHEN 8 THEN concat(CAST(doc_id AS STRING), '. The instructor ', lower(line)) WHEN 9 THEN 'To what extent do you feel at ease' WHEN 10 THEN 'Disagree/N/Agree'
 WHEN 11 THEN 'n/about right' WHEN 12 THEN concat('Please restate your answer to Question ', CAST(doc_id AS STRING), ' and explain it here:') ELSE 'Background Information' END
FROM {src} WHERE pos % 23 BETWEEN 1 AND 13""",
}
LINES_SQL = "lines AS (" + LINES["spark"].replace("{src}", "report_lines") + ")"


def lines(spark, sf):
    return spark.sql(LINES["spark"], src=view(spark, sf, "report_lines"))


@query(
    "is_no_answer",
    f"WITH {LINES_SQL} SELECT doc_id, pos, {rr('lower(x)', '^[ !.]+|[ !.]+$', '')} IN ({sql_text_list(dims.NO_ANSWER)}) AS y FROM lines",
)
def is_no_answer(spark, sf):
    return lines(spark, sf).select("doc_id", "pos", tx.is_no_answer(F.col("x")).alias("y"))


def sql_noise(x: str) -> str:
    t = f"lower({sql_strip(x)})"
    phrases, patterns = tx.PHRASE_PATTERN.replace("'", "''"), tx.NOISE_PATTERN.replace("'", "''")
    scale = "|".join([*dims.NOISE_SCALE_WORDS, WS, "/"])
    return (
        f"({t} = '' OR {t} = 'nan' OR {sql_squish(t)} IN ({sql_text_list(dims.NOISE_WORDS)}) OR regexp_matches({t}, '{phrases}') "
        f"OR regexp_matches({t}, '{patterns}') OR regexp_matches({t}, '^(?:{scale})+$'))"
    )


@query("is_noise", f"WITH {LINES_SQL} SELECT doc_id, pos, {sql_noise('x')} AS y FROM lines")
def is_noise(spark, sf):
    return lines(spark, sf).select("doc_id", "pos", tx.is_noise(F.col("x")).alias("y"))


def sql_question(x: str) -> str:
    s = rr(sql_strip(x), tx.LIMIT_NOTE, "")

    def m(p: str) -> str:
        return f"regexp_matches({s}, '{p}')"

    return (
        f"(length({s}) <= 400 AND (({m(tx.PROMPT_START)} AND length({s}) > 40) OR ({m(tx.NUMBERED)} AND {m(tx.QUESTION_START)} AND "
        f"({m(tx.PROMPT_END)} OR {s} LIKE '%.' OR contains({s}, '?'))) OR ({m(tx.PROMPT_END)} AND ({m(tx.QUESTION_START)} OR {s} LIKE '%: -'))))"
    )


@query(
    "is_question",
    f"""WITH {LINES_SQL} SELECT doc_id, pos, {sql_question('x')} AS question,
 regexp_matches({sql_strip('x')}, '{tx.NUMBERED}') AND NOT {sql_question('x')} AS numbered_item FROM lines""",
)
def is_question(spark, sf):
    x = F.col("x")
    return lines(spark, sf).select("doc_id", "pos", tx.is_question(x).alias("question"), tx.is_numbered_item(x).alias("numbered_item"))


SENTENCE_END = "[.!?)\"”'']$"


@query("ends_sentence", f"WITH {LINES_SQL} SELECT doc_id, pos, regexp_matches({sql_strip('x')}, '{SENTENCE_END}') AS y FROM lines")
def ends_sentence(spark, sf):
    return lines(spark, sf).select("doc_id", "pos", tx.ends_sentence(F.col("x")).alias("y"))


SCALE = """CASE l_linenumber WHEN 1 THEN 'Strongly  Agree' WHEN 2 THEN 'very-good' WHEN 3 THEN 'Needs Improve ment' WHEN 4 THEN 'Neutral' WHEN 5 THEN 'POOR ' WHEN 6 THEN l_returnflag ELSE 'About right' END"""


def sql_scale(x: str) -> str:
    key = f"trim(replace({rr(f'lower({x})', f'[{dims.SPACE_CLASS}\\-]+', ' ')}, 'improve ment', 'improvement'))"
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in dims.SCALE_WORDS.items())
    return f"CASE {key} {cases} END"


@query("scale_value", f"SELECT l_orderkey AS ord, {SCALE} AS x, {sql_scale(SCALE)} AS y FROM lineitem")
def scale_value(spark, sf):
    v = table(spark, sf, "lineitem").selectExpr("l_orderkey AS ord", f"{SCALE} AS x")
    return v.withColumn("y", tx.scale_value(F.col("x")))


WRAPPED = """CASE WHEN turn % 3 = 0 THEN concat('Sure: {"role": "', role, '", "n": ', CAST(conv_id AS STRING), '} done') WHEN turn % 3 = 1 THEN text ELSE concat('{"role": ', text, '}') END"""


@query(
    "extract_json_object",
    f"""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN concat('{{"role": "', role, '", "n": ', CAST(conv_id AS STRING), '}}') END AS y FROM conversations""",
)
def extract_json_object(spark, sf):
    v = table(spark, sf, "conversations").selectExpr("conv_id", "turn", f"{WRAPPED} AS x")
    return v.select("conv_id", "turn", tx.extract_json_object(F.col("x")).alias("y"))


@query(
    "request_key",
    "SELECT doc_id, sha256(CAST(json_object('p0', 'local', 'p1', text, 'p2', doc_id, 'p3', NULL) AS STRING)) AS y FROM documents",
)
def request_key(spark, sf):
    key = tx.request_key(F.lit("local"), F.col("text"), F.col("doc_id"), F.lit(None).cast("string"))
    return table(spark, sf, "documents").select("doc_id", key.alias("y"))
