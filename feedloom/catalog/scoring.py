"""Retrieval of similar examples, requests, replies and routing, over documents and assignments."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom import dims
from feedloom.catalog.base import query
from feedloom.catalog.extract import items, sql_prepare
from feedloom.catalog.reports import GATED, K, OVERALL, load
from feedloom.catalog.text import docs, dd, sql_key, sql_truncate
from feedloom.functions import text as tx
from feedloom.functions.numbers import sql_exact_mean, sql_half_even, sql_round2
from feedloom.operators import noise_model, prepare
from feedloom.operators import retrieval as rt
from feedloom.operators.stages import written
from feedloom.plans import chain, report, scoring
from feedloom.plans.report import KEYS
from feedloom.sources import files
from feedloom.views import sql_text_list, table, view


def sql_tokens(x: str) -> str:
    return (
        f"list_filter(list_distinct(string_split({sql_key(x)}, ' ')), lambda t: length(t) > 2 AND t NOT IN ({sql_text_list(dims.STOP_WORDS)}))"
    )


@query("retrieval_tokens", f"WITH {dd()} SELECT doc_id, array_to_string(list_sort({sql_tokens('x')}), ' ') AS tokens FROM d")
def retrieval_tokens(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(F.array_sort(rt.retrieval_tokens(F.col("x"))), " ").alias("tokens"))


SIM = """CASE WHEN len(lt) > 0 AND len(rt) > 0 THEN 0.55::DOUBLE * (CAST(len(list_intersect(lt, rt)) AS DOUBLE) / least(len(lt), len(rt)))
 + 0.25::DOUBLE * (CAST(len(list_intersect(lt, rt)) AS DOUBLE) / (len(lt) + len(rt) - len(list_intersect(lt, rt)))) ELSE 0.0::DOUBLE END"""


def neighbours(spark, sf):
    """Each document with the document numbered half as high."""
    d = table(spark, sf, "documents")
    left = d.select("doc_id", F.col("text").alias("l"), F.floor(F.col("doc_id") / 2).alias("other"))
    return left.join(d.select(F.col("doc_id").alias("other"), F.col("text").alias("r")), "other")


@query(
    "similarity_score",
    f"""WITH n AS (SELECT a.doc_id, {sql_tokens('a.text')} AS lt, {sql_tokens('b.text')} AS rt FROM documents a JOIN documents b ON b.doc_id = a.doc_id // 2)
SELECT doc_id, {sql_half_even(SIM, 6)} AS similarity FROM n""",
)
def similarity_score(spark, sf):
    """The token terms; the sequence term is covered by a unit test."""
    n = neighbours(spark, sf).select("doc_id", rt.retrieval_tokens(F.col("l")).alias("lt"), rt.retrieval_tokens(F.col("r")).alias("rt"))
    return n.select("doc_id", rt.half_even(rt.token_similarity(F.col("lt"), F.col("rt")), 6).alias("similarity"))


@query("topk_examples")
def topk_examples(spark, sf):
    c = view(spark, sf, "comments").select("ord", "text")
    return rt.topk_examples(c, view(spark, sf, "examples"), 3)


BLOCKED = f"""
ct AS (SELECT ord, {sql_key('text')} AS k, {sql_tokens('text')} AS lt FROM comments), et AS (SELECT ex_id, {sql_key('feedback')} AS k, {sql_tokens('feedback')} AS rt FROM examples),
pr AS (SELECT ord, ex_id, {SIM} AS s FROM ct JOIN et ON ct.k <> et.k AND ct.k <> '' AND et.k <> ''),
rk AS (SELECT ord, ex_id, s, row_number() OVER (PARTITION BY ord ORDER BY s DESC, ex_id) AS rank FROM pr WHERE s >= {dims.MIN_SIMILARITY})"""


@query("topk_examples_blocked", f"WITH {BLOCKED} SELECT ord, ex_id, {sql_half_even('s', 3)} AS similarity, CAST(rank AS INT) AS rank FROM rk WHERE rank <= 3")
def topk_examples_blocked(spark, sf):
    """Without the sequence term."""
    c = view(spark, sf, "comments").select("ord", "text")
    return rt.topk_examples(c, view(spark, sf, "examples"), 3, with_ratio=False)


@query(
    "format_examples",
    f"""WITH {BLOCKED}, j AS (SELECT ord, rank, {{'similarity': {sql_half_even('s', 3)}, 'feedback': {sql_truncate('feedback', 420)}, 'human_topic': topic_no, 'human_score': score}} AS e
 FROM rk JOIN examples USING (ex_id) WHERE rank <= 2) SELECT ord, CAST(to_json(list(e ORDER BY rank)) AS STRING) AS examples FROM j GROUP BY ord""",
)
def format_examples(spark, sf):
    e = view(spark, sf, "examples")
    found = rt.topk_examples(view(spark, sf, "comments").select("ord", "text"), e, 2, with_ratio=False)
    return rt.format_examples(found, e)


def with_item(spark, sf):
    """Each document beside one labelled example."""
    e = view(spark, sf, "examples").select("ex_id", "feedback")
    n = e.agg(F.count("*").alias("n")).scalar()
    return table(spark, sf, "documents").withColumn("ex_id", F.col("doc_id") % n).join(e, "ex_id")


@query("text_match_score")
def text_match_score(spark, sf):
    """Whole texts, containment and the three ratios; held against the plain rule in the tests."""
    return with_item(spark, sf).select("doc_id", rt.half_even(rt.text_match_score(F.col("text"), F.col("feedback")), 6).alias("similarity"))


@query(
    "text_match_levenshtein",
    f"""WITH n AS (SELECT doc_id, {sql_key('text')} AS l, {sql_key('feedback')} AS r FROM documents JOIN examples ON ex_id = doc_id % (SELECT count(*) FROM benchmark))
SELECT doc_id, {sql_half_even("CASE WHEN l = '' OR r = '' THEN 0.0::DOUBLE WHEN contains(l, r) OR contains(r, l) THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - CAST(levenshtein(l, r) AS DOUBLE) / greatest(length(l), length(r)) END", 6)} AS similarity FROM n""",
)
def text_match_levenshtein(spark, sf):
    """The edit-distance variant, also over whole texts."""
    d = with_item(spark, sf).select("doc_id", tx.canonical_key(F.col("text")).alias("l"), tx.canonical_key(F.col("feedback")).alias("r"))
    return d.select("doc_id", rt.half_even(rt.text_match_levenshtein(F.col("l"), F.col("r")), 6).alias("similarity"))


@query("match_one_to_one")
def match_one_to_one(spark, sf):
    """Every benchmark row with its match, or with the best of what was left for it."""
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("b_idx"), "text")
    p = table(spark, sf, "documents").select(F.col("doc_id").alias("p_idx"), "text")
    return rt.match_report(b, p)


# --- requests and cache --------------------------------------------------------------------
def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


@query(
    "build_requests",
    f"""SELECT course_id, ord, sha256(concat({q(scoring.ANALYSIS_HEAD)}, chr(10), 'EXAMPLES', chr(10), '[]', chr(10), 'QUESTION ANSWERED', chr(10), question, chr(10),
 'COMMENT', chr(10), text, chr(10), {q(scoring.ANALYSIS_TAIL)})) AS request_hash FROM comments""",
)
def build_requests(spark, sf):
    r = scoring.analysis_requests(view(spark, sf, "comments"))
    return r.select("course_id", "ord", F.sha2("request", 256).alias("request_hash"))


def cache_tables(spark, sf):
    """Answers exist for English documents; requests are the document texts."""
    d = table(spark, sf, "documents").withColumn("key", F.sha2("text", 256))
    cache = d.filter(F.col("lang") == "en").groupBy("key").agg(F.min("source").alias("answer"), F.lit(1).cast("bigint").alias("created"))
    return d.select("doc_id", "lang", "source", "n_chars", "key"), cache


CACHE = """
r AS (SELECT doc_id, lang, source, n_chars, sha256(text) AS key FROM documents),
cache AS (SELECT key, min(source) AS answer, 1::BIGINT AS created FROM r WHERE lang = 'en' GROUP BY key)"""


@query("reply_cache_lookup", f"WITH {CACHE} SELECT doc_id, r.key, answer, answer IS NOT NULL AS hit FROM r LEFT JOIN cache c ON c.key = r.key")
def reply_cache_lookup(spark, sf):
    requests, cache = cache_tables(spark, sf)
    return scoring.cache_lookup(requests.select("doc_id", "key"), cache)


@query(
    "reply_cache_upsert",
    f"""WITH {CACHE}, a AS (SELECT key, CASE WHEN lang = 'fr' THEN '' ELSE concat('new ', source) END AS answer, CAST(n_chars AS BIGINT) AS created FROM r),
u AS (SELECT * FROM cache UNION ALL SELECT * FROM a WHERE answer <> '')
SELECT key, answer, created FROM u QUALIFY row_number() OVER (PARTITION BY key ORDER BY created DESC, answer DESC) = 1""",
)
def reply_cache_upsert(spark, sf):
    requests, cache = cache_tables(spark, sf)
    answers = requests.select(
        "key",
        F.when(F.col("lang") == "fr", "").otherwise(F.concat(F.lit("new "), "source")).alias("answer"),
        F.col("n_chars").cast("bigint").alias("created"),
    )
    return scoring.cache_upsert(cache, answers)


# --- scorer and replies --------------------------------------------------------------------
CUES = [(2, ["that", "schaft"], "too_fast"), (5, ["erest"], None)]
WORDS = {"positive": ["ción", "tion", "lich"], "negative": ["ing", "ieau", "ado"], "unsure": ["onst"], "unreadable": ["menteau"]}
_T = "lower(text)"


def _sql_any(words):
    return "(" + " OR ".join(f"contains({_T}, '{w}')" for w in words) + ")"


def _sql_count(words):
    return "(" + " + ".join(f"contains({_T}, '{w}')::INT" for w in words) + ")"


SCORE = f"(3 + greatest(-2, least(2, {_sql_count(WORDS['positive'])} - {_sql_count(WORDS['negative'])})))"


def _sql_entry(no, words, direction):
    topic = dims.TOPICS[no - 1][1]
    d = f'"{direction}"' if direction else "null"
    quote = "CASE " + " ".join(f"WHEN contains({_T}, '{w}') THEN '{w}'" for w in words) + " END"
    return (
        f"""CASE WHEN {_sql_any(words)} THEN concat('{{"topic":"{topic}","score":', {SCORE}, ',"confidence":', CASE WHEN {_sql_any(WORDS["unsure"])} THEN '0.3' ELSE '0.8' END, """
        f"""',"evidence_quote":"', {quote}, '","reasoning":"cue words","direction":{d}}}') END"""
    )


REPLIES = f"""
flags AS (SELECT *, CASE WHEN bad THEN 'model_error' ELSE 'classified' END AS status, NOT bad AND c2 AS t2, NOT bad AND c5 AS t5, CASE WHEN NOT bad AND NOT c2 AND NOT c5 AND mood <> 3 THEN mood END AS general
  FROM (SELECT course_id, ord, text, question, non_teaching, {_sql_any(WORDS["unreadable"])} AS bad, {_sql_any(CUES[0][1])} AS c2, {_sql_any(CUES[1][1])} AS c5, {_sql_any(WORDS["unsure"])} AS low, {SCORE} AS mood FROM comments)),
replies AS (SELECT course_id, ord, CASE WHEN bad THEN 'unreadable' ELSE
  concat('{{"topics":[', concat_ws(',', {', '.join(_sql_entry(*c) for c in CUES)}), '],"general_sentiment_score":', coalesce(CAST(general AS VARCHAR), 'null'), '}}') END AS reply_json FROM flags),
assessed AS (SELECT *, t2::INT + t5::INT AS n_topics, CASE WHEN low THEN 0 ELSE t2::INT + t5::INT END AS n_passed FROM flags),
other AS (SELECT course_id, ord, CASE WHEN non_teaching THEN 'skipped_question' ELSE status END AS classification_status,
  CASE WHEN NOT non_teaching AND status = 'model_error' THEN 'classification_error' ELSE 'not_applicable' END AS scoring_status,
  CASE WHEN NOT non_teaching AND status <> 'model_error' AND n_topics = 0 THEN general END AS general_score
  FROM assessed WHERE non_teaching OR status = 'model_error' OR n_passed = 0)"""


def replies(spark, sf):
    return scoring.score_comments(view(spark, sf, "comments"), CUES, **WORDS)


def assessed(spark, sf):
    return scoring.assess(scoring.parse_replies(replies(spark, sf)))


@query("score_comments", f"WITH {REPLIES} SELECT course_id, ord, reply_json FROM replies")
def score_comments(spark, sf):
    return replies(spark, sf).select("course_id", "ord", "reply_json")


@query(
    "route_other",
    f"""WITH {REPLIES} SELECT course_id, ord, classification_status, scoring_status, CAST(general_score AS INT) AS general_score FROM other""",
)
def route_other(spark, sf):
    return report.route_other(assessed(spark, sf)).select("course_id", "ord", "classification_status", "scoring_status", "general_score")


@query(
    "general_sentiment",
    f"""WITH {REPLIES} SELECT course_id, {sql_round2('avg(general_score)')} AS average_score, count(*) AS scored_comments, count(*) FILTER (general_score >= 4) AS positive,
 count(*) FILTER (general_score = 3) AS neutral, count(*) FILTER (general_score <= 2) AS negative FROM other WHERE general_score IS NOT NULL GROUP BY course_id""",
)
def general_sentiment(spark, sf):
    return report.general_sentiment(report.route_other(assessed(spark, sf)), ["course_id"])


@query(
    "report_metadata",
    f"""WITH {REPLIES}, p AS (SELECT course_id, count(*) AS input_comments, count(DISTINCT text) AS processed_comments, count(*) - count(DISTINCT text) AS duplicates_removed FROM comments GROUP BY ALL),
d AS (SELECT * FROM assessed QUALIFY row_number() OVER (PARTITION BY course_id, text ORDER BY ord) = 1)
SELECT course_id, any_value(input_comments) AS input_comments, any_value(processed_comments) AS processed_comments, any_value(duplicates_removed) AS duplicates_removed,
 count(*) FILTER (non_teaching) AS non_teaching_skipped, count(*) FILTER (NOT non_teaching AND n_passed > 0) AS scored_comments,
 count(*) FILTER (non_teaching OR status = 'model_error' OR n_passed = 0) AS generic_comments, count(*) FILTER (NOT non_teaching AND status = 'model_error') AS classification_errors,
 CAST(sum(CASE WHEN non_teaching THEN 0 ELSE n_topics - n_passed END) AS BIGINT) AS low_confidence,
 count(*) FILTER (NOT non_teaching AND status <> 'model_error' AND n_topics > 0 AND n_passed = 0) AS all_topics_rejected FROM d JOIN p USING (course_id) GROUP BY course_id""",
)
def report_metadata(spark, sf):
    c = view(spark, sf, "comments")
    unique = prepare.dedupe_comments(c, ["course_id"])
    a = scoring.assess(scoring.parse_replies(scoring.score_comments(unique, CUES, **WORDS)))
    return report.report_metadata(prepare.duplicate_counts(c, ["course_id"], c), a, ["course_id"])


# Replies made from assignments, one per comment, and conversation texts as replies that cannot be read.
LISTED = """
l AS (SELECT ord, topic_no, max(score) AS score, max(confidence) AS confidence, max(direction) AS direction FROM assignments WHERE topic_no <> 13 GROUP BY ALL)"""


def listed(spark, sf):
    a = view(spark, sf, "assignments").filter(F.col("topic_no") != dims.OTHER_NO)
    return a.groupBy("ord", "topic_no").agg(F.max("score").alias("score"), F.max("confidence").alias("confidence"), F.max("direction").alias("direction"))


def unreadable(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select((-(F.col("conv_id") * 1000 + F.col("turn")) - 1).alias("ord"), F.col("text").alias("reply_json"))


def made_replies(spark, sf, entry):
    """At most 12 entries per comment; every list is followed by an unknown topic and a repeated one."""
    rows = listed(spark, sf).join(F.broadcast(dims.topics(spark)), "topic_no")
    per = rows.groupBy("ord").agg(F.sort_array(F.collect_list(F.struct("topic_no", entry.alias("e")))).alias("l"))
    body = F.array_join(F.concat(F.col("l.e"), F.array(F.lit('{"topic": "Weather", "score": 1}'), F.col("l.e")[0])), ", ")
    made = per.select("ord", F.concat(F.lit('Here: {"topics": ['), body, F.lit('], "general_sentiment_score": "4 of 5"} ok')).alias("reply_json"))
    return made.unionByName(unreadable(spark, sf))


@query(
    "parse_replies",
    f"""WITH {LISTED}, h AS (SELECT * REPLACE (CASE WHEN ord % 97 = 0 THEN CAST(5 * sign(score) AS INT) ELSE score END AS score) FROM l) SELECT ord, 'classified' AS status, topic_no, score, CASE WHEN score <= 2 THEN 'negative' WHEN score >= 4 THEN 'positive' ELSE 'neutral' END AS sentiment,
 CASE WHEN confidence > 1 THEN confidence / 100 ELSE confidence END AS confidence, direction FROM h
UNION ALL SELECT -(conv_id * 1000 + turn) - 1, 'model_error', NULL, NULL, NULL, NULL, NULL FROM conversations""",
)
def parse_replies(spark, sf):
    score = F.when(F.col("ord") % 97 == 0, F.col("score").cast("double") * 1e12).otherwise(F.col("score"))  # beyond any whole number type
    entry = F.to_json(F.struct("topic", score.alias("score"), "confidence", "direction"))
    p = scoring.parse_replies(made_replies(spark, sf, entry))
    flat = p.select("ord", "status", F.explode_outer("results").alias("r"))
    return flat.select("ord", "status", "r.topic_no", "r.score", "r.sentiment", "r.confidence", "r.direction")


@query(
    "exclusive_other",
    "SELECT ord, CASE WHEN list_contains(t, 13) THEN '13' ELSE array_to_string(t, ',') END AS topic_nos FROM (SELECT ord, list(DISTINCT topic_no ORDER BY topic_no) AS t FROM assignments GROUP BY ord)",
)
def exclusive_other(spark, sf):
    t = view(spark, sf, "assignments").groupBy("ord").agg(F.sort_array(F.collect_set("topic_no")).alias("t"))  # 13 topics
    return t.select("ord", F.array_join(scoring.exclusive_other(F.col("t")).cast("array<string>"), ",").alias("topic_nos"))


@query(
    "topic_requests",
    f"""SELECT ord, topic_no, CAST(length(text) AS INT) AS n, regexp_matches(q, '^{scoring.TOPIC_HEAD.split(",")[0]}') AS headed FROM (SELECT ord, t.topic_no, text, '{scoring.TOPIC_HEAD}' AS q FROM comments, topics t WHERE t.topic_no IN (2, 5))""",
)
def topic_requests(spark, sf):
    """One request per comment and topic; the comment stands in it whole."""
    c = view(spark, sf, "comments").select("ord", "text", "question", F.explode(F.array(F.lit(2), F.lit(5))).alias("topic_no"))
    r = scoring.topic_requests(c, dims.topics(spark))
    body = F.element_at(F.split("request", "COMMENT\n", 2), -1)
    return r.select("ord", "topic_no", F.length(body).alias("n"), F.col("request").startswith(scoring.TOPIC_HEAD).alias("headed"))


@query(
    "parse_topic_replies",
    """WITH s AS (SELECT ord, array_to_string(list(DISTINCT topic_no ORDER BY topic_no), ',') AS t FROM assignments WHERE topic_no <> 13 GROUP BY ord)
SELECT ord, 'classified' AS status, t AS topic_nos FROM s UNION ALL SELECT -(conv_id * 1000 + turn) - 1, 'model_error', '13' FROM conversations""",
)
def parse_topic_replies(spark, sf):
    entry = F.when(F.col("topic_no") % 2 == 0, F.to_json(F.struct(F.col("topic").alias("name")))).otherwise(F.concat(F.lit('"'), "topic", F.lit('"')))
    p = scoring.parse_topic_replies(made_replies(spark, sf, entry))
    return p.select("ord", "status", F.array_join(F.transform("topic_nos", lambda x: x.cast("string")), ",").alias("topic_nos"))


SUPPORT = "CASE l_linenumber WHEN 7 THEN 'false' WHEN 6 THEN '\"No\"' WHEN 5 THEN '\"yes\"' ELSE 'true' END"
ONE = f"""concat('{{"topic_supported": ', {SUPPORT}, ', "sentiment": "', CASE l_returnflag WHEN 'A' THEN 'Positive' WHEN 'N' THEN 'mixed' ELSE ' negative ' END,
 '", "score": ', CASE WHEN l_linenumber = 3 THEN 'null' WHEN l_quantity > 48 THEN '1000000000000' WHEN l_quantity > 46 THEN '-1e300' ELSE CAST(CAST(l_quantity AS INT) % 8 AS STRING) END, ', "confidence": "', CAST(CAST(l_discount * 100 AS INT) AS STRING), '%"}}')"""


@query(
    "parse_score_reply",
    """WITH v AS (SELECT l_orderkey AS ord, l_linenumber AS n, l_linenumber NOT IN (6, 7) AS s, CASE WHEN l_linenumber IN (3, 6, 7) THEN NULL WHEN l_quantity > 48 THEN 5 WHEN l_quantity > 46 THEN 1 ELSE CAST(greatest(1, least(5, CAST(l_quantity AS INT) % 8)) AS INT) END AS score,
 l_returnflag, CAST(CAST(l_discount * 100 AS INT) AS DOUBLE) / 100 AS confidence FROM lineitem)
SELECT ord, n, s AS topic_supported, score, CASE WHEN NOT s THEN NULL WHEN score <= 2 THEN 'negative' WHEN score >= 4 THEN 'positive' WHEN score = 3 THEN 'neutral'
 WHEN l_returnflag = 'A' THEN 'positive' WHEN l_returnflag = 'N' THEN 'neutral' ELSE 'negative' END AS sentiment, confidence, 'scored' AS scoring_status FROM v""",
)
def parse_score_reply(spark, sf):
    r = table(spark, sf, "lineitem").selectExpr("l_orderkey AS ord", "l_linenumber AS n", f"{ONE} AS reply_json")
    return scoring.parse_score_reply(r).drop("reply_json")


# Hint patterns over letter groups that the synthetic text has.
HINTS = [(1, r"\bthe(?:re)?\b|\bder\b"), (4, r"\bthat\b"), (12, r"\bles?\b|\bque\b")]


def _sql_words(p: str) -> str:
    """RE2 knows ASCII word borders only; spell them out for accented letters."""
    words = "|".join(w.removeprefix("\\b").removesuffix("\\b") for w in p.split("|"))
    return f"(^|[^\\p{{L}}\\p{{N}}_])({words})([^\\p{{L}}\\p{{N}}_]|$)"



@query(
    "topic_hints",
    "SELECT doc_id, array_to_string(list_concat([CAST(1 + doc_id % 5 AS INT)], list_filter(["
    + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{_sql_words(p)}') AND {no} <> 1 + doc_id % 5 THEN {no} END" for no, p in HINTS)
    + "], lambda x: x IS NOT NULL)), ',') AS topic_nos FROM documents",
)
def topic_hints(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", F.array((1 + F.col("doc_id") % 5).cast("int")).alias("topic_nos"))
    out = scoring.topic_hints(d, hints=HINTS)
    return out.select("doc_id", F.array_join(F.transform("topic_nos", lambda x: x.cast("string")), ",").alias("topic_nos"))


@query(
    "threshold_topics",
    """WITH p AS (SELECT DISTINCT ord, topic_no FROM assignments WHERE confidence >= 0.5 AND topic_no <> 13), r AS (SELECT ord, topic_no FROM p QUALIFY row_number() OVER (PARTITION BY ord ORDER BY topic_no) <= 3)
SELECT o.ord, coalesce(string_agg(CAST(topic_no AS STRING), ',' ORDER BY topic_no), '13') AS topic_nos FROM (SELECT DISTINCT ord FROM assignments) o LEFT JOIN r ON r.ord = o.ord GROUP BY o.ord""",
)
def threshold_topics(spark, sf):
    p = view(spark, sf, "assignments").select("ord", F.when(F.col("topic_no") != dims.OTHER_NO, F.col("topic_no")).alias("topic_no"), F.col("confidence").alias("probability"))
    out = scoring.threshold_topics(p, "ord", 3)
    return out.select("ord", F.array_join(F.transform("topic_nos", lambda x: x.cast("string")), ",").alias("topic_nos"))


@query(
    "label_to_score",
    """WITH v AS (SELECT l_orderkey AS ord, CASE l_returnflag WHEN 'A' THEN 'positive' WHEN 'N' THEN 'neutral' ELSE 'negative' END AS label, l_discount * 10 AS c FROM lineitem)
SELECT ord, label, c, CASE WHEN c > 0.9 THEN CASE WHEN label = 'positive' THEN 5 ELSE 1 END WHEN c > 0.7 THEN CASE WHEN label = 'positive' THEN 4 ELSE 2 END ELSE 3 END AS two,
 CASE WHEN c > 0.8 THEN CASE label WHEN 'positive' THEN 5 WHEN 'negative' THEN 1 ELSE 3 END WHEN c < 0.5 THEN 3 ELSE CASE label WHEN 'positive' THEN 4 WHEN 'negative' THEN 2 ELSE 3 END END AS three FROM v""",
)
def label_to_score(spark, sf):
    v = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS ord", "CASE l_returnflag WHEN 'A' THEN 'positive' WHEN 'N' THEN 'neutral' ELSE 'negative' END AS label", "l_discount * 10 AS c"
    )
    label, c = F.col("label"), F.col("c")
    return v.select("ord", "label", "c", scoring.label_to_score(label, c, "two").alias("two"), scoring.label_to_score(label, c).alias("three"))


def _sql_terms(words, mood):
    cases = ", ".join(f"CASE WHEN contains(t, '{w}') THEN '{w}' END" for w in words)
    return f"WHEN '{mood}' THEN array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL)[1:3], ', ')"


MOOD = "CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'neutral' END"
PADDED = "concat(text, CASE WHEN doc_id % 4 = 0 THEN ' well organized and clear, a great success' WHEN doc_id % 4 = 1 THEN ' hard and confusing' ELSE '' END)"


@query(
    "evidence_terms",
    f"""WITH d AS (SELECT doc_id, lower({PADDED}) AS t, {MOOD} AS m FROM documents)
SELECT doc_id, coalesce(nullif(CASE m {_sql_terms(dims.POSITIVE_WORDS, 'positive')} {_sql_terms(dims.NEGATIVE_WORDS, 'negative')} END, ''), 'sentiment language') AS terms FROM d""",
)
def evidence_terms(spark, sf):
    d = table(spark, sf, "documents").selectExpr("doc_id", f"{PADDED} AS t", f"{MOOD} AS m")
    return d.select("doc_id", scoring.evidence_terms(F.col("t"), F.col("m")).alias("terms"))


RAW_REPLY = """CASE l_linenumber WHEN 1 THEN 'none' WHEN 2 THEN '{"sentiment": "positive", "score": 4}' WHEN 3 THEN '{"sentiment": "Great", "score": "x", "reasoning": "r"}'
 ELSE concat('ok {"sentiment": "', CASE l_returnflag WHEN 'A' THEN 'POSITIVE' ELSE 'negative' END, '", "score": ', CASE WHEN l_quantity > 48 THEN '1000000000000' WHEN l_quantity > 46 THEN '{"deep": [[[]]]}' ELSE CAST(CAST(l_quantity AS INT) % 8 AS STRING) END, ', "reasoning": "why ', l_returnflag, '"}') END"""


@query(
    "validate_reply",
    """WITH v AS (SELECT l_orderkey AS ord, l_linenumber AS n, l_returnflag AS f, CASE WHEN l_quantity > 46 THEN 9 ELSE CAST(CAST(l_quantity AS INT) % 8 AS INT) END AS s FROM lineitem)
SELECT ord, n, CASE WHEN n <= 3 THEN 'neutral' WHEN f = 'A' THEN 'positive' ELSE 'negative' END AS sentiment, CASE WHEN n <= 3 OR s < 1 OR s > 5 THEN 3 ELSE s END AS score,
 CASE WHEN n <= 2 THEN 'Failed to parse response' WHEN n = 3 THEN 'r' ELSE concat('why ', f) END AS reasoning FROM v""",
)
def validate_reply(spark, sf):
    r = table(spark, sf, "lineitem").selectExpr("l_orderkey AS ord", "l_linenumber AS n", f"{RAW_REPLY} AS reply_json")
    return scoring.validate_reply(r).drop("reply_json")


# --- classifier and nested report -----------------------------------------------------------
@query("noise_classifier")
def noise_classifier(spark, sf):
    """Trained on the labelled documents, applied to all documents."""
    model = noise_model.train(view(spark, sf, "noise_labels").select("text", "label"))
    return noise_model.keep(model, table(spark, sf, "documents"), "doc_id").select("doc_id", "keep")


@query(
    "nested_report",
    f"""WITH {GATED}, {OVERALL}, n AS (SELECT {K}, row_number() OVER (PARTITION BY {K} ORDER BY ord) AS n FROM ok)
SELECT {K}, 0::BIGINT AS chunk, 13 AS topics, 0 AS comments, overall_score, count(*) AS processed FROM ok LEFT JOIN ov USING ({K}) GROUP BY ALL
UNION ALL SELECT {K}, (n - 1) // {report.COMMENT_CHUNK} + 1, 0, CAST(count(*) AS INT), NULL, NULL FROM n GROUP BY ALL""",
)
def nested_report(spark, sf):
    """The documents, opened again: figures once per report, comments in chunks."""
    a, t = load(spark, sf)
    v = F.parse_json("report_json")
    size = lambda f: F.coalesce(F.size(F.try_variant_get(v, f"$.{f}", "array<variant>")), F.lit(0))
    return report.nested_report(report.passed(a, t), t, KEYS).select(
        *KEYS, "chunk", size("categories").alias("topics"), size("comments").alias("comments"),
        F.try_variant_get(v, "$.overall_score", "double").alias("overall_score"), F.try_variant_get(v, "$.metadata.processed_comments", "bigint").alias("processed"),
    )


# --- the whole chain ------------------------------------------------------------------------
CHAIN = f"""{REPLIES}, u AS (SELECT * FROM (SELECT * EXCLUDE (text), {sql_prepare('text')} AS text FROM comments) WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY course_id, text ORDER BY ord) = 1),
d AS (SELECT a.* EXCLUDE (text), u.text FROM assessed a JOIN u USING (course_id, ord)),
cn AS (SELECT course_id, count(*) AS input_comments FROM comments GROUP BY ALL),
tr AS (SELECT course_id, ord, text, mood AS score, unnest(list_filter([CASE WHEN t2 THEN 2 END, CASE WHEN t5 THEN 5 END], lambda x: x IS NOT NULL)) AS topic_no FROM d WHERE NOT non_teaching AND n_passed > 0),
oth AS (SELECT *, CASE WHEN NOT non_teaching AND status <> 'model_error' AND n_topics = 0 THEN general END AS g FROM d WHERE non_teaching OR status = 'model_error' OR n_passed = 0)"""


def chained(spark, sf):
    return chain.course_reports(view(spark, sf, "comments"), view(spark, sf, "topics"), ["course_id"], lambda c: scoring.score_comments(c, CUES, **WORDS))


@query(
    "course_reports",
    f"""WITH {CHAIN} SELECT cn.course_id, input_comments, (SELECT count(*) FROM d WHERE d.course_id = cn.course_id) AS processed_comments,
 (SELECT {sql_round2('avg(m)')} FROM (SELECT avg(score) AS m FROM tr WHERE tr.course_id = cn.course_id GROUP BY text)) AS overall_score,
 (SELECT count(*) FROM d WHERE d.course_id = cn.course_id AND non_teaching) AS non_teaching_skipped,
 (SELECT count(*) FROM oth WHERE oth.course_id = cn.course_id) AS generic_comments,
 (SELECT count(*) FROM d WHERE d.course_id = cn.course_id AND NOT non_teaching AND status = 'model_error') AS classification_errors,
 (SELECT CAST(coalesce(sum(n_topics - n_passed), 0) AS BIGINT) FROM d WHERE d.course_id = cn.course_id AND NOT non_teaching) AS low_confidence,
 (SELECT {sql_round2('avg(g)')} FROM oth WHERE oth.course_id = cn.course_id) AS tone, (SELECT count(g) FROM oth WHERE oth.course_id = cn.course_id) AS tone_comments,
 (SELECT count(*) FROM tr WHERE tr.course_id = cn.course_id AND topic_no = 2) AS pace_comments, (SELECT {sql_round2('avg(score)')} FROM tr WHERE tr.course_id = cn.course_id AND topic_no = 5) AS fifth_average,
 (SELECT count(*) FROM tr WHERE tr.course_id = cn.course_id) + (SELECT count(*) FROM oth WHERE oth.course_id = cn.course_id) AS comments_listed FROM cn""",
)
def course_reports(spark, sf):
    """Comments to stored documents; the documents are opened again."""
    stored = written(chain.documents(chained(spark, sf), ["course_id"], "cue words"))
    v = F.parse_json("report_json")
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    meta = [get(f"$.metadata.{c}", "bigint").alias(c) for c in ("input_comments", "processed_comments", "non_teaching_skipped", "generic_comments", "classification_errors")]
    heads = stored.filter("chunk = 0").select(
        "course_id", *meta, get("$.overall_score", "double").alias("overall_score"), get("$.metadata.dropped_topic_assignments.low_confidence", "bigint").alias("low_confidence"),
        get("$.general_sentiment.average_score", "double").alias("tone"), get("$.general_sentiment.scored_comments", "bigint").alias("tone_comments"),
        get("$.categories[1].comment_count", "bigint").alias("pace_comments"), get("$.categories[4].average_score", "double").alias("fifth_average"),
    )
    comments = stored.filter("chunk > 0").groupBy("course_id").agg(F.sum(F.size(get("$.comments", "array<variant>"))).alias("comments_listed"))
    return heads.join(comments, "course_id", "left")


@query(
    "report_export",
    f"""WITH {CHAIN}, names AS (SELECT topic_no, topic FROM topics),
listed AS (SELECT course_id, ord, text, topic_no, CAST(score AS VARCHAR) AS score FROM tr UNION ALL SELECT course_id, ord, text, 13, '' FROM oth)
SELECT c.course_id AS "Course ID", topic AS "Topic", coalesce(text, '') AS "Feedback", coalesce(score, '') AS "Score",
 CASE WHEN ord IS NULL OR row_number() OVER (PARTITION BY c.course_id, n.topic_no ORDER BY ord) = 1 THEN 1 ELSE 0 END AS has_summary
FROM (SELECT DISTINCT course_id FROM d) c CROSS JOIN names n LEFT JOIN listed l ON l.course_id = c.course_id AND l.topic_no = n.topic_no""",
)
def report_export(spark, sf):
    """The flat export, written with all its columns and read back."""
    path = files.scratch(spark, "export")
    files.write_csv(chain.export_rows(chained(spark, sf), ["course_id"]), path)
    rows = files.read_csv_survey(spark, path)
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    has = (F.coalesce(F.col("`Topic Summary`"), F.lit("")) != "").cast("int").alias("has_summary")
    return rows.select("Course ID", "Topic", blank("Feedback"), blank("Score"), has)
