"""Evaluation against human labels over the gold and prediction views."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom import dims
from feedloom.catalog.base import query
from feedloom.functions.numbers import sql_half_even, sql_ratio
from feedloom.functions.text import sentiment_from_score
from feedloom.plans import evaluate as ev
from feedloom.views import table, view

KEY = ["ord", "topic_no"]


def h(x: str, p: int) -> str:
    return sql_half_even(x, p)


def gold_scores(spark, sf):
    """Human labels, repeated keys collapsed to the last; on every fifth repetition the label is neutral."""
    g = view(spark, sf, "gold_scores").withColumn(
        "sentiment", F.when(F.col("rep") == 5, "neutral").otherwise(sentiment_from_score(F.col("score")))
    )
    return ev.last_wins(g, KEY, ["rep", "score"]).drop("collapsed")


def pred_scores(spark, sf):
    p = view(spark, sf, "pred_scores").filter(F.col("score").isNotNull())
    p = p.withColumn("sentiment", F.when(F.col("rep") == 3, "positive").otherwise(sentiment_from_score(F.col("score"))))
    return ev.last_wins(p, ["model", *KEY], ["rep", "score"]).drop("collapsed")


SENT = "CASE WHEN score <= 2 THEN 'negative' WHEN score >= 4 THEN 'positive' ELSE 'neutral' END"
LABELS = f"""
gold AS (SELECT ord, topic_no, rep, score, CASE WHEN rep = 5 THEN 'neutral' ELSE {SENT} END AS sentiment FROM gold_scores
  QUALIFY row_number() OVER (PARTITION BY ord, topic_no ORDER BY rep DESC, score DESC) = 1),
pred AS (SELECT model, ord, topic_no, rep, score, CASE WHEN rep = 3 THEN 'positive' ELSE {SENT} END AS sentiment FROM pred_scores WHERE score IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY model, ord, topic_no ORDER BY rep DESC, score DESC) = 1)"""


def metrics_sql(pairs: str, preds: str) -> str:
    """Score metrics per model; ``pairs`` has model, gs, gl, ps, pl and ``preds`` model, total."""
    f1s = []
    for s in dims.SENTIMENTS:
        tp, fp, fn = (f"count(*) FILTER (gl {a} '{s}' AND pl {b} '{s}')" for a, b in (("=", "="), ("<>", "="), ("=", "<>")))
        f1s.append(f"SELECT model, {tp} AS tp, {fp} AS fp, {fn} AS fn FROM {pairs} GROUP BY model")
    pr = f"{sql_ratio('tp', 'tp + fp')} AS p, {sql_ratio('tp', 'tp + fn')} AS r"
    return f"""
lab AS (SELECT *, {pr} FROM ({' UNION ALL '.join(f1s)})),
lf AS (SELECT model, avg({sql_ratio('2 * p * r', 'p + r')}) FILTER (tp + fn > 0) AS f FROM lab GROUP BY model),
cls AS (SELECT model, gs, CAST(count(*) FILTER (gs = ps) AS DOUBLE) / count(*) AS x, CAST(count(*) FILTER (abs(gs - ps) <= 1) AS DOUBLE) / count(*) AS w FROM {pairs} GROUP BY ALL),
bal AS (SELECT model, avg(x) AS x, avg(w) AS w FROM cls GROUP BY model),
met AS (SELECT p.model, count(*) AS common_items, any_value(gold_n) - count(*) AS missing_items, any_value(total) - count(*) AS extra_items,
  {h("CAST(count(*) FILTER (gs = ps) AS DOUBLE) / count(*) * 100", 2)} AS exact_pct,
  {h("CAST(count(*) FILTER (abs(gs - ps) <= 1) AS DOUBLE) / count(*) * 100", 2)} AS within_1_pct,
  {h("CAST(sum(abs(gs - ps)) AS DOUBLE) / count(*)", 4)} AS mae,
  {h("sqrt(CAST(sum((gs - ps) * (gs - ps)) AS DOUBLE) / count(*))", 4)} AS rmse,
  {h("any_value(bal.x) * 100", 2)} AS balanced_pct, {h("any_value(bal.w) * 100", 2)} AS within_1_balanced_pct,
  {h("CAST(count(*) FILTER (gl = pl) AS DOUBLE) / count(*) * 100", 2)} AS label_accuracy_pct, {h("any_value(lf.f) * 100", 2)} AS label_macro_f1_pct
  FROM {pairs} p JOIN {preds} USING (model) JOIN bal USING (model) JOIN lf USING (model) CROSS JOIN (SELECT count(*) AS gold_n FROM gold) GROUP BY p.model)"""


PAIRS = """
pairs AS (SELECT model, g.score AS gs, g.sentiment AS gl, p.score AS ps, p.sentiment AS pl FROM pred p JOIN gold g USING (ord, topic_no)),
totals AS (SELECT model, count(*) AS total FROM pred GROUP BY model)"""


@query(
    "predicted_pairs",
    "SELECT concat('comment ', ord) AS key, topic_no, max(score) AS score FROM assignments GROUP BY ALL",
)
def predicted_pairs(spark, sf):
    return ev.predicted_pairs(view(spark, sf, "assignments"))


SETS = """
g AS (SELECT ord, list(topic_no ORDER BY topic_no) AS gs FROM gold_topics GROUP BY ord),
p AS (SELECT ord, list(topic_no ORDER BY topic_no) AS ps FROM pred_topics GROUP BY ord),
cells AS (SELECT t.topic_no, count(*) FILTER (list_contains(gs, t.topic_no) AND list_contains(ps, t.topic_no)) AS tp,
  count(*) FILTER (NOT list_contains(gs, t.topic_no) AND list_contains(ps, t.topic_no)) AS fp,
  count(*) FILTER (list_contains(gs, t.topic_no) AND NOT coalesce(list_contains(ps, t.topic_no), false)) AS fn
  FROM g LEFT JOIN p USING (ord) CROSS JOIN topics t GROUP BY t.topic_no)"""


def topic_rows(spark, sf):
    return view(spark, sf, "gold_topics"), view(spark, sf, "pred_topics")


@query("topic_confusion", f"WITH {SETS} SELECT * FROM cells")
def topic_confusion(spark, sf):
    return ev.topic_confusion(*topic_rows(spark, sf))


@query(
    "topic_f1",
    f"""WITH {SETS}, c AS (SELECT *, {sql_ratio('tp', 'tp + fp')} AS p, {sql_ratio('tp', 'tp + fn')} AS r FROM cells),
f AS (SELECT avg({h(sql_ratio('2 * p * r', 'p + r'), 3)}) FILTER (tp + fp + fn > 0) AS macro, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM c),
m AS (SELECT macro, {sql_ratio('tp', 'tp + fp')} AS p, {sql_ratio('tp', 'tp + fn')} AS r FROM f),
e AS (SELECT count(*) AS n, count(*) FILTER (gs = ps) AS hit FROM g LEFT JOIN p USING (ord))
SELECT n AS comments, {h('p', 3)} AS micro_precision, {h('r', 3)} AS micro_recall, {h(sql_ratio('2 * p * r', 'p + r'), 3)} AS micro_f1,
 {h('macro', 3)} AS macro_f1, {h(sql_ratio('hit', 'n'), 3)} AS exact_match FROM m, e""",
)
def topic_f1(spark, sf):
    return ev.topic_f1(*topic_rows(spark, sf))


@query(
    "per_topic_f1",
    f"""WITH {SETS}, c AS (SELECT *, {sql_ratio('tp', 'tp + fp')} AS p, {sql_ratio('tp', 'tp + fn')} AS r FROM cells)
SELECT topic_no, {h(sql_ratio('2 * p * r', 'p + r'), 3)} AS f1 FROM c WHERE tp + fp + fn > 0""",
)
def per_topic_f1(spark, sf):
    return ev.per_topic_f1(*topic_rows(spark, sf))


MODELS = ["a", "b"]
MATCHED = f"""
g AS (SELECT ord, list(topic_no ORDER BY topic_no) AS gs FROM gold_topics GROUP BY ord),
mp AS (SELECT DISTINCT 'a' AS model, ord, topic_no FROM pred_topics UNION ALL
  SELECT DISTINCT 'b', l_orderkey, CAST(1 + l_suppkey % 13 AS INT) FROM lineitem),
p AS (SELECT model, ord, list(topic_no ORDER BY topic_no) AS ps FROM mp GROUP BY ALL),
matched AS (SELECT model, ord, gs, ps, 0.7::DOUBLE + (ord % 30) / 100.0::DOUBLE AS similarity FROM g JOIN p USING (ord)
  WHERE 0.7::DOUBLE + (ord % 30) / 100.0::DOUBLE >= 0.8),
mc AS (SELECT model, t.topic_no, count(*) FILTER (list_contains(gs, t.topic_no)) AS support,
  count(*) FILTER (list_contains(gs, t.topic_no) AND list_contains(ps, t.topic_no)) AS tp,
  count(*) FILTER (NOT list_contains(gs, t.topic_no) AND list_contains(ps, t.topic_no)) AS fp,
  count(*) FILTER (list_contains(gs, t.topic_no) AND NOT list_contains(ps, t.topic_no)) AS fn
  FROM matched CROSS JOIN topics t GROUP BY ALL),
mf AS (SELECT *, {sql_ratio('tp', 'tp + fp')} AS p, {sql_ratio('tp', 'tp + fn')} AS r FROM mc)"""


def matched_sets(spark, sf):
    """Topic sets of matched comments; the similarity of a match follows from the comment number."""
    gold = view(spark, sf, "gold_topics").groupBy("ord").agg(F.collect_set("topic_no").alias("gold"))
    a = view(spark, sf, "pred_topics").withColumn("model", F.lit("a"))
    b = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("ord"), (1 + F.col("l_suppkey") % 13).cast("int").alias("topic_no"), F.lit("b").alias("model")
    )
    pred = a.unionByName(b).groupBy("model", "ord").agg(F.collect_set("topic_no").alias("pred"))
    m = pred.join(gold, "ord").withColumn("similarity", F.lit(0.7) + (F.col("ord") % 30) / 100.0)
    return m.filter(F.col("similarity") >= dims.MATCH_THRESHOLD)


@query(
    "model_topic_report",
    f"""WITH {MATCHED}, t AS (SELECT model, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, avg({h(sql_ratio('2 * p * r', 'p + r'), 4)}) FILTER (support > 0) AS macro FROM mf GROUP BY model),
u AS (SELECT *, {sql_ratio('tp', 'tp + fp')} AS p, {sql_ratio('tp', 'tp + fn')} AS r FROM t),
s AS (SELECT model, count(*) AS matched, min(similarity) AS lo, CAST(sum(CAST(similarity AS DECIMAL(20,12))) AS DOUBLE) / count(*) AS mid,
  count(*) FILTER (gs = ps) AS exact_set_matches FROM matched GROUP BY model)
SELECT model, matched, {h(sql_ratio('matched', '(SELECT count(*) FROM g)') + ' * 100', 2)} AS match_coverage, {h('lo', 4)} AS min_similarity, {h('mid', 4)} AS mean_similarity,
 exact_set_matches, {h(sql_ratio('exact_set_matches', 'matched') + ' * 100', 2)} AS exact_set_match_rate, {h('p * 100', 2)} AS micro_precision, {h('r * 100', 2)} AS micro_recall,
 {h(sql_ratio('2 * p * r', 'p + r') + ' * 100', 2)} AS micro_f1, {h('macro * 100', 2)} AS macro_f1,
 CAST(tp AS BIGINT) AS true_positives, CAST(fp AS BIGINT) AS false_positives, CAST(fn AS BIGINT) AS false_negatives
FROM u JOIN s USING (model)""",
)
def model_topic_report(spark, sf):
    n = view(spark, sf, "gold_topics").agg(F.count_distinct("ord").alias("benchmark_n"))
    return ev.model_topic_report(matched_sets(spark, sf), n)


@query(
    "f1_matrix",
    f"""WITH {MATCHED}, x AS (SELECT model, topic_no, support, {h(sql_ratio('2 * p * r', 'p + r'), 4)} AS f1 FROM mf WHERE support > 0)
SELECT short_name AS topic, max(support) AS max_support, max(f1 * 100) FILTER (model = 'a') AS f1_a, max(f1 * 100) FILTER (model = 'b') AS f1_b
FROM x JOIN topics USING (topic_no) GROUP BY short_name""",
)
def f1_matrix(spark, sf):
    return ev.f1_matrix(ev.model_topic_counts(matched_sets(spark, sf)), dims.topics(spark), MODELS)


@query(
    "score_metrics",
    f"""WITH {LABELS}, j AS (SELECT g.score AS gs, g.sentiment, p.score AS ps FROM gold g LEFT JOIN (SELECT * FROM pred WHERE model = 'a') p USING (ord, topic_no)),
a AS (SELECT count(*) AS pairs, count(ps) AS n, sum(abs(gs - ps)) AS e, count(*) FILTER (gs = ps) AS x, count(*) FILTER (abs(gs - ps) <= 1) AS w,
  count(*) FILTER (CASE WHEN ps <= 2 THEN 'negative' WHEN ps >= 4 THEN 'positive' WHEN ps = 3 THEN 'neutral' END = sentiment) AS s FROM j)
SELECT pairs, {h(sql_ratio('n', 'pairs'), 3)} AS coverage, {h(sql_ratio('e', 'n'), 3)} AS mae, {h(sql_ratio('x', 'n'), 3)} AS exact,
 {h(sql_ratio('w', 'n'), 3)} AS within_1, {h(sql_ratio('s', 'n'), 3)} AS sentiment_agreement FROM a""",
)
def score_metrics(spark, sf):
    return ev.score_metrics(gold_scores(spark, sf), pred_scores(spark, sf).filter(F.col("model") == "a"), KEY)


@query("model_score_report", f"WITH {LABELS}, {PAIRS}, {metrics_sql('pairs', 'totals')} SELECT * FROM met")
def model_score_report(spark, sf):
    return ev.model_score_report(gold_scores(spark, sf), pred_scores(spark, sf), KEY)


@query(
    "key_set_diff",
    f"""WITH {LABELS}, a AS (SELECT ord, topic_no FROM gold), b AS (SELECT DISTINCT ord, topic_no FROM pred)
SELECT ord, topic_no, 'both' AS side FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT ord, topic_no, 'reference_only' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT ord, topic_no, 'prediction_only' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
)
def key_set_diff(spark, sf):
    return ev.key_set_diff(gold_scores(spark, sf), pred_scores(spark, sf), KEY)


CONSTANT = """
cpairs AS (SELECT concat('Constant ', i) AS model, g.score AS gs, g.sentiment AS gl, CAST(i AS INT) AS ps,
  CASE WHEN i <= 2 THEN 'negative' WHEN i >= 4 THEN 'positive' ELSE 'neutral' END AS pl FROM gold g CROSS JOIN range(1, 6) r(i)),
ctotals AS (SELECT model, count(*) AS total FROM cpairs GROUP BY model)"""


@query("constant_baselines", f"WITH {LABELS}, {CONSTANT}, {metrics_sql('cpairs', 'ctotals')} SELECT * FROM met")
def constant_baselines(spark, sf):
    return ev.constant_baselines(gold_scores(spark, sf))


@query(
    "score_label_conflicts",
    f"""WITH {LABELS} SELECT model, count(*) FILTER ((sentiment = 'positive' AND score < 4) OR (sentiment = 'negative' AND score > 2)
 OR (sentiment = 'neutral' AND score NOT IN (2, 3))) AS conflicts, count(*) AS items FROM pred GROUP BY model""",
)
def score_label_conflicts(spark, sf):
    return ev.score_label_conflicts(pred_scores(spark, sf))


@query(
    "pairwise_agreement",
    f"""WITH {LABELS} SELECT a.model AS model_1, b.model AS model_2, count(*) AS common_items, {h("CAST(count(*) FILTER (a.score = b.score) AS DOUBLE) / count(*) * 100", 2)} AS exact_pct,
 {h("CAST(count(*) FILTER (abs(a.score - b.score) <= 1) AS DOUBLE) / count(*) * 100", 2)} AS within_1_pct, {h("CAST(sum(abs(a.score - b.score)) AS DOUBLE) / count(*)", 4)} AS mean_abs_difference
FROM pred a JOIN pred b ON a.ord = b.ord AND a.topic_no = b.topic_no AND a.model < b.model GROUP BY ALL""",
)
def pairwise_agreement(spark, sf):
    return ev.pairwise_agreement(pred_scores(spark, sf), KEY)


@query(
    "last_wins_labels",
    """SELECT ord, topic_no, score, rep, c - 1 AS collapsed FROM (SELECT *, count(*) OVER (PARTITION BY ord, topic_no) AS c,
 row_number() OVER (PARTITION BY ord, topic_no ORDER BY rep DESC, score DESC) AS r FROM gold_scores) WHERE r = 1""",
)
def last_wins_labels(spark, sf):
    return ev.last_wins(view(spark, sf, "gold_scores"), KEY, ["rep", "score"])


# Run metadata per model, from the prediction rows themselves: one time unit per repetition number.
META = """meta AS (SELECT model, CAST(sum(rep) AS DOUBLE) AS total_time, count(*) AS num_feedbacks FROM pred GROUP BY model)"""


def metadata(pred):
    return pred.groupBy("model").agg(F.sum("rep").cast("double").alias("total_time"), F.count("*").alias("num_feedbacks"))


@query(
    "best_model",
    f"""WITH {LABELS}, {PAIRS}, {metrics_sql('pairs', 'totals')}, {META}, {CONSTANT},
cm AS (SELECT model, {h("CAST(sum(abs(gs - ps)) AS DOUBLE) / count(*)", 4)} AS mae FROM cpairs GROUP BY model)
SELECT (SELECT model FROM met ORDER BY mae, exact_pct DESC, model LIMIT 1) AS best_model,
 (SELECT model FROM meta ORDER BY num_feedbacks / total_time DESC, model LIMIT 1) AS fastest_model,
 (SELECT model FROM cm ORDER BY mae, model LIMIT 1) AS best_baseline,
 (SELECT min(mae) FROM met) < (SELECT min(mae) FROM cm) AS beats_baseline""",
)
def best_model(spark, sf):
    gold, pred = gold_scores(spark, sf), pred_scores(spark, sf)
    speed = ev.throughput(metadata(pred)).withColumnRenamed("items_per_second", "speed")
    return ev.best_model(ev.model_score_report(gold, pred, KEY).join(speed, "model"), ev.constant_baselines(gold))


@query("throughput", f"WITH {LABELS}, {META} SELECT model, num_feedbacks / total_time AS items_per_second FROM meta")
def throughput(spark, sf):
    return ev.throughput(metadata(pred_scores(spark, sf)))


@query(
    "gold_distribution",
    f"""WITH {LABELS} SELECT CAST(i AS INT) AS score, count(g.ord) AS items FROM range(1, 6) r(i) LEFT JOIN gold g ON g.score = i GROUP BY ALL""",
)
def gold_distribution(spark, sf):
    return ev.gold_distribution(gold_scores(spark, sf))


@query(
    "other_share",
    f"""SELECT {h(sql_ratio('count(*) FILTER (topic_no = 13)', 'count(DISTINCT ord)'), 3)} AS other_share FROM pred_topics""",
)
def other_share(spark, sf):
    p = view(spark, sf, "pred_topics")
    return ev.other_share(p, p.select("ord").distinct())
