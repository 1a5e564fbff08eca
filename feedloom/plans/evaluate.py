"""Score predictions against human labels. Everything reduces to small count tables before metrics are formed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom import dims
from feedloom.functions.numbers import half_even, ratio
from feedloom.functions.text import canonical_key, sentiment_from_score
from feedloom.operators.stages import checkpointed


def predicted_pairs(rows: DataFrame, text: str = "feedback", order: str = "ord") -> DataFrame:
    """(comment key, topic) with the score of the last row."""
    return (
        rows.withColumn("key", canonical_key(F.col(text)))
        .groupBy("key", "topic_no")
        .agg(F.max_by(F.struct("score"), F.struct(order, "score")).alias("s"))
        .select("key", "topic_no", F.col("s.score").alias("score"))
    )


def topic_sets(gold: DataFrame, predicted: DataFrame, key: Sequence[str] = ("ord",)) -> DataFrame:
    """Gold and predicted topic sets per labelled comment: one shuffle on the key, sets of at most 13."""
    both = gold.select(*key, F.col("topic_no").alias("g"), F.lit(None).cast("int").alias("p")).unionByName(
        predicted.select(*key, F.lit(None).cast("int").alias("g"), F.col("topic_no").alias("p"))
    )
    sets = both.groupBy(*key).agg(F.collect_set("g").alias("gold"), F.collect_set("p").alias("pred"))
    return sets.filter(F.size("gold") > 0)


def _counts(sets: DataFrame, by: Sequence[str]) -> DataFrame:
    t = sets.select(*by, "gold", "pred", F.explode(F.array(*[F.lit(no) for no, *_ in dims.TOPICS])).alias("topic_no"))
    g, p = F.array_contains("gold", F.col("topic_no")), F.array_contains("pred", F.col("topic_no"))
    return t.groupBy(*by, "topic_no").agg(
        F.count_if(g & p).alias("tp"), F.count_if(p & ~g).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(g).alias("support")
    )


def topic_confusion(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    return _counts(topic_sets(gold, predicted), []).drop("support")


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def _prf(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return p, r, f1(p, r)


def per_topic_f1(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    c = topic_confusion(gold, predicted)
    _, _, f = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return c.filter(F.col("tp") + F.col("fp") + F.col("fn") > 0).select("topic_no", half_even(f, 3).alias("f1"))


def topic_f1(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Micro and macro figures; macro averages topics that occur at all, over their rounded F1."""
    sets = topic_sets(gold, predicted)
    _, _, f = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    seen = F.col("tp") + F.col("fp") + F.col("fn") > 0
    c = _counts(sets, []).agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
        F.sum(F.when(seen, half_even(f, 3)).cast("decimal(20,12)")).cast("double").alias("f1_sum"), F.count_if(seen).alias("f1_n"),
    )
    e = sets.agg(
        F.struct(
            F.count("*").alias("comments"), F.count_if(F.sort_array("gold") == F.sort_array("pred")).alias("hits")
        ).alias("e")
    ).scalar()
    p, r, f = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    c = c.withColumn("e", e)
    comments, hits = F.col("e.comments"), F.col("e.hits")
    return c.select(
        comments.alias("comments"),
        half_even(p, 3).alias("micro_precision"),
        half_even(r, 3).alias("micro_recall"),
        half_even(f, 3).alias("micro_f1"),
        half_even(ratio(F.col("f1_sum"), F.col("f1_n")), 3).alias("macro_f1"),
        half_even(ratio(hits, comments), 3).alias("exact_match"),
    )


def model_topic_counts(matched: DataFrame) -> DataFrame:
    """Per model and topic: support, tp, fp, fn, precision, recall, F1 (4 places).

    ``matched`` has one row per matched comment: model, gold, pred (topic sets), similarity.
    """
    c = _counts(matched, ["model"])
    p, r, f = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return c.select(
        "model", "topic_no", "support", "tp", "fp", "fn",
        half_even(p, 4).alias("precision"), half_even(r, 4).alias("recall"), half_even(f, 4).alias("f1"),
    )


def model_topic_report(matched: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per model: coverage, similarity, exact sets, micro figures; macro F1 averages supported topics only.

    ``benchmark`` is one row with ``benchmark_n``, the number of labelled comments.
    """
    topics = model_topic_counts(matched).groupBy("model").agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
        F.sum(F.when(F.col("support") > 0, F.col("f1")).cast("decimal(20,12)")).cast("double").alias("s"),
        F.count_if(F.col("support") > 0).alias("n"),
    )
    rows = matched.groupBy("model").agg(
        F.count("*").alias("matched"),
        F.min("similarity").alias("lo"),
        (F.sum(F.col("similarity").cast("decimal(20,12)")).cast("double") / F.count("*")).alias("mid"),
        F.count_if(F.sort_array("gold") == F.sort_array("pred")).alias("exact_set_matches"),
    )
    p, r, f = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    total = benchmark.select("benchmark_n").scalar()
    return topics.join(rows, "model").select(
        "model",
        "matched",
        half_even(ratio(F.col("matched"), total) * 100, 2).alias("match_coverage"),
        half_even(F.col("lo"), 4).alias("min_similarity"),
        half_even(F.col("mid"), 4).alias("mean_similarity"),
        "exact_set_matches",
        half_even(ratio(F.col("exact_set_matches"), F.col("matched")) * 100, 2).alias("exact_set_match_rate"),
        half_even(p * 100, 2).alias("micro_precision"),
        half_even(r * 100, 2).alias("micro_recall"),
        half_even(f * 100, 2).alias("micro_f1"),
        half_even(ratio(F.col("s"), F.col("n")) * 100, 2).alias("macro_f1"),
        F.col("tp").alias("true_positives"),
        F.col("fp").alias("false_positives"),
        F.col("fn").alias("false_negatives"),
    )


def last_wins(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Collapse repeated keys to the last row; ``collapsed`` says how many rows each key lost."""
    rest = [c for c in rows.columns if c not in key]
    agg = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"), (F.count("*") - 1).alias("collapsed"))
    return agg.select(*key, *[F.col(f"r.{c}").alias(c) for c in rest], "collapsed")


def score_metrics(gold: DataFrame, predicted: DataFrame, key: Sequence[str]) -> DataFrame:
    """Coverage, error and agreement over labelled pairs. ``gold`` keys may repeat; ``predicted`` keys are unique."""
    j = gold.join(predicted.select(*key, F.col("score").alias("p")), list(key), "left")
    err = F.abs(F.col("p") - F.col("score"))
    a = j.agg(
        F.count("*").alias("pairs"),
        F.count("p").alias("n"),
        F.sum(err).alias("e"),
        F.count_if(err == 0).alias("exact"),
        F.count_if(err <= 1).alias("near"),
        F.count_if(F.col("p").isNotNull() & (sentiment_from_score(F.col("p")) == F.col("sentiment"))).alias("agree"),
    )
    n = F.col("n")
    return a.select(
        "pairs",
        half_even(ratio(n, F.col("pairs")), 3).alias("coverage"),
        half_even(ratio(F.coalesce("e", F.lit(0)), n), 3).alias("mae"),
        half_even(ratio(F.col("exact"), n), 3).alias("exact"),
        half_even(ratio(F.col("near"), n), 3).alias("within_1"),
        half_even(ratio(F.col("agree"), n), 3).alias("sentiment_agreement"),
    )


def score_cells(gold: DataFrame, predicted: DataFrame, key: Sequence[str]) -> DataFrame:
    """Counts per (model, human score and label, model score and label): at most 225 rows per model.

    Rows without a gold partner have null human values. All model metrics are formed from this table.
    """
    g = gold.select(*key, F.col("score").alias("gs"), F.col("sentiment").alias("gl"), F.lit(True).alias("hit"))
    p = predicted.select("model", *key, F.col("score").alias("ps"), F.col("sentiment").alias("pl"))
    return p.join(g, list(key), "left").groupBy("model", "hit", "gs", "gl", "ps", "pl").agg(F.count("*").alias("n"))


def metrics_from_cells(cells: DataFrame, gold_rows: DataFrame) -> DataFrame:
    """The model score report. ``gold_rows`` is one row with ``gold_n``, the number of human keys.

    One aggregate per model: the five scores and three labels are folded into columns, so the cells are read once.
    """
    hit, n = F.col("hit"), F.col("n")
    err = F.abs(F.col("gs") - F.col("ps"))
    gl, pl = F.col("gl"), F.col("pl")

    def count(cond: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(cond, n)), F.lit(0)).alias(name)

    figures = [
        count(hit, "common"),
        count(hit.isNull(), "extra"),
        count(hit & (err == 0), "exact"),
        count(hit & (err <= 1), "near"),
        count(hit & (gl == pl), "label"),
        F.sum(F.when(hit, n * err)).alias("e1"),
        F.sum(F.when(hit, n * err * err)).alias("e2"),
    ]
    scores = range(1, 6)
    for k in scores:
        of = hit & (F.col("gs") == k)
        figures += [count(of, f"t{k}"), count(of & (err == 0), f"x{k}"), count(of & (err <= 1), f"w{k}")]
    for s in dims.SENTIMENTS:
        figures += [
            count(hit & (gl == s) & (pl == s), f"tp_{s}"),
            count(hit & (gl != s) & (pl == s), f"fp_{s}"),
            count(hit & (gl == s) & (pl != s), f"fn_{s}"),
        ]
    agg = cells.groupBy("model").agg(*figures)

    def mean_of(parts: list[tuple[Column, Column]]) -> Column:
        """Mean of the values whose condition holds; 0 when none does."""
        total, count_ = F.lit(0.0), F.lit(0)
        for cond, value in parts:
            total = total + F.when(cond, value).otherwise(0.0)
            count_ = count_ + F.when(cond, 1).otherwise(0)
        return ratio(total, count_)

    def balanced(prefix: str) -> Column:
        return mean_of([(F.col(f"t{k}") > 0, ratio(F.col(f"{prefix}{k}"), F.col(f"t{k}"))) for k in scores])

    def label_f1() -> Column:
        parts = []
        for s in dims.SENTIMENTS:
            tp, fp, fn = (F.col(f"{c}_{s}") for c in ("tp", "fp", "fn"))
            parts.append((tp + fn > 0, _prf(tp, fp, fn)[2]))
        return mean_of(parts)

    k = F.col("common")
    pct = lambda x: half_even(ratio(x, k) * 100, 2)
    return agg.withColumn("gold_n", gold_rows.select("gold_n").scalar()).select(
        "model",
        k.alias("common_items"),
        (F.col("gold_n") - k).alias("missing_items"),
        F.col("extra").alias("extra_items"),
        pct(F.col("exact")).alias("exact_pct"),
        pct(F.col("near")).alias("within_1_pct"),
        F.when(k > 0, half_even(F.col("e1") / k, 4)).alias("mae"),
        F.when(k > 0, half_even(F.sqrt(F.col("e2") / k), 4)).alias("rmse"),
        half_even(balanced("x") * 100, 2).alias("balanced_pct"),
        half_even(balanced("w") * 100, 2).alias("within_1_balanced_pct"),
        pct(F.col("label")).alias("label_accuracy_pct"),
        half_even(label_f1() * 100, 2).alias("label_macro_f1_pct"),
    )


def model_score_report(gold: DataFrame, predicted: DataFrame, key: Sequence[str]) -> DataFrame:
    gold = checkpointed(gold)  # joined and counted
    return metrics_from_cells(score_cells(gold, predicted, key), gold.agg(F.count("*").alias("gold_n")))


def constant_baselines(gold: DataFrame) -> DataFrame:
    """Metrics of always predicting 1, 2, 3, 4 or 5, from the distribution of human scores and labels."""
    dist = gold.groupBy(F.col("score").alias("gs"), F.col("sentiment").alias("gl")).agg(F.count("*").alias("n"))
    c = dist.withColumn("ps", F.explode(F.array(*[F.lit(i) for i in range(1, 6)])))
    cells = c.select(
        F.concat(F.lit("Constant "), F.col("ps").cast("string")).alias("model"), F.lit(True).alias("hit"),
        "gs", "gl", "ps", sentiment_from_score(F.col("ps")).alias("pl"), "n",
    )
    return metrics_from_cells(cells, gold.agg(F.count("*").alias("gold_n")))


def key_set_diff(reference: DataFrame, predicted: DataFrame, key: Sequence[str]) -> DataFrame:
    """Each distinct key and where it occurs: both, reference_only or prediction_only."""
    both = reference.select(*key, F.lit(True).alias("r"), F.lit(False).alias("p")).unionByName(
        predicted.select(*key, F.lit(False).alias("r"), F.lit(True).alias("p"))
    )
    flags = both.groupBy(*key).agg(F.bool_or("r").alias("r"), F.bool_or("p").alias("p"))
    side = F.when(F.col("r") & F.col("p"), "both").when(F.col("r"), "reference_only").otherwise("prediction_only")
    return flags.select(*key, side.alias("side"))


def score_label_conflicts(predicted: DataFrame) -> DataFrame:
    s, label = F.col("score"), F.col("sentiment")
    conflict = (
        ((label == "positive") & (s < 4)) | ((label == "negative") & (s > 2)) | ((label == "neutral") & ~s.isin(2, 3))
    )
    return predicted.groupBy("model").agg(F.count_if(conflict).alias("conflicts"), F.count("*").alias("items"))


def pairwise_agreement(predicted: DataFrame, key: Sequence[str]) -> DataFrame:
    """Every pair of models over their common keys (keys are unique per model)."""
    a = predicted.select(*key, F.col("model").alias("model_1"), F.col("score").alias("s1"))
    b = predicted.select(*key, F.col("model").alias("model_2"), F.col("score").alias("s2"))
    d = F.abs(F.col("s1") - F.col("s2"))
    agg = (
        a.join(b, list(key))
        .filter(F.col("model_1") < F.col("model_2"))
        .groupBy("model_1", "model_2")
        .agg(F.count("*").alias("common_items"), F.count_if(d == 0).alias("x"), F.count_if(d <= 1).alias("w"), F.sum(d).alias("d"))
    )
    n = F.col("common_items")
    return agg.select(
        "model_1", "model_2", "common_items",
        half_even(ratio(F.col("x"), n) * 100, 2).alias("exact_pct"),
        half_even(ratio(F.col("w"), n) * 100, 2).alias("within_1_pct"),
        half_even(ratio(F.col("d"), n), 4).alias("mean_abs_difference"),
    )


def best_model(models: DataFrame, baselines: DataFrame) -> DataFrame:
    """Lowest error (ties by exact share), fastest (ties: the first by name), and whether the best beats the best constant guess."""
    m = models.agg(
        F.min_by("model", F.struct("mae", -F.col("exact_pct"), "model")).alias("best_model"),
        F.min("mae").alias("best_mae"),
        F.min_by("model", F.struct(-F.col("speed"), F.col("model"))).alias("fastest_model"),
    )
    b = baselines.agg(
        F.struct(F.min_by("model", F.struct("mae", "model")).alias("model"), F.min("mae").alias("mae")).alias("b")
    ).scalar()
    return m.withColumn("b", b).select(
        "best_model", "fastest_model", F.col("b.model").alias("best_baseline"), (F.col("best_mae") < F.col("b.mae")).alias("beats_baseline")
    )


def throughput(metadata: DataFrame) -> DataFrame:
    """Items per second of each run, 0 when the time is unknown or 0."""
    t = F.coalesce("total_time", F.lit(0.0))
    n = F.coalesce(F.col("num_feedbacks").cast("double"), F.lit(0.0))
    return metadata.select("model", F.when(t > 0, n / F.when(t > 0, t)).otherwise(0.0).alias("items_per_second"))


def f1_matrix(per_topic: DataFrame, names: DataFrame, models: Sequence[str]) -> DataFrame:
    """Topic x model F1 in percent; topics by falling support (``position``). At most 13 rows."""
    cells = per_topic.filter((F.col("support") > 0) & F.col("model").isin(list(models))).groupBy("topic_no").agg(
        F.max("support").alias("max_support"),
        *[F.max(F.when(F.col("model") == m, F.col("f1") * 100)).alias(f"f1_{m}") for m in models],
    )
    return (
        cells.join(F.broadcast(names.select("topic_no", F.col("short_name").alias("topic"))), "topic_no")
        .select("topic", "max_support", *[f"f1_{m}" for m in models])
        .orderBy(F.desc("max_support"), "topic")
    )


def gold_distribution(gold: DataFrame) -> DataFrame:
    one = gold.agg(*[F.count_if(F.col("score") == i).alias(f"s{i}") for i in range(1, 6)])
    rows = F.array(*[F.struct(F.lit(i).alias("score"), F.col(f"s{i}").alias("items")) for i in range(1, 6)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def other_share(rows: DataFrame, comments: DataFrame) -> DataFrame:
    """Share of comments left in Other: rows of topic Other over the number of comments."""
    o = rows.agg(F.count_if(F.col("topic_no") == dims.OTHER_NO).alias("o"))
    n = comments.agg(F.count("*").alias("n")).scalar()
    return o.withColumn("n", n).select(half_even(ratio(F.col("o"), F.col("n")), 3).alias("other_share"))
