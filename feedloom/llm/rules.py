"""Quality rules: fixed base rules and robust multivariate outliers, all in DataFrame functions.

Per text a vector of five transformed statistics is formed. For each pair of language and source the minimum covariance
determinant estimate is found by concentration steps: from coordinate-wise medians and deviations, the half of rows with
the smallest distances gives a mean and covariance, whose distances choose the next half. The end estimate is reweighted
once. A text is rejected if its Mahalanobis distance is beyond the cut. Pairs with few rows use their language's estimate.

Text is read once; the steps work on a written table of five numbers a row. Medians and halves come from mergeable
percentile sketches and moments from sums, so a source that holds a third of all rows reaches the shuffle as one row per
task. Estimates are one row per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.operators.stages import written

LEAST_WORDS = 50
LEAST_ROWS = 100  # a smaller group has no estimate of its own
HALF = 0.75  # part of a group's rows that an estimate rests on
STEPS = 5
P = 5
MEDIAN_CHI2, CUT_CHI2 = 4.3515, 12.8325  # of five degrees of freedom: median, 97.5 %
REJECT = 30.0  # squared distance beyond which a text is an outlier: about the 99.998 % point of chi-square
RIDGE = 0.25  # added to the variance of each scaled statistic: many texts have no symbol or repeat at all
FLOORS = (0.3, 0.1, 0.1, 0.3, 0.3)  # least spread of each statistic
_WORD = r"[^\x20\x09-\x0D]+"
_Z = [f"_z{i}" for i in range(P)]


def word_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and _lines (lines with a word)."""
    keep = docs.columns
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    out = docs.withColumn("_body", body)
    out = out.withColumn("_words", F.regexp_extract_all("_body", F.lit(_WORD), F.lit(0)))
    out = out.withColumn("_full", F.filter(F.split("_body", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    # each window as one number: its hash, shifted, and its place in the low bits; equal windows are neighbours once sorted
    out = out.withColumn("_bits", F.length(F.bin(F.size("_words"))))
    out = out.withColumn("_packed", F.expr("sort_array(transform(slice(_words, 1, greatest(size(_words) - 2, 0)), (w, i) -> shiftleft(xxhash64(w, get(_words, i + 1), get(_words, i + 2)), _bits) | i))"))
    same = (
        "(shiftrightunsigned(x, _bits) = shiftrightunsigned(get(_packed, k {d} 1), _bits)"
        " AND get(_words, {a}) = get(_words, {b}) AND get(_words, {a} + 1) = get(_words, {b} + 1) AND get(_words, {a} + 2) = get(_words, {b} + 2))"
    )
    low = "cast({x} & (shiftleft(1L, _bits) - 1) AS int)"
    here = low.format(x="x")
    either = " OR ".join(same.format(d=d, a=here, b=low.format(x=f"get(_packed, k {d} 1)")) for d in ("-", "+"))
    out = out.withColumn("_twice", F.expr(f"filter(_packed, (x, k) -> {either})"))
    covered = F.expr(f"size(array_distinct(flatten(transform(_twice, x -> array({here}, {here} + 1, {here} + 2)))))")
    return out.select(
        *[F.col(f"`{c}`") for c in keep],
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_body", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("_full").cast("long").alias("_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vector() -> list[Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log1p("n_words"),
        F.log1p(F.col("word_chars") / words),
        F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("_lines"), F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / words),
    ]


def _median(c: Column) -> Column:
    return F.percentile_approx(c, 0.5, 10_000)


def _moments(rows: DataFrame) -> DataFrame:
    """(_g, _m.., _l..): means and the Cholesky factor of the covariance of each group."""
    pairs = [(i, j) for i in range(P) for j in range(i + 1)]
    sums = rows.groupBy("_g").agg(*[F.avg(z).alias(f"_m{i}") for i, z in enumerate(_Z)], *[F.avg(F.col(_Z[i]) * F.col(_Z[j])).alias(f"_s{i}{j}") for i, j in pairs])
    out = sums
    for i, j in pairs:  # rows of the factor in order; coordinates are scaled, so a small ridge keeps it regular
        value = F.col(f"_s{i}{j}") - F.col(f"_m{i}") * F.col(f"_m{j}") + F.lit(RIDGE if i == j else 0.0)
        for k in range(j):
            value = value - F.col(f"_l{i}{k}") * F.col(f"_l{j}{k}")
        out = out.withColumn(f"_l{i}{j}", F.sqrt(F.greatest(value, F.lit(1e-6))) if i == j else value / F.col(f"_l{j}{j}"))
    return out.select("_g", *[f"_m{i}" for i in range(P)], *[f"_l{i}{j}" for i, j in pairs])


def _distance(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """``rows`` with _d, the squared Mahalanobis distance under the group's estimate; rows of other groups drop out."""
    out = rows.join(estimate, "_g")
    for i in range(P):
        value = F.col(_Z[i]) - F.col(f"_m{i}")
        for j in range(i):
            value = value - F.col(f"_l{i}{j}") * F.col(f"_y{j}")
        out = out.withColumn(f"_y{i}", value / F.col(f"_l{i}{i}"))
    return out.withColumn("_d", sum((F.col(f"_y{i}") * F.col(f"_y{i}") for i in range(1, P)), F.col("_y0") * F.col("_y0")))


def _half(rows: DataFrame) -> DataFrame:
    """Of the rows with _d, those among the nearest of their group."""
    cut = written(rows.groupBy("_g").agg(F.percentile_approx("_d", HALF, 10_000).alias("_cut")))
    return rows.join(cut, "_g").where("_d <= _cut").select("_g", *_Z)


def estimates(long: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Estimates of the groups of ``long`` (_g, _x0.. _x4): the scaling table and the final table with ``_factor``."""
    x = [f"_x{i}" for i in range(P)]
    middle = written(long.groupBy("_g").agg(*[_median(F.col(c)).alias(f"_c{i}") for i, c in enumerate(x)], F.count("*").alias("_n")).where(F.col("_n") >= LEAST_ROWS).drop("_n"))
    spread = long.join(middle, "_g").groupBy("_g").agg(*[_median(F.abs(F.col(c) - F.col(f"_c{i}"))).alias(f"_w{i}") for i, c in enumerate(x)])
    spread = spread.select("_g", *[F.greatest(1.4826 * F.col(f"_w{i}"), F.lit(FLOORS[i])).alias(f"_w{i}") for i in range(P)])
    scale = written(middle.join(spread, "_g"))
    rows = written(scaled(long, scale))
    first = rows.withColumn("_d", sum((F.col(z) * F.col(z) for z in _Z[1:]), F.col(_Z[0]) * F.col(_Z[0])))
    estimate = written(_moments(_half(first)))
    for _ in range(STEPS):
        estimate = written(_moments(_half(_distance(rows, estimate))))
    estimate = _with_factor(rows, estimate)
    near = _distance(rows, estimate).where(F.col("_d") <= CUT_CHI2 * F.col("_factor")).select("_g", *_Z)
    return scale, _with_factor(rows, written(_moments(near)))


def _with_factor(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """Scale the covariance so that the median distance is that of chi-square; never shrink it, as constant statistics add nothing to distances."""
    factor = _distance(rows, estimate).groupBy("_g").agg((_median(F.col("_d")) / MEDIAN_CHI2).alias("_factor"))
    return written(estimate.join(factor.withColumn("_factor", F.greatest("_factor", F.lit(1.0))), "_g"))


def scaled(long: DataFrame, scale: DataFrame) -> DataFrame:
    rest = [c for c in long.columns if not c.startswith("_x")]
    return long.join(scale, "_g").select(*rest, *[((F.col(f"_x{i}") - F.col(f"_c{i}")) / F.col(f"_w{i}")).alias(_Z[i]) for i in range(P)])


def judge(docs: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(doc_id, base statistics, base_failed, distance, kept): one row per row of ``docs``.

    A null text has no words and fails the base rules. Null languages and sources are values like any other. Estimates
    rest on rows that pass the base rules; a row whose pair and language both have too few of them is judged by the base
    rules alone, and its distance is null. Repeated rows count each. An empty table gives an empty result.
    """
    own = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("_text"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("_lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_source"))
    stats = word_statistics(own, "_text").drop("_text").withColumn("base_failed", base_failed())
    group = F.concat(F.lit("2 "), F.length("_lang"), F.lit(" "), F.col("_lang"), F.col("_source"))
    stats = stats.select("*", group.alias("_pair"), F.concat(F.lit("1 "), F.col("_lang")).alias("_pool"), *[c.alias(f"_x{i}") for i, c in enumerate(_vector())])
    stats = written(stats.drop("_lang", "_source", "_lines"))
    good = stats.where("NOT base_failed")
    x = [f"_x{i}" for i in range(P)]
    long = good.select(F.explode(F.array("_pair", "_pool")).alias("_g"), *x)
    scale, estimate = estimates(long)
    both = scale.join(estimate, "_g")
    known = written(both)
    pairs = stats.select("_pair", "_pool").distinct()
    named = known.select(F.col("_g").alias("_known"))
    chosen = pairs.join(named, F.col("_pair") == F.col("_known"), "left").select("_pair", F.coalesce("_known", "_pool").alias("_g"))
    chosen = written(chosen.join(known, "_g"))  # per pair the estimate that judges it
    data = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    judged = stats.join(chosen, "_pair", "left")
    judged = judged.select(*data, *[c for c in chosen.columns if c[:2] in ("_m", "_l", "_f")], *[((F.col(f"_x{i}") - F.col(f"_c{i}")) / F.col(f"_w{i}")).alias(_Z[i]) for i in range(P)])
    for i in range(P):
        value = F.col(_Z[i]) - F.col(f"_m{i}")
        for j in range(i):
            value = value - F.col(f"_l{i}{j}") * F.col(f"_y{j}")
        judged = judged.withColumn(f"_y{i}", value / F.col(f"_l{i}{i}"))
    distance = sum((F.col(f"_y{i}") * F.col(f"_y{i}") for i in range(1, P)), F.col("_y0") * F.col("_y0")) / F.col("_factor")
    return judged.select(*data, distance.alias("distance"), (~F.col("base_failed") & F.coalesce(distance <= REJECT, F.lit(True))).alias("kept"))


def op9_outlier_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
