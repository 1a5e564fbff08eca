"""Text rules work on runs of characters and search for fixed words first; their results are those of the plain rules."""

import re
import unicodedata

from pyspark.sql import functions as F

from feedloom import dims
from feedloom.functions import text as tx

TEXTS = ["", " ", "• ofiﬁce… café １ a- b- c- d", "x y \n z  ", "very - good", "n/a", "n/agree", "N a‐", "5 6.0%", "50% 3 4",
         "Students Enrolled: 5", "see page 3/4", "page 3 of 4", "n=5 and av.=2", "Å and é", "end.　", "To What Extent do you feel"]


def rows(spark, column):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    return dict(zip(TEXTS, [r.y for r in df.coalesce(1).select(column(F.col("t")).alias("y")).collect()]))


def plain_noise(text):
    t = text.strip("".join(chr(c) for a, b in dims.SPACE_RANGES for c in range(a, b + 1))).lower()
    squished = "".join(c for c in t if not any(a <= ord(c) <= b for a, b in dims.SPACE_RANGES) and c not in "-‐_|")
    scale = re.compile("|".join([w + "(?!gree|bout right)" if w in ("n/a", "na") else w for w in dims.NOISE_SCALE_WORDS] + [r"\s", "/"]))
    return (
        t in ("", "nan") or squished in dims.NOISE_WORDS or any(p in t for p in dims.NOISE_PHRASES)
        or any(re.search(p, t) for p in dims.NOISE_PATTERNS) or scale.sub("", t) == ""
    )


def test_rules_against_plain_ones(spark):
    assert rows(spark, tx.nfkc) == {t: unicodedata.normalize("NFKC", t) for t in TEXTS}
    assert rows(spark, tx.is_noise) == {t: bool(plain_noise(t)) for t in TEXTS}
    assert rows(spark, tx.clean_text)[TEXTS[2]] == "ofifice... café 1 ab- cd"  # a letter joins once
    assert all(any(w in p for w in tx.PHRASE_WORDS) for p in dims.NOISE_PHRASES)


def test_plain_runs_stay_whole(spark):
    """One element for each run, not for each character of a text that holds a single odd one."""
    df = spark.range(1).select(F.regexp_extract_all(F.lit("plain é words" * 9 + "…"), F.lit(r"[\x00-\x7F\xC0-\xFF]+|[^\x00-\x7F\xC0-\xFF]+"), F.lit(0)).alias("r"))
    assert len(df.first().r) == 2
    plan = spark.createDataFrame([("a",)], "t string").select(tx.clean_text(F.col("t")))._jdf.queryExecution().analyzed().toString()
    assert "(?s).," not in plan and r"\P{M}\p{M}*" not in plan
