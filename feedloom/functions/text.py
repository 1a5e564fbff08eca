"""Text and scalar functions: plain column expressions that stay in the JVM.

Patterns that the checks share are module constants in a spelling Java and RE2 read alike.
"""

from __future__ import annotations

import json
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom import dims

def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also in filters and branches, where Catalyst does not share
    common subexpressions. Without it a chain of text functions would repeat its input many times over."""
    return F.transform(F.array(value), body)[0]


def with_once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Like ``withColumn``, but a later filter on the column is not rewritten into a second evaluation of ``value``.

    Catalyst moves filters below a projection by repeating the expression; it does not move them below a generator.
    """
    rest = [c for c in rows.columns if c != name]
    return rows.select(*rest, F.explode(F.array(value)).alias(name))


WS = f"[{dims.SPACE_CLASS}]"
_B = dims.BULLETS
_SPACES = "".join(chr(c) for a, b in dims.SPACE_RANGES for c in range(a, b + 1))
# White space but for the plain blank. Java tests the first range alone for most characters.
_WIDE = rf"[\x00-\x1F\x{{7F}}-\x{{3000}}&&[{dims.SPACE_CLASS}]]"


def strip_space(text: Column) -> Column:
    """Trim all Unicode white space, not only blanks."""
    return F.btrim(text, F.lit(_SPACES))


def norm_whitespace(text: Column) -> Column:
    """Runs of white space become one blank; a run that is one blank already is no match."""
    return F.trim(F.regexp_replace(text, f"{_WIDE}{WS}*| {WS}+", " "))


def _char_map(mapping: dict[str, str]) -> Column:
    """A constant map from one literal; building it entry by entry would bloat the plan."""
    return F.from_json(F.lit(json.dumps(mapping)), "map<string,string>")


def _in_runs(text: Column, plain: str, change) -> Column:
    """``change`` of each run of characters outside the regex class ``plain``; the runs of plain ones stay as they are."""
    runs = F.regexp_extract_all(text, F.lit(f"[{plain}]+|[^{plain}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(f"^[^{plain}]"), change(r)).otherwise(r)), "")


def _expand(text: Column, mapping: dict[str, str]) -> Column:
    """Replace single characters by several; a run of ASCII characters skips the lookup."""
    table = _char_map(mapping)
    each = F.transform(
        F.regexp_extract_all(text, F.lit(r"(?s)[\x00-\x7F]+|."), F.lit(0)),
        lambda c: F.when(c > "\x7f", F.coalesce(F.try_element_at(table, c), c)).otherwise(c),
    )
    found = F.translate(text, "".join(sorted(mapping)), "") != text  # hash lookups; a large regex class would be slow
    return F.when(found, F.array_join(each, "")).otherwise(text)


def nfkd_ascii(text: Column) -> Column:
    """Compatibility-decompose and keep the ASCII characters.

    Spark has no normalization function; the folding is a ``translate`` over a table built by rule. Characters that
    fold to several (ligatures, fractions) are expanded first. Pure ASCII text skips both.
    """
    source, target, several = dims.ascii_folding()

    def folded(t: Column) -> Column:
        ascii_only = _in_runs(t, r"\x00-\x7F", lambda r: F.regexp_replace(F.translate(_expand(r, several), source, target), r"[^\x00-\x7F]", ""))
        return F.when(t.rlike(r"[^\x00-\x7F]"), ascii_only).otherwise(t)

    return let(text, folded)


def nfkc(text: Column) -> Column:
    """Compatibility-compose: one-to-one and one-to-several characters, then letters followed by combining marks."""
    source, target, several, composed = dims.compatibility_map()
    marks = _char_map(composed)

    def with_marks(one: Column) -> Column:
        clusters = F.transform(
            F.regexp_extract_all(one, F.lit(r"\P{M}\p{M}+|\P{M}+(?!\p{M})|\p{M}+"), F.lit(0)),
            lambda c: F.when(F.length(c) > 1, F.coalesce(F.try_element_at(marks, c), c)).otherwise(c),
        )
        return F.when(one.rlike(r"\p{M}"), F.array_join(clusters, "")).otherwise(one)

    def composed_text(t: Column) -> Column:
        # the letters of Latin-1 are composed already
        plain = r"\x00-\x7F\xC0-\xFF"
        full = let(_in_runs(t, plain, lambda r: F.translate(_expand(r, several), source, target)), with_marks)
        return F.when(t.rlike(rf"[^{plain}]"), full).otherwise(t)

    return let(text, composed_text)


def canonical_key(text: Column) -> Column:
    """ASCII-folded, lower-case, runs of letters and digits joined by a blank."""
    return F.trim(F.regexp_replace(F.lower(nfkd_ascii(text)), "[^a-z0-9]+", " "))


def squish(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), f"[{dims.SPACE_CLASS}\\-\\x{{2010}}_|]", "")


def strip_bullets(text: Column) -> Column:
    """Bulleted lines become items joined by "; "."""
    mark = f"(?:[{_B}*]|-(?={WS}))"
    t = F.regexp_replace(text, rf"\n[ \t]*{mark}[ \t]*", "; ")
    t = F.regexp_replace(t, rf"^[ \t]*{mark}[ \t]*", "")
    t = F.regexp_replace(t, rf"[ \t]+[{_B}][ \t]+", "; ")
    t = F.regexp_replace(t, rf":{WS}*;{WS}*", ": ")
    return F.regexp_replace(t, rf"(;{WS}*)+", "; ")


def term_sort_key(term: Column) -> Column:
    """(unknown, year, season) of a term such as 'Fall 2025', '25-Fall' or 'F25'; unknown terms sort last."""
    t = F.lower(F.coalesce(term, F.lit("")))
    season = F.lit(None).cast("int")
    for rank, words in ((4, ("fall", "autumn")), (3, ("summer",)), (2, ("spring",)), (1, ("winter",))):
        for w in words:
            season = F.when(t.contains(w), F.lit(rank)).otherwise(season)
    full = F.regexp_extract(t, r"(20\d{2})", 1)
    short = F.regexp_extract(t, r"(^|[^\d])(\d{2})([^\d]|$)", 2)
    year = F.when(full != "", full.cast("int")).when(short != "", short.cast("int") + 2000)
    letter = F.regexp_extract(t, rf"(^|[^a-z])([wsuf]){WS}*-?{WS}*\d{{2}}", 2)
    by_letter = F.when(letter == "w", 1).when(letter == "s", 2).when(letter == "u", 3).when(letter == "f", 4)
    return F.struct(
        F.when(year.isNull(), 1).otherwise(0).alias("unknown"),
        F.coalesce(year, F.lit(0)).alias("year"),
        F.when(year.isNull(), 0).otherwise(F.coalesce(season, by_letter, F.lit(0))).alias("season"),
    )


def norm_question(text: Column) -> Column:
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"{WS}+", " ")
    return F.trim(F.regexp_replace(spaced, "[^a-z0-9 ]", ""))


def sentiment_from_score(score: Column) -> Column:
    return F.when(score <= 2, "negative").when(score >= 4, "positive").otherwise("neutral")


def credit_year_start(as_of: Column, month_day: str = dims.CREDIT_YEAR_START) -> Column:
    """Start date of the credit year that contains ``as_of``."""
    month, day = (int(p) for p in month_day.split("-"))
    this_year = F.make_date(F.year(as_of), F.lit(month), F.lit(day))
    return F.when(this_year <= as_of, this_year).otherwise(F.make_date(F.year(as_of) - 1, F.lit(month), F.lit(day)))


def clean_text(text: Column) -> Column:
    """Normalize, drop NUL, strip bullets, restore apostrophes, rejoin words cut at a line end, collapse blanks."""
    t = F.replace(nfkc(text), F.lit("\x00"), F.lit(""))
    t = F.replace(strip_bullets(t), F.lit("\ufffd"), F.lit("'"))
    # a letter joins once: the second of two cuts around it stays, hence the optional part
    return norm_whitespace(F.regexp_replace(t, "- (?<=[a-z]- )([a-z](?:- (?=[a-z]))?)", "$1"))


def prepare_text(text: Column) -> Column:
    """The form in which answers are compared and stored: bullets stripped, blanks collapsed."""
    return norm_whitespace(F.replace(strip_bullets(text), F.lit("\ufffd"), F.lit("'")))


def norm_typography(text: Column) -> Column:
    t = text
    for old, new in zip(dims.TYPOGRAPHY_FROM, dims.TYPOGRAPHY_TO):
        if new != " ":  # line ends become blanks below
            t = F.replace(t, F.lit(old), F.lit(new))
    return norm_whitespace(F.lower(t))


def truncate_text(text: Column, limit: int = 420) -> Column:

    def cut(t: Column) -> Column:
        short = F.concat(F.regexp_replace(F.substring(t, 1, limit - 3), f"{WS}+$", ""), F.lit("..."))
        return F.when(F.length(t) <= limit, t).otherwise(short)

    return let(norm_whitespace(text), cut)


def question_header(header: Column) -> Column:
    """Drop the export's ``Qn_`` prefix and repeated parts; parts are joined by a long dash."""

    def parts_of(h: Column) -> Column:
        parts = F.array_distinct(F.filter(F.transform(F.split(h, "_"), strip_space), lambda p: p != ""))
        return F.when(F.size(parts) > 0, F.array_join(parts, " \u2014 ")).otherwise(h)

    return let(F.regexp_replace(clean_text(header), r"^Q\d+_", ""), parts_of)


def course_term_parts(course_id: Column) -> Column:
    """(course, term) of ids such as ``BIO_10A_Fall2025``."""
    p = F.split(course_id, "_")
    full = F.size(p) >= 3
    return F.struct(
        F.when(full, F.concat_ws(" ", F.try_element_at(p, F.lit(1)), F.try_element_at(p, F.lit(2)))).otherwise(course_id).alias("course"),
        F.when(full, F.try_element_at(p, F.lit(3))).otherwise("Imported").alias("term"),
    )


def file_stem(name: Column) -> Column:
    """File name without directory and last suffix: the course id of an uploaded file."""
    return F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), r"(?<=.)\.[^.]*$", "")


def topic_summary(topic: Column, summary: Column) -> Column:
    """``Summary of X: text`` with the text after the last marker, on one line, without a closing note."""
    t = strip_space(F.replace(F.replace(summary, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")))
    marker = F.concat(F.lit(rf"(?i)Summary{WS}+of{WS}+\Q"), topic, F.lit(rf"\E{WS}*:"))
    t = strip_space(F.element_at(F.split(t, marker), -1))
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = strip_space(F.regexp_replace(t, rf"{WS}*\n{WS}*", " "))
    t = strip_space(F.regexp_replace(t, rf"(?i)\bNote:{WS}*.*$", ""))
    head = F.concat(F.lit("Summary of "), topic, F.lit(":"))
    return F.when(t != "", F.concat_ws(" ", head, t)).otherwise(head)


def theme_text(summary: Column, topic: Column) -> Column:
    """The written themes of a stored summary: count sentence, label and the Other sentence removed."""
    t = F.regexp_replace(F.coalesce(summary, F.lit("")), rf"(?i)^Summary of .*?(positive|neutral|negative)\.{WS}*", "")
    t = F.regexp_replace(t, F.concat(F.lit(r"(?i)^Summary of \Q"), topic, F.lit(rf"\E:{WS}*")), F.lit(""))
    t = F.regexp_replace(t, rf"(?i)^\d+ generic or uncategorized comments?; excluded from rubric averages\.{WS}*", "")
    return strip_space(t)


def score_band(score: Column, cuts: tuple[tuple[float, str], ...] = ((2.5, "low"), (3.75, "mid")), top: str = "high") -> Column:
    band = F.when(score.isNull(), "none")
    for limit, name in cuts:
        band = band.when(score < limit, name)
    return band.otherwise(top)


CLASSIC_BANDS = ((1.5, "red"), (3.0, "orange"), (4.0, "amber"))

EMPTY_VALUES = ["", "null", "none", "n/a", "na"]


def parse_score(value: Column) -> Column:
    """Text to a whole score 1 to 5: the first standalone digit 1-5, or null."""
    t = F.lower(strip_space(value))
    digit = F.regexp_extract(t, r"\b[1-5]\b", 0)
    return F.when(~t.isin(EMPTY_VALUES) & (digit != ""), digit.cast("int"))


def parse_score_number(value: Column) -> Column:
    """A number (not text) to a whole score: decimals cut off, clamped to 1-5 before the cast, so no number is too large.
    NaN and null are no score."""
    x = value.cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x), F.least(F.greatest(x, F.lit(1.0)), F.lit(5.0)).cast("int"))


def parse_confidence(value: Column) -> Column:
    """Text to 0-1: a percentage, else the first number; numbers above 1 are percentages; missing is 0."""
    t = F.lower(strip_space(F.coalesce(value, F.lit(""))))
    percent = F.regexp_extract(t, rf"(\d+(?:\.\d+)?){WS}*%", 1)
    number = F.regexp_extract(t, r"\d+(?:\.\d+)?", 0)
    x = number.try_cast("double")
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    return (
        F.when(t.isin(EMPTY_VALUES), 0.0)
        .when(percent != "", unit(percent.try_cast("double") / 100))
        .when(number != "", unit(F.when(x > 1, x / 100).otherwise(x)))
        .otherwise(0.0)
    )


def parse_confidence_number(value: Column) -> Column:
    x = value.cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.when(x > 1, x / 100).otherwise(x), F.lit(0.0))))


def truthy_label(value: Column) -> Column:
    return ~F.lower(strip_space(F.coalesce(value, F.lit("")))).isin("", "0", "false", "n", "nan", "no", "none")


def clamp_score_default(value: Column, default: int = 3) -> Column:
    """Whole number clamped to 1-5; anything else is the default."""
    t = strip_space(value)
    n = F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("decimal(38,0)"))
    return F.when(n.isNotNull(), F.least(F.greatest(n, F.lit(1)), F.lit(5)).cast("int")).otherwise(F.lit(default))


def integer_score_only(value: Column) -> Column:
    """Only whole numbers count as scores; the empty string of a written report is null, and so is a number beyond an int."""
    x = F.nullif(strip_space(value), F.lit("")).try_cast("double")
    return F.when(x % 1 == 0, x.try_cast("int"))


def round_half_even(score: Column) -> Column:
    from feedloom.functions.numbers import round2

    return round2(score)


def is_no_answer(text: Column) -> Column:
    return F.btrim(F.lower(text), F.lit(" !.")).isin(dims.NO_ANSWER)


# Every phrase holds one of these words, and a search for a fixed word is much faster than one for the alternation.
PHRASE_WORDS = ["respon", "report", "students enrolled", "created ", " audience", "sections", "invited count", "please find your", "question header", "question personal", "statistics value"]
PHRASE_PATTERN = "|".join(re.escape(p).replace("\\ ", " ") for p in dims.NOISE_PHRASES)
NOISE_PATTERN = "|".join(f"(?:{p})" for p in dims.NOISE_PATTERNS)
# Words of a printed scale are taken out one after the other: a repeated group over a long line would exhaust Java's stack.
# "n/a" and "na" are passed over where they begin "n/agree" or "n about right", so that the rest can still be read as words.
SCALE_PATTERN = "|".join([w + "(?!gree|bout right)" if w in ("n/a", "na") else w for w in dims.NOISE_SCALE_WORDS] + [WS, "/"])
# ``squish(text)`` is one of the noise words, told from the start of the text on: letters with nothing but removed characters between.
_LOOSE = rf"[{dims.SPACE_CLASS}\-\x{{2010}}_|]*"
NOISE_WORD_PATTERN = f"^{_LOOSE}(?:" + "|".join("".join(c + _LOOSE for c in w) for w in dims.NOISE_WORDS if w.isalpha()) + ")$"
ANCHORED_PATTERN = "^(?:" + "|".join(f"(?:{p})" for p in dims.NOISE_PATTERNS if p.startswith("^")) + ")"
# Patterns without an anchor, and what a text that matches one must hold; the text is trimmed, so "$" is its end.
FREE_PATTERNS = [(next(w for w in ("page ", "n=", "%") if w in p), p) for p in dims.NOISE_PATTERNS if not p.startswith("^")]


def is_noise(text: Column) -> Column:
    """Headers, scale legends, page numbers and rating rows. One alternation per rule family, all in the JVM."""

    def noise(t: Column) -> Column:
        # nothing is left over only if the text starts with a scale word; few lines do
        found = (t == "") | (t == "nan") | t.rlike(NOISE_WORD_PATTERN) | t.rlike(ANCHORED_PATTERN)
        found |= t.rlike(f"^(?:{SCALE_PATTERN})") & (F.regexp_replace(t, SCALE_PATTERN, "") == "")
        for part, pattern in FREE_PATTERNS:
            found |= t.contains(part) & t.rlike(pattern)
        return found | (reduce(or_, [t.contains(w) for w in PHRASE_WORDS]) & t.rlike(PHRASE_PATTERN))

    return let(F.lower(strip_space(text)), noise)


PROMPT_START = rf"(?i)^(\d+\.\s+)?please ({dims.PROMPT_VERBS})\b"
QUESTION_START = rf"(?i)^(\d+\.\s+|q\d+[_.:]?\s*)?({dims.PROMPT_WORDS})\b"
LIMIT_NOTE = r"(?i)\s*\((maximum|max\.?)[^)]*\)$"
PROMPT_END = r"(:|: -|:-|\?| -)$"
NUMBERED = r"^\d+\.\s+\S"


def is_question(text: Column) -> Column:
    """Survey prompts: a request of some length, or a question opening that ends like a prompt."""

    def prompt(s: Column) -> Column:
        opens = s.rlike(QUESTION_START)
        ends = s.rlike(PROMPT_END)
        numbered = s.rlike(NUMBERED) & opens & (ends | s.endswith(".") | s.contains("?"))
        return (F.length(s) <= 400) & (
            (s.rlike(PROMPT_START) & (F.length(s) > 40)) | numbered | (ends & (opens | s.endswith(": -")))
        )

    return let(let(strip_space(text), lambda t: F.when(t.endswith(")"), F.regexp_replace(t, LIMIT_NOTE, "")).otherwise(t)), prompt)


def is_numbered_item(text: Column) -> Column:
    return let(text, lambda t: strip_space(t).rlike(NUMBERED) & ~is_question(t))


def ends_sentence(text: Column) -> Column:
    return F.substring(strip_space(text), -1, 1).isin(list(".!?)\"\u201d'"))


def scale_key(label: Column) -> Column:
    return F.trim(F.replace(F.regexp_replace(F.lower(label), f"[{dims.SPACE_CLASS}\\-]+", " "), F.lit("improve ment"), F.lit("improvement")))


def scale_value(label: Column) -> Column:
    """Scale label to 1-5, or null: a lookup in a fixed table of 14 words."""
    words = F.create_map(*[F.lit(x) for pair in dims.SCALE_WORDS.items() for x in pair])
    return F.try_element_at(words, scale_key(label))


def is_rating_section(text: Column) -> Column:
    holds = lambda t: reduce(or_, [t.contains(p) for p in dims.RATING_SECTION.split("|")])
    return let(F.lower(text), holds) & text.rlike(f"(?i){dims.RATING_SECTION}")


def starts_lower(text: Column) -> Column:
    return F.substring(text, 1, 1).rlike(r"^\p{Ll}")


def word_count(text: Column) -> Column:
    """Number of words between white space."""
    return F.size(F.filter(F.split(text, f"{WS}+"), lambda w: w != ""))


def extract_json_object(text: Column) -> Column:
    """From the first ``{`` to the last ``}``, if that parses as JSON; else null."""
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when((body != "") & F.try_parse_json(body).isNotNull(), body)


def request_key(*parts: Column) -> Column:
    """SHA-256 over the JSON of all request parts."""
    named = F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])
    return F.sha2(F.to_json(named, {"ignoreNullFields": "false"}), 256)


def english_ratio(rows: DataFrame, dictionary: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """Add ``english_ratio``: the share of words of 3 and more letters that the dictionary (column ``word``) has.

    Texts that are mostly symbols score 0. The join is an ordinary hash join, which Spark broadcasts only when the
    dictionary's size allows; otherwise AQE splits the partitions of common words. Hits are counted map-side per text.
    """
    visible = F.regexp_replace(F.col(text), f"{WS}+", "")
    letters = F.length(F.regexp_replace(visible, r"[^\p{L}]+", ""))
    words = F.transform(
        F.filter(F.regexp_extract_all(F.col(text), F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.length(w) >= 3), F.lower
    )
    exploded = rows.select(id_col, F.explode(words).alias("word"))
    known = dictionary.select("word").distinct().withColumn("_known", F.lit(True))
    share = (
        exploded.join(known, "word", "left")
        .groupBy(id_col)
        .agg((F.count("_known") / F.count("*")).alias("_share"))
    )
    symbols = (F.length(visible) > 0) & (letters / F.length(visible) < 0.6)
    return (
        rows.join(share, id_col, "left")
        .withColumn(
            "english_ratio",
            F.when(symbols, 0.0)
            .when(F.col("_share").isNull(), F.when(F.length(visible) <= 3, 1.0).otherwise(0.0))
            .otherwise(F.col("_share")),
        )
        .drop("_share")
    )


def is_garbage(ratio: Column) -> Column:
    return ratio < 0.6


def short_topic(rows: DataFrame, names: DataFrame, topic: str = "topic") -> DataFrame:
    """Display name of a topic (the name itself when there is none); ``names`` is the 13-row topic dimension."""
    lookup = F.broadcast(names.select(F.col("topic").alias("_t"), F.col("short_name").alias("_s")))
    return rows.join(lookup, F.col(topic) == F.col("_t"), "left").withColumn("short_topic", F.coalesce("_s", topic)).drop("_t", "_s")
