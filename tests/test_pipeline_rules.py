"""Report rules on small inputs of our own, with figures worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from feedloom import dims
from feedloom.functions import text as tx
from feedloom.operators import extract as ex
from feedloom.operators import lines as ln
from feedloom.operators import ordered, prepare
from feedloom.plans import compare, evaluate, report, scoring, usage
from feedloom.plans import report_views as rv
from feedloom.sources import files


CUES = [(4, ["workshop"], None), (2, ["gallop"], "too_fast"), (2, ["crawl"], "too_slow")]
MOODS = {"positive": ["joy", "splendid"], "negative": ["gloom", "dreary"], "unsure": ["possibly"], "unreadable": ["####"]}


def analysed(spark, texts, cues=CUES):
    c = spark.createDataFrame([("Z9", i, t, None, False) for i, t in enumerate(texts)], "course string, ord bigint, text string, question string, non_teaching boolean")
    items = prepare.dedupe_comments(prepare.unify_inputs(c, ["course"]), ["course"])
    return scoring.parse_replies(scoring.score_comments(items, cues, **MOODS))


def test_scores_and_overall(spark):
    parsed = analysed(spark, ["A splendid workshop, pure joy", "The dreary term went at a gallop", "At a crawl, yet a workshop of joy", "Gallop, gloom and dreary days"])
    rows = scoring.topic_rows(parsed, ["course", "ord", F.col("text").alias("feedback")])
    ok = report.passed(rows, dims.topics(spark))
    averages = {r["topic_no"]: r["average_score"] for r in report.topic_average(ok, ["course"]).collect()}
    assert averages == {4: 4.5, 2: 2.33}  # workshop 5, 4; pace 2, 4, 1
    o = report.overall_score(ok, ["course"]).first()
    assert (o["overall_score"], o["scored_comments"]) == (3.0, 4)
    pace = report.pace_directions(ok, ["course"]).first()
    assert (pace["too_fast"], pace["too_slow"], pace["total"]) == (2, 1, 3)


def test_errors_gate_and_generic_comments(spark):
    texts = ["#### torn page", "possibly a joy of a workshop", "Splendid days of joy", "The workshop was a joy", "No opinion here"]
    parsed = analysed(spark, texts)
    a = {r["text"]: r for r in scoring.assess(parsed).collect()}
    assert a[texts[0]]["status"] == "model_error"
    assert (a[texts[1]]["n_low"], a[texts[1]]["n_passed"]) == (1, 0)
    other = {r["text"]: r for r in report.route_other(scoring.assess(parsed)).collect()}
    assert set(other) == {texts[0], texts[1], texts[2], texts[4]}
    assert other[texts[0]]["scoring_status"] == "classification_error"
    assert other[texts[2]]["general_score"] == 5 and other[texts[4]]["general_score"] is None
    assert {r["text"]: r["n_passed"] for r in scoring.assess(parsed, gate=False).collect()}[texts[1]] == 1


def test_replies_tolerate_anything(spark):
    odd = [
        '{"topics": [null, [], "Workload", {"topic": "\\tWorkload ", "score": "roughly 2", "confidence": "61 %"}, {"topic": "Workload", "score": 5}, {"topic": "Gardening", "score": 1}], "general_sentiment_score": 4}',
        '{"topics": 7, "general_sentiment_score": "1 star"}',
        '"only text"',
        'well {"topics": []} then',
        None,
        '{"topics": [{"topic": "Assessment", "score": 99999999999999999999}, {"topic": "Pace", "score": -1e300, "direction": "sideways"}, {"topic": "Workload", "score": [[{}]]}]}',
    ]
    rows = spark.createDataFrame(list(enumerate(odd)), "ord bigint, reply_json string")
    got = {r["ord"]: r for r in scoring.parse_replies(rows).collect()}
    first = got[0]["results"]
    assert [(r["topic_no"], r["score"], r["confidence"], r["sentiment"]) for r in first] == [(3, 2, 0.61, "negative")]
    assert got[0]["general_score"] is None and got[1]["general_score"] == 1
    assert [got[i]["status"] for i in range(5)] == ["classified", "classified", "model_error", "classified", "model_error"]
    assert [(r["topic_no"], r["score"], r["direction"]) for r in got[5]["results"]] == [(10, 5, None), (2, 1, None), (3, None, None)]


def test_plug_in_scorer(spark):
    c = spark.createDataFrame([(1, "ab"), (2, "c")], "ord bigint, text string")
    out = scoring.score_with(c, lambda texts: [json.dumps({"topics": [], "general_sentiment_score": len(t)}) for t in texts])
    assert {r["ord"]: r["general_score"] for r in scoring.parse_replies(out).collect()} == {1: 2, 2: 1}


def test_duplicates_after_cleaning(spark):
    c = spark.createDataFrame([("k", i, t) for i, t in enumerate(["warm   room", "", "warm room", "cold room", "\ufffd warm room", "cold room"])], "course string, ord bigint, text string")
    items = prepare.unify_inputs(c, ["course"])
    assert [r["text"] for r in prepare.dedupe_comments(items, ["course"]).orderBy("ord").collect()] == ["warm room", "cold room"]
    d = prepare.duplicate_counts(items, ["course"], c).first()
    assert (d["input_comments"], d["processed_comments"], d["duplicates_removed"]) == (6, 2, 3)


def test_grid_of_ratings_and_answers(spark):
    rows = [
        ["CHM 77 (03): Woodcuts", None, None, None],
        [None, "Excellent", "Fair", "Poor"],
        ["Studio light and tools:", "25% (2)", "50% (4)", "25% (2)"],
        ["Please say in your own words what the studio should change: -", None, None, None],
        [None, "Two more presses would help and", None, None],
        [None, "the sink leaks.", None, None],
        [None, "Ink dried before we could print.", None, None],
    ]
    cells = spark.createDataFrame([("w", r, c, t) for r, row in enumerate(rows) for c, t in enumerate(row) if t], "sheet string, row_no bigint, col int, text string")
    grid = ex.scale_header_rows(ex.grid_rows(cells, ["sheet"]), ["sheet"])
    rating = ex.percent_rows(grid, ["sheet"]).first()
    assert rating["distribution"] == {"Excellent": 2, "Fair": 4, "Poor": 2} and rating["mean"] == 3.25  # (2 * 5 + 4 * 3 + 2 * 2) / 8
    text_rows = grid.filter(F.col("kind") == "text").select("row_no")
    lines = cells.join(text_rows, "row_no").select(F.col("sheet").alias("doc_id"), F.col("col").cast("bigint").alias("col"), F.col("row_no").alias("pos"), "text")
    answers = ln.keep_response(ln.assign_question(ln.segment_lines(lines))).orderBy("pos").collect()
    assert [r["text"] for r in answers] == ["Two more presses would help and the sink leaks.", "Ink dried before we could print."]
    assert all(r["question"].startswith("Please say in your own words") for r in answers)


def test_question_reference_and_sections(spark):
    """Two blocks of a row share a position: order goes on by column, and nothing comes out twice."""
    cells = [
        (0, 0, "4. Did the field trips suit you, all in all?"), (1, 0, "8. Did the harbour walk suit you, all in all?"),
        (2, 0, "Please go back to your answer to question 8 and give reasons for it:"), (2, 1, "The harbour was closed that day."),
        (3, 0, "Please go back to your answer to question 4 and give reasons for it:"), (3, 1, "Please go back to your answer to question 8 and give reasons for it:"),
        (4, 0, "Boats were late."), (5, 0, "Background Information"), (6, 0, "tiny label"), (7, 0, "2. The guide was on time."), (8, 0, "Words without any question above."),
    ]
    b = spark.createDataFrame([("t", p, c, x) for p, c, x in cells], "doc_id string, pos bigint, col bigint, text string")
    got = ln.assign_question(b).collect()
    assert sorted(r["text"] for r in got) == ["Boats were late.", "The harbour was closed that day."]
    assert all("(Question 8. Did the harbour walk" in r["question"] for r in got)


def sequential_blocks(spark, texts):
    """The rule applied line by line, with the predicates taken from the column functions."""

    def flags(items):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "i int, t string")
        t = F.col("t")
        rows = df.select("i", tx.is_noise(t), tx.is_question(t), tx.is_rating_section(t), tx.ends_sentence(t), tx.starts_lower(t)).orderBy("i").collect()
        return [tuple(r)[1:] for r in rows]

    line = flags(texts)
    blocks = [texts[0]]
    for t, (n, q, r, _, low) in zip(texts[1:], line[1:]):
        bn, bq, _, be, _ = flags([blocks[-1]])[0]
        if not (n or bn or q or r or bq) and (low or not be):
            blocks[-1] += " " + t
        else:
            blocks.append(t)
    return blocks


@pytest.mark.parametrize("size", [100_000, 3, 1])
def test_segmentation_equals_the_sequential_rule(spark, monkeypatch, size):
    """Joined text that becomes a prompt stops growing; block borders do not matter."""
    texts = ["What would you", "keep of it:", "the kiln", "and the glaze.", "Page 4 of 6", "still wet", "Fair", "fired twice", "then cracked", "at the rim.", "Once more", "Comments", ": -", "cold now"]
    monkeypatch.setattr(ln, "block_of", lambda c, s=size: ordered.block_of(c, size))
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "doc_id string, pos bigint, text string")
    got = [r["text"] for r in ln.segment_lines(df, ["doc_id"]).orderBy("pos").collect()]
    assert got == sequential_blocks(spark, texts)


@pytest.mark.parametrize("size", [100_000, 2])
def test_paragraphs_across_pages(spark, monkeypatch, size):
    monkeypatch.setattr(ln, "block_of", lambda c, s=size: ordered.block_of(c, size))
    rows = [(0, 1, "We dug up a wall of"), (1, 1, "painted plaster."), (2, 1, "rain set in"), (3, 2, "second trench"), (4, 0, "7. What helped (tents,"), (5, 3, "maps, soup)?"), (6, 1, "Dry")]
    df = spark.createDataFrame([("d", p, c, t) for p, c, t in rows], "doc_id string, pos bigint, col bigint, text string")
    got = [r["text"] for r in ln.merge_paragraphs(df).orderBy("pos").collect()]
    assert got[0] == "We dug up a wall of painted plaster." and "rain set in" in got and "second trench" in got


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_blocked_windows_equal_plain_windows(spark, size):
    rows = [(k, i, (i * 7 + k) % 5 if (i + k) % 3 else None) for k in range(3) for i in range(0, 40, 1 + k)]
    df = spark.createDataFrame(rows, "k int, i bigint, v bigint")
    block = ordered.block_of(F.col("i"), size)
    sums = {(r["k"], r["i"]): r["s"] for r in ordered.running_sum(df, ["k"], ["i"], F.coalesce("v", F.lit(0)), block, "s").collect()}
    last = {(r["k"], r["i"]): r["c"] for r in ordered.carry_forward(df, ["k"], ["i"], {"c": F.col("v")}, block).collect()}
    prev = {(r["k"], r["i"]): r["p"] for r in ordered.previous(df, ["k"], ["i"], F.col("i"), block, "p").collect()}
    for k in range(3):
        total, seen, before = 0, None, None
        for _, i, v in [r for r in rows if r[0] == k]:
            total, seen = total + (v or 0), v if v is not None else seen
            assert (sums[k, i], last[k, i], prev[k, i]) == (total, seen, before)
            before = i


@pytest.mark.parametrize("chunk", [3, 500])
def test_nested_report_has_one_form(spark, chunk):
    """Figures once per report and every comment once, however small the chunks are."""
    rows = spark.createDataFrame([("c", i, f"t{i}", 1 + i % 2, 3, 0.9, None, "scored") for i in range(25)], "course string, ord bigint, feedback string, topic_no int, score int, confidence double, direction string, scoring_status string")
    docs = report.nested_report(rows, dims.topics(spark), ["course"], chunk_rows=chunk)
    got = {r["chunk"]: json.loads(r["report_json"]) for r in docs.collect()}
    assert sorted(got) == list(range(-(-25 // chunk) + 1))
    assert [c["feedback"] for k in sorted(got) if k for c in got[k]["comments"]] == [f"t{i}" for i in range(25)]
    assert len(got[0]["categories"]) == 13 and got[0]["metadata"]["processed_comments"] == 25
    assert all(len(got[k]["comments"]) <= chunk and "categories" not in got[k] for k in got if k)
    topics = files.report_topics(files.parse_reports(docs.select("report_json")), ["course_id"]).collect()
    assert len(topics) == len({r["topic"] for r in topics}) == 12


def doc(overall, topics, version=dims.PROMPT_VERSION, ratings=()):
    cats = [{"topic": t, "average_score": a, "scored_comment_count": n, "comments": []} for t, (a, n) in topics.items()]
    return json.dumps({"overall_score": overall, "categories": [*cats, {"topic": ["odd"]}, "not a category"], "quantitative": [*ratings, "not a table", {"question": {"x": 1}, "mean": 3}], "metadata": {"prompt_version": version}})


def test_comparison_of_stored_reports(spark):
    later = doc(2.9, {"Assessment": (4.5, 20), "Workload": (2.25, 6), "Pace": (1.5, 4)}, ratings=[{"question": "Food", "mean": 2.5, "n": 30}])
    sooner = doc(3.1, {"Assessment": (4.25, 8), "Workload": (3.5, 5), "Pace": (5.0, 40)}, ratings=[{"question": " Food", "mean": 3.25, "n": 12}])
    r = spark.createDataFrame([(7, "h", "D", "Winter 2031", later), (9, "h", "D", "Summer 2030", sooner)], "id bigint, g string, course string, term string, report_json string").withColumn("created_at", F.lit(None).cast("timestamp"))
    parsed = compare.order_by_term(files.parse_reports(r).drop("course_id"), ["g"])
    assert {x["term"]: x["pos"] for x in parsed.collect()} == {"Summer 2030": 1, "Winter 2031": 2}
    names = dims.topics(spark).select("topic_no", "topic")
    topics = files.report_topics(parsed, ["g", "pos"]).join(names, "topic")
    changes = compare.topic_change(topics, ["g"])
    got = {x["topic_no"]: (x["change"], x["change_is_reliable"]) for x in changes.collect()}
    assert got == {10: (0.25, True), 3: (-1.25, True), 2: (-3.5, False)}
    top = compare.improved_declined(changes, ["g"]).collect()
    assert [(x["direction"], x["topic_no"], x["change"]) for x in top] == [("declined", 3, -1.25)]
    ratings = compare.rating_changes(files.report_ratings(parsed, ["g", "pos"]), ["g"], [1, 2]).first()
    assert (ratings["r1"], ratings["r2"], ratings["change"]) == (3.25, 2.5, -0.75)
    assert compare.overall_change(parsed, ["g"]).first()["overall_change"] == -0.2


def test_stored_report_checks(spark):
    good = doc(3.0, {"Pace": (3.0, 6)})
    docs = [json.dumps({"categories": [{"topic": "Pace", "comments": []}]}), good, "{}", json.dumps({"categories": [{"topic": f"T{i}"} for i in range(250)]}),
            json.dumps({"categories": [{"topic": "P", "comments": [1] * 20_001}]}), json.dumps({"categories": [], "notes": "x" * 5_000_001}), '{"overall_score": NaN, "categories": []}']
    df = spark.createDataFrame(list(enumerate(docs)), "i int, report_json string")
    got = [r["reasons"] for r in rv.check_report_json(df).orderBy("i").collect()]
    assert got[0] == [] and got[1] == ["not a report"] and got[2] == ["not a report"]
    assert got[3] == ["too many topics"] and got[4] == ["too many comments"] and got[5] == ["too large"] and got[6] == ["not a report"]


def test_usage(spark):
    log = spark.createDataFrame([(1, 1, "2026-03-01", False, 3.0), (2, 1, "2026-03-02", False, 2.0), (3, 2, "2026-03-02", False, 1.0), (4, 2, "2026-03-03", True, 9.0), (5, 2, "2025-12-31", False, 50.0)],
                                "id bigint, user_id bigint, d string, used_own_key boolean, cost_usd double")
    log = log.withColumn("created_at", F.col("d").cast("timestamp_ntz")).withColumn("input_tokens", F.lit(10)).withColumn("output_tokens", F.lit(1))
    b = usage.budget_summary(log, "2026-11-01", 1000.0).first()
    assert (b["total_usd"], b["budget_remaining_usd"]) == (6.0, 994.0)
    users = spark.createDataFrame([(1, "a", "our_key_capped", 5.0), (2, "b", "our_key_capped", None), (3, "c", "own_key", None)], "id bigint, name string, credit_mode string, yearly_cap_usd double")
    assert [r["user_id"] for r in usage.cap_exceeded(users, log, "2026-11-01").collect()] == [1]
    assert sorted(r["user_id"] for r in usage.cap_exceeded(users, log, "2026-11-01", budget=6.0).collect()) == [1, 2]


def test_csv_reading(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('id,q\n1,"two\nlines, one ""cell"""\n2\n3,x,too,many\n4,café\n'.encode())
    (tmp_path / "b.csv").write_bytes("id,q\n5,café\n".encode("latin-1"))
    got = {r["id"]: r["q"] for r in files.read_csv_survey(spark, str(tmp_path)).collect()}
    assert got == {"1": 'two\nlines, one "cell"', "2": None, "4": "café", "5": "café"}


def test_evaluation_of_small_sets(spark):
    g = spark.createDataFrame([(1, 2), (1, 5), (2, 13)], "ord bigint, topic_no int")
    p = spark.createDataFrame([(1, 2), (2, 13), (2, 3), (9, 1)], "ord bigint, topic_no int")
    m = evaluate.topic_f1(g, p).first()
    assert (m["comments"], m["micro_precision"], m["micro_recall"], m["micro_f1"], m["exact_match"]) == (2, 0.667, 0.667, 0.667, 0.0)


def test_a_repeated_text_shows_its_last_score(spark):
    from feedloom.plans import report_views as rv

    rows = [("r", 1, "same", 4, 5, False, "Q1", None), ("r", 2, "same", 4, None, False, "Q2", 3), ("r", 3, "same", 4, 2, True, "Q3", 4), ("r", 4, "same", 13, None, False, "Q4", 1), ("r", 9, "other", 13, None, False, None, 4)]
    df = spark.createDataFrame(rows, "k string, ord long, feedback string, topic_no int, score int, ignored boolean, question string, general_score int")
    got = {r["feedback"]: r for r in rv.comment_view(df, ["k"]).collect()}
    assert got["same"]["scores"] == {4: 2} and got["same"]["question"] == "Q1" and got["same"]["idx"] == 1
    assert got["other"]["scores"] == {} and got["other"]["general_score"] == 4
