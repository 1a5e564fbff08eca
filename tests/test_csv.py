"""Records of CSV files that are split anywhere, in two encodings."""

import csv
import io
import random

import pytest

from feedloom.sources import files


def _written(rows, encoding, end):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(rows)
    return out.getvalue().encode(encoding)


@pytest.mark.parametrize("split", ["128m", "100"])
def test_records_of_split_files(spark, tmp_path, split):
    rng = random.Random(4)
    cells = ["plain", 'say ""hi""', "two\nlines", "a, b", "é ü", '"\n\n"', "tail\r\nwin", " spaced "]
    tables = {}
    for name, encoding, end in (("a.csv", "utf-8", "\n"), ("b.csv", "latin-1", "\r\n"), ("c.csv", "utf-8-sig", "\n")):
        rows = [["id", "text", "more"]] + [[str(i), rng.choice(cells), rng.choice(cells)] for i in range(60)]
        (tmp_path / name).write_bytes(_written(rows, encoding, end).replace(b"\n30,", b"\n\n30,"))
        tables[name] = rows
    (tmp_path / "d.csv").write_text("id,text,more\n1,x\n2,x,y,z\n3,x,y\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = files.read_csv_survey(spark, str(tmp_path)).collect()
        grid = files.read_csv_grid(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for name, want in tables.items():
        own = {r["id"]: (r["text"], r["more"]) for r in rows if r["file"].endswith(name)}
        assert own == {i: (a, b) for i, a, b in want[1:]}
        table = {(r["row_no"], r["col"]): r["text"] for r in grid if r["file"].endswith(name)}
        assert table == {(i, j): x for i, line in enumerate(want) for j, x in enumerate(line)}
    assert [(r["id"], r["text"], r["more"]) for r in rows if r["file"].endswith("d.csv")] == [("1", "x", None), ("3", "x", "y")]


def test_lines_are_numbered_without_a_window_over_them(spark, tmp_path):
    """What a line needs of those before it is counted while its split is read; only a row per split is windowed."""
    import re

    (tmp_path / "a.csv").write_text("id,text\n" + "".join(f'{i},"a\nb"\n{i},c\n' for i in range(50)))
    plan = files._records(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition" in plan and not re.search(r"windowspecdefinition\([^)]*_id#", plan)
