import pytest
from pyspark.sql import functions as F

from causeway.functions import scalars as S
from causeway.operators import panel
from causeway.sources import files
from causeway.streaming import incremental

HEAD = ",".join(panel.SHEET.values())


def sheet(folder, name, rows):
    """rows: (state, id, built, deck, super, sub, culvert, adt)."""
    lines = [HEAD]
    for st, sid, built, deck, up, sub, cul, adt in rows:
        v = dict.fromkeys(panel.SHEET, "")
        v |= {"state_code": st, "structure_id": f" {sid} ", "year_built": built, "deck": deck, "super": up, "sub": sub, "culvert": cul, "adt": adt}
        lines.append(",".join(v.values()))
    (folder / name).write_text("\n".join(lines))
    return str(folder / name)


def test_states_of_ratings(spark):
    df = spark.createDataFrame([(9.0, 0), (7.0, 0), (6.0, 1), (5.0, 1), (4.0, 2), (3.0, 2), (2.0, 3), (0.0, 3), (None, None), (float("nan"), None)], "r double, s int")
    assert df.where(~S.rating_state(F.col("r")).eqNullSafe(F.col("s"))).count() == 0


def test_numbers_of_text(spark):
    df = spark.createDataFrame([(" 8 ", 8.0), ("N", None), ("na", None), ("", None), ("N/A", None), ("NaN", None), ("x", None)], "t string, v double")
    assert df.where(~S.number(F.col("t")).eqNullSafe(F.col("v"))).count() == 0


def test_lowest_rating_counts_and_unrated_rows_go(spark, tmp_path):
    p = files.sheet_to_panel(spark, sheet(tmp_path, "XX20.txt", [("01", "B1", "2000", "8", "5", "9", "N", "10"), ("01", "B2", "1990", "N", "N", "N", "N", "")]), 2020)
    rows = p.collect()
    assert len(rows) == 1 and rows[0]["state4"] == 1 == rows[0]["rating"] and rows[0]["age"] == 20 and rows[0]["key"] == "01|B1"


def test_folder_pairs_and_gaps(spark, tmp_path):
    sheet(tmp_path, "XX19.txt", [("01", "B1", "2000", "8", "8", "8", "N", ""), ("01", "B2", "2000", "6", "6", "6", "N", "")])
    sheet(tmp_path, "XX20.txt", [("01", "B1", "2000", "6", "6", "6", "N", ""), ("01", "B2", "2000", "4", "4", "4", "N", "")])
    sheet(tmp_path, "XX22.txt", [("01", "B1", "2000", "4", "4", "4", "N", "")])
    (tmp_path / "notes.txt").write_text("no sheet")
    pairs = panel.next_year_pairs(files.load_sheets(spark, str(tmp_path)))
    got = {(r["structure_id"], r["year"]): (r["state4"], r["y_next"]) for r in pairs.collect()}
    assert got == {("B1", 2019): (0, 1), ("B2", 2019): (1, 2)}
    with pytest.raises(FileNotFoundError):
        files.load_sheets(spark, str(tmp_path / "notes.txt"))


def test_features_have_no_nulls(spark, tmp_path):
    p = files.sheet_to_panel(spark, sheet(tmp_path, "XX20.txt", [("01", "B1", "2000", "8", "5", "9", "N", "")]), 2020)
    out = panel.imputed(p, panel.FEATURES).select(panel.FEATURES).collect()[0]
    assert all(v is not None for v in out) and out["adt"] == 0.0
    with pytest.raises(KeyError):
        panel.panel_of(spark.createDataFrame([("x", 2020)], "OTHER string, year int"))


def test_split_needs_both_sides(spark):
    df = spark.createDataFrame([(2019,), (2021,)], "year int")
    assert [x.count() for x in panel.split_by_year(df, 2020, 2021)] == [1, 1]
    with pytest.raises(ValueError):
        panel.split_by_year(df, 2020, 2030)


def test_sheets_as_a_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    out, state = str(tmp_path / "panel"), str(tmp_path / "state")
    sheet(folder, "XX19.txt", [("01", "B1", "2000", "8", "8", "8", "N", "")])
    incremental.append_panel(incremental.sheet_stream(spark, str(folder)), out, state).awaitTermination(120)
    assert spark.read.parquet(out).count() == 1
    sheet(folder, "XX20.txt", [("01", "B1", "2000", "6", "6", "6", "N", ""), ("01", "B2", "2000", "N", "N", "N", "N", "")])
    incremental.append_panel(incremental.sheet_stream(spark, str(folder)), out, state).awaitTermination(120)
    assert {(r["year"], r["state4"]): r["n"] for r in incremental.state_counts(spark.read.parquet(out)).collect()} == {(2019, 0): 1, (2020, 1): 1}


def test_sheets_of_500_headers_are_one_scan(spark, tmp_path):
    names = [panel.SHEET[c] for c in ("state_code", "structure_id", "deck", "super", "sub", "culvert", "adt")]
    for k in range(500):
        turn = k % len(names)
        head = [*names[turn:], *(f'"EXTRA,{j}"' for j in range(k)), *names[:turn]]
        cells = dict(zip(names, ["01", f"B{k}", "8", "6", "7", "N", str(k)], strict=True))
        rows = [",".join(cells.get(h, '"a, b"') for h in head), "", "x"]
        (tmp_path / f"S{k:03}-{k % 20:02}.txt").write_text("\n".join([",".join(head), *rows]))
    (tmp_path / "empty-01.txt").write_text("")
    p = files.load_sheets(spark, str(tmp_path))
    got = {r["key"]: (r["year"], r["state4"], r["adt"], r["age"], r["material"]) for r in p.collect()}
    assert got == {f"01|B{k}": (2000 + k % 20, 1, float(k), None, None) for k in range(500)}
    plan = p._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [value") == 1 and "Union" not in plan


def test_headers_repeat_names_and_may_be_missing(spark, tmp_path):
    head = f"{panel.SHEET['state_code']},{panel.SHEET['deck']},{panel.SHEET['structure_id']},{panel.SHEET['deck']},{panel.SHEET['super']},{panel.SHEET['sub']},{panel.SHEET['culvert']}"
    (tmp_path / "XX20.txt").write_text(f'{head}\n01,8,"B,1",2,9,9,N\n{head}\n01,3,B2,9,9,9,N,more,cells\n')
    got = {r["structure_id"]: r["state4"] for r in files.load_sheets(spark, str(tmp_path)).collect()}
    assert got == {"B,1": 0, "B2": 2}
    (tmp_path / "YY20.txt").write_text("A,B\n1,2\n")
    with pytest.raises(Exception, match="structures' numbers"):
        files.load_sheets(spark, str(tmp_path)).collect()
    (tmp_path / "XX20.txt").unlink()
    with pytest.raises(KeyError):
        files.load_sheets(spark, str(tmp_path))
