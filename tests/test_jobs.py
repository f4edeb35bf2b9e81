"""The jobs over growing input: what is new is taken once, and reruns change nothing."""

import json
import logging
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import common, inspection_panel, report_intake

ROOT = Path(__file__).resolve().parent.parent


def rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def logged(caplog):
    return [r.getMessage() for r in caplog.records if r.name.startswith("jobs.")]


@pytest.fixture
def orders(spark, sf_dir, tmp_path):
    """A table's folder, and a function that adds some of the years to it as a file."""
    table = spark.read.parquet(f"{sf_dir}/orders.parquet")

    def add(condition, n=1):
        part = tmp_path / "parts"
        table.where(condition).coalesce(n).write.mode("overwrite").parquet(str(part))
        (tmp_path / "tables/orders.parquet").mkdir(parents=True, exist_ok=True)
        for f in part.glob("*.parquet"):
            shutil.copy(f, tmp_path / "tables/orders.parquet")

    return str(tmp_path / "tables"), add


def whole(spark, job, tables, tmp_path):
    """What one run over all input gives."""
    job.run(spark, tables, str(tmp_path / "at_once"))
    return rows(job.output(spark, str(tmp_path / "at_once")))


def test_panel_grows_with_its_input(spark, orders, tmp_path, caplog):
    tables, add = orders
    out = str(tmp_path / "out")
    caplog.set_level(logging.INFO)
    add("year(o_orderdate) <= 1997")
    inspection_panel.run(spark, tables, out)
    first = rows(inspection_panel.output(spark, out))
    assert any("batch 0 read 679 inspections, left out 0" in m for m in logged(caplog))
    caplog.clear()
    inspection_panel.run(spark, tables, out)
    assert rows(inspection_panel.output(spark, out)) == first  # nothing new
    assert logged(caplog) == [f"read what was new of {tables}/orders.parquet in 0 batches"]
    old = {p: p.stat().st_mtime_ns for p in Path(out, "panel/year=1995").iterdir()}
    add("year(o_orderdate) > 1997")
    add("year(o_orderdate) = 1997 AND o_orderkey % 2 = 0")  # late and again: these structures are already there
    caplog.clear()
    inspection_panel.run(spark, tables, out)
    assert rows(inspection_panel.output(spark, out)) == whole(spark, inspection_panel, tables, tmp_path) != first
    assert {p: p.stat().st_mtime_ns for p in Path(out, "panel/year=1995").iterdir()} == old  # years without news stay as they are
    n = spark.read.parquet(f"{tables}/orders.parquet").where("year(o_orderdate) > 1997").count() + spark.read.parquet(f"{tables}/orders.parquet").where("year(o_orderdate) = 1997").count()
    taken = int(next(m for m in logged(caplog) if m.startswith("batch 1 read")).split()[3])
    assert 821 < taken < n  # only the two new files


def test_batches_of_one_file_and_a_batch_again(spark, orders, tmp_path):
    tables, add = orders
    add("o_orderkey % 3 = 0")
    add("o_orderkey % 3 = 1")
    add("o_orderkey % 3 = 2")
    out, config = str(tmp_path / "out"), tmp_path / "c.json"
    config.write_text(json.dumps({"files_a_batch": 1}))
    inspection_panel.run(spark, tables, out, str(config))
    want = whole(spark, inspection_panel, tables, tmp_path)
    assert rows(inspection_panel.output(spark, out)) == want
    assert len(list(Path(out, "inspections").glob("batch=*"))) == 3
    # a batch that failed after its writes, before the checkpoint knew
    last = max(Path(out, "checkpoint/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    Path(out, f"checkpoint/commits/.{last.name}.crc").unlink(missing_ok=True)
    shutil.rmtree(Path(out, "transitions"))
    shutil.rmtree(next(Path(out, "panel").glob("year=1996")))
    inspection_panel.run(spark, tables, out, str(config))
    again = inspection_panel.output(spark, out)
    assert rows(again.where("part = 'panel'")) == [r for r in want if "part='panel'" in r]


def test_panel_of_gaps_and_nothing(spark, orders, tmp_path):
    tables, add = orders
    add("false")
    out = str(tmp_path / "out")
    inspection_panel.run(spark, tables, out)
    assert inspection_panel.output(spark, out).count() == 0
    t = spark.read.parquet(f"{tables}/orders.parquet")
    odd = spark.createDataFrame([(None,) * len(t.columns)], t.schema)
    odd.coalesce(1).write.mode("append").parquet(f"{tables}/orders.parquet")
    inspection_panel.run(spark, tables, out)
    assert inspection_panel.output(spark, out).count() == 0


DOCS = [
    (1, "deck 7, joints 5.2\nrail 3", "en", "north"), (2, "", "en", "north"), (3, None, None, None), (4, "none", " ", "south"), (5, "none", "de", "south"), (6, "none", "de", "south"),
    (7, "19 29 39", "de", "south"), (8, "1.5.2 x10.75", "12", "south"), (8, "8", "en", "north"), (None, "9", "en", "north"),
]


@pytest.fixture
def reports(spark, tmp_path):
    def put(docs):
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.mode("overwrite").parquet(str(tmp_path / "tables/documents.parquet"))

    return str(tmp_path / "tables"), put


def test_reports(spark, reports, tmp_path):
    tables, put = reports
    put(DOCS)
    out = str(tmp_path / "out")
    report_intake.run(spark, tables, out)
    got = {(r["doc_id"], r["lang"], r["source"], r["n_chars"], r["n_lines"], r["n_numbers"], r["state4"]) for r in report_intake.output(spark, out).where("part = 'report'").collect()}
    assert got == {
        (1, "en", "north", 25, 2, 3, 2), (2, "en", "north", 0, 1, 0, None), (3, "und", None, 0, 1, 0, None), (4, "und", "south", 4, 1, 0, None), (5, "de", "south", 4, 1, 0, None),
        (6, "de", "south", 4, 1, 0, None), (7, "de", "south", 8, 1, 3, 0), (8, "12", "south", 12, 1, 3, 3), (8, "en", "north", 1, 1, 1, 0),
    }
    table = {(r["lang"], r["source"]): r for r in report_intake.output(spark, out).where("part = 'quality'").collect()}
    de = table["de", "south"]
    assert [de[c] for c in ("n_reports", "n_empty", "n_texts", "n_rated", "good", "fair", "poor", "severe", "passes")] == [3, 0, 2, 1, 1, 0, 0, 0, True]
    assert not table["en", "north"]["passes"] and not table["und", None]["passes"] and table["12", "south"]["severe"] == 1


def test_reports_grow_above_the_mark(spark, reports, tmp_path, caplog):
    tables, put = reports
    caplog.set_level(logging.INFO)
    out = str(tmp_path / "out")
    put([d for d in DOCS if d[0] and d[0] <= 4])
    report_intake.run(spark, tables, out)
    first = rows(report_intake.output(spark, out))
    old = {p: p.stat().st_mtime_ns for p in Path(out, "reports").glob("*/*/*.parquet")}
    report_intake.run(spark, tables, out)
    assert rows(report_intake.output(spark, out)) == first
    put(DOCS)
    caplog.clear()
    report_intake.run(spark, tables, out)
    assert rows(report_intake.output(spark, out)) == whole(spark, report_intake, tables, tmp_path)
    assert any(m.startswith("read 5 documents above mark 4") for m in logged(caplog))
    assert {p: p.stat().st_mtime_ns for p in old} == old
    shutil.rmtree(next(Path(out, "marks").glob("above=4")))  # failed before the mark
    report_intake.run(spark, tables, out)
    assert rows(report_intake.output(spark, out)) == whole(spark, report_intake, tables, tmp_path)


def test_reports_of_nothing(spark, reports, tmp_path):
    tables, put = reports
    put([])
    report_intake.run(spark, tables, str(tmp_path / "out"))
    assert report_intake.output(spark, str(tmp_path / "out")).count() == 0


def test_settings_and_sessions_stay(spark, reports, tmp_path):
    tables, put = reports
    put(DOCS)
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    report_intake.run(spark, tables, str(tmp_path / "out"), str(ROOT / "jobs/report_intake.json"))
    assert (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode")) == before
    for job in (inspection_panel, report_intake):
        assert common.configuration(spark, job.DEFAULTS, str(ROOT / f"jobs/{job.__name__.split('.')[1]}.json")) == job.DEFAULTS
    bad = tmp_path / "bad.json"
    bad.write_text('{"least_shar": 1}')
    with pytest.raises(ValueError, match="least_shar"):
        common.configuration(spark, report_intake.DEFAULTS, str(bad))


def test_skewed_partitions_are_files_of_a_sound_size(spark, tmp_path):
    df = spark.range(100).select("id", F.when(F.col("id") < 90, "hot").otherwise("cold").alias("lang"))
    assert common.write(logging.getLogger("jobs.test"), df, str(tmp_path / "t"), ["lang"]) == 100
    assert spark.read.parquet(str(tmp_path / "t")).groupBy("lang").count().count() == 2
    assert len(list((tmp_path / "t").glob("*/*.parquet"))) == 2


def test_command_line(sf_dir, tmp_path):
    cmd = [sys.executable, str(ROOT / "jobs/report_intake.py"), "--tables", sf_dir, "--out", str(tmp_path / "o"), "--config", str(ROOT / "jobs/report_intake.json")]
    p = subprocess.run(cmd, capture_output=True, text=True, timeout=300)
    assert p.returncode == 0, p.stderr[-2000:]
    assert "read 200 documents above mark None" in p.stderr and "rows to" in p.stderr
    assert Path(tmp_path, "o/quality/_SUCCESS").exists()
