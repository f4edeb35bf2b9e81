"""Files in and out: inspection sheets, GraphML roads, optional tables, JSON, Markdown."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


from causeway.functions import scalars as S
from causeway.operators import network
from causeway.operators.lineage import cut
from causeway.operators.panel import SHEET, panel_of


def sheet_to_panel(spark: SparkSession, path: str, year: int) -> DataFrame:
    """One inspection sheet: a CSV file with a header, read as text."""
    sheet = spark.read.csv(path, header=True, inferSchema=False, encoding="UTF-8")
    return panel_of(sheet.withColumn("year", F.lit(year)))


#: The most headers that are sent to the tasks, 16 numbers and a path each; more meet their lines in a shuffle.
MOST_HEADERS = 100_000


def sheet_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``path, at, year, value``: the lines of all ``*.txt`` sheets below ``folder``; ``at`` is where the file's part begins.

    The year is 2000 and the name's last two digits; files whose names end otherwise are skipped.
    """
    lines = spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").text(folder)
    name = F.col("_metadata.file_name")
    year = F.regexp_extract(name, r"(\d{2})\.txt$", 1).cast("int") + 2000
    return lines.where(name.rlike(r"\d{2}\.txt$")).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), year.alias("year"), "value")


def _cells(line: Column) -> Column:
    """The cells of a line of CSV as they are written, quotes and all (an empty one may follow the last)."""
    return F.regexp_extract_all(line, F.lit(r'("[^"]*+(?:""[^"]*+)*+"|[^,]*+)(?:,|$)'), 1)


def _unquoted(cell: Column) -> Column:
    """A cell's text; null for an empty one."""
    inner = F.replace(F.substring(cell, F.lit(2), F.length(cell) - 2), F.lit('""'), F.lit('"'))
    return F.nullif(F.when(cell.rlike(r'^"(?s:.*)"$'), inner).otherwise(cell), F.lit(""))


def load_sheets(spark: SparkSession, folder: str) -> DataFrame:
    """All sheets below ``folder`` as one panel (see ``sheet_lines``).

    Sheets may have different columns in any order, and as many headers as files: a header is a
    row of places, which the file's lines meet by its path, so all files are one scan and one
    plan. It is the first line of the file's beginning that names the state code and the
    structure's number; of repeated names the first counts. Blank lines and empty files are
    left out, short lines end in nulls, and lines of a file without a header are an error when they are read.
    """
    lines = sheet_lines(spark, folder).where(F.trim("value") != "")
    needed = [SHEET[c] for c in ("state_code", "structure_id")]
    titles = lines.where("at = 0").where(F.col("value").contains(needed[0]) & F.col("value").contains(needed[1]))
    titles = cut(titles.withColumn("i", F.monotonically_increasing_id()).groupBy("path").agg(F.min_by("value", "i").alias("header")))
    found = titles.count()
    if not found:
        if lines.isEmpty():
            raise FileNotFoundError(f"no inspection sheets in {folder}")
        raise KeyError(needed[0])
    names = F.transform(_cells(F.col("header")), _unquoted)
    places = F.get(F.transform(F.array(names), lambda n: F.transform(F.array(*map(F.lit, SHEET.values())), lambda c: F.array_position(n, c).cast("int") - 1)), F.lit(0))
    heads = titles.select(F.col("path").alias("_path"), "header", places.alias("places"))
    own = lines.join(F.broadcast(heads) if found <= MOST_HEADERS else heads, F.col("path") == F.col("_path"), "left").where(~F.col("value").eqNullSafe(F.col("header")))
    # a place of -1 is a column that the sheet doesn't have; a line is taken apart once, for all places
    cells = F.get(F.transform(F.array(_cells(F.col("value"))), lambda c: F.transform("places", lambda p: F.when(p >= 0, _unquoted(F.get(c, p))))), F.lit(0))
    known = (F.get("places", F.lit(0)) >= 0) & (F.get("places", F.lit(1)) >= 0)
    cells = F.when(F.coalesce(known, F.lit(False)), cells).otherwise(F.raise_error(F.concat(F.lit("no header with structures' numbers: "), "path")).cast("array<string>"))
    picked = own.select("year", cells.alias("p"))
    return panel_of(picked.select("year", *(F.get("p", F.lit(j)).alias(c) for j, c in enumerate(SHEET.values()))))


def load_graphml(spark: SparkSession, path: str, speeds: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """``nodes, edges`` of a GraphML road file, routable; keys are resolved by their names."""
    rows = lambda tag, s: spark.read.format("xml").option("rowTag", tag).schema(s).load(path)
    keys = {r[0]: r[1] for r in rows("key", "`_id` string, `_attr.name` string, `_for` string").select("`_id`", "`_attr.name`").collect()}
    data = "data array<struct<_key:string,_VALUE:string>>"
    named = F.map_from_entries(F.transform("data", lambda d: F.struct(F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in keys.items() for x in kv)), d["_key"]), d["_key"]), d["_VALUE"])))
    tag = lambda c: F.try_element_at(named, F.lit(c))
    nodes = rows("node", f"_id string, {data}").select(F.col("_id").alias("node_id"), tag("x").try_cast("double").alias("x"), tag("y").try_cast("double").alias("y"), F.lit("junction").alias("kind"))
    # a tag that is a list is written as ['a', 'b']
    listed = lambda c: F.transform(F.split(F.regexp_replace(tag(c), r"^\[|\]$", ""), ","), lambda v: F.btrim(v, F.lit(" '\"")))
    ways = rows("edge", f"_source string, _target string, {data}")
    ways = ways.select(F.col("_source").alias("u"), F.col("_target").alias("v"), F.monotonically_increasing_id().alias("ord"), tag("length").try_cast("double").alias("length"), *(listed(c).alias(c) for c in ("highway", "bridge", "tunnel", "culvert")))
    return nodes, network.routable(ways, speeds)


def load_if_present(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A Parquet table, or an empty one with the given columns where there is none.

    Whatever else keeps it from being read is an error.
    """
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ddl)


def filesystem(path: str | Path):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    path = str(path)
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path if "://" in path else str(Path(path).absolute()))


def read_text(path: str | Path) -> str | None:
    """A small text file, or None if it can't be read."""
    try:
        system, at = filesystem(path)
        with system.open_input_stream(at) as f:
            return f.read().decode()
    except (OSError, ValueError):
        return None


def read_json(path: str | Path) -> dict | None:
    """A JSON file, or None if it can't be read."""
    try:
        return json.loads(read_text(path) or "")
    except ValueError:
        return None


def write_text(path: str | Path, text: str) -> None:
    system, at = filesystem(path)
    system.create_dir(at.rpartition("/")[0], recursive=True)
    with system.open_output_stream(at) as f:
        f.write(text.encode())


def write_results(result: dict, folder: str | Path, markdown: str) -> None:
    """``results.json`` and ``results.md``, overwritten."""
    write_text(f"{folder}/results.json", json.dumps(result, indent=2, default=str))
    write_text(f"{folder}/results.md", markdown)


def write_table(df: DataFrame, path: str) -> None:
    """Parquet, overwritten; columns of mixed, map, interval or no type as text."""
    plain = {f.name: F.to_json(f.name) for f in df.schema if isinstance(f.dataType, (T.MapType, T.VariantType))}
    odd = (T.NullType, T.DayTimeIntervalType, T.YearMonthIntervalType, T.CalendarIntervalType)
    plain |= {f.name: F.col(f.name).cast("string") for f in df.schema if isinstance(f.dataType, odd)}
    df.withColumns(plain).write.mode("overwrite").parquet(path)


def structures_table(edges: DataFrame, crossing: DataFrame | None = None) -> DataFrame:
    """``edge_u, edge_v, source`` of tagged edges, and of inferred crossings that aren't tagged."""
    tagged = network.tagged(edges).select(F.col("src").alias("edge_u"), F.col("dst").alias("edge_v"), F.lit("tag").alias("source"))
    if crossing is None:
        return tagged
    inferred = crossing.select(F.col("src").alias("edge_u"), F.col("dst").alias("edge_v")).join(tagged, ["edge_u", "edge_v"], "left_anti")
    return tagged.unionByName(inferred.withColumn("source", F.lit("crossing")))


def table_markdown(rows: list[dict], columns: dict[str, str]) -> str:
    """A Markdown table; ``columns``: key to format."""
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns)
    return "\n".join([head, *("| " + " | ".join(format(r[k], f) if r.get(k) is not None else "" for k, f in columns.items()) + " |" for r in rows)])


def evidence(spark: SparkSession, folder: str | Path) -> dict:
    """Saved results of the experiments, the QA text and the register."""
    from causeway.register import Register

    folder = Path(folder)
    return {
        "experiments": {p.parent.name: read_json(p) for p in sorted(folder.glob("*/results.json"))},
        "qa": read_text(folder / "network_qa.md"), "register": Register.default().as_dict(),
        "data": [
            {"name": "inspection sheets", "kind": "panel"}, {"name": "roads", "kind": "graph"}, {"name": "rain maxima", "kind": "series"},
            {"name": "facilities", "kind": "points"}, {"name": "habitations", "kind": "points"}, {"name": "cost rates", "kind": "dimension"},
        ],
    }
