"""A district out of map layers: roads, and water, places and facilities where there are any."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from causeway.operators import network
from causeway.operators.lineage import cut
from causeway.sources import files

POINTS = "points array<struct<x:double,y:double>>"


def build_district(spark: SparkSession, graphml: str, layers: str, out: str, cell: float = 0.01) -> dict:
    """Writes ``structures.parquet`` and ``real_district_qa.md`` to ``out``; returns the report's numbers.

    ``layers`` may hold ``water.parquet`` (water_id, points), ``places.parquet`` (name, place,
    population, points) and ``facilities.parquet`` (amenity, name, points); ``cell`` is in the
    roads' unit. A missing layer is reported as such.
    """
    nodes, edges = files.load_graphml(spark, graphml)
    edges = cut(edges)
    water = files.load_if_present(spark, f"{layers}/water.parquet", f"water_id long, {POINTS}")
    places = network.habitations_of(files.load_if_present(spark, f"{layers}/places.parquet", f"name string, place string, population string, {POINTS}"))
    services = network.facilities_of(files.load_if_present(spark, f"{layers}/facilities.parquet", f"amenity string, name string, {POINTS}"))
    at = lambda end: nodes.select(F.col("node_id").alias(end), F.struct("x", "y").alias(f"{end}_at"))
    lines = edges.select("src", "dst").join(at("src"), "src").join(at("dst"), "dst")
    lines = lines.select(F.struct("src", "dst").alias("edge_id"), F.array("src_at", "dst_at").alias("points"))
    crossing = network.crossings(lines, water, cell).select("edge_id.src", "edge_id.dst")
    structures = cut(files.structures_table(edges, crossing))
    files.write_table(structures, f"{out}/structures.parquet")
    sizes = network.components(nodes, edges).groupBy("component").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("nodes"), F.count("*").alias("components"), F.coalesce(F.max("n"), F.lit(0)).alias("largest")).collect()[0]
    result = {
        **sizes.asDict(), **network.tag_coverage(edges).collect()[0].asDict(), "water": not water.isEmpty(),
        "structures": {r[0]: r[1] for r in structures.groupBy("source").count().collect()}, "habitations": places.count(),
        "facilities": {k: services.where(F.col("facility_type") == k).count() for k in ("health", "school")},
    }
    files.write_text(f"{out}/real_district_qa.md", report(result))
    return result


def report(r: dict) -> str:
    tagged, crossed = r["structures"].get("tag", 0), r["structures"].get("crossing", 0)
    ready = r["habitations"] and r["facilities"]["health"]
    lines = [
        "# District", "", f"- nodes: {r['nodes']}, edges: {r['n_edges']}, connected components: {r['components']}",
        f"- share in the largest component: {r['largest'] / max(1, r['nodes']):.3f}", "", "## Structures", "",
        f"- tagged edges: {tagged} ({r['n_bridges']} bridges, {r['n_culverts']} culverts)",
        f"- inferred crossings: {crossed}" if r["water"] else "- no water layer, so no crossings were inferred", "", "## Habitations and facilities", "",
        f"- habitations: {r['habitations']}, health care: {r['facilities']['health']}, schools: {r['facilities']['school']}",
    ]
    return "\n".join([*lines, *([] if ready else ["- the loss of access can't be computed without habitations and health care"]), ""])
