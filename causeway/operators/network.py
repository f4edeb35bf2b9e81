"""Road networks as node and edge tables: build, snap, split, collapse, components, QA."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.functions import scalars as S
from causeway.operators.lineage import cut

CONNECTOR_KPH = 5.0
SNAP_TOLERANCE_M = 25.0
#: Edges that one task joins up at most.
SMALL_EDGES = 100_000


def must_be_empty(bad: DataFrame, message: str) -> None:
    """Raise ``KeyError`` with the first row of ``bad``, if there is one."""
    if rows := bad.limit(1).collect():
        raise KeyError(f"{message}: {rows[0].asDict()}")


def endpoints(u: Column, v: Column) -> tuple[Column, Column]:
    """An undirected edge's ends in one order."""
    return F.least(u, v), F.greatest(u, v)


def build_network(junctions: DataFrame, roads: DataFrame, speeds: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """``nodes, edges`` from (node_id, x, y) and (u, v, length_m, road_class[, ord]); the last of repeated roads counts."""
    nodes = junctions.select("node_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.lit("junction").alias("kind"))
    ends = roads.select(F.explode(F.array("u", "v")).alias("node_id")).distinct()
    must_be_empty(ends.join(nodes, "node_id", "left_anti"), "a road ends at an unknown junction")
    src, dst = endpoints(F.col("u"), F.col("v"))
    order = F.col("ord") if "ord" in roads.columns else F.monotonically_increasing_id()
    timed = roads.select(src.alias("src"), dst.alias("dst"), F.col("length_m").cast("double").alias("length_m"), "road_class", order.alias("ord"))
    last = timed.groupBy("src", "dst").agg(F.max_by(F.struct("length_m", "road_class"), "ord").alias("r")).select("src", "dst", "r.*")
    last = last.withColumn("speed_kph", S.class_speed(F.col("road_class"), speeds))
    return nodes, last.withColumn("travel_time_min", S.travel_minutes(F.col("length_m"), F.col("speed_kph")))


def fastest_edges(edges: DataFrame, order: str = "ord") -> DataFrame:
    """One row of parallel edges (``u, v, travel_time_min``, other columns): the fastest, the first of equals."""
    src, dst = endpoints(F.col("u"), F.col("v"))
    rest = [c for c in edges.columns if c not in ("u", "v", order)]
    best = edges.groupBy(src.alias("src"), dst.alias("dst")).agg(F.min_by(F.struct(*rest), F.struct("travel_time_min", order)).alias("r"))
    return best.select("src", "dst", "r.*")


def routable(ways: DataFrame, speeds: dict[str, float] | None = None) -> DataFrame:
    """Edges of a tagged multigraph (``u, v, length`` and arrays ``highway, bridge, tunnel, culvert``; ``ord``).

    A tag's head counts. Parallel ways collapse to the fastest, with its own bridge and culvert flags.
    """
    tag = lambda c: F.trim(S.first_of(F.col(c)))
    length = F.coalesce(F.col("length").cast("double"), F.lit(0.0))
    own = ways.select("u", "v", "ord", length.alias("length_m"), tag("highway").alias("highway"), S.highway_speed(tag("highway"), speeds).alias("speed_kph"),
                      S.is_yes(tag("bridge")).alias("is_bridge"),
                      ((F.coalesce(F.lower(tag("tunnel")), F.lit("")) == "culvert") | S.is_yes(tag("culvert"))).alias("is_culvert"))
    minutes = F.when(F.col("speed_kph") > 0, F.col("length_m") / 1000.0 / F.col("speed_kph") * 60.0).otherwise(F.lit(float("inf")))
    return fastest_edges(own.withColumn("travel_time_min", minutes))


def tag_coverage(edges: DataFrame) -> DataFrame:
    n = F.count("*")
    share = lambda c: F.coalesce(F.try_divide(F.count_if(c), n), F.lit(0.0))
    return edges.agg(n.alias("n_edges"), F.count_if("is_bridge").alias("n_bridges"), F.count_if("is_culvert").alias("n_culverts"), share("is_bridge").alias("bridge_share"), share("is_culvert").alias("culvert_share"))


def tagged(edges: DataFrame) -> DataFrame:
    return edges.where("is_bridge OR is_culvert")


#: Places of targets that a cell isn't split for, and splits one within another at most.
LEAF, LEVELS = 32, 24
#: Cells of a level that go to the points, at most; more of them meet by their places.
FEW_CELLS = 20_000


def _tree(spots: DataFrame, x0: float, y0: float, size: float) -> tuple[list[DataFrame], DataFrame]:
    """The cells of each level, and the places by the cell that isn't split any more.

    A cell of more than ``LEAF`` places is parted in sixteen, however many levels it takes,
    so that dense places have small cells. Cells are told by ``ix, iy`` in their level and
    have the box of what they hold.
    """
    levels, leaves, rest = [], [], spots
    for level in range(LEVELS + 1):
        width = size / 4.0**level
        rest = rest.withColumns({"ix": F.floor((F.col("tx") - x0) / width).cast("long"), "iy": F.floor((F.col("ty") - y0) / width).cast("long")})
        box = [F.min("tx").alias("bx0"), F.max("tx").alias("bx1"), F.min("ty").alias("by0"), F.max("ty").alias("by1")]
        held = cut(rest.groupBy("ix", "iy").agg(F.count("*").alias("n"), *box).withColumn("leaf", (F.col("n") <= LEAF) if level < LEVELS else F.lit(True)).drop("n"))
        levels.append(held)
        own = rest.join(held.select("ix", "iy", "leaf"), ["ix", "iy"])
        leaves.append(own.where("leaf").select(F.lit(level).alias("level"), "ix", "iy", "tx", "ty", "target"))
        if held.where("NOT leaf").isEmpty():
            break
        rest = cut(own.where("NOT leaf").select("tx", "ty", "target"))
    out = leaves[0]
    for more in leaves[1:]:
        out = out.union(more)
    return levels, cut(out)


def nearest(points: DataFrame, targets: DataFrame) -> DataFrame:
    """For each point (``id, x, y``) the nearest target (``target, tx, ty``; smallest id of equals) and ``dist``.

    Points go down a tree of the targets' cells, level by level and all together: of the
    cells a point has come to, those whose box begins beyond the farthest corner of another
    are left behind. So a point meets the targets of a few small cells, however many lie in
    one place. Points, and targets, of the same place are one. Without targets, and for
    points without coordinates, there is no row.
    """
    spots = cut(targets.where("tx IS NOT NULL AND ty IS NOT NULL").groupBy(F.col("tx").cast("double").alias("tx"), F.col("ty").cast("double").alias("ty")).agg(F.min("target").alias("target")))
    x0, x1, y0, y1 = spots.agg(F.min("tx"), F.max("tx"), F.min("ty"), F.max("ty")).first()
    if x0 is None:
        return points.select("id").withColumns({"target": F.lit(None).cast(targets.schema["target"].dataType), "dist": F.lit(None).cast("double")}).limit(0)
    levels, leaves = _tree(spots, x0, y0, max(x1 - x0, y1 - y0, 1e-9) * (1 + 1e-9))
    beside = lambda c: F.greatest(F.lit(0.0), F.col(f"b{c}0") - F.col(c), F.col(c) - F.col(f"b{c}1"))
    across = lambda c: F.greatest(F.abs(F.col(c) - F.col(f"b{c}0")), F.abs(F.col(c) - F.col(f"b{c}1")))
    far = lambda f: F.sqrt(F.pow(f("x"), 2.0) + F.pow(f("y"), 2.0))
    at = points.where("x IS NOT NULL AND y IS NOT NULL").select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).distinct()
    cells = at.join(F.broadcast(levels[0])).withColumn("level", F.lit(0))  # one cell
    cells = cells.withColumns({"low": far(beside), "high": far(across)})
    carried = ["x", "y", "level", "ix", "iy", "leaf", "low", "high"]
    for level, below in enumerate(levels[1:], 1):
        cells = cut(cells.select(*carried), spread=True)
        inner = below.withColumns({"px": F.floor(F.col("ix") / 4), "py": F.floor(F.col("iy") / 4)})
        inner = F.broadcast(inner) if below.count() <= FEW_CELLS else inner
        split = cells.where("NOT leaf").select("x", "y", F.col("ix").alias("px"), F.col("iy").alias("py")).join(inner, ["px", "py"])
        split = split.withColumns({"level": F.lit(level), "low": far(beside), "high": far(across)})
        both = cells.where("leaf").select(*carried).unionByName(split.select(*carried))
        cells = both.withColumn("best", F.min("high").over(Window.partitionBy("x", "y"))).where(F.col("low") <= F.col("best") * (1 + 1e-9))
    d = F.sqrt(F.pow(F.col("x") - F.col("tx"), 2.0) + F.pow(F.col("y") - F.col("ty"), 2.0))
    met = cells.select("x", "y", "level", "ix", "iy").join(leaves, ["level", "ix", "iy"]).withColumn("dist", d)
    best = met.groupBy("x", "y").agg(F.min(F.struct("dist", "target")).alias("b")).select("x", "y", "b.target", "b.dist")
    return points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).join(best, ["x", "y"]).select("id", "target", "dist")


def snap(points: DataFrame, nodes: DataFrame, tolerance_m: float = SNAP_TOLERANCE_M, connector_kph: float = CONNECTOR_KPH) -> DataFrame:
    """``id, kind, is_attached, attached_to, dist, node_id, travel_time_min`` of (id, x, y, kind) points.

    A point within the tolerance (inclusive) becomes the node ``kind:id`` with a walking
    connector to its nearest node; the others keep their whole distance as overshoot.
    """
    found = nearest(points, nodes.select(F.col("node_id").alias("target"), F.col("x").alias("tx"), F.col("y").alias("ty")))
    ok = F.col("dist") <= tolerance_m
    return points.join(found, "id").select(
        "id", "kind", "x", "y", ok.alias("is_attached"), F.when(ok, F.col("target")).alias("attached_to"), "dist",
        F.when(ok, F.concat_ws(":", "kind", F.col("id").cast("string"))).alias("node_id"),
        F.when(ok, S.travel_minutes(F.col("dist"), F.lit(connector_kph))).alias("travel_time_min"),
    )


def allocate_population(cells: DataFrame, habitations: DataFrame) -> DataFrame:
    """``node_id, population``: each population cell (id, x, y, population) goes to its nearest habitation; others get 0."""
    found = nearest(cells, habitations.select(F.col("node_id").alias("target"), F.col("x").alias("tx"), F.col("y").alias("ty")))
    sums = found.join(cells.select("id", "population"), "id").groupBy(F.col("target").alias("node_id")).agg(F.sum("population").alias("population"))
    return habitations.select("node_id").join(sums, "node_id", "left").select("node_id", F.coalesce("population", F.lit(0.0)).alias("population"))


def split_edges(nodes: DataFrame, edges: DataFrame, structures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Put structures (``node_id, u, v, fraction, structure_type``) on edges; several on one edge go in order.

    Fractions are measured from ``u``. The pieces share the edge's length and time in proportion.
    """
    must_be_empty(structures.where(~((F.col("fraction") > 0) & (F.col("fraction") < 1))), "fractions lie between 0 and 1")
    src, dst = endpoints(F.col("u"), F.col("v"))
    own = structures.select("node_id", "structure_type", src.alias("src"), dst.alias("dst"), F.when(F.col("u") <= F.col("v"), F.col("fraction")).otherwise(1 - F.col("fraction")).alias("f"))
    must_be_empty(own.join(edges, ["src", "dst"], "left_anti"), "a structure lies on an unknown edge")
    cuts = own.groupBy("src", "dst").agg(F.array_sort(F.collect_list(F.struct("f", "node_id"))).alias("cuts"))
    stops = F.concat(F.array(F.struct(F.lit(0.0).alias("f"), F.col("src").alias("node_id"))), F.col("cuts"), F.array(F.struct(F.lit(1.0).alias("f"), F.col("dst").alias("node_id"))))
    split = edges.join(cuts, ["src", "dst"]).withColumn("stops", stops)
    pieces = split.withColumn("k", F.explode(F.sequence(F.lit(0), F.size("stops") - 2)))
    a, b = F.get("stops", F.col("k")), F.get("stops", F.col("k") + 1)
    share = b["f"] - a["f"]
    ends = endpoints(a["node_id"], b["node_id"])
    whole = {"src": ends[0], "dst": ends[1], "length_m": F.col("length_m") * share, "travel_time_min": F.col("travel_time_min") * share}
    pieces = pieces.select(*(whole.get(c, F.col(c)).alias(c) for c in edges.columns))
    kept = edges.join(cuts, ["src", "dst"], "left_anti")
    at = lambda n: nodes.select(F.col("node_id").alias(n), F.col("x").alias(f"{n}_x"), F.col("y").alias(f"{n}_y"))
    placed = own.join(at("src"), "src").join(at("dst"), "dst")
    along = lambda c: F.col(f"src_{c}") + F.col("f") * (F.col(f"dst_{c}") - F.col(f"src_{c}"))
    new = placed.select("node_id", along("x").alias("x"), along("y").alias("y"), F.lit("structure").alias("kind"))
    return nodes.select("node_id", "x", "y", "kind").union(new), kept.unionByName(pieces)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node_id, component``: the smallest node id that is connected; isolated nodes are their own.

    Smallest labels travel along edges and jump to the label's own label, so rounds grow
    with the logarithm of the diameter; each round's labels are written to the shared folder.
    Up to ``SMALL_EDGES`` edges are joined up in one task instead.
    """
    ends = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    if ends.limit(SMALL_EDGES + 1).count() <= SMALL_EDGES:
        named = ends.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(_joined_up, f"node_id {edges.schema['src'].dataType.simpleString()}, component {edges.schema['src'].dataType.simpleString()}")
        return nodes.select("node_id").join(named, "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))
    both = cut(ends.union(ends.select("b", "a")).where("a <> b").distinct())
    labels = cut(nodes.select("node_id", F.col("node_id").alias("component")))
    while True:
        near = both.join(labels.select(F.col("node_id").alias("b"), "component"), "b").groupBy(F.col("a").alias("node_id")).agg(F.min("component").alias("near"))
        step = cut(labels.join(near, "node_id", "left").select("node_id", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component")))
        jump = step.select(F.col("node_id").alias("component"), F.col("component").alias("top"))
        new = cut(step.join(jump, "component").select("node_id", "old", F.least("component", "top").alias("component")))
        labels = new.select("node_id", "component")
        if new.where("component <> old").isEmpty():
            return labels


def _joined_up(ends: pd.DataFrame) -> pd.DataFrame:
    """``node_id, component`` of the nodes of an edge list ``a, b``."""
    top: dict = {n: n for n in {*ends["a"], *ends["b"]}}

    def find(n):
        while top[n] != n:
            top[n] = n = top[top[n]]
        return n

    for a, b in zip(ends["a"], ends["b"], strict=True):
        low, high = sorted((find(a), find(b)))
        top[high] = low
    return pd.DataFrame({"node_id": list(top), "component": [find(n) for n in top]})


def qa_report(nodes: DataFrame, edges: DataFrame, facilities: DataFrame, habitations: DataFrame, min_reach: float = 0.95) -> DataFrame:
    """One row: sizes, components, share of habitations that reach a health facility, orphans, verdict."""
    named = components(nodes, edges)
    largest = named.groupBy("component").agg(F.count("*").alias("n"))
    shape = largest.agg(F.sum("n").alias("n_nodes"), F.count("*").alias("n_components"), F.max("n").alias("top"))
    homes = habitations.select("node_id").join(named, "node_id")
    places = facilities.select("node_id", "facility_type").join(named, "node_id")
    served = places.where("facility_type = 'health'").select("component").distinct()
    lived = homes.select("component").distinct()
    reach = homes.join(served.withColumn("ok", F.lit(True)), "component", "left").agg(F.count("*").alias("n_habitations"), F.coalesce(F.avg(F.coalesce(F.col("ok").cast("int"), F.lit(0))), F.lit(0.0)).alias("share_habitations_with_health"))
    orphans = places.select("node_id", "component").distinct().join(lived.withColumn("ok", F.lit(True)), "component", "left").agg(F.count("*").alias("n_facilities"), F.count_if(F.col("ok").isNull()).alias("n_orphan_facilities"))
    count = edges.agg(F.count("*").alias("n_edges"))
    one = shape.join(count).join(reach).join(orphans)  # four tables of one row
    return one.select(
        F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"), "n_edges", "n_components", F.coalesce(F.try_divide("top", "n_nodes"), F.lit(0.0)).alias("largest_component_share"),
        "n_habitations", "share_habitations_with_health", "n_facilities", "n_orphan_facilities", F.lit(min_reach).alias("min_health_reach"),
        (F.col("share_habitations_with_health") >= min_reach).alias("passes"),
    )


def qa_markdown(row, name: str = "district") -> str:
    lines = [f"# Network QA: {name}", ""]
    for label, key, form in (
        ("nodes", "n_nodes", "d"), ("edges", "n_edges", "d"), ("connected components", "n_components", "d"), ("share in largest component", "largest_component_share", ".3f"),
        ("habitations", "n_habitations", "d"), ("share of habitations reaching health care", "share_habitations_with_health", ".3f"),
        ("facilities", "n_facilities", "d"), ("orphan facilities", "n_orphan_facilities", "d"),
    ):
        lines.append(f"- {label}: {row[key]:{form}}")
    return "\n".join([*lines, "", f"**Exit test (>={row['min_health_reach']:.0%} reach health care): {'PASS' if row['passes'] else 'REJECT'}**"])


def _cross(ax, ay, bx, by, px, py) -> Column:
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def segments_meet(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Whether the segments (x1, y1, x2, y2) share a point, touching included."""
    d1, d2 = _cross(*b, a[0], a[1]), _cross(*b, a[2], a[3])
    d3, d4 = _cross(*a, b[0], b[1]), _cross(*a, b[2], b[3])
    box = lambda s, x, y: x.between(F.least(s[0], s[2]), F.greatest(s[0], s[2])) & y.between(F.least(s[1], s[3]), F.greatest(s[1], s[3]))
    proper = (F.signum(d1) * F.signum(d2) < 0) & (F.signum(d3) * F.signum(d4) < 0)
    touch = ((d1 == 0) & box(b, a[0], a[1])) | ((d2 == 0) & box(b, a[2], a[3])) | ((d3 == 0) & box(a, b[0], b[1])) | ((d4 == 0) & box(a, b[2], b[3]))
    return proper | touch


def _pieces(lines: DataFrame, *keys: str) -> DataFrame:
    """``keys, x1, y1, x2, y2``: each segment of each polyline; a single point is a segment of no length."""
    k = lines.withColumn("k", F.explode(F.sequence(F.lit(0), F.greatest(F.size("points") - 2, F.lit(0)))))
    p, q = F.get("points", F.col("k")), F.coalesce(F.get("points", F.col("k") + 1), F.get("points", F.col("k")))
    return k.select(*keys, *(c.alias(n) for n, c in (("x1", p["x"]), ("y1", p["y"]), ("x2", q["x"]), ("y2", q["y"])))).where("x1 IS NOT NULL")


def _rows(segments: DataFrame, cell: float) -> DataFrame:
    """A row for each segment and row ``cy`` of the grid that it touches."""
    at = lambda f: F.floor(f("y1", "y2") / cell).cast("long")
    return segments.withColumn("cy", F.explode(F.sequence(at(F.least), at(F.greatest))))


#: Pairs of segments that meet in a cell which isn't parted, and partings one within another at most.
MOST_PAIRS, PARTINGS = 4_096, 8
#: Water segments of a crowded cell that its roads are tested against first, about.
FIRST_TESTS = 2


def _in_cells(segments: DataFrame, cell: float, within: bool = False) -> DataFrame:
    """A row for each segment and cell ``cx, cy`` that it touches: as many as it is long, not as its box holds.

    With ``within``, only the sixteen cells that part the one a row is in already.
    """
    at = lambda f: F.floor(f("y1", "y2") / cell).cast("long")
    inside = lambda low, high, c: (F.greatest(low, 4 * F.col(c)), F.least(high, 4 * F.col(c) + 3)) if within else (low, high)
    rows = segments.withColumn("ny", F.explode(F.sequence(*inside(at(F.least), at(F.greatest), "cy"))))
    part = lambda y: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (y - F.col("y1")) / (F.col("y2") - F.col("y1"))))
    x = lambda y, level: F.when(F.col("y1") == F.col("y2"), F.col(level)).otherwise(F.col("x1") + part(y) * (F.col("x2") - F.col("x1")))
    one, two = x(F.col("ny") * cell, "x1"), x((F.col("ny") + 1) * cell, "x2")
    edge = 1e-6 * cell  # a neighbouring cell more does no harm, where rounding could leave one out
    low, high = inside(*(F.floor(v / cell).cast("long") for v in (F.least(one, two) - edge, F.greatest(one, two) + edge)), "cx")
    rows = rows.withColumns({"low": low, "high": high}).where("low <= high")
    return rows.withColumn("nx", F.explode(F.sequence("low", "high"))).select(segments.columns[0], "x1", "y1", "x2", "y2", F.col("nx").alias("cx"), F.col("ny").alias("cy"))


def _inside_rings(roads: DataFrame, water: DataFrame, cell: float) -> DataFrame:
    """``edge_id`` of roads whose first point lies in a closed ring.

    A ring's box lies in four cells at most of a grid of its own size, where points meet it
    without its outline; only the segments in the point's row are then counted.
    """
    ring = water.where((F.size("points") > 3) & (F.get("points", F.lit(0)) == F.element_at("points", -1))).select("points")
    ring = cut(ring.withColumn("ring", F.monotonically_increasing_id()))
    x, y = F.transform("points", lambda p: p["x"]), F.transform("points", lambda p: p["y"])
    box = ring.select("ring", *(f(v).alias(n) for n, f, v in (("x0", F.array_min, x), ("x1", F.array_max, x), ("y0", F.array_min, y), ("y1", F.array_max, y))))
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    box = box.withColumn("level", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(side, F.lit(cell)) / cell))).cast("int"))
    width = F.pow(F.lit(2.0), F.col("level")) * cell
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width).cast("long"), F.floor(F.col(b) / width).cast("long")))
    box = box.withColumn("bx", span("x0", "x1")).withColumn("by", span("y0", "y1"))
    levels = [r[0] for r in box.select("level").distinct().collect()]  # as many as the numbers' binary digits
    first = roads.where(F.size("points") > 0).select("edge_id", F.get("points", F.lit(0)).alias("p")).select("edge_id", "p.x", "p.y")
    first = first.withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    first = first.withColumns({"bx": F.floor(F.col("x") / width).cast("long"), "by": F.floor(F.col("y") / width).cast("long")})
    held = first.join(box, ["level", "bx", "by"]).where(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")))
    held = held.select("edge_id", "x", "y", "ring", F.floor(F.col("y") / cell).cast("long").alias("cy"))
    both = held.join(_rows(_pieces(ring, "ring"), cell), ["ring", "cy"])
    over = (F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))
    at = F.col("x1") + (F.col("y") - F.col("y1")) * F.try_divide(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return both.groupBy("edge_id", "ring").agg(F.count_if(over & (F.col("x") < at)).alias("n")).where("n % 2 = 1").select("edge_id")


def crossings(roads: DataFrame, water: DataFrame, cell: float = 1000.0) -> DataFrame:
    """The ``edge_id`` of roads that meet a water line or lie in a closed water ring.

    Both sides are ``points``: arrays of struct(x, y). Segments meet in grid cells and are
    tested exactly. Where too many would meet in a cell, its roads are tested against about
    ``FIRST_TESTS`` of its water segments, and those that meet one are done; only where many
    roads are left is the cell parted in sixteen, again and again. So a dense place's long
    roads leave before they are parted, and only near segments are tested. A road inside a
    ring without touching it is found by ray casting from its first point.
    """
    a, b = (cut(_in_cells(_pieces(df.select(key, "points"), key), cell), spread=True) for df, key in ((roads, "edge_id"), (water, "water_id")))
    met, at = _inside_rings(roads, water, cell), ["cx", "cy"]
    count = lambda df, n: df.groupBy(*at).agg(F.count("*").alias(n))
    crowded = (F.col("n") * F.col("m") > MOST_PAIRS) & (F.col("n") > 1) & (F.col("m") > 1)
    chance = (F.xxhash64("water_id", "x1", "y1", "x2", "y2").cast("double") / 2.0**64 + 0.5) * F.col("m")
    for k in range(PARTINGS + 1):
        held = cut(count(a, "n").join(count(b, "m"), at).withColumn("crowded", crowded))
        some = cut(b.join(_few(held), at).where(~F.col("crowded") | (chance < FIRST_TESTS)).select(*b.columns))
        done = cut(_tested(a, _few(some)).distinct())
        met, held = met.union(done), held.where("crowded").select(*at, "m")
        if held.isEmpty():
            break
        a = cut(a.join(_few(held.select(*at)), at, "left_semi").join(done, "edge_id", "left_anti").select(*a.columns), spread=True)
        left = cut(count(a, "n").join(held, at).withColumn("crowded", crowded if k < PARTINGS else F.lit(False)))
        b = cut(b.join(_few(left), at).select(*b.columns, "crowded"), spread=True)
        met, dense = met.union(_tested(a, b.where("NOT crowded"))), left.where("crowded").select(*at)
        if dense.isEmpty():
            break
        cell /= 4
        a, b = (cut(_in_cells(df, cell, within=True), spread=True) for df in (a.join(_few(dense), at).select(*a.columns), b.where("crowded").drop("crowded")))
    return met.distinct()


def _few(df: DataFrame) -> DataFrame:
    """A written relation, to go to the other side of a join where it is small."""
    return F.broadcast(df) if df.limit(FEW_CELLS + 1).count() <= FEW_CELLS else df


def _tested(a: DataFrame, b: DataFrame) -> DataFrame:
    """``edge_id`` of the segments of ``a`` that meet one of ``b`` in their cell."""
    ends = ("x1", "y1", "x2", "y2")
    named = lambda df, p: df.select("cx", "cy", *(["edge_id"] if p == "a" else []), *(F.col(c).alias(f"{p}{i}") for i, c in enumerate(ends)))
    cols = lambda p: [F.col(f"{p}{i}") for i in range(4)]
    return named(a, "a").join(named(b, "b"), ["cx", "cy"]).where(segments_meet(cols("a"), cols("b"))).select("edge_id")


def facilities_of(features: DataFrame) -> DataFrame:
    """``facility_type, x, y, name`` of amenities that are health care or schools, at their centroid."""
    #: Amenities by facility type.
    kinds = {"health": ["hospital", "clinic", "doctors"], "school": ["school", "college", "kindergarten"]}
    amenity = F.lower(F.trim("amenity"))
    kind = F.when(amenity.isin(*kinds["health"]), "health").when(amenity.isin(*kinds["school"]), "school")
    c = S.centroid(F.col("points"))
    return features.select(kind.alias("facility_type"), c["x"].alias("x"), c["y"].alias("y"), "name").where("facility_type IS NOT NULL AND x IS NOT NULL")


def habitations_of(places: DataFrame) -> DataFrame:
    """``x, y, name, place, population`` of places that have a geometry."""
    c = S.centroid(F.col("points"))
    return places.select(c["x"].alias("x"), c["y"].alias("y"), "name", "place", S.population_of(F.col("population")).alias("population")).where("x IS NOT NULL")


def cheapest_neighbours(edges: DataFrame, k: int = 3) -> DataFrame:
    """The edges that are among the ``k`` fastest at either of their ends."""
    ends = edges.select("src", "dst", "travel_time_min", F.explode(F.array("src", "dst")).alias("node"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("travel_time_min", "src", "dst"))
    keep = ends.withColumn("r", rank).where(F.col("r") <= k).select("src", "dst").distinct()
    return edges.join(keep, ["src", "dst"], "left_semi")


def empty(spark: SparkSession, schema) -> DataFrame:
    return spark.createDataFrame([], schema)


def map_nodes(nodes: DataFrame, homes: DataFrame, places: DataFrame, structures: DataFrame) -> DataFrame:
    """The nodes of a map: ``node_id, x, y, kind`` with what lies there, null where nothing does.

    ``homes``: ``node_id, population``, summed at a node. ``places``: ``node_id, facility_type, ord``
    and ``structures``: ``node_id, structure_type, ord``; the last of a node counts, of equal
    ``ord`` the larger name. What lies at no known node, or at null, is left out. Each is
    aggregated before it meets the nodes, so a node with very many of them is one row in a join.
    """
    last = lambda df, c: df.where(F.col(c).isNotNull()).groupBy("node_id").agg(F.max_by(c, F.struct("ord", c)).alias(c))
    out = nodes.select("node_id", "x", "y", "kind")
    for what in (homes.groupBy("node_id").agg(F.sum("population").alias("population")), last(places, "facility_type"), last(structures, "structure_type")):
        out = out.join(what, "node_id", "left")
    return out
