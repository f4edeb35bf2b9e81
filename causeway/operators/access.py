"""Access to services: nearest-facility times, and the loss when a set of nodes or edges fails.

Two physical forms of the same relation. ``distances`` takes edge tables of any size, cell by
cell: all failure sets and facility types advance together, and a round's work follows its frontier.
A ``Graph`` of checked size goes along with the failure sets, which are then the data, each
solved inside its row. ``losses`` takes the second form where the graph allows it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions import scalars as S
from causeway.operators.lineage import cut
from causeway.operators.network import must_be_empty

#: A graph of so many edges, and as many habitations, goes along with the failure sets at most.
SMALL_EDGES = 100_000
#: Numbers (sets x edges) that a task holds at once, about.
HELD = 1 << 24
#: A round's rows that are broadcast at most, and rounds after which their tables become one.
FEW, COMPACT = 100_000, 8
#: Edges of a graph that is one cell, and nodes of a cell of a larger one, at most.
CELL_EDGES, CELL_NODES = 20_000, 4_000
#: Rows that the sets of a cell are dealt to.
TURNS = 64
INF = float("inf")


def both_ways(edges: DataFrame) -> DataFrame:
    w = F.coalesce("travel_time_min", F.lit(1.0)).alias("w")
    return edges.select("src", "dst", w).union(edges.select("dst", "src", w))


def cells_of(edges: DataFrame, most: int = CELL_NODES) -> DataFrame:
    """``node, cell``: connected groups of ``most`` nodes or fewer, of neighbours that are near.

    Half of the groups, by a tossed coin, ask the nearest of the others, which takes those
    nearest to it that it has room for. Rounds grow with the logarithm of ``most``, and the
    table of links between groups shrinks with each; they end at twice the least number of
    groups, or when hardly any still finds another.
    """
    ways = both_ways(edges).where("src <> dst")
    of = cut(ways.select(F.col("src").alias("node")).distinct().withColumn("cell", F.col("node").cast("string")))
    name = lambda c: F.col(c).cast("string").alias(c)
    links, sizes = cut(ways.groupBy(name("src"), name("dst")).agg(F.min("w").alias("w"))), cut(of.select("cell", F.lit(1).alias("n")))
    moved = lambda df, c, moves: df.join(moves.select(F.col("src").alias(c), F.col("dst").alias("_to")), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
    nodes = groups = sizes.count()
    r, idle, open_ = 0, 0, []  # what nodes haven't heard of yet
    while idle < 2 and 2 * nodes < groups * most:
        r += 1
        asks = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(r)), F.lit(2)) == 0  # noqa: B023, E731
        able = links.where(asks("src") & ~asks("dst")).join(sizes.select(F.col("cell").alias("src"), F.col("n").alias("own")), "src").join(sizes.select(F.col("cell").alias("dst"), "n"), "dst")
        asked = able.where(F.col("own") + F.col("n") <= most).groupBy("src").agg(F.min(F.struct("w", "dst", "own", "n")).alias("to")).select("src", "to.*")
        room = F.sum("own").over(Window.partitionBy("dst").orderBy("w", "src"))
        moves = cut(asked.withColumn("sum", room).where(F.col("sum") + F.col("n") <= most).select("src", "dst"))
        n = moves.count()
        groups, idle = groups - n, idle + 1 if 50 * n < groups else 0
        if n:
            sizes = cut(moved(sizes, "cell", moves).groupBy("cell").agg(F.sum("n").cast("int").alias("n")))
            links = cut(moved(moved(links, "src", moves), "dst", moves).where("src <> dst").groupBy("src", "dst").agg(F.min("w").alias("w")))
            open_.append(moves)
        if len(open_) == COMPACT:
            of, open_ = cut(_after(of, open_, moved)), []
    of = _after(of, open_, moved)
    return of.select("node", "cell")


def _after(of: DataFrame, moves: list[DataFrame], moved) -> DataFrame:
    for m in moves:
        of = moved(of, "cell", m)
    return of


def distances(edges: DataFrame, sources: DataFrame, blocked_nodes: DataFrame | None = None, blocked_edges: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    """``set_id, facility_type, node, dist``: least time from any source of the type.

    ``sources``: ``set_id, facility_type, node``. Blocked nodes and edges (``set_id, node``;
    ``set_id, src, dst`` in either order) take no part in their set; a blocked source isn't one.

    Nodes lie in ``cells`` (``node, cell``; a cell fits into a task). A cell is solved by
    itself, from the times at which it is entered; the times at its exits travel over the edges
    between cells, and only what improves an entry is solved again. So rounds follow the
    cells that a way crosses and not its edges; all times inside are written once, at the end.
    Without ``cells``, a small graph is one, and a larger one is parted by ``cells_of``.
    """
    keys = ["set_id", "facility_type", "node"]
    ways = cut(both_ways(edges))
    if cells is None:
        few = ways.limit(2 * CELL_EDGES + 1).count() <= 2 * CELL_EDGES
        cells = ways.select(F.col("src").alias("node")).distinct().withColumn("cell", F.lit("")) if few else cells_of(edges)
    cells = cut(cells.select("node", "cell"))
    if blocked_nodes is not None:
        blocked_nodes = cut(blocked_nodes.select("set_id", "node").distinct())
        sources = sources.join(blocked_nodes, ["set_id", "node"], "left_anti")
    if blocked_edges is not None:
        blocked_edges = cut(blocked_edges.select("set_id", F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).distinct())
    at = lambda end, name: cells.select(F.col("node").alias(end), F.col("cell").alias(name))
    placed = cut(ways.join(at("src", "a"), "src").join(at("dst", "b"), "dst"))
    cross = cut(placed.where("a <> b").select("src", "dst", "w", "a"))
    inner = placed.where("a = b").groupBy(F.col("a").alias("cell")).agg(*(F.collect_list(c).alias(c) for c in ("src", "dst", "w")))
    doors = cross.groupBy(F.col("a").alias("cell")).agg(F.collect_set("src").alias("doors"))
    maps = cut(cells.select("cell").distinct().join(inner, "cell", "left").join(doors, "cell", "left"), spread=True)
    start = cut(sources.select(*keys).distinct().withColumn("dist", F.lit(0.0)))
    solve = lambda entries, whole: _solved(entries, cells, maps, blocked_nodes, blocked_edges, whole)
    frontier, known = start, [start]  # what each round found; the least of them counts
    merged = lambda: known[0] if len(known) == 1 else _union(known).groupBy(*keys).agg(F.min("dist").alias("dist"))
    while not frontier.isEmpty():
        step = solve(frontier, False).withColumnRenamed("node", "src").join(cross.select("src", F.col("dst").alias("node"), "w"), "src")
        if blocked_nodes is not None:
            step = step.join(blocked_nodes, ["set_id", "node"], "left_anti")
        if blocked_edges is not None:
            step = step.withColumns({"lo": F.least("src", "node"), "hi": F.greatest("src", "node")}).join(blocked_edges, ["set_id", "lo", "hi"], "left_anti")
        found = cut(step.groupBy(*keys).agg(F.min(F.col("dist") + F.col("w")).alias("dist")))
        few = found.limit(FEW + 1).count() <= FEW
        # what is known stays where it is, if the round's rows are few enough to go there
        on = [F.col(f"f.{k}") == F.col(f"s.{k}") for k in keys]
        stale = (F.broadcast(found) if few else found).alias("f").join(_union(known).alias("s"), [*on, F.col("s.dist") <= F.col("f.dist")]).select(*(f"f.{k}" for k in keys)).distinct()
        frontier = cut(found.join(F.broadcast(stale) if few else stale, keys, "left_anti"))
        known.append(frontier)
        if len(known) > COMPACT:
            known = [cut(merged())]
    entries = cut(merged())
    return solve(entries, True).unionByName(entries.join(cells, "node", "left_anti"))  # a source without a road is its own place


def _solved(entries: DataFrame, cells: DataFrame, maps: DataFrame, blocked_nodes: DataFrame | None, blocked_edges: DataFrame | None, whole: bool) -> DataFrame:
    """Least times inside the cells from ``entries``, at all nodes or at those with a way out."""
    turn = F.pmod(F.xxhash64("set_id"), F.lit(TURNS)).alias("turn")  # sets of a cell are dealt to several rows
    near = cells.select("node", "cell")
    rows = entries.join(near, "node").groupBy("cell", turn).agg(F.collect_list(F.struct("set_id", "facility_type", "node", "dist")).alias("entries"))
    if blocked_nodes is not None:
        rows = rows.join(blocked_nodes.join(near, "node").groupBy("cell", turn).agg(F.collect_list(F.struct("set_id", "node")).alias("closed")), ["cell", "turn"], "left")
    if blocked_edges is not None:
        within = blocked_edges.join(near.withColumnRenamed("node", "lo"), "lo")
        rows = rows.join(within.groupBy("cell", turn).agg(F.collect_list(F.struct("set_id", "lo", "hi")).alias("cuts")), ["cell", "turn"], "left")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("closed", "array<struct<set_id:string,node:string>>"), ("cuts", "array<struct<set_id:string,lo:string,hi:string>>")) if c not in rows.columns]
    kinds = {f.name: f.dataType.simpleString() for f in entries.schema}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            for row in x.itertuples(index=False):
                yield pd.DataFrame(_walks(row, whole), columns=["set_id", "facility_type", "node", "dist"])

    return rows.select("*", *none).join(maps, "cell").mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in ("set_id", "facility_type", "node", "dist")))


def _walks(row, whole: bool) -> list[tuple]:
    """``set_id, facility_type, node, dist`` of one cell and the sets that entered it."""
    as_list = lambda v: [] if v is None else list(v)
    ways: dict = {}
    for u, v, w in zip(as_list(row.src), as_list(row.dst), as_list(row.w), strict=True):
        ways.setdefault(u, []).append((v, float(w)))
    starts: dict = {}
    for e in row.entries:
        starts.setdefault((e["set_id"], e["facility_type"]), []).append((float(e["dist"]), e["node"]))
    closed: dict = {}
    for e in as_list(row.closed):
        closed.setdefault(e["set_id"], set()).add(e["node"])
    cuts: dict = {}
    for e in as_list(row.cuts):
        cuts.setdefault(e["set_id"], set()).update(((e["lo"], e["hi"]), (e["hi"], e["lo"])))
    doors, out = set(as_list(row.doors)), []
    for (s, kind), heap in starts.items():
        shut, gone, done = closed.get(s, ()), cuts.get(s, ()), {}
        heapq.heapify(heap)
        while heap:
            d, u = heapq.heappop(heap)
            if u in done or u in shut:
                continue
            done[u] = d
            for v, w in ways.get(u, ()):
                if v not in done and (u, v) not in gone:
                    heapq.heappush(heap, (d + w, v))
        out += [(s, kind, n, d) for n, d in done.items() if whole or n in doors]
    return out


def parents(edges: DataFrame, times: DataFrame) -> DataFrame:
    """Adds ``parent`` to ``distances`` of the whole network: the node before on the way from the source, null for sources.

    Of ways that take equally long, the one over the smaller node counts. Over edges that take
    no time a node follows one that has its parent already.
    """
    keys = ["set_id", "facility_type"]
    ways = cut(both_ways(edges))
    before = times.select(*keys, F.col("node").alias("src"), F.col("dist").alias("d"))
    steps = before.join(ways, "src").select(*keys, F.col("dst").alias("node"), (F.col("d") + F.col("w")).alias("via"), F.col("src"), "d")
    first = steps.join(times, [*keys, "node"]).where("d < dist").groupBy(*keys, "node").agg(F.min(F.struct("via", "src")).alias("b"))
    tree = cut(times.join(first, [*keys, "node"], "left").select(*times.columns, F.when(F.col("b.via") <= F.col("dist"), F.col("b.src")).alias("parent")))
    held, rest = tree.where("parent IS NOT NULL OR dist = 0"), cut(tree.where("parent IS NULL AND dist > 0"))
    still = ways.where("w = 0")
    while not rest.isEmpty():
        reached = held.select(*keys, F.col("node").alias("src"), "dist").join(still, "src").groupBy(*keys, F.col("dst").alias("node"), "dist").agg(F.min("src").alias("up"))
        step = cut(rest.join(reached, [*keys, "node", "dist"], "left").select(*times.columns, F.col("up").alias("parent")))
        held, rest = cut(held.unionByName(step.where("parent IS NOT NULL"))), cut(step.where("parent IS NULL"))
    return held


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def sources_of(sets: DataFrame, facilities: DataFrame) -> DataFrame:
    """Every set's sources: sets x facilities, which are few."""
    return sets.select("set_id").distinct().join(F.broadcast(facilities.select("facility_type", F.col("node_id").alias("node"))))


def unknown(edges: DataFrame, habitations: DataFrame, facilities: DataFrame, failed_nodes: DataFrame | None = None, failed_edges: DataFrame | None = None) -> DataFrame:
    """``what, a, b``: failed nodes (``a``) and edges (their ends in order) that aren't in the network, each once, as text."""
    text = lambda what, a, b: (F.lit(what).alias("what"), a.cast("string").alias("a"), b.cast("string").alias("b"))
    out = edges.sparkSession.createDataFrame([], "what string, a string, b string")
    if failed_nodes is not None:
        known = edges.select(F.col("src").alias("node")).union(edges.select("dst")).union(habitations.select("node_id")).union(facilities.select("node_id"))
        out = out.union(failed_nodes.join(known, "node", "left_anti").select(*text("node", F.col("node"), F.lit(None))))
    if failed_edges is not None:
        pair = lambda df: df.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        out = out.union(pair(failed_edges).join(pair(edges), ["src", "dst"], "left_anti").select(*text("edge", F.col("src"), F.col("dst"))))
    return out.distinct()


def losses(
    edges: DataFrame, habitations: DataFrame, facilities: DataFrame, services: DataFrame, sets: DataFrame,
    failed_nodes: DataFrame | None = None, failed_edges: DataFrame | None = None, validate: bool = False, small: bool | None = None,
) -> DataFrame:
    """``set_id, loss`` of every set: population x weight x lost share of the cap.

    Gains are dropped, and a habitation without a way before has nothing to lose. What fails
    is ``set_id, node`` and ``set_id, src, dst``; with ``validate``, nodes and edges that
    aren't in the network are a ``KeyError``, otherwise nothing. ``small`` asks for one of the
    two forms; by default the graph's size decides.
    """
    if validate:
        lost = unknown(edges, habitations, facilities, failed_nodes, failed_edges)
        must_be_empty(lost.where("what = 'node'"), "a failed node isn't in the network")
        must_be_empty(lost.where("what = 'edge'"), "a failed edge isn't in the network")
    graph = Graph.small(edges, habitations, facilities, services) if small is not False else None
    if graph is not None:
        return _losses_inside(graph, sets, failed_nodes, failed_edges)
    base = sets.sparkSession.createDataFrame([("",)], "set_id string")
    before = distances(edges, sources_of(base, facilities))
    after = distances(edges, sources_of(sets, facilities), failed_nodes, failed_edges)
    grid = sets.select("set_id").distinct().join(F.broadcast(services))  # sets x facility types
    homes = grid.join(habitations.select(F.col("node_id").alias("node"), "population"))
    rows = homes.join(before.select("facility_type", "node", F.col("dist").alias("d0")), ["facility_type", "node"], "left")
    rows = rows.join(after.withColumnRenamed("dist", "d1"), ["set_id", "facility_type", "node"], "left")
    worse = S.travel_share(F.col("d1"), F.col("cap_min")) - S.travel_share(F.col("d0"), F.col("cap_min"))
    return rows.groupBy("set_id").agg(F.sum(F.col("population") * F.col("weight") * F.greatest(worse, F.lit(0.0))).alias("loss"))


def _losses_inside(graph: Graph, sets: DataFrame, failed_nodes: DataFrame | None, failed_edges: DataFrame | None) -> DataFrame:
    """Each set as a row with what fails in it, solved there."""
    rows = sets.select("set_id").distinct()
    for name, failed, item in (("nodes", failed_nodes, lambda: F.col("node")), ("cuts", failed_edges, lambda: F.struct("src", "dst"))):
        if failed is None:
            rows = rows.withColumn(name, F.lit(None).cast("array<string>"))
        else:
            rows = rows.join(failed.groupBy("set_id").agg(F.collect_set(item()).alias(name)), "set_id", "left")
    given = sets.sparkSession.sparkContext.broadcast(graph)  # SMALL_EDGES at most

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = given.value
        for x in frames:
            nodes = [[] if v is None else v for v in x["nodes"]]
            cuts = [[] if v is None else [(e["src"], e["dst"]) for e in v] for v in x["cuts"]]
            total = [g.losses(*g.failed(nodes[i : i + g.step], cuts[i : i + g.step])) for i in range(0, len(x), g.step)]
            yield pd.DataFrame({"set_id": x["set_id"], "loss": np.concatenate(total) if total else np.zeros(0)})

    return rows.mapInPandas(run, f"set_id {sets.schema['set_id'].dataType.simpleString()}, loss double")


def affected(tree: DataFrame, habitations: DataFrame, failed_nodes: list, failed_edges: list[tuple] = ()) -> DataFrame:
    """``facility_type, node`` of habitations whose own way (by ``parents``) uses a failed node or edge.

    Each node looks at the one it points to and then points to where that one pointed, so
    rounds grow with the logarithm of the longest way, and rows stay as wide as they are.
    """
    keys = ["set_id", "facility_type"]
    ends = [sorted(e) for e in failed_edges]
    hit = F.col("node").isin(list(failed_nodes)) if len(failed_nodes) else F.lit(False)
    for a, b in ends:
        hit = hit | F.coalesce((F.least("node", "parent") == a) & (F.greatest("node", "parent") == b), F.lit(False))
    every = cut(tree.select(*keys, "node", F.col("parent").alias("up"), hit.alias("bad")))
    while not every.where("up IS NOT NULL AND NOT bad").isEmpty():
        look = every.select(*keys, F.col("node").alias("up"), F.col("up").alias("next"), F.col("bad").alias("above"))
        every = cut(every.join(look, [*keys, "up"], "left").select(*keys, "node", F.when(~F.col("bad"), F.col("next")).alias("up"), (F.col("bad") | F.coalesce("above", F.lit(False))).alias("bad")))
    own = every.where("bad").select("facility_type", "node")
    return own.join(habitations.select(F.col("node_id").alias("node")), "node").select("facility_type", "node")


class Graph:
    """A small road graph as arrays, for solving many failure sets at once."""

    def __init__(self, edges: list[tuple], habitations: list[tuple], facilities: list[tuple], services: list[tuple]):
        names: dict = {}
        at = lambda n: names.setdefault(n, len(names))
        ends = [(at(u), at(v), float(w)) for u, v, w in edges]
        self.homes = np.array([at(n) for n, _ in habitations], int)
        self.people = np.array([p for _, p in habitations], float)
        self.services = {k: (float(cap), float(weight), [at(n) for t, n in facilities if t == k]) for k, cap, weight in services}
        self.names, self.n = names, len(names)
        self.u = np.array([e[0] for e in ends] + [e[1] for e in ends], int)
        self.v = np.array([e[1] for e in ends] + [e[0] for e in ends], int)
        self.w = np.array([e[2] for e in ends] * 2, float)
        order = np.argsort(self.v, kind="stable")
        self.u, self.v, self.w = self.u[order], self.v[order], self.w[order]
        self.first = np.flatnonzero(np.r_[True, self.v[1:] != self.v[:-1]]) if len(self.v) else np.zeros(0, int)
        self.into = self.v[self.first] if len(self.v) else np.zeros(0, int)
        self.arcs: dict[tuple[int, int], list[int]] = {}
        for i, (x, y) in enumerate(zip(self.u.tolist(), self.v.tolist(), strict=True)):
            self.arcs.setdefault((min(x, y), max(x, y)), []).append(i)
        #: Sets that are solved together.
        self.step = max(1, min(2048, HELD // max(1, self.n, len(self.w))))
        self.base = {k: self._share(self.times(places, np.zeros((1, self.n), bool)), cap)[0] for k, (cap, _, places) in self.services.items()}

    @classmethod
    def small(cls, edges: DataFrame, habitations: DataFrame, facilities: DataFrame, services: DataFrame) -> Graph | None:
        """The graph, or None if it is too large to go along."""
        tables = (
            edges.select("src", "dst", F.coalesce("travel_time_min", F.lit(1.0))), habitations.select("node_id", "population"),
            facilities.select("facility_type", "node_id"), services.select("facility_type", "cap_min", "weight"),
        )
        rows = []
        for t in tables:
            rows.append([tuple(r) for r in t.limit(SMALL_EDGES + 1).collect()])
            if len(rows[-1]) > SMALL_EDGES:
                return None
        return cls(*rows)

    @classmethod
    def collect(cls, edges: DataFrame, habitations: DataFrame, facilities: DataFrame, services: DataFrame) -> Graph:
        graph = cls.small(edges, habitations, facilities, services)
        if graph is None:
            raise ValueError("this graph is too large to go along; use losses() or Roads")
        return graph

    def times(self, places: list[int], blocked: np.ndarray, cuts: np.ndarray | None = None) -> np.ndarray:
        """Least time to ``places`` for each row of ``blocked`` (sets x nodes) and ``cuts`` (sets x arcs): all sets relax together."""
        d = np.full(blocked.shape, INF)
        d[:, places] = 0.0
        d[blocked] = INF
        w = self.w if cuts is None else np.where(cuts, INF, self.w)
        while len(self.v):
            reach = d.copy()
            reach[:, self.into] = np.minimum(d[:, self.into], np.minimum.reduceat(d[:, self.u] + w, self.first, axis=1))
            reach[blocked] = INF
            if (reach == d).all():
                break
            d = reach
        return d[:, self.homes]

    @staticmethod
    def _share(times: np.ndarray, cap: float) -> np.ndarray:
        return np.where(times >= cap, 1.0, times / cap)

    def failed(self, nodes: list, cuts: list | None = None, validate: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """What ``losses`` takes, of each set's nodes and edges. Unknown ones are a ``KeyError`` on demand, else nothing."""
        blocked = np.zeros((len(nodes), self.n), bool)
        for i, own in enumerate(nodes):
            if validate and (unknown := [n for n in own if n not in self.names]):
                raise KeyError(f"a failed node isn't in the network: {unknown[0]!r}")
            blocked[i, [self.names[n] for n in own if n in self.names]] = True
        if cuts is None or not any(map(len, cuts)):
            return blocked, None
        off = np.zeros((len(nodes), len(self.w)), bool)
        for i, own in enumerate(cuts):
            for u, v in own:
                ends = sorted((self.names.get(u, -1), self.names.get(v, -1)))
                if validate and tuple(ends) not in self.arcs:
                    raise KeyError(f"a failed edge isn't in the network: {(u, v)!r}")
                off[i, self.arcs.get(tuple(ends), [])] = True
        return blocked, off

    def losses(self, blocked: np.ndarray, cuts: np.ndarray | None = None) -> np.ndarray:
        total = np.zeros(len(blocked))
        for k, (cap, weight, places) in self.services.items():
            worse = np.maximum(self._share(self.times(places, blocked, cuts), cap) - self.base[k], 0.0)
            total += (worse * self.people * weight).sum(axis=1)
        return total

    def loss_of(self, nodes: list = (), edges: list[tuple] = (), validate: bool = False) -> float:
        return float(self.losses(*self.failed([nodes], [edges], validate))[0])

    def solo(self, nodes: list) -> list[float]:
        """The loss of each node alone."""
        return [x for i in range(0, len(nodes), self.step) for x in self.losses(*self.failed([[n] for n in nodes[i : i + self.step]])).tolist()]

    def set_losses(self, sets: DataFrame, nodes: list) -> DataFrame:
        """``failed, loss``: ``failed`` holds the places in ``nodes`` of those that fail."""
        given = sets.sparkSession.sparkContext.broadcast((self, list(nodes)))  # SMALL_EDGES at most

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            graph, names = given.value
            for x in frames:
                for i in range(0, len(x), graph.step):
                    own = x["failed"].iloc[i : i + graph.step]
                    yield pd.DataFrame({"failed": own, "loss": graph.losses(*graph.failed([[names[k] for k in f] for f in own]))})

        return sets.select("failed").mapInPandas(run, "failed array<int>, loss double")


@dataclass
class Roads:
    """A network of any size for the same questions, as tables."""

    edges: DataFrame
    habitations: DataFrame
    facilities: DataFrame
    services: DataFrame

    def set_losses(self, sets: DataFrame, nodes: list) -> DataFrame:
        spark = sets.sparkSession
        keyed = sets.select("failed").distinct().withColumn("set_id", F.concat_ws(",", F.col("failed").cast("array<string>")))
        names = spark.createDataFrame(list(enumerate(nodes)), f"place int, node {self.edges.schema['src'].dataType.simpleString()}")
        gone = keyed.select("set_id", F.explode("failed").alias("place")).join(F.broadcast(names), "place").select("set_id", "node")  # the structures
        out = losses(self.edges, self.habitations, self.facilities, self.services, keyed.select("set_id"), gone, small=False)
        return keyed.join(out, "set_id").select("failed", "loss")

    def solo(self, nodes: list) -> list[float]:
        spark = self.edges.sparkSession
        one = spark.createDataFrame([([i],) for i in range(len(nodes))], "failed array<int>")
        return [r[1] for r in sorted(map(tuple, self.set_losses(one, nodes).collect()))] if nodes else []


def subsets(spark, n: int) -> DataFrame:
    """``mask, failed``: every set of ``n`` structures, as bits and as places."""
    masks = spark.range(1 << n).select(F.col("id").alias("mask"))
    places = F.array(*(F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.lit(i)) for i in range(n))) if n else F.array().cast("array<int>")
    return masks.withColumn("failed", F.filter(places, lambda i: i.isNotNull()))


def societal_cost(loss, days):
    return loss * days
