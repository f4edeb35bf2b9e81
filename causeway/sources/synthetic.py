"""Synthetic districts and scenario sets. The random draws are numpy's, in a fixed order, so
that a seed gives the same district and scenarios everywhere; the tables are small."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from causeway import schema
from causeway.functions.scalars import CLASS_SPEEDS

TYPES = ("culvert", "minor_bridge", "major_bridge")


@dataclass
class District:
    nodes: dict = field(default_factory=dict)  # id -> (x, y, kind)
    ways: dict = field(default_factory=dict)  # id -> {neighbour: (length_m, minutes)}, in order of insertion
    habitations: dict = field(default_factory=dict)  # id -> population
    facilities: list = field(default_factory=list)  # (type, id)
    structures: list = field(default_factory=list)  # (asset id, node, type)
    corridors: dict = field(default_factory=dict)  # asset id -> number, where the district has corridors
    budget_crore: float = 100.0
    crew_days: float = 500.0
    speed_kph: float = CLASS_SPEEDS["rural"]

    def add_node(self, n, x: float, y: float, kind: str = "junction") -> None:
        self.nodes[n] = (float(x), float(y), kind)
        self.ways.setdefault(n, {})

    def add_road(self, u, v, length: float, minutes: float | None = None) -> None:
        minutes = length / 1000.0 / self.speed_kph * 60.0 if minutes is None else minutes
        self.ways[u][v] = self.ways[v][u] = (float(length), minutes)

    def edges(self) -> list[tuple]:
        """Each edge once, from the end that was inserted first, neighbours in order."""
        seen, out = set(), []
        for u, near in self.ways.items():
            out += [(u, v) for v in near if v not in seen]
            seen.add(u)
        return out

    def put_structure(self, asset: str, u, v, fraction: float, kind: str) -> None:
        """Split the edge at ``fraction`` from ``u``; its halves share length and time."""
        length, minutes = self.ways[u].pop(v)
        del self.ways[v][u]
        (ux, uy, _), (vx, vy, _) = self.nodes[u], self.nodes[v]
        node = f"structure:{asset}"
        self.add_node(node, ux + fraction * (vx - ux), uy + fraction * (vy - uy), "structure")
        self.add_road(u, node, length * fraction, minutes * fraction)
        self.add_road(node, v, length * (1 - fraction), minutes * (1 - fraction))
        self.structures.append((asset, node, kind))

    def settle(self, n, use: str, people: float | None = None) -> None:
        """Make a junction a habitation of ``people``, or a facility of type ``use``."""
        x, y, _ = self.nodes[n]
        self.nodes[n] = (x, y, "facility" if people is None else use)
        if people is None:
            self.facilities.append((use, n))
        else:
            self.habitations[n] = people

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        make = lambda rows, s: spark.createDataFrame(rows, s)
        ends = lambda u, v: tuple(sorted((str(u), str(v))))
        return {
            "nodes": make([(str(n), *at) for n, at in self.nodes.items()], schema.NODES),
            "edges": make([(*ends(u, v), self.ways[u][v][0], "rural", self.speed_kph, self.ways[u][v][1]) for u, v in self.edges()], schema.EDGES),
            "habitations": make([(str(n), p) for n, p in self.habitations.items()], schema.HABITATIONS),
            "facilities": make([(t, str(n)) for t, n in self.facilities], schema.FACILITIES),
            "structures": make([(i, a, str(n), t) for i, (a, n, t) in enumerate(self.structures)], schema.STRUCTURES),
        }


def _wire(d: District, rng: np.random.Generator, chords: int) -> None:
    """Roads of random length: a random tree over all nodes, then chords between random pairs that lack one."""
    turn = list(d.nodes)
    rng.shuffle(turn)
    length = lambda: rng.uniform(800, 4000)
    for known in range(1, len(turn)):
        d.add_road(turn[known], turn[rng.integers(0, known)], length())
    for pair in (rng.integers(0, len(turn), 2).tolist() for _ in range(chords)):
        if len(set(pair)) == 2 and pair[1] not in d.ways[pair[0]]:
            d.add_road(*pair, length())


def make_district(n_junctions: int = 24, n_habitations: int = 14, n_structures: int = 10, seed: int = 0, spacing_m: float = 3000.0, class_speeds: dict | None = None) -> District:
    """A connected district on a jittered grid: a random tree, some chords, four facilities, structures on random edges."""
    rng, d = np.random.default_rng(seed), District(speed_kph=(class_speeds or CLASS_SPEEDS)["rural"])
    side = math.ceil(math.sqrt(n_junctions))
    grid = np.array([(i % side, i // side) for i in range(n_junctions)]).reshape(-1, 2) * spacing_m
    for n, at in enumerate(grid + rng.uniform(0, 0.4 * spacing_m, (n_junctions, 2))):
        d.add_node(n, *at)
    _wire(d, rng, n_junctions // 3)
    free = list(d.nodes)
    rng.shuffle(free)
    for n, use in zip(free, ["habitation"] * n_habitations + ["health"] * 2 + ["school"] * 2, strict=False):
        d.settle(n, use, float(rng.integers(50, 800)) if use == "habitation" else None)
    bridged = d.edges()
    rng.shuffle(bridged)
    for i, (ends, kind) in enumerate(zip(bridged[:n_structures], itertools.cycle(TYPES), strict=False)):
        d.put_structure(f"S{i}", *ends, float(rng.uniform(0.25, 0.75)), kind)
    return d


def make_redundant_district(n_corridors: int = 3, redundancy: int = 2, seed: int = 0, population: float = 400.0, route_length_m: float = 1200.0, class_speeds: dict | None = None) -> District:
    """Corridors of parallel routes to one facility, a culvert on each: harmless alone, cut off together. No randomness."""
    d = District(budget_crore=1.0, crew_days=200.0, speed_kph=(class_speeds or CLASS_SPEEDS)["rural"])
    d.add_node("F", 0, 0, "facility")
    d.facilities.append(("health", "F"))
    for c in range(n_corridors):
        h = f"H{c}"
        d.add_node(h, 5000, 1500 * c, "habitation")
        d.habitations[h] = population
        for i in range(redundancy):
            j = f"{h}_j{i}"
            d.add_node(j, 2500, 1500 * c + 30 * i)
            d.add_road(h, j, route_length_m)
            d.add_road(j, "F", route_length_m)
            d.put_structure(asset := f"S{c * redundancy + i}", j, "F", 0.5, "culvert")
            d.corridors[asset] = c
    return d


@dataclass
class Scenarios:
    """Common random numbers, as arrays of scenario x year x asset."""

    rain: np.ndarray
    det_u: np.ndarray
    fail_u: np.ndarray

    @property
    def years(self) -> int:
        return self.rain.shape[1]

    def table(self, spark: SparkSession) -> DataFrame:
        """``s`` and nested arrays [year][asset]: a row a scenario."""
        rows = [(s, self.rain[s].tolist(), self.det_u[s].tolist(), self.fail_u[s].tolist()) for s in range(len(self.rain))]
        kind = "array<array<double>>"
        return spark.createDataFrame(rows, f"s int, rain {kind}, det_u {kind}, fail_u {kind}")

    def facts(self, spark: SparkSession) -> DataFrame:
        """Long form: ``s, y, ord, rain, det_u, fail_u``."""
        rows = [(s, y, a, *(float(x[s, y, a]) for x in (self.rain, self.det_u, self.fail_u))) for s, y, a in np.ndindex(*self.rain.shape)]
        return spark.createDataFrame(rows, schema.SCENARIOS)


@dataclass
class ScenarioTable:
    """The same as a relation of any size: ``s``, and ``rain, det_u, fail_u`` as nested arrays [year][asset]."""

    rows: DataFrame
    years: int

    def table(self, spark: SparkSession) -> DataFrame:
        return self.rows


def make_scenarios(n_assets: int, years: int, n: int, rng: np.random.Generator | int, rain: np.ndarray | None = None) -> Scenarios:
    """Rain ratios (given, or lognormal), then all deterioration and then all failure numbers."""
    rng = np.random.default_rng(rng)
    shape = (n, years, n_assets)
    if rain is not None and np.shape(rain) != shape:
        raise ValueError(f"rain has the shape {np.shape(rain)}, not {shape}")
    rain = np.exp(rng.normal(0.0, 0.4, size=shape)) if rain is None else np.asarray(rain, float)
    return Scenarios(rain, rng.random(shape), rng.random(shape))
