"""Allocation optimisers: one repair option per asset under a budget and a crew limit.

An instance is a few assets; many instances (one per distinct condition vector) are
solved in parallel, each inside its own row.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from causeway.functions import scalars as S
from causeway.operators.access import Graph

N_OPTIONS = len(S.OPTIONS)
TOLERANCE = 1e-9


@dataclass
class Instance:
    """``cost``, ``labour``: assets x options; ``loss``: assets x options x scenarios."""

    cost: np.ndarray
    labour: np.ndarray
    loss: np.ndarray

    @classmethod
    def flat(cls, cost, labour, loss, groups) -> Instance:
        """From flat variables and groups of equal size."""
        pick = lambda x: np.asarray(x, float)[np.asarray(groups)]
        return cls(pick(cost), pick(labour), pick(loss))

    def take(self, choice) -> tuple[float, float, np.ndarray]:
        at = np.arange(len(self.cost))
        return float(self.cost[at, choice].sum()), float(self.labour[at, choice].sum()), self.loss[at, choice].sum(axis=0)

    def feasible(self, choice, budget: float, crew: float, tol: float = 1e-6) -> bool:
        cost, labour, _ = self.take(choice)
        return cost <= budget + tol and labour <= crew + tol

    def objective(self, choice, lam: float = 0.0, alpha: float = 0.05) -> float:
        """Mean loss plus ``lam`` times the mean of its worst ``alpha`` share."""
        loss = self.take(choice)[2]
        return float(loss.mean()) + (lam * cvar(loss, alpha) if lam else 0.0)


def cvar(losses, alpha: float = 0.05) -> float:
    if not 0 < alpha <= 1:
        raise ValueError("alpha is in (0, 1]")
    x = np.sort(np.asarray(losses, float))[::-1]
    return float(x[: max(1, int(np.ceil(alpha * x.size)))].mean())


def tail_term(loss: np.ndarray, alpha: float) -> float:
    """Least eta + mean excess over eta / (1 - alpha), which is reached at one of the losses."""
    eta = np.sort(loss)
    above = np.concatenate([np.cumsum(eta[::-1])[::-1][1:], [0.0]]) - eta * np.arange(len(eta) - 1, -1, -1)
    return float((eta + above / ((1 - alpha) * len(eta))).min())


def solve(inst: Instance, budget: float, crew: float, lam: float = 0.0, alpha: float = 0.05, time_limit: float | None = None) -> list[int]:
    """The exact optimum of mean + lam x tail term; of equals the cheapest, then the lower options.

    With a ``time_limit`` in seconds, the best plan found until then by depth-first search.
    """
    return _frontier(inst, budget, crew) if lam == 0 and time_limit is None else _branch(inst, budget, crew, lam, alpha, time_limit)


def _frontier(inst: Instance, budget: float, crew: float) -> list[int]:
    """Asset by asset, the plans that no other beats in cost, labour and mean loss together."""
    mean = inst.loss.mean(axis=2)
    cost, labour, loss = np.zeros(1), np.zeros(1), np.zeros(1)
    plans = np.zeros((1, 0), np.int8)
    n = len(inst.cost)
    floor = np.r_[np.cumsum(inst.cost.min(axis=1)[::-1])[::-1], 0.0], np.r_[np.cumsum(inst.labour.min(axis=1)[::-1])[::-1], 0.0]
    for a in range(n):
        c, w, v = ((x[:, None] + y[a][None, :]).ravel() for x, y in ((cost, inst.cost), (labour, inst.labour), (loss, mean)))
        p = np.concatenate([np.repeat(plans, N_OPTIONS if inst.cost.shape[1] == N_OPTIONS else inst.cost.shape[1], axis=0), np.tile(np.arange(inst.cost.shape[1], dtype=np.int8), len(cost))[:, None]], axis=1)
        ok = (c + floor[0][a + 1] <= budget + TOLERANCE) & (w + floor[1][a + 1] <= crew + TOLERANCE)
        c, w, v, p = c[ok], w[ok], v[ok], p[ok]
        keep = _undominated(c, w, v)
        cost, labour, loss, plans = c[keep], w[keep], v[keep], p[keep]
    if not len(cost):
        raise ValueError("no plan fits the budget and the crew")
    near = np.flatnonzero(loss <= loss.min() + TOLERANCE)
    best = near[np.lexsort((*plans[near].T[::-1], np.round(cost[near], 12)))[0]]
    return plans[best].astype(int).tolist()


def _undominated(c: np.ndarray, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    order = np.lexsort((w, v, np.round(c, 12)))
    keep: list[int] = []
    front_w, front_v = np.zeros(0), np.zeros(0)
    for i in order:
        if len(front_w) and ((front_w <= w[i] + 1e-12) & (front_v <= v[i] + 1e-15)).any():
            continue
        keep.append(i)
        still = ~((front_w >= w[i]) & (front_v >= v[i]))
        front_w, front_v = np.r_[front_w[still], w[i]], np.r_[front_v[still], v[i]]
    return np.array(keep, int)


def _branch(inst: Instance, budget: float, crew: float, lam: float, alpha: float, time_limit: float | None = None) -> list[int]:
    """Depth first; a branch is bounded by giving every open asset its least loss in each scenario."""
    n, best, plan = len(inst.cost), np.inf, None
    least = inst.loss.min(axis=1)
    rest = np.vstack([np.cumsum(least[::-1], axis=0)[::-1], np.zeros(inst.loss.shape[2])])
    room_c = np.r_[np.cumsum(inst.cost.min(axis=1)[::-1])[::-1], 0.0]
    room_w = np.r_[np.cumsum(inst.labour.min(axis=1)[::-1])[::-1], 0.0]
    value = lambda x: float(x.mean()) + (lam * tail_term(x, alpha) if lam else 0.0)
    end = None if time_limit is None else time.monotonic() + time_limit
    stack: list[tuple[list[int], float, float, np.ndarray]] = [([], 0.0, 0.0, np.zeros(inst.loss.shape[2]))]
    while stack and not (end and plan is not None and time.monotonic() > end):
        chosen, c, w, x = stack.pop()
        a = len(chosen)
        bound = value(x + rest[a])
        if bound >= best - 1e-12:
            continue
        if a == n:
            best, plan = bound, chosen
            continue
        for j in np.argsort(-inst.loss[a].mean(axis=1), kind="stable"):
            cj, wj = c + inst.cost[a, j], w + inst.labour[a, j]
            if cj + room_c[a + 1] <= budget + TOLERANCE and wj + room_w[a + 1] <= crew + TOLERANCE:
                stack.append(([*chosen, int(j)], cj, wj, x + inst.loss[a, j]))
    if plan is None:
        raise ValueError("no plan fits the budget and the crew")
    return plan


def local_search(n: int, start: list[int], objective: Callable[[list[int]], float], options: int = N_OPTIONS, sweeps: int = 100) -> tuple[list[int], float]:
    """Asset by asset, the best other option if it gains; sweeps until none does."""
    choice, value = list(start), objective(start)
    for _ in range(sweeps):
        moved = False
        for a in range(n):
            trials = [(objective([*choice[:a], j, *choice[a + 1 :]]), j) for j in range(options) if j != choice[a]]
            best = (value, choice[a])
            for v, j in trials:
                if v < best[0] - 1e-12:
                    best = (v, j)
            if best[1] != choice[a]:
                value, choice[a], moved = best[0], best[1], True
        if not moved:
            break
    return choice, value


class Planner:
    """Yearly plans for condition vectors, under a sample of rain and fixed failure numbers.

    ``additive`` minimises expected loss as if each asset failed alone; ``network_aware``
    goes on from there with the loss of the failing sets, and keeps the first plan if a
    move left the budget.
    """

    def __init__(
        self, types: list[str], outage: list[float], nodes: list, graph: Graph, rain: np.ndarray, seed: int, budget: float, crew: float,
        fragility=(-3.0, 1.2, 2.0), lam: float = 0.0, alpha: float = 0.05, penalty: float = 1e6, time_limit: float | None = None, u: np.ndarray | None = None,
    ):
        """``rain``: samples x assets; ``u``: assets x samples, the failures' numbers (drawn from ``seed`` by default)."""
        self.cost = np.array([[S.BASE_COST_CRORE[t] * S.COST_MULTIPLE[o] for o in S.OPTIONS] for t in types])
        self.labour = np.array([[S.LABOUR_DAYS[t] * S.LABOUR_MULTIPLE[o] for o in S.OPTIONS] for t in types])
        self.outage, self.graph, self.rain = np.array(outage, float), graph, np.maximum(np.asarray(rain, float), 1e-9)
        self.at = np.array([graph.names[n] for n in nodes], int)
        self.u = np.random.default_rng(seed).random((self.rain.shape[1], self.rain.shape[0])) if u is None else np.asarray(u, float)
        self.budget, self.crew, self.fragility, self.lam, self.alpha, self.penalty, self.time_limit = budget, crew, fragility, lam, alpha, penalty, time_limit
        self.solo = np.array(graph.solo(nodes))
        self.factor = np.array([S.fragility_factor(o) for o in S.OPTIONS])
        self.known: dict[bytes, float] = {}

    def probabilities(self, condition: list[int]) -> np.ndarray:
        """p[asset, option, scenario]."""
        after = np.array([[max(0, min(3, round(c - S.RESET[o]))) for o in S.OPTIONS] for c in condition], float)
        b0, b1, b2 = self.fragility
        x = b0 + b1 * after[:, :, None] + b2 * np.log(self.rain.T)[:, None, :]
        return self.factor[None, :, None] / (1 + np.exp(-x))

    def instance(self, condition: list[int]) -> Instance:
        return Instance(self.cost, self.labour, self.probabilities(condition) * (self.outage * self.solo)[:, None, None])

    def set_losses(self, fails: np.ndarray) -> np.ndarray:
        """The loss of each row's set (rows x assets); each distinct set is solved once."""
        keys = [r.tobytes() for r in np.packbits(fails, axis=1)]
        new = {k: i for i, k in enumerate(keys) if k not in self.known}
        at = list(new.values())
        for i in range(0, len(at), self.graph.step):
            blocked = np.zeros((len(at[i : i + self.graph.step]), self.graph.n), bool)
            blocked[:, self.at] = fails[at[i : i + self.graph.step]]
            self.known.update(zip(list(new)[i : i + self.graph.step], self.graph.losses(blocked).tolist(), strict=True))
        return np.array([self.known[k] for k in keys])

    def objective(self, condition: list[int]) -> Callable[[list[int]], float]:
        fails = self.u[:, None, :] < self.probabilities(condition)
        at = np.arange(len(condition))

        def value(choice: list[int]) -> float:
            f = fails[at, choice]
            n = f.sum(axis=0)
            outage = np.divide((f * self.outage[:, None]).sum(axis=0), n, out=np.zeros(len(n)), where=n > 0)
            v = float((outage * self.set_losses(f.T)).sum() / len(n))
            spent, used = float(self.cost[at, choice].sum()), float(self.labour[at, choice].sum())
            return v + self.penalty * (max(0.0, spent - self.budget) + max(0.0, used - self.crew))

        return value

    def additive(self, condition: list[int]) -> list[int]:
        return solve(self.instance(condition), self.budget, self.crew, self.lam, self.alpha, self.time_limit)

    def network_aware(self, condition: list[int]) -> list[int]:
        start = self.additive(condition)
        choice, _ = local_search(len(condition), start, self.objective(condition))
        return choice if self.instance(condition).feasible(choice, self.budget, self.crew) else start
