"""Genetic search over discrete, integer and float settings."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Setting:
    """A searched setting: ``levels``, or ``n`` levels from low to high (integers by kind 'integer')."""

    name: str
    kind: str
    low: float = 0.0
    high: float = 1.0
    n: int = 0
    levels: tuple = ()

    def values(self) -> list:
        if self.kind == "discrete":
            return list(self.levels)
        n = self.n or int(self.high - self.low) + 1
        x = np.linspace(self.low, self.high, n)
        return [int(np.floor(v + 1e-9)) for v in x] if self.kind == "integer" else x.tolist()

    @property
    def bits(self) -> int:
        return max(1, (len(self.values()) - 1).bit_length())


def gray(k: int) -> int:
    return k ^ (k >> 1)


def ungray(g: int) -> int:
    k = 0
    while g:
        k ^= g
        g >>= 1
    return k


def decode(bits: np.ndarray, settings: list[Setting]) -> dict:
    """Settings of a Gray-coded genome; codes beyond the last level stand for the last."""
    out, at = {}, 0
    for s in settings:
        code = int("".join(map(str, bits[at : at + s.bits])), 2)
        v = s.values()
        out[s.name] = v[min(ungray(code), len(v) - 1)]
        at += s.bits
    return out


def encode(values: dict, settings: list[Setting]) -> np.ndarray:
    """Genome of the levels nearest to the values."""
    out: list[int] = []
    for s in settings:
        v = s.values()
        k = v.index(values[s.name]) if s.kind == "discrete" else int(np.argmin([abs(x - values[s.name]) for x in v]))
        out += [int(b) for b in format(gray(k), f"0{s.bits}b")]
    return np.array(out)


def optimise(fitness: Callable[[dict], float], settings: list[Setting], minimise: bool = True, population: int = 50, generations: int = 100, crossover: float = 0.8, mutation: float = 0.1, elite: float = 0.05, patience: int = 20, seed: int = 1, threads: int = 1, suggestions: list[dict] | None = None) -> tuple[dict, float]:
    """The best settings and their fitness. Genomes seen before aren't evaluated again; non-finite fitness never wins.

    Tournaments of three, crossover that swaps whole settings, bit mutation, elitism. ``threads``
    evaluates a generation side by side, for fitness functions that run Spark jobs.
    """
    rng = np.random.default_rng(seed)
    size = sum(s.bits for s in settings)
    ends = np.cumsum([s.bits for s in settings])
    pop = rng.integers(0, 2, (population, size))
    for i, x in enumerate(suggestions or []):
        pop[i % population] = encode(x, settings)
    known: dict[tuple, float] = {}
    best, stale = (-np.inf, None), 0
    with ThreadPoolExecutor(threads) as pool:
        for _ in range(generations):
            new = list({tuple(decode(g, settings).items()) for g in pop} - set(known))
            for key, f in zip(new, pool.map(lambda k: fitness(dict(k)), new), strict=True):
                known[key] = (-f if minimise else f) if f is not None and np.isfinite(f) else -np.inf
            score = np.array([known[tuple(decode(g, settings).items())] for g in pop])
            top = int(np.argmax(score))
            stale = 0 if score[top] > best[0] else stale + 1
            if score[top] > best[0]:
                best = (score[top], decode(pop[top], settings))
            if stale >= patience:
                break
            keep = pop[np.argsort(-score)[: max(1, round(elite * population))]]
            pick = rng.integers(0, population, (population, 3))
            parents = pop[pick[np.arange(population), score[pick].argmax(1)]]
            for i in range(0, population - 1, 2):
                if rng.random() < crossover:
                    for a, z in zip([0, *ends[:-1]], ends, strict=True):
                        if rng.random() < 0.5:
                            parents[[i, i + 1], a:z] = parents[[i + 1, i], a:z]
            hit = rng.random(population) < mutation
            parents[hit, rng.integers(0, size, population)[hit]] ^= 1
            parents[: len(keep)] = keep
            pop = parents
    if best[1] is None:
        return {s.name: None for s in settings}, float("nan")
    return best[1], float(-best[0] if minimise else best[0])
