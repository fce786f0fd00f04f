"""K-means of a weighted sketch on the driver: a grid of runs, in threads."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np

from veldra.operators.centers import Centers
from veldra.operators.sampling import weighted_draws, weighted_pick

Init = Callable[[np.ndarray, np.ndarray, int, np.random.Generator], np.ndarray]
Update = Callable[[np.ndarray, np.ndarray, np.ndarray, np.random.Generator], np.ndarray]


def random_init(x: np.ndarray, w: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    return x[weighted_pick(w, k, rng)]


def plus_plus(x: np.ndarray, w: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """The first center by weight, each next one by weight times squared distance to those chosen."""
    chosen = [int(weighted_draws(w, 1, rng)[0])]
    d2 = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < k and (d2 * w).sum() > 0:
        nxt = int(weighted_draws(w * d2, 1, rng)[0])
        chosen.append(nxt)
        d2 = np.minimum(d2, ((x - x[nxt]) ** 2).sum(1))
    return x[chosen]


def weighted_centroid(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return (x * w[:, None]).sum(0) / w.sum()


def lloyds(iterations: int) -> Update:
    """Exactly ``iterations`` rounds; a center without points stays."""

    def update(x, w, centers, rng):
        for _ in range(iterations):
            at, _ = Centers(centers).closest(x)
            now = Centers(centers).points
            centers = np.array([weighted_centroid(x[at == i], w[at == i]) if w[at == i].sum() > 0 else now[i] for i in range(len(now))])
        return centers

    return update


def mini_batch(iterations: int, size: int) -> Update:
    """Rounds of ``size`` draws by weight; each point pulls its center by 1 / (its count + 1)."""

    def update(x, w, centers, rng):
        centers = np.array(centers, float)
        counts = np.zeros(len(centers))
        for _ in range(iterations):
            batch = x[weighted_draws(w, size, rng)]
            at = ((batch[:, None] - centers) ** 2).sum(2).argmin(1)
            for p, i in zip(batch, at):
                counts[i] += 1
                eta = 1 / (counts[i] + 1)
                centers[i] = (1 - eta) * centers[i] + eta * p
        return centers

    return update


INITS: dict[str, Init] = {"random": random_init, "plus_plus": plus_plus}


def kmeans(x: np.ndarray, w: np.ndarray, k: int, init: Init | str = "plus_plus", update: Update | None = None, seed: int = 1729) -> Centers:
    """One clustering; fewer than ``k`` centers if points coincide."""
    rng = np.random.default_rng(seed)
    start = (INITS[init.lower()] if isinstance(init, str) else init)(x, w, k, rng)
    return Centers((update or lloyds(100))(x, w, start, rng))


def grid(x: np.ndarray, w: np.ndarray, ks: Sequence[int], best_of: int = 5, seed: int = 1729, threads: int = 4, **how) -> list[Centers]:
    """Runs in order: for each K its ``best_of`` runs (one for K = 1), run i with seed + K + i."""
    runs = [(k, i) for k in ks for i in range(1 if k == 1 else best_of)]
    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(lambda r: kmeans(x, w, r[0], seed=seed + r[0] + r[1], **how), runs))


def select_best(clusterings: Sequence[Centers], x: np.ndarray, w: np.ndarray) -> int:
    """Place of the clustering of least weighted cost."""
    return int(np.argmin([(c.closest(x)[1] * w).sum() for c in clusterings]))
