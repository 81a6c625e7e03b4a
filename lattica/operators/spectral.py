"""Eigenvalues and what follows from them, a component at a time, on dense matrices up to a stated number of edges."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.graph import Graph
from lattica.operators.kernels import per_component
from lattica.operators.layout import _steps

MOST_EDGES = 20_000


def _matrix(vertices: list[int], edges: list[tuple[int, int, int]]) -> np.ndarray:
    at = {v: i for i, v in enumerate(vertices)}
    a = np.zeros((len(vertices), len(vertices)))
    for _, x, y in edges:
        if x != y:
            a[at[x], at[y]] += 1
            a[at[y], at[x]] += 1
    return a


def matrices(vertices: list[int], edges: list[tuple[int, int, int]]) -> dict[str, np.ndarray]:
    """Adjacency, Laplacian, signless and normalized Laplacian, and distances."""
    a = _matrix(vertices, edges)
    d = a.sum(1)
    root = np.divide(1, np.sqrt(d), out=np.zeros_like(d), where=d > 0)
    return {"adjacency": a, "laplacian": np.diag(d) - a, "signless": np.diag(d) + a, "normalized": np.diag((d > 0).astype(float)) - root[:, None] * a * root, "distance": _steps(vertices, edges).astype(float)}


def spectra(g: Graph, kinds: tuple[str, ...] = ("adjacency", "laplacian", "signless", "normalized", "distance"), most_edges: int = MOST_EDGES) -> DataFrame:
    """(component, kind, i, value): the spectrum of each matrix, ascending. Undirected graphs, loops left out."""

    def kernel(vertices, edges):
        made = matrices(vertices, edges)
        for kind in kinds:
            for i, x in enumerate(np.linalg.eigvalsh(made[kind])):
                yield vertices[0], kind, i, float(x)

    return per_component(g, kernel, "component long, kind string, i long, value double", most_edges)


def spectral_profile(g: Graph, most_edges: int = MOST_EDGES) -> DataFrame:
    """(component, name, value): gaps, radii, energies and ratios of the spectra of each component."""

    def kernel(vertices, edges):
        n, m = len(vertices), sum(a != b for _, a, b in edges)
        made = {k: np.linalg.eigvalsh(x) for k, x in matrices(vertices, edges).items()}
        a, lap, q, norm, dist = (made[k] for k in ("adjacency", "laplacian", "signless", "normalized", "distance"))
        mean = 2 * m / n
        top = max(np.bincount(np.array([x for _, s, t in edges if s != t for x in (vertices.index(s), vertices.index(t))], int), minlength=n)) if m else 0
        second = norm[1] if n > 1 else 0.0
        trees = float(np.log(lap[1:]).sum() - math.log(n)) if n > 1 and lap[1] > 1e-10 else 0.0
        facts = {
            "spectral_gap": a[-1] - a[-2] if n > 1 else 0.0, "adjacency_spectral_gap_ratio": (a[-1] - a[-2]) / a[-1] if n > 1 and a[-1] > 1e-12 else 0.0, "spectral_radius_ratio": a[-1] / math.sqrt(top * (n - 1)) if n > 1 and top else 0.0,
            "energy_ratio": np.abs(a).sum() / (n * math.sqrt(mean)) if m else 0.0, "collatz_sinogowitz": a[-1] - mean, "normalized_algebraic_connectivity": second, "cheeger_lower": second / 2, "cheeger_upper": math.sqrt(max(0.0, 2 * second)),
            "spectral_gap_ratio": second / norm[-1] if norm[-1] > 1e-12 else 0.0, "bipartiteness_ratio": (2 - norm[-1]) / 2, "signless_laplacian_smallest": q[0], "signless_laplacian_spectral_radius": q[-1], "signless_laplacian_energy": np.abs(q - mean).sum(),
            "distance_spectral_radius": dist[-1], "distance_energy": np.abs(dist).sum(), "distance_estrada_index": np.exp(dist).sum(), "spanning_tree_ratio": min(1.0, max(0.0, trees / ((n - 1) * math.log(n)))) if n > 1 else 0.0,
        }
        yield from ((vertices[0], name, float(x)) for name, x in facts.items())

    return per_component(g, kernel, "component long, name string, value double", most_edges)


def _inverse(vertices, edges) -> np.ndarray:
    return np.linalg.pinv(matrices(vertices, edges)["laplacian"], hermitian=True)


def effective_resistances(g: Graph, most_edges: int = MOST_EDGES) -> DataFrame:
    """(u, v, resistance) of the pairs u < v of each component, each edge a resistor of one ohm."""

    def kernel(vertices, edges):
        x = _inverse(vertices, edges)
        d = np.diag(x)
        r = d[:, None] + d - 2 * x
        for i, u in enumerate(vertices):
            for j in range(i + 1, len(vertices)):
                yield u, vertices[j], float(r[i, j])

    return per_component(g, kernel, "u long, v long, resistance double", most_edges)


def resistance_centrality(g: Graph, most_edges: int = MOST_EDGES) -> DataFrame:
    """(v, centrality): n - 1 over the sum of the resistances to the other vertices of the component; 0 for a lone vertex."""

    def kernel(vertices, edges):
        x, n = _inverse(vertices, edges), len(vertices)
        d = np.diag(x)
        total = n * d + d.sum() - 2 * x.sum(1)
        for v, t in zip(vertices, total):
            yield v, float((n - 1) / t) if n > 1 else 0.0

    return per_component(g, kernel, "v long, centrality double", most_edges)


def communicability(g: Graph, most_edges: int = MOST_EDGES) -> DataFrame:
    """(v, u, value): the exponential of the adjacency; its diagonal is the subgraph centrality."""

    def kernel(vertices, edges):
        values, vectors = np.linalg.eigh(_matrix(vertices, edges))
        x = (vectors * np.exp(values)) @ vectors.T
        for i, v in enumerate(vertices):
            for j, u in enumerate(vertices):
                yield v, u, float(x[i, j])

    return per_component(g, kernel, "v long, u long, value double", most_edges)


def subgraph_centrality(g: Graph, most_edges: int = MOST_EDGES) -> DataFrame:
    """(v, centrality): closed walks from v, those of k steps over k!."""
    return communicability(g, most_edges).where("v = u").select("v", F.col("value").alias("centrality"))


def _embedded(vertices, m: np.ndarray, k: int, largest: bool, scaled: bool):
    values, vectors = np.linalg.eigh(m)
    order = np.argsort(-np.abs(values) if largest else values, kind="stable")[:k]
    for v, row in zip(vertices, vectors):
        for d, j in enumerate(order):
            sign = 1.0 if vectors[np.argmax(np.abs(vectors[:, j])), j] > 0 else -1.0
            yield v, d, float(values[j]), float(sign * row[j] * (math.sqrt(abs(values[j])) if scaled else 1.0))


def adjacency_spectral_embedding(g: Graph, k: int, scaled: bool = True, most_edges: int = MOST_EDGES) -> DataFrame:
    """(v, dim, eigenvalue, x): the eigenvectors of the k largest eigenvalues by size of A + diag(degree / (n - 1)), times their roots if scaled; signs by the largest entry."""

    def kernel(vertices, edges):
        a = _matrix(vertices, edges)
        yield from _embedded(vertices, a + np.diag(a.sum(1) / max(1, len(vertices) - 1)), k, True, scaled)

    return per_component(g, kernel, "v long, dim long, eigenvalue double, x double", most_edges)


def laplacian_spectral_embedding(g: Graph, k: int, kind: str = "laplacian", scaled: bool = False, most_edges: int = MOST_EDGES) -> DataFrame:
    """(v, dim, eigenvalue, x): the eigenvectors of the k smallest eigenvalues of the Laplacian, or of the normalized one."""

    def kernel(vertices, edges):
        yield from _embedded(vertices, matrices(vertices, edges)[kind], k, False, scaled)

    return per_component(g, kernel, "v long, dim long, eigenvalue double, x double", most_edges)


def eigen_adjacency(g: Graph, k: int, which: str = "LA", most_edges: int = MOST_EDGES) -> DataFrame:
    """(component, i, value): k eigenvalues of the adjacency of each component: LA the largest, SA the smallest, LM the largest by size."""

    def kernel(vertices, edges):
        values = np.linalg.eigvalsh(_matrix(vertices, edges))
        key = {"LA": -values, "SA": values, "LM": -np.abs(values)}[which]
        for i, x in enumerate(values[np.argsort(key, kind="stable")][:k]):
            yield vertices[0], i, float(x)

    return per_component(g, kernel, "component long, i long, value double", most_edges)


def eigen_matrix(entries: DataFrame, n: int, symmetric: bool = True) -> DataFrame:
    """(i, real, imag): all eigenvalues of a dense matrix given as (i, j, value), in one task; the largest first."""

    def run(part):
        import pandas as pd

        m = np.zeros((n, n))
        m[part.i.to_numpy(), part.j.to_numpy()] = part.value
        values = np.linalg.eigvalsh(m) if symmetric else np.linalg.eigvals(m)
        values = values[np.lexsort((-np.imag(values), -np.real(values)))]
        return pd.DataFrame({"i": range(n), "real": np.real(values), "imag": np.imag(values)})

    return entries.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "i long, real double, imag double")


def dim_select(values: list[float]) -> int:
    """How many leading values stand out: the split of the descending values with the highest likelihood of two normal groups of one variance (Zhu and Ghodsi)."""
    x = np.sort(np.asarray(values, float))[::-1]
    n = len(x)
    if n < 2:
        return n
    best, at = -math.inf, n
    for q in range(1, n + 1):
        a, b = x[:q], x[q:]
        rest = ((a - a.mean()) ** 2).sum() + (((b - b.mean()) ** 2).sum() if len(b) else 0.0)
        var = max(rest / max(1, n - 2), 1e-300)
        likelihood = -0.5 * n * math.log(2 * math.pi * var) - rest / (2 * var)
        if likelihood > best + 1e-12:
            best, at = likelihood, q
    return at
