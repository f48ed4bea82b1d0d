"""Synthetic graphs, and their evolution."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import hash_number, triangle_row
from graphloom.operators.graph import Graph, crossover
from graphloom.operators.order import numbered
from graphloom.shared import written


def _graph(edges: DataFrame, undirected: bool) -> Graph:
    return Graph.of_edges(edges, undirected)


def chain(spark: SparkSession, n: int, undirected: bool = False) -> Graph:
    """i to i + 1 for 0 <= i < n."""
    return _graph(spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")), undirected)


def star(spark: SparkSession, n: int, undirected: bool = False) -> Graph:
    """0 to each of 1..n."""
    return _graph(spark.range(1, n + 1).select(F.lit(0).alias("src"), F.col("id").alias("dst")), undirected)


def lattice(spark: SparkSession, sides: list[int], wrap: bool, undirected: bool = False) -> Graph:
    """Each cell to the next one along each side; with ``wrap`` the first also to the last."""
    cells, steps = spark.range(math.prod(sides)), []
    stride = 1
    for side in reversed(sides):
        at = F.floor(F.col("id") / stride) % side
        onward = F.struct(F.col("id").alias("src"), (F.col("id") + stride).alias("dst"))
        around = F.struct((F.col("id") - (side - 1) * stride).alias("src"), F.col("id").alias("dst"))
        steps.append(F.when(at < side - 1, onward).otherwise(around) if wrap else F.when(at < side - 1, onward))
        stride *= side
    return _graph(cells.select(F.explode(F.array(*steps)).alias("e")).where("e is not null").select("e.*"), undirected)


def mesh(spark: SparkSession, height: int, width: int, undirected: bool = False) -> Graph:
    """Each cell to its right and lower neighbour."""
    return lattice(spark, [height, width], False, undirected)


def degree4(spark: SparkSession, n: int, undirected: bool = False) -> Graph:
    """A torus of n x n cells."""
    return lattice(spark, [n, n], True, undirected)


def degree6(spark: SparkSession, n: int, undirected: bool = False) -> Graph:
    """A torus of n x n x n cells."""
    return lattice(spark, [n, n, n], True, undirected)


def torus(spark: SparkSession, n: int, dimensions: int, undirected: bool = False) -> Graph:
    """A torus of n cells along each of ``dimensions`` sides."""
    return lattice(spark, [n] * dimensions, True, undirected)


def _decode(index: Column, vertices: int, undirected: bool) -> tuple[Column, Column]:
    if undirected:
        row = triangle_row(index)
        return row, index - (row * (row + 1) / 2).cast("long")
    return F.floor(index / vertices).cast("long"), index % vertices


def random_edges(spark: SparkSession, vertices: int, count: int, seed: int, undirected: bool = False) -> DataFrame:
    """``count`` distinct edges, loops included, drawn evenly without replacement: draws by hash are made distinct until there are enough, then cut in hash order.

    Draw i is cell number hash(seed, 1, i) mod the number of cells; cells are placed by hash(seed, 2, cell), sorted by ranges. If ``draws`` (three times
    ``count`` and some) hold too few distinct cells, twice as many are drawn.
    """
    space = vertices * (vertices + 1) // 2 if undirected else vertices * vertices
    if count > space:
        raise ValueError(f"{count} edges of {space}")
    draws = 3 * count + 64
    while True:
        if 2 * count >= space:  # all cells in hash order
            cells = spark.range(space).select(F.col("id").alias("cell"))
        else:
            cells = spark.range(draws).select((hash_number(seed, 1, "id") % space).alias("cell")).distinct()
        placed = numbered(cells.withColumn("_order", hash_number(seed, 2, "cell")), ["_order", "cell"], "_rn")
        if 2 * count >= space or placed.count() >= count:
            break
        draws *= 2
    picked = placed.where(F.col("_rn") <= count)
    src, dst = _decode(F.col("cell"), vertices, undirected)
    return picked.select(src.alias("src"), dst.alias("dst"))


def random_graph(spark: SparkSession, vertices: int, count: int | None = None, rate: float | None = None, seed: int = 0, undirected: bool = False) -> Graph:
    """A fixed count of edges, or a binomial one for ``rate``."""
    if count is None:
        import numpy as np

        space = vertices * (vertices + 1) // 2 if undirected else vertices * vertices
        count = int(np.random.default_rng(seed).binomial(space, rate))
    edges = random_edges(spark, vertices, count, seed, undirected)
    if undirected:
        edges = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    return Graph(edges, spark.range(vertices), undirected)


def evolve(population: list[Graph], generations: int, size: int, elite: float = 0.2, kind: str = "edge", mutation_count: int = 0, seed: int = 0) -> list[tuple[float, Graph]]:
    """Keeps the best of each generation and fills up with children of parents drawn by weight fitness * connectivity.

    The population is a few graphs on the driver; the work on each graph is distributed.
    """
    import numpy as np

    rng = np.random.default_rng(seed)
    scored = sorted(((g.fitness() * g.connectivity(), g) for g in population), key=lambda x: -x[0])
    for step in range(generations):
        keep = scored[: max(1, int(elite * size))]
        weights = np.array([max(s, 1e-9) for s, _ in scored])
        children = []
        while len(keep) + len(children) < size:
            i, j = rng.choice(len(scored), 2, replace=len(scored) < 2, p=weights / weights.sum())
            one, other = scored[i][1], scored[j][1]
            spark, v = one.edges.sparkSession, one.vertices.count()
            changed = random_edges(spark, v, mutation_count, seed + 31 * step + len(children)) if mutation_count else None
            child = crossover(one, other, kind, point=v // 2, seed=seed + step, mutations=changed)
            child = Graph(written(child.edges, "child"), written(child.vertices, "child"), child.undirected)  # else lineage multiplies by generation
            children.append((child.fitness() * child.connectivity(), child))
        scored = sorted([*keep, *children], key=lambda x: -x[0])[:size]
    return scored
