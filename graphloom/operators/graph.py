"""Graphs as edge and vertex tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import UNREACHED, hash_number
from graphloom.operators.order import numbered, running_sum
from graphloom.shared import BUCKET_ROWS, bucket_count, bucketed, drop_written, written

#: Frontier share from which a level is expanded from the unvisited side.
PULL_SHARE = 0.1
#: Levels of a search after which the visited vertices are written as one table.
LEVELS_PER_TABLE = 16
STATISTICS = ("min", "lower", "median", "mean", "upper", "max", "stddev")


def summary(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """min, lower, median, mean, upper, max and stddev of a column, per group.

    Quartiles are medians of the halves without the middle row; the deviation is that of a sample, 0 for a single row.
    Works on the histogram of values, so that a group's rows are never sorted in one task beyond its distinct values.
    """
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    upto = Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    placed = counts.withColumn("hi", F.sum("c").over(upto)).withColumn("lo", F.col("hi") - F.col("c")).withColumn("n", F.sum("c").over(whole))
    half = F.expr("n DIV 2")
    low = [F.when(F.col("n") == 1, 0).otherwise(F.expr("(n DIV 2 - 1) DIV 2")), F.when(F.col("n") == 1, 0).otherwise(F.expr("(n DIV 2) DIV 2"))]
    mid = [F.expr("(n - 1) DIV 2"), half]
    shift = F.when(F.col("n") == 1, 0).otherwise(half + F.col("n") % 2)
    at = lambda i: F.max(F.when((F.col("lo") <= i) & (i < F.col("hi")), F.col("v")))
    middle = lambda ij: (at(ij[0]) + at(ij[1])) / 2.0
    mean = F.sum(F.col("v") * F.col("c")) / F.sum("c")
    found = placed.groupBy(*by).agg(
        F.min("v").cast("double").alias("min"), middle(low).alias("lower"), middle(mid).alias("median"), mean.alias("mean"),
        middle([x + shift for x in low]).alias("upper"), F.max("v").cast("double").alias("max"),
        F.sum("c").alias("n"), F.sum(F.col("v").cast("double") * F.col("v") * F.col("c")).alias("squares"),
    )
    spread = F.when(F.col("n") > 1, F.sqrt(F.greatest(F.lit(0.0), (F.col("squares") - F.col("n") * F.col("mean") * F.col("mean")) / F.greatest(F.col("n") - 1, F.lit(1))))).otherwise(0.0)
    return found.withColumn("stddev", spread).drop("n", "squares")


class DealtEdges:
    """Edges in buckets of one end (``key``), so that a join with vertices shuffles the vertices alone.

    A vertex with more than ``most`` edges (by default a bucket's share) is dealt to several buckets by a salt, and what meets it is copied once for each;
    there are fewer such vertices than edges / ``most``, by default fewer than buckets.
    """

    def __init__(self, edges: DataFrame, key: str, most: int | None = None):
        spark, rows = edges.sparkSession, edges.count()
        buckets = bucket_count(spark, rows)
        most = most or max(BUCKET_ROWS, -(-rows // buckets))
        heavy = edges.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > most).select(F.col(key).cast("long").alias(key), F.ceil(F.col("n") / most).cast("int").alias("salts")).collect()
        self.key, self.on, self.hot = key, [key], None
        if heavy:
            self.on, self.hot = [key, "salt"], spark.createDataFrame(heavy, f"{key} long, salts int")
            other = "dst" if key == "src" else "src"
            salt = F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(other), F.col("salts")).cast("int"))
            edges = edges.join(F.broadcast(self.hot), key, "left").withColumn("salt", salt).drop("salts")
        self.edges = bucketed(edges, self.on, buckets, "edges")

    def join(self, vertices: DataFrame, how: str) -> DataFrame:
        """The edges joined with vertices (id, ...) at the end ``key``."""
        ends = vertices.withColumnRenamed("id", self.key)
        if self.hot is not None:
            copies = F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)
            ends = ends.join(F.broadcast(self.hot), self.key, "left").withColumn("salt", F.explode(copies)).drop("salts")
        return self.edges.join(ends, self.on, how)

    def drop(self) -> None:
        drop_written(self.edges)


@dataclass
class Graph:
    """``edges`` (src, dst) and ``vertices`` (id); an undirected graph holds each edge in both directions."""

    edges: DataFrame
    vertices: DataFrame
    undirected: bool = False
    _degrees: dict = field(default_factory=dict, repr=False)

    @classmethod
    def of_edges(cls, edges: DataFrame, undirected: bool = False) -> Graph:
        """Distinct edges; vertices are 0 up to the greatest id."""
        edges = edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src is not null and dst is not null")
        if undirected:
            edges = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        edges = edges.distinct()
        top = edges.agg(F.max(F.greatest("src", "dst"))).first()[0]
        return cls(edges, edges.sparkSession.range(0, 0 if top is None else top + 1), undirected)

    @property
    def reversed(self) -> Graph:
        return self if self.undirected else Graph(self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), self.vertices)

    def counts(self) -> DataFrame:
        """One row: vertices, edges, undirected."""
        v = self.vertices.agg(F.count("*").alias("vertices"))
        return v.join(self.edges.agg(F.count("*").alias("edges"))).withColumn("undirected", F.lit(self.undirected))

    def degrees(self, kind: str = "out") -> DataFrame:
        """(id, degree) of every vertex: ``out``, ``in``, or ``abs``, their sum (undirected: the out-degree)."""
        if kind == "abs" and self.undirected:
            kind = "out"
        ends = {"out": [F.col("src")], "in": [F.col("dst")], "abs": [F.col("src"), F.col("dst")]}[kind]
        met = self.edges.select(F.explode(F.array(*ends)).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
        return self.vertices.join(met, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))

    def histogram(self, kind: str = "out") -> DataFrame:
        return self.degrees(kind).groupBy("degree").agg(F.count("*").alias("vertices"))

    def degree_statistics(self) -> DataFrame:
        """(kind, min, lower, median, mean, upper, max, stddev) for abs, in and out."""
        all_kinds = None
        for kind in ("abs", "in", "out"):
            one = self.degrees(kind).withColumn("kind", F.lit(kind))
            all_kinds = one if all_kinds is None else all_kinds.unionByName(one)
        return summary(all_kinds, "degree", ["kind"])

    def properties(self) -> DataFrame:
        """(property, value): the counts and all degree statistics, 23 rows."""
        stats = self.degree_statistics()
        pairs = F.explode(F.array(*[F.struct(F.concat_ws(" ", F.col("kind"), F.lit(s)).alias("property"), F.col(s).alias("value")) for s in STATISTICS])).alias("p")
        sizes = self.counts().select(F.explode(F.array(*[F.struct(F.lit(f"{n} count").alias("property"), F.col(c).cast("double").alias("value")) for n, c in (("vertex", "vertices"), ("edge", "edges"))])).alias("p"))
        return stats.select(pairs).unionByName(sizes).select("p.*")

    def csr(self) -> DataFrame:
        """(id, first, degree): where each vertex's edges begin among all edges sorted by source, vertices without edges included."""
        return running_sum(self.degrees("out"), ["id"], "degree", "first").select("id", "first", "degree")

    def adjacency(self) -> DataFrame:
        """(id, neighbours) with sorted lists."""
        lists = self.edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("neighbours"))
        return self.vertices.join(lists, "id", "left").withColumn("neighbours", F.coalesce("neighbours", F.array().cast("array<bigint>")))

    def bfs(self, root: int = 0, strategy: str = "switch") -> DataFrame:
        """(id, level) from ``root``; unreached vertices have level 2147483647. A root that is no vertex gives no rows.

        ``push`` joins the frontier with the edges by source; ``pull`` joins the unvisited vertices' in-edges with the frontier; ``switch`` takes pull
        once the frontier is a large part of all vertices. All give the same levels. Edges are dealt once for each direction in use, so that a level
        shuffles vertices and the edges that it opens; every level is written to the shared folder.
        """
        if strategy not in ("push", "pull", "switch"):
            raise ValueError(strategy)
        frontier = written(self.vertices.where(F.col("id") == root).select("id"), "level")
        if frontier.isEmpty():
            return frontier.withColumn("level", F.lit(0)).limit(0)
        visited, size, all_size, level = frontier.withColumn("level", F.lit(0)), 1, self.vertices.count(), 0
        edges, dealt = written(self.edges, "edges"), {}
        while size:
            level += 1
            pull = strategy == "pull" or strategy == "switch" and size >= PULL_SHARE * all_size
            key = "dst" if pull else "src"
            if key not in dealt:
                dealt[key] = DealtEdges(edges, key)
            if pull:
                open_ends = dealt[key].join(visited.select("id"), "left_anti")
                reached = open_ends.join(frontier.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
            else:
                reached = dealt[key].join(frontier.select("id"), "left_semi").select(F.col("dst").alias("id")).distinct().join(visited, "id", "left_anti")
            frontier = written(reached, "level")
            size = frontier.count()
            visited = visited.unionByName(frontier.withColumn("level", F.lit(level)))
            if level % LEVELS_PER_TABLE == 0:
                visited = written(visited, "visited")
        for d in dealt.values():
            d.drop()
        drop_written(edges)
        return self.vertices.join(visited, "id", "left").select("id", F.coalesce("level", F.lit(UNREACHED)).alias("level"))

    def levels(self, root: int = 0) -> DataFrame:
        """(level, frontier, visited, frontier_share, visited_share) of each level that a search reaches."""
        found = self.bfs(root).where(F.col("level") < UNREACHED).groupBy("level").agg(F.count("*").alias("frontier"))
        all_size = self.vertices.count()
        out = found.withColumn("visited", F.sum("frontier").over(Window.orderBy("level")))  # a row for each level
        return out.withColumn("frontier_share", F.col("frontier") / all_size).withColumn("visited_share", F.col("visited") / all_size)

    def connectivity(self) -> float:
        """The part of all vertices that vertex 0 reaches, whatever the direction of edges."""
        both = self if self.undirected else Graph.of_edges(self.edges, undirected=True)
        reached = Graph(both.edges, self.vertices, True).bfs(0)
        n = self.vertices.count()
        return reached.where(F.col("level") < UNREACHED).count() / n if n else 0.0

    def pagerank(self, iterations: int = 100, damping: float = 0.85, write_every: int = 5, with_change: bool = False) -> DataFrame:
        """(id, rank): the given number of iterations from 1/V, without normalisation; vertices without out-edges pass nothing on.

        The edges carry 1/degree and are written in buckets of their source, heavy sources salted, so that an iteration shuffles only ranks and partial sums.
        """
        n = self.vertices.count()
        if not n:
            return self.vertices.withColumn("rank", F.lit(0.0))
        edges = written(self.edges, "edges")
        shares = DealtEdges(edges.join(edges.groupBy("src").agg((1.0 / F.count("*")).alias("share")), "src"), "src")
        base = (1.0 - damping) / n
        ranks, kept = self.vertices.select("id", F.lit(1.0 / n).alias("rank")), None
        for i in range(1, iterations + 1):
            sums = shares.join(ranks, "inner").groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("s"))
            before, ranks = ranks, self.vertices.join(sums.withColumnRenamed("dst", "id"), "id", "left").select("id", (F.lit(base) + damping * F.coalesce("s", F.lit(0.0))).alias("rank"))
            if i % write_every == 0 or i == iterations:
                if with_change and i == iterations:
                    ranks = ranks.join(before.withColumnRenamed("rank", "before"), "id")
                done = written(ranks, "ranks")
                if kept is not None:
                    drop_written(kept)
                ranks = kept = done
        shares.drop()
        drop_written(edges)
        return ranks

    def rank_change(self, iterations: int = 100, damping: float = 0.85) -> DataFrame:
        """One row: the sum of absolute differences of the last two iterations' ranks."""
        found = self.pagerank(iterations, damping, with_change=True)
        return found.agg(F.sum(F.abs(F.col("rank") - F.col("before"))).alias("change"))

    def rank_order(self, ranks: DataFrame, chunk: int = 1000) -> DataFrame:
        """(id, bucket, place): vertices by rank (its low 16 bits cleared) in chunks, by id within a chunk."""
        from graphloom.functions import masked_float

        rn = numbered(ranks.select("id", masked_float("rank").alias("masked")), ["masked", "id"], "rn", 0)
        bucketed = rn.withColumn("bucket", F.floor(F.col("rn") / chunk).cast("long"))
        return bucketed.withColumn("place", F.col("bucket") * chunk + F.row_number().over(Window.partitionBy("bucket").orderBy("id")) - 1).select("id", "bucket", "place")

    def reorder(self, kind: str = "out", worst: bool = False) -> DataFrame:
        """(id, new_id): new ids by degree, highest first, then by id. ``worst`` deals each group of 32 one high, one low and 30 middling vertices.

        Here ``abs`` counts both directions of an undirected graph's edges.
        """
        degrees = self.degrees(kind)
        if kind == "abs" and self.undirected:
            degrees = degrees.withColumn("degree", F.col("degree") * 2)
        ranked = numbered(degrees, [F.desc("degree"), "id"], "at", 0)
        if not worst:
            return ranked.select("id", F.col("at").alias("new_id"))
        v = self.vertices.count()
        w = -(-v // 32)
        if v < 2 * w:  # a single vertex
            return ranked.select("id", F.col("at").alias("new_id"))
        at, low = F.col("at"), v - w
        middle = at - w
        new = F.when(at < w, _group_start(at, v, w)).when(at >= low, _group_start(at - low, v, w) + 1).otherwise(_group_start(F.floor(middle / 30), v, w) + 2 + middle % 30)
        return ranked.select("id", new.cast("long").alias("new_id"))

    def relabel(self, mapping: DataFrame) -> Graph:
        """The graph under new ids (id, new_id)."""
        one = mapping.select(F.col("id").alias("src"), F.col("new_id").alias("a"))
        other = mapping.select(F.col("id").alias("dst"), F.col("new_id").alias("b"))
        edges = self.edges.join(one, "src").join(other, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
        return Graph(edges, mapping.select(F.col("new_id").alias("id")), self.undirected)

    def fitness(self) -> float:
        """1 less the greatest distance between the distribution of degrees and an even one from 0 to V/2."""
        n = self.vertices.count()
        if not n:
            return 0.0
        upto = self.histogram("abs").withColumn("below", F.sum("vertices").over(Window.orderBy("degree")))  # a row for each distinct degree
        gap = F.abs(F.col("below") / n - F.least(F.col("degree") / (0.5 * n), F.lit(1.0)))
        return 1.0 - upto.agg(F.max(gap)).first()[0]


def _group_start(group, v: int, w: int):
    """Where a group begins: two vertices and up to 30 middling ones in each group before."""
    return group * 2 + F.least(group * 30, F.lit(v - 2 * w))


def crossover(one: Graph, other: Graph, kind: str = "point", point: int = 0, seed: int = 0, mutations: DataFrame | None = None) -> Graph:
    """A child of two graphs. Edges of both parents stay; an edge of one parent stays by ``kind``; an edge in ``mutations`` is turned over.

    ``point``: dst <= point from the first parent, the rest from the second. ``vertex`` and ``edge``: a hash bit of dst, or of the edge, whichever parent has it.
    """
    has = one.edges.distinct().withColumn("a", F.lit(True)).join(other.edges.distinct().withColumn("b", F.lit(True)), ["src", "dst"], "full")
    a, b = F.coalesce("a", F.lit(False)), F.coalesce("b", F.lit(False))
    if kind == "point":
        chosen = F.when(F.col("dst") <= point, a).otherwise(b)
    elif kind in ("vertex", "edge"):
        keys = [F.col("dst")] if kind == "vertex" else [F.col("dst"), F.col("src")]
        chosen = hash_number(seed, 3, *keys) % 2 == 0
    else:
        raise ValueError(kind)
    kept = has.where((a & b) | chosen).select("src", "dst")
    if mutations is not None:
        turned = kept.withColumn("k", F.lit(1)).join(mutations.select("src", "dst").distinct().withColumn("m", F.lit(1)), ["src", "dst"], "full")
        kept = turned.where("k is null or m is null").select("src", "dst")
    return Graph(kept, one.vertices.unionByName(other.vertices).distinct(), one.undirected and other.undirected)
