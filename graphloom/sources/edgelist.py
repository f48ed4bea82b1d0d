"""Text formats of graphs, and dictionaries of vertex names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.graph import Graph
from graphloom.operators.order import numbered


def parse_pairs(lines: DataFrame, value: str = "value") -> DataFrame:
    """(a, b, pos...) of lines that hold two names between white space; empty lines and comments (# or %) are left out."""
    text = F.trim(F.regexp_replace(value, r"\s+", " "))
    parts = F.split(text, " ")
    kept = lines.where((text != "") & ~text.startswith("#") & ~text.startswith("%"))
    return kept.withColumn("a", F.get(parts, 0)).withColumn("b", F.get(parts, 1)).where("b is not null").drop(value)


def first_seen(tokens: DataFrame, token: str = "token", position: str = "pos") -> DataFrame:
    """(token, id): dense ids from 0 in the order of first positions."""
    firsts = tokens.where(F.col(token).isNotNull()).groupBy(token).agg(F.min(position).alias("_pos"))
    return numbered(firsts, ["_pos", token], "id", 0).select(token, "id")


def header_flags(first_line: str | None) -> dict[str, bool]:
    """What a first line ``% ...`` says: ``asym`` is directed, other such headers undirected, ``bip`` has names of two sides."""
    line = first_line or ""
    return {"undirected": line.startswith("%") and "asym" not in line, "bipartite": line.startswith("%") and "bip" in line}


def read_pairs(spark: SparkSession, path: str) -> tuple[Graph, DataFrame]:
    """The graph of an edge list, and its names: (side, token, id). Names of a bipartite graph's two sides are told apart."""
    lines = spark.read.text(path)
    first = lines.first()
    flags = header_flags(first and first[0])
    pairs = parse_pairs(lines.withColumn("pos", F.monotonically_increasing_id()))
    right = "right" if flags["bipartite"] else "left"
    ends = F.explode(F.array(F.struct(F.lit("left").alias("side"), F.col("a").alias("name"), (F.col("pos") * 2).alias("at")), F.struct(F.lit(right).alias("side"), F.col("b").alias("name"), (F.col("pos") * 2 + 1).alias("at"))))
    tokens = pairs.select(ends.alias("t")).select("t.*").withColumn("token", F.struct("side", "name"))
    names = first_seen(tokens, "token", "at").select("token.side", F.col("token.name").alias("token"), "id")
    left = names.where("side = 'left'").select(F.col("token").alias("a"), F.col("id").alias("src"))
    other = names.where(F.col("side") == right).select(F.col("token").alias("b"), F.col("id").alias("dst"))
    return Graph.of_edges(pairs.join(left, "a").join(other, "b").select("src", "dst"), flags["undirected"]), names


def lookup(ids: DataFrame, names: DataFrame, reverse: bool = False) -> DataFrame:
    """Adds the token of each id, or with ``reverse`` the id of each token; unknown ones are left out."""
    return ids.join(names.select("token", "id"), "token" if reverse else "id")


def matrix_market(graph: Graph, weights: bool = False) -> DataFrame:
    """(line_no, line): the header, the sizes, and each edge counted from 1."""
    head = "%%MatrixMarket matrix coordinate " + ("real" if weights else "pattern") + " general"
    sizes = graph.counts().select(F.lit(1).cast("long").alias("line_no"), F.concat_ws(" ", F.col("vertices"), F.col("vertices"), F.col("edges")).alias("line"))
    one = F.concat_ws(" ", F.col("src") + 1, F.col("dst") + 1, *([F.lit("1.0")] if weights else []))
    body = numbered(graph.edges, ["src", "dst"], "line_no", 2).select("line_no", one.alias("line"))
    return graph.edges.sparkSession.createDataFrame([(0, head)], "line_no long, line string").unionByName(sizes).unionByName(body)


def edge_lines(graph: Graph) -> DataFrame:
    """(line_no, line): V and E, then tab-separated pairs."""
    sizes = graph.counts().select(F.lit(0).cast("long").alias("line_no"), F.concat_ws(" ", "vertices", "edges").alias("line"))
    return sizes.unionByName(numbered(graph.edges, ["src", "dst"], "line_no", 1).select("line_no", F.concat_ws("\t", "src", "dst").alias("line")))


def write_lines(lines: DataFrame, path: str) -> None:
    """Text files that hold the lines in order, one after the other."""
    lines.orderBy("line_no").select("line").write.text(path)
