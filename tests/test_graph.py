import numpy as np
import pytest

from graphloom.functions import UNREACHED
from graphloom.operators import debug, generate, graph
from graphloom.operators.graph import Graph, crossover, summary
from graphloom.sources import edgelist
from graphloom.sources.native import parse, read_native, write_native


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src long, dst long")


def levels(graph, root, strategy="push"):
    return {r["id"]: r["level"] for r in graph.bfs(root, strategy).collect()}


@pytest.mark.parametrize("strategy", ["push", "pull", "switch"])
def test_search_on_known_graphs(spark, strategy):
    assert levels(generate.chain(spark, 5), 0, strategy) == {i: i for i in range(6)}
    assert levels(generate.star(spark, 4), 0, strategy) == {0: 0} | {i: 1 for i in range(1, 5)}
    assert levels(generate.mesh(spark, 3, 4), 0, strategy) == {4 * r + c: r + c for r in range(3) for c in range(4)}
    assert levels(generate.chain(spark, 3), 2, strategy) == {0: UNREACHED, 1: UNREACHED, 2: 0, 3: 1}
    assert levels(generate.chain(spark, 3), 9, strategy) == {}


def test_strategies_agree_on_a_random_graph(spark):
    g = generate.random_graph(spark, 200, 500, seed=5)
    assert levels(g, 3, "push") == levels(g, 3, "pull") == levels(g, 3, "switch")


def test_heavy_vertices_are_dealt_to_several_buckets(spark, monkeypatch):
    pairs = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(1, 70)] + [(i, 70) for i in range(2, 50)]
    g = Graph.of_edges(edges(spark, *pairs))
    plain, ranks = levels(g, 0), {r["id"]: r["rank"] for r in g.pagerank(6).collect()}
    monkeypatch.setattr(graph, "BUCKET_ROWS", 5)
    dealt = graph.DealtEdges(g.edges, "src", 5)
    assert {r["src"]: r["salts"] for r in dealt.hot.collect()} == {0: 12}
    assert sorted(map(tuple, dealt.edges.select("src", "dst").collect())) == sorted(map(tuple, g.edges.collect()))
    assert dealt.join(g.vertices.where("id = 0"), "left_semi").count() == 59 and dealt.join(g.vertices.where("id = 0"), "left_anti").count() == len(set(pairs)) - 59
    dealt.drop()
    assert levels(g, 0, "push") == levels(g, 0, "pull") == levels(g, 0, "switch") == plain
    assert all(abs(r["rank"] - ranks[r["id"]]) < 1e-12 for r in g.pagerank(6).collect())


def test_dealt_edges_are_not_shuffled_again(spark):
    dealt = graph.DealtEdges(edges(spark, *[(i, i + 1) for i in range(100)]), "src")
    found = dealt.join(spark.range(50).hint("merge"), "left_semi")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and found.count() == 50
    dealt.drop()


def test_repeated_edges_and_loops(spark):
    g = Graph.of_edges(edges(spark, (0, 1), (0, 1), (1, 1)))
    assert g.counts().first().asDict() == {"vertices": 2, "edges": 2, "undirected": False}
    assert {r["id"]: r["degree"] for r in g.degrees("abs").collect()} == {0: 1, 1: 3}


def test_empty_graph(spark):
    g = Graph.of_edges(spark.createDataFrame([], "src long, dst long"))
    assert g.vertices.count() == 0 and g.pagerank(2).count() == 0 and g.bfs(0).count() == 0 and g.connectivity() == 0.0


def test_summary_of_halves(spark):
    got = summary(spark.createDataFrame([(i,) for i in range(1, 6)], "v long"), "v").first()
    assert (got["min"], got["lower"], got["median"], got["mean"], got["upper"], got["max"]) == (1, 1.5, 3, 3, 4.5, 5)
    assert abs(got["stddev"] - 1.5811) < 1e-3
    one = summary(spark.createDataFrame([(7,)], "v long"), "v").first().asDict()
    assert one.pop("stddev") == 0 and set(one.values()) == {7}


def test_undirected_triangle(spark):
    g = Graph.of_edges(edges(spark, (0, 1), (1, 2), (2, 0)), undirected=True)
    assert {r["degree"] for r in g.degrees("abs").collect()} == {2}
    assert g.connectivity() == 1.0


def test_pagerank_by_hand(spark):
    g = Graph.of_edges(edges(spark, (0, 1), (1, 2), (2, 0), (0, 2), (3, 0)))
    r = np.full(4, 0.25)
    m = np.array([[0, 0, 1, 1], [0.5, 0, 0, 0], [0.5, 1, 0, 0], [0, 0, 0, 0]])
    for _ in range(12):
        r = 0.15 / 4 + 0.85 * m @ r
    got = {x["id"]: x["rank"] for x in g.pagerank(12).collect()}
    assert np.allclose([got[i] for i in range(4)], r)


@pytest.mark.parametrize("worst", [False, True])
def test_reorder_is_a_relabelling(spark, worst):
    g = generate.random_graph(spark, 101, 400, seed=2)
    new = g.reorder("out", worst)
    assert sorted(r["new_id"] for r in new.collect()) == list(range(101))
    assert sorted(r["degree"] for r in g.relabel(new).degrees("out").collect()) == sorted(r["degree"] for r in g.degrees("out").collect())


def test_generators(spark):
    assert generate.degree4(spark, 5, True).edges.count() == 25 * 4
    assert generate.degree6(spark, 3, True).edges.count() == 27 * 6
    got = generate.random_edges(spark, 30, 200, 1, undirected=True).collect()
    assert len({(r["src"], r["dst"]) for r in got}) == 200 and all(0 <= r["dst"] <= r["src"] < 30 for r in got)
    assert generate.random_edges(spark, 10, 100, 1).distinct().count() == 100


def test_few_cells_are_drawn_again(spark, monkeypatch):
    seen, whole = [], generate.numbered

    def short_at_first(df, *rest):
        seen.append(1)
        return whole(df.limit(5) if len(seen) == 1 else df, *rest)

    monkeypatch.setattr(generate, "numbered", short_at_first)
    got = generate.random_edges(spark, 50, 60, 3)
    assert len(seen) == 2 and got.distinct().count() == 60


def test_rank_change_shrinks(spark):
    g = generate.random_graph(spark, 60, 300, seed=2)
    assert 0 <= g.rank_change(8).first()["change"] < g.rank_change(2).first()["change"]


def test_times_and_plans(spark):
    g = generate.chain(spark, 3)
    rows, seconds = debug.timed(g.edges)
    assert rows == 3 and seconds >= 0 and "Physical Plan" in debug.plan_text(g.edges)
    one = debug.repeated(spark, lambda: None, "nothing").first()
    assert one["name"] == "nothing" and one["std_dev"] == 0 and one["min_time"] == one["max_time"]
    many = debug.time_search(g, 0, "push", 2).first()
    assert many["min_time"] <= many["avg_time"] <= many["max_time"]


def test_crossover_and_mutation(spark):
    a, b = generate.chain(spark, 6), Graph.of_edges(edges(spark, (0, 1), (6, 0)))
    child = crossover(a, b, "point", 3, mutations=edges(spark, (0, 1), (5, 5)))
    assert {(r["src"], r["dst"]) for r in child.edges.collect()} == {(1, 2), (2, 3), (5, 5)}
    assert generate.evolve([a, b], 1, 3, seed=1)


@pytest.mark.parametrize("undirected", [False, True])
def test_native_file_round_trip(spark, tmp_path, undirected):
    g = generate.random_graph(spark, 50, 120, seed=3, undirected=undirected)
    path = str(tmp_path / "g.graph")
    write_native(g, path)
    back = read_native(spark, "file://" + path)
    key = lambda x: sorted((r["src"], r["dst"]) for r in x.edges.collect())
    assert key(back) == key(g) and back.undirected == undirected and back.vertices.count() == 50
    raw = open(path, "rb").read()
    with pytest.raises(ValueError):
        parse(raw[:-4])


def test_old_native_file(spark, tmp_path):
    words = np.array([0, 3, 3, 0, 1, 2, 3, 1, 2, 0, 0, 1, 2, 3, 2, 0, 1], "<i4")
    (tmp_path / "old").write_bytes(words.tobytes())
    back = read_native(spark, f"file://{tmp_path}/old")
    assert sorted((r["src"], r["dst"]) for r in back.edges.collect()) == [(0, 1), (1, 2), (2, 0)] and not back.undirected


def test_text_import(spark, tmp_path):
    (tmp_path / "t").write_text("% asym\nb a\n# note\na c\n\nb  a 9\n")
    g, names = edgelist.read_pairs(spark, f"file://{tmp_path}/t")
    ids = {r["token"]: r["id"] for r in names.collect()}
    assert ids == {"b": 0, "a": 1, "c": 2} and not g.undirected
    assert {(r["src"], r["dst"]) for r in g.edges.collect()} == {(0, 1), (1, 2)}
    (tmp_path / "u").write_text("% bip\nx x\ny x\n")
    g, names = edgelist.read_pairs(spark, f"file://{tmp_path}/u")
    assert g.undirected and names.count() == 3 and g.edges.count() == 4
