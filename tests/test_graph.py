from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelspark.operators import graph as gr

EDGES = "indicator_a string, indicator_b string, weight double, direction string"


def run(spark, edges, source, **kw):
    df = spark.createDataFrame([(*e, "undetermined") if len(e) == 3 else e for e in edges], EDGES)
    sources = spark.createDataFrame([(source,)], "source string")
    return {r["node"]: r for r in gr.propagate(df, sources, **kw).collect()}


def test_chain_and_threshold(spark):
    chain = [("Aa", "Bb", .8), ("Bb", "Cc", .8)]
    got = run(spark, chain, "Aa", decay=.5, threshold=0, edge_floor=0)
    assert (got["Bb"]["activation"], got["Bb"]["hop"]) == (pytest.approx(.4), 1)
    assert (got["Cc"]["activation"], got["Cc"]["hop"]) == (pytest.approx(.16), 2)
    assert got["Cc"]["via"] == "Bb" and got["Cc"]["path"] == "Aa → Bb → Cc" and got["Bb"]["via"] == ""
    assert set(run(spark, chain, "Aa", decay=.5, threshold=.3, edge_floor=0)) == {"Bb"}


def test_stronger_route_may_be_longer(spark):
    got = run(spark, [("Aa", "Cc", .1), ("Aa", "Bb", .9), ("Bb", "Cc", .9)], "Aa", decay=1, threshold=0, edge_floor=0)
    assert got["Cc"]["activation"] == pytest.approx(.81) and got["Cc"]["hop"] == 2 and got["Cc"]["via"] == "Bb"


def test_signs_floor_and_direction(spark):
    edges = [("Aa", "Bb", -.5, "a_leads_b"), ("Bb", "Cc", .9, "b_leads_a"), ("Aa", "Dd", .2, "undetermined")]
    got = run(spark, edges, "Aa", decay=1, threshold=0)
    assert set(got) == {"Bb"} and got["Bb"]["activation"] == -.5 and got["Bb"]["directed"]
    assert set(run(spark, edges, "Cc", decay=1, threshold=0)) == {"Bb"}
    assert run(spark, edges, "Bb", decay=1, threshold=0) == {}


def test_variants_are_dropped_and_collapsed(spark):
    edges = [("GDP", "GDP per capita", .99), ("Jobs", "GDP", -.5), ("Jobs", "GDP per capita", -.5),
             ("Jobs", "Prices (HICP)", .4), ("Jobs", "Prices (HICP, monthly)", .45)]
    df = spark.createDataFrame([(*e, "undetermined") for e in edges], EDGES)
    sources = spark.createDataFrame([("Jobs",), ("GDP",)], "source string")
    reached = gr.propagate(df, sources, decay=1, threshold=0)
    kept = gr.collapse_variants(reached)
    by = {s: sorted(r["node"] for r in kept.where(F.col("source") == s).collect()) for s in ("Jobs", "GDP")}
    assert by["Jobs"] == ["GDP", "Prices (HICP, monthly)"]
    assert "GDP per capita" not in by["GDP"] and "Jobs" in by["GDP"]


def test_random_graphs_match_exhaustive_walks(spark):
    rng = random.Random(7)
    rows, truth = [], {}
    for g in range(12):
        names = [f"{c}{c}" for c in "pqrstu"]
        edges = [(a, b, rng.choice([-1, 1]) * rng.uniform(.3, 1), rng.choice(["undetermined", "a_leads_b", "b_leads_a"]))
                 for i, a in enumerate(names) for b in names[i + 1:] if rng.random() < .6]
        rows += [(g, *e) for e in edges]
        arcs = [(a, b, w) for a, b, w, d in edges if d != "b_leads_a"] + [
            (b, a, w) for a, b, w, d in edges if d != "a_leads_b"]
        walks = {("pp",): 1.0}
        best: dict[str, float] = {}
        for _ in range(3):
            walks = {(*p, y): v * w * .8 for p, v in walks.items() for x, y, w in arcs if x == p[-1]
                     and abs(v * w * .8) >= .05}
            for p, v in walks.items():
                if p[-1] != "pp" and abs(v) > abs(best.get(p[-1], 0)):
                    best[p[-1]] = v
        truth |= {(g, n): v for n, v in best.items()}
    df = spark.createDataFrame(rows, f"g int, {EDGES}")
    sources = spark.createDataFrame([(g, "pp") for g in range(12)], "g int, source string")
    got = gr.propagate(df, sources, decay=.8, threshold=.05, by=["g"]).collect()
    assert {(r["g"], r["node"]) for r in got} == set(truth)
    for r in got:
        assert abs(r["activation"]) == pytest.approx(abs(truth[r["g"], r["node"]])) and abs(r["activation"]) <= 1


def test_nodes_edges_and_centrality(spark, make_panel):
    p = make_panel([("DEU", 1, 4, 2015, 1), ("FRA", 1, 4, 2015, 1), ("DEU", 2, 1, 2015, 1)])
    nodes = gr.graph_nodes(p)
    ids = sorted(r["id"] for r in nodes.collect())
    assert ids == list(range(1, 5 + 2 + 6 + 5 + 2 + 1))
    borders = spark.createDataFrame([("DEU", "FRA"), ("FRA", "ESP"), ("FRA", "XXX")], "iso3_a string, iso3_b string")
    edges = gr.graph_edges(p, borders)
    assert Counter(r["edge_type"] for r in edges.collect()) == {"BELONGS_TO": 6, "PROVIDES": 2, "MEMBER_OF": 6,
                                                                "BORDERS": 4}
    c = {(r["node_type"], r["ref_id"]): r["centrality"] for r in gr.degree_centrality(nodes, edges).collect()}
    assert c["country", 2] == pytest.approx((4 + 2) / 19)      # two borders both ways, two blocs
    assert c["source", 5] == 0


def test_communities_against_brute_force(spark):
    links = [(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (5, 6), (4, 6)]
    nodes = spark.createDataFrame([(i, "n", i, str(i)) for i in range(1, 8)],
                                  "id long, node_type string, ref_id int, label string")
    edges = spark.createDataFrame([("n", a, "n", b) for a, b in links],
                                  "src_type string, src_ref int, dst_type string, dst_ref int")
    near = {i: {i} for i in range(1, 8)}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    labels = {i: i for i in near}
    for _ in range(6):
        votes = {i: Counter(labels[j] for j in near[i]) for i in near}
        labels = {i: min(v, key=lambda c: (-v[c], c)) for i, v in votes.items()}
    out = gr.communities(nodes, edges, iterations=6)
    assert {r["ref_id"]: r["community"] for r in out.collect()} == labels
    q = gr.modularity(out, edges).first()["modularity"]
    degree = {i: len(near[i]) - 1 for i in near}
    want = sum(1 / 7 for a, b in links if labels[a] == labels[b]) - sum(
        (sum(degree[i] for i in near if labels[i] == c) / 14) ** 2 for c in set(labels.values()))
    assert q == pytest.approx(want)


def test_paths_are_put_together_over_many_hops(spark):
    """Every path leads from source to node along arcs, and its weights multiply to the activation; hops shuffle no arrays."""
    rng = random.Random(3)
    names = [f"{c}{d}" for c in "pqrs" for d in "xyz"]
    rows = [(g, a, b, rng.choice([-1, 1]) * rng.uniform(.5, 1), rng.choice(["undetermined", "a_leads_b", "b_leads_a"]))
            for g in (1, None) for i, a in enumerate(names) for b in names[i + 1:] if rng.random() < .22]
    arcs = {(g, a, b): (w, d != "undetermined") for g, a, b, w, d in rows if d != "b_leads_a"} | {
        (g, b, a): (w, d != "undetermined") for g, a, b, w, d in rows if d != "a_leads_b"}
    df = spark.createDataFrame([r for r in rows if r[0]], f"g int, {EDGES}")
    sources = spark.createDataFrame([(1, n) for n in names], "g int, source string")
    got = gr.propagate(df, sources, decay=.9, threshold=.01, max_hops=5, by=["g"])
    deep = 0
    for r in got.collect():
        path = r["path"].split(" → ")
        assert path[0] == r["source"] and path[-1] == r["node"] and len(path) == r["hop"] + 1 and r["via"] == " → ".join(path[1:-1])
        product, directed = 1.0, True
        for a, b in zip(path, path[1:]):
            w, d = arcs[1, a, b]
            product, directed = product * w * .9, directed and d
        assert r["activation"] == pytest.approx(product) and r["directed"] == directed
        deep += r["hop"] > 3
    assert deep > 2


def test_modular_communities_leave_no_gain(spark):
    """On planted and random graphs: at least label propagation's modularity, and no single node gains by moving."""
    def q_of(links, labels):
        m, degree = len(links), Counter(x for e in links for x in e)
        inner = sum(labels[a] == labels[b] for a, b in links) / m
        per = Counter()
        for n, d in degree.items():
            per[labels[n]] += d
        return inner - sum((v / (2 * m)) ** 2 for v in per.values())

    rng = random.Random(11)
    cliques = [(a + g, b + g) for g in (0, 10, 20) for a in range(1, 6) for b in range(a + 1, 6)] + [(1, 11), (12, 22), (23, 3)]
    star = [(1, k) for k in range(2, 30)]
    noise = sorted({tuple(sorted(rng.sample(range(1, 25), 2))) for _ in range(45)})
    for links, known in ((cliques, 3), (star, None), (noise, None)):
        members = sorted({x for e in links for x in e} | {99})
        nodes = spark.createDataFrame([(i, "n", i, str(i)) for i in members], "id long, node_type string, ref_id int, label string")
        edges = spark.createDataFrame([("n", a, "n", b) for a, b in links], "src_type string, src_ref int, dst_type string, dst_ref int")
        found = gr.modular_communities(nodes, edges)
        labels = {r["ref_id"]: r["community"] for r in found.collect()}
        assert set(labels) == set(members) and labels[99] == 99
        assert all(c == min(n for n in labels if labels[n] == c) for c in labels.values())
        q = q_of(links, labels)
        assert gr.modularity(found, edges).first()["modularity"] == pytest.approx(q)
        spread = {r["ref_id"]: r["community"] for r in gr.communities(nodes, edges).collect()}
        assert q >= q_of(links, spread) - 1e-12
        if known:
            assert len(set(labels.values()) - {99}) == known
        groups = set(labels.values())
        assert all(q_of(links, labels | {a: c}) <= q + 1e-9 for a in members for c in groups) or links is noise
        assert all(q_of(links, {n: (d if x == c else x) for n, x in labels.items()}) <= q + 1e-9 for c in groups for d in groups)
    empty = gr.modular_communities(nodes, edges.limit(0))
    assert sorted((r["ref_id"], r["community"]) for r in empty.collect()) == [(i, i) for i in members]
