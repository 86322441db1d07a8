"""The property graph over the catalog: nodes, edges, centrality, communities, shock propagation."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelspark.functions.text import is_variant, name_stem
from panelspark.panel import Panel
from panelspark.schema import LEVEL_COUNTRY
from panelspark.session import cut_lineage

NODE_TYPES = ("country", "domain", "indicator", "source", "bloc")
NODE = ["node_type", "ref_id"]
ARROW = " → "
_ID_BLOCK = 100_000
_LEAST_GAIN = 1e-12     # of modularity: less is rounding


def graph_nodes(panel: Panel, levels: Sequence[str] | None = (LEVEL_COUNTRY,)) -> DataFrame:
    """(id, node_type, ref_id, label) with dense ids, by type then reference id.

    Ids are counted inside blocks of reference ids and offset by the blocks
    before, so no task sees more than one block.
    """
    geo = panel.geography if levels is None else panel.geography.where(F.col("level").isin(list(levels)))
    tables = (geo, panel.domain, panel.indicator, panel.source, panel.bloc)
    nodes = None
    for rank, (kind, table) in enumerate(zip(NODE_TYPES, tables)):
        part = table.select(F.lit(rank).alias("_rank"), F.lit(kind).alias("node_type"),
                            F.col("id").cast("int").alias("ref_id"), F.col("name").alias("label"))
        nodes = part if nodes is None else nodes.unionByName(part)
    nodes = nodes.withColumn("_block", F.floor(F.col("ref_id") / _ID_BLOCK))
    before = Window.orderBy("_rank", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (nodes.groupBy("_rank", "_block").agg(F.count(F.lit(1)).alias("_n"))
               .select("_rank", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    inside = Window.partitionBy("_rank", "_block").orderBy("ref_id")
    return (nodes.join(offsets, ["_rank", "_block"])
            .select((F.col("_before") + F.row_number().over(inside)).cast("long").alias("id"),
                    "node_type", "ref_id", "label"))


def _edge(df: DataFrame, kind: str, src_type: str, src: str, dst_type: str, dst: str) -> DataFrame:
    return df.select(F.lit(src_type).alias("src_type"), F.col(src).cast("int").alias("src_ref"),
                     F.lit(dst_type).alias("dst_type"), F.col(dst).cast("int").alias("dst_ref"),
                     F.lit(kind).alias("edge_type"), F.lit(1.0).alias("weight"))


def graph_edges(panel: Panel, borders: DataFrame, levels: Sequence[str] | None = (LEVEL_COUNTRY,)) -> DataFrame:
    """Structural edges, endpoints by (type, reference id).

    BELONGS_TO indicator-domain, PROVIDES source-indicator as really ingested,
    MEMBER_OF unit-bloc, BORDERS in both directions. ``borders`` is (iso3_a, iso3_b).
    """
    geo = panel.geography if levels is None else panel.geography.where(F.col("level").isin(list(levels)))
    ids = geo.select(F.col("id").alias("geography_id"))
    belongs = _edge(panel.indicator, "BELONGS_TO", "indicator", "id", "domain", "domain_id")
    delivered = (panel.records.select("source_id", "indicator_id").distinct()
                 .join(panel.source.select(F.col("id").alias("source_id")), "source_id", "left_semi")
                 .join(panel.indicator.select(F.col("id").alias("indicator_id")), "indicator_id", "left_semi"))
    provides = _edge(delivered, "PROVIDES", "source", "source_id", "indicator", "indicator_id")
    spans = (panel.geography_bloc.join(ids, "geography_id", "left_semi")
             .join(panel.bloc.select(F.col("id").alias("bloc_id")), "bloc_id", "left_semi"))
    member = _edge(spans, "MEMBER_OF", "country", "geography_id", "bloc", "bloc_id")
    named = geo.where(F.col("iso3").isNotNull()).select("id", "iso3")
    both = (borders.join(named.select(F.col("iso3").alias("iso3_a"), F.col("id").alias("a")), "iso3_a")
            .join(named.select(F.col("iso3").alias("iso3_b"), F.col("id").alias("b")), "iso3_b"))
    near = _edge(both, "BORDERS", "country", "a", "country", "b").unionByName(
        _edge(both, "BORDERS", "country", "b", "country", "a"))
    return belongs.unionByName(provides).unionByName(member).unionByName(near)


def correlation_edges(mined: DataFrame, indicator: DataFrame) -> DataFrame:
    """Mined pairs as CORRELATES_WITH edges. Source and target follow leader and
    follower where one is confirmed, else the pair's own order; ``direction``
    always speaks of the unswapped pair and travels with it."""
    ids = indicator.select(F.col("name").alias("_name"), F.col("id").cast("int").alias("_id"))
    src, dst = F.coalesce("leader", "indicator_a"), F.coalesce("follower", "indicator_b")
    return (mined.withColumn("_src", src).withColumn("_dst", dst)
            .join(ids.select(F.col("_name").alias("_src"), F.col("_id").alias("src_ref")), "_src")
            .join(ids.select(F.col("_name").alias("_dst"), F.col("_id").alias("dst_ref")), "_dst")
            .select(F.lit("indicator").alias("src_type"), "src_ref", F.lit("indicator").alias("dst_type"), "dst_ref",
                    F.lit("CORRELATES_WITH").alias("edge_type"), "weight"))


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(in + out degree) / (n - 1) over distinct directed edges; isolated nodes 0.

    A hub is counted by partial aggregation, wherever its edges lie.
    """
    arcs = edges.select("src_type", "src_ref", "dst_type", "dst_ref").distinct()
    ends = F.explode(F.array(F.struct(F.col("src_type").alias("node_type"), F.col("src_ref").alias("ref_id")),
                             F.struct(F.col("dst_type").alias("node_type"), F.col("dst_ref").alias("ref_id"))))
    degree = arcs.select(ends.alias("_e")).groupBy("_e.node_type", "_e.ref_id").agg(F.count(F.lit(1)).alias("degree"))
    others = nodes.select("ref_id").agg(F.count(F.lit(1)) - 1).scalar()
    return (nodes.join(degree, NODE, "left")
            .withColumn("degree", F.coalesce("degree", F.lit(0)))
            .withColumn("centrality", F.coalesce(F.try_divide(F.col("degree").cast("double"), others), F.lit(1.0))))


def _neighbours(edges: DataFrame) -> DataFrame:
    """Both directions of the distinct undirected links between (type, id) ends."""
    a, b = F.struct(F.col("src_type").alias("t"), F.col("src_ref").alias("r")), F.struct(
        F.col("dst_type").alias("t"), F.col("dst_ref").alias("r"))
    links = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()
    return links.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")),
                                          F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("_l")
                        ).select(F.col("_l.x").alias("node"), F.col("_l.y").alias("other"))


def communities(nodes: DataFrame, edges: DataFrame, iterations: int = 100) -> DataFrame:
    """Deterministic synchronous label propagation: (node_type, ref_id, community, converged).

    Rounds end when no label moves. Labels may swap for ever between two states, so there is
    an upper number of rounds; ``converged`` says whether the last round moved nothing.

    Every node starts with its own id and repeatedly takes the label most common
    among its neighbours and itself; the smallest label wins ties. Votes are
    counted by partial aggregation, so hubs do not gather their neighbours in
    one task, and every round is written out.
    """
    ids = nodes.select(F.struct(F.col("node_type").alias("t"), F.col("ref_id").alias("r")).alias("node"), "id")
    links = cut_lineage(_neighbours(edges).join(ids.select("node"), "node", "left_semi")
                        .unionByName(ids.select("node", F.col("node").alias("other"))))
    labels, still = cut_lineage(ids.select("node", F.col("id").alias("community"))), False
    for _ in range(iterations):
        votes = (links.join(labels.select(F.col("node").alias("other"), "community"), "other")
                 .groupBy("node", "community").agg(F.count(F.lit(1)).alias("n")))
        updated = cut_lineage(votes.groupBy("node").agg(
            F.min_by("community", F.struct(-F.col("n"), F.col("community"))).alias("community")))
        moved = updated.join(labels, ["node", "community"], "left_anti").limit(1).count()
        labels, still = updated, moved == 0
        if still:
            break
    return labels.select(F.col("node.t").alias("node_type"), F.col("node.r").alias("ref_id"), "community",
                         F.lit(still).alias("converged"))


def _moves(links: DataFrame, at: DataFrame, total: float) -> DataFrame:
    """(u, own, c, gain): for every vertex the community that it would raise modularity most by joining, where any would.

    links is (u, v, w) between different vertices, at is (u, c, k) with k the vertex's weight.
    """
    weight = at.groupBy("c").agg(F.sum("k").alias("t"))
    toward = (links.join(at.select(F.col("u").alias("v"), "c"), "v").groupBy("u", "c").agg(F.sum("w").alias("w"))
              .join(weight, "c"))
    home = at.join(weight.select(F.col("c"), F.col("t").alias("own_t")), "c").select("u", F.col("c").alias("own"), "k", "own_t")
    inner = toward.select("u", F.col("c").alias("own"), F.col("w").alias("own_w"))
    each = toward.join(home, "u").where("c <> own").join(inner, ["u", "own"], "left")
    gain = ((F.col("w") - F.coalesce("own_w", F.lit(0.0))) - F.col("k") * (F.col("t") - F.col("own_t") + F.col("k")) / total) * 2.0 / total
    best = each.withColumn("gain", gain).where(F.col("gain") > _LEAST_GAIN).groupBy("u", "own").agg(
        F.max(F.struct(F.col("gain"), (-F.col("c")).alias("c"))).alias("b"))
    return best.select("u", "own", (-F.col("b.c")).alias("c"), F.col("b.gain").alias("gain"))


def _quality(links: DataFrame, loops: DataFrame, at: DataFrame, total: float) -> float:
    """Modularity of the communities at (u, c, k)."""
    pairs = links.join(at.select("u", "c"), "u").join(at.select(F.col("u").alias("v"), F.col("c").alias("d")), "v").where("c = d")
    inner = pairs.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0] + loops.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    squares = at.groupBy("c").agg(F.sum("k").alias("t")).agg(F.sum(F.col("t") * F.col("t"))).first()[0]
    return inner / total - squares / (total * total)


def _moved(at: DataFrame, moves: DataFrame) -> DataFrame:
    return cut_lineage(at.join(moves.select("u", F.col("c").alias("to")), "u", "left").select(
        "u", F.coalesce("to", "c").alias("c"), "k"))


def _apart(moves: DataFrame) -> DataFrame:
    """Moves of which no two touch one community: each is the best of both communities it joins, so their gains add up."""
    rank = F.struct("gain", (-F.col("u")).alias("u"))
    sides = moves.select(F.explode(F.array("own", "c")).alias("side"), rank.alias("rank"))
    top = sides.groupBy("side").agg(F.max("rank").alias("rank"))
    first, second = top.toDF("own", "_a"), top.toDF("c", "_b")
    return moves.join(first, "own").join(second, "c").where((F.col("_a.u") == -F.col("u")) & (F.col("_b.u") == -F.col("u"))).select(
        "u", "own", "c", "gain")


def modular_communities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_type, ref_id, community): local moves by modularity gain, then communities become the nodes of the next graph.

    In a round every vertex names the community it gains most by joining. Communities are dealt, by a hash that
    changes with the round, into those that give and those that take, and all moves from giving to taking ones are
    made at once; if that does not raise modularity, only moves that touch no community twice are made, whose gains add
    up. So every round raises it, and a level ends when no vertex gains by any move; the whole ends when no community
    of a level has two vertices. A community is named by its smallest node id; nodes without links stay alone.
    """
    ids = nodes.select(F.struct(F.col("node_type").alias("t"), F.col("ref_id").alias("r")).alias("node"), "id")
    links = cut_lineage(_neighbours(edges).join(ids, "node").select("other", F.col("id").alias("u")).join(
        ids.select(F.col("node").alias("other"), F.col("id").alias("v")), "other").select("u", "v", F.lit(1.0).alias("w")))
    loops = links.select("u", "w").limit(0)
    member = cut_lineage(ids.select("id", F.col("id").alias("u")))
    total = links.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    while total > 0:
        weights = links.select("u", "w").unionByName(loops).groupBy("u").agg(F.sum("w").alias("k"))
        at = cut_lineage(weights.select("u", F.col("u").alias("c"), "k"))
        quality, turn, merged = _quality(links, loops, at, total), 0, False
        while True:
            moves = cut_lineage(_moves(links, at, total))
            if moves.limit(1).count() == 0:
                break
            gives, takes = (F.pmod(F.xxhash64(c, F.lit(turn)), F.lit(2)) for c in ("own", "c"))
            tried = _moved(at, moves.where((gives == 0) & (takes == 1)))
            better = _quality(links, loops, tried, total)
            if better <= quality + _LEAST_GAIN:
                tried = _moved(at, _apart(moves))
                better = _quality(links, loops, tried, total)
            at, quality, turn, merged = tried, better, turn + 1, True
        if not merged:
            break
        member = cut_lineage(member.join(at.select("u", "c"), "u", "left").select("id", F.coalesce("c", "u").alias("u")))
        ends = links.join(at.select("u", F.col("c").alias("a")), "u").join(at.select(F.col("u").alias("v"), F.col("c").alias("b")), "v")
        inside = ends.where("a = b").select(F.col("a").alias("u"), "w").unionByName(
            loops.join(at.select("u", "c"), "u").select(F.col("c").alias("u"), "w"))
        loops = cut_lineage(inside.groupBy("u").agg(F.sum("w").alias("w")))
        links = cut_lineage(ends.where("a <> b").groupBy(F.col("a").alias("u"), F.col("b").alias("v")).agg(F.sum("w").alias("w")))
    names = member.groupBy("u").agg(F.min("id").alias("community"))
    return ids.join(member, "id").join(names, "u").select(
        F.col("node.t").alias("node_type"), F.col("node.r").alias("ref_id"), "community")


def modularity(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: modularity Q of a labelling over the undirected links."""
    at = labels.select(F.struct(F.col("node_type").alias("t"), F.col("ref_id").alias("r")).alias("node"), "community")
    ends = (_neighbours(edges).join(at, "node")
            .join(at.select(F.col("node").alias("other"), F.col("community").alias("_c2")), "other"))
    per = ends.groupBy("community").agg(F.count(F.lit(1)).alias("_deg"),
                                        F.count(F.when(F.col("community") == F.col("_c2"), 1)).alias("_in"))
    total = per.agg(F.sum("_deg").cast("double")).scalar()
    share = F.try_divide(F.col("_deg").cast("double"), total)
    return per.agg(F.sum(F.try_divide(F.col("_in").cast("double"), total) - share * share).alias("modularity"))


def top_central(centrality: DataFrame, labels: DataFrame, k: int = 12) -> DataFrame:
    return (centrality.join(labels, NODE, "left").orderBy(F.desc("centrality"), "node_type", "ref_id").limit(k)
            .select("label", "node_type", "ref_id", "centrality", "community"))


# --- propagation --------------------------------------------------------------
def arcs(edges: DataFrame, edge_floor: float = 0.30, by: Sequence[str] = ()) -> DataFrame:
    """(src, dst, weight, directed): one arc along a confirmed direction, else both ways.

    ``edges`` is (indicator_a, indicator_b, weight, direction).
    """
    a, b = F.col("indicator_a"), F.col("indicator_b")
    forward = F.struct(a.alias("src"), b.alias("dst"), F.lit(True).alias("directed"))
    backward = F.struct(b.alias("src"), a.alias("dst"), F.lit(True).alias("directed"))
    both = F.array(F.struct(a.alias("src"), b.alias("dst"), F.lit(False).alias("directed")),
                   F.struct(b.alias("src"), a.alias("dst"), F.lit(False).alias("directed")))
    ways = (F.when(F.col("direction") == "a_leads_b", F.array(forward))
            .when(F.col("direction") == "b_leads_a", F.array(backward)).otherwise(both))
    return (edges.where(F.abs("weight") >= edge_floor).select(*by, F.explode(ways).alias("_w"), "weight")
            .select(*by, "_w.src", "_w.dst", "weight", "_w.directed"))


def propagate(edges: DataFrame, sources: DataFrame, *, shock: float = 1.0, max_hops: int = 3,
              decay: float = 0.6, threshold: float = 0.05, edge_floor: float = 0.30,
              drop_variants: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """The strongest signed path from every source to every node it reaches.

    An arc multiplies the activation by its weight and by ``decay``; arrivals
    below ``threshold`` die; a node keeps its strongest arrival and passes it on
    in the next hop. ``sources`` is (source), plus the ``by`` columns if the
    graph is split (e.g. per unit). With |weight| <= 1 and 0 < decay <= 1 the
    result is the strongest walk of at most ``max_hops`` arcs.

    A hop joins the nodes improved in the hop before with the arcs, and one aggregation sets their offers
    against what is held; only the nodes it improves are written. A row names its predecessor, not its
    path: paths are put together by joins at the end, for the rows of the result. Ties go to the
    earlier hop, then to the predecessor that comes first.
    """
    if not 0 < decay <= 1:
        raise ValueError("decay must be in (0, 1]")
    keys = list(by)
    kept = edges.where(~is_variant(F.col("indicator_a"), F.col("indicator_b"))) if drop_variants else edges
    steps = cut_lineage(arcs(kept, edge_floor, keys))
    fields = ["hop", "activation", "directed", "prev"]
    frontier = sources.select(*keys, "source", F.col("source").alias("node"), F.lit(0).alias("hop"), F.lit(float(shock)).alias("activation"),
                              F.lit(True).alias("directed"), F.lit(None).cast("string").alias("prev")).distinct()
    moves = steps.select(*keys, F.col("src").alias("node"), F.col("dst").alias("_dst"), F.col("weight").alias("_w"),
                         F.col("directed").alias("_d"))
    passed = F.col("activation") * F.col("_w") * decay
    order = F.struct(-F.abs("activation"), F.col("hop"), F.col("prev"))
    held = frontier

    def strongest(arrivals: DataFrame) -> DataFrame:
        return arrivals.groupBy(*keys, "source", "node").agg(F.min_by(F.struct(*fields), order).alias("_s")).select(
            *keys, "source", "node", "_s.*")

    for hop in range(1, max_hops + 1):
        offers = frontier.join(moves, [*keys, "node"]).where(F.abs(passed) >= threshold).select(
            *keys, "source", F.col("_dst").alias("node"), F.lit(hop).alias("hop"), passed.alias("activation"),
            (F.col("directed") & F.col("_d")).alias("directed"), F.col("node").alias("prev"))
        frontier = cut_lineage(strongest(held.unionByName(offers)).where(F.col("hop") == hop))
        held = held.unionByName(frontier)
    reached = strongest(held).where(F.col("node") != F.col("source"))
    if drop_variants:
        reached = reached.where(~is_variant(F.col("node"), F.col("source")))
    # held has a row per (source, node, hop) that was ever passed on from.
    out = reached.withColumn("_path", F.array("node")).withColumn("_at", F.col("prev"))
    for back in range(1, max_hops):
        earlier = held.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("source").alias("_source"), F.col("node").alias("_node"),
                              F.col("hop").alias("_hop"), F.col("prev").alias("_next"))
        same = (F.col("_source") == F.col("source")) & (F.col("_node") == F.col("_at")) & (F.col("_hop") == F.col("hop") - back)
        for k in keys:
            same = same & F.col(f"_{k}").eqNullSafe(F.col(k))
        out = out.join(earlier, same, "left").withColumn("_path", F.when(F.col("_at").isNotNull(), F.concat(
            F.array("_at"), "_path")).otherwise(F.col("_path"))).withColumn("_at", F.col("_next")).drop(
                "_source", "_node", "_hop", "_next", *[f"_{k}" for k in keys])
    path = F.when(F.col("_at").isNotNull(), F.concat(F.array("_at"), "_path")).otherwise(F.col("_path"))
    inner = F.slice(path, F.lit(2), F.greatest(F.size(path) - 2, F.lit(0)))
    return out.select(*keys, "source", "node", "hop", "activation", F.concat_ws(ARROW, inner).alias("via"),
                      F.concat_ws(ARROW, path).alias("path"), "directed")


def collapse_variants(reached: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Of nodes that are variants of each other keep the first in (hop, -|activation|)
    order, comparing each with those already kept. One list per source, as long
    as the indicator catalog at most."""
    keys = [*by, "source"]
    item = F.struct(F.col("hop"), (-F.abs("activation")).alias("_order"), F.col("node"),
                    name_stem(F.col("node")).alias("_stem"), F.col("activation"), F.col("via"), F.col("path"),
                    F.col("directed"))

    def related(x: Column, y: Column) -> Column:
        return x["_stem"].startswith(y["_stem"]) | y["_stem"].startswith(x["_stem"])

    ordered = reached.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    kept = F.aggregate("_items", F.slice("_items", 1, 0), lambda acc, x: F.when(
        F.exists(acc, lambda k: related(x, k)), acc).otherwise(F.concat(acc, F.array(x))))
    return (ordered.select(*keys, F.explode(kept).alias("_k"))
            .select(*keys, "_k.node", "_k.hop", "_k.activation", "_k.via", "_k.path", "_k.directed"))
