"""Near-duplicates against every pair, and the hard cases."""
from collections import defaultdict

from panelspark.llm import minhash
from panelspark.llm.components import connected_components
from panelspark.llm.registry import QUERIES
import panelspark.llm.queries  # noqa: F401


def sets_of(texts):
    out = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        n = max(1, len(w) - 4)
        out[i] = {tuple(w[k:k + 5]) for k in range(n)} if w else set()
    return out


def brute(texts):
    sets, where = sets_of(texts), defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    root = {i: i for i in texts}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    common = defaultdict(int)
    for ids in where.values():
        for k, a in enumerate(ids):
            for b in ids[:k]:
                common[a, b] += 1
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in texts}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_whole_table_equals_every_pair(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    out = QUERIES["op3_minhash_dedup"](spark, sf)
    assert got(out) == brute({r.doc_id: r.text for r in rows})
    assert all(r.kept == (r.doc_id == r.component_id) for r in out.collect())


def test_edges_of_the_definition(spark, make_docs):
    base = [f"w{i}" for i in range(60)]
    rows = [(5, " ".join(base)), (9, "\t".join(base).upper()), (7, " ".join(base[:58] + ["x", "y"])), (1, None), (2, " \n "),
            (3, "two words"), (4, "Two  WORDS"), (11, "other words"), (12, " ".join(f"z{i}" for i in range(60))), (5, " ".join(base))]
    out = minhash.near_duplicates(make_docs(rows))
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out.collect()) == [
        (1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False), (5, 56, 5, True), (5, 56, 5, True),
        (7, 56, 5, False), (9, 56, 5, False), (11, 1, 11, True), (12, 56, 12, True)]
    kept = minhash.dedup_stage(make_docs(rows))
    assert kept.columns == make_docs(rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 5, 5, 11, 12]


def test_null_ids_and_empty_table(spark, make_docs):
    text = " ".join(f"w{i}" for i in range(20))
    out = minhash.near_duplicates(make_docs([(None, text), (3, text), (None, text), (8, text)])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in out) == [
        (0, 0, True), (0, 0, True), (3, 3, True), (8, 3, False)]
    assert minhash.near_duplicates(make_docs([])).collect() == []
    assert len(minhash.dedup_stage(make_docs([(None, text), (3, text), (8, text)])).collect()) == 2


def test_group_whose_members_differ_from_each_other(spark, make_docs):
    """Copies of one text with edits at different places: most pairs of copies fall below the threshold."""
    import random
    random.seed(3)
    base = [f"w{i}" for i in range(300)]
    texts = {0: None}
    for i in range(1, 120):
        w = list(base)
        for p in random.sample(range(300), random.choice([1, 5, 8, 9, 12])):
            w[p] = f"e{i}x{p}"
        texts[i + 50] = " ".join(w)
    texts[400] = " ".join(base)
    texts[500] = " ".join([f"q{i}" for i in range(2500)] * 9)
    out = minhash.near_duplicates(make_docs(list(texts.items())))
    assert got(out) == brute(texts)


def test_components_of_chains_and_hubs(spark):
    edges = [(i + 1, i) for i in range(100, 140)] + [(500, x) for x in range(600, 650)] + [(7, 7), (None, 3)]
    out = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {i: 100 for i in range(100, 141)} | {i: 500 for i in [500, *range(600, 650)]}
