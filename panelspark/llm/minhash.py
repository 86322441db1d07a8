"""Near-duplicate documents: universal hash minima, banding, verification, connected components.

1. Python workers turn each text into its set of hashed five-word shingles, 128 minima of universal
   hashes over it, and 32 bands of four minima. Texts with equal words share a class; only the class
   member with the smallest id goes on.
2. Documents that share a band are candidates. Each bucket picks a leader, the member that meets most
   others over all its buckets; members are checked against the leader, by signature, then on the full
   sets. A group of n copies needs n checks, not n * n.
3. Links become components. Only families (the buckets of one leader) that still hold several
   components compare all their members, in blocks of bounded size, again by signature and then on the
   full sets, and only across components.

A pair at the threshold is missed with probability (1 - 0.75**4)**32, about 5e-6; at 0.8 it is 5e-8.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType

from panelspark.llm.components import connected_components
from panelspark.session import cut_lineage

SHINGLE = 5
HASHES, ROWS = 128, 4
BANDS = HASHES // ROWS
MIN_ESTIMATE = 0.56          # 0.75 less five standard deviations of a signature's estimate
BLOCK = 1024                 # members of a block that is compared at once
BROADCAST_ROWS = 2_000_000   # ids beyond this number are joined by shuffle
_CHUNK = 4096                # shingles hashed at once
_CACHE = 500_000             # word hashes remembered by a worker
_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2)
_P = np.uint64(0x9E3779B97F4A7C15)
_FEATURES = "doc_id long, fa long, fb long, n_shingles long, sig binary, bands array<long>"


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def split_words(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased: the methods of bytes know ASCII letters and blanks only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(words: list[bytes], hashes: dict) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; fewer words make one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    span = min(SHINGLE, len(words))
    h = np.full(len(w) - span + 1, span, np.uint64)
    for k in range(span):
        h = h * _P + w[k:len(w) - span + 1 + k]
    return np.unique(_mix(h))


def signature(shingles: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), _CHUNK):
        part = shingles[i:i + _CHUNK]
        np.minimum(low, (part[None, :] * _A[:, None] + _B[:, None]).min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _WordHashes()
    tag = np.arange(BANDS, dtype=np.uint64)
    for batch in batches:
        ids, fa, fb, sizes, sigs, bands, offsets = [], [], [], [], [], [], [0]
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = split_words(text.as_py())
            shingles = shingle_set(words, hashes)
            ids.append(doc_id)
            sizes.append(len(shingles))
            if words:
                low = signature(shingles)
                print_ = xxhash.xxh3_128_digest(b" ".join(words))
                fa.append(int.from_bytes(print_[:8], "little", signed=True))
                fb.append(int.from_bytes(print_[8:], "little", signed=True))
                sigs.append(low.astype(np.uint16).tobytes())
                rows, key = low.reshape(BANDS, ROWS), tag.copy()
                for k in range(ROWS):
                    key = _mix(key * _P + rows[:, k])
                bands.append(key.view(np.int64))
                offsets.append(offsets[-1] + BANDS)
            else:
                for column in (fa, fb, sigs):
                    column.append(None)
                offsets.append(offsets[-1])
        flat = np.concatenate(bands) if bands else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(fa, pa.int64()), pa.array(fb, pa.int64()), pa.array(sizes, pa.int64()),
             pa.array(sigs, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))],
            names=["doc_id", "fa", "fb", "n_shingles", "sig", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = _WordHashes()
    for batch in batches:
        sets = [shingle_set(split_words(t.as_py()), hashes).tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["rep", "shingles"])


def _alike(a: bytes, b: bytes) -> np.ndarray:
    return np.frombuffer(a, np.uint16) == np.frombuffer(b, np.uint16)


@F.pandas_udf(DoubleType())
def _estimate(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([float(_alike(x, y).mean()) for x, y in zip(a, b)], dtype="float64")


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    if 3 * max(len(a), len(b)) > 4 * min(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 75 * (len(a) + len(b) - both)


@F.pandas_udf(BooleanType())
def _verify(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b)],
                     dtype="bool")


def _block_links(key, members: pd.DataFrame) -> pd.DataFrame:
    """Links between different components of two blocks of a family, enough of them to join these."""
    _, i, j = key
    left = members[members.block == i]
    right = left if i == j else members[members.block == j]
    sig = [np.stack([np.frombuffer(s, np.uint16) for s in part.sig]) if len(part) else None for part in (left, right)]
    if sig[0] is None or sig[1] is None:
        return pd.DataFrame({"u": pd.Series(dtype="int64"), "v": pd.Series(dtype="int64")})
    comp = [part.comp.to_numpy() for part in (left, right)]
    size = [part.n.to_numpy() for part in (left, right)]
    found = []
    for r in range(0, len(left), 16):
        rows = slice(r, r + 16)
        est = (sig[0][rows, None, :] == sig[1][None, :, :]).mean(axis=2)
        ok = (est >= MIN_ESTIMATE) & (comp[0][rows, None] != comp[1][None, :])
        ok &= 3 * np.maximum(size[0][rows, None], size[1]) <= 4 * np.minimum(size[0][rows, None], size[1])
        a, b = np.nonzero(ok)
        found.append(np.column_stack([est[a, b], a + r, b]))
    found = np.concatenate(found)
    if i == j:
        found = found[found[:, 1] < found[:, 2]]
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while x in root:
            x = root[x]
        return x

    sets = [[np.frombuffer(s, np.uint64) for s in part.shingles] for part in (left, right)]
    reps, out = [part.rep.to_numpy() for part in (left, right)], []
    for _, a, b in found[np.argsort(-found[:, 0], kind="stable")]:
        a, b = int(a), int(b)
        x, y = top(int(comp[0][a])), top(int(comp[1][b]))
        if x != y and _linked(sets[0][a], sets[1][b]):
            root[max(x, y)] = min(x, y)
            out.append((int(reps[0][a]), int(reps[1][b])))
    return pd.DataFrame(out, columns=["u", "v"]).astype("int64")


def _few(df: DataFrame) -> DataFrame:
    """The (written) table with a broadcast hint if its row count allows it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Two documents are linked when 100 * common >= 75 * all of their distinct shingles; component_id is
    the smallest id reachable, kept marks it. Defined results: a null or blank text has no shingles and
    stands alone; rows of one id are one document; a null id stands alone, has no component and is kept;
    an empty table gives an empty table. Other columns are not read.
    """
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    feats = cut_lineage(given.mapInArrow(_features, _FEATURES))
    real = feats.where("n_shingles > 0 and doc_id is not null")
    reps = cut_lineage(real.groupBy("fa", "fb").agg(
        F.min("doc_id").alias("rep"),
        F.min_by(F.struct("n_shingles", "sig", "bands"), "doc_id").alias("f")).select("fa", "fb", "rep", "f.*"))

    # Buckets with several members, and the leader of each.
    rows = reps.select("rep", F.explode("bands").alias("bucket")).distinct()
    shared = rows.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1")
    links = cut_lineage(rows.join(shared, "bucket"))
    score = links.groupBy("rep").agg(F.sum("c").alias("s"))
    lead = links.join(score, "rep").groupBy("bucket").agg(
        F.max(F.struct(F.col("s"), (-F.col("rep")).alias("r"))).alias("top")).select(
            "bucket", (-F.col("top.r")).alias("leader"))
    family = cut_lineage(links.join(lead, "bucket").select("leader", "rep").distinct())

    # Members against their leader, by signature.
    sigs = reps.select("rep", F.col("n_shingles").alias("n"), "sig").dropDuplicates(["rep"])
    pairs = (family.where("leader <> rep").join(sigs, "rep")
             .join(sigs.toDF("leader", "m", "lsig"), "leader")
             .where("3 * greatest(n, m) <= 4 * least(n, m)")
             .where(_estimate("sig", "lsig") >= MIN_ESTIMATE).select("leader", "rep"))
    pairs = cut_lineage(pairs)

    def sets_of(ids: DataFrame) -> DataFrame:
        texts = given.join(_few(cut_lineage(ids)), given.doc_id == F.col("rep"), "left_semi")
        return cut_lineage(texts.mapInArrow(_sets, "rep long, shingles binary").dropDuplicates(["rep"]))

    sets = sets_of(pairs.select("rep").union(pairs.select("leader")).distinct())
    star = cut_lineage(pairs.join(sets, "rep").join(sets.toDF("leader", "lset"), "leader")
                       .where(_verify("shingles", "lset")).select(F.col("leader").alias("u"), F.col("rep").alias("v")))
    parts = connected_components(star)

    # Families that still hold several components, in blocks.
    placed = family.join(parts, F.col("rep") == F.col("id"), "left").select(
        "leader", "rep", F.coalesce("component", "rep").alias("comp"))
    open_ = placed.groupBy("leader").agg(
        F.count("*").alias("k"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where(
            "lo <> hi and k > 2").select("leader", F.expr(f"cast(ceil(k / {BLOCK}) as int)").alias("blocks"))
    rest = cut_lineage(placed.join(open_, "leader").join(sigs, "rep").withColumn(
        "block", F.expr("cast(pmod(xxhash64(rep), blocks) as int)")))
    rest = rest.join(sets_of(rest.select("rep").distinct()), "rep")
    blocks = rest.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "leader", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        "rep", "comp", "n", "block", "sig", "shingles")
    more = blocks.groupBy("leader", "i", "j").applyInPandas(_block_links, "u long, v long")
    parts = connected_components(star.union(cut_lineage(more)))

    classes = reps.select("fa", "fb", "rep").join(parts, F.col("rep") == F.col("id"), "left").select(
        "fa", "fb", F.coalesce("component", "rep").alias("found"))
    out = feats.select("doc_id", "fa", "fb", "n_shingles").join(classes, ["fa", "fb"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def dedup_stage(docs: DataFrame) -> DataFrame:
    """The documents without those whose component holds a smaller id; columns unchanged."""
    gone = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(_few(cut_lineage(gone)), docs["doc_id"] == F.col("_gone"), "left_anti")
