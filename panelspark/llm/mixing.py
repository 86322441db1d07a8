"""Mixing sources to target weights, by blocks of words.

Each source is one stream of words, cut into blocks of fixed length. The mix has as many slots as its
targets need blocks. Slots are dealt to output shards by a pseudorandom permutation, so a shard's counts
of sources are a multinomial draw under the condition that every source meets its total. The k-th slot of
a source takes the block at place k of the source's own pseudorandom permutation, starting over after the
last block. Blocks and slots are joined by index: a permutation can be run backwards, so every block finds its slots
where its words lie, and neither side is shuffled for it.

The mix is a table of blocks with their words, shard and slot; what it takes of a document is counted from the
pieces of documents in that table. A block's words are joined by single spaces.

DataFrame operations only. Offsets in a stream are running sums inside hashed pieces of bounded size plus
the totals of the pieces before, so that no source is ordered in one task. Texts are shuffled once, by piece; of
a piece's blocks only the first and the last, which other pieces share, are shuffled again.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelspark.llm.common import few, whole, word_count, words
from panelspark.session import cut_lineage

WEIGHTS = [3, 1, 2]      # of the sources in order of their names, repeating
SHARE = 1.5              # words of the mix per word of the input
EPOCHS = 2               # a source gives at most this many times its words
BLOCK = 256              # words of a block
SHARD_SLOTS = 1024       # blocks of an output shard
PIECE = 1_000            # documents whose running sum one task builds, on average
SLOT_PIECE = 10_000      # slots made from one row
SLOT_TASKS = 4_096       # tasks that make them, at most
_ROUNDS = 16


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, epochs=EPOCHS) -> DataFrame:
    """(source, source_size, target): shares by weight, none above epochs times the source's size.

    One row per source is ordered in one task; texts and documents are not.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                           F.pmod(rank, F.lit(len(weights))) + 1))
    per = per.withColumn("cap", F.lit(float(epochs)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    per = per.withColumn("full", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    per = per.withColumn("left", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    per = per.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(every))
    # The level: words per unit of weight once all sources with a lower cap per weight are full.
    per = per.withColumn("level", (F.col("total") - F.col("full")) / F.col("left"))
    per = per.withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(
        (F.col("cap") / F.col("w")).alias("c"), F.col("level").alias("l")))).over(every)["l"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("w")))
    return per.select("source", "source_size", target.alias("target"))


def place(x: Column, size: Column, seed: Column, back: bool = False) -> Column:
    """Where a pseudorandom permutation of 0..size-1 sends x: swap-or-not rounds, exact for every size. back: what is sent to x."""
    def swap(at: Column, r: Column) -> Column:
        mate = F.pmod(F.pmod(F.xxhash64(seed, r), size) - at, size)
        coin = F.xxhash64(seed, r + _ROUNDS, F.greatest(at, mate))
        return F.when(coin > 0, mate).otherwise(at)

    first, last = (_ROUNDS - 1, 0) if back else (0, _ROUNDS - 1)      # a round undoes itself
    return F.aggregate(F.sequence(F.lit(first), F.lit(last)), x.cast("long"), swap)


def _sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, text, their number of words, and what tells rows of one id apart."""
    return docs.select("doc_id", "source", "text", word_count("text").alias("size"), F.xxhash64(whole("text")).alias("_salt"))


def _keyed(df: DataFrame) -> DataFrame:
    """With a source key that is never null: joins and groups on it keep one partitioning."""
    return df.withColumn("_s", F.coalesce("source", F.lit(""))).withColumn("_none", F.col("source").isNull())


def _piecewise(docs: DataFrame, sized: DataFrame) -> DataFrame:
    """docs with source key, piece, start, and what its piece covers: _head to _end of the _total words of its source.

    The rows lie by piece, in order.
    """
    key = ["_s", "_none", "_piece"]
    counts = cut_lineage(_keyed(sized.groupBy("source").agg(F.ceil(F.count("*") / PIECE).alias("_pieces"))).drop("source"))
    counts = few(counts, F.length("_s") * 2 + 128)

    def dealt(df: DataFrame) -> DataFrame:
        return _keyed(df).join(counts, ["_s", "_none"]).withColumn(
            "_piece", F.pmod(F.xxhash64("doc_id", "size", "_salt"), F.col("_pieces"))).drop("_pieces")

    inside = Window.partitionBy(*key).orderBy("doc_id", "size", "_salt")
    before = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    earlier = Window.partitionBy("_s", "_none").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    heads = dealt(sized).groupBy(*key).agg(F.sum("size").alias("words")).withColumn(
        "_head", F.coalesce(F.sum("words").over(earlier), F.lit(0))).select(
            *key, "_head", (F.col("_head") + F.col("words")).alias("_end"), F.sum("words").over(Window.partitionBy("_s", "_none")).alias("_total"))
    return dealt(docs).withColumn("_before", before).join(heads.hint("merge"), key).withColumn(
        "start", F.col("_head") + F.col("_before")).drop("_before")


def streams(docs: DataFrame) -> DataFrame:
    """docs without _salt, with start: every document's place in its source's stream of words."""
    return _piecewise(docs, docs).select(*[c for c in docs.columns if c != "_salt"], "start")


def _name(seed: int) -> Column:
    return F.coalesce(F.xxhash64("source"), F.lit(0).cast("long")) + F.lit(seed)


def slots(plan: DataFrame, seed: int = 0) -> DataFrame:
    """(shard, slot, source, epoch, block): which block fills which slot of the mix.

    plan: targets() with the blocks of each source, the slots it gets and the slots before it.
    """
    pieces = plan.agg(F.sum(F.ceil(F.col("slots") / SLOT_PIECE))).first()[0] or 0
    piece = plan.where("slots > 0").withColumn("piece", F.explode(F.expr(
        f"sequence(0, cast((slots - 1) div {SLOT_PIECE} as bigint))"))).repartition(
            max(1, min(int(pieces), SLOT_TASKS)), "source", "piece")
    each = piece.withColumn("k", F.explode(F.expr(
        f"sequence(piece * {SLOT_PIECE}, least(piece * {SLOT_PIECE} + {SLOT_PIECE} - 1, slots - 1))")))
    block = place(F.pmod(F.col("k"), F.col("blocks")), F.col("blocks"), _name(seed))
    at = place(F.col("first") + F.col("k"), F.col("all_slots"), F.lit(seed).cast("long"))
    dealt = each.select("source", F.expr("k div blocks").alias("epoch"), block.alias("block"), at.alias("at"))
    return dealt.select(F.expr(f"at div {SHARD_SLOTS}").alias("shard"), F.expr(f"at % {SHARD_SLOTS}").alias("slot"),
                        "source", "epoch", "block")


def plan_of(per_source: DataFrame) -> DataFrame:
    """targets() with blocks, slots, first (slots of the sources before) and all_slots."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    blocks = F.ceil(F.col("source_size") / F.lit(BLOCK))
    out = per_source.withColumn("blocks", blocks).withColumn("slots", F.when(F.col("source_size") > 0, F.round(
        F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(0).cast("long"))
    before = F.sum("slots").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return out.withColumn("first", F.coalesce(before, F.lit(0))).withColumn(
        "all_slots", F.sum("slots").over(Window.partitionBy(F.lit(0))))


def _blocks(placed: DataFrame, whole_blocks: bool, *key: str) -> DataFrame:
    """(_s, _none, block, text, pieces): the blocks that lie in one piece, or those that several pieces share.

    placed: the documents of _piecewise(). A block's text is put together from its documents' parts, in order.
    """
    def in_piece(b: Column) -> Column:
        inside = (b * BLOCK >= F.col("_head")) & (F.least((b + 1) * BLOCK, F.col("_total")) <= F.col("_end"))
        return inside if whole_blocks else ~inside

    def part(all_words: Column, block: Column) -> Column:
        at = F.greatest(F.col("start"), block * BLOCK)
        n = F.least(F.col("start") + F.col("size"), (block + 1) * BLOCK) - at
        text = F.array_join(F.slice(all_words, (at - F.col("start") + 1).cast("int"), n.cast("int")), " ")
        return F.struct(block.alias("block"), at.alias("at"), n.alias("words"), text.alias("text"))

    blocks = F.filter(F.sequence(F.expr(f"start div {BLOCK}"), F.expr(f"(start + size - 1) div {BLOCK}")), in_piece)
    touched = placed if whole_blocks else placed.where(F.size(blocks) > 0)
    # The outer transform splits a text once; the outer explode keeps Catalyst from repeating it in a filter below.
    parts = F.get(F.transform(F.array(words("text")), lambda w: F.transform(blocks, lambda b: part(w, b))), 0)
    cut = touched.select("_s", "_none", "_piece", "doc_id", "start", F.explode_outer(parts).alias("p")).where("p is not null").select(
        "_s", "_none", "_piece", "p.block", F.struct("p.at", "doc_id", "start", "p.words", "p.text").alias("p"))
    return cut.groupBy("_s", "_none", *key, "block").agg(F.array_sort(F.collect_list("p")).alias("_all")).select(
        "_s", "_none", "block", F.array_join(F.transform("_all", lambda p: p["text"]), " ").alias("text"),
        F.transform("_all", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["start"].alias("start"), p["words"].alias("words"))
                    ).alias("pieces"))


def slots_of(block: Column, seed: int = 0) -> Column:
    """(epoch, at): the slots that take a block of a source, found by running slots() backwards on the columns of plan_of()."""
    k = place(block, F.col("blocks"), _name(seed), back=True)
    times = F.expr("sequence(cast(0 as bigint), greatest(cast(0 as bigint), (slots - 1) div blocks))")
    # The outer transform keeps k from being computed again for every epoch.
    taken = F.get(F.transform(F.array(k), lambda first: F.filter(
        F.transform(times, lambda e: F.struct(e.alias("epoch"), (first + e * F.col("blocks")).alias("k"))),
        lambda t: t["k"] < F.col("slots"))), 0)
    return F.transform(taken, lambda t: F.struct(t["epoch"].alias("epoch"), place(
        F.col("first") + t["k"], F.col("all_slots"), F.lit(seed).cast("long")).alias("at")))


def _mixed(docs: DataFrame, sized: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    placed = _piecewise(_sized(docs).where("size > 0"), sized)
    # Grouping by piece needs no shuffle after that by piece; the shared blocks, two of a piece, need one.
    blocks = _blocks(placed, True, "_piece").union(_blocks(placed, False))
    per_source = few(_keyed(plan.select("source", "blocks", "slots", "first", "all_slots")), F.length("_s") * 4 + 256)
    used = blocks.join(per_source, ["_s", "_none"]).withColumn("_slot", F.explode_outer(slots_of(F.col("block"), seed))).where("_slot is not null")
    return cut_lineage(used.select(F.expr(f"_slot.at div {SHARD_SLOTS}").alias("shard"), F.expr(f"_slot.at % {SHARD_SLOTS}").alias("slot"),
                                   "source", "_slot.epoch", "block", "text", "pieces"), compression="zstd")


def _planned(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    sized = cut_lineage(_sized(docs).drop("text"))
    return sized, cut_lineage(plan_of(targets(sized)))


def mixed_blocks(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(shard, slot, source, epoch, block, text, pieces): the mix itself, a row per slot, read from a written table.

    pieces (doc_id, start, words) are the documents a block was cut from, in order. Slots of a shard are numbered
    in the order of the mix; rows of the table are in no order.
    """
    return _mixed(docs, *_planned(docs), seed)


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes, repeats counted) of every row.

    taken is counted from the table of mixed_blocks(), which is written for it.
    Defined results: null and blank texts have size 0 and are taken 0 times; null is a source of its
    own, last in order; rows that agree in id, source and text are each a document, and which of them
    comes first does not matter; an empty table gives an empty table. A document's words are taken at
    most EPOCHS times. Other columns are not read.
    """
    sized, plan = _planned(docs)
    taken = _keyed(_mixed(docs, sized, plan, seed)).select("_s", "_none", F.explode("pieces").alias("p")).groupBy(
        "_s", "_none", F.col("p.start").alias("start")).agg(F.sum("p.words").alias("taken")).withColumn("_some", F.lit(True))
    # Rows without words share their place in the stream with the next row, but have no piece in the mix.
    placed = _keyed(streams(sized)).withColumn("_some", F.col("size") > 0)
    per_doc = placed.join(taken.hint("merge"), ["_s", "_none", "start", "_some"], "left")
    per_source = _keyed(plan).select("_s", "_none", "source_size", "target")
    return per_doc.join(per_source, ["_s", "_none"]).select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
