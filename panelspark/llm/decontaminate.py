"""Benchmark leaks by template windows: numbers, names and units become typed placeholders.

Windows of eight canonical words are hashed on both sides and joined. A document is a candidate for
an item when it holds enough of the item's windows. Candidates are then compared word by word: in one
occurrence a value of the item behind a placeholder must have one value in the document, so that a
question with other numbers or names is caught, and texts that merely share a frame are not. A window
that holds another value than most does not count; the others do.

Placeholders need a frame: a window with more placeholders than literal words is matched by its plain words, so
that lists of numbers or names are not taken for each other. Names are told by their upper case, so every window
has a case-free form, without placeholders for names, and one with them. A document holds a window when either
form matches. An item shorter than a window is one window of its own length, unless that is a common phrase.

DataFrame operations only. Document windows are matched inside the scan while the benchmark's windows
are few enough to broadcast, which is measured first; beyond that both sides are shuffled by hash.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelspark.llm.common import SPACE, few, unused, whole
from panelspark.session import cut_lineage

WINDOW = 8                   # words
SHORTEST = 4                 # words of an item; with fewer it cannot be told from a common phrase
MIN_COVER_PERCENT = 50       # share of an item's window positions a document must hold
MIN_COVER = 24               # or so many of them: a quote of 31 words, whatever its share
COMMON_TEXTS, COMMON_SHARE = 10, 1000    # an item under WINDOW words is a common phrase in more texts, and in more than one of so many

# Measuring units that may follow a number.
UNITS = ("km cm mm m mi ft in yd kg g mg lb lbs oz l ml gal h hr hrs hours hour min minutes minute s sec seconds second "
         "days day weeks week months month years year km/h mph m/s hz khz mhz ghz w kw mw v a j kj cal kcal c f k pa bar "
         "usd eur gbp dollars dollar euros euro cents cent percent % miles mile meters meter metres metre "
         "kilometers kilometer kilograms kilogram grams gram pounds pound liters liter litres litre").split()

# Stands before a name until words are compared; a private character, removed from texts first.
_MARK = "\ue000"

# Each pattern tests a character before it looks behind: most characters are ruled out at once.
_EDGE = (r"[\p{P}\p{S}&&[^<>]](?<=[\p{L}\p{N}>][\p{P}\p{S}])[\p{P}\p{S}&&[^<>]]*(?=[\x20\x09-\x0D]|$)"
         r"|[\p{P}\p{S}&&[^<>+-]](?<=(?:^|[\x20\x09-\x0D])[\p{P}\p{S}])[\p{P}\p{S}&&[^<>+-]]*(?=[\p{L}\p{N}\x{E000}])")
_NUMBER = r"(?<![\p{L}\p{N}])[+-]?[0-9]+(?:[.,:/][0-9]+)*"
_NAME = r"\p{Lu}(?<=[^.!?:;\x20\x09-\x0D]\x20\p{Lu})\p{Ll}+"
_UNIT = r"(?<=<num>|<num>\x20)(?:" + "|".join(sorted((u for u in UNITS), key=len, reverse=True)) + r")(?![\p{L}\p{N}])"


def _bare(text: Column) -> Column:
    """Lower-cased words without punctuation around them, names behind a mark."""
    named = F.regexp_replace(F.replace(text, F.lit(_MARK), F.lit("")), _NAME, _MARK + "$0")
    return F.regexp_replace(F.lower(named), _EDGE, "")


def _numbered(bare: Column) -> Column:
    """Placeholders for numbers and for units after them; as many words as before."""
    return F.when(F.rlike(bare, F.lit("[0-9]")), F.regexp_replace(F.regexp_replace(bare, _NUMBER, "<num>"), _UNIT, "<unit>")
                  ).otherwise(bare)


def _split(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _unmarked(text: Column) -> Column:
    return _split(F.replace(text, F.lit(_MARK), F.lit("")))


def _bound(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _mixed(first: Column, rest: Column, step: int) -> Column:
    """Hash of what starts at each word and goes on step words later. The four low bits count placeholders."""
    def at(x: Column, y: Column) -> Column:
        return F.xxhash64(x, y).bitwiseAND(F.lit(-16)) + x.bitwiseAND(F.lit(15)) + y.bitwiseAND(F.lit(15))

    if first is rest:
        return _bound(first, lambda a: F.transform(a, lambda x, i: at(x, F.get(a, i + step))))
    return _bound(rest, lambda b: F.transform(first, lambda x, i: at(x, F.get(b, i + step))))


def _hashes(words: Column, length: int) -> Column:
    """Hash of the window of so many words that starts at each word, in order; null for texts that are shorter."""
    level = F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(F.lit(-16)) + F.when(w.contains("<"), 1).otherwise(0))
    out, step = None, 1
    while True:
        if length & step:
            out = level if out is None else _mixed(level, out, step)
        if 2 * step > length:
            break
        level, step = _mixed(level, level, step), 2 * step
    return F.when(F.size(words) >= length, F.slice(out, 1, F.size(words) - (length - 1)))


def _framed(hashes: Column, plain: Column, length: int) -> Column:
    """The hashes, that of the plain words where a window has more placeholders than literal words."""
    def loose(x: Column) -> Column:
        return x.bitwiseAND(F.lit(15)) * 2 > length

    return F.when(F.exists(hashes, loose), _bound(_hashes(plain, length), lambda p: F.transform(
        hashes, lambda x, i: F.when(loose(x), F.get(p, i)).otherwise(x)))).otherwise(hashes)


def _forms(texts: DataFrame, *keys: str) -> DataFrame:
    """(keys, _p, _k, _c): plain words, those with numbers and units replaced, and with names too, null if there are none."""
    step = texts.select(*keys, _bare(whole("text")).alias("_b"))
    step = step.select(*keys, "_b", _numbered(F.col("_b")).alias("_m"))
    named = F.when(F.col("_m").contains(_MARK), _split(F.regexp_replace("_m", _MARK + r"\p{L}+", "<name>")))
    return step.select(*keys, _unmarked(F.col("_b")).alias("_p"), _unmarked(F.col("_m")).alias("_k"), named.alias("_c"))


def _hashed(texts: DataFrame, length: int, *keys: str) -> DataFrame:
    """(keys, _p, _k, _c, _h, _g): _forms() with the hashes of the windows of both forms."""
    step = _forms(texts, *keys)
    step = step.withColumn("_h", _hashes(F.col("_k"), length)).withColumn("_g", F.when(F.col("_c").isNotNull(), _hashes(F.col("_c"), length)))
    return step.withColumn("_h", _framed(F.col("_h"), F.col("_p"), length)).withColumn("_g", _framed(F.col("_g"), F.col("_p"), length))


def _held(texts: DataFrame, lengths: list[int], *keys: str) -> DataFrame:
    """(keys, hash): the distinct windows of every text, of each length, in both forms."""
    def one(length: int) -> DataFrame:
        both = F.array_distinct(F.concat("_h", F.coalesce("_g", F.array().cast("array<long>"))))
        # The outer form keeps Catalyst from repeating the hashes in a filter below; nulls go right after.
        return _hashed(texts, length, *keys).select(*keys, F.explode_outer(both).alias("hash")).where("hash is not null")

    return reduce(DataFrame.union, [one(n) for n in lengths])


def _windows(texts: DataFrame, length: int, *keys: str) -> DataFrame:
    """(keys, at, hash, first, canon, plain) of every window in both forms, once if they agree.

    at is its position, first says that it is the case-free form, canon has the words that were hashed, plain the values.
    """
    def cut(words: Column, at: Column) -> Column:
        return F.slice(words, at + 1, length)

    other = F.transform("_g", lambda h, i: F.struct(i.alias("at"), F.when(h != F.get("_h", i), h).alias("hash"), F.lit(False).alias("first")))
    main = F.transform("_h", lambda h, i: F.struct(i.alias("at"), h.alias("hash"), F.lit(True).alias("first")))
    both = F.concat(main, F.coalesce(other, F.slice(main, 1, 0)))
    step = _hashed(texts, length, *keys).select(*keys, "_p", "_k", "_c", F.explode_outer(both).alias("w")).where("w.hash is not null")
    step = step.select(*keys, "w.at", "w.hash", "w.first", cut(F.when(F.col("w.first"), F.col("_k")).otherwise(F.col("_c")), F.col("w.at")).alias("c"),
                       cut(F.col("_p"), F.col("w.at")).alias("plain"))
    loose = F.size(F.filter("c", lambda w: w.contains("<"))) * 2 > length
    return step.select(*keys, "at", "hash", "first", F.when(loose, F.col("plain")).otherwise(F.col("c")).alias("canon"), "plain")


def text_key(text: str = "text") -> list[Column]:
    """What stands for a text in joins: a leak depends on the text alone, so copies share it."""
    return [F.xxhash64(whole(text)).alias("_t"), F.length(whole(text)).alias("_n")]


def _consistent(found: DataFrame) -> DataFrame:
    """Matched windows whose values are those of their run, or that equal the item's window word for word.

    A run is one occurrence of an item: the windows on one offset, at most as many as the item has words. In a run
    a value of the item stands for the document's value that most windows hold, the greatest of equals.
    """
    run = ["_t", "_n", "item_id", "offset"]
    pairs = F.filter(F.arrays_zip("canon", "item_plain", "plain"), lambda x: x["canon"].contains("<"))
    values = F.transform(pairs, lambda x: F.struct(x["item_plain"].alias("a"), x["plain"].alias("b")))
    # A shuffle by runs serves all the steps below.
    each = found.withColumn("offset", F.col("at") - F.col("item_at")).repartition(*run).select(
        *run, "item_at", "hash", (F.col("plain") == F.col("item_plain")).alias("same"), F.explode_outer(values).alias("v"))
    each = each.select(*run, "item_at", "hash", "same", "v.a", "v.b")
    each = each.withColumn("votes", F.count("*").over(Window.partitionBy(*run, "a", "b")))
    each = each.withColumn("best", F.max(F.struct("votes", "b")).over(Window.partitionBy(*run, "a"))["b"])
    return each.groupBy(*run, "item_at", "hash").agg(F.max("same").alias("same"), F.every(
        F.coalesce(F.col("b") == F.col("best"), F.lit(True))).alias("fits")).where("same or fits")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(_t, _n, item_id, cover): texts that hold an item, and the percentage of its windows they hold.

    Defined results: null and empty texts, items of less than SHORTEST words or without an id never match; an
    item under WINDOW words is one window, and matches nothing if more than COMMON_TEXTS texts and more than one text of
    COMMON_SHARE hold it; repeated documents share one result, repeated items count once; empty tables
    give an empty result; columns other than text, item_id and text are not read.
    """
    items = benchmark.where("item_id is not null").select("item_id", "text").distinct()
    sized = cut_lineage(items.withColumn("_size", F.size(_split(whole("text")))).where(f"_size >= {SHORTEST}"))
    lengths = sorted({WINDOW} | {r[0] for r in sized.where(f"_size < {WINDOW}").select("_size").distinct().collect()})
    parts = [_windows(sized.where(f"least(_size, {WINDOW}) = {n}"), n, "item_id").withColumn("item_length", F.lit(n)) for n in lengths]
    item_windows = cut_lineage(reduce(DataFrame.union, parts).toDF(
        "item_id", "item_at", "hash", "item_first", "item_canon", "item_plain", "item_length"))
    totals = item_windows.where("item_first").groupBy("item_id", "item_length").agg(F.count("*").alias("windows"))
    keyed = docs.select(*text_key(), whole("text").alias("text"))

    marks = few(item_windows.select("hash", "item_id", "item_at"), 64)
    held = _held(keyed, lengths, "_t", "_n").join(marks, "hash").groupBy("_t", "_n", "item_id", "item_at").count().groupBy(
        "_t", "_n", "item_id").agg(F.count("*").alias("k"))
    enough = F.expr(f"100 * k >= {MIN_COVER_PERCENT} * windows or k >= {MIN_COVER}")
    candidates = cut_lineage(held.join(totals, "item_id").where(enough).select("_t", "_n", "item_id", "item_length"))

    texts = keyed.join(few(cut_lineage(candidates.select("_t", "_n").distinct()), 64), ["_t", "_n"], "left_semi").dropDuplicates(["_t", "_n"])
    if len(lengths) > 1:
        texts = cut_lineage(texts)
    wide = few(item_windows, F.length(F.array_join("item_canon", " ")) * 2 + F.length(F.array_join("item_plain", " ")) * 2 + 512)
    found = reduce(DataFrame.union, [_windows(texts, n, "_t", "_n").join(wide.where(F.col("item_length") == n), "hash") for n in lengths])
    found = found.join(candidates.drop("item_length"), ["_t", "_n", "item_id"]).where(F.col("canon") == F.col("item_canon"))
    covered = _consistent(found).select("_t", "_n", "item_id", "item_at").distinct()
    out = covered.groupBy("_t", "_n", "item_id").agg(F.count("*").alias("k")).join(totals, "item_id").where(enough).select(
        "_t", "_n", "item_id", F.expr("100 * k / windows").alias("cover"), "item_length")
    if lengths == [WINDOW]:
        return out.drop("item_length")
    out = cut_lineage(out)
    texts_of = out.where(f"item_length < {WINDOW}").groupBy("item_id").agg(F.count("*").alias("c"))
    common = cut_lineage(texts_of.where((F.col("c") > COMMON_TEXTS) & (F.col("c") * COMMON_SHARE > F.lit(keyed.select("_t", "_n").distinct().count()))))
    return out.join(common, "item_id", "left_anti").drop("item_length")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_items (leaked items), item_id (the smallest), contaminated and kept, per document row.

    Defined results: those of leaks(); every row has one, with null ids and repeated ids too; a null or empty text holds nothing.
    """
    found = leaks(docs, benchmark).groupBy("_t", "_n").agg(
        F.count_distinct("item_id").alias("n_items"), F.min("item_id").alias("item_id"))
    out = docs.select("doc_id", *text_key()).join(few(cut_lineage(found), 96), ["_t", "_n"], "left")
    hit = F.col("n_items").isNotNull()
    return out.select("doc_id", F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), "item_id",
                      hit.alias("contaminated"), (~hit).alias("kept"))


def decontaminate_stage(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without those that hold a benchmark item; columns unchanged.

    Defined results: those of leaks(); null and empty texts stay, copies go together, names of columns do not matter.
    """
    a, b = unused(docs, "_gone_t"), unused(docs, "_gone_n")
    gone = few(cut_lineage(leaks(docs, benchmark).select(F.col("_t").alias(a), F.col("_n").alias(b)).distinct()), 64)
    t, n = text_key()
    return docs.join(gone, (t == F.col(a)) & (n == F.col(b)), "left_anti")
