"""Token counts through a digest cache.

A text's content digest and the tokenizer's version digest are joined to stored counts; only distinct
texts without one are encoded, each once, and their counts are appended to the cache.

The content digest is SHA-256 of the text in the normal form that the tokenizer itself applies, as far as
that can be told to keep every count (see normal_form). The version digest covers the tokenizer's file, its
library and that library's version: a new file or library never reads old counts.

The cache is a folder of Parquet: tokenizer=<version>/batch=<run>/. A run adds a folder of its own, so
concurrent runs do not meet and a run that dies leaves only rows that are right by themselves. Digests that two runs
stored are read once. Texts cross the network once, after copies were dropped where they lie; with a
warm cache only the misses do. A task holds one Arrow batch and the encodings of about SLICE_CHARS characters,
or of one longer text.
"""
from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelspark.llm.common import whole
from panelspark.session import cut_lineage, scratch_folder

LIMIT = 1024                       # tokens; more are over the limit
SLICE_CHARS = 1 << 20              # characters encoded at once
BROADCAST_ROWS = 1_000_000         # missing digests, of 32 bytes each, that are sent to every executor
_COUNTS = "content binary, n_tokens long"


@dataclass(frozen=True)
class Tokenizer:
    """A vocabulary file with what identifies its counts."""
    kind: str          # the library: tokenizers or sentencepiece
    data: bytes
    version: str       # digest of file, library and library version
    one_space: bool    # runs of white space count like one space


def load(path: str) -> Tokenizer:
    """The tokenizer of a .json file (tokenizers) or a .model file (sentencepiece)."""
    kind = {".json": "tokenizers", ".model": "sentencepiece"}.get(os.path.splitext(path)[1])
    if kind is None:
        raise ValueError(f"neither a .json nor a .model file: {path}")
    with open(path, "rb") as f:
        data = f.read()
    library = __import__(kind).__version__
    digest = hashlib.sha256(b"\0".join([kind.encode(), library.encode(), data])).hexdigest()
    return Tokenizer(kind, data, digest, kind == "tokenizers" and _one_space(json.loads(data)))


def _one_space(spec: dict) -> bool:
    """Whether the tokenizer replaces white space runs by a space itself, before words and merges."""
    step = spec.get("normalizer") or {}
    steps = step.get("normalizers", [step])
    collapses = any(s.get("type") == "Replace" and s.get("pattern") == {"Regex": "\\s+"} and s.get("content") == " " for s in steps)
    # Added tokens are cut out before that: they must neither hold nor swallow white space.
    plain = all(not t["lstrip"] and not t["rstrip"] and not any(c.isspace() for c in t["content"])
                for t in spec.get("added_tokens", []))
    return collapses and plain


def normal_form(text: Column, tokenizer: Tokenizer) -> Column:
    """A form of the text with the same number of tokens: null is empty, white space runs are one
    space where the tokenizer makes them so, all else stays (case and composition may not be folded,
    as special strings are looked for before)."""
    return F.regexp_replace(whole(text), r"[\x20\x09-\x0D]+", " ") if tokenizer.one_space else whole(text)


def _encoder(kind: str, data: bytes) -> Callable[[list[str]], list[int]]:
    if kind == "sentencepiece":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=data)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"      # a task has one core
    import tokenizers

    model = tokenizers.Tokenizer.from_str(data.decode())
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(e) for e in model.encode_batch_fast(texts, add_special_tokens=False)]


_LOADED: dict[str, Callable[[list[str]], list[int]]] = {}


def _counter(kind: str, version: str, file) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if version not in _LOADED:
            _LOADED[version] = _encoder(kind, file.value)
        encode = _LOADED[version]
        for batch in batches:
            counts: list[int] = []
            slice_, chars = [], 0
            for text in batch.column(1):
                slice_.append(text.as_py())
                chars += len(slice_[-1])
                if chars >= SLICE_CHARS:
                    counts += encode(slice_)
                    slice_, chars = [], 0
            if slice_:
                counts += encode(slice_)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["content", "n_tokens"])
    return count


def stored_counts(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    """(content, n_tokens), one row per digest, of a tokenizer version; None if nothing is stored."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{cache.rstrip('/')}/tokenizer={version}")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    rows = spark.read.schema(_COUNTS).option("recursiveFileLookup", "true").parquet(path.toString())
    return rows.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def fill_cache(texts: DataFrame, tokenizer: Tokenizer, cache: str) -> int:
    """Encodes the texts (content, text) that have no stored count, each once, and appends their counts.

    Returns the number of distinct digests that were missing.
    """
    spark = texts.sparkSession
    stored = stored_counts(spark, cache, tokenizer.version)
    if stored is None:
        distinct = texts.groupBy("content").agg(F.first("text").alias("text"))
    else:
        missing = cut_lineage(texts.select("content").distinct().join(stored, "content", "left_anti"))
        rows = missing.count()
        if rows == 0:
            return 0
        if rows <= BROADCAST_ROWS:
            distinct = texts.join(F.broadcast(missing), "content", "left_semi").groupBy("content").agg(F.first("text").alias("text"))
        else:       # copies go before the shuffle, which then serves the join as well
            distinct = texts.groupBy("content").agg(F.first("text").alias("text")).join(missing.hint("merge"), "content", "left_semi")
    count = _counter(tokenizer.kind, tokenizer.version, spark.sparkContext.broadcast(tokenizer.data))
    target = f"{cache.rstrip('/')}/tokenizer={tokenizer.version}/batch={os.path.basename(scratch_folder(spark))}"
    distinct.mapInArrow(count, _COUNTS).write.parquet(target)
    return spark.read.schema(_COUNTS).parquet(target).count()


def count_tokens(docs: DataFrame, tokenizer: Tokenizer, cache: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit of every row, as the tokenizer's library counts them.

    No begin, end or added special tokens are set; special strings inside a text are what the library makes
    of them by default; nothing is truncated or padded. cache: the folder of stored counts, a new one without it.
    Defined results: a null text is empty, an empty one has no tokens; a null or repeated doc_id is a row like any
    other; equal texts are encoded once; an empty table gives an empty table. Other columns are not read.
    """
    spark = docs.sparkSession
    cache = cache or scratch_folder(spark)
    given = docs.select("doc_id", F.octet_length(whole("text")).cast("long").alias("n_bytes"),
                        normal_form(F.col("text"), tokenizer).alias("text"))
    content = F.unhex(F.sha2("text", 256)).alias("content")
    keyed = cut_lineage(given.select("doc_id", "n_bytes", content))
    fill_cache(given.select(content, "text"), tokenizer, cache)
    counts = stored_counts(spark, cache, tokenizer.version)
    if counts is None:        # no rows at all
        counts = spark.createDataFrame([], _COUNTS)
    return keyed.join(counts, "content", "left").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
