"""Operator 9: token counts through a digest cache.

The cache is a table of (content digest, tokenizer digest, count).  Texts are
named by the SHA-256 of their normalised content, which here is the text
itself with null as empty: any further change could change a count.  The
tokenizer digest is that of its vocabulary file and library, so a new
vocabulary never meets old counts.  Texts whose digests the cache lacks are
brought together by digest, each distinct one is encoded once, and the new
counts are appended to the cache before the answer is joined from it.

Null text counts as empty (no tokens).  Repeated texts are encoded once, their
rows returned apiece; equal digests are equal texts, so no tie is left open.
An empty table gives an empty table.  Only doc_id and text are read, whatever
other columns are named.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import materialize, shared_dir, text_of
from wordloom.llm.tokens import counter, default_path

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"
_SEEN = 500_000


def tokenizer_digest(path: str) -> str:
    """Of the vocabulary file and the version of the library that reads it."""
    import importlib.metadata

    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"{library} {importlib.metadata.version(library)}".encode()).hexdigest()


def new_cache(spark: SparkSession) -> str:
    """The path of an empty cache in the shared folder."""
    return f"{shared_dir(spark)}/token-cache-{uuid.uuid4().hex}"


def _read(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def _encode_misses(path: str, tokenizer: str):
    """Rows arrive sorted by digest; one of each is encoded."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        last = None
        for batch in batches:
            digests, counts = [], []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if d != last:
                    last = d
                    digests.append(d)
                    counts.append(count(text.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([tokenizer] * len(digests), pa.string()), pa.array(counts, pa.int64())], names=["digest", "tokenizer", "n_tokens"])

    return emit


def _once_a_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves out texts that this task has already sent, so that a hot text is shuffled once a task."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for i, d in enumerate(batch.column(0).to_pylist()):
            if d not in seen:
                keep.append(i)
                if len(seen) < _SEEN:
                    seen.add(d)
        yield batch.take(pa.array(keep, pa.int32())) if len(keep) < batch.num_rows else batch


def fill_cache(texts: DataFrame, cache: str, vocabulary: str, text: str = "text") -> DataFrame:
    """Append the counts of all texts that the cache lacks; returns the cache's rows for this vocabulary."""
    spark = texts.sparkSession
    tokenizer = tokenizer_digest(vocabulary)
    known = _read(spark, cache).where(F.col("tokenizer") == tokenizer)
    asked = texts.select(F.unhex(F.sha2(text_of(text), 256)).alias("digest"), text_of(text).alias("_t")).mapInArrow(_once_a_task, "digest binary, _t string")
    misses = asked if known.isEmpty() else asked.join(known.select("digest"), "digest", "left_anti")
    counted = misses.repartition("digest").sortWithinPartitions("digest").mapInArrow(_encode_misses(vocabulary, tokenizer), CACHE_SCHEMA)
    counted.write.mode("append").parquet(cache)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == tokenizer)


def count_tokens(docs: DataFrame, vocabulary: str | None = None, cache: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of docs (doc_id, text).

    vocabulary is a file path (byte_bpe_50k.json as installed by default); cache is a path that a later call can name again.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or default_path("byte_bpe_50k.json")
    counts = fill_cache(docs, cache or new_cache(spark), vocabulary).select("digest", "n_tokens")
    if cache:  # calls that ran side by side may have counted a text twice
        counts = materialize(counts.dropDuplicates(["digest"]), "counts")
    # both sides come straight from their exchanges, so that the join can split a hot digest
    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text_of()).cast("long").alias("n_bytes"), F.unhex(F.sha2(text_of(), 256)).alias("digest"))
    return asked.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
