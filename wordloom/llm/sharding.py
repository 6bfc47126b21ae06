"""Operator 8: shards by jump consistent hashing, in native expressions.

A key walks through jumps of a 64-bit linear congruential generator; its shard
among n is the last jump below n.  No ring table is kept, and a shard appended
takes 1 / (n + 1) of the keys, from all others, and moves nothing else.  The
64-bit products are put together from 16- and 32-bit halves, so they cannot
overflow under ANSI arithmetic.

Places inside a shard (``slot``) come in two steps: rows are numbered inside
1024 buckets of a shard (a hash of the key and the ordering columns, so that
rows of one key do not meet in one bucket), and buckets start where the counts
of those before them end; no task sees a whole shard.

Null keys count as -1; null text is empty.  Rows that repeat a key share its
shard; which of rows that are equal in key and order takes which slot is open,
as nothing tells them apart.  An empty table gives an empty table.  Only the
key and the ordering columns are read (doc_id and text of documents), whatever
other columns are named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm.common import text_of

_FACTOR = 2862933555777941757
_M0, _M1 = _FACTOR & 0xFFFFFFFF, _FACTOR >> 32
_M32 = 0xFFFFFFFF
BUCKETS = 1024


def _step(hi: Column, lo: Column) -> tuple[Column, Column]:
    """High and low 32 bits of key * factor + 1 modulo 2**64."""

    def low_product(a: Column, m: int) -> Column:
        """a * m modulo 2**32, for 32-bit a and m."""
        a0, a1 = a.bitwiseAND(F.lit(0xFFFF)), F.shiftright(a, 16)
        return (a0 * F.lit(m) + F.shiftleft((a1 * F.lit(m)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(_M32)

    p0 = lo.bitwiseAND(F.lit(0xFFFF)) * F.lit(_M0)
    p1 = F.shiftright(lo, 16) * F.lit(_M0)
    low = p0.bitwiseAND(_M32) + F.shiftleft(p1.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    high = F.shiftright(p0, 32) + F.shiftright(p1, 16) + F.shiftright(low, 32) + low_product(lo, _M1) + low_product(hi, _M0)
    return high.bitwiseAND(_M32), low.bitwiseAND(_M32)


def jump_hash(key: Column, shards: int) -> Column:
    """struct(shard, grown): the shard of a long key among ``shards`` and among one more."""
    if shards < 1:
        raise ValueError("at least one shard")
    key = F.coalesce(key.cast("long"), F.lit(-1).cast("long"))
    hi, lo = F.shiftrightunsigned(key, 32), key.bitwiseAND(_M32)
    long0 = F.lit(0).cast("long")
    start = F.struct(hi.alias("hi"), lo.alias("lo"), long0.alias("j"), long0.alias("shard"), long0.alias("grown"))

    def jump(s: Column, _: Column) -> Column:
        nhi, nlo = _step(s["hi"], s["lo"])
        # the next jump: (j + 1) * 2**31 / (the generator's upper 31 bits + 1)
        far = F.floor((s["j"] + 1) * (F.lit(float(1 << 31)) / (F.shiftright(nhi, 1) + 1).cast("double")))
        on = F.struct(
            nhi.alias("hi"), nlo.alias("lo"), far.alias("j"),
            F.when(s["j"] < shards, s["j"]).otherwise(s["shard"]).alias("shard"), s["j"].alias("grown"),
        )
        return F.when(s["j"] <= shards, on).otherwise(s)

    steps = F.sequence(F.lit(0), F.lit(shards))
    return F.aggregate(steps, start, jump, lambda s: F.struct(s["shard"].cast("int").alias("shard"), s["grown"].cast("int").alias("grown")))


def assign(df: DataFrame, key: str, shards: int, order: list[str]) -> DataFrame:
    """df with shard, grown_shard and slot; slots of a shard go by bucket, then by key and ``order``."""
    bucket = F.pmod(F.xxhash64(key, *order), F.lit(BUCKETS)).cast("int")
    marked = df.withColumn("_j", jump_hash(F.col(key), shards)).withColumns({"shard": F.col("_j.shard"), "grown_shard": F.col("_j.grown"), "_b": bucket}).drop("_j")
    counts = marked.groupBy("shard", "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("shard", "_b").orderBy(key, *order)
    ranked = marked.withColumn("slot", (F.row_number().over(inside) - 1).cast("long"))
    # at most shards * 1024 rows
    joined = ranked.join(F.broadcast(starts) if shards <= 1024 else starts, ["shard", "_b"])
    return joined.withColumn("slot", F.col("slot") + F.col("_first")).drop("_b", "_first")


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row of docs (doc_id, text), under the law ``key``."""
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text_of()) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text_of(), "UTF-8")).alias("text_crc32"),
    )
    return assign(own, "doc_id", shards, ["size", "text_crc32"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
