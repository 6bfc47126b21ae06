"""Vocabularies as tables: lookups by joins, prefix searches by equal length, extension by anti-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.model import BYTE, CONTROL, NORMAL, UNKNOWN, USER_DEFINED, FormatError, Model, Trainer
from wordloom.operators.tokenizer import Tokenizer
from wordloom.sources.model_file import pieces_of

SCHEMA = "id int, piece string, score float, type int, added boolean"
#: Vocabularies up to this size are broadcast (about 64 bytes a row); larger ones are joined by exchange.
BROADCAST_PIECES = 1_000_000


def vocab_df(spark: SparkSession, tok: Tokenizer, with_added: bool = True) -> DataFrame:
    """V6: one row for each id."""
    added = set(tok.vocab.added)
    rows = [(i, p.piece, float(p.score), p.type, i in added) for i, p in enumerate(tok.vocab.pieces) if with_added or i not in added]
    return spark.createDataFrame(rows, SCHEMA)


def from_vocab_df(vocab: DataFrame, trainer: Trainer = Trainer(), **options) -> Tokenizer:
    """A tokenizer from a vocabulary table (id, piece, score, type)."""
    return Tokenizer.from_model(Model(pieces_of(vocab.select("id", "piece", "score", "type").collect()), trainer), **options)


def _hint(vocab: DataFrame, size: int | None) -> DataFrame:
    return F.broadcast(vocab) if size is not None and size <= BROADCAST_PIECES else vocab


def index(vocab: DataFrame) -> DataFrame:
    """V1: (piece, id): the last id of a repeated piece; empty pieces (gaps) aside."""
    return vocab.where("piece <> ''").groupBy("piece").agg(F.max("id").alias("id"))


def piece_to_id(df: DataFrame, piece: str, vocab: DataFrame, unk_id: int, out: str = "id", size: int | None = None) -> DataFrame:
    """V2"""
    found = index(vocab).select(F.col("piece").alias("__piece"), F.col("id").alias("__id"))
    return df.join(_hint(found, size), F.col(piece) == F.col("__piece"), "left").withColumn(out, F.coalesce("__id", F.lit(unk_id))).drop("__piece", "__id")


def contains(df: DataFrame, piece: str, vocab: DataFrame, size: int | None = None) -> DataFrame:
    """V2: rows whose piece is in the vocabulary."""
    found = vocab.where("piece <> ''").select(F.col("piece").alias("__piece"))
    return df.join(_hint(found, size), F.col(piece) == F.col("__piece"), "left_semi")


def describe_ids(df: DataFrame, token_id: str, vocab: DataFrame, trainer: Trainer, size: int | None = None) -> DataFrame:
    """V2 to V5: df with piece, score, type, is_special, is_byte and byte_value of an id; ids outside are unknown pieces of score -infinity."""
    v = _hint(vocab.select(F.col("id").alias("__id"), F.col("piece").alias("__piece"), F.col("score").alias("__score"), F.col("type").alias("__type")), size)
    kind = F.coalesce("__type", F.lit(UNKNOWN))
    piece = F.coalesce("__piece", F.lit(trainer.unk_piece))
    return df.join(v, F.col(token_id) == F.col("__id"), "left").select(
        *df.columns, piece.alias("piece"), F.coalesce("__score", F.lit(float("-inf")).cast("float")).alias("score"), kind.alias("type"),
        kind.isin(CONTROL, UNKNOWN).alias("is_special"), (kind == BYTE).alias("is_byte"), F.when(kind == BYTE, byte_value(piece)).alias("byte_value"),
        *[(F.col(token_id) == getattr(trainer, f"{r}_id")).alias(f"is_{r}") for r in ("unk", "bos", "eos", "pad")],
    )


def byte_value(piece: Column) -> Column:
    """V5: 42 of <0x2A>, null for other pieces."""
    return F.when(piece.rlike("^<0x[0-9A-Fa-f]{2}>$"), F.conv(F.substring(piece, 4, 2), 16, 10).cast("int"))


def byte_token(value: Column) -> Column:
    """V5: <0x2A> of 42."""
    return F.concat(F.lit("<0x"), F.lpad(F.hex(value.cast("int")), 2, "0"), F.lit(">"))


def all_prefixes(df: DataFrame, text: str, vocab: DataFrame, longest: int, start: Column | int = 0, size: int | None = None) -> DataFrame:
    """A3: df with (piece, id, start, end) of every piece at a place of a text; an equal join on substrings of each length."""
    at = F.lit(start) if isinstance(start, int) else start
    lengths = F.sequence(F.lit(1), F.least(F.lit(longest), F.char_length(text) - at))
    cut = df.withColumn("start", at.cast("int")).where(F.char_length(text) > F.col("start")).withColumn("__n", F.explode(lengths))
    cut = cut.withColumn("piece", F.substring(F.col(text), F.col("start") + 1, F.col("__n")))
    return cut.join(_hint(index(vocab), size), "piece").select(*df.columns, "piece", "id", "start", (F.col("start") + F.col("__n")).alias("end"))


def longest_prefix(df: DataFrame, key: str, text: str, vocab: DataFrame, longest: int, start: Column | int = 0, size: int | None = None) -> DataFrame:
    """A2: (key, piece, id, start, end) of the longest piece."""
    found = all_prefixes(df.select(key, text), text, vocab, longest, start, size)
    return found.groupBy(key).agg(F.max_by(F.struct("piece", "id", "start", "end"), "end").alias("m")).select(key, "m.*")


def add_tokens(vocab: DataFrame, tokens: DataFrame, kind: int = USER_DEFINED) -> DataFrame:
    """V7, V8: vocab with the tokens (pos, piece) that it lacks, in the order of pos, each time they stand there; new ids follow the last one.

    The list of tokens is numbered in one task: it is a setting, not data.
    """
    fresh = tokens.join(vocab.select("piece").distinct(), "piece", "left_anti")
    numbered = fresh.withColumn("n", F.row_number().over(Window.orderBy("pos")))
    last = vocab.agg(F.coalesce(F.max("id"), F.lit(-1))).scalar()
    return vocab.unionByName(numbered.select((F.col("n") + last).cast("int").alias("id"), "piece", F.lit(0.0).cast("float").alias("score"), F.lit(kind).alias("type"), F.lit(True).alias("added")))


def added_vocab(vocab: DataFrame) -> DataFrame:
    """(id, piece) of the pieces that were added."""
    return vocab.where("added").select("id", "piece")


def is_added(df: DataFrame, piece: str, vocab: DataFrame, size: int | None = None) -> DataFrame:
    """Df with the id of a piece (null if there is none) and whether it was added."""
    known = vocab.where("piece <> ''").groupBy("piece").agg(F.max(F.struct("id", "added")).alias("__v")).select(F.col("piece").alias("__piece"), "__v")
    found = df.join(_hint(known, size), F.col(piece) == F.col("__piece"), "left")
    return found.select(*df.columns, F.col("__v.id").alias("id"), F.coalesce("__v.added", F.lit(False)).alias("is_added"))


def add_at(vocab: DataFrame, entries: DataFrame) -> DataFrame:
    """Vocab with entries (id, piece, special) at their ids; gaps become empty pieces, conflicts are errors."""
    if not entries.where("id < 0").isEmpty():
        raise ValueError("negative token id")
    taken = entries.join(vocab.select("id", F.col("piece").alias("__other")), "id").where("__other <> '' and __other <> piece")
    moved = entries.join(vocab.where("piece <> ''").select(F.col("id").alias("__other"), "piece"), "piece").where("__other <> id")
    if not (taken.isEmpty() and moved.isEmpty()):
        raise FormatError("an added token conflicts with the vocabulary")
    new = entries.join(vocab.where("piece <> ''"), ["id", "piece"], "left_anti")
    made = new.select(F.col("id").cast("int").alias("id"), "piece", F.lit(0.0).cast("float").alias("score"), F.when(F.col("special"), CONTROL).otherwise(USER_DEFINED).alias("type"), F.lit(True).alias("added"))
    kept = vocab.join(new.select("id"), "id", "left_anti").select("id", "piece", "score", "type", "added").unionByName(made)
    top = kept.agg(F.max("id")).scalar()
    every = vocab.sparkSession.range(1).select(F.explode(F.sequence(F.lit(0), top.cast("int"))).alias("id"))
    return every.join(kept, "id", "left").select("id", F.coalesce("piece", F.lit("")).alias("piece"), F.coalesce("score", F.lit(0.0).cast("float")).alias("score"), F.coalesce("type", F.lit(NORMAL)).alias("type"), F.coalesce("added", F.lit(False)).alias("added"))
