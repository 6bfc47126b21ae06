"""The algebra of encodings as native Column expressions over the encoding struct; no Python runs on executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.model import DO_NOT_TRUNCATE, LONGEST_FIRST, ONLY_FIRST, ONLY_SECOND
from wordloom.operators.encoding import FIELDS

SPAN = "struct<start:int,end:int>"
KINDS = dict(zip(FIELDS, ("array<string>", "array<int>", "array<int>", "array<int>", "array<int>", f"array<{SPAN}>", "array<int>", "array<int>")))
SCHEMA = "struct<" + ",".join(f"{k}:{v}" for k, v in KINDS.items()) + ">"
Int = Column | int
#: Batches whose longest lengths are collected and sent to all tasks.
BROADCAST_BATCHES = 50_000


def _int(x: Int) -> Column:
    return (F.lit(x) if isinstance(x, int) else x).cast("int")


def _col(enc: Column | str) -> Column:
    return F.col(enc) if isinstance(enc, str) else enc


def _no_span() -> Column:
    return F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))


def _each(of: Callable[[str], Column]) -> Column:
    return F.struct(*[of(f).cast(KINDS[f]).alias(f) for f in FIELDS])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once a row: lambdas compute what they take from outside anew for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def empty() -> Column:
    """M2"""
    return _each(lambda f: F.array())


def content(tokens: Column, ids: Column, offsets: Column, word_ids: Column, type_id: Int = 0, sequence_id: Int | None = None, n: Column | None = None) -> Column:
    """Content tokens from parallel arrays.

    Where their number is given, the fields are made in place, each from its own array, and nothing is held or copied.
    """
    if n is not None:
        return F.struct(*[of.alias(f) for f, of in zip(FIELDS, (tokens, ids, F.array_repeat(_int(type_id), n), F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), n), offsets, word_ids, F.array_repeat(_int(type_id if sequence_id is None else sequence_id), n)))])

    def body(s: Column) -> Column:
        n = F.size(s["ids"])
        parts = (s["tokens"], s["ids"], F.array_repeat(_int(type_id), n), F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), n), s["offsets"], s["words"], F.array_repeat(_int(type_id if sequence_id is None else sequence_id), n))
        return _each(dict(zip(FIELDS, parts)).__getitem__)

    return let(F.struct(tokens.alias("tokens"), ids.alias("ids"), offsets.alias("offsets"), word_ids.alias("words")), body)


def special(token: str, token_id: int, type_id: int = 0) -> Column:
    null = F.lit(None).cast("int")
    parts = (F.lit(token), F.lit(token_id), F.lit(type_id), F.lit(1), F.lit(1), _no_span(), null, null)
    return _each(lambda f: F.array(dict(zip(FIELDS, parts))[f]))


def joined(*encodings: Column) -> Column:
    bound = F.struct(*[e.alias(f"e{i}") for i, e in enumerate(encodings)])
    return let(bound, lambda s: _each(lambda f: F.concat(*[s[f"e{i}"][f] for i in range(len(encodings))])))


def joined_in_place(*encodings: Column, fields: tuple[str, ...] = FIELDS) -> Column:
    """The same of structs that are made in place, or of some of their fields: what is not asked for is not made."""
    return F.struct(*[F.concat(*[e[f] for e in encodings]).alias(f) for f in fields])


def length(enc: Column | str) -> Column:
    """C8"""
    return F.size(_col(enc)["ids"])


def with_padding(enc: Column | str, target: Int, pad_id: int, pad_token: str = "[PAD]", right: bool = True, pad_type_id: int = 0, fields: tuple[str, ...] = FIELDS) -> Column:
    """Of a named column in place, with no interpreted step; of an expression, which is computed once."""
    if isinstance(enc, str):
        return _padded_column(F.col(enc), target, pad_id, pad_token, right, pad_type_id, fields)
    return let(_col(enc), lambda e: _padded(e, target, pad_id, pad_token, right, pad_type_id))


def _fill(pad_id: int, pad_token: str, pad_type_id: int) -> dict[str, Column]:
    null = F.lit(None).cast("int")
    return dict(zip(FIELDS, (F.lit(pad_token), F.lit(pad_id), F.lit(pad_type_id), F.lit(0), F.lit(1), _no_span(), null, null)))


def _padded_column(e: Column, target: Int, pad_id: int, pad_token: str, right: bool, pad_type_id: int, fields: tuple[str, ...] = FIELDS) -> Column:
    fill, missing = _fill(pad_id, pad_token, pad_type_id), F.greatest(_int(target) - length(e), F.lit(0))
    pads = {f: F.array_repeat(fill[f], missing) for f in fields}
    return F.when(e.isNotNull(), F.struct(*[F.concat(*((e[f], pads[f]) if right else (pads[f], e[f]))).alias(f) for f in fields]))


def _padded(e: Column, target: Int, pad_id: int, pad_token: str, right: bool, pad_type_id: int) -> Column:
    fill = _fill(pad_id, pad_token, pad_type_id)

    def filled(missing: Column) -> Column:
        pads = {f: F.array_repeat(fill[f], missing) for f in FIELDS}
        return _each(lambda f: F.concat(e[f], pads[f]) if right else F.concat(pads[f], e[f]))

    return F.when(e.isNotNull(), let(F.greatest(_int(target) - length(e), F.lit(0)), filled))


def pad_to_multiple(enc: Column | str, multiple: int, pad_id: int, pad_token: str = "[PAD]", right: bool = True, pad_type_id: int = 0) -> Column:
    """P2"""
    if multiple <= 0:
        return _col(enc)
    if isinstance(enc, str):
        return _padded_column(F.col(enc), round_up(length(enc), multiple), pad_id, pad_token, right, pad_type_id)
    return let(_col(enc), lambda e: _padded(e, round_up(length(e), multiple), pad_id, pad_token, right, pad_type_id))


def round_up(n: Column, multiple: int | None) -> Column:
    return n + F.pmod(-n, F.lit(multiple)) if multiple and multiple > 0 else n


def pad_to_longest(df: DataFrame, enc: str, pad_id: int, pad_token: str = "[PAD]", right: bool = True, pad_type_id: int = 0, batch_by: str | None = None, size: int | None = None, multiple: int | None = None, length_of: Column | None = None, made: Column | None = None, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """To a fixed size, or to the longest encoding of the whole table or of each batch.

    Maxima are found first, from ``length_of`` where it is given (a cheaper way to the lengths than the encodings
    themselves).  Up to ``BROADCAST_BATCHES`` of them are sent to the encodings, which are then not exchanged at all;
    of more, both sides meet by batch.  ``made`` is what the column is made of where it is not there yet: it is made
    when the lengths have met the rows, which then are exchanged without it.  Of the padded encodings only ``fields`` are made.
    """
    made = F.col(enc) if made is None else made
    if size is not None:
        return df.withColumn(enc, made).withColumn(enc, with_padding(enc, round_up(F.lit(size), multiple), pad_id, pad_token, right, pad_type_id, fields))
    longest = F.max(length(enc) if length_of is None else length_of).alias("__longest")
    if batch_by is None:
        return df.withColumn(enc, made).withColumn(enc, with_padding(enc, round_up(F.lit(df.agg(longest).first()[0] or 0), multiple), pad_id, pad_token, right, pad_type_id, fields))
    maxima = df.groupBy(F.col(batch_by).alias("__batch")).agg(longest)
    few = maxima.limit(BROADCAST_BATCHES + 1).collect()
    if len(few) <= BROADCAST_BATCHES:
        maxima = F.broadcast(df.sparkSession.createDataFrame(few, maxima.schema))
    both = df.join(maxima, F.col(batch_by).eqNullSafe(F.col("__batch"))).drop("__batch")
    return both.withColumn(enc, made).withColumn(enc, with_padding(enc, round_up(F.col("__longest"), multiple), pad_id, pad_token, right, pad_type_id, fields)).drop("__longest")


def with_truncation(enc: Column | str, max_length: Int, from_end: bool = True, keep_special: bool = False) -> Column:
    """T1, T2"""
    n = _int(max_length)
    if keep_special:
        return let(_col(enc), lambda e: F.when(e.isNull() | (length(e) <= n), e.cast(SCHEMA)).otherwise(_cut_content(e, n, from_end)))

    def cut(e: Column) -> Column:
        keep = F.least(length(e), n)
        start = F.lit(1) if from_end else length(e) - keep + 1
        return F.when(e.isNotNull(), _each(lambda f: F.slice(e[f], start, keep)))

    return let(_col(enc), cut)


def _cut_content(e: Column, n: Column, from_end: bool) -> Column:
    """All special tokens, and of the others as many as there is room for, with their spans and words."""
    mask = e["special_tokens_mask"]
    null = F.lit(None).cast("int")

    def bounds(at: Column) -> Column:
        room = F.least(F.size(at), F.greatest(n - (F.size(mask) - F.size(at)), F.lit(0)))
        low = F.when(room > 0, F.get(at, F.lit(0) if from_end else F.size(at) - room))
        high = F.when(room > 0, F.get(at, room - 1 if from_end else F.size(at) - 1))
        return F.struct(F.coalesce(low, F.lit(0)).alias("low"), F.coalesce(high, F.lit(-1)).alias("high"))

    def keep_between(b: Column) -> Column:
        marked = F.transform(mask, lambda m, i: F.struct(i.alias("i"), (m == 1).alias("s")))
        return F.filter(marked, lambda x: x["s"] | ((x["i"] >= b["low"]) & (x["i"] <= b["high"])))

    def of(kept: Column, f: str) -> Column:
        if f == "attention_mask":
            return F.transform(kept, lambda x: F.lit(1))
        blank = {"offsets": _no_span(), "word_ids": null, "sequence_ids": null}.get(f)
        value = (lambda x: F.coalesce(F.get(e[f], x["i"]), F.get(e["type_ids"], x["i"]))) if f == "sequence_ids" else (lambda x: F.get(e[f], x["i"]))
        return F.transform(kept, value if blank is None else lambda x: F.when(x["s"], blank).otherwise(value(x)))

    content_at = F.filter(F.transform(mask, lambda m, i: F.when(m == 0, i)), lambda i: i.isNotNull())
    return let(let(let(content_at, bounds), keep_between), lambda kept: _each(lambda f: of(kept, f)))


def pair_lengths(a: Column, b: Column, room: Column, strategy: str) -> tuple[Column, Column]:
    excess = F.greatest(a + b - room, F.lit(0))
    if strategy == DO_NOT_TRUNCATE:
        return a, b
    if strategy == ONLY_FIRST:
        return F.greatest(a - excess, F.lit(0)), b
    if strategy == ONLY_SECOND:
        return a, F.greatest(b - excess, F.lit(0))
    if strategy != LONGEST_FIRST:
        raise ValueError(strategy)
    lead = F.least(F.abs(a - b), excess)
    rest = excess - lead
    half = F.shiftright(rest, 1)
    return a - F.when(a > b, lead).otherwise(0) - half, b - F.when(a > b, 0).otherwise(lead) - (rest - half)


def truncate_pair(a: Column | str, b: Column | str, max_length: Int, strategy: str = LONGEST_FIRST, n_special: int = 3) -> tuple[Column, Column]:
    """T4 to T6"""
    a, b = _col(a), _col(b)
    room = _int(max_length) - n_special
    left, right = pair_lengths(length(a), length(b), room, strategy)
    none = room <= 0
    return with_truncation(a, F.when(none, 0).otherwise(left)), with_truncation(b, F.when(none, 0).otherwise(right))


def merge(parts: Column, growing_offsets: bool = True) -> Column:
    """M1: an array of encodings as one; spans and words go on from those before."""
    return let(parts, lambda p: _merged(p, growing_offsets))


def _merged(parts: Column, growing_offsets: bool) -> Column:
    def span_end(e: Column) -> Column:
        return F.coalesce(F.array_max(F.transform(F.filter(e["offsets"], lambda o: (o["start"] != 0) | (o["end"] != 0)), lambda o: F.greatest(o["end"], F.lit(0)))), F.lit(0))

    def word_end(e: Column) -> Column:
        return F.greatest(F.coalesce(F.array_max(e["word_ids"]), F.lit(0)), F.lit(0)) + 1

    def sums(sizes: Column) -> Column:
        start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("sum"))
        return F.aggregate(sizes, start, lambda acc, x: F.struct(F.concat(acc["out"], F.array(acc["sum"])).alias("out"), (acc["sum"] + x).alias("sum")), lambda acc: acc["out"])

    spans, words = sums(F.transform(parts, span_end)), sums(F.transform(parts, word_end))

    def moved(e: Column, by: Column) -> Column:
        return F.transform(e, lambda o: F.when((o["start"] == 0) & (o["end"] == 0), _no_span()).otherwise(F.struct((o["start"] + by).alias("start"), (o["end"] + by).alias("end"))))

    def of(f: str) -> Column:
        if f == "offsets" and growing_offsets:
            return F.flatten(F.zip_with(F.transform(parts, lambda e: e[f]), spans, moved))
        if f == "word_ids":
            return F.flatten(F.zip_with(F.transform(parts, lambda e: e[f]), words, lambda w, by: F.transform(w, lambda x: x + by)))
        return F.flatten(F.transform(parts, lambda e: e[f]))

    return F.when(F.size(parts) == 1, F.get(parts, F.lit(0)).cast(SCHEMA)).otherwise(_each(of))


def merge_encodings(df: DataFrame, key: str, order: str, enc: str, growing_offsets: bool = True) -> DataFrame:
    """(key, encoding): the encodings of each key merged by order; a merged encoding is one row by definition."""
    parts = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(enc).alias("e")))).alias("__parts"))
    return parts.select(key, merge(F.transform("__parts", lambda p: p["e"]), growing_offsets).alias("encoding"))


def _first(mask: Column) -> Column:
    at = F.array_position(mask, F.lit(True)).cast("int")
    return F.when(at > 0, at - 1)


def char_to_token(enc: Column | str, pos: Int, sequence: Int = 0) -> Column:
    """C1"""
    enc = _col(enc)
    return _first(F.zip_with(enc["sequence_ids"], enc["offsets"], lambda q, o: F.coalesce((o["start"] <= _int(pos)) & (_int(pos) < o["end"]) & (q == _int(sequence)), F.lit(False))))


def char_to_word(enc: Column | str, pos: Int, sequence: Int = 0) -> Column:
    """C2"""
    return F.get(_col(enc)["word_ids"], char_to_token(enc, pos, sequence))


def token_to_chars(enc: Column | str, i: Int) -> Column:
    """C3"""
    enc, i = _col(enc), _int(i)
    span = F.get(enc["offsets"], i)
    return F.when((F.get(enc["special_tokens_mask"], i) == 1) & (span["start"] == 0) & (span["end"] == 0), F.lit(None)).otherwise(span)


def token_to_word(enc: Column | str, i: Int) -> Column:
    """C4"""
    return F.get(_col(enc)["word_ids"], _int(i))


def token_to_sequence(enc: Column | str, i: Int) -> Column:
    """C4"""
    return F.get(_col(enc)["sequence_ids"], _int(i))


def _of_word(enc: Column, word: Int, sequence: Int) -> Column:
    """Places of the tokens of a word."""
    at = F.zip_with(enc["word_ids"], enc["sequence_ids"], lambda w, q: (w == _int(word)) & (q == _int(sequence)))
    return F.filter(F.transform(at, lambda x, i: F.when(x, i)), lambda i: i.isNotNull())


def word_to_chars(enc: Column | str, word: Int, sequence: Int = 0) -> Column:
    """C5"""
    enc = _col(enc)
    spans = F.transform(_of_word(enc, word, sequence), lambda i: F.get(enc["offsets"], i))
    return let(spans, lambda a: F.when(F.size(a) > 0, F.struct(F.array_min(a["start"]).alias("start"), F.array_max(a["end"]).alias("end"))))


def word_to_tokens(enc: Column | str, word: Int, sequence: Int = 0) -> Column:
    """C6"""
    return let(_of_word(_col(enc), word, sequence), lambda at: F.when(F.size(at) > 0, F.struct(F.array_min(at).alias("start"), (F.array_max(at) + 1).alias("end"))))


def derived_sequences(type_ids: Column, special_mask: Column) -> Column:
    """The type, and nothing at special tokens."""
    return F.zip_with(type_ids, special_mask, lambda t, s: F.when(s != 1, t))


def n_sequences(enc: Column | str) -> Column:
    """C7"""
    q = _col(enc)["sequence_ids"]
    return F.when(F.array_contains(q, 1), 2).when(F.array_contains(q, 0), 1).otherwise(0)


def fuse_unknown(ids: Column, unk: int) -> Column:
    """A8"""
    return let(ids, lambda a: F.filter(a, lambda x, i: (x != unk) | (i == 0) | (F.get(a, i - 1) != unk)))


def to_map(enc: Column | str) -> Column:
    """The encoding as JSON text with its snake_case names."""
    return F.to_json(_col(enc), {"ignoreNullFields": "false"})
