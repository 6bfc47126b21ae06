"""The registered queries of the engine, each over whole tables, with their SQL."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import textops
from wordloom.model import CONTROL, MARK, AddedToken, NormalizerOp, NormalizerSpec, PreTokenizerSpec, Trainer
from wordloom.operators import columns as C
from wordloom.operators import encode as E
from wordloom.operators import vocabulary as V
from wordloom.operators.encoding import FIELDS
from wordloom.plans import toy
from wordloom.sources.tables import read_table as table
from wordloom.sources.tables import spread
from wordloom.streaming.text_stream import printable_column, stream_decode_arrays, stream_decode_batch

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

# The same characters for SQL's regular expressions.
_WS = r"[\x{9}-\x{D}\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
_WIDE = r"[\x{9}-\x{D}\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_WORDS = f"list_filter(string_split_regex(coalesce(text, ''), '{_WIDE}+'), lambda w: w <> '')"


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def _documents(spark: SparkSession, sf_dir: str, *cols) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select("doc_id", *cols)


def _join(a: Column | str, sep: str = " ") -> Column:
    """Numbers and spans as text: nested types compare by their words."""
    return F.array_join((F.col(a) if isinstance(a, str) else a).cast("array<string>"), sep, "-")


# Normalization


def _normalize_query(name: str, of: Callable[[Column], Column], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _documents(spark, sf_dir, of(F.col("text")).alias("out"))

    run.__name__ = name
    _query(f"SELECT doc_id, {sql} AS out FROM documents")(run)


def _sql_dummy(t: str) -> str:
    return f"CASE WHEN {t} <> '' AND NOT regexp_matches({t}, '^{_WS}') THEN ' ' || {t} ELSE {t} END"


_COLLAPSED = f"trim(regexp_replace(text, '{_WS}+', ' ', 'g'), ' ')"
_NORMAL = f"replace({_sql_dummy(_COLLAPSED)}, ' ', '{MARK}')"
_normalize_query("n1_normalize", lambda t: textops.normalize(t, NormalizerSpec()), _NORMAL)
_normalize_query("n2_collapse_whitespace", textops.collapse_whitespace, _COLLAPSED)
_normalize_query("n3_dummy_prefix", textops.dummy_prefix, _sql_dummy("text"))
_normalize_query("n4_escape", textops.escape_whitespace, f"replace(text, ' ', '{MARK}')")
_normalize_query("n5_denormalize", lambda t: textops.denormalize(textops.normalize(t, NormalizerSpec()), NormalizerSpec()), f"regexp_replace(replace({_NORMAL}, '{MARK}', ' '), '^ ', '')")
_OPS = NormalizerSpec(operations=(NormalizerOp("Prepend", replacement="> "), NormalizerOp("Replace", r"[0-9]+", "$1\\0"), NormalizerOp("Replace", r"e\.", "E!")))
_normalize_query("n8_operations", lambda t: textops.normalize(t, _OPS), r"CASE WHEN text = '' THEN text ELSE regexp_replace(regexp_replace('> ' || text, '[0-9]+', '$1\\0', 'g'), 'e\.', 'E!', 'g') END")
_normalize_query("n9_prepend", lambda t: textops.prepend(t, MARK), f"'{MARK}' || text")
_normalize_query("n10_replace", lambda t: textops.replace_all(t, r" +([a-z])", "_$1"), "regexp_replace(text, ' +([a-z])', '_$1', 'g')")


_MAPPED = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "the": "THE", "th": "TH", "é": "e", ",": ""}


def _sql_mapped() -> str:
    """Longest forms first, each through a character of the private use area, so that none is mapped twice."""
    out = "text"
    for i, k in enumerate(sorted(_MAPPED, key=len, reverse=True)):
        out = f"replace({out}, '{k}', chr({0xE000 + i}))"
    for i, k in enumerate(sorted(_MAPPED, key=len, reverse=True)):
        out = f"replace({out}, chr({0xE000 + i}), '{_MAPPED[k]}')"
    return out


@_query(f"SELECT doc_id, {_sql_mapped()} AS out FROM documents")
def n6_charsmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leftmost-longest character map: of the forms of the map none overlaps another but the longer one that it starts."""
    from wordloom.sources.charsmap import Charsmap

    return _documents(spark, sf_dir, textops.charsmap_column(F.col("text"), Charsmap.build(_MAPPED).to_bytes()).alias("out"))


# Pre-tokenization


def _chunk_query(name: str, spec: PreTokenizerSpec | None, chunks: str, words: str, normal: bool = False) -> None:
    """Chunks and word ids of each text, as text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = F.coalesce("text", F.lit(""))
        found = _documents(spark, sf_dir, textops.pretokenize(textops.escape_whitespace(t) if normal else t, spec).alias("c"))
        return found.select("doc_id", F.array_join(F.transform("c", lambda c: c["text"]), "|").alias("chunks"), _join(F.transform("c", lambda c: c["word_id"])).alias("words"), F.size("c").cast("long").alias("n"))

    run.__name__ = name
    _query(f"WITH c AS (SELECT doc_id, {chunks} AS c FROM documents) SELECT doc_id, array_to_string(c, '|') AS chunks, {words} AS words, len(c)::BIGINT AS n FROM c")(run)


_COUNT = "array_to_string(range(len(c)), ' ')"
_chunk_query("w1_no_pretokenizer", None, "[coalesce(text, '')]", "'-'")
_chunk_query("w2_whitespace_split", PreTokenizerSpec(True, False), _WORDS, _COUNT)
_chunk_query("w3_whitespace_metaspace", PreTokenizerSpec(True, True), f"list_transform({_WORDS}, lambda w: '{MARK}' || regexp_replace(w, '^{MARK}', ''))", _COUNT)
_META = f"regexp_replace(coalesce(text, ''), '{_WIDE}', '{MARK}', 'g')"
_META_PREFIX = f"CASE WHEN {_META} <> '' AND NOT starts_with({_META}, '{MARK}') THEN '{MARK}' || {_META} ELSE {_META} END"
_chunk_query("w4_metaspace", PreTokenizerSpec(split=False), f"[{_META_PREFIX}]", "'0'")
_chunk_query("w5_metaspace_split", PreTokenizerSpec(), f"regexp_extract_all({_META_PREFIX}, '{MARK}?[^{MARK}]+')", _COUNT)
_chunk_query("w6_noop_split", PreTokenizerSpec(False, False), "[coalesce(text, '')]", "'0'")


# Segmentation

_TOY = f"v(id, piece, score, type) AS (VALUES {toy.sql_values()}), maps AS (SELECT map(list(piece), list(score)) AS s, map(list(piece), list(id)) AS i FROM v)"
_DOC_WORDS = f"SELECT doc_id, lang, '{MARK}' || unnest(list_filter(string_split_regex(coalesce(text, ''), '{_WS}+'), lambda w: w <> '')) AS w FROM documents"


def _viterbi(words: str, unknown_score: str = "-20.0", unknown_ids: str = "'0'") -> str:
    """Best path by position, one row a word: p characters are done, best[p + 1] and path[p + 1] are those of the first p.

    The score and the ids of a character that no piece starts at are expressions over ``c``.
    """
    score, ids = (x.replace("c$", "substr(w, p + 1, 1)") for x in (unknown_score, unknown_ids))
    return f"""
words AS (SELECT DISTINCT w FROM ({words})),
dp(w, p, best, path) AS (
  SELECT w, 0, [0.0::DOUBLE], [''] FROM words
  UNION ALL
  SELECT w, p + 1, list_append(best, c.x), list_append(path, c.y) FROM (
    SELECT w, p, best, path, list_sort(list_filter([
      {{'x': best[p + 2 - k] + CASE WHEN k = 1 AND NOT h THEN {score} ELSE s[substr(w, p + 2 - k, k)] END, 'k': k,
        'y': trim(path[p + 2 - k] || ' ' || CASE WHEN k = 1 AND NOT h THEN {ids} ELSE i[substr(w, p + 2 - k, k)]::VARCHAR END)}}
      for k in range(1, least({toy.LONGEST}, p + 1) + 1) if s[substr(w, p + 2 - k, k)] IS NOT NULL OR (k = 1 AND NOT h)], lambda z: z.x IS NOT NULL), 'DESC')[1] AS c
    FROM (SELECT *, len(list_filter(range(1, {toy.LONGEST} + 1), lambda k: p + k <= length(w) AND s[substr(w, p + 1, k)] IS NOT NULL)) > 0 AS h FROM dp, maps WHERE p < length(w))
  )
)"""


_VITERBI = _viterbi(_DOC_WORDS)


def _distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.explode(F.split("text", f"[{textops._java(textops.SPACE)}]+"))
    return spread(table(spark, sf_dir, "documents")).select(words.alias("w")).where("w <> ''").distinct()


@_query(f"WITH RECURSIVE {_TOY}, {_VITERBI} SELECT w AS word, path[p + 1] AS ids FROM dp WHERE p = length(w)")
def a4_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best paths of all distinct words of all documents."""
    return _distinct_words(spark, sf_dir).select(F.concat(F.lit(MARK), "w").alias("word"), _join(E.token_ids("w", toy.tokenizer(), False)).alias("ids"))


_BYTE0 = len(toy.pieces())
_CHAR_BYTES = "hex(encode(c$))"


@_query(f"WITH RECURSIVE {_TOY}, {_viterbi(_DOC_WORDS, f'(length({_CHAR_BYTES}) // 2) * {toy.BYTE_SCORE!r}', f"array_to_string(list_transform(range(length({_CHAR_BYTES}) // 2, 0, -1), lambda z: {_BYTE0} + ('0x' || substr({_CHAR_BYTES}, (2 * z - 1)::INTEGER, 2))::INTEGER), ' ')")} SELECT w AS word, path[p + 1] AS ids FROM dp WHERE p = length(w)")
def a6_byte_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best paths where a character that no piece starts at gives the pieces of its bytes, the last byte first."""
    return _distinct_words(spark, sf_dir).select(F.concat(F.lit(MARK), "w").alias("word"), _join(E.token_ids("w", toy.bytes_tokenizer(), False)).alias("ids"))


@_query(f"WITH RECURSIVE {_TOY}, {_VITERBI}, counted AS (SELECT w, len(string_split(path[p + 1], ' ')) AS n FROM dp WHERE p = length(w)) SELECT lang, sum(n)::BIGINT AS tokens, count(DISTINCT doc_id)::BIGINT AS docs FROM ({_DOC_WORDS}) JOIN counted USING (w) GROUP BY lang")
def e_tokens_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalize, cut, segment, aggregate: content tokens per language of texts that have any."""
    return E.tokens_by(spread(table(spark, sf_dir, "documents").select("lang", "text")), "text", "lang", toy.tokenizer())


_BPE = f"""
words AS (SELECT DISTINCT w FROM ({_DOC_WORDS})),
m(w, a) AS (
  SELECT w, string_split(w, '') FROM words
  UNION ALL
  SELECT w, a[:b.k - 1] || [a[b.k] || a[b.k + 1]] || a[b.k + 2:] FROM (
    SELECT w, a, list_sort([{{'x': s[a[k] || a[k + 1]], 'j': -k, 'k': k}} for k in range(1, len(a)) if s[a[k] || a[k + 1]] IS NOT NULL], 'DESC')[1] AS b FROM m, maps
  ) WHERE b IS NOT NULL
), last AS (SELECT w, arg_min(a, len(a)) AS a FROM m GROUP BY w)"""


@_query(f"WITH RECURSIVE {_TOY}, {_BPE} SELECT w AS word, array_to_string(list_transform(a, lambda x: coalesce(i[x], 0)), ' ') AS ids FROM last, maps")
def a10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merges of all distinct words of all documents."""
    return _distinct_words(spark, sf_dir).select(F.concat(F.lit(MARK), "w").alias("word"), _join(E.token_ids("w", toy.bpe(), False)).alias("ids"))


_PLACES = "SELECT item_id, text, unnest(range(length(text)))::INTEGER AS place FROM benchmark"
_PREFIXES = f"SELECT item_id, place, p.piece, p.id::INTEGER AS id, (place + length(p.piece))::INTEGER AS \"end\" FROM ({_PLACES}) JOIN v p ON starts_with(substr(text, place + 1, {toy.LONGEST}), p.piece) AND p.type = 1"


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of every text of the benchmark."""
    items = spread(table(spark, sf_dir, "benchmark").select("item_id", "text")).where("text <> ''")
    return items.select("item_id", "text", F.explode(F.sequence(F.lit(0), F.char_length("text") - 1)).alias("place"))


@_query(f"WITH {_TOY} {_PREFIXES}")
def a3_all_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = V.vocab_df(spark, toy.tokenizer()).where("type = 1")
    return V.all_prefixes(_places(spark, sf_dir), "text", vocab, toy.LONGEST, F.col("place"), size=200).select("item_id", "place", "piece", "id", "end")


@_query(f"WITH {_TOY}, f AS ({_PREFIXES}) SELECT item_id, place, arg_max(piece, \"end\") AS piece, arg_max(id, \"end\") AS id, max(\"end\") AS \"end\" FROM f GROUP BY item_id, place")
def a2_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest piece at each place where one stands."""
    vocab = V.vocab_df(spark, toy.tokenizer()).where("type = 1")
    named = _places(spark, sf_dir).select(F.struct("item_id", "place").alias("key"), "text")
    return V.longest_prefix(named, "key", "text", vocab, toy.LONGEST, F.col("key.place"), size=200).select("key.*", "piece", "id", "end")


@_query("WITH x AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), ' '), lambda w: CASE WHEN length(w) < 5 THEN 0 ELSE length(w) END) AS a FROM documents) SELECT doc_id, array_to_string(list_filter(a, lambda x, i: x <> 0 OR i = 1 OR a[i - 1] <> 0), ' ') AS ids FROM x")
def a8_fuse_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = F.transform(F.split(F.coalesce("text", F.lit("")), " "), lambda w: F.when(F.char_length(w) < 5, 0).otherwise(F.char_length(w)))
    return _documents(spark, sf_dir, _join(C.fuse_unknown(lengths, 0)).alias("ids"))


# Encodings: made of the words of each text, with every third one's span empty, so that SQL can make the same.


def _encoding(text: Column, type_id: int = 0, fields: tuple[str, ...] = FIELDS) -> Column:
    def of(words: Column) -> Column:
        body = C.content(
            words, F.transform(words, F.char_length), F.transform(words, lambda w, i: F.when(i % 3 == 2, F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))).otherwise(F.struct((10 * i).alias("start"), (10 * i + F.char_length(w)).alias("end")))),
            F.transform(words, lambda w, i: F.when(i % 3 != 2, F.shiftright(i, 1))), type_id, n=F.size(words),
        )
        return C.joined_in_place(C.special("<s>", 1), body, C.special("</s>", 2, 1), fields=fields)

    return C.let(F.split(F.coalesce(text, F.lit("")), " "), of)


def _sql_encoding(text: str = "text", type_id: int = 0) -> str:
    """The fields of ``_encoding``, from words of a text; DuckDB's lambdas count from 1."""
    w = f"string_split(coalesce({text}, ''), ' ')"
    return f"""{{'t': ['<s>'] || {w} || ['</s>'], 'i': [1] || list_transform({w}, lambda x: length(x)::INTEGER) || [2],
 'y': [0] || list_transform({w}, lambda x: {type_id}) || [1], 'a': list_transform(['<s>'] || {w} || ['</s>'], lambda x: 1), 'm': [1] || list_transform({w}, lambda x: 0) || [1],
 'o': ['0:0'] || list_transform({w}, lambda x, i: CASE WHEN (i - 1) % 3 = 2 THEN '0:0' ELSE (10 * (i - 1))::VARCHAR || ':' || (10 * (i - 1) + length(x))::VARCHAR END) || ['0:0'],
 'w': ['-'] || list_transform({w}, lambda x, i: CASE WHEN (i - 1) % 3 = 2 THEN '-' ELSE ((i - 1) // 2)::VARCHAR END) || ['-'],
 'q': ['-'] || list_transform({w}, lambda x: '{type_id}') || ['-']}}"""


_ENCODED = f"WITH e AS (SELECT doc_id, {_sql_encoding()} AS e FROM documents)"
_SHOWN = ("tokens", "ids", "types", "attention", "special", "offsets", "words", "sequences")


def _show(key: str, enc: Column) -> list[Column]:
    shown = dict(zip(FIELDS, (enc[f] for f in FIELDS)))
    shown["offsets"] = F.transform(enc["offsets"], lambda o: F.concat(o["start"].cast("string"), F.lit(":"), o["end"].cast("string")))
    return [F.col(key), *[_join(p).alias(n) for p, n in zip(shown.values(), _SHOWN)]]


def _sql_show(key: str, parts: dict[str, str], source: str) -> str:
    """SQL that shows the eight lists, given by the letters of ``_sql_encoding``."""
    return f"SELECT {key}, " + ", ".join(f"array_to_string({parts[k]}, ' ') AS {n}" for k, n in zip("tiyamowq", _SHOWN)) + f" FROM {source}"


_FILL = {"t": "'[PAD]'", "i": "9", "y": "3", "a": "0", "m": "1", "o": "'0:0'", "w": "'-'", "q": "'-'"}


def _sql_padded(target: str, right: bool = True) -> dict[str, str]:
    out = {}
    for k, fill in _FILL.items():
        pad = f"list_transform(range(greatest({target} - len(e.i), 0)), lambda z: {fill})"
        out[k] = f"e.{k} || {pad}" if right else f"{pad} || e.{k}"
    return out


def _encoding_query(name: str, of: Callable[[Column], Column], parts: dict[str, str], source: str = "e", prefix: str = _ENCODED) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = _documents(spark, sf_dir, _encoding(F.col("text")).alias("e"))
        return made.select("doc_id", of(F.col("e")).alias("e")).select(*_show("doc_id", F.col("e")))

    run.__name__ = name
    _query(f"{prefix} {_sql_show('doc_id', parts, source)}")(run)


_encoding_query("e10_build", lambda e: e, {k: f"e.{k}" for k in _FILL})
_encoding_query("p1_padding", lambda e: C.with_padding("e", 300, 9, pad_type_id=3), _sql_padded("300"))
_encoding_query("p1_padding_left", lambda e: C.with_padding("e", 300, 9, right=False, pad_type_id=3), _sql_padded("300", False))
_encoding_query("p2_padding_multiple", lambda e: C.pad_to_multiple("e", 64, 9, pad_type_id=3), _sql_padded("(len(e.i) + 63) // 64 * 64"))
_encoding_query("t1_truncation", lambda e: C.with_truncation(e, 20), {k: f"e.{k}[:20]" for k in _FILL})
_encoding_query("t1_truncation_start", lambda e: C.with_truncation(e, 20, from_end=False), {k: f"e.{k}[-20:]" for k in _FILL})
_encoding_query("t2_truncation_special", lambda e: C.with_truncation(e, 20, keep_special=True), {k: f"CASE WHEN len(e.i) <= 20 THEN e.{k} ELSE e.{k}[:19] || e.{k}[-1:] END" for k in _FILL})
_encoding_query("t2_truncation_special_start", lambda e: C.with_truncation(e, 20, from_end=False, keep_special=True), {k: f"CASE WHEN len(e.i) <= 20 THEN e.{k} ELSE e.{k}[:1] || e.{k}[-19:] END" for k in _FILL})


@_query(f"{_ENCODED}, n AS (SELECT e.*, lang, max(len(e.i)) OVER (PARTITION BY lang) AS longest FROM e JOIN documents USING (doc_id)) SELECT doc_id, lang, len(e.i) + greatest((longest + 7) // 8 * 8 - len(e.i), 0) AS size, list_sum({_sql_padded('(longest + 7) // 8 * 8')['i']})::BIGINT AS total FROM n")
def p3_pad_to_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padding to the longest encoding of a language, rounded up to eights; only ids are shown, so only ids are made."""
    made = _documents(spark, sf_dir, "lang", _encoding(F.col("text"), fields=("ids",)).alias("e"))
    padded = C.pad_to_longest(made, "e", 9, pad_type_id=3, batch_by="lang", multiple=8, fields=("ids",))
    return padded.select("doc_id", "lang", F.size("e.ids").cast("long").alias("size"), F.aggregate("e.ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


_PAIR_LENGTHS = "WITH l AS (SELECT doc_id, len(string_split(coalesce(text, ''), ' ')) + 2 AS a, len(string_split(coalesce(source, ''), ' ')) + length(lang) * 20 + 2 AS b FROM documents)"


def _pair_query(name: str, strategy: str, a: str, b: str) -> None:
    """Ids left of a text and of a second one made of its source and language, cut to 60 with 3 special tokens."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        second = F.concat_ws(" ", F.coalesce("source", F.lit("")), F.array_join(F.array_repeat(F.lit("x"), F.char_length("lang") * 20), " "))
        made = _documents(spark, sf_dir, _encoding(F.col("text")).alias("a"), _encoding(second, 1).alias("b"))
        left, right = C.truncate_pair("a", "b", 63, strategy)
        return made.select("doc_id", C.length(left).cast("long").alias("n_a"), C.length(right).cast("long").alias("n_b"), F.try_element_at(left["tokens"], F.lit(1)).alias("first"), F.try_element_at(right["tokens"], F.lit(-1)).alias("last"))

    run.__name__ = name
    shown = "SELECT doc_id, a::BIGINT AS n_a, b::BIGINT AS n_b, CASE WHEN a > 0 THEN '<s>' END AS first"
    full = "(SELECT doc_id, source, len(string_split(coalesce(source, ''), ' ')) + length(lang) * 20 + 2 AS whole FROM documents)"
    _query(f"{_PAIR_LENGTHS}, c AS (SELECT doc_id, {a} AS a, {b} AS b FROM l) {shown}, CASE WHEN b = 0 THEN NULL WHEN b = whole THEN '</s>' WHEN b = 1 THEN '<s>' WHEN b = 2 THEN source ELSE 'x' END AS last FROM c JOIN {full} USING (doc_id)")(run)


_EXCESS = "greatest(a + b - 60, 0)"
_LEAD = f"least(abs(a - b), {_EXCESS})"
_pair_query("t4_pair_longest_first", "longest_first", f"a - CASE WHEN a > b THEN {_LEAD} ELSE 0 END - ({_EXCESS} - {_LEAD}) // 2", f"b - CASE WHEN a > b THEN 0 ELSE {_LEAD} END - ({_EXCESS} - {_LEAD} + 1) // 2")
_pair_query("t5_only_first", "only_first", f"greatest(a - {_EXCESS}, 0)", "b")
_pair_query("t5_only_second", "only_second", "a", f"greatest(b - {_EXCESS}, 0)")
_pair_query("t6_pair_untouched", "do_not_truncate", "a", "b")


@_query(f"WITH e AS (SELECT conv_id, turn, string_split(coalesce(text, ''), ' ') AS w FROM conversations), s AS (SELECT *, greatest(coalesce(list_max(list_transform(w, lambda x, i: CASE WHEN (i - 1) % 3 = 2 THEN 0 ELSE 10 * (i - 1) + length(x) END)), 0), 0) AS far, coalesce(list_max(list_transform(w, lambda x, i: CASE WHEN (i - 1) % 3 = 2 THEN 0 ELSE (i - 1) // 2 END)), 0) + 1 AS nw FROM e), t AS (SELECT *, coalesce(sum(far) OVER k, 0) AS by_far, coalesce(sum(nw) OVER k, 0) AS by_word FROM s WINDOW k AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT conv_id, sum(len(w) + 2)::BIGINT AS size, sum(list_sum(list_transform(w, lambda x, i: CASE WHEN (i - 1) % 3 = 2 THEN 0 ELSE 10 * (i - 1) + by_far END)))::BIGINT AS starts, sum(list_sum(list_transform(w, lambda x, i: CASE WHEN (i - 1) % 3 = 2 THEN 0 ELSE (i - 1) // 2 + by_word END)))::BIGINT AS words FROM t GROUP BY conv_id")
def m1_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of a conversation as one encoding; spans and words go on from turn to turn."""
    made = table(spark, sf_dir, "conversations").select("conv_id", "turn", _encoding(F.col("text")).alias("e"))
    merged = C.merge_encodings(made, "conv_id", "turn", "e")

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x, F.lit(0)))

    e = F.col("encoding")
    return merged.select("conv_id", F.size(e["ids"]).cast("long").alias("size"), total(F.transform(e["offsets"], lambda o: o["start"])).alias("starts"), total(e["word_ids"]).alias("words"))


@_query(f"{_ENCODED}, f AS (SELECT doc_id, e, list_position(list_transform(e.o, lambda x, i: e.q[i] = '0' AND split_part(x, ':', 1)::INT <= 31 AND 31 < split_part(x, ':', 2)::INT), true) AS k FROM e), g AS (SELECT doc_id, e, k, list_filter(range(1, len(e.i) + 1), lambda i: e.q[i] = '0' AND e.w[i] = '3') AS found FROM f) SELECT doc_id, (k - 1)::INTEGER AS char_token, CASE WHEN e.w[k] <> '-' THEN e.w[k]::INTEGER END AS char_word, CASE WHEN len(e.o) > 2 THEN e.o[3] END AS token_chars, CASE WHEN e.w[3] <> '-' THEN e.w[3]::INTEGER END AS token_word, CASE WHEN e.q[3] <> '-' THEN e.q[3]::INTEGER END AS token_sequence, CASE WHEN len(found) > 0 THEN list_min(list_transform(found, lambda i: split_part(e.o[i], ':', 1)::INT))::VARCHAR || ':' || list_max(list_transform(found, lambda i: split_part(e.o[i], ':', 2)::INT))::VARCHAR END AS word_chars, CASE WHEN len(found) > 0 THEN (found[1] - 1)::VARCHAR || ':' || found[-1]::VARCHAR END AS word_tokens, 1 AS n_sequences, len(e.i)::INTEGER AS size FROM g".replace("CASE WHEN len(e.o) > 2 THEN e.o[3] END", "CASE WHEN e.m[3] = 1 THEN NULL ELSE e.o[3] END"))
def c_index_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 to C8 at fixed places of each text's encoding."""

    def span(s: Column) -> Column:
        return F.when(s.isNotNull(), F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))

    def mapped(e: Column) -> Column:
        return F.struct(
            C.char_to_token(e, 31).alias("char_token"), C.char_to_word(e, 31).alias("char_word"), span(C.token_to_chars(e, 2)).alias("token_chars"), C.token_to_word(e, 2).alias("token_word"),
            C.token_to_sequence(e, 2).alias("token_sequence"), span(C.word_to_chars(e, 3)).alias("word_chars"), span(C.word_to_tokens(e, 3)).alias("word_tokens"), C.n_sequences(e).alias("n_sequences"), C.length(e).alias("size"),
        )

    return _documents(spark, sf_dir, _encoding(F.col("text")).alias("e")).select("doc_id", mapped(F.col("e")).alias("m")).select("doc_id", "m.*")


@_query("SELECT doc_id, CASE WHEN source IS NULL THEN 1 ELSE 2 END AS n_sequences, CASE WHEN source IS NULL THEN NULL ELSE (len(string_split(coalesce(text, ''), ' ')) + 3)::INTEGER END AS first_of_second FROM documents")
def c7_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C7, C1 on two sequences: a text and, where it has one, its source."""

    def mapped(e: Column) -> Column:
        return F.struct(C.n_sequences(e).alias("n_sequences"), C.char_to_token(e, 0, 1).alias("first_of_second"))

    second = F.when(F.col("source").isNotNull(), _encoding(F.col("source"), 1)).otherwise(C.empty())
    return _documents(spark, sf_dir, C.let(C.joined(_encoding(F.col("text")), second), mapped).alias("m")).select("doc_id", "m.*")


@_query("SELECT conv_id, turn, concat('{\"ids\":[', array_to_string(list_transform(string_split(coalesce(text, ''), ' '), lambda w: length(w)), ','), ']}') AS json FROM conversations")
def s17_to_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split(F.coalesce("text", F.lit("")), " ")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", C.to_map(F.struct(F.transform(words, F.char_length).alias("ids"))).alias("json"))


# Encoding and decoding with a model


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the assistant turn after it."""
    turns = spread(table(spark, sf_dir, "conversations"))
    answers = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return turns.where("role = 'user'").join(answers, ["conv_id", "turn"]).select("conv_id", "turn", "text", "answer")


_SQL_PAIRS = "(SELECT a.conv_id, a.turn, a.text, b.text AS answer FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.role = 'user' AND b.role = 'assistant')"


def _sql_ids(source: str, key: str, texts: tuple[str, ...]) -> str:
    """CTEs: enc(key, x0, ...) with the content ids of each text of each row of a source, null where the text is."""
    cut = [f"SELECT {key}, {k} AS side, unnest(range(len(l))) AS pos, '{MARK}' || unnest(l) AS w FROM (SELECT {key}, list_filter(string_split_regex({t}, '{_WS}+'), lambda w: w <> '') AS l FROM {source})" for k, t in enumerate(texts)]
    sides = ", ".join(f"CASE WHEN {t} IS NOT NULL THEN coalesce(j.m[{k}], []) END AS x{k}" for k, t in enumerate(texts))
    return f"""cutw AS ({" UNION ALL ".join(cut)}), {_viterbi("SELECT w FROM cutw")},
joined AS (SELECT {key}, map_from_entries(list((side, ids))) AS m FROM (SELECT {key}, side, flatten(list(string_split(path[p + 1], ' ') ORDER BY pos)) AS ids FROM cutw JOIN (SELECT * FROM dp WHERE p = length(w)) USING (w) GROUP BY {key}, side) GROUP BY {key}),
enc AS (SELECT {", ".join(f"s.{k.strip()}" for k in key.split(","))}, {sides.replace("CASE WHEN ", "CASE WHEN s.")}, pc FROM {source} s LEFT JOIN joined j USING ({key}), (SELECT list(piece ORDER BY id) AS pc FROM v))"""


def _sql_fields(parts: list[tuple[str, int, int]], ends: list[int]) -> str:
    """The lists of an encoding <s> x </s> or <s> x </s> y </s>: parts are (ids, type, sequence), ends the types of </s>."""
    one = {"t": "['<s>']", "i": "['1']", "y": "['0']", "a": "['1']", "m": "['1']", "w": "['-']", "q": "['-']"}
    for (x, kind, sequence), end in zip(parts, ends):
        n = f"list_transform({x}, lambda z: "
        body = {"t": f"{n}pc[z::INTEGER + 1])", "i": x, "y": f"{n}'{kind}')", "a": f"{n}'1')", "m": f"{n}'0')", "w": f"{n}'-')", "q": f"{n}'{sequence}')"}
        stop = {"t": "['</s>']", "i": "['2']", "y": f"['{end}']", "a": "['1']", "m": "['1']", "w": "['-']", "q": "['-']"}
        one = {k: f"{v} || {body[k]} || {stop[k]}" for k, v in one.items()}
    return "{" + ", ".join(f"'{k}': {v}" for k, v in one.items()) + "}"


_PLAIN_SHOWN = tuple((k, n) for k, n in zip("tiyamowq", _SHOWN) if k != "o")


def _show_plain(enc: Column) -> list[Column]:
    """All fields but the offsets, which e8_offsets shows."""
    return [c for c, n in zip(_show("x", enc)[1:], _SHOWN) if n != "offsets"]


def _sql_show_plain(key: str, source: str, pad: str | None = None) -> str:
    fill = dict(zip("tiyamwq", ("<pad>", "2", "0", "0", "1", "-", "-")))
    out = [f"array_to_string(e.{k}" + (f" || list_transform(range({pad} - len(e.i)), lambda z: '{fill[k]}')" if pad else "") + f", ' ') AS {n}" for k, n in _PLAIN_SHOWN]
    return f"SELECT {key}, {', '.join(out)} FROM {source}"


_SINGLE = f"CASE WHEN x0 IS NOT NULL THEN {_sql_fields([('x0', 0, 0)], [0])} END AS e"
_PAIR = f"CASE WHEN x0 IS NOT NULL AND x1 IS NOT NULL THEN {_sql_fields([('x0', 0, 0), ('x1', 1, 1)], [1, 1])} END AS e"


@_query(f"WITH RECURSIVE {_TOY}, {_sql_ids('documents', 'doc_id', ('text',))}, f AS (SELECT doc_id, {_SINGLE} FROM enc) {_sql_show_plain('doc_id', 'f')}")
def e1_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodings of whole texts with special tokens."""
    return _documents(spark, sf_dir, E.encode("text", toy.tokenizer()).alias("e")).select("doc_id", *_show_plain(F.col("e")))


@_query()
def e8_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source spans of the tokens of whole texts; tests hold them against fixed cases and definitions."""
    turns = spread(table(spark, sf_dir, "conversations")).select("conv_id", "turn", E.encode("text", toy.tokenizer()).alias("e"))
    return turns.select("turn", *[c for c, n in zip(_show("conv_id", F.col("e")), ("conv_id", *_SHOWN)) if n in ("conv_id", "tokens", "offsets")])


@_query(f"WITH RECURSIVE {_TOY}, {_sql_ids(_SQL_PAIRS, 'conv_id, turn', ('text', 'answer'))}, f AS (SELECT conv_id, turn, {_PAIR} FROM enc) {_sql_show_plain('conv_id, turn', 'f')}")
def e2_encode_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with its answer, whole."""
    made = _pairs(spark, sf_dir).select("conv_id", "turn", E.encode_pair("text", "answer", toy.tokenizer()).alias("e"))
    return made.select("conv_id", "turn", *_show_plain(F.col("e")))


@_query(f"WITH RECURSIVE {_TOY}, {_sql_ids('conversations', 'conv_id, turn', ('text',))}, f AS (SELECT conv_id, turn, {_SINGLE} FROM enc), g AS (SELECT *, (max(len(e.i)) OVER (PARTITION BY conv_id) + 7) // 8 * 8 AS size FROM f) {_sql_show_plain('conv_id, turn', 'g', 'size')}")
def e3_encode_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of a conversation as a batch, padded to the longest, rounded up to eights."""
    tok = toy.tokenizer().with_padding(multiple=8)
    turns = spread(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "text")
    return E.encode_batch(turns, "text", tok, batch_by="conv_id").select("conv_id", "turn", *_show_plain(F.col("encoding")))


@_query(f"WITH RECURSIVE {_TOY}, {_sql_ids(_SQL_PAIRS, 'conv_id, turn', ('text', 'answer'))}, f AS (SELECT conv_id, turn, {_PAIR} FROM enc), g AS (SELECT *, max(len(e.i)) OVER (PARTITION BY conv_id) AS size FROM f) {_sql_show_plain('conv_id, turn', 'g', 'size')}")
def e4_encode_pair_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = E.encode_pair_batch(_pairs(spark, sf_dir), "text", "answer", toy.tokenizer().with_padding(), batch_by="conv_id")
    return made.select("conv_id", "turn", *_show_plain(F.col("encoding")))


@_query(f"WITH RECURSIVE {_TOY}, {_VITERBI} SELECT w AS word, array_to_string(list_transform(string_split(path[p + 1], ' '), lambda x: (SELECT piece FROM v WHERE id = x::INTEGER)), ' ') AS tokens FROM dp WHERE p = length(w)".replace("list_transform(string_split(path[p + 1], ' '), lambda x: (SELECT piece FROM v WHERE id = x::INTEGER))", "list_transform(string_split(path[p + 1], ' '), lambda x: pieces[x::INTEGER + 1])").replace("FROM dp WHERE", "FROM dp, (SELECT list(piece ORDER BY id) AS pieces FROM v) WHERE"))
def e6_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distinct_words(spark, sf_dir).select(F.concat(F.lit(MARK), "w").alias("word"), F.array_join(E.tokenize("w", toy.tokenizer()), " ").alias("tokens"))


_IDS = f"list_transform(string_split(coalesce(text, ''), ' '), lambda w: (length(w) * 7) % {len(toy.pieces()) + 3})"


def _fake_ids() -> Column:
    return F.transform(F.split(F.coalesce("text", F.lit("")), " "), lambda w: F.char_length(w) * 7 % (len(toy.pieces()) + 3))


@_query(f"WITH {_TOY}, p AS (SELECT list(CASE WHEN type IN (2, 3) THEN '' ELSE piece END ORDER BY id) AS p FROM v), x AS (SELECT doc_id, array_to_string(list_transform({_IDS}, lambda i: coalesce(p[i + 1], '')), '') AS t FROM documents, p) SELECT doc_id, regexp_replace(replace(t, '{MARK}', ' '), '^ ', '') AS text FROM x")
def d1_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir, E.decode(_fake_ids(), toy.tokenizer()).alias("text"))


_BYTE_IDS = f"list_transform(string_split(coalesce(text, ''), ' '), lambda w: CASE WHEN length(w) % 2 = 0 THEN {_BYTE0 + 33} + (length(w) * 7) % 200 ELSE (length(w) * 7) % {_BYTE0} END)"


@_query(f"WITH {_TOY}, p AS (SELECT list(CASE WHEN type IN (2, 3) THEN '' ELSE piece END ORDER BY id) AS p FROM v), x AS (SELECT doc_id, array_to_string(list_transform({_BYTE_IDS}, lambda i: CASE WHEN i >= {_BYTE0} THEN chr((i - {_BYTE0})::INTEGER) ELSE p[i + 1] END), '') AS t FROM documents, p) SELECT doc_id, regexp_replace(replace(t, '{MARK}', ' '), '^ ', '') AS text FROM x")
def d1_decode_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte pieces give the character of their value."""
    n = F.char_length
    ids = F.transform(F.split(F.coalesce("text", F.lit("")), " "), lambda w: F.when(n(w) % 2 == 0, n(w) * 7 % 200 + (_BYTE0 + 33)).otherwise(n(w) * 7 % _BYTE0))
    return _documents(spark, sf_dir, E.decode(ids, toy.bytes_tokenizer()).alias("text"))


@_query(f"WITH {_TOY}, p AS (SELECT list(piece ORDER BY id) AS p FROM v) SELECT doc_id, array_to_string(list_transform({_IDS}, lambda i: coalesce(p[i + 1], '<unk>')), ' ') AS tokens FROM documents, p")
def d4_ids_to_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir, F.array_join(E.ids_to_tokens(_fake_ids(), toy.tokenizer()), " ").alias("tokens"))


@_query(f"WITH {_TOY} SELECT doc_id, array_to_string(list_transform(string_split(coalesce(text, ''), ' '), lambda w: coalesce(i[w], i['{MARK}' || w], 0)), ' ') AS ids FROM documents, maps")
def d3_tokens_to_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole words as tokens, with the mark where only that form is a piece."""
    marked = F.array(*[F.lit(p.piece[1:]) for p in toy.pieces() if p.piece.startswith(MARK) and len(p.piece) > 1 and p.piece[1:] not in {q.piece for q in toy.pieces()}])
    tokens = F.transform(F.split(F.coalesce("text", F.lit("")), " "), lambda w: F.when(F.array_contains(marked, w), F.concat(F.lit(MARK), w)).otherwise(w))
    return _documents(spark, sf_dir, _join(E.tokens_to_ids(tokens, toy.tokenizer())).alias("ids"))


@_query("SELECT 0 AS bos, 0 AS eos, 0 AS n, 0 AS pair UNION ALL SELECT 1, 0, 1, 1 UNION ALL SELECT 0, 1, 1, 2 UNION ALL SELECT 1, 1, 2, 3")
def e7_special_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tok = toy.tokenizer()
    rows = [(b, e, tok.num_special_tokens(bool(b), bool(e)), tok.num_special_tokens(bool(b), bool(e), True)) for b in (0, 1) for e in (0, 1)]
    return spark.createDataFrame(rows, "bos int, eos int, n int, pair int")


# Vocabularies

_BUILT = "b AS (SELECT row_number() OVER (ORDER BY w) - 1 AS id, w AS piece, n FROM (SELECT w, count(*) AS n FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part) GROUP BY 1))"


def _name_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split(F.lower("p_name"), " ")).alias("at", "w"))


def _built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary table of the words of part names: ids in the order of the pieces."""
    from pyspark.sql import Window

    counts = _name_words(spark, sf_dir).groupBy(F.col("w").alias("piece")).agg(F.count("*").alias("n"))
    return counts.select((F.row_number().over(Window.orderBy("piece")) - 1).alias("id"), "piece", (-F.col("n")).cast("float").alias("score"), F.lit(1).alias("type"), F.lit(False).alias("added"))


@_query("SELECT p_type AS piece, max(p_partkey)::INTEGER AS id FROM part GROUP BY p_type")
def v1_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a repeated piece the last id counts."""
    repeated = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("id"), F.col("p_type").alias("piece"))
    return V.index(repeated).select("piece", "id")


@_query(f"WITH {_BUILT} SELECT id::INTEGER AS id, piece, -n::DOUBLE AS score FROM b")
def v1_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir).select("id", "piece", F.col("score").cast("double").alias("score"))


@_query(f"WITH {_BUILT}, w AS (SELECT 's' || s_suppkey AS key, unnest(string_split(lower(s_name), ' ')) AS w FROM supplier UNION ALL SELECT 'p' || p_partkey, unnest(string_split(lower(p_name), ' ')) FROM part) SELECT key, w AS word, coalesce(b.id, -1)::INTEGER AS id FROM w LEFT JOIN b ON w = piece")
def v2_piece_to_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("key"), F.explode(F.split(F.lower("s_name"), " ")).alias("word"))
    parts = _name_words(spark, sf_dir).select(F.concat(F.lit("p"), "p_partkey"), "w")
    return V.piece_to_id(suppliers.union(parts), "word", _built(spark, sf_dir), -1).select("key", "word", F.col("id").cast("int").alias("id"))


@_query(f"WITH {_TOY}, x AS (SELECT event_id, (event_id % {len(toy.pieces()) + 5})::INTEGER AS token FROM events) SELECT event_id, token, coalesce(piece, '<unk>') AS piece, coalesce(score, '-infinity'::DOUBLE) AS score, coalesce(type, 2) AS type, coalesce(type, 2) IN (2, 3) AS is_special, false AS is_byte, token = 0 AS is_unk, token = 1 AS is_bos, token = 2 AS is_eos, token = 2 AS is_pad FROM x LEFT JOIN v ON token = v.id")
def v3_describe_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2 to V4"""
    tok = toy.tokenizer()
    asked = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % (len(toy.pieces()) + 5)).cast("int").alias("token"))
    found = V.describe_ids(asked, "token", V.vocab_df(spark, tok), tok.vocab.trainer, len(tok.vocab))
    return found.select("event_id", "token", "piece", F.col("score").cast("double").alias("score"), "type", "is_special", "is_byte", "is_unk", "is_bos", "is_eos", "is_pad")


@_query("SELECT c_custkey, '<0x' || lpad(upper(to_hex(c_custkey % 256)), 2, '0') || '>' AS token, (c_custkey % 256)::INTEGER AS value FROM customer")
def v5_byte_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "customer").select("c_custkey", V.byte_token(F.col("c_custkey") % 256).alias("token"))
    return made.select("*", V.byte_value(F.col("token")).alias("value"))


@_query(f"WITH {_BUILT}, t AS (SELECT n_nationkey AS pos, lower(n_name) AS piece FROM nation), f AS (SELECT pos, piece FROM t WHERE piece NOT IN (SELECT piece FROM b)) SELECT id::INTEGER AS id, piece, false AS added FROM b UNION ALL SELECT ((SELECT max(id) FROM b) + row_number() OVER (ORDER BY pos))::INTEGER, piece, true FROM f")
def v7_add_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("pos"), F.lower("n_name").alias("piece"))
    return V.add_tokens(_built(spark, sf_dir), tokens).select("id", "piece", "added")


@_query(f"WITH {_BUILT}, t AS (SELECT ((SELECT count(*) FROM b) + 3 + 2 * r_regionkey)::INTEGER AS id, '<' || r_name || '>' AS piece, r_regionkey % 2 = 0 AS special FROM region), k AS (SELECT id, piece, 1 AS type, false AS added FROM b UNION ALL SELECT id, piece, CASE WHEN special THEN 3 ELSE 4 END, true FROM t) SELECT g.id::INTEGER AS id, coalesce(piece, '') AS piece, coalesce(type, 1) AS type, coalesce(added, false) AS added FROM (SELECT unnest(range((SELECT max(id) + 1 FROM k))) AS id) g LEFT JOIN k ON g.id = k.id")
def v9_add_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens at their own ids, with gaps."""
    vocab = _built(spark, sf_dir)
    size = vocab.agg(F.count("*")).scalar()
    entries = table(spark, sf_dir, "region").select((size + 3 + 2 * F.col("r_regionkey")).cast("int").alias("id"), F.concat(F.lit("<"), "r_name", F.lit(">")).alias("piece"), (F.col("r_regionkey") % 2 == 0).alias("special"))
    return V.add_at(vocab, entries).select("id", "piece", "type", "added")


_WITH_NATIONS = "t AS (SELECT n_nationkey AS pos, lower(n_name) AS piece FROM nation), f AS (SELECT pos, piece FROM t WHERE piece NOT IN (SELECT piece FROM b)), a AS (SELECT ((SELECT max(id) FROM b) + row_number() OVER (ORDER BY pos))::INTEGER AS id, piece FROM f)"


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("pos"), F.lower("n_name").alias("piece"))


@_query(f"WITH {_BUILT}, {_WITH_NATIONS} SELECT id::INTEGER AS id, piece, 1 AS type, false AS added FROM b UNION ALL SELECT id, piece, 3, true FROM a")
def v8_add_special_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.add_tokens(_built(spark, sf_dir), _nations(spark, sf_dir), CONTROL).select("id", "piece", "type", "added")


@_query(f"WITH {_BUILT}, {_WITH_NATIONS} SELECT id, piece, true AS is_added FROM a UNION ALL SELECT id::INTEGER, piece, false FROM b WHERE piece IN ('green', 'blue', 'red') UNION ALL SELECT NULL, 'no such piece', false")
def v10_added_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether pieces were added, for all that were and some that were not."""
    grown = V.add_tokens(_built(spark, sf_dir), _nations(spark, sf_dir))
    asked = V.added_vocab(grown).select("piece").union(grown.where("piece IN ('green', 'blue', 'red')").select("piece")).union(spark.createDataFrame([("no such piece",)], "piece string"))
    return V.is_added(asked, "piece", grown).select("id", "piece", "is_added")


@_query(f"WITH {_BUILT}, w AS (SELECT n_nationkey::BIGINT AS pos, lower(n_name) AS piece FROM nation UNION ALL SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) FROM part) SELECT pos, piece FROM w WHERE piece IN (SELECT piece FROM b)")
def v2_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _nations(spark, sf_dir).select(F.col("pos").cast("long").alias("pos"), "piece").union(_name_words(spark, sf_dir).select("p_partkey", "w"))
    return V.contains(tokens, "piece", _built(spark, sf_dir))


_TAGS = ("<p>", "</p>", "<br>", "<b>", "</li>")
_TAG_PATTERN = "|".join(_TAGS)


@_query(f"WITH x AS (SELECT page_id, regexp_extract_all(coalesce(html, ''), '{_TAG_PATTERN}') AS t FROM pages) SELECT page_id, len(t)::BIGINT AS n, array_to_string(t, ' ') AS tags FROM x")
def w9_added_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added tokens are cut out of a text before it is normalized."""
    tok = toy.tokenizer()
    vocab = tok.vocab
    for i, t in enumerate(_TAGS):
        vocab = vocab.add_at(_BYTE0 + i, t)
    tok = replace(tok, vocab=vocab, added_tokens=tuple(AddedToken(_BYTE0 + i, t, normalized=False) for i, t in enumerate(_TAGS)))
    found = spread(table(spark, sf_dir, "pages")).select("page_id", F.filter(E.tokenize(F.coalesce("html", F.lit("")), tok), lambda t: t.isin(*_TAGS)).alias("t"))
    return found.select("page_id", F.size("t").cast("long").alias("n"), F.array_join("t", " ").alias("tags"))


_HF_UNIGRAM = json.dumps([["<unk>", 0.0], ["<s>", 0.0], [MARK, -1.0], ["hello", -2.5], ["<0x0A>", -9.0], ["h", -4.25]])
_HF_MERGES = json.dumps(["h e", "l l", "he ll", "hell o", "h e"])
_HF_VOCAB = json.dumps({"<unk>": 0, "h": 1, "e": 2, "l": 3, "o": 4, "he": 5, "ll": 6, "hell": 7, "hello": 8})


@_query(f"SELECT (i - 1)::INTEGER AS id, x->>0 AS piece, (x->>1)::DOUBLE AS score, CASE WHEN i = 1 THEN 2 WHEN x->>0 = '<s>' THEN 3 WHEN regexp_matches(x->>0, '^<0x[0-9A-F][0-9A-F]>$') THEN 6 ELSE 1 END AS type FROM (SELECT unnest(json_extract('{_HF_UNIGRAM}', '$[*]')) AS x, unnest(range(1, 7)) AS i)")
def s6_unigram_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wordloom.sources import hf_json

    tok = hf_json.load({"model": {"type": "Unigram", "vocab": json.loads(_HF_UNIGRAM), "unk_id": 0}, "added_tokens": [{"id": 1, "content": "<s>", "special": True}]})
    return V.vocab_df(spark, tok).select("id", "piece", F.col("score").cast("double").alias("score"), "type")


@_query(f"WITH v AS (SELECT k AS piece, ('{_HF_VOCAB}'::JSON->>k)::INTEGER AS id FROM (SELECT unnest(json_keys('{_HF_VOCAB}')) AS k)), m AS (SELECT replace(x, ' ', '') AS piece, max(i) AS rank FROM (SELECT unnest(json_extract_string('{_HF_MERGES}', '$[*]')) AS x, unnest(range(5)) AS i) GROUP BY 1) SELECT id, piece, CASE WHEN id = 0 THEN 0.0 WHEN rank IS NOT NULL THEN -rank ELSE -6.0 END::DOUBLE AS score FROM v LEFT JOIN m USING (piece)")
def s7_bpe_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores from merge ranks; a repeated merge takes its last rank."""
    from wordloom.sources import hf_json

    tok = hf_json.load({"model": {"type": "BPE", "vocab": json.loads(_HF_VOCAB), "merges": json.loads(_HF_MERGES)}})
    return V.vocab_df(spark, tok).select("id", "piece", F.col("score").cast("double").alias("score"))


# Streams


@_query()
def x2_stream_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every turn's tokens; tests hold their concatenation against decode and each chunk against a full re-decode."""
    turns = spread(table(spark, sf_dir, "conversations"))
    made = turns.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("stream"), E.token_ids("text", toy.tokenizer()).alias("ids"))
    return stream_decode_arrays(made, "stream", "ids", toy.tokenizer()).select(F.col("key").alias("stream"), "seq", "chunk", "stream_end")


@_query(f"WITH RECURSIVE {_TOY}, {_sql_ids('conversations', 'conv_id, turn', ('text',))} SELECT conv_id, turn, regexp_replace(replace(array_to_string(list_transform(x0, lambda z: CASE WHEN z = '0' THEN '' ELSE pc[z::INTEGER + 1] END), ''), '{MARK}', ' '), '^ ', '') AS text FROM enc WHERE x0 IS NOT NULL")
def x2_stream_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of each stream together, from tokens that come one row each."""
    turns = spread(table(spark, sf_dir, "conversations")).where("text is not null")
    ids = turns.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("stream"), F.posexplode(E.token_ids("text", toy.tokenizer())).alias("pos", "id"))
    chunks = stream_decode_batch(ids, "stream", "pos", "id", toy.tokenizer())
    whole = chunks.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "chunk"))), lambda x: x["chunk"]), "").alias("text"))
    parts = F.split("key", "/")
    return whole.select(parts[0].cast("long").alias("conv_id"), parts[1].cast("long").alias("turn"), "text")


_LAST = "length(text) - strpos(reverse(text), ' ')"


@_query(f"SELECT conv_id, turn, CASE WHEN strpos(text, chr(10)) > 0 THEN text[:strpos(text, chr(10))] WHEN strpos(text, ' ') > 0 AND {_LAST} > 0 THEN text[:{_LAST} + 1] WHEN length(text) > 4 THEN text WHEN text IS NOT NULL THEN '' END AS out FROM conversations")
def x3_printable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", printable_column(F.col("text")).alias("out"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e_tokens_by_lang(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
