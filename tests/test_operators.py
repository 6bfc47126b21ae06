"""Byte fallback, added tokens, pairs, vocabularies, JSON loading, SQL functions and streams."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_engine import MINIMAL, minimal, template
from wordloom.functions import sql, textops
from wordloom.model import BYTE, MARK, UNKNOWN, AddedToken, Config, FormatError, Model, NormalizerOp, NormalizerSpec, Piece, Trainer, Unsupported, Vocabulary
from wordloom.operators import columns as C
from wordloom.operators import encode as E
from wordloom.operators import vocabulary as V
from wordloom.operators.encoding import Encoding
from wordloom.operators.kernels import PrefixTable, Unigram
from wordloom.operators.tokenizer import Tokenizer
from wordloom.plans import toy
from wordloom.sources import hf_json
from wordloom.sources.charsmap import Charsmap
from wordloom.sources.tables import spread
from wordloom.streaming import text_stream as X

# Byte fallback


def test_bytes_of_an_unknown_character_come_last_first():
    tok, first = toy.bytes_tokenizer(), len(toy.pieces())
    assert tok.ids("Z") == [tok.vocab.index[MARK], first + ord("Z")]
    han = "漢".encode()
    assert tok.ids("漢")[1:] == [first + b for b in han[::-1]]
    assert Tokenizer(tok.vocab, tok.normalizer, forward_bytes=True).ids("漢")[1:] == [first + b for b in han]


def test_byte_pieces_that_are_missing_end_in_the_greedy_path():
    pieces = (Piece("<unk>", 0.0, UNKNOWN), Piece("a", -1.0), Piece("ab", -1.5), Piece("b", -1.0), *(Piece(f"<0x{b:02X}>", -9.0, BYTE) for b in (0x7A, 0xC3)))
    v = Vocabulary(pieces, Trainer(byte_fallback=True))
    assert Unigram(v).tokenize("az") == [1, 4]
    # the path ends at a character without its bytes: longest pieces from the start, known bytes, and the unknown piece
    assert Unigram(v).tokenize("abéz") == [2, 5, 0, 4]
    assert Unigram(Vocabulary(pieces[:4], Trainer(byte_fallback=True))).tokenize("abq") == [2, 0]


def test_decoded_bytes():
    tok, first = toy.bytes_tokenizer(), len(toy.pieces())
    ids = [first + b for b in "é".encode()]
    assert tok.decode(ids) == "Ã©" and Tokenizer(tok.vocab, tok.normalizer, utf8_bytes=True).decode(ids) == "é"


def test_prefixes():
    table = PrefixTable()
    for i, p in enumerate(("a", "ab", "abcd", "b")):
        table.insert(p, i)
    assert [x[0] for x in table.prefixes("xabcde", 1)] == ["a", "ab", "abcd"] and table.longest_prefix("abx") == ("ab", 1, 0, 2)
    assert table.longest_prefix("zz") is None and "ab" in table and len(table) == 4 and table.lookup("q") is None
    table.clear()
    assert len(table) == 0 and table.prefixes("abc") == []


# Added tokens


def with_added(*tokens, base=None):
    tok = base or minimal()
    vocab = tok.vocab
    for t in tokens:
        vocab = vocab.add_at(t.id, t.content, t.special)
    return Tokenizer(vocab, tok.normalizer, added_tokens=tokens)


X0 = len(MINIMAL)


@pytest.mark.parametrize(
    "options, text, span",
    [
        ({}, "hello [X] hello", (6, 9)), ({"lstrip": True}, "hello  [X] hello", (5, 10)), ({"rstrip": True}, "hello [X]  hello", (6, 11)), ({"lstrip": True, "rstrip": True}, "hello [X] \thello", (5, 11)),
        ({"single_word": True}, "hello[X] hello", None), ({"single_word": True}, "hello [X]_", None), ({"single_word": True}, "hello ([X])", (7, 10)),
    ],
)
def test_sides_of_an_added_token(options, text, span):
    tok = with_added(AddedToken(X0, "[X]", normalized=False, **options))
    e = tok.encode(text)
    assert [(s, t) for s, t, _ in tok.added_matches(text)] == ([span] if span else []) and tok.ids(text) == e.ids
    assert span is None or (X0, span) in zip(e.ids, e.offsets)


def test_longest_added_token_wins_and_the_first_of_equal_ones():
    tok = with_added(AddedToken(X0, "[X]", normalized=False), AddedToken(X0 + 1, "[X]]", normalized=False))
    assert [i for i in tok.ids("a[X]]b[X]") if i >= X0] == [X0 + 1, X0]


def test_normalized_added_token():
    """a normalized added token is found in its own and in its mapped form."""
    blob = Charsmap.build({"Ａ": "A"}).to_bytes()
    base = Tokenizer(minimal().vocab, NormalizerSpec(add_dummy_prefix=False, escape_whitespaces=False, remove_extra_whitespaces=False, operations=(NormalizerOp("Precompiled", charsmap=blob),)))
    tok = with_added(AddedToken(X0, "Ａ"), base=base)
    assert tok.ids("A") == tok.ids("Ａ") == [X0]


# Offsets


def test_spans_show_their_tokens():
    spec = NormalizerSpec(add_dummy_prefix=False, remove_extra_whitespaces=False)
    tok = Tokenizer.from_model(Model(tuple(toy.pieces()), Trainer(), spec))
    r = random.Random(7)
    for _ in range(200):
        text = " ".join("".join(r.choice("thearnio") for _ in range(r.randrange(1, 7))) for _ in range(r.randrange(0, 6)))
        e = tok.encode(text)
        assert [text[s:t].replace(" ", MARK) for s, t in e.offsets if t > s] == [x for x, (s, t) in zip(e.tokens, e.offsets) if t > s]
        at = [o for o in e.offsets if o[1] > o[0]]
        assert at == sorted(at) and all(a[1] <= b[0] for a, b in zip(at, at[1:]))


# Pairs


def test_pair_strategies(spark):
    tok = toy.tokenizer()
    a, b = "the house and the tree", "a small door"
    whole = len(tok.encode_pair(a, b))
    rows = spark.createDataFrame([(a, b)], "a string, b string")
    for strategy in ("longest_first", "only_first", "only_second", "do_not_truncate"):
        made = tok.encode_pair(a, b, max_length=whole - 4, strategy=strategy)
        got = rows.select(E.encode_pair("a", "b", tok, max_length=whole - 4, strategy=strategy).alias("e")).first()["e"]
        assert list(got["ids"]) == made.ids and list(got["type_ids"]) == made.type_ids and list(got["sequence_ids"]) == made.sequence_ids
        assert len(made) == (whole if strategy == "do_not_truncate" else whole - 4)
        first = sum(x == 0 for x in made.sequence_ids)
        assert first == {"only_first": len(tok.ids(a)) - 4, "only_second": len(tok.ids(a))}.get(strategy, first)
    left, right = Encoding.truncate_pair(Encoding.content([(1, "a", (0, 1), 0)] * 5), Encoding.content([(1, "a", (0, 1), 0)] * 3), 7, "only_first", 0)
    assert (len(left), len(right)) == (4, 3)


def test_a_long_row_does_not_fail_the_job(spark):
    tok, long = toy.tokenizer(), "the " * 150_000
    with pytest.raises(ValueError):
        tok.encode(long)
    sql.register(spark, tok, "long")
    df = spark.createDataFrame([(1, long), (2, "the"), (3, None)], "i int, t string")
    got = {r["i"]: r["n"] for r in df.select("i", F.size(E.encode("t", tok)["ids"]).alias("n")).collect()}
    assert got == {1: 150_002, 2: 3, 3: None}
    df.createOrReplaceTempView("long_rows")
    assert [r[0] for r in spark.sql("SELECT long_count(t) FROM long_rows ORDER BY i").collect()] == [150_000, 1, None]


def test_padding_of_batches_sent_or_met(spark, monkeypatch):
    tok = toy.tokenizer().with_padding(multiple=4)
    texts = [("x", "the house"), ("x", ""), ("y", None), (None, "a tree and a door"), (None, "the"), ("y", "a")]
    df = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(texts)], "i int, k string, t string")
    want = {}
    for key in ("x", "y", None):
        rows = [(i, t) for i, (k, t) in enumerate(texts) if k == key and t is not None]
        want |= {i: e.ids for (i, _), e in zip(rows, tok.encode_batch([t for _, t in rows]))}
    for most in (C.BROADCAST_BATCHES, 1):
        monkeypatch.setattr(C, "BROADCAST_BATCHES", most)
        got = {r["i"]: r["encoding"] for r in E.encode_batch(df, "t", tok, batch_by="k").collect()}
        assert {i: list(e["ids"]) for i, e in got.items() if e} == want and got[2] is None
    assert "BroadcastHashJoin" in E.encode_batch(df, "t", tok, batch_by="k")._jdf.queryExecution().toString() or most == 1


def test_tokens_by_words_are_those_of_whole_texts(spark):
    r = random.Random(9)
    texts = [None, "", "  ", "the", f"a{MARK}b {MARK}{MARK} c{MARK}", *("".join(r.choice(f"the  nd\t\u00a0Zé{MARK if r.random() < 0.1 else 'o'}") for _ in range(r.randrange(80))) for _ in range(200))]
    df = spark.createDataFrame([("k" if i % 3 else None, t) for i, t in enumerate(texts)], "k string, t string")
    for tok in (toy.tokenizer(), toy.tokenizer(fuse=True), toy.bytes_tokenizer()):
        want = {}
        for i, t in enumerate(texts):
            n = len(tok.ids(t)) if t is not None else 0
            if n:
                k = "k" if i % 3 else None
                want[k] = (want.get(k, (0, 0))[0] + n, want.get(k, (0, 0))[1] + 1)
        assert {x["k"]: (x["tokens"], x["docs"]) for x in E.tokens_by(df, "t", "k", tok).collect()} == want


def test_spread_keeps_the_rows(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/one")
    one = spark.read.parquet(f"{tmp_path}/one")
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread(one).distinct().count() == 1000
    spark.range(1000).repartition(40).write.parquet(f"{tmp_path}/many")
    assert "Exchange" not in spread(spark.read.parquet(f"{tmp_path}/many"))._jdf.queryExecution().toString()


# Vocabularies


def test_special_tokens_by_role():
    v, count = minimal().vocab.add_special_tokens({"pad_token": "<pad>", "bos": "<s>", "extra": "<mask>", "eos_token": "<end>"})
    assert count == 3 and [v.id_to_piece(i) for i in range(X0, X0 + 3)] == ["<pad>", "<mask>", "<end>"]
    assert (v.trainer.pad_id, v.trainer.bos_id, v.trainer.eos_id, v.trainer.eos_piece) == (X0, 1, X0 + 2, "<end>")
    assert all(v.is_special(i) for i in range(X0, X0 + 3)) and v.added_special == (X0, X0 + 1, X0 + 2)


def test_added_vocabulary(spark):
    tok, count = minimal().add_tokens(["new", "hello", "new"])
    assert count == 3 - ("hello" in minimal().vocab.index)
    assert set(tok.added_vocab()) == {"new", "hello"} - set(minimal().vocab.index) and tok.is_added_token("new") and not tok.is_added_token("h") and not tok.is_added_token("zz")
    assert tok.is_added(X0) and not tok.is_added(0) and "new" not in tok.get_vocab(False)
    asked = spark.createDataFrame([("new",), ("h",), ("zz",)], "p string")
    assert {r["p"]: r["is_added"] for r in V.is_added(asked, "p", V.vocab_df(spark, tok)).collect()} == {"new": True, "h": False, "zz": False}


# JSON


@pytest.mark.parametrize("decoder, fallback", [(None, False), ({"type": "ByteFallback"}, True), ({"type": "Sequence", "decoders": [{"type": "Fuse"}, {"type": "Sequence", "decoders": [{"type": "ByteFallback"}]}]}, True), ({"type": "Metaspace"}, False)])
def test_byte_fallback_of_a_decoder(decoder, fallback):
    assert hf_json.has_byte_fallback(decoder) is fallback


def replacing(pattern, content):
    return {"type": "Replace", "pattern": pattern, "content": content}


def test_flags_of_a_normalizer():
    of = lambda *steps: hf_json.parse_normalizer({"type": "Sequence", "normalizers": list(steps)})
    prepend = {"type": "Prepend", "prepend": MARK}
    assert hf_json.parse_normalizer(None).spec == NormalizerSpec(remove_extra_whitespaces=False)
    assert of(prepend, replacing({"String": " "}, MARK)).spec == NormalizerSpec(add_dummy_prefix=True, remove_extra_whitespaces=False, escape_whitespaces=True)
    assert of(replacing({"String": "a"}, "b")).spec == NormalizerSpec(add_dummy_prefix=False, remove_extra_whitespaces=False, escape_whitespaces=False)
    # with a character map the steps themselves run
    import base64

    blob = Charsmap.build({"A": "a"}).to_bytes()
    mapped = of({"type": "Precompiled", "precompiled_charsmap": base64.b64encode(blob).decode()}, replacing({"String": "a"}, "b"))
    assert textops.TextNormalizer(mapped.spec).normalize("Aa") == "bb"
    for bad, error in ((replacing("x", "y"), FormatError), (replacing({"Other": 1}, "y"), Unsupported), (replacing({"Regex": "("}, "y"), FormatError), ({"type": "Prepend"}, FormatError), ({"type": "NFKC"}, Unsupported), ({"type": "Precompiled", "precompiled_charsmap": "!"}, FormatError)):
        with pytest.raises(error):
            of(bad)


@pytest.mark.parametrize(
    "steps, proven",
    [([replacing({"String": " "}, MARK)], True), ([replacing({"String": " "}, MARK), replacing({"String": "x"}, "a b")], False), ([replacing({"Regex": " "}, MARK)], False), ([replacing({"String": " "}, MARK), {"type": "Prepend", "prepend": " "}], False), ([], False)],
)
def test_a_split_at_spaces_needs_proof_that_none_are_left(steps, proven):
    split = {"type": "Split", "pattern": {"String": " "}, "behavior": "MergedWithPrevious", "invert": False}
    normal = hf_json.parse_normalizer({"type": "Sequence", "normalizers": steps})
    assert normal.no_spaces is proven
    if proven:
        assert hf_json.parse_pre_tokenizer(split, True).use_metaspace is False
    else:
        with pytest.raises(Unsupported):
            hf_json.parse_pre_tokenizer(split, normal.no_spaces)


def test_metaspace():
    of = lambda **more: hf_json.parse_pre_tokenizer({"type": "Metaspace", "replacement": MARK, **more}, False)
    assert of().add_prefix_space and of(prepend_scheme="first").add_prefix_space and not of(prepend_scheme="never").add_prefix_space
    assert not of(add_prefix_space=False, prepend_scheme="always").add_prefix_space and of(split=False).split is False
    for bad, error in (({"prepend_scheme": "sometimes"}, Unsupported), ({"replacement": ""}, FormatError)):
        with pytest.raises(error):
            of(**bad)


def test_metadata_and_added_tokens_of_a_file():
    data = template(["a"])
    data["added_tokens"] += [{"id": 7, "content": "<late>", "special": False, "lstrip": True}, {"id": 5, "content": "<early>", "special": True}]
    tok = hf_json.load(data)
    assert [tok.vocab.id_to_piece(i) for i in (5, 6, 7)] == ["<early>", "", "<late>"] and tok.vocab.is_special(5) and not tok.vocab.is_special(7)
    assert tok.vocab.trainer.unk_id == 3 and tok.vocab.trainer.bos_id == 0


# SQL functions


def test_sql_functions(spark):
    tok = toy.tokenizer()
    names = sql.register(spark, tok, "t")
    assert names == ["t_encode", "t_encode_pair", "t_ids", "t_tokenize", "t_count", "t_decode", "t_explode"]
    text, other = "the house", "a tree"
    row = spark.sql(f"SELECT t_encode('{text}') AS e, t_encode_pair('{text}', '{other}') AS p, t_ids('{text}') AS i, t_tokenize('{text}') AS t, t_count('{text}') AS n, t_decode(t_ids('{text}')) AS d, t_ids(CAST(NULL AS STRING)) AS z").first()
    assert list(row["e"]["ids"]) == tok.encode(text).ids and list(row["p"]["ids"]) == tok.encode_pair(text, other).ids and list(row["i"]) == tok.ids(text)
    assert list(row["t"]) == tok.tokenize(text) and row["n"] == len(tok.ids(text)) and row["d"] == text and row["z"] is None
    got = spark.sql(f"SELECT * FROM t_explode('{text}') ORDER BY pos").collect()
    assert [(r["id"], r["token"], (r["start"], r["end"]), r["word_id"]) for r in got] == tok.rows(text)


# Streams


def test_streams_end_reset_and_skip_prompts():
    tok, ids = minimal(), minimal().ids("hello world")
    out = []
    s = X.TextStreamer(tok, on_text=lambda text, last: out.append((text, last)))
    s.end()
    assert out == [("", True)]
    out.clear()
    s.put(ids[0])
    s.reset()
    for x in ids:
        s.put(x)
    s.end()
    assert "".join(t for t, _ in out) == "hello world" and [last for _, last in out].count(True) == 1
    texts = []
    X.decode_with_callback(tok, [1, *ids, 2], texts.append)
    assert "".join(texts) == "hello world" and all(texts)
    for n in (1, 3):
        out.clear()
        s = X.TextStreamer(tok, skip_prompt=True, prompt_length=n, on_text=lambda text, last: out.append((text, last)))
        for _ in range(2):  # the prompt is skipped again after an end
            for x in [1] * n + ids:
                s.put(x)
            s.end()
        assert "".join(t for t, _ in out) == "hello world" * 2
    assert list(X.decode_stream(tok, [1, 2])) == []


def test_batch_and_array_streams_agree(spark):
    r = random.Random(10)
    tok = toy.tokenizer()
    streams = {k: [r.randrange(len(tok.vocab)) for _ in range(r.randrange(25))] for k in range(30)}
    arrays = spark.createDataFrame([*streams.items(), (99, None)], "k int, ids array<int>")
    rows = spark.createDataFrame([(k, p, i) for k, ids in streams.items() for p, i in enumerate(ids)], "k int, p int, i int")
    for options in ({}, {"skip_prompt": True, "prompt_length": 2}, {"skip_special": False}):
        a = [tuple(x) for x in X.stream_decode_arrays(arrays, "k", "ids", tok, **options).collect()]
        b = [tuple(x) for x in X.stream_decode_batch(rows, "k", "p", "i", tok, **options).collect()]
        assert sorted(x for x in a if streams[x[0]]) == sorted(b)


def test_late_tokens_and_prompts_in_a_streaming_query(spark, tmp_path):
    tok = minimal()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ids = [1, *minimal().ids("hello world")]
    schema = "k string, p int, i int, e boolean"
    for part, positions in enumerate(([0, 1, 2, 3], [2, 4, 5, 6])):  # position 2 comes again, late
        spark.createDataFrame([("a", p, ids[p], p == 6) for p in positions], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{part}")
    source_dir = tmp_path / "in"
    source_dir.mkdir()
    got = []
    for part in range(2):
        for f in (tmp_path / f"in{part}").glob("*.parquet"):
            f.rename(source_dir / f"{part}-{f.name}")
        source = spark.readStream.schema(schema).parquet(str(source_dir))
        made = X.stream_decode(source, "k", "p", "i", tok, "e", skip_prompt=True, prompt_length=1)
        query = made.writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
        assert query.awaitTermination(120)
    assert "".join(r["chunk"] for r in sorted(got, key=lambda r: r["seq"])) == "hello world" and max(r["late"] for r in got) == 1


def test_config_names():
    assert Config.gemma() == Config(add_bos=True, add_eos=True) and Config.llama() == Config(add_bos=True)
