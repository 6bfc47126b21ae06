"""Models, kernels, encodings, decoding and streams against fixed cases and definitions."""

import random

import pytest

from wordloom.model import BPE, MARK, UNKNOWN, AddedToken, Config, FormatError, Model, NormalizerSpec, Piece, PreTokenizerSpec, Trainer, Unsupported, Vocabulary
from wordloom.operators import columns as C
from wordloom.operators import encode as E
from wordloom.operators.encoding import FIELDS, Encoding, pair_lengths
from wordloom.operators.kernels import Bpe, Unigram, naive_bpe
from wordloom.operators.tokenizer import Tokenizer
from wordloom.plans import toy
from wordloom.sources import hf_json, own_json
from wordloom.sources.charsmap import Charsmap
from wordloom.sources.model_file import parse_model, write_model
from wordloom.streaming import text_stream as X

MINIMAL = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), (MARK, -1.0, 1), *[(MARK + w, s, 1) for w, s in (("hello", -2.0), ("world", -2.5), ("the", -1.5), ("a", -1.8), ("is", -2.0), ("test", -2.2), ("This", -2.3), ("sentence", -3.0))], *[(c, -3.5, 1) for c in "helowrdtsnci"]]


def minimal(config=Config()):
    return Tokenizer.from_model(Model(tuple(Piece(*p) for p in MINIMAL), Trainer(), NormalizerSpec(add_dummy_prefix=False)), config)


def test_minimal_model():
    assert minimal().encode("hello world").ids == [12, 13, 14, 14, 15, 5]
    assert list(X.decode_stream(minimal(), [12, 13, 14, 14, 15, 5])) == ["hello", " world"]


SIX = (Piece("<unk>", -100.0, UNKNOWN), Piece("a", -1.0), Piece("b", -1.0), Piece("ab", -0.5), Piece("abc", -0.3), Piece("c", -1.0))


def test_six_pieces():
    v = Vocabulary(SIX, Trainer())
    assert [Unigram(v).tokenize(t) for t in ("a", "abc", "abab")] == [[1], [4], [3, 3]]
    assert [Bpe(v).tokenize(t) for t in ("a", "ab", "abc")] == [[1], [3], [4]]


def test_heap_merges_are_the_naive_ones():
    r = random.Random(1)
    for _ in range(400):
        pieces = [Piece("<unk>", 0.0, UNKNOWN), *(Piece(p, float(-r.randrange(6))) for p in sorted({"".join(r.choice("abc") for _ in range(r.randrange(1, 5))) for _ in range(12)}))]
        v = Vocabulary(tuple(pieces), Trainer(model_type=BPE))
        text = "".join(r.choice("abcd") for _ in range(r.randrange(0, 14)))
        assert Bpe(v).tokenize(text) == naive_bpe(v, text)


def test_best_path_is_best():
    r = random.Random(2)

    def best(v, text):
        if not text:
            return 0.0
        hits = [n for n in range(1, len(text) + 1) if text[:n] in v.index]
        return max((v.score(v.index[text[:n]]) + best(v, text[n:]) for n in hits), default=None) if hits else v.score(0) + best(v, text[1:])

    for _ in range(200):
        pieces = [Piece("<unk>", -9.0, UNKNOWN), *(Piece(c, -4.0) for c in "abc"), *(Piece(p, -r.randrange(1, 40) / 4) for p in sorted({"".join(r.choice("abc") for _ in range(r.randrange(2, 5))) for _ in range(8)}))]
        v = Vocabulary(tuple(pieces), Trainer())
        text = "".join(r.choice("abcd") for _ in range(r.randrange(0, 9)))
        assert sum(v.score(i) for i in Unigram(v).tokenize(text)) == best(v, text)


@pytest.mark.parametrize("tok", [toy.tokenizer(), toy.tokenizer(fuse=True), toy.bpe(), minimal(), Tokenizer.from_model(Model(tuple(toy.pieces()), Trainer(), NormalizerSpec(), PreTokenizerSpec())), Tokenizer.from_model(Model(tuple(toy.pieces()), Trainer(), NormalizerSpec(escape_whitespaces=False), PreTokenizerSpec(True)))])
def test_memo_path_gives_the_ids_of_rows(tok):
    r = random.Random(3)
    for _ in range(200):
        text = "".join(r.choice("the  and\tZ9ä　▁.") for _ in range(r.randrange(0, 40)))
        assert tok.ids(text) == [x[0] for x in tok.rows(text)] == tok.ids(text)


def test_added_tokens_are_cut_out():
    tok = minimal()
    tok = Tokenizer(tok.vocab.add_at(len(MINIMAL), "[X]"), tok.normalizer, added_tokens=(AddedToken(len(MINIMAL), "[X]", normalized=False),))
    e = tok.encode("hello[X]hello")
    assert e.ids.count(len(MINIMAL)) == 1 and e.offsets[e.ids.index(len(MINIMAL))] == (5, 8) and tok.ids("hello[X]hello") == e.ids


def test_charsmap():
    assert Charsmap.build({"A": "a", "B": "b"}).normalize("ABCA") == "abCa"
    assert Charsmap.build({"A": "1", "AB": "2", "ABC": "3"}).normalize("ABCABD") == "32D"
    blob = Charsmap.build({"ﬁ": "fi", "‍": ""}).to_bytes()
    assert Charsmap.parse(blob).to_bytes() == blob and Charsmap.parse(blob).normalize("ﬁ‍x") == "fix"
    for bad in (b"\0\0", b"\xff\0\0\0", b"\3\0\0\0abc"):
        with pytest.raises(FormatError):
            Charsmap.parse(bad)


def test_round_trips():
    tok = minimal(Config.gemma())
    model = Model(tok.vocab.pieces, tok.vocab.trainer, tok.normalizer)
    back = parse_model(write_model(model))
    assert [p.piece for p in back.pieces] == [p.piece for p in model.pieces] and back.normalizer.add_dummy_prefix is False
    again = own_json.load(tok.to_json())
    assert again.encode("hello world") == tok.encode("hello world") and again.config == tok.config
    with pytest.raises(FormatError):
        own_json.load("{}")
    with pytest.raises(Unsupported):
        Tokenizer.from_model(Model(SIX, Trainer(model_type="word")))


def template(pieces, **more):
    return {"model": {"type": "Unigram", "unk_id": 3, "vocab": [[p, -float(i)] for i, p in enumerate(["<s>", "<pad>", "</s>", "<unk>", *pieces])]}, "added_tokens": [{"id": i, "content": t, "special": True} for i, t in enumerate(("<s>", "<pad>", "</s>", "<unk>"))], **more}


def test_pipeline_json():
    post = {"type": "TemplateProcessing", "single": [{"SpecialToken": {"id": "<s>", "type_id": 0}}, {"Sequence": {"id": "A", "type_id": 0}}, {"SpecialToken": {"id": "</s>", "type_id": 0}}]}
    meta = {"type": "Metaspace", "replacement": MARK, "prepend_scheme": "never"}
    tok = hf_json.load(template(["hello", MARK + "world"], normalizer={"type": "Sequence", "normalizers": []}, pre_tokenizer=meta))
    assert tok.tokenize("hello world") == ["hello", MARK + "world"]
    split = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "Metaspace", "replacement": MARK}]}
    assert hf_json.load(template([MARK + "hello", MARK + "world", MARK + "again"], pre_tokenizer=split)).ids("hello\tworld\nagain") == [4, 5, 6]
    assert hf_json.load(template(["a"], normalizer={"type": "Replace", "pattern": {"String": "q"}, "content": "q"})).ids("xyz") == [3]
    ends = hf_json.load(template(["hello"], post_processor=post, normalizer={"type": "Replace", "pattern": {"String": "q"}, "content": "q"}))
    assert ends.encode("hello").ids == [0, 4, 2] and ends.encode("hello").special_tokens_mask == [1, 0, 1]
    fixed = hf_json.load(template(["a"], post_processor=post, normalizer={"type": "Replace", "pattern": {"String": "q"}, "content": "q"}, truncation={"max_length": 4, "strategy": "LongestFirst", "direction": "Right", "stride": 0}, padding={"strategy": "BatchLongest", "direction": "Right", "pad_id": 1, "pad_token": "<pad>"}))
    assert fixed.encode("aaaaa").ids == [0, 4, 4, 2] and [e.ids for e in fixed.encode_batch(["a", "aa"])] == [[0, 4, 2, 1], [0, 4, 4, 2]]
    with pytest.raises(Unsupported):
        hf_json.load(template(["a"], pre_tokenizer={"type": "Digits"}))


def test_pair_lengths_are_those_of_the_loop():
    for a in range(12):
        for b in range(12):
            for room in range(1, 25):
                x, y = a, b
                for _ in range(max(a + b - room, 0)):
                    x, y = (x - 1, y) if x > y else (x, y - 1)
                assert pair_lengths(a, b, room, "longest_first") == (x, y)


def _random_encoding(r):
    parts = [Encoding.special("<s>", 1)] * r.randrange(2) + [Encoding.content([(r.randrange(9), "t", (i * 3, i * 3 + 2), r.choice([None, i // 2])) for i in range(r.randrange(7))], r.randrange(2))] + [Encoding.special("</s>", 2, 1)] * r.randrange(3)
    return Encoding.joined(parts)


def _back(row):
    return Encoding(*([tuple(x) for x in row[f]] if f == "offsets" else list(row[f]) for f in FIELDS))


def test_columns_do_what_the_python_algebra_does(spark):
    r = random.Random(4)
    all_e = [_random_encoding(r) for _ in range(60)]
    rows = [(i, {**e.to_map(), "offsets": [{"start": s, "end": t} for s, t in e.offsets]}) for i, e in enumerate(all_e)]
    df = spark.createDataFrame(rows, f"i int, e {C.SCHEMA}")
    made = df.select(
        "i", C.with_padding("e", 9, 7, right=False, pad_type_id=2).alias("pad"), C.pad_to_multiple("e", 4, 7).alias("multiple"), C.with_truncation("e", 4).alias("end"), C.with_truncation("e", 4, False).alias("start"),
        C.with_truncation("e", 4, True, True).alias("keep"), C.with_truncation("e", 1, False, True).alias("keep_start"), C.char_to_token("e", 4, 1).alias("ct"), C.word_to_chars("e", 1).alias("wc"), C.word_to_tokens("e", 1).alias("wt"), C.token_to_chars("e", 1).alias("tc"), C.n_sequences("e").alias("n"),
    )
    for x in made.collect():
        e = all_e[x["i"]]
        assert _back(x["pad"]) == e.with_padding(9, 7, right=False, pad_type_id=2) and _back(x["multiple"]) == e.pad_to_multiple(4, 7)
        assert _back(x["end"]) == e.with_truncation(4) and _back(x["start"]) == e.with_truncation(4, False)
        assert _back(x["keep"]) == e.with_truncation(4, True, True) and _back(x["keep_start"]) == e.with_truncation(1, False, True)
        spans = [tuple(x[k]) if x[k] else None for k in ("wc", "wt", "tc")]
        assert (x["ct"], *spans, x["n"]) == (e.char_to_token(4, 1), e.word_to_chars(1), e.word_to_tokens(1), e.token_to_chars(1), e.n_sequences)
    merged = C.merge_encodings(df.selectExpr("i div 4 k", "i", "e"), "k", "i", "e")
    for x in merged.collect():
        assert _back(x["encoding"]) == Encoding.merge(all_e[4 * x["k"] : 4 * x["k"] + 4])


def test_encode_columns_are_the_python_encodings(spark):
    tok = toy.tokenizer().with_truncation(12).with_padding(multiple=4)
    texts = ["the house", "", None, "a tiny  story\nabout them", "x" * 40]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [_back(r["encoding"]) if r["encoding"] else None for r in E.encode_batch(df, "t", tok).orderBy("i").collect()]
    want = tok.encode_batch([t for t in texts if t is not None])
    assert [g for g in got if g] == want and got[2] is None
    ids = df.select(E.token_ids("t", tok).alias("ids")).where("ids is not null")
    assert [r[0] for r in ids.select(E.decode("ids", tok)).collect()] == [tok.decode(r[0]) for r in ids.collect()]


def reference_chunks(tok, ids):
    done, out = 0, []
    for i in range(1, len(ids) + 1):
        text = X.printable(tok.decode(ids[:i])[done:])
        if text:
            out.append(text)
            done += len(text)
    rest = tok.decode(ids)[done:]
    return out + [rest] * bool(rest)


def test_stream_chunks_are_those_of_full_decodes(spark):
    r = random.Random(5)
    tok = toy.tokenizer()
    streams = {k: [r.randrange(len(tok.vocab)) for _ in range(r.randrange(30))] for k in range(40)}
    for ids in streams.values():
        assert list(X.decode_stream(tok, ids)) == reference_chunks(tok, ids)
    rows = [(k, p, i) for k, ids in streams.items() for p, i in enumerate(ids)]
    r.shuffle(rows)
    got = {}
    for x in X.stream_decode_batch(spark.createDataFrame(rows, "k int, p int, i int"), "k", "p", "i", tok).orderBy("key", "seq").collect():
        got.setdefault(x["key"], []).append(x["chunk"])
    assert {k: [c for c in v if c] for k, v in got.items()} == {k: reference_chunks(tok, v) for k, v in streams.items() if v}


def test_streaming_query(spark, tmp_path):
    tok = minimal()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [("a", i, x, i == 5) for i, x in enumerate([12, 13, 14, 14, 15, 5])]
    spark.createDataFrame(rows, "k string, p int, i int, e boolean").write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("k string, p int, i int, e boolean").parquet(f"{tmp_path}/in")
    query = X.stream_decode(source, "k", "p", "i", tok, "e").writeStream.format("memory").queryName("chunks").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    assert query.awaitTermination(120)
    assert "".join(r[0] for r in spark.table("chunks").orderBy("seq").select("chunk").collect()) == "hello world"
