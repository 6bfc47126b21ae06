"""Batches go through workers by bytes, and what is counted or cut ahead agrees with what is made."""

import random

import pyarrow as pa
import pytest

from tests.test_engine import minimal
from wordloom.functions import slices, textops
from wordloom.model import LONGEST_FIRST, ONLY_FIRST, AddedToken
from wordloom.operators import encode as E
from wordloom.plans import toy
from wordloom.sources.charsmap import Charsmap
from wordloom.operators.tokenizer import Tokenizer, align


def test_a_batch_is_cut_by_bytes():
    texts = ["x" * n for n in (10, 0, 500, 20, 5, 70)] + [None, "é" * 40]
    parts = [p.to_pylist() for (p,) in slices.cut((pa.array(texts),), 100)]
    assert parts == [texts[:2], texts[2:3], texts[3:5], texts[5:7], texts[7:]]
    assert list(slices.cut((pa.array([], pa.string()),))) == []
    lists = pa.array([[1] * 50, [], None, [2] * 3, [3]], pa.list_(pa.int32()))
    assert [p.to_pylist() for (p,) in slices.cut((lists.slice(1),), 32)] == [[[], None], [[2] * 3], [[3]]]


@pytest.mark.parametrize("pair", [False, True])
def test_each_slice_is_a_batch_of_its_own(spark, pair):
    seen = []

    def of(*columns):
        seen.append(sum(len(x or "") for c in columns for x in c.to_pylist()))
        return columns[0]

    texts = pa.array(["word " * 200] * 3000)
    made = slices.sliced_pair("string", of) if pair else slices.sliced("string", of)
    out = list(made.func(iter([(texts, texts) if pair else texts])))
    assert len(out) == len(seen) > 10 and max(seen) <= slices.SLICE_BYTES
    assert pa.concat_arrays(out) == texts


def test_columns_over_many_slices(spark):
    rng = random.Random(5)
    texts = [None if i % 50 == 0 else " ".join(rng.choice(("the", "ä,", "hand", "", "über")) for _ in range(rng.randint(0, 400))) for i in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    tok, mapped = toy.tokenizer(), Charsmap.build({"ä": "ae", "the": "THE", "th": "TH"})
    got = df.select("i", E.encode("t", tok).alias("e"), E.encode_pair("t", "t", tok).alias("p"), E.token_ids("t", tok).alias("ids"), textops.charsmap_column(df["t"], mapped.to_bytes()).alias("m")).collect()
    for r in got:
        t = texts[r["i"]]
        if t is None:
            assert r["e"] is r["p"] is r["ids"] is r["m"] is None
            continue
        want = tok.encode(t)
        assert r["ids"] == want.ids == r["e"]["ids"] and [tuple(o) for o in r["e"]["offsets"]] == want.offsets and r["e"]["word_ids"] == want.word_ids
        assert r["p"]["tokens"] == tok.encode_pair(t, t).tokens and r["m"] == mapped.normalize(t)


@pytest.mark.parametrize("options", [{}, {"max_length": 9}, {"max_length": 2}, {"max_length": 7, "strategy": ONLY_FIRST}, {"add_special": False}, {"max_length": 8, "strategy": LONGEST_FIRST, "add_special": False}])
def test_the_length_of_a_pair_is_counted(options):
    for tok in (toy.tokenizer(), toy.tokenizer().with_truncation(11)):
        for a, b in (("the hand", "of"), ("", ""), ("a b c d e f g h", "in the sea of the hand"), ("x", "über")):
            assert tok.pair_length(a, b, **options) == len(tok.finish_pair(tok.bare_pair(a, b, **options)))


def test_tokens_are_those_of_rows():
    tok = minimal()
    vocab = tok.vocab.add_at(len(tok.vocab), "<b>")
    added = Tokenizer(vocab, tok.normalizer, added_tokens=(AddedToken(len(tok.vocab), "<b>", normalized=False),))
    assert added._chunks_cut_at_marks == tok.cuts_at_marks and not added.cuts_at_marks
    for own in (tok, added, toy.tokenizer(), toy.bytes_tokenizer(), toy.bpe()):
        for t in ("", " ", "<b>", "hello<b> world <b><b>the", "a▁b", "  hello  <b> \n"):
            assert own.tokens(t) == [r[1] for r in own.rows(t)] and own.ids(t) == [r[0] for r in own.rows(t)]


def test_ids_of_tokens_with_nulls(spark):
    tok = toy.tokenizer()
    rows = [(0, ["the", None, "no such", "th"]), (1, None), (2, []), (3, ["e"])]
    df = spark.createDataFrame(rows, "i int, t array<string>").coalesce(1)
    got = {r["i"]: r["ids"] for r in df.select("i", E.tokens_to_ids("t", tok).alias("ids")).collect()}
    assert got == {i: None if t is None else [tok.vocab.piece_to_id(x) for x in t] for i, t in rows}


def test_rows_segment_each_word_once():
    """Ids of rows are those of whole texts, spans those of all characters, and a repeated word is not segmented again."""
    tok, rng, calls = toy.tokenizer(), random.Random(9), []
    words = ("the", "hand", "über", "x.", "漢", "　", "", "\t", "▁", "Ａb", "‍")
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    for t in texts:
        normal = tok._normal.normalize(t)
        rows = tok.rows(t)
        assert [r[0] for r in rows] == tok.segmenter.tokenize(normal)
        spans, at = align(t, normal), 0
        assert [s for s in spans if s] == sorted(s for s in spans if s)
        for i, token, span, _ in rows:
            n = len(token) if normal.startswith(token, at) else 1
            own = [s for s in spans[at : at + n] if s]
            assert span == ((min(s for s, _ in own), max(e for _, e in own)) if own else (0, 0))
            at += n
    tok = toy.tokenizer()
    plain = tok._word_segmenter.tokenize
    tok._word_segmenter.tokenize = lambda part: calls.append(part) or plain(part)
    tok.rows("the hand of the hand " * 50)
    assert sorted(calls) == sorted({"▁the", "▁hand", "▁of"})
