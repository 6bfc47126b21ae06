"""A public vocabulary of 32,000 pieces against its own library, and the walk-through."""

import random
from dataclasses import replace

import pytest

from examples import golden, walkthrough
from wordloom.functions.textops import WIDE_SPACES
from wordloom.operators import encode as E
from wordloom.operators.tokenizer import Tokenizer
from wordloom.sources.model_file import parse_model


def begins_with_a_word(text):
    """The library puts a space in front of every text; the engine's rule leaves alone one that begins with white space."""
    return text[:1] not in WIDE_SPACES


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tok(path):
    with open(path, "rb") as f:
        return replace(Tokenizer.from_model(parse_model(f.read())), utf8_bytes=True)


def test_golden_encodings(path, tok):
    for record in golden.records(path):
        text = record["input"]
        if not begins_with_a_word(text) or "<s>" in text or "</s>" in text or "<unk>" in text:
            continue  # the library never reads control pieces from a text; here they are ordinary words of the vocabulary
        assert tok.ids(text) == record["ids"] and tok.tokenize(text) == record["tokens"], text
        assert tok.decode(record["ids"]) == record["decoded"], text


def test_random_texts(path, tok):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(11)
    alphabet = "the and of ing ab cde   \n\t.,;!0123 äöüéß 漢字 かな Привет 😀 ≠∑ ▁ "
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(0, 120))) for _ in range(500)]
    texts = list(filter(begins_with_a_word, texts))
    assert len(texts) > 300 and [tok.ids(t) for t in texts] == own.encode(texts)


def test_columns_of_a_large_vocabulary(spark, path, tok):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [*filter(begins_with_a_word, golden.TEXTS[:30]), "word " * 5000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", E.token_ids("t", tok, False).alias("ids"))
    got = {r["i"]: (list(r["ids"]), r["text"]) for r in rows.select("i", "ids", E.decode("ids", tok).alias("text")).collect()}
    assert [got[i][0] for i in range(len(texts))] == own.encode(texts) and [got[i][1] for i in range(len(texts))] == [own.decode(x) for x in own.encode(texts)]


def test_walkthrough(spark):
    steps = walkthrough.walk(spark)
    rows = {name: df.collect() for name, df in steps.items()}
    assert all(rows.values())
    assert [r["text"] for r in rows["decode"]] == ["the house and the tree", "a door", None]
    assert [r["piece"] for r in rows["added"]] == ["[NEW]"] and "".join(r["chunk"] for r in rows["stream"] if r["key"] == 2) == "a door"
