"""Writes golden encodings: what the public library of a vocabulary says of a list of texts, one JSON record a line.

    python examples/golden.py piece_bpe_32k.model golden.jsonl

A record holds the input, the ids, the tokens and the decoded text.  The tests hold the engine against such records.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

# Kinds of text that tokenizers are known to differ on.
TEXTS = (
    "", " ", "   ", "\t", "\n", "Hello, world!", "hello world", "Hello  World   again", " leading", "trailing ", "The quick brown fox jumps over the lazy dog.",
    "unbelievable internationalization antidisestablishmentarianism", "1234567890", "3.14159 2,718", "a" * 50, "!!!???...", "user@example.org https://example.org/a/b?c=d#e", "def f(x):\n    return x ** 2  # square\n",
    "Crème brûlée à la française", "Straße über Äpfel", "¿Qué tal, señor?", "日本語のテキスト", "中文分词测试", "한국어 문장", "Привет, мир", "שלום עולם", "😀 emoji 👩‍💻 join", "mixed 日本 and English 混合", "tab\tseparated\tvalues", "line one\nline two\r\nline three",
    "non breaking", "zero​width", "em—dash en–dash", "▁literal mark", "<s> </s> <unk>", "x" * 300, "word " * 200,
)


def records(path: str, texts=TEXTS) -> Iterator[dict]:
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)
    for text in texts:
        ids = own.encode(text)
        yield {"input": text, "ids": ids, "tokens": [own.id_to_piece(i) for i in ids], "decoded": own.decode(ids)}


def main(name: str, out: str) -> None:
    import public_tokenizers

    with open(out, "w", encoding="utf-8") as f:
        for record in records(public_tokenizers.path(name)):
            f.write(json.dumps(record, ensure_ascii=False) + "\n")


if __name__ == "__main__":
    main(*sys.argv[1:])
