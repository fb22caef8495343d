"""Encoding and decoding against the tokenizers library."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cueline.llm.bpe import Encoder, Vocabulary, bpe_decode, bpe_digests, bpe_encode, decode

PATH = public_tokenizers.path("word_bpe_49k.json")
CASES = [
    "", " ", "Hello world", "it's we'll I'd'd THEY'RE", "a" * 3000, "aaa aaaa aaaaa", "x\x1cy \x1f z\x85w\xa0q　r​s", "<|endoftext|>a<|startoftext|> <|ENDOFTEXT|><|end", "ΣΑΣ ΟΔΟΣ İstanbul ẞ ǅ", "é ́x ạ̇ Ω Å", "日本語 中文 한국어 ไทย हिन्दी",
    "½ ² Ⅷ ٣ 123 4.5e-6", "😀😀 👩‍👩‍👧 ❤️", "tab\tnew\nline\r\n\x0b\x0c", "password=\"A1b2\" ***### $$$ !!", "  ;`", "﻿bom  \U0010ffff",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_against_library(library):
    v = Vocabulary.load(PATH)
    rng = random.Random(7)
    letters = [*"abcdefgHIJKL 0123456789 .,!?'<|>-_\t\n", "é", "ß", "Ω", "я", "中", "😀", "́", "'s", "'LL", "<|endoftext|>", "the", "ing"]
    cases = CASES + ["".join(rng.choices(letters, k=rng.randrange(80))) for _ in range(3000)]
    cases += ["".join(chr(rng.choice([rng.randrange(1, 0x3000), rng.randrange(0xA000, 0xD7FF), rng.randrange(0xE000, 0x11000)])) for _ in range(20)) for _ in range(1500)]
    ids, starts = Encoder(v).encode(cases)
    for text, a, b in zip(cases, starts, starts[1:], strict=False):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids[a:b].tolist() == want, repr(text)
        assert decode(v, want) == library.decode(want, skip_special_tokens=False)


def test_rows(spark, library):
    rows = [(1, "Hello hello"), (2, None), (2, ""), (None, "it's"), (5, "word " * 20000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text AS ids", "1 AS n_tokens")
    got = {r.doc_id: r for r in bpe_digests(df, PATH).collect()}
    assert got[1].n_tokens == 2 and got[2].n_tokens == 0 and got[None].n_tokens == 2 and got[5].n_tokens == 20000
    assert len(bpe_digests(df, PATH).collect()) == 5
    assert bpe_digests(df.limit(0), PATH).count() == 0
    back = bpe_decode(bpe_encode(df.where("doc_id = 1"), PATH), PATH).first()
    assert back.decoded == "hello</w> hello</w>"
