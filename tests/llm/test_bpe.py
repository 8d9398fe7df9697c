"""BPE against the tokenizers library, with whole texts and with texts cut into very short leaves."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from lexmill.llm import bpe
from lexmill.llm.queries import vocabulary

tokenizers = pytest.importorskip("tokenizers")
PATH = vocabulary("word_bpe_49k.json")
PIECES = ["a", "b", "the ", "ing", "é", "é", " ", "\n", "'s", "'ll", "'re", "!!!", "123", "中文", "漢字", "ΑΣ", "ς", "İ", "ß", "ﬁ",
          " ", "\x85", "\x1c", "\x00", "🙂", "👍🏽", "<|endoftext|>", "<|start", "oftext|>", "‍", "²", "ª", "_", "क्षि"]


@pytest.fixture(scope="module")
def library():
    found = tokenizers.Tokenizer.from_file(PATH)
    found.no_truncation()
    found.no_padding()
    return found


def in_leaves(code: bpe.Codec, text: str, limit: int) -> list[int]:
    ids: list[int] = []
    for section, special in code.sections(text):
        if special:
            ids.append(code.special[section])
            continue
        leaves = []
        for leaf in bpe.halved(section, limit):
            words, steps = code.cut_with_steps(leaf)
            parts = [list(map(int, code.numbers[w].split())) for w in words]
            leaves.append(bpe.Stretch(code, leaf, np.cumsum(np.array(steps, "int64")), np.array([len(p) for p in parts], "int64"),
                                      np.array([i for p in parts for i in p], "int64")))
        ids += bpe.fold(leaves).ids.tolist()
    return ids


def test_random_texts(library, monkeypatch):
    rng, code = random.Random(3), bpe.Codec(PATH)
    for _ in range(1500):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60)))
        monkeypatch.setattr(bpe, "LEAF_SYMBOLS", rng.choice([2, 4, 8, 256]))
        code.numbers.clear()
        assert in_leaves(code, text, rng.choice([3, 7, 20])) == library.encode(text, add_special_tokens=False).ids, text


def test_long_text_without_a_cut(library, monkeypatch):
    rng, code = random.Random(5), bpe.Codec(PATH)
    for k in range(40):
        text = "".join(rng.choice(["in", "th", "an", "re", "he", "e", "t", "ü", "q"]) for _ in range(rng.randint(100, 1500)))
        monkeypatch.setattr(bpe, "LEAF_SYMBOLS", rng.choice([2, 8, 32, 256]))
        code.numbers.clear()
        assert in_leaves(code, text, 50) == code.piece(text) == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("part_chars", [bpe.PART_CHARS, 40])
def test_rows_on_spark(spark, library, part_chars):
    texts = [None, "", " ", "Hello  World", "Hello  World", "naïve ΑΣ İstanbul <|endoftext|> it's 42", "x" * 3000, "ab c" * 6000, "日本語" * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS row_no", "2 AS ids", "true AS special")
    got = {r.doc_id: r for r in bpe.encode(docs, PATH, part_chars=part_chars).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), sha(" ".join(map(str, ids))))
        assert got[i].decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False))


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
