"""BPE against the tokenizers library."""

import random

import pytest

from helixframe.llm import bpe as M

tokenizers = pytest.importorskip("tokenizers")


def texts():
    rnd = random.Random(3)
    out = [None, "", " \n\t ", "It's we'll I'D don't 'tis", "a" * 3000, "ΣΟΣ İstanbul Éé", "x<|endoftext|>y <|startoftext|>", "<|endoftext|", "日本語 12345 ½ ⅷ", "a\u0085b c​d\x1ce\x1ff　g", "!!!???###", "\0\0 a\0b", "zzzz 👩‍👩‍👧 \U0001f1e9\U0001f1ea"]
    letters = "abcdefghij klmno pqrs tuvwxyz ABC éüß '\".,!#\n0123 "
    out += ["".join(rnd.choices(letters, k=rnd.randint(1, 400))) for _ in range(200)]
    return out


def test_as_the_library(spark):
    lib = tokenizers.Tokenizer.from_file(M.default_path())
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, ids int")
    got = {r.doc_id: r for r in M.decode(M.encode(docs, M.default_path()), M.default_path()).collect()}
    for i, t in rows:
        want = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == want, t
        assert got[i].decoded == lib.decode(want, skip_special_tokens=False), t


def test_memo_is_bounded_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(M, "MEMO", 10)
    monkeypatch.setattr(M, "GROUP", 50)
    tok = M.Tokenizer(M.default_path())
    lib = tokenizers.Tokenizer.from_file(M.default_path())
    for t in texts()[13:60]:
        assert tok.encode([t])[0].tolist() == lib.encode(t, add_special_tokens=False).ids
    assert M.digests(spark.createDataFrame([], "doc_id long, text string"), M.default_path()).collect() == []
