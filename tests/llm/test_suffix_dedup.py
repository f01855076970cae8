"""Suffix-array dedup against a dictionary of all 100-byte strings."""

import hashlib
import random

from helixframe.llm import suffix_dedup as M

SCHEMA = "doc_id long, text string, n_removed string"


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    return [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in M.suffix_dedup(docs).collect()]


def test_as_brute_force(spark):
    rnd = random.Random(5)
    words = ["the", "of", "tion", "é", "ü", "a", "re", "\n", "1"]
    text = lambda n: " ".join("".join(rnd.choices(words, k=rnd.randint(1, 4))) for _ in range(n))
    shared = [text(30) for _ in range(4)]
    rows = []
    for i in range(80):
        t = text(rnd.randint(0, 60)) + rnd.choice(shared) + text(rnd.randint(0, 60)) + rnd.choice(shared)[:120]
        rows.append((i, t if rnd.random() < 0.9 else rows[rnd.randrange(len(rows))][1] if rows else t))
    rows += [(100, None), (101, ""), (102, "a" * 5000), (103, "a" * 99), (104, "a" * 100), (-5, shared[0] * 3)]
    got = {r[0]: r[1:] for r in run(spark, rows)}
    assert got == M.brute_force([(i, (t or "").encode()) for i, t in rows])


def test_hot_prefix_is_dealt_out_by_window(spark, monkeypatch):
    rnd = random.Random(9)
    rows = [(i, "".join(rnd.choices("ab", k=60)) + "zzzzzzzzzz0123456789qwertyuiop" + "".join(rnd.choices("ab", k=4)) * 20) for i in range(300)]
    monkeypatch.setattr(M, "HOT", 1 / 100000)
    got = {r[0]: r[1:] for r in run(spark, rows)}
    assert got == M.brute_force([(i, t.encode()) for i, t in rows])


def test_repeated_rows_null_ids_and_no_rows(spark):
    t = "".join(random.Random(1).choices("abcdefgh ", k=300))
    got = run(spark, [(7, t), (7, t), (None, t), (9, None), (None, None)])
    assert sorted((r[0] is None, r[0], r[2]) for r in got if r[1]) == [(False, 7, 0), (False, 7, 0), (True, None, 300)]
    assert run(spark, []) == []


def test_texts_longer_than_a_piece(spark, monkeypatch):
    monkeypatch.setattr(M, "PIECE", 500)
    monkeypatch.setattr(M, "BLOCK", 300)
    rnd = random.Random(3)
    rows = [(i, "".join(rnd.choices("abcd", k=2000))) for i in range(4)]
    rows.append((9, rows[1][1][100:1700] + "x" + rows[2][1]))
    got = {r[0]: r[1:] for r in run(spark, rows)}
    assert got == M.brute_force([(i, t.encode()) for i, t in rows])
