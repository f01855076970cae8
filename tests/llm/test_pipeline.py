"""The pipeline's stages against brute-force versions of each, on a small table."""

import random

import pytest

from helixframe.llm import bpe, suffix_dedup

from .test_operators import brute_links, edited, text

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    rnd = random.Random(21)
    items = [(k, text(rnd, 25)) for k in range(6)]
    passage = text(rnd, 60)
    rows = []
    for i in range(60):
        t = text(rnd, 90)
        if i % 10 == 1:
            t = edited(rnd, rows[-1][1], 1)
        if i % 10 == 3:
            t += " " + passage
        if i % 10 == 5:
            t += " " + items[i // 10][1] + " " + text(rnd, 10)
        if i % 10 == 7:
            t = text(rnd, 10)
        if i % 10 == 9:
            t = " ".join(w + "$$$" for w in t.split(" "))
        rows.append((i, t))
    rows.append((60, None))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    labels = [(i, int(i % 10 != 9), 0) for i, _ in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        seen.append((docs, out))
        if name != pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs = out
    table = lambda df: {r.doc_id: r.text for r in df.collect()}
    a, b = map(table, seen[0])
    assert set(a) - set(b) == {i for i, t in rows if t is None or i % 10 in (7, 9)}
    a, b = map(table, seen[1])
    assert set(b) == {i for i, (c, _) in brute_links(list(a.items())).items() if c == i} and len(b) < len(a)
    a, b = map(table, seen[2])
    want = suffix_dedup.brute_force([(i, t.encode()) for i, t in a.items()])
    assert set(a) == set(b) and sum(len(t.encode()) for t in b.values()) <= sum(v[0] - v[1] for v in want.values())
    assert all(b[i] == a[i] for i in a if want[i][1] == 0)
    a, b = map(table, seen[3])
    assert set(a) - set(b) == {i for i, t in a.items() if i % 10 == 5}
    kept = table(seen[4][0])
    tok = bpe.Tokenizer(bpe.default_path())
    assert {r.doc_id: r.ids for r in seen[4][1].collect()} == {i: tok.encode([t])[0].tolist() for i, t in kept.items()}
    whole = pipeline.run(spark, str(tmp_path))
    assert sorted(r.doc_id for r in whole.collect()) == sorted(kept)


def test_stages_on_odd_tables(spark, tmp_path):
    """Null ids and texts, repeated rows, very long texts, columns that clash with the operators' own; and no rows at all."""
    rnd = random.Random(22)
    long = text(rnd, 30_000)
    clean = [text(rnd, 90) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(clean)] + [(3, clean[3]), (3, clean[3]), (None, clean[4]), (None, None), (50, None), (51, ""), (52, long), (53, long + " " + text(rnd, 5)), (5, text(rnd, 80))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, did string, crc int, windows string, th string, k1 string, row string, removed int, uid int"
    full = [(i, t, "en", "s", len(t or ""), "d", 1, "w", "t", "k", "r", 2, 3) for i, t in rows]
    items = [(1, text(rnd, 20)), (None, clean[1]), (2, None), (2, clean[0][:200])]
    for name, some in (("odd", full), ("none", [])):
        spark.createDataFrame(some, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(items if some else [], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        spark.createDataFrame([(0, 1, 0), (None, 0, 1), (3, None, 0), (3, 1, 0)] if some else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        count = {}
        for k, (stage, step) in enumerate(pipeline.STAGES):
            out = step(spark, docs, f"{tmp_path}/{name}")
            out.write.parquet(f"{tmp_path}/{name}/{k}")
            out = spark.read.schema(out.schema).parquet(f"{tmp_path}/{name}/{k}")
            assert k == 4 or out.columns == docs.columns
            docs, count[stage] = out, out.count()
        if not some:
            assert set(count.values()) == {0}
            continue
        assert count["quality rules"] == len(rows) - 3  # two nulls and an empty text have no words
        # the near copies of the long text and of a row without an id: 53 goes, rows without an id take no part
        assert count["n-gram Jaccard join"] == count["quality rules"] - 1 == count["suffix-array dedup"]
        assert count["benchmark decontamination"] == count["suffix-array dedup"] - 1 == count["BPE encoding"]
        assert {r.doc_id for r in docs.collect()} == {*range(1, 12), 52, None}
    bare = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    assert pipeline.STAGES[4][1](spark, bare, "").columns == ["doc_id", "n_tokens", "ids"]
