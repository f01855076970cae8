"""Reports over k-mers and indexes in many blocks, buckets and pieces, against counts in plain Python."""

import random
from collections import Counter

import pytest

from helixframe.functions import kmers
from helixframe.operators import index
from helixframe.plans import data

K = 7


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(kmers.pieces, "__defaults__", (300,))
    monkeypatch.setattr(index, "BLOCK", 250)
    monkeypatch.setattr(index, "BUCKET", 200)


def _contigs(spark):
    rnd = random.Random(4)
    words = ["".join(rnd.choices("ACGT", k=rnd.randrange(3, 9))) for _ in range(60)]
    rows = [(k, "".join(rnd.choices(words, k=n)) + "NN" + "".join(rnd.choices("ACGT", k=n))) for k, n in ((3, 300), (1, 20), (2, 0), (9, 700), (5, 90), (8, 2))]
    rows += [(11, None), (12, ""), (13, "ACG"), (14, "A" * 900)]
    return rows, spark.createDataFrame(rows, "contig_id long, sequence string")


def _places(rows):
    out = []
    for c, s in rows:
        s = s or ""
        for p in range(len(s) - K + 1):
            f = s[p : p + K]
            if "N" not in f:
                r = f.translate(str.maketrans("ACGT", "TGCA"))[::-1]
                out.append((min(f, r), c, p, r < f))
    return out


def test_reports_over_multiplicities(spark, small):
    rows, contigs = _contigs(spark)
    totals = Counter(x[0] for x in _places(rows))
    held = index.multiplicity(contigs, K)
    assert {r.total: r.seeds for r in held.collect()} == Counter(totals.values())
    built = index.build(contigs, K, 50)
    assert index.summary(contigs, held, K, 50).collect() == index.summary(contigs, built, K, 50).collect()
    assert sorted(index.cap_distribution(held, 4).collect()) == sorted(index.cap_distribution(built, 4).collect())
    kept = {r.policy: (r.hits, r.seeds, r.offsets) for r in index.kept_by_policy(held, ["first", "drop", "sample-spaced", "adaptive"], 4, 6, 9).collect()}
    for name in kept:
        each = []
        for n in totals.values():
            spaced = {i * n // 4 for i in range(4)}
            each.append([i for i in range(n) if n <= 4 or (name == "first" and i < 4) or (name == "sample-spaced" and i in spaced)
                         or (name == "adaptive" and (n <= 6 or n <= 9 and i in spaced))])
        assert kept[name] == (sum(map(len, each)), sum(map(bool, each)), sum(map(sum, each))), name


def test_index_in_small_buckets(spark, small):
    rows, contigs = _contigs(spark)
    places = {}
    for code, c, p, rc in _places(rows):
        places.setdefault(code, []).append((c, p, rc))
    got = index.build(contigs, K, 20).collect()
    assert len(got) == len(places)
    value = lambda f: sum("ACGT".index(b) * 4 ** (K - 1 - i) for i, b in enumerate(f))
    by = {value(f): sorted(v) for f, v in places.items()}
    for r in got:
        assert (r.total, r.capped, [tuple(h) for h in r.hits]) == (len(by[r.code]), len(by[r.code]) > 20, by[r.code][:20])


@pytest.mark.parametrize("cap", [1, 3, 8, 10_000])
def test_gaps_and_isolated_places_of_pieces(spark, small, cap):
    rows, contigs = _contigs(spark)
    places = _places(rows)
    totals = Counter(x[0] for x in places)
    rare = {}
    for code, c, p, _ in places:
        if totals[code] <= cap:
            rare.setdefault(c, []).append(p)
    gaps = Counter()
    for own in rare.values():
        for a, b in zip(own, own[1:], strict=False):
            gaps[next((e for e in (16, 32, 64, 128, 512, 2048, 16384) if b - a <= e), 2**63 - 1)] += 1
    assert {r.up_to: r.gaps for r in index.position_gaps(contigs, K, cap).collect()} == gaps
    for within in (2, 40):
        alone = Counter(c for code, c, p, _ in places if totals[code] > cap and not any(abs(q - p) <= within for q in rare.get(c, [])))
        assert {r.contig_id: r.hits for r in index.isolated(contigs, K, cap, within).collect()} == alone


def test_texts_become_bases_as_in_columns(spark, tmp_path):
    texts = ["Hello, World", "", None, "naïve Ünïcode ſ KK 漢字 1\n\tz", "\u0000a\U0001f600Z"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    want = {r.doc_id: r.s for r in docs.select("doc_id", data.bases(docs.text).alias("s")).collect()}
    assert {r.contig_id: r.sequence for r in data.contigs(spark, str(tmp_path)).collect()} == want


def test_places_of_wanted_kmers(spark, small, monkeypatch):
    rows, contigs = _contigs(spark)
    value = lambda f: sum("ACGT".index(b) * 4 ** (K - 1 - i) for i, b in enumerate(f))
    every = sorted((c, p, value(f), rc) for f, c, p, rc in _places(rows))
    codes = sorted({x[2] for x in every})[::7]
    wanted = spark.createDataFrame([(c,) for c in [*codes, codes[0], -1, 4**K + 5]], "code long")
    for most in (500_000, 3):
        monkeypatch.setattr(index, "WANTED", most)
        got = index.places_of(contigs, K, wanted).select("contig_id", "ref_pos", "code", "is_rc").collect()
        assert sorted(map(tuple, got)) == [x for x in every if x[2] in set(codes)]
