"""Cases that single operators once got wrong, and brute-force versions of the results that SQL cannot express."""

import collections
import html.parser
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from helixframe.llm import common as C
from helixframe.llm import bpe, components, ctw, decontam, html_extract, jaccard, quality, sharding, substring_dedup, suffix_dedup, url_filter

from .test_operators import EDGES, brute_links, frame, text

# -- repeated ids, reopened indexes, written shards ---------------------------------------------


def test_texts_under_one_id_keep_their_bytes(spark):
    rnd = random.Random(41)
    shared = text(rnd, 80)
    rows = [(1, "aaa " + shared), (1, "bbbb " + shared), (2, shared), (1, "aaa " + shared), (0, "c" * 50)]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.suffix_dedup(frame(spark, rows)).collect())
    n = len(shared.encode())
    assert got == [(0, 50, 0), (1, n + 4, 0), (1, n + 4, 0), (1, n + 5, 0), (2, n, n)]
    inside = "xyz" * 200  # repeats itself: the same document, an earlier start
    [r] = suffix_dedup.suffix_dedup(frame(spark, [(7, inside)])).collect()
    assert (r.n_removed, r.n_spans) == suffix_dedup.brute_force([(7, inside.encode())])[7][1:3]


def test_index_is_reopened(spark):
    rnd = random.Random(42)
    rows = [(i, text(rnd, 60)) for i in range(20)] + [(50 + i, text(rnd, 5)) for i in range(3)]
    rows += [(100 + i, text(rnd, 5) + " " + rows[i][1] + " " + text(rnd, 4)) for i in range(12)]
    slim = lambda part: frame(spark, part).select("doc_id", "text")
    first = substring_dedup.FingerprintIndex(spark)
    parts = first.add(slim(rows[:10])).unionByName(first.add(slim(rows[10:23])))
    for name, _ in first.runs:  # another session does not know the tables
        spark.sql(f"drop table {name}")
    again = substring_dedup.FingerprintIndex(spark, first.path, buckets=99)
    assert again.runs == first.runs and again.buckets == first.buckets and list(again.hot) == list(first.hot)
    parts = parts.unionByName(again.add(slim(rows[23:])))
    gone = collections.defaultdict(set)
    for r in substring_dedup.resolve(slim(rows), parts).collect():
        gone[r.did] |= set(range(r["first"], r["first"] + r["count"]))
    want = substring_dedup.brute_force(rows)
    assert {i: len(gone[i]) for i, _ in rows} == {i: n for i, (_, n, _) in want.items()} and sum(map(len, gone.values()))


def test_links_of_texts_that_share_an_id(spark, monkeypatch):
    rnd = random.Random(43)
    x, y = text(rnd, 60), text(rnd, 60)
    rows = [(1, x), (1, y), (2, x + " more"), (3, y + " more"), (4, text(rnd, 30)), (4, None)]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.jaccard_join(frame(spark, rows)).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 4, 0), (4, 4, 0)]
    kept = sorted((r.doc_id, r.text or "") for r in jaccard.one_of_each(frame(spark, rows)).collect())
    assert kept == sorted([(1, x), (1, y), (4, rows[4][1]), (4, "")])


def test_hot_hubs_buckets_and_clusters(spark, monkeypatch):
    """Every key that repeats is hot, buckets and clusters are many blocks: the same links."""
    monkeypatch.setattr(C, "hot_limit", lambda total: 1)
    monkeypatch.setattr(components, "SMALL", 0)
    monkeypatch.setattr(jaccard, "BUCKET", 3)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rnd = random.Random(44)
    base = [text(rnd, 90).split(" ") for _ in range(2)]
    rows = []
    for i in range(30):
        w = list(base[i % 2])
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = text(rnd, 1)
        rows.append((i, " ".join(w)))
    rows += [(90 + i, rows[0][1]) for i in range(4)] + [e for e in EDGES if e[0] is not None]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.jaccard_join(frame(spark, rows)).collect()}
    assert got == brute_links(rows)
    star = [(0, k) for k in range(1, 40)] + [(k, k + 100) for k in range(1, 40)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(star, "a long, b long")).collect()}
    assert set(found.values()) == {0} and len(found) == 79


def test_components_say_when_rounds_are_too_few(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long").repartition(7)
    with pytest.raises(RuntimeError):
        components.components(path, rounds=1)
    assert {r.root for r in components.components(path).collect()} == {0}


def test_written_shards_hold_every_row_once(spark, tmp_path):
    rnd = random.Random(45)
    rows = [(i % 20, text(rnd, rnd.randint(1, 40))) for i in range(40)] + [(None, "no id"), (None, None), (3, ""), (3, ""), *[(9, "z" * 400)] * 5]
    docs = frame(spark, rows)
    sharding.write_shards(docs, str(tmp_path / "out"), limit=900)
    back = spark.read.schema("doc_id long, text string, did string, n_chars int, shard string, volume long").parquet(str(tmp_path / "out"))
    assert sorted(map(repr, (tuple(r)[:4] for r in back.collect()))) == sorted(map(repr, (tuple(r) for r in docs.collect())))
    weights = collections.Counter()
    for r in back.collect():
        weights[(r.shard, r.volume)] += len((r.text or "").encode()) + sharding.ROW_BYTES
    assert len(weights) > 3 and max(weights.values()) <= 900
    with pytest.raises(ValueError):
        sharding.write_shards(docs.withColumn("Shard", F.lit(1)), str(tmp_path / "no"))


# -- context-tree weighting ----------------------------------------------------------------------


def brute_ctw(train, texts):
    """log10 probabilities by dictionaries of all contexts, as the definition says."""
    deep = ctw.DEPTH

    def coded(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        return "".join(x + " " for x in w).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode() + b"\0"

    def decisions(data):
        for k, byte in enumerate(data):
            past = bytes(deep) + data[:k]
            for b in range(8):
                yield [(past[len(past) - d :] if d else b"", (byte | 256) >> (8 - b)) for d in range(deep + 1)], byte >> (7 - b) & 1

    counts = collections.defaultdict(lambda: [0, 0])
    kids = collections.defaultdict(set)
    for t in train:
        for nodes, bit in decisions(coded(t)):
            for d, x in enumerate(nodes):
                counts[x][bit] += 1
                if d:
                    kids[nodes[d - 1]].add(x)

    def kt(x):
        a, b = counts[x]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    weighted, stop = {}, {}
    for x in sorted(counts, key=lambda x: -len(x[0])):
        if len(x[0]) == deep:
            weighted[x], stop[x] = kt(x), 1.0
        else:
            below = sum(weighted[y] for y in kids[x])
            weighted[x] = float(np.logaddexp(kt(x), below)) - math.log(2)
            stop[x] = math.exp(kt(x) - math.log(2) - weighted[x])

    def probability(nodes, bit):
        if not nodes or nodes[0] not in counts:
            return None
        own = (counts[nodes[0]][bit] + 0.5) / (sum(counts[nodes[0]]) + 1)
        deeper = probability(nodes[1:], bit)
        return own if deeper is None else stop[nodes[0]] * own + (1 - stop[nodes[0]]) * deeper

    return [sum(math.log10(probability(nodes, bit) or 0.5) for nodes, bit in decisions(coded(t))) for t in texts]


def test_score_is_that_of_the_whole_tree(spark):
    rnd = random.Random(46)
    rows = [(i, text(rnd, rnd.randint(0, 12))) for i in range(25)] + [(40, None), (41, ""), (42, "The THE the \x07 é"), (43, rnd.choice("ab") * 300), (44, rows_[0] if (rows_ := ["Some more"]) else "")]
    docs = frame(spark, rows)
    got = {r.doc_id: r for r in ctw.score(docs, ctw.train(docs.where(~ctw.held_out()))).collect()}
    want = brute_ctw([t for i, t in rows if not got[i].held_out], [t for _, t in rows])
    for (i, _), x in zip(rows, want, strict=True):
        assert got[i].score == pytest.approx(x, rel=1e-5)


def test_what_was_seen_never_has_probability_zero():
    """A context seen 2**26 times with one byte and once with another: no estimate is rounded to one."""
    grams = np.array([0x6161616161_61, 0x6161616161_62], np.uint64)
    tree = ctw.grow(grams, np.array([1 << 26, 1]))
    got = ctw.log10_probability(tree, np.concatenate([grams, [np.uint64(0x6161616161_FF)]]))
    assert np.isfinite(got).all() and got[0] > -0.01 and -10 < got[1] < -5


# -- quality -------------------------------------------------------------------------------------


def labelled(rnd, n):
    rows, labels = [], []
    for i in range(n):
        bad, toxic = i % 5 == 0, i % 4 == 1
        w = text(rnd, 70).split(" ")
        if toxic:
            w[rnd.randrange(60)] = rnd.choice(["stupidheads", "stupidly", "moronic"])
        rows.append((i, " ".join(x.upper() + "!!" if bad else x for x in w)))
        labels.append((i, int(not bad), int(toxic)))
    return rows, labels


def test_fit_is_that_of_plain_numpy(spark):
    """The executors' counts and packed entries against one dense fit of the same rows."""
    rows, labels = labelled(random.Random(47), 150)
    model = quality.train(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    order = [r.doc_id for r in spark.createDataFrame(labels, "doc_id long, quality int, toxic int").orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    texts, of = dict(rows), {i: (q, t) for i, q, t in labels}
    buf, offs = C.flat(pa.array([texts[i] for i in order]))
    f, tokens = quality.features(buf, offs)
    held = np.arange(len(order)) % 5 == 4
    for k, (head, slots, (row, slot, value)) in enumerate(((model.quality, quality.SLOTS, f), (model.toxic, quality.TOXIC_SLOTS, quality.present(tokens)))):
        x = np.zeros((len(order), slots), np.float32)
        np.add.at(x, (row, slot), value)
        y = np.array([of[i][k] for i in order])
        has = x[~held] > 0
        found = quality.Found(has[y[~held] == 1].sum(0), has[y[~held] == 0].sum(0), int((y[~held] == 1).sum()), int((y[~held] == 0).sum()))
        good = found.good()
        odds = np.log((found.yes + 0.5) / (found.ny + 1)) - np.log((found.no + 0.5) / (found.nn + 1))
        z = (x * odds)[:, good]
        weight = np.where(held, 0, np.where(y == 1, 0.5 / found.ny, 0.5 / found.nn))
        w, b, g2, b2 = np.zeros(z.shape[1]), 0.0, np.full(z.shape[1], 1e-8), 1e-8
        for _ in range(40):
            miss = (quality.sigmoid(z @ w + b) - y) * weight
            g, gb = z.T @ miss + 1e-5 * w, miss.sum()
            g2, b2 = g2 + g * g, b2 + gb * gb
            w, b = w - 0.2 * g / np.sqrt(g2), b - 0.2 * gb / np.sqrt(b2)
        score = z @ w + b
        slope, shift = quality.platt(score[held], y[held])
        mine = head.probability((row, slot, value), len(order))
        assert np.allclose(mine, quality.sigmoid(slope * score + shift), atol=2e-3)
        assert np.mean((mine >= 0.5) == (y == 1)) > 0.9


def test_word_pairs_are_features():
    """Texts of the same words in another order differ in their pairs only."""
    a, b = ("alpha beta gamma delta", "gamma alpha delta beta")
    slots = []
    for t in (a, b):
        _, (_, h) = quality.features(*C.flat(pa.array([t])))
        slots.append(set(h.tolist()))
    assert len(slots[0] - slots[1]) == 3 and len(slots[0] & slots[1]) > 4


def test_calibration_is_finite_and_says_when_there_is_nothing():
    rnd = np.random.default_rng(48)
    y = (np.arange(400) % 2).astype(int)
    slope, shift = quality.platt(np.where(y == 1, 500.0, -500.0) + rnd.normal(size=400), y)  # far apart
    p = quality.sigmoid(slope * np.array([-500.0, 500.0]) + shift)
    assert p[0] < 0.01 and p[1] > 0.99 and np.isfinite([slope, shift]).all()
    score = rnd.normal(size=4000) + 0.8 * (np.arange(4000) % 2)
    slope, shift = quality.platt(score, np.arange(4000) % 2)
    got = quality.sigmoid(slope * score + shift)
    for low in (0.2, 0.4, 0.6):  # probabilities are shares
        own = (got >= low) & (got < low + 0.2)
        assert abs(np.mean((np.arange(4000) % 2)[own]) - np.mean(got[own])) < 0.06
    label = np.arange(100) % 2
    held = np.arange(100) >= 60
    row = np.flatnonzero((label == 1) != held)  # the slot says 1 in fitted rows, and 0 in held ones
    found = quality.Found(np.array([30]), np.array([0]), 30, 30)
    with pytest.warns(UserWarning, match="learnt nothing"):
        head = quality.fit((row, np.zeros(len(row), int), np.ones(len(row), np.float32)), found, label, held, 1, "quality")
    assert head.probability((np.array([0]), np.array([0]), np.array([1.0])), 1) == pytest.approx(0.5)


# -- decontamination -----------------------------------------------------------------------------


def brute_template(t):
    """(token, value, kind) of each word of an ASCII text."""
    out, before, last_number = [], None, False
    for m in re.finditer(r"[^\x20\x09-\x0D]+", t or ""):
        w = m.group()
        starts = before is None or before.group()[-1] in ".!?:" or "\n" in t[before.end() : m.start()]
        before = m
        core = re.sub(r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "", w)
        if not core:
            continue
        low, digits, capitals = core.lower(), sum(c.isdigit() for c in core), sum(c.isupper() for c in core)
        number = core[0].isdigit() or digits > 0 and len(core) <= digits + 2 or low in decontam.NUMBERS
        name = core[0].isupper() and capitals == 1 and not starts and not number
        kind = 1 if number else 3 if last_number and low in decontam.UNITS else 2 if name else 0
        last_number = number
        out.append(((0, low) if kind == 0 else (kind, ""), low, kind))
    return out


def brute_items(doc, items):
    d = brute_template(doc)
    found, changed = [], []
    for item, t in items:
        b = brute_template(t)
        n = min(8, len(b))
        places = [j for j in range(len(b) - n + 1) if n >= 5 and sum(x[2] == 0 for x in b[j : j + n]) >= min(4, n // 2)]
        part = 0 if places else 1
        places = places or list(range(len(b) - n + 1)) if n else []
        pairs = [(i, j) for j in places for i in range(len(d) - n + 1) if [x[part] for x in d[i : i + n]] == [x[part] for x in b[j : j + n]] and (part or sum(x[2] == 0 for x in d[i : i + n]) >= min(4, n // 2))]
        covered, differs = set(), False
        for shift in {i - j for i, j in pairs}:
            own = sorted(p for p in pairs if p[0] - p[1] == shift)
            slots = collections.defaultdict(lambda: collections.defaultdict(set))
            for k, (i, j) in enumerate(own):
                for e in range(n):
                    if d[i + e][2]:
                        slots[(d[i + e][2], b[j + e][1])][d[i + e][1]].add(k)
            gone = set()
            for values in slots.values():
                best = max(values, key=lambda v: len(values[v]))
                gone |= {k for v, ks in values.items() if v != best for k in ks}
            for k, (i, j) in enumerate(own):
                if k not in gone:
                    covered.add(j)
                    differs |= [x[1] for x in d[i : i + n]] != [x[1] for x in b[j : j + n]]
        if places and 2 * len(covered) >= len(places):
            found.append(item)
            if differs:
                changed.append(item)
    return found, changed


def test_decontamination_by_brute_force(spark):
    rnd = random.Random(49)
    words = "train leaves town miles while counts apples basket river buys rice costs total many does how much when after before under".split()
    filled = lambda t: re.sub(r"\{(\w)\}", lambda m: rnd.choice({"n": ["5", "17", "three", "120", "2.5"], "p": ["Boston", "Mary", "Denver", "Tom"], "u": ["kg", "miles", "euros", "days"]}[m[1]]), t)
    templates = []
    for _ in range(8):
        w = [rnd.choice(words) for _ in range(rnd.randint(3, 22))]
        for _ in range(len(w) // 4):
            w[rnd.randrange(1, len(w))] = rnd.choice(["{n} {u}", "{n}", "{p}", "{p}"])
        templates.append(" ".join(w))
    items = [(i, filled(t)) for i, t in enumerate(templates)] + [(20, "12 44 9 3"), (21, "red kite"), (22, "")]
    docs = []
    for k in range(60):
        body = [rnd.choice(words) for _ in range(rnd.randint(0, 15))]
        t = rnd.choice(templates)
        middle = rnd.choice([filled(t), rnd.choice(items)[1], filled(t)[: rnd.randint(0, 90)], ""])
        docs.append((k, (" ".join(body) + rnd.choice([". ", " ", "\n"]) + middle + " " + " ".join(body[::-1])).replace(" apples", rnd.choice([" apples", ", apples"]))))
    got = {r.doc_id: (r["items"], r.changed_items) for r in decontam.decontaminate(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {i: brute_items(t, items) for i, t in docs}
    assert got == want and sum(bool(f) for f, _ in want.values()) > 15 and any(c for _, c in want.values())


# -- site style trees ----------------------------------------------------------------------------


class Dom(html.parser.HTMLParser):
    """Well-formed pages only: (path of labels, its path's parent) and own text of each element."""

    def __init__(self):
        super().__init__()
        self.stack, self.elements = [], [((), [], [])]  # path, labels of children, blocks

        self.stack.append(self.elements[0])

    def handle_starttag(self, tag, attrs):
        label = tag + "".join("." + re.sub("[0-9]", "", v) for k, v in attrs if k == "class")
        path, kids, _ = self.stack[-1]
        if not kids or kids[-1] != label:
            kids.append(label)
        self.elements.append(((*path, label), [], []))
        self.stack.append(self.elements[-1])

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        if data.strip():
            self.stack[-1][2].append(" ".join(data.split()))


def brute_tree(pages):
    """The text of each page of one host, by the definitions."""
    doms = []
    for p in pages:
        d = Dom()
        d.feed(p)
        doms.append(d)
    m = len(pages)
    on = collections.defaultdict(set)
    styles, words, repeated = collections.defaultdict(collections.Counter), collections.defaultdict(lambda: collections.defaultdict(set)), collections.defaultdict(set)
    holds = set()
    for k, d in enumerate(doms):
        for path, kids, blocks in d.elements:
            on[path].add(k)
            styles[path][tuple(kids)] += 1
            if kids:
                holds.add(path)
            for t in blocks:
                repeated[(path, t)].add(k)
                for w in t.split():
                    words[path][w].add(k)
    own = {path: sum(len(ks) * (1 - (math.log(len(ks)) / math.log(len(on[path])) if len(on[path]) > 1 else 0)) for ks in w.values()) for path, w in words.items()}
    info = {p: sum(v for q, v in own.items() if q[: len(p)] == p) / len(on[p]) for p in on}

    def presentation(path):
        n = sum(styles[path].values())
        return -sum(c / n * math.log(c / n) for c in styles[path].values()) / math.log(n) if n > 1 else 1.0

    share = {p: info[p] / info[p[:-1]] if info[p[:-1]] > 0 else 0 for p in on if p}
    main = {p for p in share if share[p] >= 0.5 and p in holds}
    low = {p for p in share if share[p] * (1 + presentation(p)) / 2 < 0.1 and p not in main and any(q[:-1] == p[:-1] for q in main)}
    out = []
    for p in pages:
        d, kept = Dom(), []
        d.feed(p)
        for path, _, blocks in d.elements:
            cut = next((k for k in range(1, len(path) + 1) if path[:k] in low), None)
            gone = cut is not None and all(path[:k] in main for k in range(1, cut))
            kept += [(t, path) for t in blocks if not gone and 1 - math.log(len(repeated[(path, t)])) / math.log(m) >= 0.25]
        order = [t for t, _ in kept]
        out.append(sorted(order))
    return out, low


def site(rnd, k):
    """A page without an article: what is not the article differs from page to page, as the rest does."""
    menu = "".join(f"<li><a>{text(rnd, 1)}</a></li>" for _ in range(rnd.randint(3, 6)))
    prose = "".join(f"<p>{text(rnd, rnd.randint(20, 60))}</p>" for _ in range(rnd.randint(2, 7)))
    extra = f"<div class=\"related{k}\"><ul><li>{text(rnd, 2)}</li></ul></div>" if k % 3 == 0 else ""
    return (
        f"<html><body><div class=\"top\"><ul>{menu}</ul></div><div class=\"wrap\"><div class=\"text\"><h1>{text(rnd, 5)}</h1>{prose}<div>Read more of our other offers.</div></div>{extra}"
        f"<div class=\"say\">{text(rnd, 6)}</div></div><div class=\"bottom\">We set files on your machine, {text(rnd, 3)}</div></body></html>"
    )


def test_the_tree_alone(spark, monkeypatch):
    """Menus, notices and footers of pages without an article go by the tree alone, and as the brute-force tree says."""
    rnd = random.Random(50)
    pages = [site(rnd, k) for k in range(40)]
    df = spark.createDataFrame([(k, f"http://a.example/{k}", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(df, priors=False).collect()}
    want, low = brute_tree(pages)
    assert [sorted(got[k].split("\n\n")) for k in range(40)] == want
    assert {p[-1] for p in low} >= {"div.top", "div.bottom", "div.say"}
    for k, p in enumerate(pages):
        inside = re.search(r'<div class="text">(.*?)<div>Read', p)[1]
        assert got[k] == "\n\n".join(re.findall(r">([^<>]+)</(?:h1|p)>", inside))


def test_deep_nesting_stays_small():
    import tracemalloc

    tracemalloc.start()
    page = html_extract.Page("<div>" * 100_000 + "deep" + "</div></x></span>" * 50_000 + "<p>after")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6 and [t for _, t, _ in page.blocks] == ["deep", "after"]


def test_pages_of_any_kind(spark):
    """Null and repeated ids, null urls and html, columns that clash with the operator's own, no rows."""
    rows = [(None, None, None, 1, "x"), (1, "http://h/", "<p>a</p>", 2, "y"), (1, "http://h/", "<p>a</p>", 2, "y"), (1, "nourl", "<p>b", 3, "z"), (2, "http://h/", "<article>" + "<p>long " * 3000, 4, "w")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int, nodes string")
    got = sorted(((r.page_id or 0, r.text[:4], r.n_chars) for r in html_extract.extract(df).collect()))
    assert got == [(0, "", 0), (1, "a", 1), (1, "a", 1), (1, "b", 1), (2, "long", 3000 * 4 + 2999 * 2)]


# -- every operator: clashing columns, null and repeated ids, no rows -----------------------------


def test_tokens_of_repeated_and_null_ids(spark):
    rows = [(1, "some words"), (1, "some words"), (1, "others"), (None, "some words"), (None, None), (2, "word " * 50_000)]
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256[:8]) for r in bpe.digests(frame(spark, rows), bpe.default_path()).collect())
    assert sum(got.values()) == len(rows) and max(got.values()) == 2 and {k[1] for k in got if k[0] is None} == {0, 2}
    assert [k[1] for k in got if k[0] == 2][0] >= 50_000


def test_urls_of_any_length_and_clashing_columns(spark, monkeypatch):
    long = "http://" + "a." * 2000 + "example.com/en/" + "x" * 100_000
    rows = [(1, long, "h", "p", "k", 9), (None, long, "h", "p", "k", 9), (2, None, "h", "p", "k", 9), (3, "http://www.example.com/en/", "h", "p", "k", 9), (3, "http://x.net/fr/", "h", "p", "k", 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string, key string, part int")
    plain = sorted(map(str, url_filter.judge(pages, url_filter.literal_rules(spark)).collect()))
    monkeypatch.setattr(C, "hot_limit", lambda total: 1)  # every label is dealt out
    assert sorted(map(str, url_filter.judge(pages, url_filter.literal_rules(spark)).collect())) == plain
    got = [(r.page_id, r.rule, r.verdict) for r in url_filter.judge(pages, url_filter.literal_rules(spark)).collect()]
    assert sorted(got, key=str) == sorted([(1, "example.com/en/", "block"), (None, "example.com/en/", "block"), (2, None, "allow"), (3, "www.example.com/en/", "allow"), (3, "net/fr/", "block")], key=str)


def test_words_of_repeated_and_null_rows(spark):
    long = "w " * 60_000
    rows = [(1, long), (1, long), (2, long), (None, long), (None, None), (3, "")]
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(frame(spark, rows)).collect())
    assert got == {(1, 60_000, 0): 2, (2, 60_000, 60_000): 1, (None, 60_000, 60_000): 1, (None, 0, 0): 1, (3, 0, 0): 1}
