"""The other operators against brute force, round trips or held-out accuracy, with their edge cases."""

import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from helixframe.llm import common as C
from helixframe.llm import components, ctw, decontam, html_extract, jaccard, quality, sharding, substring_dedup, url_filter

WORDS = ["the", "of", "tion", "re", "an", "é", "er", "who", "st", "ou", "nd"]


def text(rnd, n):
    return " ".join("".join(rnd.choices(WORDS, k=rnd.randint(1, 3))) for _ in range(n))


def edited(rnd, t, n):
    w = t.split(" ")
    for _ in range(n):
        w[rnd.randrange(len(w))] = text(rnd, 1)
    return " ".join(w)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, did string, n_chars int")


EDGES = [(900, None), (901, ""), (902, " \n "), (903, "one two"), (904, "one two"), (None, "null id text here and more words"), (905, "x" * 200_000)]


# -- substring dedup -----------------------------------------------------------------------------


def test_substrings(spark, monkeypatch):
    rnd = random.Random(1)
    shared = [text(rnd, 40) for _ in range(3)]
    rows = [(i, text(rnd, rnd.randint(0, 60)) + " " + edited(rnd, rnd.choice(shared), rnd.randint(0, 2)) + "  " + text(rnd, rnd.randint(0, 30))) for i in range(60)]
    rows += [(100, rows[3][1]), (101, "same " * 50), (102, "same " * 30), (103, shared[0] + " " + shared[0])]
    distinct = rows + [e for e in EDGES if e[0] is not None]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.substring_dedup(frame(spark, rows + EDGES)).collect()}
    want = substring_dedup.brute_force(distinct)
    import hashlib

    assert {k: (v[0], v[1], hashlib.sha256(v[2].encode()).hexdigest()) for k, v in got.items() if k is not None} == want
    assert substring_dedup.substring_dedup(frame(spark, [])).collect() == []


def test_substrings_of_long_texts_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "PIECE", 100)
    rnd = random.Random(2)
    a = text(rnd, 700)
    got = {(r.doc_id, r.n_removed) for r in substring_dedup.substring_dedup(frame(spark, [(1, a), (1, a), (2, "x " + " ".join(a.split()[10:]))])).collect()}
    assert (1, 0) in got and len(got) == 2
    assert next(n for i, n in got if i == 2) == len(a.split()) - 10


def test_hot_grams_are_dealt_out_by_window(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", 1 / 100000)
    rnd = random.Random(31)
    rows = [(i, text(rnd, 20) + " licensed under the terms of this very long licence text " + text(rnd, rnd.randint(3, 6)) + " and so it goes on for all of us") for i in range(300)]
    rows += [(300 + i, rows[i][1].split(" ", 3)[3]) for i in range(40)]
    import hashlib

    assert len(substring_dedup.hot_grams(frame(spark, rows).select("doc_id", "text"))) > 0
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substring_dedup.substring_dedup(frame(spark, rows)).collect()}
    assert got == substring_dedup.brute_force(rows)


def test_index_runs_are_compacted(spark):
    index = substring_dedup.FingerprintIndex(spark)
    rnd = random.Random(3)
    t = text(rnd, 80)
    for k in range(5):
        index.add(frame(spark, [(k, t if k in (0, 4) else text(rnd, 50))]).select("doc_id", "text"))
        assert len(index.runs) <= substring_dedup.FANOUT


# -- Jaccard -------------------------------------------------------------------------------------


def brute_links(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: (find(i), sum(i in p for p in links)) for i in sets}


def test_jaccard(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)  # several blocks in the large cluster
    rnd = random.Random(4)
    base = [text(rnd, 120) for _ in range(6)]
    rows = [(i, edited(rnd, base[0] if i < 40 else rnd.choice(base), rnd.randint(0, 4))) for i in range(80)]
    rows += [(200 + i, base[1]) for i in range(5)] + [(300, text(rnd, 7)), (301, "a b c d e f g")]
    rows += [e for e in EDGES if e[0] is not None]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.jaccard_join(frame(spark, [*rows, EDGES[5]])).collect()}
    assert got.pop(None) == (None, 0)
    assert got == brute_links(rows)
    kept = {r.doc_id for r in jaccard.one_of_each(frame(spark, rows)).collect()}
    assert kept == {i for i, (c, _) in got.items() if c == i}
    assert jaccard.jaccard_join(frame(spark, [])).collect() == []


def test_posterior():
    assert jaccard.posterior(60, 60) > 0.999 and jaccard.posterior(10, 60) < 1e-6
    least = jaccard.least_agreement()
    assert all(jaccard.posterior(m, n) >= jaccard.TOLERANCE and (m == 0 or jaccard.posterior(m - 1, n) < jaccard.TOLERANCE) for n, m in least.items())


def test_components(spark):
    rnd = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(rnd.randrange(200, 230), rnd.randrange(200, 230)) for _ in range(25)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    import collections

    near = collections.defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    for x in near:
        seen, todo = {x}, [x]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        assert got[x] == min(seen)
    assert set(got) == set(near)


# -- decontamination -----------------------------------------------------------------------------


def test_templates(spark):
    items = [(1, "A train leaves Boston at 5 pm and travels 120 miles while Mary counts 5 apples in the red basket nearby."), (2, "When Tom buys 3 kg of rice for 12 dollars how much does 1 kg of the rice cost him in total?"), (3, "too short"), (None, "x"), (4, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [
        (1, "Noise before. " + items[0][1] + " Noise after."),
        (2, "We read that A train leaves Denver at 7 pm and travels 340 miles while Susan counts 7 apples in the red basket nearby."),
        (3, "A train leaves Denver at 7 pm and travels 340 miles while Susan counts 9 apples in the red basket nearby."),
        (4, "Nothing of the kind stands here at all, it is only a few plain words about other things."),
        (5, items[1][1].replace("3 kg", "8 lbs").replace("12 dollars", "40 euros").replace("1 kg", "1 lbs").upper().lower()),
        (6, None),
        (7, ""),
    ]
    got = {r.doc_id: (r.contaminated, r["items"], r.changed_items) for r in decontam.decontaminate(frame(spark, docs), bench).collect()}
    assert got[1] == (True, [1], []) and got[2] == (True, [1], [1])
    assert got[3] == (True, [1], [1])  # 5 -> 7 and 5 -> 9 clash: the windows of the larger consistent set count
    assert got[5] == (True, [2], [2])
    assert not got[4][0] and got[6] == (False, [], []) and got[7] == (False, [], [])
    assert {r.doc_id for r in decontam.clean(frame(spark, docs), bench).collect()} >= {4, 6, 7}
    assert decontam.decontaminate(frame(spark, []), bench).collect() == []
    assert decontam.clean(frame(spark, docs), bench.where("false")).count() == len(docs)


def test_clashing_slots(spark):
    """One of two equal numbers changed: the windows of the larger consistent set still count, the others do not."""
    item = "A train leaves Boston at 5 pm and travels 120 miles while Mary counts 5 apples in the red basket nearby."
    close = "We add 5 mugs and 5 cups and 5 pots and 5 pans to it."
    bench = spark.createDataFrame([(1, item), (2, close)], "item_id long, text string")
    docs = [(3, item.replace("5 pm", "7 pm").replace("5 apples", "9 apples")), (4, close.replace("5 cups", "6 cups").replace("5 pots", "7 pots").replace("5 pans", "8 pans"))]
    got = {r.doc_id: (r["items"], r.changed_items) for r in decontam.decontaminate(frame(spark, docs), bench).collect()}
    assert got == {3: ([1], [1]), 4: ([], [])}


def test_short_and_wordless_items(spark):
    items = [(1, "which planet has most moons today"), (2, "cheap red kite"), (3, "17 42 99 3 8 21 7 5 64 12 30"), (4, "1 2 3 4 5 6")]
    noise = "some plain words that stand before and after what is looked for here "
    docs = [(i, noise + t + ". " + noise) for i, t in items] + [(5, noise + "which planet has most rings today " + noise), (6, noise + "17 42 99 3 8 22 7 5 64 12 31 " + noise), (7, noise + "1 2 3 4 5 7 " + noise), (8, "Cheap, red kite!")]
    got = {r.doc_id: r["items"] for r in decontam.decontaminate(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {1: [1], 2: [2], 3: [3], 4: [4], 5: [], 6: [], 7: [], 8: [2]}


def hot_and_unfiltered(monkeypatch):
    """Every key that repeats is hot, and the filter is so full that other windows pass it."""
    monkeypatch.setattr(C, "hot_limit", lambda total: 1)
    monkeypatch.setattr(decontam, "FILTER_MOST", 64)


def test_benchmark_in_salted_parts(spark, monkeypatch):
    hot_and_unfiltered(monkeypatch)
    rnd = random.Random(6)
    items = [(i, text(rnd, 20)) for i in range(7)]
    docs = [(i, text(rnd, 10) + " " + t + " " + text(rnd, 10)) for i, t in items]
    got = {r.doc_id: r["items"] for r in decontam.decontaminate(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {i: [i] for i in range(7)}


def test_rows_are_kept(spark, monkeypatch):
    """One row for each row of docs, also for null and repeated ids, however windows are joined."""
    rnd = random.Random(16)
    items = [(i, text(rnd, 20)) for i in range(5)]
    docs = [(None, items[0][1]), (None, "nothing here"), (None, None), (7, items[1][1]), (7, items[2][1]), (7, "clean"), (7, "clean"), (8, items[3][1] + " " + items[4][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = []
    for salted in (False, True):
        if salted:
            hot_and_unfiltered(monkeypatch)
        got.append(sorted((tuple(r) for r in decontam.decontaminate(frame(spark, docs), bench).collect()), key=repr))
    assert got[0] == got[1] and len(got[0]) == len(docs)


# -- url filter ----------------------------------------------------------------------------------


def rule_of(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest)
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]
    fit = [(len(h), len(p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best[2] if best else None, best[3] if best else "allow"


def test_urls(spark):
    rnd = random.Random(7)
    labels = ["com", "net", "example", "www", "a", "b", "spam-farm", "exam"]
    rules = list({(h, p): (rnd.choice(["allow", "block"]), h, p) for h, p in ((".".join(rnd.choices(labels, k=rnd.randint(1, 3))), rnd.choice(["/", "/en/", "/en/x", ""])) for _ in range(40))}.values())
    urls = ["http://" + ".".join(rnd.choices(labels, k=rnd.randint(1, 4))) + rnd.choice(["", "/", "/en/x?q=/en/", "/en/#a", "?x://y", "/de/"]) for _ in range(300)]
    urls += [None, "", "no scheme", "HTTP://WWW.Example.COM/EN/", "a://b://c/d", "http://", "http://u@h.com:80/", "x://\nexample.com/en/\nx"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for own in (rules, url_filter.RULES, []):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, url_filter.rules_frame(spark, own)).collect()}
        assert got == {i: rule_of(u, own) for i, u in enumerate(urls)}
    repeated = spark.createDataFrame([(1, "http://a.com/"), (1, "http://a.com/")], "page_id long, url string")
    assert url_filter.judge(repeated, url_filter.literal_rules(spark)).count() == 2
    assert url_filter.judge(repeated.where("false"), url_filter.literal_rules(spark)).count() == 0


# -- sharding ------------------------------------------------------------------------------------


def test_shards_fit(spark):
    rnd = random.Random(8)
    rows = [(i, text(rnd, rnd.randint(1, 60))) for i in range(400)] + [(1000, "y" * 5000)] + [(7, "repeated text")] * 60 + EDGES
    limit = 1000
    got = sharding.shards(frame(spark, rows), limit).collect()
    assert len(got) == len(rows)
    weight: dict = {}
    for r in got:
        weight.setdefault((r.shard, r.volume), []).append(r.n_bytes)
        assert len(r.shard) == r.depth and r.oversized == (r.n_bytes > limit)
    for sizes in weight.values():
        assert sum(sizes) <= limit or len(sizes) == 1
    prefixes = {r.shard for r in got}
    assert not any(a != b and b.startswith(a) for a in prefixes for b in prefixes)  # a directory: no bucket inside another
    parents = {p[:-1] for p in prefixes if p}
    by_parent = {p: sum(r.n_bytes for r in got if r.shard.startswith(p)) for p in parents}
    assert all(v > limit for v in by_parent.values())  # only oversized buckets were split
    assert sharding.shards(frame(spark, []), limit).collect() == []


# -- HTML ----------------------------------------------------------------------------------------


def page(body, extra=""):
    return f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">menu</a></ul></nav><div class="ad">buy</div>{body}{extra}<footer>&copy; x</footer></body></html>'


def test_blocks():
    of = lambda h: [t for _, t in html_extract.blocks(h)]
    assert of(page("<article><h1>Title &amp; more</h1><p><b>Lead.<br><p>One\n two<p>Three <a href='#'>four</a>!</article>")) == ["Title & more", "Lead.", "One two", "Three four!"]
    assert of(page("<article><p>a</p><div class='comments'><p>nice</p></div><aside>x</aside><form>f<input></form><p>b</p></article>")) == ["a", "b"]
    assert of(page("<article><header><h1>Head</h1></header><p>x < y &lt;z&gt; &#233;&nbsp;q</p>")) == ["Head", "x < y <z> é q"]
    assert of("<main><p>in</p></main><p>out</p>") == ["in"] and of("plain &amp; simple") == ["plain & simple"]
    assert of(None) == [] and of("") == [] and of("<!-- a <p>b") == [] and of("<p") == [] and of("<article><table><tr><td>1<td>2<tr><td>3</table>") == ["1", "2", "3"]
    assert of("<article><p>a<!-- c --><script>if (a<b) x</script>b</p>") == ["ab"]
    assert of("<div><div>deep" * 3000 + "</div>" * 10) != []


def test_style_tree(spark, monkeypatch):
    rnd = random.Random(9)
    rows = []
    for i in range(30):
        body = f"<article><p>{text(rnd, 12)}</p><div class='x'>Read our other offers today.</div><p>{text(rnd, 9)}</p></article>"
        rows.append((i, f"http://site.example/{i}", page(body)))
    same = page("<article><p>A page that was published often.</p></article>")
    rows += [(100 + i, f"http://site.example/c{i}", same) for i in range(60)] + [(200, None, None), (201, "http://small.example/", rows[0][2]), (202, "http://site.example/", "")]
    pages = spark.createDataFrame([(*r, 5) for r in rows], "page_id long, url string, html string, n_chars int")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert len(got) == len(rows) and got[200] == "" and got[202] == ""
    assert all("offers" not in got[i] and len(got[i].split("\n\n")) == 2 for i in range(30))
    assert got[100] == "A page that was published often." and "offers" in got[201]
    monkeypatch.setattr(html_extract, "BROADCAST", 0)
    assert {r.page_id: r.text for r in html_extract.extract(pages).collect()} == got
    assert html_extract.extract(pages.where("false")).collect() == []


# -- CTW -----------------------------------------------------------------------------------------


def test_tree_is_a_distribution_and_learns():
    rnd = random.Random(10)
    train = [text(rnd, 40) for _ in range(200)]
    import pyarrow as pa

    data, offs = ctw.canonical(*C.flat(pa.array(train)))
    tree = ctw.grow(*ctw.tally(ctw.grams(data, offs)))
    context = ctw.grams(data, offs)[[50, 500, 1]] & ~C.U64(255)
    for c in context:
        p = 10 ** ctw.log10_probability(tree, c | np.arange(256, dtype=np.uint64))
        assert abs(p.sum() - 1) < 1e-9
    fresh, o = ctw.canonical(*C.flat(pa.array([text(rnd, 100)])))
    own = ctw.log10_probability(tree, ctw.grams(fresh, o)).sum()
    assert own > -len(fresh) * 1.0  # far under the 2.4 digits a byte costs without a model


def test_gamma():
    x = np.array([0.5, 1.0, 1.5, 3.7, 20.0, 1e6])
    assert np.allclose(ctw._log_gamma(x), [math.lgamma(v) for v in x], atol=1e-10)


def test_scores(spark):
    rnd = random.Random(11)
    rows = [(i, text(rnd, rnd.randint(0, 40))) for i in range(60)] + EDGES + [(3, "again the same id")] * 2
    docs = frame(spark, rows)
    out = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 == 1
    tokens = lambda t: [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None]
    import collections

    counts = collections.Counter(w for i, t in rows if not out(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.held_out, round(r.base_score, 6)) for r in ctw.score(docs, ctw.train(docs.where(~ctw.held_out()))).collect()))
    want = sorted((i is None, i or 0, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), out(i), round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for i, t in rows)
    assert got == want
    whole = ctw.grow(*ctw.tally(*map(np.concatenate, zip(*[ctw.tally(ctw.grams(*ctw.canonical(*C.flat(__import__("pyarrow").array([t or ""]))))) for i, t in rows if not out(i)], strict=True))))
    shared = ctw.train(docs.where(~ctw.held_out()))
    for a, b in zip(whole.keys + whole.one + whole.stop, shared.keys + shared.one + shared.stop, strict=True):
        assert np.allclose(a.astype(float), b.astype(float), atol=1e-5)
    empty = docs.where("false")
    assert ctw.score(empty, ctw.train(empty)).collect() == []
    [r] = ctw.score(docs.where("doc_id = 901"), ctw.train(empty)).collect()
    assert r.n_tokens == 1 and abs(r.score - 8 * math.log10(0.5)) < 1e-9


def test_rare_contexts_are_kept(spark):
    """More than 2 ** 20 training bytes, and a passage that stands there once: its nodes count as they would in a small input."""
    rnd = random.Random(14)
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    ids = itertools.count()
    rows = [(next(i for i in ids if not out(i)), "aaaa bbbb " * 12_000) for _ in range(12)]
    rare = " ".join("".join(rnd.choices("qxzvjkw", k=6)) for _ in range(30))
    rows.append((next(i for i in ids if not out(i)), rare))
    docs = frame(spark, rows)
    [r] = ctw.score(frame(spark, [(next(i for i in ids if out(i)), rare)]), ctw.train(docs)).collect()
    names, n = zip(*(ctw.tally(ctw.grams(*ctw.canonical(*C.flat(__import__("pyarrow").array([t]))))) for _, t in rows), strict=True)
    *deep, first = ctw.subtrees(*ctw.tally(np.concatenate(names), np.concatenate(n)))
    whole = ctw.completed(ctw.topmost(first), deep)
    assert math.isclose(r.score, ctw.log10_probability(whole, ctw.grams(*ctw.canonical(*C.flat(__import__("pyarrow").array([rare]))))).sum(), rel_tol=1e-5)


# -- quality -------------------------------------------------------------------------------------


def brute_counts(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines, seen, dup = t.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    tri = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    times = {x: tri.count(x) for x in set(tri)}
    rep = set()
    for k, x in enumerate(tri):
        if times[x] > 1:
            rep |= {k, k + 1, k + 2}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(rep)


def test_quality_counts(spark):
    rnd = random.Random(12)
    rows = [(i, "\n".join(rnd.choice([text(rnd, rnd.randint(0, 8)), "same line", " ", "a#b|é 日本 <x>", "one two three one two three"]) for _ in range(rnd.randint(1, 9)))) for i in range(80)] + EDGES
    docs = frame(spark, rows)
    model = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    got = sorted(((r.doc_id is None, r.doc_id or 0), (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in quality.judge(docs, model).collect())
    assert got == sorted(((i is None, i or 0), brute_counts(t)) for i, t in rows)
    assert quality.judge(docs.where("false"), model).collect() == []


def test_quality_learns(spark):
    rnd = random.Random(13)

    def make(good, toxic):
        w = text(rnd, 80).split(" ")
        if not good:
            w = [x + rnd.choice(["###", "$$$", "***"]) for x in w]
        if toxic:
            for _ in range(4):
                w[rnd.randrange(80)] = rnd.choice(["idiot", "moron"])
        return " ".join(w)

    kinds = [(rnd.random() < 0.7, rnd.random() < 0.2) for _ in range(600)]
    rows = [(i, make(*k)) for i, k in enumerate(kinds)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(g), int(t)) for i, (g, t) in enumerate(kinds[:400])] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = {r.doc_id: r.kept for r in quality.judge(docs, model).collect()}
    right = sum(got[i] == (g and not t) for i, (g, t) in enumerate(kinds) if i >= 400)
    assert right >= 190
    assert {r.doc_id for r in quality.keep(docs, model).collect()} == {i for i, k in got.items() if k}


def test_quality_sample(spark):
    """Labels of absent or overlong documents take no place in the sample, and texts of 8,000 to 20,000 bytes are fitted."""
    rnd = random.Random(15)
    rows = [(i, " ".join(x + "###" * (i % 2) for x in text(rnd, 2000).split(" "))[:15_000]) for i in range(40)]
    labels = [(i, 1 - i % 2, i % 2) for i in range(40)] + [(i, 1, 0) for i in range(1000, 6000)] + [(-1, 1, 0)] * 50
    docs = frame(spark, rows + [(-1, "x " * quality.TRAIN_BYTES)])
    assert min(len(t) for _, t in rows) > 8_000
    model = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), 40)
    assert model.quality.weights.any() and model.toxic.weights.any()
    got = {r.doc_id: r.p_quality >= 0.5 for r in quality.judge(frame(spark, rows), model).collect()}
    assert got == {i: i % 2 == 0 for i in range(40)}


@pytest.mark.parametrize("n", [1, 5, 64])
def test_packing(n):
    a = {"x": np.arange(n, dtype=np.uint64) * 3, "y": np.arange(n, dtype=np.uint8)}
    back = C.unpack(C.pack(**a), x="<u8", y="<u1")
    assert all((back[k] == a[k]).all() for k in a)


def test_multikey():
    rng = np.random.default_rng(1)
    cols = [rng.integers(0, 3, 500).astype(np.uint64) for _ in range(4)]
    order, group = C.multikey(cols)
    keys = [tuple(c[i] for c in cols) for i in order]
    assert keys == sorted(keys)
    assert all((group[i] == group[i + 1]) == (keys[i] == keys[i + 1]) for i in range(499))
