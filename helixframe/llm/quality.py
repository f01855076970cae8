"""Quality rules: hashed word and character n-gram logistic regression, calibrated, against fixed thresholds.

Features of a text are hashed into a fixed number of slots: its words and pairs of neighbouring words (letters
only, ASCII ones lower-cased), shapes of words (capitals, digits, symbols) and of pairs of words, whether a word repeats
the one before it, and byte 4-grams of the lower-cased text; the value of a kind is its mean weight over the text.
Two heads: quality (label 1) and toxicity (label 1).  For toxicity the presence of a word, of its first four and of
its first five bytes, and of a pair of words counts, since one word can decide, and each has three slots of a larger
table, so that a shared slot alone does not make it toxic.  Slots found in fewer than LEAST training rows, or whose
log-likelihood ratio against the label is under GAIN (so that rare slots do not pass by chance) or not among the MOST
highest, have no weight, and values are scaled by the slot's log-odds between the
classes before the fit.

Heads are trained by full-batch gradient descent on a bounded sample of labelled rows: TRAIN_ROWS labels with the
smallest hashes of doc_id, among those of documents that are there and have at most TRAIN_BYTES bytes.  Executors make
the features, count slots and send the few with a weight; the driver fits.  Four fifths of the sample are fitted, the
rest calibrates (Platt's method: Newton steps with a line search).  A head whose scores do not rise with the held-out
label has learnt nothing: it warns and gives every text the sample's share of its label.  Texts are scored in Arrow
batches against the fixed thresholds KEEP and TOXIC; plain counts (few words, repeated words) reject a text beforehand.

Null texts are empty: they have no words and are not kept.  Very long texts are scored whole.  Every row is judged by
its own text, so repeated rows are judged alike.  Labels with null doc_id, quality or toxic, or without a document,
are left out of training; repeated labels count as often as they stand there, and of several texts under
one doc_id the least is fitted.  Without any labels, or with one class only, a head always says yes (quality) or
no (toxicity).
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SLOTS = 1 << 17
TOXIC_SLOTS = 1 << 20
#: Bound on the labelled rows that are fitted, and on their bytes (longer texts are left out of the fit).
TRAIN_ROWS, TRAIN_BYTES = 8000, 20_000
#: Tasks that make the sample's features.
SAMPLE_PARTS = 16
#: Bytes of text whose features are held at once (some 250 bytes for each).
BLOCK = 1 << 18
LEAST, GAIN, MOST = 5, 28.0, 2048
KEEP, TOXIC = 0.5, 0.25
MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
ROW = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, p_quality double, p_toxic double, kept boolean"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Shape classes of bytes: 0 other, 1 lower-case letter, 2 capital, 3 digit, 4 symbol, 5 beyond ASCII
_SHAPE = np.zeros(256, np.uint64)
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[128:] = 1, 2, 3, 5
for _b in SYMBOLS + b"!?@=_/\\{}[]~^":
    _SHAPE[_b] = 4
_LETTER = ((_SHAPE == 1) | (_SHAPE == 2) | (_SHAPE == 5)).astype(np.uint64)


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Of quality: for each feature (row, slot, value), values of a kind adding up to one in a row; of toxicity: (row, hash) of each token, repeats too."""
    n = len(offs) - 1
    low = _LOWER[buf]
    starts, ends, at = C.words_of(buf, offs)
    row = np.repeat(np.arange(n), np.diff(at))
    prefix = C.prefix_hash(np.where(_LETTER[low] > 0, C.BYTE[low], C.U64(0)))
    word = C.range_hash(prefix, starts, ends)  # letters only, so punctuation does not hide a word
    kinds = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(C.U64(1) << (_SHAPE[buf] * C.U64(10)) if len(buf) else np.empty(0, np.uint64), out=kinds[1:])
    shape = kinds[ends] - kinds[starts]
    few = np.zeros(len(starts), np.uint64)
    for k in range(6):  # each count of a kind of byte in a word as 0, 1, 2 or more
        few = few * C.U64(3) + np.minimum((shape >> C.U64(10 * k)) & C.U64(1023), C.U64(2))
    inside = row[1:] == row[:-1]  # neighbours in one text
    with np.errstate(over="ignore"):
        two = C.mix(word[:-1] * C.U64(0x9E3779B97F4A7C15) + word[1:])[inside]
        shapes = C.mix(few[:-1] * C.U64(1000003) + few[1:] + C.U64(77))[inside]
    again = np.zeros(len(word), np.uint64)
    again[1:] = (word[1:] == word[:-1]) & inside
    gram, grow = np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(buf) >= 4:
        x = low.astype(np.uint64)
        gram = C.mix(x[:-3] | (x[1:-2] << C.U64(8)) | (x[2:-1] << C.U64(16)) | (x[3:] << C.U64(24)) | C.U64(1 << 40))
        grow = np.repeat(np.arange(n), np.diff(offs))[: len(gram)]
        whole = np.arange(len(gram)) + 4 <= offs[1:][grow]
        gram, grow = gram[whole], grow[whole]
    mask = C.U64(SLOTS - 1)
    pair_row = row[:-1][inside]
    quality = []
    for h, r in ((word, row), (two, pair_row), (C.mix(few + C.U64(55)), row), (shapes, pair_row), (C.mix(again + C.U64(991)), row), (gram, grow)):
        total = np.bincount(r, minlength=n)
        quality.append((r, (h & mask).astype(np.int64), 1.0 / np.maximum(total, 1)[r]))
    tokens, rows = [word, two], [row, pair_row]
    if len(buf):
        pad = np.concatenate([low, np.zeros(4, np.uint8)])
        lead = [pad[starts + k].astype(np.uint64) for k in range(5)]
        four = lead[0] | (lead[1] << C.U64(8)) | (lead[2] << C.U64(16)) | (lead[3] << C.U64(24))
        for size, h in ((4, C.mix(four + C.U64(1 << 41))), (5, C.mix((four | (lead[4] << C.U64(32))) + C.U64(1 << 42)))):
            long = ends - starts >= size
            tokens.append(h[long])
            rows.append(row[long])
    return tuple(map(np.concatenate, zip(*quality, strict=True))), (np.concatenate(rows), C.mix(np.concatenate(tokens)))


def toxic_slots(h: np.ndarray) -> list[np.ndarray]:
    """The three slots of each token."""
    return [((h >> C.U64(21 * k + 1)) & C.U64(TOXIC_SLOTS - 1)).astype(np.int64) for k in range(3)]


def present(tokens: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, value) of the different tokens of each row."""
    row, h = tokens
    by = np.lexsort((h, row))
    row, h = row[by], h[by]
    new = np.append(True, (row[1:] != row[:-1]) | (h[1:] != h[:-1])) if len(row) else np.empty(0, bool)
    row, slots = row[new], toxic_slots(h[new])
    return np.tile(row, 3), np.concatenate(slots), np.full(3 * len(row), 1 / 3)


@dataclass
class Head:
    """Weights, intercept, and Platt's slope and offset."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, f: tuple[np.ndarray, ...], n: int) -> np.ndarray:
        row, slot, value = f
        return np.bincount(row, self.weights[slot] * value, n) + self.bias

    def probability(self, f: tuple[np.ndarray, ...], n: int) -> np.ndarray:
        return sigmoid(self.slope * self.raw(f, n) + self.shift)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def compact(f: tuple[np.ndarray, ...], slots: int) -> tuple[np.ndarray, ...]:
    """One entry for each slot of a row, in small types."""
    row, slot, value = f
    key, inverse = np.unique(row * slots + slot, return_inverse=True)
    return (key // slots).astype(np.int32), (key % slots).astype(np.int32), np.bincount(inverse, value).astype(np.float32)


@dataclass
class Found:
    """In how many fitted rows of each class a slot is found, of ny and nn rows."""

    yes: np.ndarray
    no: np.ndarray
    ny: int
    nn: int

    def good(self) -> np.ndarray:
        """The slots that have a weight."""
        yes, no, ny, nn = self.yes, self.no, self.ny, self.nn
        n, seen = ny + nn, yes + no
        gain = np.zeros(len(yes))
        for k, margin in ((yes, ny), (no, nn)):
            for times, rows in ((k, seen), (margin - k, n - seen)):
                gain += 2 * times * np.log(np.maximum(times, 1) * n / np.maximum(rows * float(margin), 1))
        good = (seen >= min(LEAST, max(1, n // 20))) & (gain >= min(GAIN, n / 4))
        if good.sum() > MOST:
            good &= gain >= np.partition(gain[good], -MOST)[-MOST]
        return good if good.any() else yes + no > 0


def fit(
    f: tuple[np.ndarray, ...], found: Found, label: np.ndarray, held: np.ndarray, slots: int, what: str, rounds: int = 40, rate: float = 0.2,
    decay: float = 1e-5
) -> Head:
    """Logistic regression with classes of equal weight (Adagrad steps over all rows), then Platt's calibration on held rows."""
    row, slot, value = f  # of good slots only, as compact() gives them
    n = len(label)
    head = Head(np.zeros(slots, np.float32), 0.0)
    use = ~held
    weight = np.where(use, np.where(label == 1, 0.5 / max(1, found.ny), 0.5 / max(1, found.nn)), 0.0)
    names = np.flatnonzero(np.bincount(slot, minlength=slots))
    number = np.zeros(slots, np.int32)
    number[names] = np.arange(len(names))
    slot = number[slot]
    odds = np.log((found.yes[names] + 0.5) / (found.ny + 1)) - np.log((found.no[names] + 0.5) / (found.nn + 1))
    scaled = value * odds.astype(np.float32)[slot]
    w, b = np.zeros(len(names)), 0.0
    g2, b2 = np.full(len(names), 1e-8), 1e-8
    for _ in range(rounds):
        miss = (sigmoid(np.bincount(row, w[slot] * scaled, n) + b) - label) * weight
        g = np.bincount(slot, miss[row] * scaled, len(names)) + decay * w
        g2 += g * g
        w -= rate * g / np.sqrt(g2)
        gb = miss.sum()
        b2 += gb * gb
        b -= rate * gb / np.sqrt(b2)
    head.weights[names], head.bias = w * odds, float(b)
    fold = held if held.any() and len(np.unique(label[held])) == 2 else use
    score = np.bincount(row, w[slot] * scaled, n) + b
    head.slope, head.shift = platt(score[fold], label[fold])
    if head.slope <= 0:  # higher scores do not mean the label
        warnings.warn(f"the {what} head has learnt nothing from {n} labelled rows; it gives every text the label's share", stacklevel=2)
        share = (label.sum() + 1) / (n + 2)
        return Head(np.zeros(slots, np.float32), float(np.log(share / (1 - share))))
    return head


def platt(score: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """slope and shift of P = sigmoid(slope * score + shift) with Platt's smoothed targets.

    Newton's method; a step is halved until the loss falls, so it cannot run away where classes are far apart."""
    pos, neg = int((label == 1).sum()), int((label == 0).sum())
    target = np.where(label == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = max(float(np.std(score)), 1e-9)
    x = score / scale

    def loss(a: float, b: float) -> float:
        z = a * x + b
        return float((np.logaddexp(0, z) - target * z).sum())

    a, b = 0.0, float(np.log((pos + 1) / (neg + 1)))
    now = loss(a, b)
    for _ in range(100):
        p = sigmoid(a * x + b)
        d, h = p - target, p * (1 - p) + 1e-12
        ga, gb = float((d * x).sum()), float(d.sum())
        if abs(ga) < 1e-6 and abs(gb) < 1e-6:
            break
        haa, hab, hbb = float((h * x * x).sum()) + 1e-9, float((h * x).sum()), float(h.sum()) + 1e-9
        det = haa * hbb - hab * hab
        da, db = (-(hbb * ga - hab * gb) / det, -(haa * gb - hab * ga) / det) if det > 0 else (-ga, -gb)
        step = 1.0
        while step > 1e-10 and loss(a + step * da, b + step * db) > now + 1e-4 * step * (ga * da + gb * db):
            step /= 2
        if step <= 1e-10:
            break
        a, b = a + step * da, b + step * db
        now = loss(a, b)
    return a / scale, b


@dataclass
class Model:
    quality: Head
    toxic: Head

    def __post_init__(self):
        self.active = self.toxic.weights != 0

    def probabilities(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of quality and of toxicity, for each text."""
        n = len(offs) - 1
        quality, (row, h) = features(buf, offs)
        a, b, c = toxic_slots(h)
        hit = np.flatnonzero(self.active[a] | self.active[b] | self.active[c])  # others add nothing
        return self.quality.probability(quality, n), self.toxic.probability(present((row[hit], h[hit])), n)


SIZES = (SLOTS, TOXIC_SLOTS)


def _sample(docs: DataFrame, labels: DataFrame, most: int) -> tuple[list[tuple[int, int]], DataFrame | None]:
    """The labels (quality, toxic) of the sampled rows, and their texts (row, text), written once."""
    spark = docs.sparkSession
    good = labels.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("_q"), F.col("toxic").cast("int").alias("_t")
    ).dropna()
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).where(F.octet_length(text) <= TRAIN_BYTES)
    drawn = good.join(slim.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id", "_q", "_t").limit(most).collect()
    if not drawn:
        return [], None
    rows = spark.createDataFrame([(r.doc_id, k) for k, r in enumerate(drawn)], "doc_id long, row int")  # at most TRAIN_ROWS
    texts = slim.join(F.broadcast(rows), "doc_id").groupBy("row").agg(F.min("text").alias("text"))
    return [(r._q, r._t) for r in drawn], C.cut(texts.repartition(SAMPLE_PARTS, "row"), "sample")


def _counted(label_of: list[np.ndarray], held: np.ndarray):
    """For each head the number of fitted rows of each class in which a slot is found, over the rows of a task."""

    def run(batches):
        total = [np.zeros((2, s), np.int32) for s in SIZES]
        for row, f in _features(batches):
            for (r, slot, _), to, label in zip(f, total, label_of, strict=True):
                own = ~held[row[r]]
                for k in (0, 1):
                    to[k] += np.bincount(slot[own & (label[row[r]] == k)], minlength=to.shape[1]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array([pa.compress(t.tobytes(), codec="zstd", asbytes=True)], pa.binary()) for t in total], names=["quality", "toxic"]
        )

    return run


def _features(batches):
    """The rows of blocks of texts, and for each head one entry for each slot of a row."""
    for batch in batches:
        buf, offs = C.flat(batch.column("text"))
        row = C.longs(batch.column("row"))
        for i, j in C.blocks(offs, BLOCK):
            quality, toxic = features(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            yield row[i:j], (compact(quality, SLOTS), compact(present(toxic), TOXIC_SLOTS))


def _entries(good: list[np.ndarray]):
    """Entries of slots with a weight, packed."""

    def run(batches):
        for row, f in _features(batches):
            packs = []
            for (r, slot, value), ok in zip(f, good, strict=True):
                own = ok[slot]
                packs.append(pa.array([C.pack(row=row[r[own]].astype(np.int32), slot=slot[own], value=value[own])], pa.binary()))
            yield pa.RecordBatch.from_arrays(packs, names=["quality", "toxic"])

    return run


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``most`` labelled rows, those with the smallest hashes of doc_id (ties by doc_id)."""
    label_rows, texts = _sample(docs, labels, most)
    if texts is None:
        return Model(Head(np.zeros(SLOTS, np.float32), 40.0), Head(np.zeros(TOXIC_SLOTS, np.float32), -40.0))
    label_of = [np.array([r[k] for r in label_rows]) for k in (0, 1)]
    held = np.arange(len(label_rows)) % 5 == 4
    totals = [np.zeros((2, s), np.int64) for s in SIZES]
    for r in texts.mapInArrow(_counted(label_of, held), "quality binary, toxic binary").collect():  # SAMPLE_PARTS rows
        for to, name in zip(totals, ("quality", "toxic"), strict=True):
            to += np.frombuffer(pa.decompress(r[name], decompressed_size=to.size * 4, codec="zstd", asbytes=True), np.int32).reshape(to.shape)
    two = [len(np.unique(label[~held])) == 2 for label in label_of]
    found = [Found(t[1], t[0], int((label[~held] == 1).sum()), int((label[~held] == 0).sum())) for t, label in zip(totals, label_of, strict=True)]
    good = [x.good() if ok else np.zeros(s, bool) for x, ok, s in zip(found, two, SIZES, strict=True)]
    parts: tuple[list, list] = ([], [])
    for r in texts.mapInArrow(_entries(good), "quality binary, toxic binary").collect():
        for to, name in zip(parts, ("quality", "toxic"), strict=True):
            to.append(C.unpack(r[name], row="<i4", slot="<i4", value="<f4"))
    C.forget(texts)
    heads = []
    for label, empty, slots, x, ok, own, what in zip(label_of, (1, 0), SIZES, found, two, parts, ("quality", "toxic"), strict=True):
        if not ok:
            heads.append(Head(np.zeros(slots, np.float32), 40.0 if (label[0] if len(np.unique(label)) == 1 else empty) else -40.0))
            continue
        f = C.joined(own)
        own.clear()
        heads.append(fit((f["row"], f["slot"], f["value"]), x, label, held, slots, what))
        del f
    return Model(*heads)


def counts(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    n = len(offs) - 1
    starts, ends, at = C.words_of(buf, offs)
    words = np.diff(at)
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offs])
    space = (buf == 32) | ((buf >= 9) & (buf <= 13))
    chars = total(~space & ((buf & 0xC0) != 0x80))
    symbols = total(np.isin(buf, np.frombuffer(SYMBOLS, np.uint8)))
    # 3-word windows found twice or more in their text: compare hashes inside each text
    prefix = C.prefix_hash(C.BYTE[buf])
    word = C.range_hash(prefix, starts, ends)
    repeat = np.zeros(len(word), bool)
    if len(word) >= 3:
        row = np.repeat(np.arange(n), words)
        with np.errstate(over="ignore"):
            key = C.mix(word[:-2] * C.U64(3) ^ C.mix(word[1:-1] * C.U64(5) ^ C.mix(word[2:] * C.U64(7))))
        own = row[:-2] == row[2:]
        where = np.flatnonzero(own)
        key = C.mix(key[where] + row[where].astype(np.uint64) * C.U64(0x9E3779B97F4A7C15))
        by = np.argsort(key)
        k = key[by]
        twice = np.zeros(len(k), bool)
        same = k[1:] == k[:-1]
        twice[1:] |= same
        twice[:-1] |= same
        hit = where[by[twice]]
        for d in range(3):
            repeat[hit + d] = True
    repeats = np.diff(np.concatenate([[0], np.cumsum(repeat)])[at])
    # lines: \n-split, with a word, equal to an earlier line of the text
    dup = np.zeros(n, np.int64)
    if len(buf):
        ends_at = np.flatnonzero(buf == 10)
        row_of = np.searchsorted(offs, ends_at, "right") - 1
        full = np.flatnonzero(np.diff(offs) > 0)
        s = np.concatenate([ends_at + 1, offs[full]])
        e = np.concatenate([ends_at, offs[full + 1]])
        r = np.concatenate([row_of, full])
        s, e = np.sort(s), np.sort(e)  # each line's start and its end have the same rank
        r = np.sort(np.concatenate([row_of, full]))
        has = np.concatenate([[0], np.cumsum(~space)])
        ok = has[e] > has[s]
        s, e, r = s[ok], e[ok], r[ok]
        with np.errstate(over="ignore"):
            key = C.mix(C.range_hash(prefix, s, e) + r.astype(np.uint64) * C.U64(0xC2B2AE3D27D4EB4F))
        _, first = np.unique(key, return_index=True)
        dup = np.bincount(r, minlength=n) - np.bincount(r[first], minlength=n)
    return {"n_words": words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeats}


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each row of docs (doc_id, text): counts, probabilities and the verdict."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # two heads of SLOTS weights: a fixed size

    def run(batches):
        m = shared.value
        for batch in batches:
            buf, offs = C.flat(batch.column("text"))
            for i, j in C.blocks(offs, BLOCK):
                b, o = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                c = counts(b, o)
                failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
                pq, pt = m.probabilities(b, o)
                kept = ~failed & (pq >= KEEP) & (pt < TOXIC)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i), *(pa.array(np.asarray(x, np.int64)) for x in c.values()), pa.array(failed),
                        pa.array(pq), pa.array(pt), pa.array(kept)
                    ],
                    names=["doc_id", *c, "base_failed", "p_quality", "p_toxic", "kept"],
                )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(run, ROW)


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the rules keep, with their own columns; decided in place, without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            buf, offs = C.flat(batch.column("text"))
            for i, j in C.blocks(offs, BLOCK):
                b, o = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                c = counts(b, o)
                pq, pt = m.probabilities(b, o)
                ok = (c["n_words"] >= MIN_WORDS) & (100 * c["n_repeat_words"] <= 50 * c["n_words"]) & (pq >= KEEP) & (pt < TOXIC)
                yield batch.slice(i, j - i).filter(pa.array(ok))

    return docs.mapInArrow(run, docs.schema)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
