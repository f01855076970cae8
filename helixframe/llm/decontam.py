"""Benchmark decontamination by template canonicalisation.

Both sides become token templates: words are stripped of outer punctuation and lower-cased (ASCII),
words without a letter or digit are dropped, and numbers, names and units become typed placeholders
that remember what stood there.  Windows of WINDOW template tokens are hash-joined: the benchmark's windows are a
written table; a document's windows that pass a Bloom filter of the table's hashes (a bounded broadcast) are
joined with it by hash, a hot hash in salted parts.  Matching windows are verified token by token and
grouped by document, item and alignment; on each alignment the slots must be consistent: one value
of the item always has the same value in the document; where it has several, that of the most windows (of
equally many, the first) holds and the windows with another are dropped.  That finds a question again when its
numbers, names or units were changed, and not when the wording merely looks alike.  An item is in a
document if consistent alignments cover COVER of its windows.

An item of fewer than WINDOW tokens is one window of all its tokens, and documents are
looked up by windows of each size that occurs.  A window counts if at least LITERAL of its tokens (half of a
shorter window) are plain words.  An item of fewer than LEAST tokens, or without a window that counts, is found
by windows of its exact tokens (numbers, names and units as they stand).  Null or empty texts are clean.  Rows of the benchmark with a null item_id are left
out; rows that repeat an item_id are matched each on its own.  Every row of docs gives one row: rows that repeat an id or
a whole row, and rows without an id, are each judged by their own text.  Very long texts are judged whole; of
equally frequent values of a slot the one that comes first in the text holds.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WINDOW, LEAST, LITERAL, COVER = 8, 5, 4, 0.5
#: Bits of the filter for each window of the benchmark, and the most it has (32 MB); beyond that more windows pass it, and none is lost.
FILTER_BITS, FILTER_MOST = 32, 1 << 28
#: Bits that a window sets: one in 40,000 other windows passes.
FILTER_SETS = 6

# Words for units and for numbers, in English, German, French and Spanish.
UNITS = (
    "mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons mm cm m km inch inches foot feet ft yard yards "
    "mile miles meter meters metre metres ml l liter liters litre litres gallon gallons cup cups second seconds minute minutes min hour hours "
    "h day days week weeks month months year years cent cents dollar dollars euro euros percent degree degrees mph kmh kwh watt watts volt volts "
    "gramm kilogramm pfund tonne tonnen kilometer meile meilen sekunde sekunden minuten stunde stunden tag tage tagen woche wochen monat monate jahr jahre prozent grad "
    "gramme grammes kilogramme kilogrammes tonnes kilom\u00e8tre kilom\u00e8tres seconde secondes heure heures jour jours semaine semaines mois ann\u00e9e ann\u00e9es an ans pourcent degr\u00e9s "
    "gramo gramos kilogramo kilogramos tonelada toneladas kil\u00f3metro kil\u00f3metros metro metros litro litros segundo segundos minuto minutos hora horas d\u00eda d\u00edas semana semanas mes meses a\u00f1o a\u00f1os grados"
).split()
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion "
    "null eins zwei drei vier f\u00fcnf sechs sieben acht neun zehn elf zw\u00f6lf zwanzig drei\u00dfig vierzig f\u00fcnfzig hundert tausend "
    "z\u00e9ro deux trois quatre cinq sept huit neuf dix onze douze vingt trente quarante cinquante cent mille "
    "cero dos tres cuatro cinco seis siete ocho nueve diez once doce veinte treinta cuarenta cincuenta cien mil"
).split()

_BYTES = np.arange(256)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_CAPITAL = (_BYTES >= 65) & (_BYTES <= 90)
_ALNUM = _DIGIT | _CAPITAL | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
_LOWER = np.where(_CAPITAL, _BYTES + 32, _BYTES).astype(np.uint8)
_STOP = np.isin(_BYTES, [ord(c) for c in ".!?:"])
WORD, NUMBER, NAME, UNIT = 0, 1, 2, 3
_SLOT = np.array([0, 0x9D39247E33776D41, 0x2AF7398005AAA5C7, 0x44DB015024623547], np.uint64)


@dataclass
class Template:
    """Tokens of a block of texts: their hash with placeholders, their own hash, kind, place in the text's bytes, and each text's first token."""

    token: np.ndarray
    value: np.ndarray
    kind: np.ndarray
    at: np.ndarray


def _hash_all(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    buf = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(r) for r in raw])
    return np.sort(C.range_hash(C.prefix_hash(C.BYTE[buf]), ends - [len(r) for r in raw], ends))


_UNIT_HASHES, _NUMBER_HASHES = _hash_all(sorted(set(UNITS))), _hash_all(NUMBERS)


def _among(x: np.ndarray, names: np.ndarray) -> np.ndarray:
    return names[np.minimum(np.searchsorted(names, x), len(names) - 1)] == x


def canonical(buf: np.ndarray, offs: np.ndarray) -> Template:
    starts, ends, first = C.words_of(buf, offs)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    solid = np.flatnonzero(_ALNUM[buf])
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends) - 1
    has = a <= b
    stops = np.zeros(len(starts), bool)  # a sentence or a line ends before the word
    if len(starts):
        stops[0] = True
        lines = np.concatenate([[0], np.cumsum(buf == 10)])
        stops[1:] = _STOP[buf[ends[:-1] - 1]] | (lines[starts[1:]] > lines[ends[:-1]]) | (row[1:] != row[:-1])
    a, b, row, stops = solid[a[has]], solid[b[has]] + 1, row[has], stops[has]
    value = C.range_hash(C.prefix_hash(C.BYTE[_LOWER[buf]]), a, b)
    count = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    digits = count(_DIGIT[buf])
    capital = _CAPITAL[buf]
    if len(buf) > 1:
        capital[:-1] |= (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E)
    capitals = count(capital)
    number = _DIGIT[buf[a]] | ((digits[b] > digits[a]) & (b - a <= digits[b] - digits[a] + 2)) | _among(value, _NUMBER_HASHES)
    name = capital[a] & (capitals[b] - capitals[a] == 1) & ~stops & ~number
    unit = np.zeros(len(a), bool)
    unit[1:] = _among(value[1:], _UNIT_HASHES) & number[:-1] & (row[1:] == row[:-1])
    kind = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, WORD))).astype(np.uint8)
    token = np.where(kind == WORD, value, _SLOT[kind])
    return Template(token, value, kind, np.searchsorted(row, np.arange(len(offs))))


def windows(t: Template, size: int, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first token and text of every window of ``size`` tokens: of exact tokens, or of those with enough plain words."""
    many = np.maximum(np.diff(t.at) - size + 1, 0)
    first = C.runs_to_rows(t.at[:-1], many)
    row = np.repeat(np.arange(len(many)), many)
    if not exact:
        plain = np.concatenate([[0], np.cumsum(t.kind == WORD)])
        ok = plain[first + size] - plain[first] >= min(LITERAL, size // 2)
        first, row = first[ok], row[ok]
    return C.range_hash(C.prefix_hash(t.value if exact else t.token), first, first + size), first, row


def _mixed(h: np.ndarray, size: int, exact: bool) -> np.ndarray:
    """Windows of another size, or of exact tokens, are others."""
    with np.errstate(over="ignore"):
        return C.mix(h + C.U64(size * 2 + exact) * C.U64(0xD1342543DE82EF95)).astype(np.int64)


def _spread(t: Template, first: np.ndarray, size: int, exact: bool) -> list[pa.Array]:
    """For each window what must be equal, the values and the kinds of its tokens, as bytes."""
    at = first[:, None] + np.arange(size)
    arrays = []
    for x in (t.value if exact else t.token, t.value, t.kind):
        raw = x[at] if len(first) else np.empty((0, size), x.dtype)
        arrays.append(pa.array([r.tobytes() for r in raw], pa.binary()))
    return arrays


WINDOWS = "h long, same binary, values binary, kinds binary"


def item_windows(benchmark: DataFrame) -> DataFrame:
    """The windows of the benchmark's rows: WINDOWS, the item's row, its item_id, number of windows, size, exact, and the window's first token."""
    schema = f"{WINDOWS}, item_row long, item long, total int, size int, exact boolean, there int"
    slim = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).where("item_id is not null")

    def run(batches):
        from pyspark import TaskContext

        before = TaskContext.get().partitionId() << 36
        for batch in batches:
            buf, offs = C.flat(batch.column("text"))
            ids = C.longs(batch.column("item_id"))
            for i, j in C.blocks(offs, 1 << 18):
                t = canonical(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                long = np.minimum(np.diff(t.at), WINDOW)
                found = np.zeros(j - i, bool)
                for exact in (False, True):  # exact ones for items without a window that counts
                    todo = ~found
                    for size in np.unique(long[todo & (long >= (1 if exact else LEAST))]).tolist():
                        h, first, row = windows(t, size, exact)
                        own = todo[row] & (long[row] == size)
                        h, first, row = h[own], first[own], row[own]
                        found[row] = True
                        n = len(h)
                        number = np.cumsum(np.bincount(row, minlength=j - i))
                        total = np.diff(np.concatenate([[0], number]))[row]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(
                                    _mixed(h, size, exact)
                                ), *_spread(t, first, size, exact), pa.array(before + i + row), pa.array(ids[i + row]), pa.array(total.astype(np.int32)),
                                pa.array(np.full(n, size, np.int32)), pa.array(np.full(n, exact)), pa.array((first - t.at[row]).astype(np.int32)),
                            ],
                            names=["h", "same", "values", "kinds", "item_row", "item", "total", "size", "exact", "there"],
                        )
            before += batch.num_rows

    return C.cut(slim.mapInArrow(run, schema), "item-windows")


@dataclass
class Filter:
    """A Bloom filter of the windows' hashes (steps from the low bits by the high ones), and the windows' sizes."""

    bits: np.ndarray
    sizes: list[tuple[int, bool]]

    def passes(self, h: np.ndarray) -> np.ndarray:
        """Places of the hashes that pass."""
        mask = len(self.bits) * 64 - 1
        left, first, step = np.arange(len(h)), h & mask, ((h >> 32) | 1) & mask
        for k in range(FILTER_SETS):
            at = (first + k * step) & mask
            ok = (self.bits[at >> 6] >> (at & 63).astype(np.uint64)) & C.U64(1) == 1
            left, first, step = left[ok], first[ok], step[ok]
        return left


def window_filter(table: DataFrame) -> Filter:
    """Built by executors: words of 64 bits, of which at most FILTER_MOST / 64 reach the driver."""
    n = table.count()
    size = min(FILTER_MOST, 1 << max(10, int(n * FILTER_BITS).bit_length()))
    low, step = F.col("h").bitwiseAND(F.lit(size - 1)), F.shiftright("h", 32).bitwiseOR(F.lit(1)).bitwiseAND(F.lit(size - 1))
    places = table.select(F.explode(F.array(*((low + k * step).bitwiseAND(F.lit(size - 1)) for k in range(FILTER_SETS)))).alias("at"))
    words = places.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.uint64)
    bits[C.longs(words["word"].combine_chunks())] = C.longs(words["bits"].combine_chunks()).astype(np.uint64)
    return Filter(bits, sorted((r.size, r.exact) for r in table.select("size", "exact").distinct().collect()))


SKETCH = "row long, id long, tag long, windows binary"


def _passing(shared):
    """One row for each row of docs (id, tag, text): its number, and the windows that pass the filter."""

    def run(batches):
        from pyspark import TaskContext

        keep, row = shared.value, TaskContext.get().partitionId() << 36
        for batch in batches:
            buf, offs = C.flat(batch.column("text"))
            for i, j in C.blocks(offs, 1 << 20):
                t = canonical(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                held: list[list[tuple]] = [[] for _ in range(j - i)]
                for size, exact in keep.sizes:
                    h, first, own = windows(t, size, exact)
                    h = _mixed(h, size, exact)
                    hit = keep.passes(h)
                    for k, x, y, r in zip(h[hit].tolist(), first[hit].tolist(), t.at[own[hit]].tolist(), own[hit].tolist(), strict=True):
                        same = (t.value if exact else t.token)[x : x + size].tobytes()
                        held[r].append((k, x - y, same, t.value[x : x + size].tobytes(), t.kind[x : x + size].tobytes()))
                packs = [pickle.dumps(x) if x else None for x in held]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + j - i)), batch.column("id").slice(i, j - i), batch.column("tag").slice(i, j - i),
                        pa.array(packs, pa.binary())
                    ], names=["row", "id", "tag", "windows"]
                )
                row += j - i

    return run


def _unpacked(batches):
    for batch in batches:
        rows = [(r, *x) for r, pack in zip(batch.column("row").to_pylist(), batch.column("windows").to_pylist(), strict=True) for x in pickle.loads(pack)]
        for k in range(0, len(rows), 20_000):
            part = list(zip(*rows[k : k + 20_000], strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(part, kinds, strict=True)], names=["row", "h", "here", "d_same", "d_values", "d_kinds"]
            )


def decide(matches: Iterator[tuple]) -> tuple[list[int], list[int], int]:
    """Items found, those of them with changed slots, and the number of windows matched, from the matches of one text:

    (item's row, item, item's windows, there, here, the text's values and kinds, the item's values)."""
    groups: dict[tuple[int, int], list[tuple]] = defaultdict(list)
    for m in matches:
        groups[(m[0], m[4] - m[3])].append(m)
    covered: dict[tuple[int, int, int], set[int]] = defaultdict(set)
    changed: dict[tuple[int, int, int], bool] = defaultdict(bool)
    for members in groups.values():
        members.sort(key=lambda m: m[4])
        slots: dict[tuple[int, int], dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for k, (*_, values, kinds, theirs) in enumerate(members):
            for kind, own, other in zip(kinds.tolist(), values.tolist(), theirs.tolist(), strict=True):
                if kind != WORD:
                    slots[(kind, other)][own].add(k)
        dropped: set[int] = set()
        for values in slots.values():
            if len(values) > 1:
                best = max(values, key=lambda v: len(values[v]))
                dropped.update(*(ks for v, ks in values.items() if v != best))
        for k, (item_row, item, total, there, _, values, _, theirs) in enumerate(members):
            if k not in dropped:
                covered[(item_row, item, total)].add(there)
                changed[(item_row, item, total)] |= bool((values != theirs).any())
    whole = [x for x, places in covered.items() if len(places) >= COVER * x[2]]
    return sorted({x[1] for x in whole}), sorted({x[1] for x in whole if changed[x]}), sum(map(len, covered.values()))


FOUND = "row long, items array<long>, changed_items array<long>, n_matches long"


def _decided(batches):
    """Matches sorted by row: the rows of a text follow each other."""
    row, held, out = None, [], []

    def batch_of(out):
        row, items, changed, n = zip(*out, strict=True)
        lists = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(row, pa.int64()), pa.array(items, lists), pa.array(changed, lists), pa.array(n, pa.int64())],
            names=["row", "items", "changed_items", "n_matches"]
        )

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("row", "item_row", "item", "total", "there", "here", "d_values", "d_kinds", "values")]
        for r, item_row, item, total, there, here, values, kinds, theirs in zip(*columns, strict=True):
            if r != row:
                if held:
                    out.append((row, *decide(held)))
                row, held = r, []
            held.append(
                (
                    item_row, item, total, there, here, np.frombuffer(values, np.uint64), np.frombuffer(kinds, np.uint8),
                    np.frombuffer(theirs, np.uint64)
                )
            )
        if out:
            yield batch_of(out)
            out = []
    if held:
        yield batch_of([(row, *decide(held))])


def _search(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The numbered rows of docs (id, tag, text) as (row, id, tag), and what is found in them (FOUND; rows without a match are absent)."""
    spark = docs.sparkSession
    table = item_windows(benchmark)
    shared = spark.sparkContext.broadcast(window_filter(table))  # at most FILTER_MOST bits
    sketch = C.cut(docs.mapInArrow(_passing(shared), SKETCH), "passing")
    own = sketch.where("windows is not null").select("row", "windows").mapInArrow(
        _unpacked, "row long, h long, here int, d_same binary, d_values binary, d_kinds binary"
    )
    own = C.cut(own, "windows")
    n = C.partitions(spark)
    met = C.salted_join(own, table, "h", own.count(), "row", n).where("d_same = same")
    sorted_ = met.select("row", "item_row", "item", "total", "there", "here", "d_values", "d_kinds", "values").repartition(n, "row").sortWithinPartitions("row")
    return sketch.select("row", "id", "tag"), sorted_.mapInArrow(_decided, FOUND)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): contaminated, the items found (and those of them with changed slots), windows matched."""
    rows, found = _search(docs.select(F.col("doc_id").cast("long").alias("id"), F.lit(0).cast("long").alias("tag"), "text"), benchmark)
    none = F.array().cast("array<long>")
    out = rows.join(found, "row", "left").withColumn("items", F.coalesce("items", none))
    return out.select(
        F.col("id").alias("doc_id"), (F.size("items") > 0).alias("contaminated"), "items", F.coalesce("changed_items", none).alias("changed_items"), F.coalesce(
            "n_matches", F.lit(0).cast("long")
        ).alias("n_matches")
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item, with their own columns.

    A row is decided by its text alone, so rows are told apart by two hashes of it (96 bits)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumns({"__decontam_id": F.xxhash64(text), "__decontam_tag": F.crc32(text.cast("binary"))})
    rows, found = _search(keyed.select(F.col("__decontam_id").alias("id"), F.col("__decontam_tag").alias("tag"), "text"), benchmark)
    bad = rows.join(found.where(F.size("items") > 0).select("row"), "row", "left_semi").select(
        F.col("id").alias("__decontam_id"), F.col("tag").alias("__decontam_tag")
    )
    return C.without(keyed, bad, ["__decontam_id", "__decontam_tag"]).select(*docs.columns)


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
