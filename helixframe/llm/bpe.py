"""BPE encoding and decoding by batched numpy merge rounds.

Reads a tokenizer file in the JSON format of the ``tokenizers`` library (BPE with an end-of-word
suffix, NFC and lower case, words split by a pattern, byte-level alphabet, no decoder) and encodes
whole texts as that library does without special tokens added.

Method.  The distinct words of a batch lie in one flat array of symbol ids.  In each round the rank
of every neighbouring pair is found by binary search over the sorted pair keys (left id * size +
right id), each word's lowest-ranked pair (leftmost of equal ones) is merged everywhere in the word
from left to right, and the array is compacted; rounds end when no pair has a rank.  Words met
before in the same task come from a bounded memo, so the cost follows the distinct words.

Null texts are empty and have no tokens.  Every row is encoded by its own text, so rows that repeat an id or a whole row, and
rows without an id, each give a row; columns called like the results are replaced.  A very long text is encoded whole, in a
group of its own; of equally ranked pairs the leftmost is merged.  The strings of special tokens in a text are those tokens,
as in the library.  Decoding joins the tokens' own strings by one space, as the library does for a
file without a decoder.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that a task remembers before it forgets them all.
MEMO = 400_000
#: Texts are encoded in groups of about so many characters.
GROUP = 1_000_000


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if printable in Latin-1, else the next unused one from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Tokenizer:
    """Encodes and decodes; holds the pair ranks as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        self.size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.text = [""] * self.size
        for t, i in vocab.items():
            self.text[i] = t
        for t in spec["added_tokens"]:
            self.text[t["id"]] = t["content"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # White space is Unicode's property, as in the library's own pattern engine.
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"[^\s", r"[^\p{White_Space}"))
        letters = byte_alphabet()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        by = np.argsort(key, kind="stable")
        self.keys = key[by]
        self.rank = by.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        self.memo: dict[str, int] = {}
        self.ids: list[np.ndarray] = [np.empty(0, np.uint32)]
        self.start = np.zeros(1, np.int64)

    # -- words -----------------------------------------------------------------------------------

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has."""
        raw = [w.encode() for w in words]
        size = np.array([len(b) for b in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        ids = self.inner[data]
        ends = np.cumsum(size)
        full = size > 0
        ids[ends[full] - 1] = self.last[data[ends[full] - 1]]
        word = np.repeat(np.arange(len(words)), size)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        none = np.int64(len(self.made))
        while len(ids):
            key = ids[:-1] * self.size + ids[1:]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            hit = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank = np.append(np.where(hit, self.rank[at], none), none)
            begin = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, begin)
            count = np.diff(np.append(begin, len(ids)))
            finished = least == none
            if finished.any():  # these words have no pair left: put them aside
                out = np.repeat(finished, count)
                done.append((word[out], ids[out]))
                ids, word, rank = ids[~out], word[~out], rank[~out]
                least, count = least[~finished], count[~finished]
                if not len(ids):
                    break
            best = rank == np.repeat(least, count)
            # Of neighbouring equal pairs (aaa) every other is merged, from the left.
            run = np.flatnonzero(best)
            fresh = np.append(True, (np.diff(run) > 1))
            place = np.arange(len(run)) - np.maximum.accumulate(np.where(fresh, np.arange(len(run)), 0))
            left = run[place % 2 == 0]
            ids[left] = self.made[rank[left]]
            keep = np.ones(len(ids), bool)
            keep[left + 1] = False
            ids, word = ids[keep], word[keep]
        if not done:
            return np.empty(0, np.uint32), np.zeros(len(words), np.int64)
        word, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        by = np.argsort(word, kind="stable")
        return ids[by].astype(np.uint32), np.bincount(word, minlength=len(words))

    def _learn(self, words: list[str]) -> None:
        flat, count = self.encode_words(words)
        have = len(self.memo)
        self.memo.update(zip(words, range(have, have + len(words)), strict=True))
        old = self.start[have]
        self.ids.append(flat)
        self.start = np.concatenate([self.start[: have + 1], old + np.cumsum(count)])

    # -- texts -----------------------------------------------------------------------------------

    def normalized(self, text: str) -> str:
        """NFC, then lower case character by character (no final sigma)."""
        if not text.isascii():
            import unicodedata

            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def pieces(self, text: str) -> list[str]:
        """Words in order; special tokens as their own strings with a mark in front."""
        if self.split_special is None or "<|" not in text and not self.split_special.search(text):
            return self.words.findall(self.normalized(text))
        out: list[str] = []
        for i, part in enumerate(self.split_special.split(text)):
            if i % 2:
                out.append("\0" + part)
            else:
                out += self.words.findall(self.normalized(part))
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (uint32), and the n + 1 offsets of the texts."""
        if len(self.memo) > MEMO:
            self.memo, self.ids, self.start = {}, [np.empty(0, np.uint32)], np.zeros(1, np.int64)
        split = [self.pieces(t) for t in texts]
        known = self.memo
        new = set()
        for words in split:
            new.update(words)
        new = [w for w in new if w not in known]
        special = [w for w in new if w[0] == "\0" and w[1:] in self.special]
        if special:
            for w in special:
                have = len(known)
                known[w] = have
                self.ids.append(np.array([self.special[w[1:]]], np.uint32))
                self.start = np.append(self.start, self.start[-1] + 1)
            new = [w for w in new if w not in known]
        if new:
            self._learn(new)
        if len(self.ids) > 1:
            self.ids = [np.concatenate(self.ids)]
        flat = self.ids[0]
        count = np.array([len(w) for w in split], np.int64)
        get = known.__getitem__
        index = np.fromiter((get(w) for words in split for w in words), np.int64, int(count.sum()))
        first, size = self.start[index], self.start[index + 1] - self.start[index]
        total = np.cumsum(size)
        n = int(total[-1]) if len(total) else 0
        at = np.arange(n) + np.repeat(first - (total - size), size)
        offs = np.concatenate([[0], total])[np.concatenate([[0], np.cumsum(count)])] if len(total) else np.zeros(len(texts) + 1, np.int64)
        return flat[at], offs

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.text.__getitem__, ids.tolist()))


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    """One for each file and worker."""
    return Tokenizer(path)


def _groups(texts: list[str]):
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= GROUP):
            size += len(texts[j])
            j += 1
        yield i, j
        i = j


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a column of token ids (array of int); a clashing column of that name is replaced."""
    docs = docs.drop(ids)

    def run(batches):
        tok = tokenizer(path)
        for batch in batches:
            texts = [x or "" for x in batch.column(text).to_pylist()]
            for i, j in _groups(texts):
                flat, offs = tok.encode(texts[i:j])
                part = batch.slice(i, j - i)
                array = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, array], names=[*part.schema.names, ids])

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """docs with the decoded text of an array of ids (null: null)."""
    docs = docs.drop(text)

    def run(batches):
        tok = tokenizer(path)
        for batch in batches:
            column = batch.column(ids)
            out = [tok.decode(np.asarray(x.values)) if x.is_valid else None for x in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, text])

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(text, T.StringType())]))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the decoded text; both are made and digested batch by batch."""

    def run(batches):
        tok = tokenizer(path)
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for i, j in _groups(texts):
                flat, offs = tok.encode(texts[i:j])
                own = [flat[a:b] for a, b in zip(offs[:-1], offs[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i),
                        pa.array(np.diff(offs).astype(np.int64)),
                        pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in own], pa.string()),
                        pa.array([hashlib.sha256(tok.decode(x).encode()).hexdigest() for x in own], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path())
