"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The words of a block that were not met before are laid out in one flat symbol array. In each round every word finds
its lowest-rank pair, by binary search of its pair keys among the sorted keys of all merges, and merges all its
occurrences; ranks are looked up again only next to a merge, and finished words leave the arrays. Documents are then
rows of word numbers, and their ids and decoded bytes are gathers.

The tokenizer file is read once on the driver and its tables (a fixed size, a few MB) are broadcast.

Defined cases: a null text is an empty one, with no ids and an empty decoded text; the file's added tokens found in a
text become their ids, as its library does; repeated rows get equal rows; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.words import text_blocks

# Fixed value: how byte-level BPE splits a text into words before merging.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
KEEP_WORDS = 100_000
_NONE = np.int32(2**31 - 1)


def _printable_bytes() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tables:
    """Numpy tables of one byte-level BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, to_byte = spec["model"]["vocab"], _printable_bytes()
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.size = max([*vocab.values(), *self.added.values()]) + 1
        texts = [b""] * self.size
        for token, i in vocab.items():
            texts[i] = bytes(to_byte[c] for c in token)
        for token, i in self.added.items():
            texts[i] = token.encode()
        self.token_bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.token_at = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        self.of_byte = np.zeros(256, np.int32)
        for c, b in to_byte.items():
            self.of_byte[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and the number of ids of each word."""
        lengths = np.array([len(w) for w in words], np.int64)
        symbols = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        ranks = self._ranks_of(symbols, word)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            least = np.minimum.reduceat(ranks, first)
            size = np.diff(np.append(first, len(word)))
            active = np.repeat(least < _NONE, size)
            if not active.all():
                done.append((word[~active], symbols[~active]))
                symbols, word, ranks = symbols[active], word[active], ranks[active]
                least, size = least[least < _NONE], size[least < _NONE]
                if not len(symbols):
                    break
            hit = np.flatnonzero(ranks == np.repeat(least, size))
            # Of overlapping pairs (a symbol with itself, in a row) the first, third, ... merge.
            run = np.cumsum(np.concatenate(([True], np.diff(hit) != 1)))
            hit = hit[(np.arange(len(hit)) - np.searchsorted(run, run)) % 2 == 0]
            symbols[hit] = self.merged[ranks[hit]]
            stay = np.ones(len(symbols), bool)
            stay[hit + 1] = False
            at = hit - np.arange(len(hit))  # places after the second halves are gone
            symbols, word, ranks = symbols[stay], word[stay], ranks[stay]
            again = np.union1d(at, at[at > 0] - 1)
            ranks[again] = self._ranks_at(symbols, word, again)
        if done:
            word, symbols = (np.concatenate(x) for x in zip(*done))
            order = np.argsort(word, kind="stable")
            word, symbols = word[order], symbols[order]
        return symbols, np.bincount(word, minlength=len(words))

    def _ranks_of(self, symbols: np.ndarray, word: np.ndarray) -> np.ndarray:
        return self._ranks_at(symbols, word, np.arange(len(symbols)))

    def _ranks_at(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.full(len(at), _NONE, np.int32)
        inner = np.flatnonzero(at + 1 < len(symbols))
        inner = inner[word[at[inner]] == word[at[inner] + 1]]
        out[inner] = self.rank(symbols[at[inner]], symbols[at[inner] + 1])
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, one after another."""
        start, n = self.token_at[ids], np.diff(self.token_at)[ids]
        return self.token_bytes[_spread(start, n)]


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (n[0] of them), start[1], ..."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Encoder:
    """Encodes documents; keeps the ids of words met before, up to ``KEEP_WORDS``."""

    def __init__(self, tables: Tables) -> None:
        self.tables = tables
        self.added = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(tables.added, key=len, reverse=True)) + ")") if tables.added else None
        self._clear()

    def _clear(self) -> None:
        self.row: dict[str, int] = {}
        self.ids, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)
        for token, i in self.tables.added.items():  # an added token is found as the tuple of itself, never as a word
            self._append([(token,)], np.array([i], np.int32), np.ones(1, np.int64))

    def _append(self, words: list, ids: np.ndarray, n: np.ndarray) -> None:
        for w in words:
            self.row[w] = len(self.row)
        self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(n)))
        self.ids = np.concatenate((self.ids, ids))

    def words(self, text: str) -> list:
        if self.added is None or not self.added.search(text):
            return SPLIT.findall(text)
        out: list = []
        for k, part in enumerate(self.added.split(text)):
            out += [(part,)] if k % 2 else SPLIT.findall(part)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's ids begin and end."""
        lists = [self.words(t) for t in texts]
        new = [w for w in set().union(*lists) if w not in self.row]
        if len(self.row) + len(new) > KEEP_WORDS:
            self._clear()
            new = [w for w in set().union(*lists) if w not in self.row]
        if new:
            self._append(new, *self.tables.encode_words([w.encode() for w in new]))
        rows = np.fromiter((self.row[w] for words in lists for w in words), np.int64, sum(map(len, lists)))
        n = np.diff(self.at)[rows]
        ids = self.ids[_spread(self.at[rows], n)]
        ends = np.concatenate(([0], np.cumsum(n)))
        return ids, ends[np.concatenate(([0], np.cumsum([len(x) for x in lists])))]


def round_trip(documents: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, ids (of the whole text), decoded (the text of the ids)."""
    shared = documents.sparkSession.sparkContext.broadcast(Tables(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for rows, data, offsets in text_blocks(batch, "text", 1 << 20):
                whole, at = data.tobytes(), offsets.tolist()
                ids, ends = encoder.encode([whole[a:b].decode() for a, b in zip(at, at[1:])])
                raw = shared.value.decode(ids)
                sizes = np.concatenate(([0], np.cumsum(np.diff(shared.value.token_at)[ids])))[ends]
                texts = pa.array([raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(sizes.tolist(), sizes[1:].tolist())], pa.string())
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)), texts], ["doc_id", "ids", "decoded"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, ids array<int>, decoded string")
