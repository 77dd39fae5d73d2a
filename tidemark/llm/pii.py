"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The field's features of a word are its shape (digits, length, first and last character, marks inside), its spelling
for short cue words, and the shapes and cues of its neighbours. It is trained from a small labelled table (sentences as
words with a label each; :func:`labelled_sentences` builds one by rule) and decoded by Viterbi over whole documents,
all documents of a block in lockstep. Neighbouring words with one label form a span.

The patterns give the base spans, which stay as they are; a span of the field is added where it touches no base span.
Positions are code points, end exclusive.

Defined cases: a null text is an empty one and has no spans (redaction leaves it null); repeated rows get equal rows;
extra columns are ignored by :func:`find` and passed on by :func:`redact`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import chains
from tidemark.llm.words import SPACES, Words, lower_ascii, separator_table, text_blocks

# The base patterns' parts, the kinds in listing order, the labels of the field.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # digits before a match could only be part of a longer one
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
CUES = 512
EPOCHS = 60
RATE = 0.2
DECAY = {"shape": 1e-5, "cue": 1e-3, "marks": 1e-5}
_SEPARATORS = separator_table(SPACES)
_TRIM_LEFT, _TRIM_RIGHT = "\"'<[{,;:!?.|", "\"'>]},;:!?.|"


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses: from each ``@`` back over the local part and on over the domain."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            done = m.end()
            out.append((start, done))
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Kind, start, end of the fixed patterns, by kind as listed, then start."""
    out = [("email", s, e) for s, e in emails(text)]
    part = lambda p: len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(part(p) for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = _digits(m.group())
        if 13 <= len(d) <= 19 and _luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


@dataclass
class Model:
    shape: np.ndarray  # (shapes, labels), and the same for the words before and after
    cue: np.ndarray  # (CUES, labels), likewise
    marks: np.ndarray  # (mark sets, labels)
    transitions: np.ndarray
    start: np.ndarray


_DIGIT_STEPS, _LENGTH_STEPS = np.array([1, 2, 3, 4, 5, 7, 9, 11, 13, 16, 17, 20]), np.array([2, 3, 4, 5, 7, 9, 12, 15, 19, 25])
_SHAPES = (len(_DIGIT_STEPS) + 1) * (len(_LENGTH_STEPS) + 1) * 2
_MARKS = b"@.-()+:/["
_MARK_SETS = 1 << len(_MARKS)


def features(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shape, cue and mark set of every word; ``w`` has lower-case text."""

    def inside(flag: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flag, dtype=np.int32)))
        return sums[w.ends] - sums[w.starts]

    digits = inside((w.data >= 48) & (w.data <= 57))
    letters = inside(((w.data >= 97) & (w.data <= 122)) | (w.data >= 128))
    size = w.ends - w.starts
    shape = (np.searchsorted(_DIGIT_STEPS, digits, side="right") * (len(_LENGTH_STEPS) + 1) + np.searchsorted(_LENGTH_STEPS, size, side="right")) * 2 + (letters > 0)
    marks = np.zeros(len(size), np.int64)
    for k, c in enumerate(_MARKS):
        marks |= (inside(w.data == c) > 0).astype(np.int64) << k
    # Cue words are known by spelling, without the mark at the end; words with digits have no cue.
    end = np.where(size > 1, w.ends - np.isin(w.data[w.ends - 1], np.frombuffer(b".,:;!?", np.uint8)), w.ends) if len(size) else w.ends
    bare = Words.__new__(Words)
    bare.data, bare.starts, bare.ends = w.data, w.starts, end
    cue = np.where((digits == 0) & (size <= 12), bare.hashes() % np.uint64(CUES - 1) + np.uint64(1), np.uint64(0)).astype(np.int64)
    return shape, cue, marks


def _neighbours(x: np.ndarray, first: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    before, after = np.concatenate(([none], x[:-1]))[: len(x)], np.concatenate((x[1:], [none]))[: len(x)]
    full = np.diff(first) > 0
    before[first[:-1][full]] = none
    after[first[1:][full] - 1] = none
    return before, after


class _Rows:
    """Rows of the weight tables that a block's words use."""

    def __init__(self, w: Words) -> None:
        shape, cue, marks = features(w)
        near_shape, near_cue = _neighbours(shape, w.first, 0), _neighbours(cue, w.first, 0)
        self.shape = (shape, near_shape[0] + _SHAPES, near_shape[1] + 2 * _SHAPES)
        self.cue = (cue, near_cue[0] + CUES, near_cue[1] + 2 * CUES)
        self.marks = (marks,)

    def tables(self, m: Model):
        return (("shape", m.shape, self.shape), ("cue", m.cue, self.cue), ("marks", m.marks, self.marks))

    def emissions(self, m: Model) -> np.ndarray:
        return sum(table[rows] for _, table, parts in self.tables(m) for rows in parts)


def labelled_sentences(spark: SparkSession, sentences: int = 900, seed: int = 11) -> DataFrame:
    """The small labelled table: words array<string>, labels array<string>; made by rule from templates."""
    rng = np.random.default_rng(seed)
    syllables = "the and on er in th re at en or es ti an ing ly ha st nt sh of der die und ein ung keit lich que les ment oi ci do ra mente ó ñ é ü ß".split()
    pick = lambda x: x[int(rng.integers(len(x)))]
    number = lambda n: "".join(str(int(d)) for d in rng.integers(0, 10, n))
    hexa = lambda n: "".join("0123456789abcdef"[int(d)] for d in rng.integers(0, 16, n))
    word = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(1, 4))))
    ends = ["", "", "", "", ".", ",", "!!", "###", "%%%", "&&&", "$$$", "***", ":", ";", "?"]
    long = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(1, 13)))) + pick(ends)
    grouped = lambda sep: sep.join(number(4) for _ in range(4))
    ip = lambda: ".".join(str(int(x)) for x in rng.integers(0, 256, 4))
    made = {
        "email": [
            lambda: f"{word()}.{number(2)}@mail{number(1)}.example.com", lambda: f"{word()}@{word()}.org", lambda: f"{word()}[at]{word()}[dot]com",
            lambda: f"{word()}(at){word()}.net",
        ],
        "ip": [ip, lambda: ip() + ":8080"],
        "card": [lambda: number(16), lambda: number(16), lambda: number(16), lambda: grouped("-"), lambda: grouped(" "), lambda: grouped("."), lambda: number(15)],
        "phone": [
            lambda: f"+1 ({number(3)}) 555-{number(4)}", lambda: f"({number(3)}) 555-{number(4)}", lambda: f"{number(3)}-{number(3)}-{number(4)}",
            lambda: f"+{number(2)} {number(3)} {number(6)}", lambda: f"00{number(2)} {number(3)} {number(7)}",
        ],
        "other": [
            lambda: number(4), lambda: number(2) + "%", lambda: f"{number(1)},{number(3)}", lambda: f"{number(2)}.{number(2)}", lambda: f"20{number(2)}-0{number(1)}-1{number(1)}",
            lambda: f'token = "{hexa(40)}"', lambda: f"AKIA{hexa(16).upper()}", lambda: f"version {number(1)}.{number(1)}.{number(2)}", lambda: number(6), lambda: f"{word()}{number(2)}",
            lambda: f"section {number(1)}.{number(1)}", lambda: f"{word()}###", lambda: "|", lambda: f"{number(2)}:{number(2)}", lambda: f"https://{word()}.org/{number(3)}", lambda: hexa(12),
            lambda: number(1), long, lambda: " ".join([word() + "."] * 6), lambda: number(3), lambda: f"{word()} at {word()}", lambda: f"({word()})", lambda: f"{word()}-{word()}",
        ],
    }
    cues = {"email": ["mail", "email", "contact", "write to"], "ip": ["ip", "host", "address", "from"], "card": ["card", "visa", "pay with", "number"], "phone": ["phone", "call", "tel", "mobile"]}
    rows = []
    for _ in range(sentences):
        words: list[str] = []
        labels: list[str] = []
        for _ in range(int(rng.integers(1, 4))):
            plain = [long().upper() if rng.random() < 0.05 else long().capitalize() if rng.random() < 0.2 else long() for _ in range(int(rng.integers(0, 9)))]
            words += plain
            labels += ["other"] * len(plain)
            kind = pick(LABELS) if rng.random() < 0.8 else "other"
            if kind in cues and rng.random() < 0.4:
                cue = pick(cues[kind]).split() + ([":"] if rng.random() < 0.2 else [])
                words += cue
                labels += ["other"] * len(cue)
            item = pick(made[kind])().split(" ")
            if rng.random() < 0.2:
                item[-1] += pick([".", ",", ";"])
            words += item
            labels += [kind] * len(item)
        tail = [long() for _ in range(int(rng.integers(0, 6)))]
        rows.append((words + tail, labels + ["other"] * len(tail)))
    return spark.createDataFrame(rows, "words array<string>, labels array<string>")


def train(labelled: DataFrame, epochs: int = EPOCHS) -> Model:
    """Fits the field on the labelled table, which is small and collected whole; rows with nulls are left out."""
    rows = labelled.where("words IS NOT NULL AND labels IS NOT NULL AND size(words) = size(labels) AND size(words) > 0").select("words", "labels").collect()
    rows.sort()
    n = len(LABELS)
    m = Model(np.zeros((3 * _SHAPES, n)), np.zeros((3 * CUES, n)), np.zeros((_MARK_SETS, n)), np.zeros((n, n)), np.zeros(n))
    m.start[0] = m.shape[:, 0] = 0.1
    if not rows:
        return m
    raw = [" ".join(r["words"]).encode() for r in rows]
    w = Words(lower_ascii(np.frombuffer(b"".join(raw), np.uint8)), np.concatenate(([0], np.cumsum([len(r) for r in raw]))), _SEPARATORS)
    x, y, steps = _Rows(w), np.array([LABELS.index(k) for r in rows for k in r["labels"]]), chains.Adagrad(RATE)
    for _ in range(epochs):
        by_word, pairs, start = chains.gradient(x.emissions(m), w.first, m.transitions, m.start, y)
        for name, table, parts in x.tables(m):
            g = sum(np.stack([np.bincount(p, by_word[:, k], len(table)) for k in range(n)], axis=1) for p in parts)
            steps.step(name, table, g / len(y) + DECAY[name] * table)
        steps.step("t", m.transitions, pairs / len(y) + 1e-5 * m.transitions)
        steps.step("s", m.start, start / len(y) + 1e-5 * m.start)
    return m


def _field_spans(w: Words, m: Model) -> list[tuple[int, int, int, int]]:
    """Document, label, first byte and end byte of the labelled runs of words, in order."""
    y = chains.viterbi(_Rows(w).emissions(m).astype(np.float32), w.first, m.transitions.astype(np.float32), m.start.astype(np.float32)) if len(w.starts) else np.zeros(0, np.int64)
    marked = np.flatnonzero(y)
    if not len(marked):
        return []
    doc = np.searchsorted(w.first, marked, side="right") - 1
    new = np.flatnonzero(np.concatenate(([True], (np.diff(marked) != 1) | (np.diff(doc) != 0) | (np.diff(y[marked]) != 0))))
    last = np.append(new[1:], len(marked)) - 1
    return list(zip(doc[new].tolist(), y[marked[new]].tolist(), w.starts[marked[new]].tolist(), w.ends[marked[last]].tolist()))


def _spans(data: np.ndarray, offsets: np.ndarray, m: Model) -> list[list[tuple[str, int, int]]]:
    """Base spans, then the field's, of every document of a block."""
    looks = np.concatenate(([0], np.cumsum((data == 64) | ((data >= 48) & (data <= 57)))))[offsets]
    out: list[list[tuple[str, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    texts = {}
    for j in np.flatnonzero(np.diff(looks) > 0).tolist():
        texts[j] = data[offsets[j] : offsets[j + 1]].tobytes().decode()
        out[j] = base_spans(texts[j])
    w = Words(lower_ascii(data), offsets, _SEPARATORS)
    for j, label, a, b in _field_spans(w, m):
        body = data[offsets[j] : offsets[j + 1]].tobytes()
        start, found = len(body[: a - offsets[j]].decode()), body[a - offsets[j] : b - offsets[j]].decode()
        start += len(found) - len(found.lstrip(_TRIM_LEFT))
        found = found.lstrip(_TRIM_LEFT).rstrip(_TRIM_RIGHT)
        end = start + len(found)
        if found and not any(s < end and start < e for _, s, e in out[j]):
            out[j].append(("field-" + LABELS[label], start, end))
    for spans in out:
        spans.sort(key=lambda x: (_RANK[x[0]], x[1]))
    return out


_RANK = {k: i for i, k in enumerate([*KINDS, *["field-" + k for k in KINDS]])}
_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find(documents: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id and ``found``, spans (kind, start, end) by kind as listed, then start; the field's last."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_blocks(batch, "text"):
                found = [[{"kind": k, "start": s, "end": e} for k, s, e in spans] for spans in _spans(data, offsets, shared.value)]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(found, _FOUND)], ["doc_id", "found"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, found array<struct<kind:string,start:int,end:int>>")


def _redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in spans):
        if start >= at:
            out += [text[at:start], "<" + kind.removeprefix("field-").upper() + ">"]
        else:  # spans of two kinds overlap: the longer reach is hidden
            out.append("")
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(documents: DataFrame, model: Model) -> DataFrame:
    """The documents with every span of their text replaced by its kind in angle brackets; other columns as they are."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    place = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_blocks(batch, "text"):
                texts = rows.column(place).to_pylist()
                for j, spans in enumerate(_spans(data, offsets, shared.value)):
                    if spans:
                        texts[j] = _redacted(texts[j], spans)
                yield rows.set_column(place, "text", pa.array(texts, rows.schema.field(place).type))

    return documents.mapInArrow(run, documents.schema)
