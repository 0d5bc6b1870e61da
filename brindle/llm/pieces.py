"""Encoding and decoding with a sentencepiece vocabulary of merge type.

A text becomes symbols, one a character, after each space has turned into the space mark and one mark has been put before it
all. Adjacent symbols whose concatenation is a piece are on an agenda, the highest score first, the leftmost among equals;
taking one merges it and puts the new neighbours on the agenda, until the agenda is empty. What is no piece then is spelt in
byte pieces.

No piece of such a vocabulary holds a space mark behind another character, which is checked when it is loaded. Merges hence
never cross the start of a run of marks, so a text is cut there and each stretch solved once in a process while it is
remembered. In each Arrow batch the stretches solved there are compared, ids and decoded text, with the sentencepiece library.
"""

from __future__ import annotations

import functools
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .shared import bounded_batches

#: Fixed value: the mark that stands for a space in pieces.
MARK = "▁"
#: Stretches of a generation, of which a process remembers two, and the longest remembered; others are solved anew. Bounds memory, not results.
REMEMBERED, LONGEST = 450_000, 64
_STRETCH = re.compile(f"{MARK}+[^{MARK}]*")


class Vocabulary:
    """Pieces of a model file, by the library's own reading of it."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [lib.id_to_piece(i) for i in range(lib.get_piece_size())]
        normal = [i for i in range(len(names)) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
        if any(lib.is_unused(i) for i in normal):
            raise ValueError(f"{path}: unused pieces are not supported")
        self.ids = {names[i]: i for i in normal}
        self.cost = {names[i]: -lib.get_score(i) for i in normal}
        if any(MARK in name.lstrip(MARK) for name in self.ids):
            raise ValueError(f"{path}: a piece holds a space mark behind another character")
        byte = {names[i]: i for i in range(len(names)) if lib.is_byte(i)}
        self.bytes = [byte.get(f"<0x{b:02X}>") for b in range(256)]
        if None in self.bytes:
            raise ValueError(f"{path}: no byte pieces to fall back on")
        spelt = [n.replace(MARK, " ").encode() for n in names]
        for b, i in enumerate(self.bytes):
            spelt[i] = bytes([b])
        self.spelt = np.frombuffer(b"".join(spelt), np.uint8)
        self.sizes = np.array([len(x) for x in spelt], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The symbols that are left of ``text`` (marks for spaces) when the agenda is empty."""
        symbol: list[str | None] = list(text)
        n = len(symbol)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        cost = self.cost
        agenda = [(c, i, pair) for i in range(n - 1) if (c := cost.get(pair := symbol[i] + symbol[i + 1])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            left = symbol[i]
            j = after[i]
            if left is None or j >= n or len(left) + len(symbol[j]) != len(pair):
                continue  # one of the two has been merged otherwise since
            symbol[i], symbol[j] = pair, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (c := cost.get(new := pair + symbol[k])) is not None:
                    heapq.heappush(agenda, (c, i, new))
            if (k := before[i]) >= 0 and (c := cost.get(new := symbol[k] + pair)) is not None:
                heapq.heappush(agenda, (c, k, new))
        return [s for s in symbol if s is not None]

    def solved(self, text: str) -> list[int]:
        symbols = self.merged(text)
        out = list(map(self.ids.get, symbols))
        if None not in out:
            return out
        return [k for s, i in zip(symbols, out) for k in ([i] if i is not None else [self.bytes[b] for b in s.encode()])]

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The pieces' text in UTF-8, marks as spaces, and where each id's part ends in it."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.spelt[at].tobytes(), ends

    def learn(self, stretches: list[str]) -> dict[str, bytes]:
        """The ids (int32) of stretches not known so far. The library has to give them, and their text, too."""
        mine = [self.solved(s) for s in stretches]
        plain = [s[1:].replace(MARK, " ") for s in stretches]  # the library puts the first mark itself
        theirs = self.library.encode(plain, num_threads=1)
        if mine != theirs:
            for a, b, p in zip(mine, theirs, plain):
                # The library gives no ids for an empty text, which a lone first mark would be; such a stretch follows another text.
                if p and a != b:
                    raise ValueError(f"the sentencepiece library encodes {p[:200]!r} as {b[:50]}, not {a[:50]}")
        flat = [i for ids in mine for i in ids]
        read = self.decode(np.array(flat, np.int32))[0].decode()
        if read[1:] != self.library.decode(flat):
            raise ValueError(f"the sentencepiece library decodes another text than {read[:200]!r}")
        return {s: array("i", a).tobytes() for s, a in zip(stretches, mine)}

    def found(self, stretches: set[str]) -> dict[str, bytes]:
        """``learn`` of those among ``stretches`` that the older generation does not know either; all of them become known."""
        older = self.older.get
        out = {s: v for s in stretches if (v := older(s)) is not None}
        out |= self.learn([s for s in stretches if s not in out])
        if len(self.known) + len(out) > REMEMBERED:
            self.known, self.older = {}, self.known
        self.known.update((s, v) for s, v in out.items() if len(s) <= LONGEST)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids (int32) of each text; an empty text has none."""
        cut = [_STRETCH.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        held = [list(map(self.known.get, stretches)) for stretches in cut]
        gaps = [(k, i) for k, have in enumerate(held) if None in have for i, v in enumerate(have) if v is None]
        fresh = self.found({cut[k][i] for k, i in gaps}) if gaps else {}
        for k, i in gaps:
            held[k][i] = fresh[cut[k][i]]
        return list(map(b"".join, held))


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encoded(docs: DataFrame, model: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each row of ``docs`` (key, text) as (key, ids array<int>, decoded string), without begin and end ids, no sampling.

    ``model`` is the path of a vocabulary that every executor can read. A stretch for which the library gives other ids or
    another text ends the job with an error that shows it. Null and empty texts have no ids and decode to the empty text.
    Rows are independent: repeated rows stay, an empty table gives an empty one. Texts are taken whole, some megabytes at a
    time. Other columns, whatever their names, are not read.
    """
    bounded_batches(docs.sparkSession)
    only = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for batch in batches:
            raw = batch.column(1).cast(pa.large_binary())
            for at, texts in words.grouped(x.as_py() for x in raw):
                made = vocab.encode([t.decode() for t in texts])
                flat = np.frombuffer(b"".join(made), np.int32)
                ends = np.cumsum([0] + [len(i) // 4 for i in made])
                data, places = vocab.decode(flat)
                places = np.concatenate([[0], places])[ends]
                # A text begins with the mark put before it, which is one byte here.
                plain = pa.array([data[a + 1 : b] for a, b in zip(places, places[1:])], pa.binary()).cast(pa.string())
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), ids, plain], ["key", "ids", "decoded"])

    kind = docs.schema[key].dataType.simpleString()
    return only.mapInArrow(run, f"key {kind}, ids array<int>, decoded string").withColumnRenamed("key", key)


def written(ids: Column) -> Column:
    """Decimal ids joined by commas."""
    return F.array_join(ids.cast("array<string>"), ",")
