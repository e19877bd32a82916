"""Operator 1, byte-level BPE: merges run as DuckDB recursive queries, one connection a worker.

Encoding: the pattern's matches are the words of a text. A recursive query holds one row for each
token and position of a word, joins neighbours to the merge table, takes each word's leftmost pair
of least rank and contracts it, until no word has a pair left. Each distinct word of a batch goes
through the query once. Decoding: token rows join the vocabulary and an ordered aggregation puts
the bytes of each document together.

A word of over LONG_WORD bytes would need as many rounds as it has merges, each over the whole
word; such words take the same merges from a heap instead, in n log n steps.

Memory: a batch holds at most BATCH_CHARS characters or one document; remembered words are bounded
by WORDS_KEPT; DuckDB has MEMORY and spills below the worker's own temporary folder.

Defined cases: null text is empty and has no tokens; rows with equal or null ids are encoded each
by themselves; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import tempfile
from collections.abc import Iterator
from functools import cache
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import slim

#: Bytes. The recursive query takes a round a merge and keeps every round's rows, so it grows with the square of a word.
LONG_WORD = 1024
BATCH_CHARS = 1_500_000
WORDS_KEPT = 500_000
MEMORY = "200MB"

CONTRACT = """
with recursive s(w, p, t, round) as (
  select w, p, t, 0 from seed
  union all
  (with pairs as (
     select a.w, a.p, m.t from s a join s b on a.w = b.w and b.p = a.p + 1 join merges m on m.l = a.t and m.r = b.t),
   best as (
     select w, min(t::bigint * 4096 + p) as least from pairs group by w)
   select s.w, case when s.p > least % 4096 then s.p - 1 else s.p end,
     case when s.p = least % 4096 then (least // 4096)::int else s.t end, s.round + 1
   from s join best on s.w = best.w where s.p <> least % 4096 + 1))
select w, p, t from s join (select w, max(round) as round from s group by w) using (w, round) order by w, p
"""
DECODE = "select d, array_to_string(list(piece order by p), '') as piece from batch join vocab using (t) group by d"


class Numbers(dict):
    """Words by number; a word asked for the first time gets the next one and is noted as fresh."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        return n


class Column:
    """An array that grows at its end."""

    def __init__(self, kind: type) -> None:
        self.held, self.size = np.zeros(1024, kind), 0

    def append(self, values: np.ndarray) -> None:
        size = self.size + len(values)
        if size > len(self.held):
            self.held = np.concatenate([self.held, np.zeros(size, self.held.dtype)])
        self.held[self.size : size] = values
        self.size = size

    def all(self) -> np.ndarray:
        return self.held[: self.size]


class Codec:
    """One vocabulary, made once a worker process; as a context it has a DuckDB connection."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import duckdb
        import regex

        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.find = regex.compile(pattern).findall
        self.pieces = {t: b for b, t in self.ranks.items()}
        self.byte_ids = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        triples = [
            (self.ranks[b[:k]], self.ranks[b[k:]], t)
            for b, t in self.ranks.items()
            for k in range(1, len(b))
            if b[:k] in self.ranks and b[k:] in self.ranks
        ]
        l, r, t = (np.array(x, np.int32) for x in zip(*triples, strict=True))
        # Bytes stand as the characters of the same number; DuckDB strings hold no zero, so it is 256.
        ids = sorted(self.pieces)
        pieces = pa.array([self.pieces[i].decode("latin-1").replace("\0", "Ā") for i in ids])
        self.tables = {"merges": {"l": l, "r": r, "t": t}, "vocab": {"t": np.array(ids, np.int32), "piece": pieces}}
        self.connect = duckdb.connect
        self._forget()

    def __enter__(self) -> Codec:
        """Connect for one task."""
        self.folder = tempfile.TemporaryDirectory(prefix="bpe-")
        self.db = self.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": self.folder.name})
        for name, columns in self.tables.items():
            self._load(name, **columns)
        return self

    def __exit__(self, *_: object) -> None:
        """A worker that waits for its next task holds neither words nor DuckDB's memory."""
        self.db.close()
        self.folder.cleanup()
        self._forget()

    def _load(self, name: str, **columns: Any) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"create or replace table {name} as select * from given")
        self.db.unregister("given")

    def _heap(self, word: bytes) -> tuple[int, ...]:
        """The same merges for a long word: least rank first, then leftmost."""
        n = len(word)
        token = [self.ranks[bytes([b])] for b in word]
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        alive = [True] * n

        def offer(i: int) -> None:
            j = end[i]
            if j < n and (t := self.ranks.get(word[i : end[j]])) is not None:
                heapq.heappush(heap, (t, i, j, end[j]))

        heap: list[tuple[int, int, int, int]] = []
        for i in range(n - 1):
            offer(i)
        while heap:
            t, i, j, stop = heapq.heappop(heap)
            if not (alive[i] and j < n and alive[j] and end[i] == j and end[j] == stop):
                continue
            token[i], end[i], alive[j] = t, stop, False
            if stop < n:
                before[stop] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return tuple(token[i] for i in range(n) if alive[i])

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each has: whole tokens at once, others by the query."""
        out: list[tuple[int, ...] | list[int]] = [()] * len(words)
        rest, raw = [], []
        for i, word in enumerate(words):
            b = word.encode("utf-8", "surrogatepass")
            if (t := self.ranks.get(b)) is not None:
                out[i] = (t,)
            elif len(b) > LONG_WORD:
                out[i] = self._heap(b)
            else:
                rest.append(i)
                raw.append(b)
        if rest:
            sizes = np.array([len(b) for b in raw], np.int64)
            starts = np.cumsum(sizes) - sizes
            w = np.repeat(np.arange(len(raw), dtype=np.int32), sizes)
            p = (np.arange(sizes.sum()) - np.repeat(starts, sizes)).astype(np.int32)
            self._load("seed", w=w, p=p, t=self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)])
            found = self.db.sql(CONTRACT).to_arrow_table()
            ids = found["t"].to_numpy().tolist()
            ends = np.searchsorted(found["w"].to_numpy(), np.arange(len(raw)), "right").tolist()
            at = 0
            for i, stop in zip(rest, ends, strict=True):
                out[i] = ids[at:stop]
                at = stop
        counts = np.array([len(x) for x in out], np.int64)
        return np.array([t for x in out for t in x], np.int32), counts

    def _know(self) -> None:
        """Learn the words that were met first in this batch."""
        if not self.numbers.fresh:
            return
        ids, counts = self.learn(self.numbers.fresh)
        self.numbers.fresh = []
        digits = list(map(str, ids.tolist()))
        ends = np.cumsum(counts).tolist()
        self.digits.extend(" ".join(digits[e - n : e]) for e, n in zip(ends, counts.tolist(), strict=True))
        self.ids.append(ids)
        self.counts.append(counts)

    def _forget(self) -> None:
        self.numbers = Numbers()
        self.digits: list[str] = []
        self.ids, self.counts = Column(np.int32), Column(np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """All ids, the end of each text in them, and the ids of each text as decimal digits."""
        if len(self.numbers) > WORDS_KEPT:
            self._forget()
        number = self.numbers.__getitem__
        numbers = [list(map(number, self.find(t))) for t in texts]
        self._know()
        digit = self.digits.__getitem__
        joined = [" ".join(map(digit, x)) for x in numbers]
        words_end = np.cumsum([0, *map(len, numbers)])
        flat = np.fromiter(chain.from_iterable(numbers), np.int64, words_end[-1])
        counts = self.counts.all()[flat]
        stops = np.cumsum(counts)
        all_counts = self.counts.all()
        firsts = (np.cumsum(all_counts) - all_counts)[flat]
        ids = self.ids.all()[np.repeat(firsts - stops + counts, counts) + np.arange(counts.sum())]
        return ids, np.concatenate([[0], stops])[words_end[1:]].astype(np.int64), joined

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes of each run of ids."""
        d = np.repeat(np.arange(len(ends), dtype=np.int32), np.diff(ends, prepend=0))
        self.db.register("batch", pa.table({"d": d, "p": np.arange(len(ids), dtype=np.int32), "t": ids}))
        found = self.db.sql(DECODE).to_arrow_table()
        self.db.unregister("batch")
        out = [b""] * len(ends)
        for d, piece in zip(found["d"].to_pylist(), found["piece"].to_pylist(), strict=True):
            out[d] = piece.replace("Ā", "\0").encode("latin-1")
        return out


@cache
def codec(ranks_path: str, pattern: str) -> Codec:
    return Codec(ranks_path, pattern)


def slices(texts: list[str], most: int) -> Iterator[slice]:
    """Runs of texts of at most ``most`` characters, or one text."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > most:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def encoded(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): every text as an array of token ids."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec(ranks_path, pattern) as c:
            for batch in slim(batches):
                texts = [t or "" for t in batch["text"].to_pylist()]
                for part in slices(texts, BATCH_CHARS):
                    ids, ends, _ = c.encode(texts[part])
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids))
                    yield pa.RecordBatch.from_arrays([batch["id"][part.start : part.stop], lists], ["id", "ids"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", key)


def decoded(tokens: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, bytes): every array of ids as the bytes it stands for; null ids decode to no bytes."""
    rows = tokens.select(F.col(key).alias("id"), F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec(ranks_path, pattern) as c:
            for batch in batches:
                lists = batch["ids"]
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
                ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([batch["id"], pa.array(c.decode(flat, ends), pa.binary())], ["id", "bytes"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, bytes binary").withColumnRenamed("id", key)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): every text encoded, and its ids decoded again."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with codec(ranks_path, pattern) as c:
            for batch in slim(batches):
                texts = [t or "" for t in batch["text"].to_pylist()]
                for part in slices(texts, BATCH_CHARS):
                    ids, ends, joined = c.encode(texts[part])
                    back = c.decode(ids, ends)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch["id"][part.start : part.stop],
                            pa.array(np.diff(ends, prepend=0), pa.int64()),
                            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in joined]),
                            pa.array([hashlib.sha256(x).hexdigest() for x in back]),
                        ],
                        ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
                    )

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", key)
