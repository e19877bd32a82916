"""Operator 8, suffix-array dedup: removes every byte under a WINDOW-byte string that also starts elsewhere.

1. Anchors (``anchors``) cut the starts of each text into runs. Windows can only be equal under
   anchors with one gram, so runs whose gram comes once in the corpus are done.
2. A region is the bytes that the windows of a run cover. Equal regions collapse to one with a
   mark: if it comes twice, all its windows are repeated.
3. Of grams with several regions, one copy of each region goes to the shard of its gram. There a
   suffix array, built by external induced sorting (``induced``), puts equal windows side by side;
   neighbours are compared byte by byte. A shard is worked through in pieces of whole grams.
4. A gram with over HOT regions would make one task take them all. Its regions are cut into parts of
   fewer starts at fixed distances from the anchor (STEPS, coarse to fine); equal windows lie in
   parts whose core, the bytes that all windows of the part hold, is equal. So the core stands for
   the gram from then on: parts are collapsed, sorted in shards, or, under a core that is still
   hot, cut again. A part of one start is its own core, so equal ones collapse and none stays hot.
5. Found starts become byte spans of every text that has the region; copies of a whole text are
   removed whole. Each text is cut once.

Strings are judged on the input, never across texts. Defined cases: null text is empty; texts
shorter than the window lose nothing unless they are never compared at all; equal rows count as
several texts, so they repeat each other; null ids are allowed; other columns are not read (or, in
``cut``, passed through); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm import anchors, induced
from tidewright.llm.common import free_prefix, kept, partitions, slim, text_of

WINDOW = anchors.WINDOW
#: A gram or core with more distinct regions or parts than this, about what fills a piece, is cut finer.
HOT = 1500
#: Starts of one part of a hot region, coarse to fine.
STEPS = (100, 25, 6, 1)
#: Bytes of regions whose suffixes are sorted together.
PIECE = 1 << 21
#: What tells a region (of a gram) or a part (of a core) from others.
RID = ["gram", "r1", "r2"]


def _pair(raw: bytes, seed: int = 0) -> tuple[int, int]:
    """A 128-bit hash as two signed longs."""
    h = xxhash.xxh3_128_intdigest(raw, seed & 0xFFFFFFFFFFFFFFFF)
    low, high = h & 0xFFFFFFFFFFFFFFFF, h >> 64
    return low - (low >> 63 << 64), high - (high >> 63 << 64)


def hashed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, text, h1, h2): the text and its 128-bit hash."""
    own = docs.select(F.col(key).alias("id"), text_of(text).alias("text"))
    return own.select("id", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), F.col("text")).alias("h2"))


def runs(texts: DataFrame, window: int) -> DataFrame:
    """(h1, h2, gram, r1, r2, places, n, rel): the regions of each text with the places where they start.

    rel is the anchor's place in the region. A region that a text repeats, as periodic text does, is
    one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slim(batches):
            rows = []
            for h1, h2, t in zip(batch["h1"].to_pylist(), batch["h2"].to_pylist(), batch["text"], strict=True):
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                if len(raw) < window:
                    continue
                own: dict[tuple[int, ...], list[int]] = {}
                g, a, s0, s1 = anchors.runs(raw, window)
                for gram, rel, x, y in zip(g.view(np.int64).tolist(), (a - s0).tolist(), s0.tolist(), s1.tolist(), strict=True):
                    own.setdefault((gram, *_pair(raw[x : y + window], rel), y - x + 1, rel), []).append(x)
                rows += [(h1, h2, *k[:3], places, *k[3:]) for k, places in own.items()]
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())] + [pa.int32()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["h1", "h2", *RID, "places", "n", "rel"])

    schema = "h1 long, h2 long, gram long, r1 long, r2 long, places array<int>, n int, rel int"
    return texts.select("h1", "h2", "text").mapInArrow(run, schema)


def repeated_starts(regions: list[bytes], starts: list[int], folder: str, window: int) -> np.ndarray:
    """Marks over the bytes of all regions, each followed by one more: starts whose window starts elsewhere too.

    The first ``starts[i]`` bytes of region i are starts.
    """
    raw = b"".join(r + b"\0" for r in regions)
    sizes = np.array([len(r) + 1 for r in regions])
    ends = np.cumsum(sizes)
    t = np.frombuffer(raw, np.uint8).astype(np.uint16) + 1
    t[ends - 1] = 0
    edge = np.zeros(len(raw) + 1, np.int32)
    edge[ends - sizes] += 1
    np.add.at(edge, ends - sizes + np.array(starts), -1)
    start = np.cumsum(edge[:-1]) > 0
    sa = induced.suffix_array(t, folder)
    order = np.array(sa)
    order = order[start[order]]
    a, b = order[:-1], order[1:]
    raw += b"\0" * 8
    words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    # Eight bytes at a time; the last eight may overlap those before.
    for k in [*range(0, window - 7, 8), window - 8]:
        same = words[a + k] == words[b + k]
        a, b = a[same], b[same]
    marks = np.zeros(len(raw), bool)
    marks[a] = marks[b] = True
    return marks


def spans_of(marks: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of marks."""
    d = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(d == 1).tolist(), (np.flatnonzero(d == -1) - 1).tolist(), strict=True))


FOUND = "gram long, r1 long, r2 long, low int, high int"
#: A region or part: its key (gram or core) and hash, the region that it belongs to, the place of its
#: first start and the number of starts there, whether its windows are known to be repeated, its bytes.
PART = "key1 long, key2 long, h1 long, h2 long, gram long, r1 long, r2 long, rel int, low int, n int, dup boolean, raw binary"
PART_COLUMNS = [c.split()[0] for c in PART.split(", ")]
_PART_KINDS = [pa.int64()] * 7 + [pa.int32()] * 3 + [pa.bool_(), pa.binary()]


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def sorted_shards(parts: DataFrame, window: int) -> DataFrame:
    """Repeated starts of the parts of each key, by suffix arrays: (gram, r1, r2, low, high)."""

    def work(rows: list[dict]) -> pa.RecordBatch:
        with tempfile.TemporaryDirectory(prefix="induced-") as folder:
            marks = repeated_starts([x["raw"] for x in rows], [x["n"] for x in rows], folder, window)
        out, at = [], 0
        for x in rows:
            if not x["dup"]:
                out += [(*(x[c] for c in RID), x["low"] + low, x["low"] + high) for low, high in spans_of(marks[at : at + x["n"]])]
            at += len(x["raw"]) + 1
        return _batch(out, [*RID, "low", "high"], [pa.int64()] * 3 + [pa.int32()] * 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size, last = 0, None
        for batch in slim(batches):
            for x in batch.to_pylist():
                key = (x["key1"], x["key2"])
                if key != last and size > PIECE:
                    yield work(held)
                    held, size = [], 0
                last = key
                held.append(x)
                size += len(x["raw"])
        if held:
            yield work(held)

    dealt = parts.repartition(partitions(parts.sparkSession), "key1", "key2").sortWithinPartitions("key1", "key2")
    return dealt.select("key1", "key2", *RID, "low", "n", "dup", "raw").mapInArrow(run, FOUND)


def cut_finer(parts: DataFrame, step: int, window: int) -> DataFrame:
    """The parts of ``step`` starts of each part, keyed by what all their windows hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slim(batches):
            out = []
            for x in batch.to_pylist():
                raw, first, stop = x["raw"], x["low"], x["low"] + x["n"]
                # Parts begin at multiples of the step from the anchor, so equal windows lie in parts of one number.
                for j in range((first - x["rel"]) // step, (stop - 1 - x["rel"]) // step + 1):
                    base = j * step + x["rel"]
                    low, high = max(first, base), min(stop, base + step)
                    core = _pair(raw[base + step - 1 - first : base + window - first], x["key1"] ^ j)
                    own = raw[low - first : high - 1 + window - first]
                    out.append((*core, *_pair(own, (low - base) * window + high - base), *(x[c] for c in RID), x["rel"], low, high - low, x["dup"], own))
            yield _batch(out, PART_COLUMNS, _PART_KINDS)

    return parts.select(*PART_COLUMNS).mapInArrow(run, PART)


def repeated(parts: DataFrame, window: int) -> DataFrame:
    """(gram, r1, r2, low, high): repeated starts of all parts that are not known to be repeated as a whole.

    parts: of keys that have several.
    """
    key = ["key1", "key2"]
    found = []
    for level, step in enumerate((*STEPS, 1)):
        sizes = parts.groupBy(*key).agg(F.count(F.lit(1)).alias("parts"))
        # At most one hot key for every HOT parts; as a written table its size decides how it is joined.
        hot = kept(sizes.where(F.col("parts") > HOT).select(*key), "hot")
        any_hot = not hot.isEmpty()
        cool = parts.join(hot, key, "left_anti") if any_hot else parts
        if level:
            cool = cool.join(sizes.where(F.col("parts").between(2, HOT)).select(*key), key, "left_semi")
        found.append(sorted_shards(cool, window))
        if not any_hot:
            break
        finer = kept(cut_finer(parts.join(hot, key, "left_semi"), min(step, window), window), "parts")
        first = [F.first(c).alias(c) for c in PART_COLUMNS[4:] if c != "dup"]
        # Equal parts under one core: one stands for them, and all of them are repeated.
        parts = kept(finer.groupBy(*PART_COLUMNS[:4]).agg(*first, ((F.count(F.lit(1)) > 1) | F.max("dup")).alias("dup")), "parts")
        same = parts.where("dup").select(*PART_COLUMNS[:4])
        found.append(finer.where("not dup").join(same, PART_COLUMNS[:4], "left_semi").select(*RID, "low", (F.col("low") + F.col("n") - 1).alias("high")))
    return reduce(DataFrame.unionByName, found)


def spans(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(h1, h2, spans): for each text hash the byte spans [low, high) to remove; low < 0 stands for the whole text."""
    copies = kept(texts.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")), "copies")
    all_runs = kept(runs(texts, window), "runs")
    # Copies of a text have the same regions; anything else that shares a gram is another (text, region) or place.
    own = F.xxhash64("h1", "h2", "r1", "r2")
    shared = all_runs.groupBy("gram").agg(F.min(own).alias("a"), F.max(own).alias("b"), F.max(F.size("places")).alias("times"))
    met = kept(all_runs.join(shared.where("a <> b or times > 1").select("gram"), "gram").dropDuplicates(["h1", "h2", *RID]), "met")
    first = [F.first(c).alias(c) for c in ("h1", "h2", "n", "rel")]
    dup = (F.count(F.lit(1)) > 1) | (F.max(F.size("places")) > 1)
    regions = kept(met.groupBy(*RID).agg(dup.alias("dup"), F.first(F.col("places")[0]).alias("s0"), *first), "regions")
    many = regions.groupBy("gram").agg(F.count(F.lit(1)).alias("regions")).where("regions > 1")
    open_regions = regions.join(many, "gram", "left_semi")
    wanted = open_regions.groupBy("h1", "h2").agg(F.collect_list(F.struct(*RID, "s0", "n", "rel", "dup")).alias("list"))
    # One copy of each text gives the bytes.
    wanted = wanted.join(copies, ["h1", "h2"]).select(F.col("h1").alias("w1"), F.col("h2").alias("w2"), F.col("id").alias("wid"), "list")
    at = (F.col("h1") == F.col("w1")) & (F.col("h2") == F.col("w2")) & F.col("id").eqNullSafe(F.col("wid"))
    sourced = texts.join(wanted.hint("shuffle_hash"), at).select("text", "list")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slim(batches):
            rows = []
            for t, items in zip(batch["text"], batch["list"].to_pylist(), strict=True):
                raw = t.as_buffer().to_pybytes()
                for x in items:
                    own = tuple(x[c] for c in RID)
                    rows.append((x["gram"], 0, *own[1:], *own, x["rel"], 0, x["n"], x["dup"], raw[x["s0"] : x["s0"] + x["n"] - 1 + window]))
            yield _batch(rows, PART_COLUMNS, _PART_KINDS)

    # Equal rows with one id each give the bytes of their text; all of it is repeated then anyway.
    cut_out = kept(sourced.mapInArrow(fetch, PART), "bytes")
    found = kept(repeated(cut_out, window), "found")
    whole = regions.where("dup").select(*RID, F.lit(0).alias("low"), (F.col("n") - 1).alias("high"))
    # One row a region with its starts, fewer than a window has bytes; so one row a place after the join.
    starts = found.unionByName(whole).groupBy(*RID).agg(F.collect_list(F.struct("low", "high")).alias("starts"))
    hits = met.join(starts, RID)
    moved = F.flatten(
        F.transform("places", lambda s: F.transform("starts", lambda x: F.struct((s + x["low"]).alias("low"), (s + x["high"] + window).alias("high"))))
    )
    ranges = hits.select("h1", "h2", moved.alias("spans"))
    ranges = ranges.unionByName(copies.where("copies > 1").select("h1", "h2", F.array(F.struct(F.lit(-1).alias("low"), F.lit(-1).alias("high"))).alias("spans")))
    return ranges.groupBy("h1", "h2").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def removed(size: int, found: list[dict[str, int]] | None, window: int) -> list[tuple[int, int]]:
    """Disjoint byte spans in order, from the spans of a text of ``size`` bytes."""
    if not found:
        return []
    if any(x["low"] < 0 for x in found):
        return [(0, size)] if size >= window else []
    out: list[tuple[int, int]] = []
    for low, high in sorted((x["low"], x["high"]) for x in found):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _kept_bytes(raw: bytes, gone: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for low, high in gone:
        parts.append(raw[at:low])
        at = high
    return b"".join([*parts, raw[at:]])


def _with_spans(texts: DataFrame, window: int) -> DataFrame:
    found = spans(texts.select("id", "text", "h1", "h2"), window)
    return texts.join(found.hint("shuffle_hash"), ["h1", "h2"], "left")


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, text) of every row: the bytes of the input, what goes, and the text that stays.

    ``text`` leaves out a character of which a part is removed; the hash is over all bytes that stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slim(batches):
            out: list[list] = [[], [], [], [], []]
            for t, found in zip(batch["text"], batch["spans"].to_pylist(), strict=True):
                raw = t.as_buffer().to_pybytes()
                gone = removed(len(raw), found, window)
                stays = _kept_bytes(raw, gone)
                row = (len(raw), sum(b - a for a, b in gone), len(gone), hashlib.sha256(stays).hexdigest(), stays.decode("utf-8", "ignore"))
                for o, x in zip(out, row, strict=True):
                    o.append(x)
            cols = [pa.array(o, k) for o, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["id"], *cols], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    rows = _with_spans(hashed(docs, key, text), window).select("id", "text", "spans")
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")
    return out.withColumnRenamed("id", key)


def cut(docs: DataFrame, key: str = "doc_id", text: str = "text", chars: str | None = "n_chars", window: int = WINDOW) -> DataFrame:
    """``docs`` with the repeated bytes gone from its texts, and ``chars`` (if a column) counted anew.

    A character of which a part is removed goes as a whole. Null texts stay null.
    """
    p = free_prefix(docs)
    texts = hashed(docs, key, text)
    found = spans(texts, window).select(F.col("h1").alias(f"{p}h1"), F.col("h2").alias(f"{p}h2"), F.col("spans").alias(f"{p}spans"))
    t = text_of(text)
    same = (F.xxhash64(t) == F.col(f"{p}h1")) & (F.xxhash64(F.lit(1), t) == F.col(f"{p}h2"))
    joined = docs.join(found.hint("shuffle_hash"), same, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slim(batches):
            at = batch.schema.get_field_index(text)
            out = []
            for x, own in zip(batch.column(at), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                raw = x.as_buffer().to_pybytes() if x.is_valid else b""
                gone = removed(len(raw), own, window)
                out.append(_kept_bytes(raw, gone).decode("utf-8", "ignore") if x.is_valid else None)
            cols = [pa.array(out, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(cols, batch.schema.names[:-1])

    columns: list[Column] = [F.col(f"`{c}`") for c in docs.columns]
    done = joined.select(*columns, f"{p}spans").mapInArrow(run, docs.schema)
    if chars in docs.columns:
        done = done.withColumn(chars, F.char_length(text).cast(docs.schema[chars].dataType))
    return done
