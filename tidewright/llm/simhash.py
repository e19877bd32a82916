"""Operator 3, SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints of 64 bits over word shingles link at ``radius`` or fewer differing bits. Bit i is
given a vector m(i) over GF(2) of radius + 1 places; for each nonzero vector v the mask of v holds
the bits with <m(i), v> = 1. Any ``radius`` vectors leave some v orthogonal to them all, so two
fingerprints within the radius agree on all bits of some mask: every such pair meets in some table.

Copies of one fingerprint are one node. Nodes are dealt by (mask, masked bits); nodes that meet are
joined by a spanning forest of their links, so a group of any size gives no more edges than nodes.
Components come from distributed stars (``components``).

Defined cases: null and blank texts have no words and fingerprint zero, linked like any other; texts
of fewer words than a shingle are one shingle; long texts are hashed in blocks; equal rows are in
one component; null ids stay rows and are never a component's id unless all of its ids are null;
other columns are not read (or, in ``one_of_each_group``, passed through); an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import free_prefix, given, kept, new_path, partitions, settled, slim, written
from tidewright.llm.components import components

BITS = 64
SHINGLE, RADIUS = 3, 2
#: A bucket of up to this many nodes is compared pair by pair in one block; a larger one is split by its bits first.
BLOCK = 2048
#: Rows of a block that are compared with the others at a time.
STRIPE = 256
#: Shingles hashed at a time.
SHINGLES_AT_ONCE = 1 << 16
#: The pipeline's stage: tables over fingerprints of distinct words, links over five-word shingles.
GROUP_SHINGLE, GROUP_SIMILARITY = 5, 0.8
#: Independent word fingerprints with tables: a pair is lost only if it is too far apart in each.
WORD_PRINTS, WORD_RADIUS, WORD_APART = 2, 6, 12
#: Bits of the wide fingerprint by which links are ordered and found, in longs of 64.
WIDE = 16
#: Standard deviations of the wide estimate: a pair that falls short of the similarity by more is no link, one
#: that is above it by more than SURE is one, and the shingle sets decide the others.
MARGIN, SURE = 3.0, 4.0
#: Edge-disjoint spanning forests of links that a bucket gives to that decision.
FORESTS = 3
#: Links of a bucket held before all but those of its forests are let go.
LINKS_AT_ONCE = 1 << 20
#: Links, nearest first, that are tried between two looks at what the forests join.
LINKS_AT_A_LOOK = 1 << 12
#: Bits of the filter that tells which rows a join may meet, in bitmaps of 2^15 bits.
FILTER_BITS, BITMAP = 1 << 24, 1 << 15
#: Rows of whole buckets that a task compares at a time; a bucket with more is taken alone.
ROWS_AT_ONCE = 1 << 18
#: Covering tables that are exchanged at a time.
TABLES_AT_ONCE = 32
#: Parts, by their shingles, in which prefixes are exchanged one after another.
GRAM_PARTS = 4
#: Texts, about, whose shingles tell which are frequent, and how many of those are told: only an order, see ``prefix_of``.
SAMPLE, FREQUENT = 4096, 1 << 15
#: What a share of whole numbers lacks as a double.
SLACK = 1e-6


def shingle_hashes(words: list[bytes], shingle: int, once: bool = False) -> np.ndarray:
    """XXH64 of each shingle, repeats included. once: each distinct shingle counts once."""
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    grams = (b" ".join(words[i : i + shingle]) for i in range(n)) if shingle > 1 else words
    if once:
        grams = dict.fromkeys(grams)
    return np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64)


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half the hashes; 0 for none."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), SHINGLES_AT_ONCE):
        part = hashes[i : i + SHINGLES_AT_ONCE]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def simhash(words: list[bytes], shingle: int, once: bool = False) -> int:
    return majority(shingle_hashes(words, shingle, once))


def rehashed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Independent hashes made of hashes, by a finalising mix."""
    h = hashes + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def most_apart(similarity: float, bits: int, margin: float = MARGIN) -> int:
    """Differing bits up to which two fingerprints count as of sets with that Jaccard similarity.

    Each bit differs with the angle between the sets over pi; the margin is in standard deviations.
    """
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(bits * share + margin * np.sqrt(bits * share * (1 - share)))


def masks(radius: int) -> list[int]:
    """One mask for each nonzero vector of radius + 1 places."""
    count = 2 ** (radius + 1) - 1
    if count <= BITS:
        own = [i % count + 1 for i in range(BITS)]
    else:  # odd vectors only: every mask but one holds half of the bits
        own = [2 * (i % (count // 2 + 1)) + 1 for i in range(BITS)]
    return [sum(1 << i for i, m in enumerate(own) if (m & v).bit_count() % 2) for v in range(1, count + 1)]


def prefix_of(hashes: np.ndarray, similarity: float, frequent: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The first elements of a set, so many that two sets of that Jaccard similarity share one of theirs.

    The order is one for all sets: what is not ``frequent`` (sorted) by its value, then the frequent by their
    places. Any order loses no pair; the rare first let few other sets meet.
    """
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        order = np.lexsort((hashes, np.where(frequent[at] == hashes, places[at], 0)))
    else:
        order = np.argsort(hashes)
    return hashes[order[: len(hashes) - int(np.ceil(similarity * len(hashes) - SLACK)) + 1]]


def parity_of(hashes: np.ndarray) -> np.ndarray:
    """A bit for each remainder of the hashes: whether an odd number of them has it.

    As many bits as elements at least, a power of two of longs. Where two sets differ in d elements, these
    differ in d bits at most.
    """
    bits = BITS << max(0, (len(hashes) - 1).bit_length() - 6)
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def fingerprints(
    docs: DataFrame, key: str, text: str, sketches: list[tuple[int, bool, int]], wide: int = 0, similarity: float | None = None, frequent: Sequence[int] = ()
) -> DataFrame:
    """(id, fp0, fp1, ..., w0, w1, ...): a signed 64-bit fingerprint for each (shingle, once, number).

    Sketches of another number are independent; number 0 is XXH64 itself. wide: as many more over the
    shingles of the last sketch, with independent hashes. similarity: also size, prefix (``prefix_of``) and
    parity (``parity_of``) of the set of those shingles.
    """
    often = np.array(frequent, np.int64).view(np.uint64)
    ranks = np.argsort(often)
    often, ranks = often[ranks], ranks + 1
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    names = [f"fp{i}" for i in range(len(sketches))] + [f"w{k}" for k in range(wide)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slim(batches):
            found: list[list[int]] = [[] for _ in names]
            sizes, prefixes, parities = [], [], []
            for t in batch["text"]:
                # bytes.lower() changes A-Z only, and bytes.split() cuts at ASCII white space only.
                words = (t.as_py() or "").encode().lower().split()
                hashes, made = np.zeros(0, np.uint64), None
                for out, (k, once, number) in zip(found, sketches, strict=False):
                    if made != (k, once):
                        hashes, made = shingle_hashes(words, k, once), (k, once)
                    out.append(majority(rehashed(hashes, -number) if number else hashes))
                for k, out in enumerate(found[len(sketches) :]):
                    out.append(majority(rehashed(hashes, k)))
                if similarity is not None:
                    sizes.append(len(hashes))
                    prefixes.append(prefix_of(hashes, similarity, often, ranks).view(np.int64))
                    parities.append(parity_of(hashes))
            cols = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in found]
            if similarity is not None:
                cols += [pa.array(sizes, pa.int32()), *(pa.array(x, pa.list_(pa.int64())) for x in (prefixes, parities))]
            yield pa.RecordBatch.from_arrays([batch["id"], *cols], ["id", *names, *more])

    kind = rows.schema["id"].dataType.simpleString()
    more = [] if similarity is None else ["size", "prefix", "parity"]
    sets = "" if similarity is None else ", size int, prefix array<bigint>, parity array<bigint>"
    return rows.mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} long" for n in names) + sets)


class Forest:
    """Union-find over 0..n-1 that keeps the links which joined two trees."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether the link joined two trees."""
        x, y = self.root(a), self.root(b)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        self.links.append((a, b))
        return True

    def roots(self) -> np.ndarray:
        """The root of every node."""
        up = np.array(self.up)
        while not np.array_equal(up[up], up):
            up = up[up]
        return up


class NearestForests:
    """FORESTS edge-disjoint spanning forests of the links among 0..n-1, nearest links first.

    At most FORESTS links a node. If a later test refuses some links, what linked rows it leaves apart
    lie on two sides of a cut over which FORESTS or more refused links are nearer than any true one.
    """

    def __init__(self, n: int) -> None:
        self.n, self.held, self.size = n, [], 0

    def add(self, a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> None:
        self.held.append((np.minimum(a, b), np.maximum(a, b), apart))
        self.size += len(a)
        if self.size > LINKS_AT_ONCE:
            self.held = [self.links()]
            self.size = len(self.held[0][0])

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        a, b, apart = (np.concatenate([none, *x]).astype(np.int64) for x in (zip(*self.held, strict=True) if self.held else ((), (), ())))
        once = np.unique(a * self.n + b, return_index=True)[1]
        nearest = once[np.argsort(apart[once], kind="stable")]
        forests = [Forest(self.n) for _ in range(FORESTS)]
        taken = []
        for i in range(0, len(nearest), LINKS_AT_A_LOOK):
            some = nearest[i : i + LINKS_AT_A_LOOK]
            # What the last forest joins, all do.
            last = forests[-1].roots()
            some = some[last[a[some]] != last[b[some]]]
            taken += [j for j, x, y in zip(some.tolist(), a[some].tolist(), b[some].tolist(), strict=True) if any(f.join(x, y) for f in forests)]
        return a[taken], b[taken], apart[taken]


def wide_bits(fps: np.ndarray, first: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of the wide fingerprint, the columns of fps from ``first`` on."""
    apart = np.zeros(len(a), np.uint16)
    for k in range(first, fps.shape[1]):
        apart += np.bitwise_count(fps[a, k] ^ fps[b, k])
    return apart


def _linked(fps: np.ndarray, limits: list[int], a: np.ndarray, b: np.ndarray, wide_apart: int = 0) -> np.ndarray:
    """Which pairs of rows differ in at most limits[k] bits of fingerprint k, for every k.

    Further columns of fps are one wide fingerprint, of which at most wide_apart bits may differ.
    """
    a, b = np.broadcast_arrays(a, b)
    ok = np.ones(a.shape, bool)
    for k, most in enumerate(limits):
        ok &= np.bitwise_count(fps[a, k] ^ fps[b, k]) <= most
    if fps.shape[1] > len(limits):
        at = np.nonzero(ok)
        ok[at] = wide_bits(fps, len(limits), a[at], b[at]) <= wide_apart
    return ok


def linked_pairs(fps: np.ndarray, limits: list[int], rows: np.ndarray, wide_apart: int = 0, depth: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All linked pairs among ``rows`` (numbers of rows of ``fps``), some more than once, in pieces.

    Within limits[0] bits, two fingerprints agree on one of limits[0] + 1 segments of their bits, so
    a large bucket is split by each segment in turn; only rows that agree there are compared.
    """
    parts = limits[0] + 1
    if len(rows) <= BLOCK or depth == 3:
        for i in range(0, len(rows), STRIPE):
            left = rows[i : i + STRIPE]
            for j in range(i, len(rows), BLOCK):
                right = rows[j : j + BLOCK]
                ok = _linked(fps, limits, left[:, None], right[None, :], wide_apart)
                # Inside a stripe, both orders of a pair come; elsewhere one.
                ok &= np.arange(i, i + len(left))[:, None] < np.arange(j, j + len(right))[None, :]
                x, y = np.nonzero(ok)
                yield left[x], right[y]
        return
    edges = np.linspace(0, BITS, parts + 1).astype(int)
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        seg = (fps[rows, 0] >> np.uint64(low)) & np.uint64((1 << int(high - low)) - 1)
        order = np.argsort(seg, kind="stable")
        cuts = np.flatnonzero(np.diff(seg[order])) + 1
        for group in np.split(rows[order], cuts):
            if len(group) > 1:
                yield from linked_pairs(fps, limits, group, wide_apart, depth + 1 if len(group) < len(rows) else 3)


def join_links(fps: np.ndarray, limits: list[int], rows: np.ndarray, forest: Forest) -> None:
    """Join all linked pairs among ``rows``."""
    for left, right in linked_pairs(fps, limits, rows):
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            forest.join(a, b)


def before(fps: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether row a comes before row b in the order of the columns."""
    low = np.zeros(len(a), bool)
    for k in range(fps.shape[1] - 1, -1, -1):
        low = (fps[a, k] < fps[b, k]) | ((fps[a, k] == fps[b, k]) & low)
    return low


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and where each group of them starts and ends in it."""
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    return order, np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])


def bucket_edges(keys: np.ndarray, fps: np.ndarray, limits: list[int], wide_apart: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (a, b) that join what is linked within each group of equal keys, and their differing wide bits.

    Without a wide fingerprint these are the links of one spanning forest, else of the nearest forests.
    """
    order, starts, ends = _groups(keys)
    fps, sizes, first = fps[order], ends - starts, len(limits)
    pair = starts[sizes == 2]
    pair = pair[_linked(fps, limits, pair, pair + 1, wide_apart)]
    left, right, apart = [pair], [pair + 1], [wide_bits(fps, first, pair, pair + 1)]
    for s, e in zip(starts[sizes > 2].tolist(), ends[sizes > 2].tolist(), strict=True):
        own = fps[s:e]
        if fps.shape[1] > first:
            near = NearestForests(e - s)
            for x, y in linked_pairs(own, limits, np.arange(e - s), wide_apart):
                near.add(x, y, wide_bits(own, first, x, y))
            a, b, bits = near.links()
        else:
            forest = Forest(e - s)
            join_links(own, limits, np.arange(e - s), forest)
            a, b = np.array(forest.links, np.int64).reshape(-1, 2).T
            bits = np.zeros(len(a), np.uint16)
        left.append(a + s)
        right.append(b + s)
        apart.append(bits)
    return order[np.concatenate(left)], order[np.concatenate(right)], np.concatenate(apart)


def bucket_mates(keys: np.ndarray, fps: np.ndarray, limits: list[int]) -> np.ndarray:
    """Rows with a linked partner in their group of equal keys."""
    order, starts, ends = _groups(keys)
    fps, sizes = fps[order], ends - starts
    found = np.zeros(len(keys), bool)
    pair = starts[sizes == 2]
    pair = pair[_linked(fps, limits, pair, pair + 1)]
    found[pair] = found[pair + 1] = True
    for s, e in zip(starts[sizes > 2].tolist(), ends[sizes > 2].tolist(), strict=True):
        for a, b in linked_pairs(fps[s:e], limits, np.arange(e - s)):
            found[a + s] = found[b + s] = True
    return order[found]


def whole_buckets(batches: Iterator[pa.RecordBatch], rows: int | None = None) -> Iterator[pa.Table]:
    """Tables of all rows of some keys, of about ``rows`` rows, from batches sorted by ``key``."""
    rows = ROWS_AT_ONCE if rows is None else rows
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch["key"].to_numpy(zero_copy_only=False)
        if size >= rows:
            # What goes on with the last key is still of its bucket.
            last = held[-1]["key"][held[-1].num_rows - 1].as_py()
            same = int(np.argmax(np.append(keys != last, True)))
            held.append(batch.slice(0, same))
            batch, keys = batch.slice(same), keys[same:]
            if batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def edges(nodes: DataFrame, limits: list[int], radius: int, wide: int = 0, wide_apart: int = 0, prints: int = 1) -> DataFrame:
    """(a0.., b0.., apart) links among the distinct fingerprints fp0.. of ``nodes`` that join all linked ones.

    prints: the first so many fingerprints have tables. Buckets stream through a task in order of their key.
    Every table has a row for each node, so only TABLES_AT_ONCE of them are on disk at a time.

    wide: linked ones also differ in ``wide_apart`` bits of the fingerprints w0.. at most, ``apart`` says in
    how many, and several forests of the nearest links come, as a later test may refuse some. As so many
    longs more in every table would be most of the exchange, they join only those rows that have a
    partner by the other fingerprints.
    """
    names, more = [f"fp{i}" for i in range(len(limits))], [f"w{k}" for k in range(wide)]
    all_masks = np.array(masks(radius), np.uint64)
    spread = np.uint64(0x9E3779B97F4A7C15)
    parts = partitions(nodes.sparkSession)

    def dealt(first: int) -> DataFrame:
        """The nodes under their keys in the tables from this one on."""

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = range(first, min(first + TABLES_AT_ONCE, prints * len(all_masks)))
            for batch in batches:
                fps = [batch[n].to_numpy(zero_copy_only=False) for n in names]
                for i in range(0, len(fps[0]), 4096):
                    for t in range(prints):
                        own = fps[t][i : i + 4096].view(np.uint64)
                        # Masked bits and the table's number, mixed: the few that clash are told apart by their bits.
                        table = np.array([n + 1 for n in tables if n // len(all_masks) == t], np.uint64)
                        if not len(table):
                            continue
                        keys = ((own[:, None] & all_masks[(table - np.uint64(1)) % np.uint64(len(all_masks))]) + table * spread) * np.uint64(0xD6E8FEB86659FD93)
                        keys ^= keys >> np.uint64(32)
                        cols = [pa.array(np.repeat(f[i : i + 4096], len(table))) for f in fps]
                        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), *cols], ["key", *names])

        return by_bucket(nodes.select(*names).mapInArrow(deal, f"key long, {kinds}"))

    def read(table: pa.Table, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return table["key"].to_numpy(), np.stack([table[n].to_numpy().view(np.uint64) for n in columns], axis=1)

    def mates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_buckets(batches):
            keys, fps = read(table, names)
            rows = bucket_mates(keys, fps, limits)
            yield pa.RecordBatch.from_arrays([pa.array(keys[rows]), *[pa.array(fps[rows, k].view(np.int64)) for k in range(len(names))]], ["key", *names])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_buckets(batches):
            keys, fps = read(table, names + more)
            a, b, apart = bucket_edges(keys, fps, limits, wide_apart)
            # A link that several tables find is one row.
            low = before(fps[:, : len(names)], a, b)
            a, b = np.where(low, a, b), np.where(low, b, a)
            cols = [pa.array(fps[side, k].view(np.int64)) for side in (a, b) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(apart.astype(np.int32))], [*(f"{s}{k}" for s in "ab" for k in range(len(names))), "apart"])

    def by_bucket(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, "key").sortWithinPartitions("key")

    kinds = ", ".join(f"{n} long" for n in names)
    out = ", ".join(f"{s}{k} long" for s in "ab" for k in range(len(names))) + ", apart int"
    starts = range(0, prints * len(all_masks), TABLES_AT_ONCE)
    if wide:
        path, kind = new_path(nodes.sparkSession, "mates"), f"key long, {kinds}"
        for first in starts:
            written(dealt(first).mapInArrow(mates, kind), path)
        near = nodes.sparkSession.read.schema(kind).parquet(path)
        return by_bucket(near.join(nodes.select(*names, *more), names).select("key", *names, *more)).mapInArrow(meet, out).distinct()
    met = dealt(0).mapInArrow(meet, out)
    for first in starts[1:]:
        met = met.unionByName(dealt(first).mapInArrow(meet, out))
    return met.distinct()


def _nodes(prints: DataFrame, limits: list[int], members: Column, wide: int = 0) -> DataFrame:
    """(fp0.., first, w0..): distinct fingerprints with the least member of each."""
    names = [f"fp{i}" for i in range(len(limits))]
    # Texts of equal fingerprints are one node; of several wide fingerprints the least stands for them.
    widest = [F.min(F.struct(*[f"w{k}" for k in range(wide)])).alias("w")] if wide else []
    nodes = prints.groupBy(*names).agg(F.min(members).alias("first"), *widest).select(*names, "first", *(["w.*"] if wide else []))
    return kept(nodes, "nodes")


def _classes(nodes: DataFrame, links: DataFrame, names: list[str], since: int | None = None) -> DataFrame:
    """(fp0.., first, component): nodes with their component. since: what was written from there on only made the links."""
    since = given() if since is None else since
    pack = lambda s: F.struct(*[F.col(f"{s}{k}").alias(n) for k, n in enumerate(names)])
    groups = components(links.select(pack("a").alias("a"), pack("b").alias("b")), "a", "b")
    named = groups.select(*[F.col(f"node.{n}").alias(n) for n in names], "component")
    joined = nodes.select(*names, "first").join(named, names, "left")
    own = F.struct(*[F.col(n) for n in names])
    return settled(joined.withColumn("component", F.coalesce("component", own)), "classes", since)


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """The rows with ``shingles``, the hashes of the text's distinct shingles, for ``text``."""
    names = [c for c in texts.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slim(batches, 100):
            sets = [shingle_hashes((t.as_py() or "").encode().lower().split(), shingle, True).view(np.int64) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([*[batch[n] for n in names], pa.array(sets, pa.list_(pa.int64()))], [*names, "shingles"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema if f.name in names)
    return texts.mapInArrow(run, f"{kinds}, shingles array<bigint>")


def maybe_in(rows: DataFrame, hashed: Column, keys: DataFrame, key_hash: Column, name: str) -> DataFrame:
    """``rows`` with a boolean column ``name``: false only where the row's hash is none of the keys'.

    The keys' hashes are bits of a filter of FILTER_BITS, broadcast as 2 MiB at most however many they
    are; where they are so many that most bits are set, more rows are true and nothing else changes.
    """
    place = lambda h: F.pmod(h, F.lit(FILTER_BITS))
    bits = keys.select(place(key_hash).alias("at")).groupBy(F.shiftright("at", 15).alias(f"{name}_part"))
    bits = bits.agg(F.bitmap_construct_agg(F.col("at") % BITMAP).alias(f"{name}_bits"))
    rows = rows.withColumn(f"{name}_at", place(hashed))
    rows = rows.join(F.broadcast(bits), F.shiftright(f"{name}_at", 15) == F.col(f"{name}_part"), "left")
    octet = f"cast(conv(hex(substring(`{name}_bits`, cast(`{name}_at` % {BITMAP} div 8 as int) + 1, 1)), 16, 10) as int)"
    found = F.expr(f"coalesce(shiftright({octet}, cast(`{name}_at` % 8 as int)) & 1, 0) = 1")
    return rows.withColumn(name, found).drop(f"{name}_at", f"{name}_part", f"{name}_bits")


def decided(links: DataFrame, nodes: DataFrame, texts: DataFrame, names: list[str], shingle: int, similarity: float) -> DataFrame:
    """The links (a0.., b0..) whose texts' sets of distinct shingles have that Jaccard similarity.

    texts: (id, text), the nodes' ``first`` being an id. Only texts of nodes with a link are read into
    sets; a link carries two of them through the joins, so nothing is ever held for a group.
    """
    ends = links.select(*[F.col(f"a{k}").alias(n) for k, n in enumerate(names)]).unionByName(links.select(*[F.col(f"b{k}").alias(n) for k, n in enumerate(names)]))
    wanted = kept(nodes.select(*names, F.col("first").alias("id")).join(ends.distinct(), names), "wanted")
    # Only texts that may be wanted are shuffled. Rows of equal id and text are one.
    near = maybe_in(texts, F.xxhash64("id"), wanted, F.xxhash64("id"), "asked").where("asked").drop("asked")
    own = near.join(wanted.hint("shuffle_hash"), "id").groupBy("id").agg(F.first("text").alias("text"), *[F.first(n).alias(n) for n in names])
    sets = kept(shingle_sets(own.drop("id"), shingle), "sets")
    side = lambda s: sets.select(*[F.col(n).alias(f"{s}{k}") for k, n in enumerate(names)], F.col("shingles").alias(f"s{s}"))
    pairs = links.join(side("a"), [f"a{k}" for k in range(len(names))]).join(side("b"), [f"b{k}" for k in range(len(names))])
    both = F.size(F.array_intersect("sa", "sb"))
    # Two sets of integers: a share of whole numbers.
    alike = both >= F.lit(similarity) * (F.size("sa") + F.size("sb") - both) - SLACK
    return pairs.where(alike).select(*links.columns)


def frequent_shingles(texts: DataFrame, shingle: int) -> list[int]:
    """Hashes of shingles that several of about SAMPLE texts have, the rarer first; FREQUENT at most."""
    some = texts.where(F.pmod(F.xxhash64("id"), F.lit(max(1, texts.count() // SAMPLE))) == 0).select(F.xxhash64("id").alias("id"), "text")
    counts = shingle_sets(some, shingle).select(F.explode("shingles").alias("gram")).groupBy("gram").count().where("count > 2")
    return [r["gram"] for r in counts.orderBy(F.desc("count"), "gram").limit(FREQUENT).collect()][::-1]


def meeting(sets: DataFrame, similarity: float) -> DataFrame:
    """(a_node, b_node): what may be two sets of that similarity in different components; no such two are left out.

    sets: (node, c, size, prefix), written, with the component as c and the prefix of ``prefix_of``; with parity too,
    what that tells apart goes first (``near_by_parity``), as the pairs grow faster than the sets. Two sets of
    the similarity share so many elements, ``least``, that the first shared one has as many in either from it on;
    only shingles so far in front of both count. Those of the smaller set lie where a partner of its own
    size asks for one. So what many sets share gives no row for each pair of them, unless it is among the rarest of both.
    """
    least = lambda a, b: F.ceil(F.lit(similarity / (1 + similarity)) * (F.col(a) + F.col(b)) - SLACK)
    every = sets.select("node", "c", "size", F.posexplode("prefix").alias("at", "gram"))
    every = every.withColumn("front", F.col("at") <= F.col("size") - least("size", "size"))
    side = lambda rows, s: rows.select("gram", *[F.col(c).alias(f"{s}_{c}") for c in ("node", "c", "size", "at")])
    smaller = (F.col("a_size") < F.col("b_size")) | ((F.col("a_size") == F.col("b_size")) & (F.col("a_c") < F.col("b_c")))
    sizes = F.col("a_size") >= F.lit(similarity) * F.col("b_size") - SLACK
    early = F.least(F.col("a_size") - F.col("a_at"), F.col("b_size") - F.col("b_at")) >= least("a_size", "b_size")
    found = []
    for part in range(GRAM_PARTS):
        mark = given()
        grams = every.where(F.pmod("gram", F.lit(GRAM_PARTS)) == part)
        met = grams.groupBy("gram").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.max("front").alias("fronts"))
        shared = kept(grams.join(kept(met.where("low <> high and fronts").select("gram"), f"met{part}"), "gram"), f"shared{part}")
        rows = side(shared.where("front"), "a").join(side(shared, "b"), "gram").where((F.col("a_c") != F.col("b_c")) & smaller & sizes & early)
        found.append(settled(rows.select("a_node", "b_node").distinct(), "found", mark))
    own = lambda s: sets.select(*[F.col(c).alias(f"{s}_{c}") for c in ("node", "size", "prefix")])
    pairs = kept(reduce(DataFrame.unionByName, found).distinct(), "meeting")
    if "parity" in sets.columns:
        pairs = kept(near_by_parity(pairs, sets, similarity), "near")
    pairs = pairs.join(own("a"), "a_node").join(own("b"), "b_node")
    # How many shingles the prefixes share bounds what the sets can share.
    pairs = pairs.withColumn("both", F.array_intersect("a_prefix", "b_prefix")).withColumn("last", F.element_at("both", -1))
    # What they share beyond the last of these lies behind it in both, and behind one's prefix.
    left = lambda s: F.col(f"{s}_size") - F.array_position(f"{s}_prefix", F.col("last"))
    most = F.size("both") + F.least(left("a"), left("b"), F.ceil(F.lit(similarity) * F.greatest("a_size", "b_size") - SLACK) - 1)
    return pairs.where(most >= least("a_size", "b_size")).select("a_node", "b_node")


def near_by_parity(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a_node, b_node) without those whose parities differ in more bits than sets of that similarity in elements.

    sets: (node, size, parity). A longer parity is folded to the length of the other. So a pair carries about an
    eighth of a byte for an element of its sets, and hardly any goes on that is not alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slim(batches):
            own = [(batch[f"{s}_parity"].flatten().to_numpy(zero_copy_only=False).view(np.uint64), batch[f"{s}_parity"].value_lengths().to_numpy()) for s in "ab"]
            (a, b), sizes = (np.cumsum(n) - n for _, n in own), sum(batch[f"{s}_size"].to_numpy().astype(np.int64) for s in "ab")
            apart = np.zeros(batch.num_rows, np.int64)
            for n, m in {*zip(own[0][1].tolist(), own[1][1].tolist(), strict=True)}:
                at, k = np.flatnonzero((own[0][1] == n) & (own[1][1] == m)), min(n, m)
                left, right = (np.bitwise_xor.reduce(x[start[at, None] + np.arange(size)].reshape(len(at), -1, k), axis=1) for (x, _), start, size in zip(own, (a, b), (n, m), strict=True))
                apart[at] = np.bitwise_count(left ^ right).sum(1)
            least = np.ceil(similarity / (1 + similarity) * sizes - SLACK).astype(np.int64)
            yield batch.select(["a_node", "b_node"]).filter(pa.array(apart <= sizes - 2 * least))

    side = lambda s: sets.select(*[F.col(c).alias(f"{s}_{c}") for c in ("node", "size", "parity")])
    return pairs.join(side("a"), "a_node").join(side("b"), "b_node").mapInArrow(run, "a_node long, b_node long")


def joined_by_rest(classes: DataFrame, nodes: DataFrame, prints: DataFrame, texts: DataFrame, names: list[str], shingle: int, similarity: float) -> DataFrame:
    """``classes`` with those components as one that hold two texts of that similarity: no link is left out.

    Fingerprints miss some links, and a bucket's forests give only some. Two texts of the similarity share
    a shingle of their prefixes, whatever their fingerprints are; of prefixes that meet, only those of
    different components are of use, so a group that is joined already gives no pair (``meeting``). The sets
    decide the others.
    """
    mark = given()
    # A node's texts are of one id here, so rows that come twice are of equal names and id.
    own = prints.join(classes.select(*names, F.col("first").alias("id"), "component"), [*names, "id"]).dropDuplicates([*names, "id"])
    own = kept(own.select(*names, F.xxhash64(*names).alias("node"), F.xxhash64("component").alias("c"), "component", "size", "prefix", "parity"), "prefixes")
    inner = given()
    pairs = settled(meeting(own.select("node", "c", "size", "prefix", "parity"), similarity), "pairs", inner)
    side = lambda s: own.select(F.col("node").alias(f"{s}_node"), F.col("component").alias(f"c{s}"), *[F.col(n).alias(f"{s}{k}") for k, n in enumerate(names)])
    links = settled(pairs.join(side("a"), "a_node").join(side("b"), "b_node").drop("a_node", "b_node"), "rest", mark)
    merged = components(decided(links, nodes, texts, names, shingle, similarity).select("ca", "cb"), "ca", "cb")
    merged = merged.select(F.col("node").alias("component"), F.col("component").alias("whole"))
    return settled(classes.join(merged, "component", "left").select(*names, "first", F.coalesce("whole", "component").alias("component")), "wholes", mark)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(key, fingerprint, component_id): every row with the least key that its links reach."""
    prints = kept(fingerprints(docs, key, text, [(shingle, False, 0)]), "prints")
    nodes = _nodes(prints, [radius], F.col("id"))
    classes = _classes(nodes, edges(nodes, [radius], radius), ["fp0"])
    firsts = classes.groupBy("component").agg(F.min("first").alias("component_id"))
    named = classes.join(firsts, "component").select("fp0", "component_id")
    out = prints.join(named, "fp0")
    return out.select(F.col("id").alias(key), F.lpad(F.lower(F.hex("fp0")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each_group(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle: int = GROUP_SHINGLE,
    similarity: float = GROUP_SIMILARITY,
    word_radius: int = WORD_RADIUS,
    word_apart: int = WORD_APART,
    word_prints: int = WORD_PRINTS,
) -> DataFrame:
    """``docs`` with one row of each group of near copies, the one of the least (key, text hash).

    Two texts are linked if their sets of distinct shingles have that Jaccard similarity; how often a
    shingle comes doesn't count. No link is left out (``joined_by_rest``). The covering tables stand over ``word_prints`` independent fingerprints
    of the distinct words, which move less under an edit: they are sure to hold every pair within
    ``word_radius`` bits in one of them, and most of those a few bits beyond. Of the pairs that meet,
    those that are clearly alike or clearly apart by the wide fingerprints (64 * WIDE bits) are settled
    by them, and the sets themselves decide the others.
    """
    p = free_prefix(docs)
    keyed = docs.withColumn(f"{p}hash", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    ids = keyed.select(F.struct(F.col(key).alias("key"), F.col(f"{p}hash").alias("hash")).alias("id"), F.col(text).alias("text"))
    sketches = [*((1, True, k) for k in range(word_prints)), (shingle, True, 0)]
    names = [f"fp{k}" for k in range(len(sketches))]
    prints = kept(fingerprints(ids, "id", "text", sketches, WIDE, similarity, frequent_shingles(ids, shingle)), "prints")
    limits = [*[word_apart] * word_prints, most_apart(similarity, BITS, 3.0)]
    nodes = _nodes(prints, limits, F.col("id"), WIDE)
    mark = given()
    links = settled(edges(nodes, limits, word_radius, WIDE, most_apart(similarity, BITS * WIDE), word_prints), "links", mark)
    mark = given()
    sure = F.col("apart") <= most_apart(similarity, BITS * WIDE, -SURE)
    alike = links.where(sure).unionByName(decided(links.where(~sure), nodes, ids, names, shingle, similarity))
    classes = joined_by_rest(_classes(nodes, alike, names, mark), nodes, prints, ids, names, shingle, similarity)
    firsts = classes.groupBy("component").agg(F.min("first").alias("keep"))
    named = classes.join(firsts, "component").select(*names, "keep")
    # One row for each (key, text hash): does it stay, and how often does it come?
    rows = prints.join(named, names).groupBy("id").agg(F.first("keep").alias("keep"), F.count(F.lit(1)).alias("n"))
    marks = kept(rows.where((F.col("id") != F.col("keep")) | (F.col("n") > 1)).select("id.key", "id.hash", (F.col("id") == F.col("keep")).alias("stays")), "marks")
    lost = marks.where(~F.col("stays")).select(F.col("key").alias(f"{p}k"), F.col("hash").alias(f"{p}h"))
    often = marks.where("stays").select(F.col("key").alias(f"{p}k"), F.col("hash").alias(f"{p}h"))
    same = F.col(key).eqNullSafe(F.col(f"{p}k")) & (F.col(f"{p}hash") == F.col(f"{p}h"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # Rows that surely have no mark stay where they are; the others are joined by key at any size, as many may go as there are documents.
    twice = not often.isEmpty()
    marked = lost.unionByName(often) if twice else lost
    flagged = maybe_in(keyed, F.xxhash64(F.col(key), F.col(f"{p}hash")), marked, F.xxhash64(f"{p}k", f"{p}h"), f"{p}met")
    clear, met = flagged.where(~F.col(f"{p}met")).select(*columns), flagged.where(F.col(f"{p}met"))
    single = clear.unionByName(met.join(marked.hint("shuffle_hash"), same, "left_anti").select(*columns))
    if not twice:
        return single
    # Rows that come more than once and stay: one of them.
    repeated = met.join(often.hint("shuffle_hash"), same, "left_semi").dropDuplicates([key, f"{p}hash"]).select(*columns)
    return single.unionByName(repeated)
