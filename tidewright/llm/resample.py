"""Operator 13, importance resampling: draw the documents that look most like a target.

A text's features are its runs of LOW to HIGH consecutive words, each hashed to a bucket. A bucket's
gain is the log ratio of its smoothed shares in the target and in the corpus, a document's weight the
sum of its features' gains, and the highest weights with Gumbel noise are drawn: a sample without
replacement in proportion to the ratios.

The words of a block of texts (BLOCK_BYTES of one partition; a longer text is a block of its own) are
numbered, and a suffix array over these numbers, sorted to HIGH words deep, brings equal runs
together. Where neighbours share their first L words, they are occurrences of one L-gram: such a run of
the common-prefix lengths is hashed once, and its bucket is scattered back to the places of all its
occurrences. The buckets of each place are written down, so counting and scoring do not read texts again.

Only bucket counts (as many as there are buckets) go through the driver. Places in the draw come from
ranges of the scores (``ordered.numbered``); equal rows are told apart by their number in the written
table, so even one key with a third of all rows is dealt over all parts.

Defined cases: a null text has no words, weight 0 and a score of its noise alone; a null key is hashed
as the empty string and comes last among equal scores; rows with one key have one noise, equal rows take
places of their own; a text of any length is taken whole; an empty corpus gives an empty result, an
empty target counts zero everywhere; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import kept, sql_crc32
from tidewright.operators import ordered

BUCKETS = 10_000
#: The runs of words that are features: from LOW to HIGH words.
LOW, HIGH = 1, 1
#: Documents with fewer words are never drawn.
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
BLOCK_BYTES = 4 << 20

#: A-Z become a-z; ASCII other than letters and digits parts words; all else is in words.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_BYTES).split()


@dataclass
class Hashed:
    """How many hashes were taken for how many occurrences."""

    hashes: int = 0
    places: int = 0


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes in the order of their first ``depth`` numbers, by doubling."""
    rank, done = ids, 1
    order = np.argsort(rank, kind="stable")
    while done < depth:
        after = np.full(len(ids), -1, np.int64)
        if done < len(ids):
            after[:-done] = rank[done:]
        order = np.lexsort((after, rank))
        a, b = rank[order], after[order]
        new = np.concatenate([[0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))])
        rank = np.empty(len(ids), np.int64)
        rank[order] = new
        done *= 2
    return order


def common_prefixes(ids: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix, how many leading numbers it shares with the one before it in order, up to ``depth``."""
    lcp = np.zeros(len(order), np.int64)
    same = np.ones(max(0, len(order) - 1), bool)
    for k in range(depth):
        a, b = order[1:] + k, order[:-1] + k
        inside = (a < len(ids)) & (b < len(ids))
        same = same & inside & (ids[np.minimum(a, len(ids) - 1)] == ids[np.minimum(b, len(ids) - 1)])
        lcp[1:] += same
    return lcp


def buckets_of(docs: list[list[bytes]], low: int, high: int, buckets: int, seen: Hashed | None = None) -> list[np.ndarray]:
    """The bucket of every feature of each text, shorter features first."""
    words = [w for d in docs for w in d]
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    sizes = np.array([len(d) for d in docs], np.int64)
    ends = np.repeat(np.cumsum(sizes), sizes)  # where the text of each place ends
    out: list[list[np.ndarray]] = [[] for _ in docs]
    if not len(ids):
        return [np.zeros(0, np.int64) for _ in docs]
    order = suffix_array(ids, high)
    lcp = common_prefixes(ids, order, high)
    for n in range(low, high + 1):
        whole = order + n <= ends[order]  # features do not cross texts
        run = np.cumsum(lcp < n) - 1
        # The first occurrence of a run that lies within one text stands for all of them.
        some, first = np.unique(run[whole], return_index=True)
        starts = order[whole][first]
        hashed = np.zeros(run[-1] + 1, np.int64)
        hashed[some] = [zlib.crc32(b" ".join(words[p : p + n])) % buckets for p in starts.tolist()]
        if seen is not None:
            seen.hashes += len(starts)
            seen.places += int(whole.sum())
        at = np.full(len(ids), -1, np.int64)
        at[order[whole]] = hashed[run[whole]]
        for i, part in enumerate(np.split(at, np.cumsum(sizes)[:-1])):
            out[i].append(part[part >= 0])
    return [np.concatenate(parts) for parts in out]


def blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """The rows in order, each table of about so many bytes of text at most, or of one row."""
    held, size = [], 0
    for batch in batches:
        start = 0
        for i, own in enumerate(pc.fill_null(pc.binary_length(batch["text"]), 0).to_pylist()):
            if size + own > most and (held or i > start):
                yield pa.Table.from_batches([*held, batch.slice(start, i - start)])
                held, size, start = [], 0, i
            size += own
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def featured(docs: DataFrame, key: str, text: str, low: int = LOW, high: int = HIGH, buckets: int = BUCKETS, block: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_words, n_features, buckets, row) of every text: the features' buckets as 2 or 4 bytes each, and a number of the row, fixed once written."""
    if not 1 <= low <= high:
        raise ValueError("features are runs of low to high words, one at least")
    kind = _kind(buckets)
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, block):
            words = [words_of(t) for t in part["text"].to_pylist()]
            found = buckets_of(words, low, high, buckets)
            columns = [
                part["id"].combine_chunks(), pa.array([len(w) for w in words], pa.int64()), pa.array([len(f) for f in found], pa.int64()),
                pa.array([f.astype(kind).tobytes() for f in found], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_features", "buckets"])

    made = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_features long, buckets binary")
    return made.withColumn("row", F.monotonically_increasing_id())


def _kind(buckets: int) -> type:
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def counts(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features each bucket holds, over all rows: each task counts its own, and as many rows as there are buckets come together."""
    kind = _kind(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for x in batch["buckets"]:
                total += np.bincount(np.frombuffer(x.as_buffer(), kind), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in features.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousand times the log ratio of the smoothed shares of each bucket, rounded down."""
    n, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    ratio = [(float(b + 1) * float(s + n)) / (float(a + 1) * float(t + n)) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weighed(features: DataFrame, gains: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, row, weight): the gains of a row's features, added up."""
    kind = _kind(len(gains))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            weight = [int(gains[np.frombuffer(x.as_buffer(), kind)].sum()) for x in b["buckets"]]
            yield pa.RecordBatch.from_arrays([b["id"], b["n_words"], b["n_features"], b["row"], pa.array(weight, pa.int64())], ["id", "n_words", "n_features", "row", "weight"])

    return features.mapInArrow(run, f"id {features.schema['id'].dataType.simpleString()}, n_words long, n_features long, row long, weight long")


def noise(key: Column, seed: int = SEED) -> Column:
    """A row's Gumbel noise in thousandths, rounded down, from a hash of the seed and its key."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resampled(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT,
    least_words: int = LEAST_WORDS, low: int = LOW, high: int = HIGH, buckets: int = BUCKETS, seed: int = SEED, block: int = BLOCK_BYTES,
) -> DataFrame:
    """(key, n_features, weight, score, rank) of every document; the rank is null for those that are not drawn.

    Drawn are ``percent`` of a hundred of the documents with ``least_words`` words, rounded down: those of the highest
    scores, of equal ones the smaller key.
    """
    own = kept(featured(docs, key, text, low, high, buckets, block), "features")
    like = kept(featured(target.select(F.lit(0).alias("id"), F.col(target_text).alias("text")), "id", "text", low, high, buckets, block), "target-features")
    gains = gains_of(counts(own, buckets), counts(like, buckets))
    eligible = F.col("n_words") >= least_words
    n = own.where(eligible).count() * percent // 100
    rows = weighed(own, gains).select("id", "n_features", "row", "weight", (F.col("weight") + noise(F.col("id"), seed)).alias("score"), eligible.alias("eligible"))
    placed = ordered.numbered(rows, [F.col("eligible").desc(), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row")], "rank")
    return placed.select(F.col("id").alias(key), "n_features", "weight", "score", F.when(F.col("rank") <= n, F.col("rank")).alias("rank"))


def _sql_words(table: str) -> str:
    """The words of a table's texts: only A-Z are lower-cased."""
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_extract_all({lowered}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


SQL = f"""
with docs as (select row_number() over () as k, doc_id, {_sql_words("documents")} as words from documents),
occurs as (select k, unnest(words) as w from docs),
targets as (select unnest({_sql_words("benchmark")}) as w from benchmark),
vocab as (select w, {sql_crc32("w")} % {BUCKETS} as b from (select w from occurs union select w from targets)),
s as (select b, count(*) as s from occurs join vocab using (w) group by 1),
t as (select b, count(*) as t from targets join vocab using (w) group by 1),
gains as (
  select b, floor(1000 * ln(((coalesce(t, 0) + 1)::double * ((select count(*) from occurs) + {BUCKETS})::double)
    / ((coalesce(s, 0) + 1)::double * ((select count(*) from targets) + {BUCKETS})::double)))::bigint as gain
  from s full join t using (b)),
sums as (select k, sum(gain)::bigint as weight from occurs join vocab using (w) join gains using (b) group by 1),
scored as (
  select k, doc_id, len(words)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5) / 4294967296)))::bigint as score
  from docs left join sums using (k)),
placed as (
  select *, row_number() over (partition by n_features >= {LEAST_WORDS} order by score desc, doc_id nulls last) as place,
    count(*) over (partition by n_features >= {LEAST_WORDS}) as n from scored)
select doc_id, n_features, weight, score, case when n_features >= {LEAST_WORDS} and place <= {PERCENT} * n // 100 then place end as rank from placed
"""
