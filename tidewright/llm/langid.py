"""Operator 10, language identification: averaged hashed subword embeddings, linear softmax.

A text is the mean of the embeddings of its character n-grams' hashes (bytes of the lower-cased
text, runs of other characters than letters as one blank); a linear layer and a softmax follow. Both
are trained by stochastic gradient descent in numpy on a bounded, stratified sample of labelled
rows. As the model is linear in the mean, a whole text of any length is one sum. With few languages
the layer is multiplied into the embeddings once, so that each n-gram adds its class scores; with
many, the mean embedding is made first. Both give the same scores. Every label is a class.

Calibration: a held-back part of the sample fits the softmax temperature and the score below which
a prediction counts as rejected (``accepted`` is false; the language stays the likeliest one).

Defined cases: null text, and text without a letter, gives ``und`` and score 0; a row without a
language or key is never learned from; equal rows get equal answers; other columns are not read;
of equal scores the first language by name wins; an empty table gives an empty result; with no
labelled row every answer is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import slim
from tidewright.scratch import local_table

#: Bound of the training sample: about this many rows of each language, and at most twice it.
ROWS_PER_LANGUAGE = 800
#: With many languages each gets fewer, so that the driver holds about so many rows in all, but never fewer than LEAST_ROWS.
ROWS_IN_ALL, LEAST_ROWS = 12_000, 3
#: Of a longer text a stretch of this many characters, at a hashed place, is learned from, which bounds the sample's bytes; it is predicted whole like all.
TRAIN_CHARS = 20_000
GRAMS = (2, 3)
BUCKETS = 1 << 15
DIMENSIONS = 16
EPOCHS = 6
RATE = 0.4
SEED = 7
#: Share of right answers on the calibration rows that the rejection threshold must not lose.
KEEP = 0.995
UNKNOWN = "und"
BATCH_BYTES = 1 << 22

_SPREAD = np.uint32(2654435761)
_BLANK = np.frombuffer(bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)), np.uint8)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of every text, and where each text's buckets begin.

    Texts stand one after another between blanks; a gram belongs to the text in which it starts,
    and only blanks lie beyond a text's end.
    """
    pad = b" " * max(GRAMS)
    joined = _BLANK[np.frombuffer(b"".join(b" " + t + pad for t in texts), np.uint8)]
    # Runs of blanks count as one.
    keep = np.ones(len(joined), bool)
    keep[1:] = (joined[1:] != 32) | (joined[:-1] != 32)
    starts = np.cumsum([0] + [len(t) + 1 + len(pad) for t in texts])
    at = np.concatenate([[0], np.cumsum(keep)])[starts]
    x = joined[keep].astype(np.uint32)
    n = len(x)
    x = np.concatenate([x, np.full(max(GRAMS), 32, np.uint32)])
    columns = []
    for size in GRAMS:
        h = x[:n].copy()
        for k in range(1, size):
            h = (h << np.uint32(8)) | x[k : k + n]
        h = (h + np.uint32(size)) * _SPREAD
        columns.append((h >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int32))
    # The grams of one text stay together: all sizes at one place, then the next place.
    return np.stack(columns, 1).ravel(), at * len(GRAMS)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    embeddings: np.ndarray  # BUCKETS x dimensions; with few languages BUCKETS x languages, the layer multiplied in
    layer: np.ndarray | None  # dimensions x languages
    temperature: float
    threshold: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        import regex

        letter = regex.compile(r"\p{L}").search
        known = [i for i, t in enumerate(texts) if t and self.languages and letter(t)]
        names, best = [UNKNOWN] * len(texts), np.zeros(len(texts))
        start = 0
        while start < len(known):
            size, stop, batch = 0, start, []
            while stop < len(known) and (size < BATCH_BYTES or stop == start):
                raw = texts[known[stop]].lower().encode("utf-8", "replace")
                batch.append(raw)
                size += len(raw)
                stop += 1
            logits = self.logits(batch) / self.temperature
            e = np.exp(logits - logits.max(1, keepdims=True))
            p = e / e.sum(1, keepdims=True)
            for i, k, s in zip(known[start:stop], p.argmax(1).tolist(), p.max(1).tolist(), strict=True):
                names[i], best[i] = self.languages[k], s
            start = stop
        return names, best

    def logits(self, texts: list[bytes]) -> np.ndarray:
        buckets, at = grams(texts)
        # One text after another may be larger than memory likes as vectors: sum each column apart.
        sums = np.stack([np.add.reduceat(self.embeddings[buckets, k], at[:-1]) for k in range(self.embeddings.shape[1])], 1)
        mean = sums / np.diff(at)[:, None]
        return mean if self.layer is None else mean @ self.layer


def train(texts: list[str], labels: list[str]) -> Model:
    """Fit on the rows given; one in five is held back for calibration."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), None, 1.0, 0.0)
    rng = np.random.default_rng(SEED)
    number = {x: k for k, x in enumerate(languages)}
    y = np.array([number[x] for x in labels])
    bags = []
    for t in texts:
        buckets, _ = grams([t.lower().encode("utf-8", "replace")])
        ids, counts = np.unique(buckets, return_counts=True)
        bags.append((ids, (counts / len(buckets)).astype(np.float32)))
    order = rng.permutation(len(texts))
    held, fit = (order[: len(order) // 5], order[len(order) // 5 :]) if len(order) >= 20 else (order, order)
    emb = (rng.standard_normal((BUCKETS, DIMENSIONS)) / DIMENSIONS).astype(np.float32)
    out = np.zeros((DIMENSIONS, len(languages)), np.float32)
    steps, done = EPOCHS * len(fit), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(fit):
            ids, w = bags[i]
            rate = RATE * (1 - done / steps)
            done += 1
            x = w @ emb[ids]
            z = x @ out
            e = np.exp(z - z.max())
            g = e / e.sum()
            g[y[i]] -= 1
            back = out @ g
            out -= rate * np.outer(x, g)
            # The mean's gradient falls on each n-gram by its share; the factor makes up for averaging.
            emb[ids] -= (rate * 20 * w)[:, None] * back[None, :]
    z = np.stack([(w @ emb[ids]) @ out for ids, w in (bags[i] for i in held)])
    truth = y[held]

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(1, keepdims=True)
        return float(-(s[np.arange(len(s)), truth] - np.log(np.exp(s).sum(1))).mean())

    temperature = min(np.geomspace(0.05, 5, 60).tolist(), key=loss)
    s = z / temperature
    p = np.exp(s - s.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    right = np.sort(p.max(1)[p.argmax(1) == truth])
    threshold = float(right[int((1 - KEEP) * len(right))]) if len(right) else 0.0
    few = len(languages) <= DIMENSIONS
    return Model(languages, (emb @ out).astype(np.float32) if few else emb, None if few else out, temperature, threshold)


def fold(key: str, folds: int = 3) -> F.Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


def sample(docs: DataFrame, key: str, text: str, lang: str, rows: int) -> DataFrame:
    """(key, text, lang): a bounded sample of each language from the rows learned from.

    Counts per language, over all its rows, give each its share; a hash of key and text decides which rows are read.
    """
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (fold(key) != 1))
    fit = labelled.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    sizes = fit.groupBy("lang").count().collect()  # one row a class
    if not sizes:
        return fit.limit(0)
    rows = max(LEAST_ROWS, min(rows, ROWS_IN_ALL // len(sizes)))
    shares = local_table(docs.sparkSession, {"lang": pa.array([r["lang"] for r in sizes]), "share": pa.array([min(1.0, rows / r["count"]) for r in sizes])})
    u = F.pmod(F.xxhash64(F.lit("langid"), F.col("key"), F.col("text")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    over = F.greatest(F.char_length("text") - TRAIN_CHARS, F.lit(0))
    start = F.pmod(F.xxhash64(F.lit("stretch"), F.col("key")), over + 1).cast("int") + 1
    learned = F.when(over > 0, F.substring("text", start, F.lit(TRAIN_CHARS))).otherwise(F.col("text"))
    return fit.join(shares, "lang").where(u < F.col("share")).select("key", learned.alias("text"), "lang").limit(2 * rows * len(sizes))


def fitted(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = ROWS_PER_LANGUAGE) -> Model:
    got = sorted((r["key"], r["text"], r["lang"]) for r in sample(docs, key, text, lang, rows).collect())
    return train([t for _, t, _ in got], [x for _, _, x in got])


def identified(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, lang_pred, score, accepted) of every whole text."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most BUCKETS x DIMENSIONS + DIMENSIONS x classes numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slim(batches):
            names, best = m.predict(batch["text"].to_pylist())
            ok = pa.array((best >= m.threshold) & np.array([n != UNKNOWN for n in names], bool))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(names, pa.string()), pa.array(best), ok], ["id", "lang_pred", "score", "accepted"])

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, lang_pred string, score double, accepted boolean").withColumnRenamed("id", key)
    return out.select(key, F.coalesce(fold(key) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")
