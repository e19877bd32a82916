"""Operator 6, token counts: the library's own counts, with overlap resynchronisation for long texts.

A text of over CHUNK characters is encoded in overlapping chunks with offsets. Two neighbouring
chunks are spliced at a position that is proven stable: one at which a match of the pre-tokenizer
always ends, and after which matches do not depend on what went before. These are white space after
anything else (a match holds white space only at its start), a digit after a letter, and punctuation
after a letter or digit. (Not a letter after punctuation: an apostrophe takes some letters along.)
Both encodings must also have a token boundary there. A shorter text is one chunk, and is cut at all
of the first kind of these positions; the library encodes each of the stretches between them once a
task, as far as they are remembered. If the overlap holds no such position it is
doubled, up to the whole rest; so only a stretch of one kind of character, such as letters without
any space, sign or digit, is encoded at one go: it is one word to the pre-tokenizer too.

Defined cases: null text is empty and has no tokens; equal rows are counted each; other columns are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from typing import Any
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.bpe import slices
from tidewright.llm.common import slim

#: In characters.
CHUNK = 8_000
OVERLAP = 200
#: Encodings of this much text are held at a time.
BATCH_CHARS = 400_000
LIMIT = 512
#: Counts of about so many stretches, of at most so many characters each, are remembered.
REMEMBERED = 1 << 18
REMEMBERED_CHARS = 32
DIGITS = frozenset("0123456789")
#: White space of the pre-tokenizer's pattern; Python's also has the separators U+001C to U+001F, which are no white space there.
BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
STRETCH = re.compile(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+")
_IS_BLANK = re.compile(f"[{BLANK}]").fullmatch


@cache
def tokenizer(path: str) -> Any:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@cache
def splices(path: str) -> bool:
    """Whether texts may be cut at blanks: byte-level matches and tokens, every byte has one, and no added token that touches white space."""
    import json

    from tokenizers.pre_tokenizers import ByteLevel

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    plain = all(not (x["lstrip"] or x["rstrip"] or any(c.isspace() for c in x["content"])) for x in spec.get("added_tokens", []))
    model = spec["model"]
    spelled = model.get("type") == "BPE" and not (model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")) and set(ByteLevel.alphabet()) <= set(model["vocab"])
    return plain and spelled and spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")


@cache
def widths(t: Any) -> np.ndarray:
    """How many bytes each token holds, by its id: a byte-level vocabulary spells each byte as one character."""
    size = {i: len(token) for token, i in t.get_vocab(with_added_tokens=True).items()}
    size |= {i: len(x.content.encode()) for i, x in t.get_added_tokens_decoder().items()}
    found = np.zeros(max(size) + 1, np.int64)
    found[list(size)] = list(size.values())
    return found


def ends_of(t: Any, text: str, start: int) -> np.ndarray:
    """Where each token of a text that starts at byte ``start`` ends, in bytes.

    The tokens are summed up, as the library takes half as long again to give the offsets.
    """
    ids = t.encode_batch_fast([text], add_special_tokens=False)[0].ids
    return start + np.cumsum(widths(t)[np.array(ids, np.int64)])


def stable(left: str, right: str) -> bool:
    """Whether a match always ends between these two characters."""
    if _IS_BLANK(right):
        return not _IS_BLANK(left)
    a, b = category(left)[0], category(right)[0]
    return (a == "L" and right in DIGITS) or ((a == "L" or left in DIGITS) and b == "P")


def _meeting(text: str, low: int, high: int, at: int, left: np.ndarray, right: np.ndarray) -> tuple[int, int] | None:
    """The first stable position in (low, high) at which both encodings have a boundary, in characters and bytes. at: the bytes before low."""
    for p in range(low + 1, high):
        at += len(text[p - 1].encode())
        if stable(text[p - 1], text[p]) and all(ends[np.searchsorted(ends, at)] == at for ends in (left, right)):
            return p, at
    return None


@dataclass
class Splices:
    """How often chunks were spliced, and how often an overlap had to be widened for it."""

    spliced: int = 0
    widened: int = 0


def count_long(t: Any, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, seen: Splices | None = None) -> int:
    """The tokens of a text by chunks. seen: counts what was done."""
    seen = seen or Splices()
    total, begin, at = 0, 0, 0  # tokens from ``begin`` on, which is byte ``at``, are still to count
    end = min(chunk, len(text))
    now = ends_of(t, text[:end], 0)
    while end < len(text):
        wide = overlap
        while True:
            after = max(begin, end - wide)
            stop = min(len(text), after + chunk + wide)
            before = at + len(text[begin:after].encode())
            then = ends_of(t, text[after:stop], before)
            met = _meeting(text, after, end, before, now, then)
            if met is not None:
                seen.spliced += 1
                break
            seen.widened += 1
            if after == begin:  # no place to splice: encode on from here with a longer chunk
                if stop == len(text):
                    break
                chunk *= 2
            wide *= 2
        if met is None:
            now, end = then, stop
            continue
        p, cut = met
        total += int(np.searchsorted(now, cut, "right") - np.searchsorted(now, at, "right"))
        begin, at, now, end = p, cut, then, stop
    return total + len(now) - int(np.searchsorted(now, at, "right"))


@cache
def remembered(path: str) -> dict[str, int]:
    """The tokens of stretches that this process has met."""
    return {}


def count_short(path: str, texts: list[str]) -> list[int]:
    """The tokens of each text, as the sum of its stretches' tokens."""
    t, known, out = tokenizer(path), remembered(path), []
    for part in slices(texts, BATCH_CHARS):
        if len(known) > REMEMBERED:
            known.clear()
        cut = [STRETCH.findall(x) for x in texts[part]]
        new = list(set().union(*cut).difference(known))
        known |= zip(new, map(len, t.encode_batch_fast(new, add_special_tokens=False)), strict=True)
        out += [sum(map(known.__getitem__, own)) for own in cut]
        for x in new:
            if len(x) > REMEMBERED_CHARS:
                del known[x]
    return out


def counts_of(path: str, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """The tokens of each text; equal texts of the list are counted once."""
    t = tokenizer(path)
    found = dict.fromkeys(texts, 0)
    if splices(path):
        short = [x for x in found if len(x) <= chunk]
        found |= zip(short, count_short(path, short), strict=True)
        found |= {x: count_long(t, x, chunk, overlap) for x in found if len(x) > chunk}
    else:
        whole = list(found)
        for part in slices(whole, BATCH_CHARS):
            own = whole[part]
            found |= zip(own, map(len, t.encode_batch_fast(own, add_special_tokens=False)), strict=True)
    return [found[x] for x in texts]


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every whole text. path: a tokenizer file that executors have."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slim(batches):
            texts = [x or "" for x in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(counts_of(path, texts), pa.int64())],
                ["id", "n_bytes", "n_tokens"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    counted = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
