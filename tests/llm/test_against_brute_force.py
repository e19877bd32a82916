"""Plain Python versions of operators that SQL can't express, on small fixtures and on the small data set."""

from __future__ import annotations

import os
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tidewright.llm import bpe, fingerprint, langid, quality, simhash, suffix
from tests.llm.test_operators import RANKS, _brute_repeats, corpus, public_tokenizers

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the small data set is not here")


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# Fingerprints.


def plain_fingerprint(text):
    paras = []
    for line in text.split("\n"):
        paras += [line] if len(line) < 16 else [m for m in re.findall(r"(?:[^\s]*+\s){0,7}[^\s]*+(?:\s|$)", line, re.ASCII) if m]
    lanes, bits = [0] * 8, [[0] * 3 for _ in range(42)]
    for q in paras:
        raw = q.encode()
        seeds = [42] + [xxhash.xxh64_intdigest(i.to_bytes(4, "little"), 42) for i in (1, 2, 3)]
        hs = [xxhash.xxh64_intdigest(raw, s) for s in seeds]
        for i, h in enumerate(hs):
            lanes[2 * i] = (lanes[2 * i] + (h & 0xFFFFFFFF)) % 2**32
            lanes[2 * i + 1] = (lanes[2 * i + 1] + (h >> 32)) % 2**32
        for i, h in enumerate(hs[2:]):
            for k in range(21):
                for j in range(3):
                    bits[21 * i + k][j] = (bits[21 * i + k][j] + (h >> (k + 21 * j) & 1)) % 2**20
    return len(paras), lanes, bits


def as_hex(fp):
    n, lanes, bits = fp
    return "".join(f"{x:016x}" for x in [n, *lanes, *(b[0] | b[1] << 21 | b[2] << 42 for b in bits)])


def plain_likeness(a, b):
    signed = lambda fp: [2 * x - fp[0] for part in fp[2] for x in part]
    x, y = signed(a), signed(b)
    total = sum(v * v for v in x) + sum(v * v for v in y)
    return max(0.0, 1 - sum((p - q) ** 2 for p, q in zip(x, y, strict=True)) / total) if total else 1.0


def test_fingerprints_of_texts_and_of_edited_texts(spark):
    rows = sorted({r[0]: (r[1] or "").replace("\r", "") for r in corpus() if r[0] is not None}.items())
    got = {r["doc_id"]: r for r in fingerprint.compared(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        own, new, other = (plain_fingerprint(x) for x in (t, edited, after))
        assert got[i]["fingerprint"] == as_hex(own) and got[i]["edited_fingerprint"] == as_hex(new)
        assert got[i]["near_edited"] == pytest.approx(plain_likeness(own, new)) and got[i]["near_next"] == pytest.approx(plain_likeness(own, other))


# Quality rules.


def plain_verdict(t):
    t = t or ""
    w = words_of(t)
    n = len(w)
    grams = [tuple(w[i : i + 5]) for i in range(n - 4)]
    often = Counter(grams)
    inside = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if words_of(x)]
    twice = len(lines) - len(set(lines))
    chars = sum(map(len, w))
    return not (
        n < 10
        or 100 * len(inside) > 20 * n
        or len(re.findall(r"[#*$%&|<>]", t)) > 0.25 * n
        or (twice > 2 and twice > 0.3 * len(lines))
        or sum(a == b for a, b in zip(w, w[1:], strict=False)) > 0.25 * n
        or not 2 * n <= chars <= 20 * n
    )


def test_the_verdict_of_the_rules(spark):
    texts = [r[1] for r in corpus()] + ["ab " * 5 + " ".join(f"w{i}" for i in range(30)), "a " * 40, " ".join(f"w{i} w{i}" for i in range(30)), "\n".join(["same line"] * 5 + [f"line {i} of many others" for i in range(9)]), " ".join("x" * 30 for _ in range(12))]
    texts += [" ".join(f"w{i}" for i in range(20)) + " #" * k for k in (4, 6, 8)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for rules in (None, quality.RULES[::-1]):
        got = {r["doc_id"]: r["kept"] for r in quality.judged(df, rules).collect()}
        assert got == {i: plain_verdict(t) for i, t in enumerate(texts)}
        assert {r["doc_id"] for r in quality.cascade(df, rules).collect()} == {i for i, t in enumerate(texts) if plain_verdict(t)}


def test_the_order_of_the_rules_is_greedy():
    rejected = [frozenset({1, 2, 3}), frozenset({1, 2, 3, 4}), frozenset({9}), frozenset()]
    assert quality.greedy(rejected, [1.0, 1.0, 1.0, 0.1], ["a", "b", "c", "d"]) == [1, 2, 3, 0]


# Language identification.


@needs_data
def test_held_out_accuracy_on_the_documents(spark):
    # A thousand documents: the smallest set has some forty to learn a language from.
    docs = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/documents.parquet")
    got = langid.identified(docs, langid.fitted(docs)).join(docs.select("doc_id", "lang"), "doc_id")
    held = got.where("held_out and lang is not null and lang_pred <> 'und'")
    right, n = held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert n > 30 and right >= 0.95


def test_many_labels_are_all_classes(spark):
    rng = random.Random(3)
    names = [f"l{k:02}" for k in range(40)]
    stems = {x: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(6)] for x in names}
    rows = [(i, " ".join(rng.choice(stems[names[i % 40]]) for _ in range(30)), names[i % 40], "a", 1) for i in range(1600)]
    rows.append((5000, "x" * 300_000, "l00", "b", 2))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, key string, share int")
    model = langid.fitted(df)
    assert model.languages == names and model.layer is not None
    got = langid.identified(df, model).join(df.select("doc_id", "lang"), "doc_id").where("held_out and doc_id < 5000")
    assert got.where("lang = lang_pred").count() >= 0.9 * got.count()


# The pipeline, stage by stage, and from end to end.


def shingles(t):
    w = words_of(re.sub(r"[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_pairs(texts, least):
    """Pairs of texts whose shingle sets have that similarity."""
    sets = {i: shingles(t) for i, t in texts.items()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    shared = Counter()
    for own in holders.values():
        own.sort()
        for k, a in enumerate(own):
            for b in own[k + 1 :]:
                shared[a, b] += 1
    return {p for p, n in shared.items() if n >= least * (len(sets[p[0]]) + len(sets[p[1]]) - n)}


@needs_data
def test_the_pipeline_against_brute_force(spark):
    import tiktoken

    import corpus_pipeline as c
    from tidewright.llm import mixing

    stages = dict(c.STAGES)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}

    kept = stages["quality_rules"](spark, docs, DATA)
    good = {i: t for i, t in texts.items() if plain_verdict(t)}
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == good

    alone = {r["doc_id"]: r["text"] for r in stages["simhash_near_dedup"](spark, kept, DATA).collect()}
    alike = near_pairs(good, 0.8)
    assert sum(not {a, b} <= set(alone) for a, b in alike) >= 0.9 * len(alike)
    lost = set(good) - set(alone)
    forest = simhash.Forest(max(good) + 1)
    for a, b in alike:
        forest.join(a, b)
    assert all(any(forest.root(i) == forest.root(j) for j in alone) for i in lost) and all(good[i] == alone[i] for i in alone)

    left = spark.createDataFrame(kept.where(F.col("doc_id").isin(*alone)).collect(), kept.schema)
    cut = {r["doc_id"]: r["text"] for r in stages["suffix_array_dedup"](spark, left, DATA).collect()}
    ids = sorted(alone)
    want = _brute_repeats([alone[i] for i in ids], c.PASSAGE_BYTES)
    raw = {r["doc_id"]: r for r in suffix.digests(left, window=c.PASSAGE_BYTES).collect()}
    assert [(raw[i]["n_bytes"], raw[i]["n_removed"], raw[i]["n_spans"], raw[i]["kept_sha256"]) for i in ids] == want
    assert all(cut[i] == raw[i]["text"] for i in ids)

    shown = spark.createDataFrame([(i, t, "x") for i, t in cut.items()], "doc_id long, text string, source string")
    per = Counter(r["doc_id"] for r in mixing.mixed(shown).collect())
    assert set(per) <= set(cut)

    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.codec(RANKS, public_tokenizers.PATTERN).ranks, special_tokens={})
    out = c.run(spark, DATA).collect()
    assert out and {r["doc_id"] for r in out} <= set(cut)
    assert all(list(r["ids"]) == lib.encode_ordinary(cut[r["doc_id"]] or "") for r in out)


def test_the_pipeline_on_nulls_and_on_no_rows(spark):
    import corpus_pipeline as c

    rows = [(*r, "x") for r in corpus()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, keep string")
    for df in (docs, docs.limit(0)):
        for name, stage in c.STAGES:
            out = stage(spark, df, DATA)
            if name != "byte_bpe":
                assert out.columns == df.columns, name
            n = out.count()
            assert n <= max(df.count() * 60, 0)
            df = spark.createDataFrame(out.collect(), out.schema) if name != "byte_bpe" else out


def test_links_are_decided_alike_in_one_block_and_in_many(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 8, dtype=np.uint64)
    fps = np.unique((base[:, None] ^ (np.uint64(1) << rng.integers(0, 64, (8, 60)).astype(np.uint64))).ravel())[:, None]
    pairs = lambda: {tuple(sorted(p)) for a, b in simhash.linked_pairs(fps, [2], np.arange(len(fps))) for p in zip(a.tolist(), b.tolist(), strict=True)}
    whole = pairs()
    monkeypatch.setattr(simhash, "BLOCK", 8)
    assert pairs() == whole and len(whole) > 100
