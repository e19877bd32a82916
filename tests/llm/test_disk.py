"""What the near-copy stage holds on disk: pairs that are not alike, shuffles of what is written, covering tables."""

from __future__ import annotations

import random
import time

import numpy as np
from pyspark.sql import functions as F

from tidewright.llm import common, simhash


def test_pairs_that_are_not_alike_carry_no_sets(spark, monkeypatch):
    """Pairs of texts at a similarity of 0.7 share shingles of their prefixes; before, all 40 went on to the sets."""
    rnd = random.Random(3)
    word = lambda: f"w{rnd.randrange(10**9)}"
    rows = []
    for i in range(40):
        own = [word() for _ in range(300)]
        # Behind 247 words all others differ: 243 shingles of 296 in either.
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(own[:247] + [word() for _ in range(53)]))]
    rows += [(80, "one two three four five six seven eight nine ten"), (81, "one two three four five six seven eight nine ten eleven")]
    written = {}
    kept = common.kept
    monkeypatch.setattr(common, "kept", lambda df, name: (out := kept(df, name), written.setdefault(name, []).append(out.count()))[0])
    monkeypatch.setattr(simhash, "kept", common.kept)
    left = {r["doc_id"] for r in simhash.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left == {*range(81)}
    assert written["meeting"][0] >= 30 and written["rest"][0] <= 3


def test_parity_keeps_every_pair_at_the_similarity(spark):
    rng = np.random.default_rng(7)
    sets, pairs, alike = [], [], set()
    for i in range(400):
        n = int(rng.integers(1, 700))
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        extra = int(rng.integers(0, n // 3 + 2))
        b = np.concatenate([a[: n - int(rng.integers(0, n // 5 + 1))], rng.integers(0, 1 << 63, extra, dtype=np.uint64)])
        sets += [(2 * i, len(a), simhash.parity_of(a).tolist()), (2 * i + 1, len(b), simhash.parity_of(b).tolist())]
        pairs.append((2 * i, 2 * i + 1))
        both = len(np.intersect1d(a, b))
        if both >= 0.8 * (len(a) + len(b) - both):
            alike.add(pairs[-1])
    lengths = {(len(sets[a][2]), len(sets[b][2])) for a, b in pairs}
    assert any(n != m for n, m in lengths) and len(alike) > 100
    made = spark.createDataFrame(sets, "node long, size int, parity array<bigint>")
    found = {tuple(r) for r in simhash.near_by_parity(spark.createDataFrame(pairs, "a_node long, b_node long"), made, 0.8).collect()}
    assert alike <= found and len(found - alike) < 100


def test_shuffle_files_go_with_what_they_made(spark):
    env = spark._jvm.org.apache.spark.SparkEnv.get()
    files = lambda: sum("shuffle" in f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(env.blockManager().diskBlockManager().getAllFiles()))
    before, setting = files(), spark.conf.get(common.SHUFFLES_GO)
    out = common.kept(spark.range(1000).repartition(3, "id"), "rows")
    end = time.monotonic() + 20
    while files() > before and time.monotonic() < end:
        time.sleep(0.2)
    assert files() <= before and out.count() == 1000
    assert spark.conf.get(common.SHUFFLES_GO) == setting


def test_tables_in_turns_link_the_same(spark, monkeypatch):
    rnd = random.Random(5)
    docs = []
    for i in range(120):
        own = [f"w{rnd.randrange(10**6)}" for _ in range(60)]
        docs += [(3 * i + k, " ".join(own[: 60 - k])) for k in range(3)]
    made = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted(map(tuple, simhash.near_duplicates(made).collect()))
    monkeypatch.setattr(simhash, "TABLES_AT_ONCE", 2)
    assert sorted(map(tuple, simhash.near_duplicates(made).collect())) == want
    monkeypatch.setattr(simhash, "TABLES_AT_ONCE", 100)
    whole = sorted(r[0] for r in simhash.one_of_each_group(made).select("doc_id").collect())
    monkeypatch.setattr(simhash, "TABLES_AT_ONCE", 1000)
    assert sorted(r[0] for r in simhash.one_of_each_group(made).select("doc_id").collect()) == whole
    assert made.agg(F.count("*")).first()[0] > len(whole)
