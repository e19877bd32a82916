"""Each operator against a brute-force version or an exact round trip, and in its corner cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewright.llm import anchors, bpe, fingerprint, induced, langid, mixing, quality, shards, simhash, suffix, token_count, urls
from tidewright.llm.components import components

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS, JSON = (public_tokenizers.path(f"byte_bpe_50k.{x}") for x in ("tiktoken", "json"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, h1 long, fp0 long, spans string, copies long, tokens string, words string"


def _text(rng, n, alphabet="abcdefgh é\n"):
    return "".join(rng.choice(alphabet) for _ in range(n))


def corpus():
    """Nulls, empty and long texts, equal rows, near copies, shared passages, odd characters."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = say(180), say(90)
    near = base.split()
    near[40], near[120] = "changed", "altered"
    texts = [
        None, "", " \n\t ", "a", "a b", "one two three", base, base, " ".join(near), say(60) + "\n" + passage + "\n" + say(30), say(50) + "\n" + passage,
        "x y " * 300, "z" * 1500, say(4000), "😀 é \0 <|endoftext|> don't 123", "Zeile\nZeile\nZeile\nneu", "###$$$ %%% &&&", say(12), say(12).upper(),
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(6, base), (None, say(40)), (None, None), (100, say(25))]
    return [(i, t, ("en" if k % 2 else "de") if k % 7 else None, f"s{k % 3}" if k % 5 else None, len(t or "")) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", 1, 2, "y", 3, "z", "w") for r in corpus()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_bpe_matches_the_library_and_decodes(spark, docs, none):
    import tiktoken

    c = bpe.codec(RANKS, public_tokenizers.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    want = []
    for r in corpus():
        ids, t = lib.encode_ordinary(r[1] or ""), (r[1] or "").encode()
        want.append((r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t).hexdigest()))
    assert rows_of(bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN)) == sorted(want, key=repr)
    back = bpe.decoded(bpe.encoded(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert sorted((bytes(r["bytes"]) for r in back.collect())) == sorted((r[1] or "").encode() for r in corpus())
    assert bpe.round_trip(none, RANKS, public_tokenizers.PATTERN).count() == 0
    with c:
        for word in ("a" * 700, "ab" * 90, "é" * 300, "xyzzy" * 60, " " * 200):
            assert c.encode([word])[0].tolist() == lib.encode_ordinary(word)


def test_bpe_forgets_words_and_stays_right(monkeypatch):
    monkeypatch.setattr(bpe, "WORDS_KEPT", 3)
    with bpe.Codec(RANKS, public_tokenizers.PATTERN) as c:
        first = c.encode(["alpha beta gamma delta"])[2]
        c.encode(["other words entirely here now"])
        assert c.encode(["alpha beta gamma delta"])[2] == first


def test_fingerprints(spark, docs, none):
    got = fingerprint.compared(docs).collect()
    assert len(got) == len(corpus())
    by_text = {}
    keyed = sorted({r[0]: None for r in corpus() if r[0] is not None})
    texts = {}
    for r in corpus():
        if r[0] is not None:
            texts.setdefault(r[0], r[1] or "")
    want = Counter()
    for r in corpus():
        t = r[1] or ""
        q = len(t) // 4
        head = texts[keyed[(keyed.index(r[0]) + 1) % len(keyed)]][:q] if r[0] is not None else ""
        want[r[0], len(t), hashlib.sha256((t[: len(t) - q] + head).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        by_text.setdefault(r["edited_sha256"], set()).add(r["edited_fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())
    assert fingerprint.compared(none).count() == 0


def test_fingerprint_is_a_multiset_hash(spark):
    df = spark.createDataFrame([("a\nb b b\nc", "c\na\nb b b", "a\nc", "b b b", "a\nb b\nc")], "p string, q string, part string, rest string, other string")
    for c in df.columns:
        df = fingerprint.fingerprinted(df, F.col(c), f"f_{c}")
    both, left = fingerprint.plus(F.col("f_part"), F.col("f_rest")), fingerprint.minus(F.col("f_p"), F.col("f_rest"))
    row = df.select("f_p", "f_q", "f_part", "f_other", both.alias("both"), left.alias("left")).first()
    assert row["f_p"] == row["f_q"] == row["both"] and row["left"] == row["f_part"] and row["f_p"] != row["f_other"]


def test_fingerprint_likeness_follows_the_overlap(spark):
    rng = random.Random(1)
    lines = [_text(rng, 40, "abcdefghij ") for _ in range(200)]
    rows = [("\n".join(lines), "\n".join(lines[:k] + [x + "!" for x in lines[k:]])) for k in (0, 100, 150, 200)]
    df = spark.createDataFrame(rows, "a string, b string")
    df = fingerprint.fingerprinted(fingerprint.fingerprinted(df, F.col("a"), "fa"), F.col("b"), "fb")
    df = df.select(fingerprint.signs("fa").alias("sa"), fingerprint.signs("fb").alias("sb")).select(fingerprint.likeness("sa", "sb").alias("x"))
    got = [r["x"] for r in df.collect()]
    assert got[3] == 1 and got[0] < 0.3 and 0.3 < got[1] < 0.7 and 0.55 < got[2] < 0.95


def _components(fps, radius):
    up = {f: f for f in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= radius:
                up[root(b)] = root(a)
    return {f: root(f) for f in fps}


def test_simhash_components(spark, docs, none):
    def one(t):
        w = [x.decode() for x in re.sub(r"[A-Z]", lambda m: m[0].lower(), t or "").encode().split()]
        grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    fps = [one(r[1]) for r in corpus()]
    comp = _components(set(fps), 2)
    least = {}
    for r, f in zip(corpus(), fps, strict=True):
        if r[0] is not None:
            least[comp[f]] = min(least.get(comp[f], 10**9), r[0])
    want = sorted(((r[0], f"{f:016x}", least.get(comp[f])) for r, f in zip(corpus(), fps, strict=True)), key=repr)
    assert rows_of(simhash.near_duplicates(docs)) == want
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 6])
def test_masks_cover_the_radius(radius):
    rng = random.Random(radius)
    masks = simhash.masks(radius)
    for _ in range(500):
        bits = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(not bits & m for m in masks)


def test_large_buckets_lose_no_link(monkeypatch):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 20, dtype=np.uint64)
    flip = lambda: np.uint64(1) << rng.integers(0, 64, 20).astype(np.uint64)
    x = np.unique(np.concatenate([base ^ flip() ^ flip() for _ in range(40)]))
    monkeypatch.setattr(simhash, "BLOCK", 16)
    forest = simhash.Forest(len(x))
    simhash.join_links(x[:, None], [2], np.arange(len(x)), forest)
    assert len(x) - len(forest.links) == len(set(_components([int(v) for v in x], 2).values()))


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100)], "a int, b int")
    got = {r["node"]: r["component"] for r in components(edges, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_one_of_each_group(spark, docs, none):
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns
    texts = [r["text"] for r in kept.collect()]
    base = corpus()[6][1]
    assert sum(t == base for t in texts) == 1 and corpus()[8][1] not in texts
    assert sum(t is None or not t.strip() for t in texts) == 1
    assert corpus()[9][1] in texts and corpus()[17][1] in texts
    assert simhash.one_of_each_group(none).count() == 0


def _edited(rng, base, share, fresh):
    return " ".join(rng.choice(fresh) if rng.random() < share else w for w in base)


def _likeness(texts):
    """Jaccard similarities of the sets of distinct five-word shingles, all pairs."""
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    return np.array([[len(a & b) / len(a | b) for b in sets] for a in sets])


def test_one_of_each_group_among_loose_neighbours(spark):
    """The kept texts are those of all pairs at 0.8 that meet, though most pairs of the group are a bit below."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(900)]
    base = [rng.choice(words) for _ in range(600)]
    texts = [_edited(rng, base, 0.005 + 0.03 * i / 120, words) for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    near = _likeness(texts)
    assert ((near >= 0.7) & (near < 0.8)).sum() > 1.5 * ((near >= 0.8) & (near < 1)).sum()
    forest = simhash.Forest(len(texts))
    for a, b in np.argwhere(near >= 0.8).tolist():
        forest.join(a, b)
    want = sorted({forest.root(i) for i in range(len(texts))})
    assert 5 < len(want) < len(texts) - 5
    got = sorted(r["doc_id"] for r in simhash.one_of_each_group(docs).collect())
    # Nothing goes without a chain of links; a pair is lost only if no table holds it.
    assert set(want) <= set(got) and len(set(got) - set(want)) <= 2


def test_the_nearest_forests_keep_a_true_link_behind_refused_ones():
    rng = np.random.default_rng(5)
    n, links = 60, [(i, j) for i in range(60) for j in range(i)]
    a, b = np.array(links).T
    apart = rng.integers(0, 1000, len(links))
    forests = simhash.NearestForests(n)
    for i in range(0, len(links), 100):
        forests.add(a[i : i + 100], b[i : i + 100], apart[i : i + 100])
    x, y, bits = forests.links()
    assert len(x) <= simhash.FORESTS * (n - 1) and len({*zip(x.tolist(), y.tolist(), strict=True)}) == len(x)
    at = {tuple(sorted(p)): d for p, d in zip(links, apart.tolist(), strict=True)}
    assert all(at[p] == d for p, d in zip(zip(x.tolist(), y.tolist(), strict=True), bits.tolist(), strict=True))
    # Whatever two of the links are refused, the others still join all.
    for i in range(0, len(x) - 1, 7):
        forest = simhash.Forest(n)
        for k, (p, q) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
            if k not in (i, i + 1):
                forest.join(p, q)
        assert len({forest.root(k) for k in range(n)}) == 1


def test_the_nearest_forests_alike_in_pieces(monkeypatch):
    rng = np.random.default_rng(6)
    links = [(i, j) for i in range(80) for j in range(i)]
    a, b = np.array(links).T
    apart = rng.permutation(len(links))

    def found():
        forests = simhash.NearestForests(80)
        for i in range(0, len(links), 50):
            forests.add(a[i : i + 50], b[i : i + 50], apart[i : i + 50])
        return {*zip(*(x.tolist() for x in forests.links()), strict=True)}

    whole = found()
    monkeypatch.setattr(simhash, "LINKS_AT_ONCE", 300)
    monkeypatch.setattr(simhash, "LINKS_AT_A_LOOK", 16)
    assert found() == whole


def test_nothing_goes_below_the_similarity(spark):
    """Pairs from 0.7 to 0.8 both stay, whatever their wide fingerprints say; pairs from 0.8 lose one."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(5000)]
    rows, near = [], {}
    while len(near) < 160:
        base = [rng.choice(words) for _ in range(rng.randint(80, 400))]
        pair = [" ".join(base), _edited(rng, base, rng.uniform(0.02, 0.035), words)]
        share = _likeness(pair)[0, 1]
        if 0.7 <= share < 0.85:
            near[len(rows)] = share
            rows += [(len(rows) + k, t) for k, t in enumerate(pair)]
    left = {r["doc_id"] for r in simhash.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    below = [i for i, x in near.items() if x < 0.8]
    above = [i for i, x in near.items() if x >= 0.8]
    assert len(below) > 40 and len(above) > 40
    assert all(i in left and i + 1 in left for i in below)
    assert sum(i + 1 not in left for i in above) >= 0.95 * len(above)


def test_buckets_stream_whole():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    keys = np.sort(rng.integers(0, 40, 1000))
    cuts = np.sort(rng.integers(0, 1000, 60))
    batches = [pa.RecordBatch.from_arrays([pa.array(x)], ["key"]) for x in np.split(keys, cuts)]
    got = [t["key"].to_numpy() for t in simhash.whole_buckets(iter(batches), 90)]
    assert np.array_equal(np.concatenate(got), keys) and len(got) > 4
    assert all(not set(a) & set(b) for a, b in zip(got, got[1:], strict=False))


def test_one_of_each_group_finds_pairs_at_the_similarity(spark):
    """Of pairs whose shingle sets have a similarity of 0.8 or a little more, nearly all lose a member; of pairs at 0.6 hardly any."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(5000)]
    sets = lambda t: {tuple(w[i : i + 5]) for w in [t.split()] for i in range(len(w) - 4)}
    alike, apart, rows = [], [], []
    while len(alike) < 150 or len(apart) < 80:
        base = [rng.choice(words) for _ in range(rng.randint(80, 500))]
        other = _edited(rng, base, rng.choice([0.021, 0.05]), words)
        a, b = sets(" ".join(base)), sets(other)
        near = len(a & b) / len(a | b)
        to = alike if 0.8 <= near < 0.86 else apart if 0.5 < near < 0.65 else None
        if to is None:
            continue
        to.append(len(rows))
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, other)]
    kept = {r["doc_id"] for r in simhash.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(i + 1 not in kept for i in alike) >= 0.95 * len(alike)
    assert sum(i + 1 in kept for i in apart) >= 0.95 * len(apart)
    assert all(i in kept for i in alike + apart)


def test_one_of_each_group_leaves_no_link_out(spark):
    """Short texts and their copies with two words more: 9 of 11 shingles, with fingerprints often far apart."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8))
    rows = []
    for i in range(300):
        text = " ".join(word() for _ in range(13))
        rows += [(2 * i, text), (2 * i + 1, f"{text} {word()} {word()}")]
    left = {r["doc_id"] for r in simhash.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left == {2 * i for i in range(300)}


def test_what_many_sets_share_gives_no_row_for_each_pair(spark):
    """Sets that share shingles of their prefixes with all others, and three pairs at 0.8 or a little more: all of these come, of the others few."""
    rng = np.random.default_rng(5)
    fresh = lambda n: rng.integers(1 << 32, 1 << 63, n, dtype=np.uint64)
    common = np.sort(rng.integers(0, 1 << 32, 60, dtype=np.uint64))
    none = np.zeros(0, np.uint64)
    sets = [np.concatenate([fresh(40), common]) for _ in range(300)]
    # The common ones come behind 14 rarer ones of 100: in the prefixes of 21, but not in front of two sets of that size.
    rarer = [np.concatenate([rng.integers(0, 1 << 20, 14, dtype=np.uint64), x[14:]]) for x in sets]
    base = [fresh(100) for _ in range(3)]
    alike = [np.concatenate([x[:n], fresh(m)]) for x, n, m in zip(base, (90, 80, 89), (11, 0, 11), strict=True)]
    shares = [len(np.intersect1d(a, b)) / len(np.union1d(a, b)) for a, b in zip(base, alike, strict=True)]
    assert min(shares) >= 0.8 and max(shares) < 0.82
    rows = [(i, i, len(x), simhash.prefix_of(x, 0.8, none, none).view(np.int64).tolist()) for i, x in enumerate([*base, *alike, *rarer])]
    made = spark.createDataFrame(rows, "node long, c long, size int, prefix array<bigint>")
    plain = made.select("c", F.explode("prefix").alias("gram"))
    assert plain.join(plain.withColumnRenamed("c", "other"), "gram").where("c < other").count() > 40_000
    written = {}
    kept = simhash.kept
    with pytest.MonkeyPatch.context() as m:
        m.setattr(simhash, "kept", lambda df, name: written.setdefault(name, kept(df, name)))
        found = {tuple(sorted(r)) for r in simhash.meeting(made, 0.8).collect()}
    assert found == {(0, 3), (1, 4), (2, 5)}
    assert written["meeting"].count() < 300


def test_one_of_each_group_counts_a_repeated_line_once(spark):
    """Texts that share only a line that comes often stay; copies that repeat a line otherwise don't."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(150)]
    line = " ".join(rng.choice(words) for _ in range(8))

    # The same words in another order: equal sets of words, other shingles.
    first, second = ([*words * 6] for _ in range(2))
    rng.shuffle(first)
    rng.shuffle(second)
    apart = [" ".join(x) + "\n" + "\n".join([line] * 30) for x in (first, second)]
    other = " ".join("".join(rng.choice("qrstuvwxyz") for _ in range(7)) for _ in range(900))
    alike = [other + "\n" + "\n".join([line] * n) for n in (1, 40)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in [*apart, *alike])]
    assert len(sets[0] & sets[1]) < 0.1 * len(sets[0] | sets[1]) and len(sets[2] & sets[3]) > 0.9 * len(sets[2] | sets[3])
    docs = spark.createDataFrame(list(enumerate([*apart, *alike])), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.one_of_each_group(docs).collect()) == [0, 1, 2]


def test_shards_keep_every_row_and_versions(spark, docs, none, tmp_path):
    root = f"file://{tmp_path}/store"
    store = shards.ShardStore(spark, root, docs.schema, target_bytes=1 << 20, fan_in=3)
    for i in range(7):
        store.append(docs.withColumn("n_chars", F.col("n_chars") * 0 + i))
    before = store.runs()
    old = store.version()
    store.compact()
    assert len(store.runs()) < len(before) and store.version() > old
    assert store.read().groupBy("n_chars").count().orderBy("n_chars").collect() == [(i, len(corpus())) for i in range(7)]
    assert rows_of(store.read().where("n_chars = 0").drop("n_chars")) == rows_of(docs.drop("n_chars"))
    with pytest.raises(shards.Conflict):
        store.commit([], store.version() - 1)
    assert store.compact() == store.version() and max(r.tier for r in store.runs()) >= 1
    empty = shards.compacted(none, f"file://{tmp_path}/empty")
    assert empty.read(shard_col="s", tier_col="t").count() == 0
    placed = store.read(shard_col="s", tier_col="t")
    assert placed.where("s is null or s = '/'").count() == 0
    # Old versions stay readable, also by who planned before, until they are expired.
    assert rows_of(store.read(old)) == rows_of(store.read())
    assert store.expire(keep=1, grace=3600) == []
    gone = store.expire(keep=1, grace=-1)
    assert gone and rows_of(store.read().where("n_chars = 0").drop("n_chars")) == rows_of(docs.drop("n_chars"))


def test_a_reader_goes_on_across_a_compaction(spark, docs, tmp_path):
    store = shards.ShardStore(spark, f"file://{tmp_path}/store", docs.schema, target_bytes=1 << 20, fan_in=2)
    for _ in range(4):
        store.append(docs)
    planned = store.read(tier_col="tier").drop("tier")
    store.compact()
    assert planned.count() == 4 * len(corpus()) == store.read().count()


def test_two_writers_and_a_dead_one(spark, docs, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root = f"file://{tmp_path}/store"
    store = shards.ShardStore(spark, root, docs.schema, target_bytes=1 << 20, fan_in=2)
    store.append(docs)
    store.append(docs)
    # A writer that died before its commit leaves files that nobody names.
    docs.withColumn("tw_arrival", F.lit(0)).write.partitionBy("tw_arrival").parquet(f"{root}/data/dead")
    assert store.read().count() == 2 * len(corpus())
    store.compact()
    assert store.read().count() == 2 * len(corpus()) and "dead" in store.expire(grace=-1)
    # Of two that commit one version, one fails, and only the other's rows are there.
    at, runs = store.version(), store.runs()

    def write(k):
        own = shards.ShardStore(spark, root, docs.schema)
        by = own._written(docs.limit(5 + k).withColumn("k", F.lit(k)), "k")
        try:
            return own.commit(runs + [own._run(n, 0) for n in by], at)
        except shards.Conflict:
            return None

    with ThreadPoolExecutor(2) as pool:
        done = list(pool.map(write, (1, 2)))
    assert sorted(x is None for x in done) == [False, True]
    assert store.read().count() == 2 * len(corpus()) + (6 if done[0] else 7)


def test_shards_of_rows_with_clashing_columns(spark, tmp_path):
    rows = spark.createDataFrame([(i, "x", "mine", i, i) for i in range(40)], "doc_id long, source string, shard string, tier int, tw_group int")
    store = shards.compacted(rows, f"file://{tmp_path}/store", fan_in=2)
    assert rows_of(store.read()) == rows_of(rows)
    got = store.read(shard_col="shard", tier_col="tier", columns=["doc_id", "source"])
    assert got.columns == ["doc_id", "source", "shard", "tier"] and got.where("shard = 'mine'").count() == 0
    assert got.agg(F.max("tier")).first()[0] >= 1


def test_url_rules(spark):
    cases = {
        "http://A.B.net/x": ("a.b.net", "/x", "net/", "block"),
        "https://example.net/en/1?q": ("example.net", "/en/1", "example.net/en/", "allow"),
        "https://x.example.net/de/": ("x.example.net", "/de/", "net/", "block"),
        "https://notexample.net/en/": ("notexample.net", "/en/", "net/", "block"),
        "https://www.example.com/de/a#b": ("www.example.com", "/de/a", "example.com/de/", "block"),
        "https://www.example.com/den": ("www.example.com", "/den", None, "allow"),
        "ftp://org/fr/": ("org", "/fr/", "org/fr/", "allow"),
        "http://a.net": ("a.net", "", None, "allow"),
        "http://a.net?x/": ("a.net", "", None, "allow"),
        "http://a.net:80/": ("a.net:80", "/", None, "allow"),
        "nothing": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "http://ÄB.net/\n": ("Äb.net", "/\n", "net/", "block"),
    }
    rows = [(i, u, "h", "r", "v") for i, u in enumerate(cases)] + [(0, "http://A.B.net/x", "h", "r", "v")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string, token string")
    got = rows_of(urls.judge_urls(pages))
    assert got == sorted([(i, *want) for i, want in enumerate(cases.values())] + [(0, *cases["http://A.B.net/x"])], key=repr)
    assert urls.judge_urls(pages.limit(0)).count() == 0
    odd = urls.judge_urls(pages, [urls.UrlRule("block", "net", "/x"), urls.UrlRule("block", "ö", "/")])
    assert odd.where("verdict = 'block'").count() == 2


def test_token_counts(spark, docs, none):
    t = token_count.tokenizer(JSON)
    want = sorted(((r[0], len((r[1] or "").encode()), n := len(t.encode(r[1] or "", add_special_tokens=False)), n > 512) for r in corpus()), key=repr)
    assert rows_of(token_count.token_counts(docs, JSON)) == want
    assert token_count.token_counts(none, JSON).count() == 0


@pytest.mark.parametrize(("chunk", "overlap"), [(50, 5), (120, 30), (333, 2)])
def test_resynchronised_counts_equal_whole_counts(chunk, overlap):
    t = token_count.tokenizer(JSON)
    assert token_count.splices(JSON)
    for r in corpus():
        x = (r[1] or "")[:3000]
        assert token_count.count_long(t, x, chunk, overlap) == len(t.encode(x, add_special_tokens=False))


def test_poisson_counts_follow_the_distribution(spark):
    for rate in (0.3, 2.5, 70.0):
        got = spark.range(4000).select(mixing.poisson_count(F.lit(rate), F.col("id").cast("string")).alias("k")).agg(F.avg("k"), F.var_samp("k")).first()
        assert got[0] == pytest.approx(rate, abs=5 * (rate / 4000) ** 0.5)
        assert got[1] == pytest.approx(rate, rel=0.15)


def test_mixing(spark, docs, none):
    out = mixing.mixed(docs, weights={"s0": 3.0, "s1": 1.0, "unknown": 5.0}, epochs=20.0, copy_col="copy")
    rows = out.collect()
    assert {r["source"] for r in rows} <= {"s0", "s1"} and out.columns == [*docs.columns, "copy"]
    per = Counter((r["doc_id"], r["text"], r["source"]) for r in rows)
    again = Counter((r["doc_id"], r["text"], r["source"]) for r in mixing.mixed(docs.repartition(7), weights={"s0": 3.0, "s1": 1.0}, epochs=20.0).collect())
    assert per == again
    share = sum(r["source"] == "s0" for r in rows) / len(rows)
    assert 0.6 < share < 0.9
    assert mixing.mixed(none).count() == 0 and mixing.mixed(docs).columns == docs.columns
    clash = mixing.mixed(docs.withColumn("Copy", F.lit("own")), copy_col="copy", order_col="words")
    assert clash.columns == [c for c in docs.columns if c != "words"] + ["copy", "words"] and clash.where("copy < 1").count() == 0
    nulls = mixing.rates(docs).where("source is null").count()
    assert nulls == 1


def _brute_repeats(texts, window):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[k : k + window] for r in raws for k in range(len(r) - window + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for k in range(len(r) - window + 1):
            if seen[r[k : k + window]] > 1:
                gone[k : k + window] = b"\1" * window
        runs = sum(1 for i in range(len(r)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((len(r), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def shared_passages():
    rng = random.Random(5)
    say = lambda n: _text(rng, n)
    p, q, r = say(520), say(410), say(700)
    texts = [say(rng.randint(0, 300)) + p + say(rng.randint(0, 200)) for _ in range(12)] + [say(50) + q + say(90) + q for _ in range(3)]
    texts += ["ab " * 400, "ab " * 300 + "x", say(900), None, "", "z" * 1200, "z" * 399] + [r] * 3 + [r[:350] + say(3) + r[353:]] * 2
    return texts + [p[:450] + say(70)] + [say(600)] * 2 + [r + say(3) for _ in range(6)] + [say(1) + r[1:] for _ in range(5)]


@pytest.mark.parametrize("hot", [3, 192])
def test_repeated_bytes_go(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "PIECE", 3000)
    texts = shared_passages()
    df = spark.createDataFrame([(i if i % 9 else None, t, 1, "s") for i, t in enumerate(texts)], "doc_id long, text string, h1 long, spans string").repartition(3)
    want = sorted(((i if i % 9 else None, *x) for i, x in enumerate(_brute_repeats(texts, 400))), key=repr)
    got = suffix.digests(df)
    assert rows_of(got.drop("text")) == want
    assert got.where("length(encode(text, 'utf-8')) > n_bytes - n_removed").count() == 0
    cut = suffix.cut(df, chars=None)
    assert cut.columns == df.columns and cut.count() == len(texts) and cut.where("text is null").count() == 1


def test_suffix_dedup_corner_cases(spark, docs, none):
    want = sorted(((r[0], *x) for r, x in zip(corpus(), _brute_repeats([r[1] for r in corpus()], 400), strict=True)), key=repr)
    assert rows_of(suffix.digests(docs).drop("text")) == want
    assert suffix.digests(none).count() == 0 and suffix.cut(none).columns == none.columns and suffix.cut(none).count() == 0
    cut = suffix.cut(docs)
    assert cut.columns == docs.columns and cut.where("n_chars <> char_length(coalesce(text, ''))").count() == 0


@pytest.mark.parametrize(("limit", "base"), [(1 << 22, 1 << 22), (3, 2), (5, 0)])
def test_induced_suffix_arrays(limit, base):
    rng = random.Random(0)
    for _ in range(150):
        t = np.array([rng.randint(0, rng.choice([1, 2, 5, 20])) for _ in range(rng.randint(1, 60))], np.uint16)
        want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        assert induced.suffix_array(t, limit=limit, base=base).tolist() == want


def test_a_production_piece_spills_and_recurses():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    raw = " ".join(rng.choice(words) for _ in range(suffix.PIECE // 6)).encode()[: suffix.PIECE]
    work = induced.Work()
    sa = induced.suffix_array(np.frombuffer(raw, np.uint8).astype(np.uint16) + 1, work=work)
    assert work.spills > 0 and work.recursions > 0
    assert np.array_equal(np.sort(sa), np.arange(len(raw)))
    some = sa[:: len(raw) // 3000]
    keys = [raw[i : i + 300] for i in some.tolist()]
    assert keys == sorted(keys)


def test_equal_windows_have_equal_anchors():
    rng = random.Random(3)
    shared = _text(rng, 800).encode()
    a, b = (_text(rng, n).encode() + shared for n in (333, 77))
    anchor = []
    for raw in (a, b):
        g, at, s0, s1 = anchors.runs(raw)
        place = {s: (int(g[k]), int(at[k]) - s) for k in range(len(g)) for s in range(s0[k], s1[k] + 1)}
        anchor.append([place[len(raw) - len(shared) + s] for s in range(len(shared) - 400 + 1)])
    assert anchor[0] == anchor[1]


def test_quality_measures_and_verdict(spark, docs, none):
    def one(t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        often = Counter(grams)
        inside = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 10 or 100 * len(inside) > 20 * len(w)
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside), failed

    got = quality.judged(docs.select("doc_id", "text", "id", "words")).drop("text", "id", "words")
    want = sorted(((r[0], *one(r[1])) for r in corpus()), key=repr)
    assert rows_of(got.drop("kept")) == want
    assert got.where("kept and base_failed").count() == 0
    kept = quality.cascade(docs)
    assert kept.columns == docs.columns and kept.count() == got.where("kept").count()
    assert quality.cascade(none).count() == 0 and quality.judged(none.select("doc_id", "text")).count() == 0


def test_quality_order_does_not_change_the_verdict(docs):
    forward, back = quality.cascade(docs, quality.RULES), quality.cascade(docs, quality.RULES[::-1])
    assert rows_of(forward) == rows_of(back)
    assert {r.name for r, _, _ in quality.estimate(docs)} == {r.name for r in quality.RULES}


def test_language_id_held_out_accuracy(spark):
    rng = random.Random(2)
    stems = {"en": "the of and ing tion with that", "de": "der die und ung lich keit sch", "fr": "les des ment aux eau que tion"}
    rows = []
    for i in range(900):
        lang = rng.choice(list(stems))
        rows.append((i, " ".join(rng.choice(stems[lang].split()) + rng.choice(["a", "e", "er", ""]) for _ in range(rng.randint(4, 60))), lang))
    rows += [(9000, None, "en"), (9001, "123 !?", "de"), (9002, "", None), (None, "the and with", "en"), (9003, "Ψ", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = langid.identified(df, langid.fitted(df))
    got = {r["doc_id"]: r for r in out.collect()}
    held = [(got[i]["lang_pred"], lang) for i, _, lang in rows[:900] if got[i]["held_out"]]
    assert 200 < len(held) < 400 and sum(a == b for a, b in held) > 0.97 * len(held)
    for i in (9000, 9001, 9002):
        assert got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and not got[i]["accepted"]
    assert got[None]["lang_pred"] in stems and not got[None]["held_out"] and got[9003]["lang_pred"] in stems
    assert all(0 <= r["score"] <= 1 for r in got.values())
    empty = df.limit(0)
    assert langid.identified(empty, langid.fitted(empty)).count() == 0
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert langid.identified(unlabelled, langid.fitted(unlabelled)).where("lang_pred <> 'und'").count() == 0
