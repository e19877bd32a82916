"""Faults that were mended: labels with long texts only, mixing of rows without an id, writers of shards that meet."""

from __future__ import annotations

import math
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tidewright.llm import langid, mixing


def test_a_label_of_long_texts_only_is_a_class(spark):
    rows = [(i, "the house and the garden of the man " * 3, "en") for i in range(60)] + [(100 + i, "das haus und der garten von dem mann " * 700, "de") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    learned = langid.sample(docs, "doc_id", "text", "lang", 800)
    assert learned.select(F.max(F.char_length("text"))).first()[0] == langid.TRAIN_CHARS
    model = langid.fitted(docs)
    assert model.languages == ["de", "en"]
    got = langid.identified(docs, model).groupBy("lang_pred").count().collect()
    assert {r["lang_pred"]: r["count"] for r in got} == {"en": 60, "de": 60}


def test_rows_without_an_id_draw_by_their_texts(spark):
    n = 20_000
    docs = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("web").alias("source"))
    out = mixing.mixed(docs, epochs=3.0)
    sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert abs(sum(sizes) - 3 * n) < 3 * math.sqrt(3 * n)
    assert max(sizes) < 2 * sum(sizes) / int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_writers_that_meet_commit_their_runs_over_each_other(spark, tmp_path):
    from tidewright.llm import shards

    root, rows = f"file://{tmp_path}/store", spark.range(30)
    make = lambda: shards.ShardStore(spark, root, rows.schema, target_bytes=1 << 20, fan_in=2)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: make().append(rows.select((F.col("id") + 100 * k).alias("id"))), range(4)))
    assert make().version() == 4 and len(make().runs()) == 4

    class Disturbed(shards.ShardStore):
        """Another writer commits between this one's files and its manifest."""

        between = None

        def _written(self, rows, by):
            found = super()._written(rows, by)
            if self.between:
                between, self.between = self.between, None
                between()
            return found

    store = Disturbed(spark, root, rows.schema, target_bytes=1 << 20, fan_in=2)
    store.between = lambda: make().append(rows.select((F.col("id") + 400).alias("id")))
    store.compact()
    assert sorted(r[0] for r in store.read().collect()) == sorted(i + 100 * k for i in range(30) for k in range(5))
    # Another compaction of the same runs leaves nothing to replace.
    store.append(rows)
    store.append(rows)
    before = store.read().count()
    store.between = lambda: make().compact()
    with pytest.raises(shards.Conflict):
        store.compact()
    assert make().read().count() == before


def test_groups_that_are_due_are_of_similar_runs():
    from tidewright.llm import shards

    store, dice = object.__new__(shards.ShardStore), random.Random(5)
    store.target_bytes = 1000
    for fan_in in (2, 3, 4):
        store.fan_in = fan_in
        for _ in range(200):
            sizes = [int(1000 * 2 ** dice.uniform(-8, 2)) for _ in range(dice.randrange(30))]
            runs = [shards.Run(str(k), 0, (("part-0", b),)) for k, b in enumerate(sizes)]
            due = store.groups(runs)
            names = [r.name for g in due for r in g]
            assert len(names) == len(set(names)) and all(len(g) == fan_in for g in due)
            assert all(r.bytes < 500 for g in due for r in g)
            # Nobody is far above the mean of those before, and whoever is left has fewer than fan_in equals in size.
            for g in due:
                held = [r.bytes for r in g]
                assert all(b <= 1.5 * sum(held[:k]) / k for k, b in enumerate(held) if k)
            left = sorted(b for k, b in enumerate(sizes) if str(k) not in names and b < 500)
            assert all(left[k + 2 * fan_in - 2] > left[k] for k in range(len(left) - 2 * fan_in + 2))


def test_a_filter_of_keys_misses_none_and_lets_few_others_through(spark):
    from tidewright.llm import simhash

    keys = spark.range(0, 3000, 3).select("id", F.xxhash64("id").alias("h"))
    rows = spark.range(3000).union(spark.range(1).select(F.lit(None).cast("long"))).toDF("id")
    out = simhash.maybe_in(rows, F.xxhash64("id"), keys, F.col("h"), "m")
    assert out.columns == ["id", "m"] and out.count() == 3001
    wrong = out.where(F.col("m") != F.coalesce(F.col("id") % 3 == 0, F.lit(False)))
    assert wrong.where("not m").count() == 0 and wrong.count() < 5
    assert simhash.maybe_in(rows, F.xxhash64("id"), keys.limit(0), F.col("h"), "m").where("m").count() == 0


def _odd_texts(n, size):
    """Texts of blanks, separators that are none to the tokenizer, contractions, digits, signs and wide characters."""
    dice = random.Random(6)
    parts = [*" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u180e\u2003\u200b\u2028\u3000", "  ", "#", "'s", "don't", "...", "12", "a", "Word", " the", "é", "漢字", "😀", "<|endoftext|>", "\0"]
    return ["".join(dice.choices(parts, k=dice.randint(1, size))) for _ in range(n)]


def test_stretches_and_spliced_chunks_count_as_whole_texts(monkeypatch):
    """A text may be cut before a blank only if the tokenizer takes it for one: the separators from U+001C to U+001F go with signs."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tidewright.llm import token_count

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = token_count.tokenizer(path)
    assert not token_count.stable("#", "\x1c") and token_count.stable("#", "\u3000")
    monkeypatch.setattr(token_count, "REMEMBERED", 50)
    texts = _odd_texts(3000, 40)
    whole = [len(x) for x in t.encode_batch(texts, add_special_tokens=False)]
    assert token_count.counts_of(path, texts) == whole
    seen = token_count.Splices()
    assert [token_count.count_long(t, x, 20, 5, seen) for x in texts] == whole and seen.spliced > 1000


def test_token_counts_ask_the_library_for_no_offsets_and_for_a_stretch_once(monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tidewright.llm import token_count

    path = public_tokenizers.path("byte_bpe_50k.json")
    real = token_count.tokenizer(path)

    class Counted:
        chars = 0

        def __getattr__(self, name):
            assert name not in ("encode", "encode_batch")
            return getattr(real, name)

        def encode_batch_fast(self, texts, **given):
            self.chars += sum(map(len, texts))
            return real.encode_batch_fast(texts, **given)

    t = Counted()
    monkeypatch.setattr(token_count, "tokenizer", lambda _: t)
    texts = [f"{k} the house and the garden\n" * 50 for k in range(100)]
    assert token_count.counts_of(path, texts) == [len(real.encode(x, add_special_tokens=False)) for x in texts]
    assert t.chars < sum(map(len, texts)) / 100
    t.chars, long = 0, " ".join(f"word{k}" for k in range(5000))
    assert token_count.counts_of(path, [long]) == [len(real.encode(long, add_special_tokens=False))]
    assert len(long) <= t.chars < 1.1 * len(long)
