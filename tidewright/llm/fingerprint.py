"""Operator 2, document fingerprints: a homomorphic multiset hash over paragraphs.

A text is a multiset of paragraphs (lines; a line of over RUN words is taken in runs of RUN
words). Each paragraph is hashed to a wide vector; the fingerprint is the sum of these vectors,
lane by lane modulo a power of two. Sums commute, so the order of paragraphs does not matter,
and a paragraph is inserted or deleted by adding or subtracting its vector (``plus``, ``minus``).

Lanes: one count (mod 2^60), LANES lanes of 32 bits (mod 2^32) for equality, and SIGNS lanes of 20
bits (mod 2^20), three to a long, that sum single hash bits. The difference of two fingerprints'
sign lanes is a random-sign projection of the difference of the multisets, so its mean square
estimates how many paragraphs differ: that gives a likeness from 0 to 1 without the texts.

Defined cases: null text counts as empty (one empty paragraph); equal texts, and texts whose
paragraphs are the same in another order, have equal fingerprints; a text of any length takes one
pass; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import kept, partitions, text_of

RUN = 8
LANES = 8
#: Bits of one xxhash64 that a sign long takes: lanes of 20 bits and a guard bit each.
STEP = 21
ONES = 1 | 1 << STEP | 1 << 2 * STEP
BITS20 = ((1 << 20) - 1) * ONES
#: Two hashes of 63 bits each give 2 * STEP longs of three lanes.
SIGN_LONGS = 2 * STEP
SIGNS = 3 * SIGN_LONGS
LOW32 = (1 << 32) - 1
#: Runs of up to RUN words with the blanks after them; every character falls in one run.
RUNS = rf"(?:[^\s]*+\s){{0,{RUN - 1}}}[^\s]*+(?:\s|$)"


def paragraphs(text: Column) -> Column:
    """The multiset of paragraphs, as an array: one empty paragraph for an empty line."""
    cut = F.transform(
        F.split(text, "\n", -1),
        lambda line: F.when(F.length(line) < 2 * RUN, F.array(line)).otherwise(
            F.filter(F.regexp_extract_all(line, F.lit(RUNS), 0), lambda run: run != "")
        ),
    )
    return F.flatten(cut)


def _hashes(paras: Column) -> Column:
    """For each paragraph four hashes with independent seeds."""
    return F.transform(
        paras, lambda q: F.struct(F.xxhash64(q).alias("a"), *[F.xxhash64(F.lit(i), q).alias(n) for i, n in enumerate("bcd", 1)])
    )


def _sums(hashes: str) -> Column:
    """array<long> of a column of hashes: count, LANES wide lanes, SIGN_LONGS packed sign longs.

    ``hashes`` names a column, not an expression: the lambdas below read it once a lane.
    """
    wide = [
        f"aggregate({hashes}, 0L, (acc, h) -> (acc + (shiftrightunsigned(h.{n}, {32 * half}) & {LOW32}L)) & {LOW32}L)"
        for n in "abcd"
        for half in (0, 1)
    ]
    signs = [
        f"transform(sequence(0, {STEP - 1}), k -> aggregate({hashes}, 0L, (acc, h) -> (acc + (shiftrightunsigned(h.{n}, k) & {ONES}L)) & {BITS20}L))"
        for n in "cd"
    ]
    return F.expr(f"concat(array(cast(size({hashes}) as bigint), {', '.join(wide)}), {', '.join(signs)})")


def fingerprinted(df: DataFrame, text: Column, name: str) -> DataFrame:
    """``df`` with the fingerprint of ``text`` as the array column ``name``."""
    hashes = f"{name}_hashes"
    return df.withColumn(hashes, _hashes(paragraphs(text))).withColumn(name, _sums(hashes)).drop(hashes)


def plus(a: Column, b: Column) -> Column:
    """The fingerprint of both multisets together."""
    return F.transform(
        a,
        lambda x, i: F.when(i == 0, x + F.get(b, i))
        .when(i <= LANES, (x + F.get(b, i)).bitwiseAND(F.lit(LOW32)))
        .otherwise((x + F.get(b, i)).bitwiseAND(F.lit(BITS20))),
    )


def minus(a: Column, b: Column) -> Column:
    """The fingerprint of ``a`` after the deletion of the multiset ``b``."""
    return F.transform(
        a,
        lambda x, i: F.when(i == 0, x - F.get(b, i))
        .when(i <= LANES, (x + F.lit(LOW32 + 1) - F.get(b, i)).bitwiseAND(F.lit(LOW32)))
        .otherwise((x.bitwiseOR(F.lit(ONES << 20)) - F.get(b, i)).bitwiseAND(F.lit(BITS20))),
    )


def digits(fp: Column) -> Column:
    """The fingerprint as lowercase hex, 16 digits a lane."""
    return F.lower(F.concat_ws("", F.transform(fp, lambda x: F.lpad(F.hex(x), 16, "0"))))


def signs(fp: str) -> Column:
    """The sign lanes as signed sums of +1 and -1 over the paragraphs, centred modulo 2^21."""
    lane = f"pmod(2 * (shiftrightunsigned(x, {{}}) & {(1 << 20) - 1}L) - {fp}[0] + {1 << 20}L, {1 << 21}L) - {1 << 20}L"
    lanes = ", ".join(lane.format(STEP * i) for i in range(3))
    return F.expr(f"flatten(transform(slice({fp}, {LANES + 2}, {SIGN_LONGS}), x -> array({lanes})))")


def likeness(a: str, b: str) -> Column:
    """From two columns of ``signs``: 1 for equal multisets, about 0 for disjoint ones."""
    total = lambda e: f"aggregate({e}, 0D, (acc, v) -> acc + v)"
    apart = total(f"zip_with({a}, {b}, (x, y) -> cast(x - y as double) * (x - y))")
    square = lambda c: total(f"transform({c}, x -> cast(x as double) * x)")
    return F.expr(f"coalesce(greatest(0D, 1D - try_divide({apart}, {square(a)} + {square(b)})), 1D)")


def next_ids(ids: DataFrame, name: str = "id") -> DataFrame:
    """(id, next_id, more): ids are distinct; the next by ascending id, after the last the first.

    Ids are dealt by range and kept, so each part finds its own successors; one row a part then
    tells where the next part begins. No task sees all ids.
    """
    spark = ids.sparkSession
    parts = kept(ids.repartitionByRange(partitions(spark), name).withColumn("part", F.spark_partition_id()), "ranged")
    # One row a part, as many as there are shuffle partitions.
    firsts = parts.groupBy("part").agg(F.min(name).alias("first"))
    ring = firsts.select("part", F.expr("coalesce(lead(first) over (order by part), min(first) over ())").alias("after"))
    inner = F.expr(f"lead({name}) over (partition by part order by {name})")
    linked = parts.withColumn("inner", inner).join(F.broadcast(ring), "part")
    return linked.withColumn("next_id", F.coalesce("inner", "after")).drop("inner", "after", "part")


def compared(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's fingerprint, that of its edited text, and likenesses.

    The edited text is the text whose last quarter of code points (rounded down) is replaced by as
    many (or all) first ones of the next document by ascending key. Only the lines after the last
    line feed before the cut change, so the edited fingerprint is the old one minus those lines
    plus the new ones. Rows with one key share the next document; of rows with the next key, the
    smallest head stands for it. A row without a key has no next document: the empty text.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(key).alias("id"), text_of(text).alias("text"))
    sizes = own.where(F.col("id").isNotNull()).groupBy("id").agg(F.max(F.floor(F.char_length("text") / 4)).alias("quarter"))
    links = next_ids(kept(sizes, "sizes")).select(F.col("id").alias("for_id"), F.col("next_id").alias("id"), "quarter")
    base = fingerprinted(own, F.col("text"), "fp")
    # A key has one follower each, so this join makes one row a key; only heads are moved on.
    heads = base.where(F.col("id").isNotNull()).join(links, "id").select("for_id", F.struct(F.expr("left(text, quarter)").alias("head"), F.col("fp").alias("next_fp")).alias("next"))
    heads = heads.groupBy("for_id").agg(F.min("next").alias("next"))
    # Both joins read ``base`` by id in the same form, so its exchange is made once and reused.
    placed = base.where(F.col("id").isNotNull()).join(heads, F.col("id") == F.col("for_id"), "left")
    nowhere = base.where(F.col("id").isNull()).withColumn("next", F.lit(None).cast(heads.schema["next"].dataType))
    j = placed.drop("for_id").unionByName(nowhere)
    empty = fingerprinted(spark.range(1), F.lit(""), "fp").first()["fp"]
    j = j.select(
        "id", "text", "fp", F.char_length("text").cast("long").alias("n_chars"),
        F.coalesce("next.head", F.lit("")).alias("head"), F.coalesce("next.next_fp", F.lit(empty).cast("array<bigint>")).alias("next_fp"),
    )
    j = j.withColumn("n_new", F.floor(F.col("n_chars") / 4).cast("int"))
    j = j.withColumn("prefix", F.expr("left(text, int(n_chars) - n_new)")).withColumn("new", F.expr("left(head, n_new)"))
    j = j.withColumn("last_line", F.substring_index("prefix", "\n", -1))
    j = j.withColumn("old_tail", F.expr("concat(last_line, substring(text, int(n_chars) - n_new + 1))"))
    j = j.withColumn("new_tail", F.concat("last_line", "new"))
    j = fingerprinted(fingerprinted(j, F.col("old_tail"), "old_fp"), F.col("new_tail"), "new_fp")
    j = j.withColumn("edited_fp", plus(minus(F.col("fp"), F.col("old_fp")), F.col("new_fp")))
    j = j.select(
        "id", "n_chars", F.sha2(F.concat("prefix", "new"), 256).alias("edited_sha256"), "fp", "edited_fp",
        signs("fp").alias("s"), signs("edited_fp").alias("s_edited"), signs("next_fp").alias("s_next"),
    )
    return j.select(
        F.col("id").alias(key), "n_chars", "edited_sha256", digits(F.col("fp")).alias("fingerprint"),
        digits(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness("s", "s_edited").alias("near_edited"), likeness("s", "s_next").alias("near_next"),
    )
