"""Operator 7, mixing sources to target weights by Poisson replication.

Each source gets a target share of the output; its mean repetition rate is target / size. Every
document draws its count by inverting a Poisson distribution at a uniform number hashed from
(seed, doc_id), is repeated that often, and all copies are shuffled globally by a second hash.
The draw needs no state: any executor repeats it exactly.

Defined cases: a null source is a source of its own; rows with the same doc_id share one draw and
are each repeated by it; rows without one draw by their text, so only equal texts share; else text is
not read, only carried; sources without a weight
are dropped, weights without rows are ignored; an empty table gives an empty result. Columns of
the input are all carried, but for one that has the name of an added column: the added one takes its
place.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import free_prefix, partitions, text_of

#: Production: shares in proportion to size ** ALPHA, as many documents in all as came in.
ALPHA = 0.5
SEED = "mix-1"
#: A rate is split into equal parts of at most this size, each drawn alone: exp() stays far from 0.
PART = 32.0
#: Counts tried for one part: beyond this the rest of the distribution is below 1e-18.
MOST = 128
#: This many sources at most are sent to every executor.
BROADCAST_SOURCES = 10_000


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) with 52 bits, from the md5 of the parts joined by colons."""
    text = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def _poisson_part(rate: Column, u: Column) -> Column:
    """Smallest k with P(X <= k) > u for X of mean ``rate`` <= PART."""
    # The sum stops growing once it is above u; k counts the terms added before.
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"), F.lit(0).alias("k"))

    def step(acc: Column, i: Column) -> Column:
        p = acc["p"] * rate / i
        grown = F.struct(p.alias("p"), (acc["cdf"] + p).alias("cdf"), (acc["k"] + 1).alias("k"))
        return F.when(acc["cdf"] > u, acc).otherwise(grown)

    return F.aggregate(F.sequence(F.lit(1), F.lit(MOST)), start, step, lambda acc: acc["k"])


def poisson_count(rate: Column, key: Column, seed: str = SEED) -> Column:
    """A Poisson draw of mean ``rate`` for ``key``: the sum of independent parts."""
    n = F.greatest(F.lit(1), F.ceil(rate / PART).cast("int"))
    parts = F.transform(
        F.sequence(F.lit(1), n), lambda i: _poisson_part(rate / n, uniform(seed, i.cast("string"), key)).cast("long")
    )
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x)


def rates(docs: DataFrame, source: str = "source", weights: Mapping[str, float] | None = None, epochs: float = 1.0) -> DataFrame:
    """(source, rate): one row a source. epochs: output documents as a multiple of the input's."""
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(ALPHA)))
    else:
        given = docs.sparkSession.createDataFrame(list(weights.items()), "of string, weight double")
        weighed = sizes.join(given, sizes.source.eqNullSafe(given.of)).drop("of")
    # Two numbers over all sources.
    total = weighed.agg(F.sum("weight").alias("weight"), F.sum("n").alias("n")).first()
    rate = F.col("weight") / F.lit(total["weight"] or 1.0) * F.lit(total["n"] or 0) * F.lit(float(epochs)) / F.col("n")
    return weighed.select("source", rate.alias("rate"))


def mixed(
    docs: DataFrame,
    source: str = "source",
    key: str = "doc_id",
    weights: Mapping[str, float] | None = None,
    epochs: float = 1.0,
    seed: str = SEED,
    copy_col: str | None = None,
    order_col: str | None = None,
    text: str = "text",
) -> DataFrame:
    """``docs`` with every row repeated by its draw, shuffled globally.

    copy_col: adds the copy's number from 1 under this name. order_col: adds the shuffle key.
    """
    p = free_prefix(docs)
    per = rates(docs, source, weights, epochs)
    per = per.select(F.col("source").alias(f"{p}source"), F.col("rate").alias(f"{p}rate"))
    # Sources are few; their number is checked before they are sent everywhere.
    few = per.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    at = docs.join(F.broadcast(per) if few else per, F.col(source).eqNullSafe(F.col(f"{p}source")))
    name = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("null:"), F.md5(text_of(text))))
    times = poisson_count(F.col(f"{p}rate"), name, seed)
    drawn = at.withColumn(f"{p}times", times)
    numbers = F.expr(f"if({p}times > 0, sequence(1L, {p}times), cast(array() as array<bigint>))")
    copies = drawn.withColumn(f"{p}copy", F.explode(numbers))
    order = F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.col(f"{p}copy"), name))
    copies = copies.withColumn(f"{p}order", order)
    # A hash of the shuffle key deals copies over all partitions; within each they are sorted by it.
    dealt = copies.repartition(partitions(docs.sparkSession), F.col(f"{p}order")).sortWithinPartitions(f"{p}order")
    more = [F.col(f"{p}{c}").alias(name) for c, name in (("copy", copy_col), ("order", order_col)) if name]
    added = {name.lower() for name in (copy_col, order_col) if name}
    return dealt.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in added], *more)


#: The production query for DuckDB: counts per part, then copies. ALPHA is a square root there.
SQL = f"""
with sizes as (select source, count(*) as n from documents group by source),
total as (select sum(power(n::double, {ALPHA})) as all_weight, sum(n) as all_n from sizes),
rates as (select source, power(n::double, {ALPHA}) / all_weight * all_n * 1.0::double / n as rate from sizes, total),
parts as (
  select d.doc_id, d.text, d.lang, d.source, d.n_chars, rate, greatest(1, ceil(rate / {PART})::int) as n_parts
  from documents d join rates r on d.source is not distinct from r.source),
draws as (
  select * exclude (rate), rate / n_parts as part_rate,
    list_transform(range(1, n_parts + 1), lambda i:
      ('0x' || substr(md5('{SEED}:' || i::varchar || ':' || coalesce(doc_id::varchar, 'null:' || md5(coalesce(text, '')))), 1, 13))::bigint::double / 4503599627370496.0) as us
  from parts),
counted as (
  select * exclude (us), list_sum(list_transform(us, lambda u:
    list_reduce(range(1, {MOST} + 1), lambda acc, i:
      case when acc.cdf > u then acc
           else {{'p': acc.p * part_rate / i, 'cdf': acc.cdf + acc.p * part_rate / i, 'k': acc.k + 1}} end,
      {{'p': exp(-part_rate), 'cdf': exp(-part_rate), 'k': 0}}).k)) as times
  from draws)
select doc_id, text, lang, source, n_chars, copy, md5('{SEED}:order:' || copy::varchar || ':' || coalesce(doc_id::varchar, 'null:' || md5(coalesce(text, '')))) as shuffle_key
from (select *, unnest(range(1, times::bigint + 1)) as copy from counted)
"""
