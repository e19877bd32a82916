"""Operator 9, quality rules: a short-circuit cascade ordered by rejection per cost.

Every rule is a chain of Catalyst expressions. A sample of bounded rows and bytes gives each rule's
cost and which of its rows the rule rejects. The cascade starts with the rule of most rejections per second,
goes on with that of most further rejections per second, and so on; a row that one rule rejects is
not measured by the next (each measure stands under a CASE on the rows still alive). The verdict is
a conjunction, so the order changes cost, never the result.

Defined cases: null text counts as empty text; an empty text has no words and is rejected; a very
long text is judged whole, in time that grows as sorting does; rows that repeat are judged each alike; other columns pass through whatever their names are; an empty
table gives an empty result.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Collection, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import free_prefix, kept, text_of, words_of

#: Production thresholds.
MIN_WORDS = 10
MAX_REPEATED_WORDS = 0.20  # share of words inside five-word windows found twice or more
MAX_SYMBOLS_PER_WORD = 0.25
MAX_DUPLICATE_LINES, FEW_LINES = 0.30, 2  # share of lines; so few never count
MAX_DOUBLED_WORDS = 0.25  # share of words equal to the one before
MIN_WORD_CHARS, MAX_WORD_CHARS = 2.0, 20.0  # mean
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: The sample on which costs and selectivity are estimated: about so many rows, and about so many bytes at most, in so many parts.
SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_PARTS, SAMPLE_SEED = 500, 1 << 24, 8, 9
#: How often each rule runs over the sample while it is timed, so that its work outweighs the job around it.
REPEATS = 12

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _guard(alive: Column | None, value: Column) -> Column:
    return value if alive is None else F.when(alive, value)


def _add_words(df: DataFrame, p: str, alive: Column | None) -> DataFrame:
    """Word array and count; later measures reuse them."""
    if f"{p}words" in df.columns:
        return df
    df = df.withColumn(f"{p}words", _guard(alive, words_of(F.col(f"{p}text"))))
    return df.withColumn(f"{p}n_words", F.size(F.col(f"{p}words")).cast("long"))


def _add_word_chars(df: DataFrame, p: str, alive: Column | None) -> DataFrame:
    bare = F.translate(F.col(f"{p}text"), " \t\n\x0b\x0c\r", "")
    return df.withColumn(f"{p}word_chars", _guard(alive, F.char_length(bare).cast("long")))


def _add_symbols(df: DataFrame, p: str, alive: Column | None) -> DataFrame:
    text = F.col(f"{p}text")
    count = F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))
    return df.withColumn(f"{p}n_symbols", _guard(alive, count.cast("long")))


def _add_lines(df: DataFrame, p: str, alive: Column | None) -> DataFrame:
    lines = F.filter(F.split(F.col(f"{p}text"), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    df = df.withColumn(f"{p}lines", _guard(alive, lines))
    n = F.size(f"{p}lines")
    return df.withColumn(f"{p}n_lines", n.cast("long")).withColumn(
        f"{p}n_dup_lines", (n - F.size(F.array_distinct(f"{p}lines"))).cast("long")
    )


def _add_doubled(df: DataFrame, p: str, alive: Column | None) -> DataFrame:
    words = F.col(f"{p}words")
    doubled = F.size(F.filter(words, lambda w, i: w == F.get(words, i - 1)))
    return df.withColumn(f"{p}n_doubled", _guard(alive, doubled.cast("long")))


def _add_repeats(df: DataFrame, p: str, alive: Column | None) -> DataFrame:
    """Words inside five-word windows that occur twice or more in the text.

    Window hashes are compared first as a set; only a text that repeats one pays for sorting
    (hash, position) pairs, so no step is quadratic in the length of a text.
    """
    df = _add_words(df, p, alive)
    words, n = F.col(f"{p}words"), F.col(f"{p}n_words").cast("int")
    starts = F.sequence(F.lit(1), n - (WINDOW - 1))
    hashes = F.when(n > WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, WINDOW))))
    df = df.withColumn(f"{p}hashes", _guard(alive, hashes))
    own = F.col(f"{p}hashes")
    pairs = F.sort_array(F.transform(own, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn(f"{p}pairs", F.when(F.size(F.array_distinct(own)) < F.size(own), pairs))
    s = F.col(f"{p}pairs")
    found = F.filter(
        s,
        lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]),
    )
    at = F.sort_array(F.transform(found, lambda x: x["i"]))
    covered = F.aggregate(
        at,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("total")),
        lambda acc, i: F.struct(
            i.alias("last"), (acc["total"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("total")
        ),
        lambda acc: acc["total"],
    )
    covered = F.coalesce(covered, F.lit(0)).cast("long")
    return df.withColumn(f"{p}n_repeat_words", _guard(alive, covered))


Measure = Callable[[DataFrame, str, Column | None], DataFrame]


@dataclass(frozen=True)
class Rule:
    """A rule: which measures it adds (only on rows alive) and when it rejects."""

    name: str
    measures: tuple[Measure, ...]
    rejects: Callable[[Callable[[str], Column]], Column]


def _mean_length(m: Callable[[str], Column]) -> Column:
    return (m("word_chars") < MIN_WORD_CHARS * m("n_words")) | (m("word_chars") > MAX_WORD_CHARS * m("n_words"))


RULES: tuple[Rule, ...] = (
    Rule("few_words", (_add_words,), lambda m: m("n_words") < MIN_WORDS),
    Rule("repeated_words", (_add_words, _add_repeats), lambda m: 100 * m("n_repeat_words") > round(100 * MAX_REPEATED_WORDS) * m("n_words")),
    Rule("symbols", (_add_words, _add_symbols), lambda m: m("n_symbols") > MAX_SYMBOLS_PER_WORD * m("n_words")),
    Rule("duplicate_lines", (_add_lines,), lambda m: (m("n_dup_lines") > FEW_LINES) & (m("n_dup_lines") > MAX_DUPLICATE_LINES * m("n_lines"))),
    Rule("doubled_words", (_add_words, _add_doubled), lambda m: m("n_doubled") > MAX_DOUBLED_WORDS * m("n_words")),
    Rule("word_length", (_add_words, _add_word_chars), _mean_length),
)
BASE = ("few_words", "repeated_words")
#: What ``judged`` reports of every row.
REPORTED = (_add_words, _add_word_chars, _add_symbols, _add_lines, _add_repeats)


def _with_text(docs: DataFrame, p: str, text: str) -> DataFrame:
    return docs.withColumn(f"{p}text", text_of(text))


def _apply(df: DataFrame, p: str, rules: Sequence[Rule], always: Collection[Measure] = ()) -> DataFrame:
    """Adds ``{p}alive``: no rule rejected the row. Only rows that are still alive are measured, but for the measures in ``always``."""
    df = df.withColumn(f"{p}alive", F.lit(True))
    seen: set[Measure] = set()
    for rule in rules:
        alive = F.col(f"{p}alive")
        for add in rule.measures:
            # Words measured for an earlier rule hold for every row alive now: rows only die.
            if add not in seen:
                df = add(df, p, None if add in always else alive)
                seen.add(add)
        rejected = F.coalesce(rule.rejects(lambda c: F.col(f"{p}{c}")), F.lit(False))
        df = df.withColumn(f"{p}alive", alive & ~rejected)
    # A non-deterministic term keeps the optimiser from moving a filter on the verdict below the
    # measures, where each would be inlined into lambdas and run once an element.
    return df.withColumn(f"{p}alive", F.col(f"{p}alive") & (F.spark_partition_id() >= 0))


def _sample(docs: DataFrame, p: str, text: str, rows: int) -> DataFrame:
    """(row, text): about ``rows`` whole texts drawn at random over all of the table, fewer where they are long, written once.

    Each row is drawn on its own, so copies of one text do not come all together, and many tasks hold what was drawn.
    """
    own = docs.select(text_of(text).alias(f"{p}text"))
    drawn = own.sample(min(1.0, rows / max(docs.count(), 1)), SAMPLE_SEED).repartition(SAMPLE_PARTS)
    drawn = kept(drawn.select(F.monotonically_increasing_id().alias(f"{p}row"), f"{p}text"), "quality-sample")
    size = drawn.agg(F.sum(F.octet_length(f"{p}text"))).first()[0] or 0
    return drawn if size <= SAMPLE_BYTES else kept(drawn.sample(SAMPLE_BYTES / size, SAMPLE_SEED), "quality-sample")


def greedy(rejected: Sequence[frozenset[int]], seconds: Sequence[float], names: Sequence[str]) -> list[int]:
    """The order of the rules: next comes that of most rejections, among rows not yet rejected, a second.

    One that rejects nothing more keeps its place by cost.
    """
    left, gone, order = set(range(len(rejected))), set(), []
    while left:
        best = max(left, key=lambda k: ((len(rejected[k] - gone) + 1e-3) / max(seconds[k], 1e-6), names[k]))
        order.append(best)
        left.remove(best)
        gone |= rejected[best]
    return order


def estimate(docs: DataFrame, rules: Sequence[Rule] | None = None, text: str = "text", rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, share rejected, seconds a thousand texts) of each rule on a bounded sample, in the order to run them.

    Each rule runs over the sample REPEATS times; a run that only reads the rows is taken off.
    """
    rules = RULES if rules is None else rules
    p = free_prefix(docs)
    sample = _sample(docs, p, text, rows)
    n = max(1, sample.count())
    judged_by = [_apply(sample, p, [r]).where(~F.col(f"{p}alive")).select(F.lit(k).alias("rule"), f"{p}row") for k, r in enumerate(rules)]
    found = reduce(DataFrame.unionByName, judged_by).collect()  # at most a row a rule and sampled text
    many = sample.select(F.explode(F.sequence(F.lit(1), F.lit(REPEATS))).alias(f"{p}k"), F.concat(f"{p}text", F.lit(" "), F.col(f"{p}k").cast("string")).alias(f"{p}text"))

    def timed(of: Sequence[Rule]) -> float:
        began = time.perf_counter()
        _apply(many, p, of).agg(F.count_if(f"{p}alive")).collect()
        return time.perf_counter() - began

    idle = min(timed([]) for _ in range(2))
    seconds = [max(1e-4, timed([r]) - idle) for r in rules]
    rejected = [frozenset(r[1] for r in found if r[0] == k) for k in range(len(rules))]
    order = greedy(rejected, seconds, [r.name for r in rules])
    return [(rules[k], len(rejected[k]) / n, seconds[k] * 1000 / (n * REPEATS)) for k in order]


def cascade(docs: DataFrame, rules: Sequence[Rule] | None = None, text: str = "text") -> DataFrame:
    """``docs`` without the rows that a rule rejects; same columns. rules: already ordered, else estimated."""
    p = free_prefix(docs)
    order = rules if rules is not None else [r for r, _, _ in estimate(docs, text=text)]
    return _apply(_with_text(docs, p, text), p, order).where(F.col(f"{p}alive")).select(*[F.col(f"`{c}`") for c in docs.columns])


def judged(docs: DataFrame, rules: Sequence[Rule] | None = None, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with all measures, ``base_failed`` and ``kept`` as columns named ``prefix`` + name.

    The report needs its five measures of every row; what only the other rules need is measured on rows
    that are still alive. The verdict is the cascade's, over the same rules.
    """
    p = free_prefix(docs)
    order = rules if rules is not None else [r for r, _, _ in estimate(docs, text=text)]
    df = _apply(_with_text(docs, p, text), p, order, REPORTED)
    base = F.lit(False)
    for rule in (r for r in RULES if r.name in BASE):
        base = base | F.coalesce(rule.rejects(lambda c: F.col(f"{p}{c}")), F.lit(False))
    return df.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        *[F.col(f"{p}{m}").alias(f"{prefix}{m}") for m in MEASURES],
        base.alias(f"{prefix}base_failed"),
        F.col(f"{p}alive").alias(f"{prefix}kept"),
    )


#: The same measures and verdict, all rules at once. A window is known by its five words, which hold no blank.
SQL = f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select r, doc_id, t, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from d),
tok as (select r, unnest(words) as x, unnest(range(1, len(words) + 1)) as i from w),
wins as (select r, i, concat_ws(' ', x, {", ".join(f"lead(x, {k}) over v" for k in range(1, WINDOW))}) as five, lead(x, {WINDOW - 1}) over v as last from tok window v as (partition by r order by i)),
twice as (select r, i from (select r, i, count(*) over (partition by r, five) as n from wins where last is not null) where n > 1),
runs as (select r, least({WINDOW}, i - lag(i, 1, -{WINDOW}) over (partition by r order by i)) as fresh from twice),
rep as (select r, sum(fresh)::bigint as n_repeat_words from runs group by 1),
m as (select doc_id, len(words)::bigint as n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::bigint as word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, len(lines)::bigint as n_lines,
  (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
  len(list_filter(words, lambda x, i: i > 1 and x = words[i - 1]))::bigint as n_doubled from w left join rep using (r)),
b as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {round(100 * MAX_REPEATED_WORDS)} * n_words as base_failed from m)
select doc_id, {", ".join(MEASURES)}, base_failed, not (base_failed or n_symbols > {MAX_SYMBOLS_PER_WORD}::double * n_words
  or (n_dup_lines > {FEW_LINES} and n_dup_lines > {MAX_DUPLICATE_LINES}::double * n_lines) or n_doubled > {MAX_DOUBLED_WORDS}::double * n_words
  or word_chars < {MIN_WORD_CHARS}::double * n_words or word_chars > {MAX_WORD_CHARS}::double * n_words) as kept from b
"""
