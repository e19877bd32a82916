r"""Operator 11, secret scans: known forms by pattern, unknown ones by entropy in a sliding window. Native.

Three base kinds are patterns: a value assigned to a telling name, an access key, a long lowercase hex
string. Beside them, every character class has candidate strings (long runs of its characters). A
window slides over a candidate's characters: the class's counts change by the character that comes and the
one that goes, and so does the sum of c * log2(c) over the counts, from which the window's Shannon
entropy follows. Windows at or over the class's threshold are joined to spans. Sums are whole
millionths, so they neither drift nor depend on order. A candidate that matches an allow-list (plain
words, numbers, paths and slugs of words, UUIDs, the alphabet in a row, examples) adds no span; base spans stay whatever it says, and
an entropy span may lie over one.

Positions of all matches come from the pieces between them: Spark's functions give matches and pieces
but no offsets. Their running sums are taken in blocks, as appending to an array copies it.

Defined cases: a null or empty text has no spans; a text of any length is searched whole, its spans
are one array; equal rows are scanned each; other columns pass through, and ``spans`` replaces a
column of that name; an empty table gives an empty result. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import free_prefix, text_of

#: Base kinds in their order: name, pattern, and what a match must satisfy: least characters of a group.
BASE = (
    ("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: Hex and access matches that are too short are not even listed: a longer one can't begin inside one.
SEARCHED = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}

#: Elements of an array that are summed up one after another.
BLOCK = 512
MILLION = 1_000_000

#: Candidates that are no secrets: words with what joins them, numbers, UUIDs, rows of the alphabet, examples.
ALLOWED = (
    r"^[-_/+A-Za-z]+$",
    r"^[-_/+0-9]+$",
    r"^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    r"(?:abcdefghijklm|ABCDEFGHIJKLM|0123456789)",
    r"(?:EXAMPLE|example|Example)",
)


@dataclass(frozen=True)
class CharacterClass:
    """Candidates are matches of ``pattern`` in ``alphabet``; windows of ``window`` characters are told by ``bits``."""

    name: str
    pattern: str
    alphabet: str
    window: int
    bits: float
    allowed: tuple[str, ...] = ALLOWED

    @property
    def sums(self) -> list[int]:
        """c * log2(c) in millionths for each count."""
        return [0] + [round(MILLION * c * math.log2(c)) for c in range(1, self.window + 1)]

    @property
    def most(self) -> int:
        """The greatest sum of a window with enough entropy: log2(window) - sum / window >= bits."""
        return math.floor(MILLION * self.window * (math.log2(self.window) - self.bits))


_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
CLASSES = (
    CharacterClass("entropy_hex", r"[0-9A-F]{20,}|[0-9a-f]{20,}", _DIGITS + "abcdefABCDEF", 20, 3.0),
    CharacterClass("entropy_base64", r"[A-Za-z0-9+/_-]{20,}", _DIGITS + _LOWER + _LOWER.upper() + "+/_-", 20, 3.7, (*ALLOWED, r"^(?:[0-9A-F]+|[0-9a-f]+)$")),
)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def running_sums(lengths: str) -> str:
    """SQL for the running sums of an array of bigint: within blocks, then block by block."""
    block = f"slice({lengths}, k * {BLOCK} + 1, {BLOCK})"
    add = "(a, v) -> named_struct('s', a.s + v, 'out', concat(a.out, array(a.s + v)))"
    inner = f"aggregate({block}, named_struct('s', 0L, 'out', cast(array() as array<bigint>)), {add}, a -> a.out)"
    blocks = f"transform(sequence(0, greatest(0, (size({lengths}) - 1) div {BLOCK})), k -> {inner})"
    shifted = "array(transform(b, v -> v + o.s))"
    join = f"(o, b) -> named_struct('s', o.s + if(size(b) > 0, element_at(b, -1), 0L), 'out', concat(o.out, {shifted}))"
    return f"flatten(aggregate({blocks}, named_struct('s', 0L, 'out', cast(array() as array<array<bigint>>)), {join}, o -> o.out))"


def _located(df: DataFrame, text: str, pattern: str, name: str) -> DataFrame:
    """``df`` with ``name``: (start, end, match) of each leftmost match that overlaps none before it."""
    df = df.withColumn(f"{name}_m", F.regexp_extract_all(F.col(text), F.lit(pattern), 0))
    # Most texts have no match: their pieces aren't made.
    df = df.withColumn(f"{name}_p", F.when(F.size(f"{name}_m") > 0, F.split(F.col(text), pattern, -1)).otherwise(F.array().cast("array<string>")))
    steps = f"transform({name}_m, (m, i) -> cast(length({name}_p[i]) + if(i > 0, length({name}_m[i - 1]), 0) as bigint))"
    df = df.withColumn(f"{name}_s", F.expr(steps))
    df = df.withColumn(f"{name}_s", F.expr(running_sums(f"{name}_s")))
    spans = f"transform({name}_m, (m, i) -> named_struct('start', {name}_s[i], 'end', {name}_s[i] + length(m), 'match', m))"
    return df.withColumn(name, F.expr(spans)).drop(f"{name}_m", f"{name}_p", f"{name}_s")


def high_entropy(candidate: str, c: CharacterClass) -> str:
    """SQL for the joined windows of a candidate, (a, b) from its start, that have enough entropy."""
    g = "array(" + ", ".join(f"{x}L" for x in c.sums) + ")"
    codes = f"transform(split({candidate}, ''), x -> instr({_quoted(c.alphabet)}, x))"
    # Step i: character x comes, and o (0: none yet) goes. ``h`` holds the counts, ``s`` their sum.
    gone = f"if(w.o > 0 and w.o <> w.x, {g}[w.h[w.o - 1]] - {g}[w.h[w.o - 1] - 1], 0L)"
    come = f"if(w.o <> w.x, {g}[w.h[w.x - 1] + 1] - {g}[w.h[w.x - 1]], 0L)"
    counts = "if(w.o = w.x, w.h, transform(w.h, (n, j) -> n + if(j + 1 = w.x, 1, 0) - if(j + 1 = w.o, 1, 0)))"
    hot = f"i + 1 >= {c.window} and v.s <= {c.most}L"
    away = f"i + 1 - {c.window} > v.b"
    fields = "'h', {h}, 's', {s}, 'a', {a}, 'b', {b}, 'out', {out}"
    # The inner transforms of one-element arrays only name intermediate values: w, then v.
    stepped = f"named_struct({fields.format(h=counts, s=f'w.s - {gone} + {come}', a='w.a', b='w.b', out='w.out')})"
    joined = "named_struct({})".format(
        fields.format(
            h="v.h", s="v.s", a=f"if({hot} and {away}, i + 1 - {c.window}, v.a)", b=f"if({hot}, i + 1, v.b)",
            out=f"if({hot} and {away} and v.b >= 0, concat(v.out, array(named_struct('a', v.a, 'b', v.b))), v.out)",
        )
    )
    widened = f"named_struct('h', acc.h, 's', acc.s, 'a', acc.a, 'b', acc.b, 'out', acc.out, 'x', codes[i], 'o', if(i >= {c.window}, codes[i - {c.window}], 0))"
    merge = f"(acc, i) -> transform(transform(array({widened}), w -> {stepped}), v -> {joined})[0]"
    start = f"named_struct('h', array_repeat(0, {len(c.alphabet)}), 's', 0L, 'a', -1, 'b', -1, 'out', cast(array() as array<struct<a:int,b:int>>))"
    finish = "acc -> if(acc.b >= 0, concat(acc.out, array(named_struct('a', acc.a, 'b', acc.b))), acc.out)"
    return f"transform(array({codes}), codes -> aggregate(sequence(0, size(codes) - 1), {start}, {merge}, {finish}))[0]"


def found(docs: DataFrame, text: str = "text", classes: Sequence[CharacterClass] = CLASSES) -> DataFrame:
    """``docs`` with ``spans``: (start, place, end, kind) of all secrets, in the order of start and kind; ``place`` is the kind's."""
    p = free_prefix(docs)
    df = docs.withColumn(f"{p}t", text_of(text))
    spans: list[str] = []
    for k, (name, pattern, group, least) in enumerate(BASE):
        df = _located(df, f"{p}t", SEARCHED.get(name, pattern), f"{p}{name}")
        long_enough = f"length(regexp_extract(m.match, {_quoted(pattern)}, {group})) >= {least}"
        spans.append(f"transform(filter({p}{name}, m -> {long_enough}), m -> named_struct('start', m.start, 'place', {k}, 'end', m.end, 'kind', '{name}'))")
    for k, c in enumerate(classes, len(BASE)):
        df = _located(df, f"{p}t", c.pattern, f"{p}{c.name}")
        clean = " or ".join(f"m.match rlike {_quoted(a)}" for a in c.allowed) or "false"
        df = df.withColumn(f"{p}{c.name}", F.expr(f"filter({p}{c.name}, m -> not ({clean}))"))
        windows = f"transform({high_entropy('m.match', c)}, x -> named_struct('start', m.start + x.a, 'place', {k}, 'end', m.start + x.b, 'kind', '{c.name}'))"
        spans.append(f"flatten(transform({p}{c.name}, m -> {windows}))")
    df = df.withColumn("spans", F.expr(f"array_sort(concat({', '.join(spans)}))"))
    names = [c for c in docs.columns if c != "spans"]
    return df.select(*names, "spans")


def listed(spans: Column, base_only: bool = False) -> Column:
    """The spans as kind:start:end, joined by commas."""
    some = F.filter(spans, lambda s: s["place"] < len(BASE)) if base_only else spans
    return F.concat_ws(",", F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans) of every text; what the entropy of its strings adds is in ``spans``."""
    rows = found(docs.select(F.col(key).alias("id"), F.col(text).alias("text")))
    n = lambda k: F.size(F.filter("spans", lambda s: s["place"] == k)).cast("long")
    counts = [n(k).alias(f"n_{name}") for k, (name, *_) in enumerate(BASE)]
    return rows.select(F.col("id").alias(key), *counts, F.sha2(listed(F.col("spans"), True), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _sql_located(kind: str, place: int, pattern: str, keep: str) -> str:
    """DuckDB's rows (k, place, kind, start, end, m) of the matches that satisfy ``keep``."""
    p = pattern.replace("'", "''")
    return f"""
  select k, {place} as place, '{kind}' as kind, pos as start, pos + length(m) as "end", m from (
    select k, m, sum(length(piece)) over w + coalesce(sum(length(m)) over (partition by k order by i rows between unbounded preceding and 1 preceding), 0) as pos
    from (select k, unnest(string_split_regex(text, '{p}')) as piece, unnest(list_append(regexp_extract_all(text, '{p}'), null)) as m,
            unnest(range(len(string_split_regex(text, '{p}')))) as i from docs)
    window w as (partition by k order by i)) where m is not null and {keep}"""


def _sql_windows(place: int, c: CharacterClass) -> str:
    """DuckDB's spans of one class: each character's counts in the windows that it enters and leaves are counted anew, not carried on."""
    clean = " or ".join(f"regexp_matches(m, '{a}')" for a in c.allowed)
    g = f"({c.sums}::bigint[])"
    gain = f"{g}[(coming + 1)::int] - {g}[coming::int]"
    loss = f"{g}[(going + 1)::int] - {g}[going::int]"
    return f"""
cand{place} as (select row_number() over () as c, k, start, m from ({_sql_located(c.name, place, c.pattern, f"not ({clean})")})),
chars{place} as (select c, k, start, unnest(range(length(m))) as i, unnest(string_split(m, '')) as ch from cand{place}),
counted{place} as (
  select *, count(*) over (partition by c, ch order by i range between {c.window - 1} preceding and current row) as coming,
    count(*) over (partition by c, ch order by i range between current row and {c.window - 1} following) as going from chars{place}),
flow{place} as (select c, k, start, i, {gain} as d from counted{place} union all select c, k, start, i + {c.window}, -({loss}) from counted{place}),
steps{place} as (select c, k, start, i, sum(d) as d from flow{place} group by all),
sums{place} as (select *, sum(d) over (partition by c order by i) as s from steps{place}),
hot{place} as (select c, k, start, i + 1 as stop from sums{place} where s <= {c.most} and i >= {c.window - 1} and i < (select max(length(m)) from cand{place} x where x.c = sums{place}.c)),
breaks{place} as (select *, case when stop - {c.window} <= lag(stop) over (partition by c order by stop) then 0 else 1 end as fresh from hot{place}),
runs{place} as (select *, sum(fresh) over (partition by c order by stop) as run from breaks{place}),
spans{place} as (select k, {place} as place, '{c.name}' as kind, start + min(stop) - {c.window} as start, start + max(stop) as "end" from runs{place} group by k, c, start, run)"""


def _sql() -> str:
    base = []
    for k, (name, pattern, group, least) in enumerate(BASE):
        plain = pattern.replace("'", "''")
        base.append(_sql_located(name, k, pattern, f"length(regexp_extract(m, '{plain}', {group})) >= {least}"))
    windows = ",".join(_sql_windows(k, c) for k, c in enumerate(CLASSES, len(BASE)))
    every = " union all ".join(["select k, place, kind, start, \"end\" from base", *(f"select * from spans{k}" for k in range(len(BASE), len(BASE) + len(CLASSES)))])
    line = "kind || ':' || start || ':' || \"end\""
    counts = ", ".join(f"count(*) filter (place = {k}) as n_{name}" for k, (name, *_) in enumerate(BASE))
    return f"""
with docs as (select row_number() over () as k, doc_id, coalesce(text, '') as text from documents),
base as ({" union all ".join(base)}),{windows},
total as (select k, {counts}, coalesce(string_agg({line}, ',' order by start, place) filter (place < {len(BASE)}), '') as base, string_agg({line}, ',' order by start, place) as spans
  from ({every}) group by k)
select doc_id, {", ".join(f"coalesce(n_{name}, 0) as n_{name}" for name, *_ in BASE)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join total using (k)"""


SQL = _sql()
