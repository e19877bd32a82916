r"""Operator 12, conversation structure repair: the cheapest edits that give a legal order of roles.

Legal are no turns at all, or an optional system turn and then user and assistant in alternation, an
assistant last. A grammar state says what may follow: nothing yet, after system, after user, after
assistant. Edits: Keep a turn (0), Rerole it to user or assistant (1), Delete it (2; blank turns and
repetitions must go), Insert an empty turn of user or assistant anywhere (5); a truncated turn that
stays adds 5. In each state only one of user and assistant may follow, so an edit's initial tells it.

First a backward pass over the turns takes the cost to go of each state, and notes for each the
ASCII-least edit among those that are tight (edit and cost to go after it add up to the cost to go).
A greedy forward walk over these notes then gives the audit, the ASCII-least of the cheapest. No
other cost is kept: a turn takes two bytes in the pass, however long its conversation is.

Both passes need no texts: faults and initials are made before, a repetition being a row that is not
the first of its (conversation, role, text digest). The audit then meets the texts in turn order, and a
stream through the sorted partition rebuilds the turns, to return or to hash. A conversation is walked
by one task, as its edits and its hash depend on all turns before, but in bounded memory: only its notes
and its audit, one cell of the result, grow with it.

Defined cases: a null role or text is one space; a null turn comes before all others, equal turns are
in the order of role and text digest (MD5); conversations with a null id are one; a conversation
without rows (listed in ``ids``) has zeros and an empty audit; roles count by their first letter, others than s, u, a are never
legal; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import BLANKS, kept, slim, sql_crc32

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
NEVER = 1 << 40
#: Faults of a row, the first that holds.
SOUND, BLANK, DUPLICATE, CUT = range(4)
INITIALS = "sua"
#: What user or assistant leads to: states are nothing yet, after system, after user, after assistant.
SPOKEN = (2, 2, 3, 2)
#: Where a turn that is kept leads to, by state and initial.
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ROLE_INTO = {2: "user", 3: "assistant"}
EDITS = "DIKR"
#: Costs to go behind the last turn.
END = (0, INSERT + INSERT, INSERT, 0)


@lru_cache(maxsize=65_536)
def _step(kind: int, after: tuple[int, int, int, int]) -> tuple[tuple[int, int, int, int], int]:
    """Costs to go before a turn from those behind it, and the states' best edits, two bits each. kind: fault * 4 + initial."""
    fault, initial = kind >> 2, (*INITIALS, "?")[kind & 3]
    stays = NEVER if fault in (BLANK, DUPLICATE) else TRUNCATED if fault == CUT else 0
    ways = []
    for q in range(4):
        keep = stays + KEEP + after[KEPT[q][initial]] if initial in KEPT[q] else NEVER
        ways.append({"D": DELETE + after[q], "K": keep, "R": stays + REROLE + after[SPOKEN[q]]})
    base = [min(w.values()) for w in ways]
    user, assistant = min(base[2], INSERT + base[3]), min(base[3], INSERT + base[2])
    costs = (min(base[0], INSERT + user), min(base[1], INSERT + user), user, assistant)
    notes = 0
    for q in range(4):
        tight = ways[q] | {"I": INSERT + costs[SPOKEN[q]]}
        notes |= EDITS.index(min(e for e in EDITS if tight[e] == costs[q])) << 2 * q
    return costs, notes


def audited(kinds: bytes) -> tuple[int, str]:
    """(cost, audit) of a conversation's turns. kinds: fault * 4 + initial of each."""
    notes, costs, base = bytearray(len(kinds)), END, 0
    for i in range(len(kinds) - 1, -1, -1):
        low = min(costs)  # costs to go are taken from their least, so few differ and steps are looked up
        base += low
        costs, notes[i] = _step(kinds[i], (costs[0] - low, costs[1] - low, costs[2] - low, costs[3] - low))
    audit, q, i = [], 0, 0
    while i < len(kinds) or q in (1, 2):
        e = EDITS[notes[i] >> 2 * q & 3] if i < len(kinds) else "I"
        audit.append(e)
        if e == "K":
            q = KEPT[q][INITIALS[kinds[i] & 3]]
        elif e != "D":
            q = SPOKEN[q]
        i += e != "I"
    return base + costs[0], "".join(audit)


def damaged(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, turn, role, text): rows damaged by a checksum of their key and turn, to try a repair on; nulls are one space."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(one(key), F.lit(":"), one(turn))) % 20
    whole = rows.select(F.col(key).alias(key), F.col(turn).alias(turn), one(role).alias(role), one(text).alias(text), code.alias("_code")).where("_code <> 0")
    said = F.when(F.col("_code") == 1, "").when(F.col("_code") == 2, F.translate(text, ".!?", "")).otherwise(F.col(text))
    spoken = F.when(F.col("_code") == 4, "user").otherwise(F.col(role))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_code") == 3, 2).otherwise(1)))
    return whole.select(key, turn, spoken.alias(role), said.alias(text), times.alias("_copy")).drop("_copy")


def _rows(rows: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    one = lambda c: F.coalesce(F.col(c), F.lit(" "))
    return rows.select(F.col(key).alias("id"), F.col(turn).alias("turn"), one(role).alias("role"), one(text).alias("text"), F.unhex(F.md5(one(text))).alias("digest"))


def _fault(text: Column) -> Column:
    """Blank or cut by the text alone."""
    end = F.right(F.rtrim(text, F.lit(" " + BLANKS)), F.lit(1))
    return F.when(end == "", BLANK).when(end.isin(".", "!", "?"), SOUND).otherwise(CUT)


PLAN = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def plans(rows: DataFrame, ids: DataFrame | None = None, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation, those of ``ids`` without rows too.

    The columns count what was wrong before the repair; the audit holds the initials of its edits in order.
    """
    own = _rows(rows, key, turn, role, text)
    initial = F.when(F.substring("role", 1, 1).isin(*INITIALS), F.instr(F.lit(INITIALS), F.substring("role", 1, 1)) - 1).otherwise(3)
    thin = own.select("id", "turn", "role", "digest", _fault(F.col("text")).alias("fault"), initial.cast("int").alias("initial"), F.lit(True).alias("here"))
    if ids is not None:
        kinds = dict(thin.dtypes)
        absent = [F.expr(f"cast(null as {kinds[c]}) as {c}") for c in ("turn", "role", "digest", "fault", "initial")]
        thin = thin.unionByName(ids.select(F.col(key).alias("id")).distinct().select("id", *absent, F.lit(False).alias("here")))
    # One exchange by conversation: first places of equal texts are found within it.
    first = "row_number() over (partition by id, here, role, digest order by turn nulls first)"
    marked = thin.repartition("id").withColumn("nth", F.expr(first))
    kind = F.when(F.col("fault") == BLANK, BLANK).when(F.col("nth") > 1, DUPLICATE).otherwise(F.col("fault")) * 4 + F.col("initial")
    ready = marked.select("id", "turn", "role", "digest", "here", "nth", kind.alias("kind")).sortWithinPartitions("id", "turn", "role", "digest", "nth").select("id", "turn", "here", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(["id", *[c.split()[0] for c in PLAN.split(", ")]])
        at = None
        for batch in slim(batches, 10_000):
            out.kinds.setdefault("id", batch.schema.field("id").type)
            for who, when, here, k in zip(*(batch[c].to_pylist() for c in ("id", "turn", "here", "kind")), strict=True):
                if at is None or at.id != who:
                    if at is not None:
                        out.add(at.planned())
                    at = _Turns(who)
                if here:
                    at.add(when, k)
            yield from out.flush()
        if at is not None:
            out.add(at.planned())
        yield from out.flush(0)

    made = ready.mapInArrow(run, f"id {ready.schema['id'].dataType.simpleString()}, {PLAN}")
    return made.withColumnRenamed("id", key)


class _Turns:
    """What one conversation's turns tell, in order: two bytes a turn at most."""

    def __init__(self, who) -> None:  # noqa: ANN001 (any key)
        self.id, self.kinds, self.illegal = who, bytearray(), 0
        self.low = self.high = None
        self.days = 0

    def add(self, turn: int | None, kind: int) -> None:
        if self.kinds:
            pair = (*INITIALS, "?")[self.kinds[-1] & 3] + (*INITIALS, "?")[kind & 3]
            self.illegal += pair not in ("su", "ua", "au")
        self.kinds.append(kind)
        if turn is not None and turn != self.high:
            self.low, self.high, self.days = turn if self.low is None else self.low, turn, self.days + 1

    def planned(self) -> tuple:
        cost, audit = audited(bytes(self.kinds))
        faults = bytes(k >> 2 for k in self.kinds)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.days
        return (self.id, gaps, faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), self.illegal, cost, audit)


class _Out:
    """Rows that become batches of a few thousand, or some megabytes of text."""

    def __init__(self, names: list[str]) -> None:
        self.names, self.rows, self.size = names, [], 0
        self.kinds: dict[str, pa.DataType] = {}

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        self.size += 100 + sum(len(x) for x in row if isinstance(x, str))

    def flush(self, least: int = 1 << 20) -> Iterator[pa.RecordBatch]:
        if self.rows and self.size >= least:
            columns = zip(*self.rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, self.kinds.get(n)) for n, c in zip(self.names, columns, strict=True)], self.names)
            self.rows, self.size = [], 0


class Walk:
    """Applies an audit to the turns as they come."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, 0

    def _inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self.state = SPOKEN[self.state]
            yield "I", ROLE_INTO[self.state], ""

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the turns that stand for the next one: what is inserted before it, and itself unless deleted."""
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = KEPT[self.state][role[0]]
            yield edit, role, text
        elif edit == "R":
            self.state = SPOKEN[self.state]
            yield edit, ROLE_INTO[self.state], text

    def rest(self) -> Iterator[tuple[str, str, str]]:
        yield from self._inserted()


def _met(planned: DataFrame, rows: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """Each conversation's plan, then its turns in order, in one partition."""
    own = _rows(rows, key, turn, role, text)
    plan = planned.withColumnRenamed(key, "id")
    columns = [c for c in plan.columns if c != "id"]
    kinds = dict(own.dtypes) | dict(plan.dtypes)
    null = lambda c: F.expr(f"cast(null as {kinds[c]}) as {c}")
    a = plan.select("id", F.lit(0).alias("part"), *[null(c) for c in ("turn", "role", "text", "digest")], *columns)
    b = own.select("id", F.lit(1).alias("part"), "turn", "role", "text", "digest", *[null(c) for c in columns])
    return a.unionByName(b).repartition("id").sortWithinPartitions("id", "part", "turn", "role", "digest").drop("digest")


def _streamed(met: DataFrame, columns: list[str], schema: str, begin: Callable, each: Callable, end: Callable) -> DataFrame:
    """One pass over met plans and turns. begin(plan), each(plan's state, turn's edits) and end(state, edits) give rows without their id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, walk, state, who = _Out(["id", *columns]), None, None, None
        for batch in slim(batches, 1000):
            out.kinds.setdefault("id", batch.schema.field("id").type)
            if "turn" in columns:
                out.kinds.setdefault("turn", batch.schema.field("turn").type)
            plans_here = [c for c in batch.schema.names if c not in ("id", "part", "turn", "role", "text")]
            for row in batch.to_pylist():
                if row["part"] == 0:
                    if walk is not None:
                        for made in end(state, walk.rest()):
                            out.add((who, *made))
                    who, walk = row["id"], Walk(row["audit"])
                    state = begin([row[c] for c in plans_here])
                else:
                    for made in each(state, row["turn"], walk.turn(row["role"], row["text"])):
                        out.add((who, *made))
            yield from out.flush()
        if walk is not None:
            for made in end(state, walk.rest()):
                out.add((who, *made))
        yield from out.flush(0)

    return met.mapInArrow(run, schema)


def repaired(planned: DataFrame, rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, place, edit, turn, role, text): the turns of every conversation after the repair; inserted ones have no turn. planned: of ``plans``."""
    met = _met(planned.select(key, "audit"), rows, key, turn, role, text)
    kinds = dict(met.dtypes)

    def numbered(state: list[int], when: int | None, edits: Iterator) -> Iterator[tuple]:
        for e, r, t in edits:
            state[0] += 1
            yield state[0], e, None if e == "I" else when, r, t

    schema = f"id {kinds['id']}, place long, edit string, turn {kinds['turn']}, role string, text string"
    made = _streamed(met, ["place", "edit", "turn", "role", "text"], schema, lambda plan: [0], numbered, lambda state, edits: numbered(state, None, edits))
    return made.withColumnsRenamed({"id": key, "turn": turn, "role": role, "text": text})


class _Digest:
    """A plan and the hash of the turns that were rebuilt so far."""

    def __init__(self, plan: list) -> None:
        self.plan, self.hash, self.any = plan, hashlib.sha256(), False

    def take(self, edits: Iterator) -> None:
        for _, role, text in edits:
            self.hash.update((("\n" if self.any else "") + f"{role}:{text}").encode())
            self.any = True


def digests(planned: DataFrame, rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``planned`` with repaired_sha256: the hash of the rebuilt turns, as role:text joined by line feeds."""

    def each(state: _Digest, when: int | None, edits: Iterator) -> tuple:
        state.take(edits)
        return ()

    def end(state: _Digest, edits: Iterator) -> Iterator[tuple]:
        state.take(edits)
        yield (*state.plan, state.hash.hexdigest())

    met = _met(planned, rows, key, turn, role, text)
    names = [c.split()[0] for c in PLAN.split(", ")]
    made = _streamed(met, [*names, "repaired_sha256"], f"id {dict(met.dtypes)['id']}, {PLAN}, repaired_sha256 string", _Digest, each, end)
    return made.withColumnRenamed("id", key)


def repaired_digests(rows: DataFrame, ids: DataFrame | None = None, key: str = "conv_id") -> DataFrame:
    """Plans and digests of conversations: the plans are written once, and then meet the texts."""
    return digests(kept(plans(rows, ids, key), "repair-plans"), rows, key)


def _sql() -> str:
    """The same repair for DuckDB: costs to go by one recursion from the last turn, the walk by another from the first."""
    blanks = r"[^\x20\x09-\x0D]"
    never = "1000000"
    stays = "case when fault = 'truncated' then 5 else 0 end"
    ways = []
    for q in range(4):
        keeps = " ".join(f"when initial = '{x}' then v{to}" for x, to in KEPT[q].items())
        ways.append(f"least(2 + v{q}, case when fault in ('blank', 'duplicate') then {never} else {stays} + least(case {keeps} else {never} end, 1 + v{SPOKEN[q]}) end) as b{q}")
    pick = lambda name, of: f"case {of} when 0 then {name}0 when 1 then {name}1 when 2 then {name}2 else {name}3 end"
    into = "(case q when 2 then 3 else 2 end)"
    kept_to = "(case when q = 0 and initial = 's' then 1 when q in (0, 1, 3) and initial = 'u' then 2 when q = 2 and initial = 'a' then 3 end)"
    edit = f"""case when r is not null and 2 + {pick("n", "q")} = {pick("v", "q")} then 'D'
      when 5 + {pick("v", into)} = {pick("v", "q")} then 'I'
      when fault not in ('blank', 'duplicate') and {kept_to} is not null and {stays} + {pick("n", kept_to)} = {pick("v", "q")} then 'K' else 'R' end"""
    spoken = f"case when {into} = 2 then 'user' else 'assistant' end"
    return f"""
with recursive named as (select *, {sql_crc32("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as code, coalesce(role, ' ') as r0, coalesce(text, ' ') as t0 from conversations),
convs as (select conv_id, row_number() over () as c from (select distinct conv_id from conversations)),
hurt as (
  select c, turn, case when code = 4 then 'user' else r0 end as role, case code when 1 then '' when 2 then translate(t0, '.!?', '') else t0 end as text
  from named join convs on named.conv_id is not distinct from convs.conv_id, range(case code when 0 then 0 when 3 then 2 else 1 end)),
seen as (
  select *, left(role, 1) as initial, row_number() over (partition by c order by turn nulls first, role, md5(text), nth) as r
  from (select *, row_number() over (partition by c, role, text order by turn nulls first) as nth from hurt)),
judged as (
  select *, case when not regexp_matches(text, '{blanks}') then 'blank' when nth > 1 then 'duplicate'
    when regexp_extract(text, '(.)[\x20\x09-\x0D]*$', 1, 's') not in ('.', '!', '?') then 'truncated' else 'sound' end as fault,
    lag(initial) over (partition by c order by r) || initial as pair from seen),
sizes as (
  select c, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
    count(*) filter (fault = 'truncated') as truncated, count(*) filter (pair is not null and pair not in ('su', 'ua', 'au')) as illegal from judged group by 1),
back(c, i, v0, v1, v2, v3) as (
  select c, n, 0, 10, 5, 0 from sizes
  union all
  select c, i - 1, least(b0, 5 + least(b2, 5 + b3)), least(b1, 5 + least(b2, 5 + b3)), least(b2, 5 + b3), least(b3, 5 + b2) from (
    select back.c, back.i, {", ".join(ways)} from back join judged on judged.c = back.c and judged.r = back.i)),
nodes as (
  select a.c, a.i, a.v0, a.v1, a.v2, a.v3, b.v0 as n0, b.v1 as n1, b.v2 as n2, b.v3 as n3, r, initial, role, text, fault
  from back a left join back b on b.c = a.c and b.i = a.i + 1 left join judged on judged.c = a.c and judged.r = a.i + 1),
walk(c, i, q, audit, made, stop) as (
  select c, 0::bigint, 0, '', []::varchar[], false from sizes
  union all
  select c, case when e in ('D', 'K', 'R') then i + 1 else i end,
    case when e is null or e = 'D' then q when e = 'K' then {kept_to} else {into} end, audit || coalesce(e, ''),
    case e when 'K' then list_append(made, role || ':' || text) when 'R' then list_append(made, {spoken} || ':' || text) when 'I' then list_append(made, {spoken} || ':') else made end, e is null
  from (select walk.*, initial, role, text, case when r is null and {pick("v", "q")} = 0 then null else {edit} end as e from walk join nodes on nodes.c = walk.c and nodes.i = walk.i where not stop))
select conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(v0, 0)::bigint as cost, coalesce(audit, '') as audit, sha256(coalesce(array_to_string(made, chr(10)), '')) as repaired_sha256
from convs left join sizes using (c) left join (select c, v0 from back where i = 0) using (c) left join (select c, audit, made from walk where stop) using (c)"""


SQL = _sql()
