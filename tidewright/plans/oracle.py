"""The same model in SQL, for an independent engine: common table expressions and a query for each name."""

from __future__ import annotations

from tidewright.schema import RANK_WINDOWS, VOLATILITY_WINDOWS, WINDOWS, slug

ROOT = "sqrt(252.0)"


def r6(x: str) -> str:
    return f"(floor(({x}) * 1e6 + 0.5) / 1e6)"


def _ret(f: int, s: int, idx: str = "eidx", close: str = "eclose") -> str:
    at = lambda c, d: f"max(case when idx = anchor - {d} then {c} end)"
    ok = f"any_value(anchor) - {s + f} >= 0 and {at(idx, s)} > {at(idx, s + f)}"
    return f"case when {ok} then {at(close, s)} / {at(close, s + f)} - 1 end"


def _vol(col: str, length: int, skip: int = 0) -> str:
    r = f"case when idx between anchor - {skip + length - 1} and anchor - {skip} then {col} end"
    return f"case when any_value(anchor) - {skip + length - 1} >= 1 and count({r}) >= ceil(0.6 * {length}) and count({r}) >= 2 then stddev_samp({r}) * {ROOT} end"


_R252 = "case when idx between anchor - 251 and anchor then ret end"
_OK252 = f"any_value(anchor) - 251 >= 1 and count({_R252}) >= 152"
_C252 = "case when idx between anchor - 251 and anchor then close end"
_FALL = "case when idx between anchor - 252 and anchor then close / peak - 1 end"
_NEAR = "case when idx between anchor - 62 and anchor and close is not null then (close >= high * 0.95)::int::double end"

MEASURES: dict[str, str] = {
    **{n: f"any_value({n})" for n in ("beta", "alpha", "r2", "pairs")},
    **{f"ret_{slug(w)}": _ret(f, s) for w, (f, s) in WINDOWS.items()},
    **{f"bret_{slug(w)}": _ret(f, s, "beidx", "beclose") for w, (f, s) in WINDOWS.items()},
    **{f"vol_{slug(w)}": _vol("ret", n) for w, n in VOLATILITY_WINDOWS.items()},
    **{f"rank_vol_{slug(w)}": _vol("ret", *WINDOWS[w]) for w in RANK_WINDOWS},
    **{f"res_vol_{slug(w)}": _vol("residual", *WINDOWS[w]) for w in RANK_WINDOWS},
    "max_drawdown": f"case when any_value(anchor) - 252 >= 0 and count({_FALL}) >= 126 then least(0.0, min({_FALL})) end",
    "low52": f"min({_C252})",
    "high52": f"max({_C252})",
    "from_high": f"case when any_value(anchor) - 251 >= 0 and count({_C252}) >= 152 then max(case when idx = anchor then close end) / max({_C252}) end",
    "near_high": f"case when any_value(anchor) - 62 - 251 >= 0 and count({_NEAR}) >= 38 then avg({_NEAR}) end",
    "positive_days": f"case when {_OK252} then avg(case when {_R252} is not null then ({_R252} > 0)::int::double end) end",
    "downside": f"case when {_OK252} then sqrt(sum(case when {_R252} < 0 then ({_R252}) * ({_R252}) else 0.0 end) / count({_R252})) * {ROOT} end",
    "top_days": f"""case when {_OK252} and count({_R252}) > 5 and sum(ln(1 + ({_R252}))) > 0
      then list_sum(list_transform(list_slice(list_reverse_sort(list(ln(1 + ({_R252}))) filter ({_R252} is not null)), 1, 5), lambda x: greatest(x, 0.0)))
        / sum(ln(1 + ({_R252}))) end""",
    "last": "arg_max(close, case when close is not null then idx end)",
    "first_idx": "min(case when close is not null then idx end)",
    "last_idx": "max(case when close is not null then idx end)",
    "days": "count(close)",
}
RESIDUALS = {f"res_{slug(w)}": f"ret_{slug(w)} - beta * bret_{slug(w)}" for w in WINDOWS}

PANEL = """
with members as (
  select s_suppkey as id, s_name as name, r_name as segment, n_name as sector, s_acctbal as market_cap
  from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
weekly as (
  select l_suppkey as id, date_trunc('week', l_shipdate)::date as date, sum(l_extendedprice::decimal(18,2)) as paid, sum(l_quantity::decimal(18,2)) as quantity
  from lineitem group by 1, 2),
obs as (select id, date, paid::double / quantity::double as close from weekly),
bobs as (select segment, date, sum(paid)::double / sum(quantity)::double as close from weekly join members using (id) group by 1, 2),
cal as (select date, (row_number() over (order by date) - 1)::int as idx from (select distinct date from bobs)),
size as (select max(idx) as anchor from cal),
panel as (
  select i.id, c.idx, c.date, o.close from (select distinct id from obs) i cross join cal c left join obs o on o.id = i.id and o.date = c.date),
ser as (
  select p.id, segment, idx, date, close, close / lag(close) over w - 1 as ret,
    last_value(case when close is not null then idx end ignore nulls) over (w rows between 5 preceding and current row) as eidx,
    last_value(close ignore nulls) over (w rows between 5 preceding and current row) as eclose,
    max(close) over (w rows between 251 preceding and current row) as high
  from panel p join members using (id) window w as (partition by p.id order by idx)),
bpanel as (
  select s.segment, c.idx, o.close from (select distinct segment from bobs) s cross join cal c left join bobs o on o.segment = s.segment and o.date = c.date),
bser as (
  select segment, idx, close / lag(close) over w - 1 as bret,
    last_value(case when close is not null then idx end ignore nulls) over (w rows between 5 preceding and current row) as beidx,
    last_value(close ignore nulls) over (w rows between 5 preceding and current row) as beclose
  from bpanel window w as (partition by segment order by idx)),
days as (select * from ser left join bser using (segment, idx))
"""
MEASURED = (
    PANEL
    + """,
anch as (select 'now' as moment, anchor from size union all select 'prior', anchor - 63 from size),
pairs as (
  select *, case when idx between greatest(1, anchor - 755) and anchor and ret is not null and bret is not null then ret end as y,
    case when idx between greatest(1, anchor - 755) and anchor and ret is not null and bret is not null then bret end as x
  from days cross join anch),
fit as (
  select id, moment, regr_count(y, x) as n, regr_sxx(y, x) as sxx, regr_syy(y, x) as syy, regr_sxy(y, x) as sxy, regr_avgx(y, x) as ax, regr_avgy(y, x) as ay
  from pairs group by 1, 2),
beta as (
  select id, moment, case when n >= 120 and sxx > 1e-18 then sxy / sxx end as beta,
    case when n >= 120 and sxx > 1e-18 then ay - sxy / sxx * ax end as alpha,
    case when n >= 120 and sxx > 1e-18 then case when syy <= 1e-18 then 0.0 else sxy * sxy / (sxx * syy) end end as r2,
    case when n >= 120 and sxx > 1e-18 then n else 0 end as pairs
  from fit),
each as (
  select d.*, b.beta, b.alpha, b.r2, b.pairs, ret - b.beta * bret as residual,
    max(case when idx between anchor - 252 and anchor then close end) over (partition by id, moment order by idx rows between unbounded preceding and current row) as peak
  from pairs d join beta b using (id, moment)),
agg as (select id, segment, moment, """
    + ", ".join(f"{v} as {k}" for k, v in MEASURES.items())
    + """ from each group by 1, 2, 3),
m as (select *, """
    + ", ".join(f"{v} as {k}" for k, v in RESIDUALS.items())
    + """, case when vol_1y > 1e-9 then ret_12m / vol_1y end as return_per_vol from agg)
"""
)
EVENTS = """,
quarters as (
  select l_suppkey as id, date_trunc('quarter', l_shipdate) as quarter, max(l_shipdate)::date as date,
    sum(l_extendedprice::decimal(18,2))::double / count(*) as eps_actual, sum((l_quantity * p_retailprice)::decimal(18,2))::double / count(*) as eps_estimated
  from lineitem join part on l_partkey = p_partkey group by 1, 2),
newest as (
  select id, max(q.date) as date, arg_max(eps_actual, q.date) as eps_actual, arg_max(eps_estimated, q.date) as eps_estimated
  from quarters q, (select max(date) as last from cal) where q.date <= last group by id),
placed as (select n.*, (select min(idx) from cal where cal.date >= n.date) as at_idx from newest n),
latest as (
  select p.id, p.date, p.eps_actual, p.eps_estimated, (p.eps_actual - p.eps_estimated) / d.eclose as surprise,
    case when p.at_idx < anchor and e.eidx > d.eidx then e.eclose / d.eclose - 1 end as since_return
  from placed p cross join size join days d on d.id = p.id and d.idx = p.at_idx join days e on e.id = p.id and e.idx = anchor
  where p.at_idx <= anchor and anchor - p.at_idx <= 63)
"""
NOW = [c for c in (*MEASURES, *RESIDUALS, "return_per_vol") if not c.startswith("bret")]
PRIOR = [*(f"ret_{slug(w)}" for w in WINDOWS), *(f"res_{slug(w)}" for w in WINDOWS), *(f"vol_{slug(w)}" for w in VOLATILITY_WINDOWS), "return_per_vol"]
_INTS = {"pairs", "first_idx", "last_idx", "days"}
_shown = lambda c, x: x if c in _INTS else r6(x)
UNIVERSE = (
    MEASURED
    + EVENTS
    + """,
ends as (select id, max(case when idx = anchor then eclose end) as end_now, max(case when idx = anchor - 63 then eclose end) as end_prior from days cross join size group by id),
uni as (
  select n.id, mem.name, n.segment, mem.sector, """
    + r6("mem.market_cap")
    + " as market_cap, "
    + r6("mem.market_cap * (end_prior / end_now)")
    + " as prior_market_cap, "
    + r6("surprise")
    + " as surprise, "
    + ", ".join(f"{_shown(c, 'n.' + c)} as {c}" for c in NOW)
    + ", "
    + ", ".join(f"{r6('p.' + c)} as prior_{c}" for c in PRIOR)
    + """
  from m n join m p on p.id = n.id and p.moment = 'prior' join members mem on mem.id = n.id join ends on ends.id = n.id left join latest l on l.id = n.id
  where n.moment = 'now')
"""
)


def measures(columns: list[str], at: str = "now") -> str:
    shown = ", ".join(f"{_shown(c, c)} as {c}" for c in columns)
    return f"{MEASURED} select id, {shown} from m where moment = '{at}'"


def screen(value: str, prior: str, descending: bool, pool: str = "true", invert: bool = False, change_only: bool = False) -> str:
    own = "desc" if descending else "asc"
    shown = "asc" if descending == invert else "desc"
    active = "change::double" if change_only else "v"
    return f"""{UNIVERSE},
pool as (select id, {value} as v, {prior} as p from uni where {pool}),
basis as (
  select *, case when v is not null then rank() over (partition by v is null order by v {own}) end as basis_now,
    case when p is not null then rank() over (partition by p is null order by p {own}) end as basis_then from pool),
moved as (select *, basis_then - basis_now as change from basis)
select id, case when {active} is not null then rank() over (partition by ({active}) is null order by {active} {shown}) else 0 end as rank,
  {r6(active)} as value, change from moved"""


def thinned(query: str, keep: str) -> str:
    """The query over the panel of which only some weeks of the securities stay."""
    whole = "obs as (select id, date, paid::double / quantity::double as close from weekly)"
    assert query.count(whole) == 1
    return query.replace(whole, f"{whole[:-1]} where {keep})")


def digits(size: str, places: int) -> str:
    """Fixed-point digits of a value of zero or more, halves up; ties are odd multiples of a power of two."""
    return f"printf('%.{places}f', case when ({size}) * {2 ** (places + 1)} % 2 = 1 then ({size}) + {10.0 ** -(places + 2)} else ({size}) end)"
