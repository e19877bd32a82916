"""SQL of allocations: caps and clusters as bounded recursions over lists, one element a holding in ascending order of id."""

from __future__ import annotations

from tidewright.plans.oracle import r6

CLIPS, PASSES = 64, 24


def _filled(name: str, source: str, cap: float | None) -> str:
    """Weights of ``source`` (w, g) clipped at the cap, what is clipped spread over the rest, as ``name`` (w, g)."""
    if cap is None:
        return f"{name} as (select w, g from {source})"
    return f"""{name}_steps as (select 0 as k, w, g from {source} union all
  select k + 1, list_transform(w, lambda x: case when x > {cap} + 1e-12 then {cap} when x < {cap} - 1e-12 and spare > 1e-12
    then x + case when base <= 1e-18 then spare / n else spare * x / base end else x end), g
  from (select k, w, g, list_sum(list_transform(w, lambda x: case when x > {cap} + 1e-12 then x - {cap} else 0.0 end)) as spare,
    list_sum(list_transform(w, lambda x: case when x < {cap} - 1e-12 then x else 0.0 end)) as base,
    len(list_filter(w, lambda x: x < {cap} - 1e-12)) as n from {name}_steps where k < {CLIPS})),
{name} as (select w, g from {name}_steps where k = {CLIPS})"""


def capped(per_holding: float | None, per_group: float | None, groups: int) -> str:
    """From ``start`` (w, g: weights and the groups' numbers below ``groups``) to ``w`` (id, weight). The caps can be met."""
    parts = [_filled("single", "start", per_holding)]
    if per_group is None:
        parts.append("again as (select w, g from single)")
    else:
        # A step is one group of a pass; the groups' totals are those at the pass's start.
        parts.append(f"""level as (select 0 as k, w, g, []::double[] as t from single union all
  select k + 1, case when t[f + 1] > {per_group} + 1e-9 then list_transform(w, lambda x, i: case when g[i] = f then x * {per_group} / t[f + 1] else x + (t[f + 1] - {per_group}) * x / room end) else w end, g, t
  from (select k, w, g, f, t, list_sum(list_transform(w, lambda x, i: case when g[i] = f then 0.0 else x end)) as room
    from (select k, w, g, k % {groups} as f, case when k % {groups} = 0 then list_transform(range({groups}), lambda m: list_sum(list_transform(w, lambda x, i: case when g[i] = m then x else 0.0 end))) else t end as t
      from level where k < {PASSES * groups}))),
again_in as (select w, g from level where k = {PASSES * groups})""")
        parts.append(_filled("again", "again_in", per_holding))
    parts.append("w as (select unnest(ids) as id, unnest(list_transform(again.w, lambda x: x / list_sum(again.w))) as weight from again cross join names)")
    return ",\n".join(parts)


def holdings(groups: int) -> str:
    """``names``: the ids that have a variance, and the number of each one's group among all brands."""
    return f"""brands as (select p_brand as id, (row_number() over (order by p_brand) - 1) % {groups} as g from (select distinct p_brand from part where p_brand is not null)),
names as (select list(i order by i) as ids, list(g order by i) as g, list(cov order by i) as v from shr join brands on brands.id = i where i = j)"""


INVERSE_VOLATILITY = """start as (select list_transform(v, lambda x: (1 / sqrt(x)) / list_sum(list_transform(v, lambda y: 1 / sqrt(y)))) as w, g from names)"""

#: Single linkage: the two nearest clusters (the first such pair) merge and the union goes last. Then halving: a stretch of
#: the leaves in order is split in the middle, each half weighed against the other's variance under inverse-variance weights.
RISK_PARITY = """mat as (select n, list(cov order by a, b) as c from (select i as a, j as b, cov from shr union all select j, i, cov from shr where i <> j) cross join (select len(ids) as n from names) group by n),
near as (select n, c, list_transform(range(n * n), lambda k: sqrt(greatest(0.0, (1 - c[k + 1] / sqrt(c[(k // n) * (n + 1) + 1] * c[(k % n) * (n + 1) + 1])) / 2))) as d from mat),
merges as (select n, list_transform(range(n), lambda k: [k]) as cl from mat union all
  select n, list_append(list_filter(cl, lambda x, k: k <> p[2] and k <> p[3]), list_concat(cl[p[2]::bigint], cl[p[3]::bigint]))
  from (select n, cl, list_sort(flatten(list_transform(range(1, len(cl)), lambda a: list_transform(range(a + 1, len(cl) + 1), lambda b:
      [list_min(list_transform(cl[a], lambda x: list_min(list_transform(cl[b], lambda y: d[x * n + y + 1])))), a::double, b::double]))))[1] as p
    from (select m.n, m.cl, near.d from merges m cross join near where len(m.cl) > 1))),
leaves as (select cl[1] as o from merges where len(cl) = 1),
split as (select 0::bigint as lo, n as hi, 1.0::double as f from mat union all
  select unnest([lo, mid]) as lo, unnest([mid, hi]) as hi, unnest([f * alpha, f * (1 - alpha)]) as f
  from (select lo, mid, hi, f, case when va + vb > 1e-18 then 1 - va / (va + vb) else 0.5 end as alpha
    from (select lo, mid, hi, f,
      list_sum(list_transform(left_part, lambda x: list_sum(list_transform(left_part, lambda y: c[x * n + y + 1] / c[x * (n + 1) + 1] / c[y * (n + 1) + 1])))) / list_sum(list_transform(left_part, lambda x: 1 / c[x * (n + 1) + 1])) ** 2 as va,
      list_sum(list_transform(right_part, lambda x: list_sum(list_transform(right_part, lambda y: c[x * n + y + 1] / c[x * (n + 1) + 1] / c[y * (n + 1) + 1])))) / list_sum(list_transform(right_part, lambda x: 1 / c[x * (n + 1) + 1])) ** 2 as vb
      from (select lo, lo + (hi - lo) // 2 as mid, hi, f, n, c, o[lo + 1 : lo + (hi - lo) // 2] as left_part, o[lo + (hi - lo) // 2 + 1 : hi] as right_part
        from split cross join mat cross join leaves where hi - lo > 1)))),
start as (select list(f order by o[lo + 1]) as w, any_value(g) as g from split cross join leaves cross join names where hi - lo = 1)"""


def allocated(covariances: str, risk: str, weights: str, per_holding: float | None, per_group: float | None, groups: int = 3) -> str:
    """The whole query. covariances: ends in ``shr`` (i, j, cov) for i <= j; risk: goes on from ``w`` (id, weight)."""
    more = f", {r6('(select sum(weight * weight) from w)')} as concentration, (select count(distinct idx) from syn)::bigint as days, '' as warnings\nfrom w join marg"
    return f"{covariances.replace('with ', 'with recursive ', 1)},\n{holdings(groups)},\n{weights},\n{capped(per_holding, per_group, groups)}{risk.replace(chr(10) + 'from w join marg', more)}"
