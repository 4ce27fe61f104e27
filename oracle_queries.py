"""Equivalent SQL for the registered queries.

Written independently of the Spark plans: samples are ranked with window
functions instead of cut at a key, subjects are multiplied by seeds with a join,
and the logistic fit is solved by bisection instead of Newton steps.
"""

from __future__ import annotations

import re

# The xxHash64 constants, as published.
P1 = 0x9E3779B185EBCA87
P2 = 0xC2B2AE3D27D4EB4F
P3 = 0x165667B19E3779F9
P4 = 0x85EBCA77C2B2AE63
P5 = 0x27D4EB2F165667C5
LOW = (1 << 32) - 1
Z = 1.9599639845400536

TRIAL = """
adsl as (
  select c_custkey SUBJID, case when c_custkey%2=0 then 'F' else 'M' end SEX,
         cast(c_nationkey%4+1 as int) TRTPN,
         case c_nationkey%4 when 0 then 'ACTIVE' when 1 then 'PLACEBO'
              when 2 then 'TEST 140MG' else 'TEST 210MG' end TRTP
  from customer),
adpa as (
  with v as (select o_custkey SUBJID, o_orderkey k,
               cast(row_number() over(partition by o_custkey order by o_orderdate,o_orderkey) as int) AVISITN,
               o_totalprice A10, cast(o_orderkey%100+1 as double) A20 from orders),
  l as (select SUBJID,k,AVISITN,10 PARAMN,A10 A from v
        union all select SUBJID,k,AVISITN,20 PARAMN,A20 A from v),
  b as (select SUBJID,PARAMN,A BASE from l where AVISITN=1),
  c as (select l.SUBJID,l.PARAMN,l.AVISITN,
               case when l.AVISITN>1 and l.k%37=0 then null else l.A end AVAL, b.BASE
        from l join b on l.SUBJID=b.SUBJID and l.PARAMN=b.PARAMN)
  select c.SUBJID,c.PARAMN,c.AVISITN,concat('Visit ',cast(c.AVISITN as varchar(9))) AVISIT,
         c.AVAL, 100*(c.BASE-c.AVAL)/c.BASE PCHG,
         case when c.AVAL is null then null
              when 100*(c.BASE-c.AVAL)/c.BASE>=25 then 1 else 0 end PCHGCA1N,
         s.TRTP, s.TRTPN
  from c join adsl s on s.SUBJID=c.SUBJID),
allv as (
  select p.*, a.SEX,
         lag(PCHGCA1N) over (partition by p.SUBJID order by AVISITN) LAGPCHGCA1N
  from adpa p left join adsl a on a.SUBJID=p.SUBJID where PARAMN=10),
novisit2 as (
  select p.*, a.SEX,
         lag(PCHGCA1N) over (partition by p.SUBJID order by AVISITN) LAGPCHGCA1N
  from adpa p left join adsl a on a.SUBJID=p.SUBJID where PARAMN=10 and AVISITN<>2),
base6 as (select * from novisit2 where AVISITN=6),
pools as (
  select s.SUBJID,
         coalesce(bool_or(AVISITN=3 and PCHG<10), false) poor4,
         coalesce(bool_or(AVISITN=4 and PCHG<10), false) poor5,
         coalesce(bool_or(AVISITN=5 and PCHG<10), false) poor6
  from adsl s left join adpa p on p.SUBJID=s.SUBJID and p.PARAMN=10
  group by s.SUBJID)"""


def _replaced(text: str, *pairs: tuple[str, str]) -> str:
    for old, new in pairs:
        if old not in text:
            raise ValueError(old)
        text = text.replace(old, new)
    return text


# All orders of a month are one visit; its rows follow the order key.
REPEATED = _replaced(
    TRIAL,
    (
        "row_number() over(partition by o_custkey order by o_orderdate,o_orderkey)",
        "dense_rank() over(partition by o_custkey order by date_trunc('month', o_orderdate))",
    ),
    (
        "select SUBJID,PARAMN,A BASE from l where AVISITN=1",
        "select SUBJID,PARAMN,arg_min(A,k) BASE from l where AVISITN=1 group by all",
    ),
    ("c as (select l.SUBJID,", "c as (select l.k LINE, l.SUBJID,"),
    ("select c.SUBJID,", "select c.LINE, c.SUBJID,"),
    ("order by AVISITN) LAG", "order by AVISITN, LINE) LAG"),
)
NATIONS = _replaced(
    TRIAL,
    (
        """case c_nationkey%4 when 0 then 'ACTIVE' when 1 then 'PLACEBO'
              when 2 then 'TEST 140MG' else 'TEST 210MG' end TRTP
  from customer""",
        "n_name TRTP from customer join nation on n_nationkey = c_nationkey",
    ),
)


def _lit(n: int) -> str:
    return f"{n}::UBIGINT"


def _mul(x: str, c: int) -> str:
    lo = f"(({x} & {_lit(LOW)}) * {_lit(c & LOW)})"
    hi = (
        f"((({lo} >> 32) + ((({x} & {_lit(LOW)}) * {_lit(c >> 32)}) & {_lit(LOW)})"
        f" + ((({x} >> 32) * {_lit(c & LOW)}) & {_lit(LOW)})) & {_lit(LOW)})"
    )
    return f"(({hi} << 32) | ({lo} & {_lit(LOW)}))"


def _add(x: str, c: int) -> str:
    lo = f"(({x} & {_lit(LOW)}) + {_lit(c & LOW)})"
    hi = f"((({lo} >> 32) + ({x} >> 32) + {_lit(c >> 32)}) & {_lit(LOW)})"
    return f"(({hi} << 32) | ({lo} & {_lit(LOW)}))"


def _rot(x: str, r: int) -> str:
    return f"((({x} & {_lit((1 << (64 - r)) - 1)}) << {r}) | ({x} >> {64 - r}))"


def _hash_step(src: str, value: str, seed: str, out: str) -> str:
    """xxHash64 of one 64-bit value, 64-bit arithmetic done on 32-bit halves."""
    s = f"(select *, {_mul(value, P2)} _a, {_add(seed, P5 + 8)} _s from {src})"
    s = f"(select *, {_rot('_a', 31)} _r from {s})"
    s = f"(select *, xor(_s, {_mul('_r', P1)}) _c from {s})"
    s = f"(select *, {_rot('_c', 27)} _t from {s})"
    s = f"(select *, {_mul('_t', P1)} _u from {s})"
    s = f"(select *, {_add('_u', P4)} _d from {s})"
    s = f"(select *, xor(_d, _d >> 33) _v from {s})"
    s = f"(select *, {_mul('_v', P2)} _e from {s})"
    s = f"(select *, xor(_e, _e >> 29) _w from {s})"
    s = f"(select *, {_mul('_w', P3)} _f from {s})"
    return (
        f"(select * exclude(_a,_s,_r,_c,_t,_u,_d,_v,_e,_w,_f), xor(_f, _f >> 32) {out} from {s})"
    )


def _seeds(first: int, last: int) -> str:
    return f"seeds as (select cast(range as bigint) seed from range({first}, {last + 1}))"


HASHED = "hashed as (select * from {})".format(
    _hash_step(
        "(select p.*, SUBJID::UBIGINT _id, 42::UBIGINT _start from pools p)", "_id", "_start", "_h1"
    )
)


def _key(src: str, draw: int) -> str:
    """src plus the signed key ``k`` of a draw; src has seed and the subject's hash."""
    stepped = _hash_step(
        _hash_step(f"(select *, seed::UBIGINT _seed, {draw}::UBIGINT _draw from {src})", "_seed", "_h1", "_h0"),
        "_draw",
        "_h0",
        "_h2",
    )
    top = _lit(1 << 63)
    return (
        f"(select * exclude(_h2, _h0, _seed, _draw), case when _h2 >= {top} then (_h2 - {top})::BIGINT"
        f" - 9223372036854775807 - 1 else _h2::BIGINT end k from {stepped})"
    )


def _mcar(first: int, last: int, trial: str = TRIAL) -> str:
    """CTEs up to ``ranked``: seed, SUBJID, rank, pool size."""
    return f"""{trial}, {_seeds(first, last)}, {HASHED},
subj as (select seed, h.* from hashed h, seeds),
ranked as (
  select seed, SUBJID, row_number() over (partition by seed order by k, SUBJID) rn,
         count(*) over (partition by seed) n_pool
  from {_key('subj', 0)})"""


def _rate(p) -> str:
    return f"cast({p} as double)"


def _drawn(p) -> str:
    return f"rn <= floor({_rate(p)} * n_pool)"


MCAR_SCENARIOS = "scen as (select * from (values ('MCAR 10%',0.1),('MCAR 20%',0.2),('MCAR 30%',0.3)) t(scenario,p))"
SCRIPT = [("MAR", 0.3, 0.05)]
MENU = [
    (f"MAR {100 * h:g}/{100 * low:g}%", h, low)
    for h in (0.3, 0.25, 0.2)
    for low in (0.1, 0.075, 0.05)
]


def _masked(dropout: str) -> str:
    return f"""(
  select d.scenario, d.seed, d.dropout_visit, r.* exclude(AVAL, PCHG, PCHGCA1N),
         case when coalesce(AVISITN >= dropout_visit, false) then null else AVAL end AVAL,
         case when coalesce(AVISITN >= dropout_visit, false) then null else PCHG end PCHG,
         case when coalesce(AVISITN >= dropout_visit, false) then null else PCHGCA1N end PCHGCA1N
  from allv r join {dropout} d on d.SUBJID = r.SUBJID)"""


def _mar(first: int, last: int, scenarios=SCRIPT, visits=(4, 5, 6)) -> str:
    """CTEs up to ``dropout``: scenario, seed, SUBJID, dropout_visit; ``step_v`` per visit."""
    rows = ",".join(f"('{s}',{_rate(h)},{_rate(low)})" for s, h, low in scenarios)
    sql = f"""{TRIAL}, {_seeds(first, last)}, {HASHED},
scen as (select * from (values {rows}) t(scenario, p_high, p_low)),
step_3 as (select scenario, p_high, p_low, seed, h.*, cast(null as int) dropout_visit
           from hashed h, seeds, scen)"""
    for v in visits:
        sql += f""",
step_{v} as (
  select * exclude(k, is_high, rn, n_pool, dropout_visit),
         is_high is_high_{v}, n_pool n_pool_{v},
         floor(case when is_high then p_high else p_low end * n_pool) n_drawn_{v},
         coalesce(dropout_visit,
                  case when rn <= floor(case when is_high then p_high else p_low end * n_pool)
                       then {v} end) dropout_visit
  from (select *, row_number() over (partition by scenario, seed, is_high order by k, SUBJID) rn,
               count(*) over (partition by scenario, seed, is_high) n_pool
        from (select *, poor{v} and dropout_visit is null is_high from {_key(f'step_{v - 1}', v)})))"""
    return sql + f""",
dropout as (select scenario, seed, SUBJID, dropout_visit from step_{visits[-1]}),
masked as {_masked('dropout')}"""


def _rows_by_strategy_mcar() -> str:
    """long rows scenario, seed, strategy, SEX, TRTP, y of the fits."""
    return f""",
{MCAR_SCENARIOS},
flagged as (select s.scenario, r.seed, b.SEX, b.TRTP, b.PCHGCA1N y, b.LAGPCHGCA1N lagged,
                   r.rn <= floor(cast(s.p as double) * r.n_pool) missing
            from base6 b join ranked r on r.SUBJID=b.SUBJID, scen s),
fitrows as (
  select scenario, seed, 'completers' strategy, SEX, TRTP, y from flagged where not missing
  union all
  select scenario, seed, 'imputed', SEX, TRTP, case when missing then 0 else y end from flagged
  union all
  select scenario, seed, 'locf', SEX, TRTP, case when missing then lagged else y end from flagged)"""


LAST_OBSERVED = """,
carried as (
  select *, last_value(case when AVISITN<>2 then PCHGCA1N end ignore nulls) over (
           partition by scenario, seed, SUBJID order by AVISITN
           rows between unbounded preceding and 1 preceding) seen
  from masked)"""


def _rows_by_strategy_mar(last_observed: bool = False) -> str:
    src, lagged = ("carried", "seen") if last_observed else ("masked", "LAGPCHGCA1N")
    return (LAST_OBSERVED if last_observed else "") + f""",
at6 as (select scenario, seed, SEX, TRTP, PCHGCA1N y, {lagged} lagged from {src} where AVISITN=6),
fitrows as (
  select scenario, seed, 'completers' strategy, SEX, TRTP, y from at6 where y is not null
  union all
  select scenario, seed, 'imputed', SEX, TRTP, coalesce(y, 0) from at6
  union all
  select scenario, seed, 'locf', SEX, TRTP, coalesce(y, lagged) from at6)"""


CELLS = """,
cells as (select scenario, seed, strategy, SEX, TRTP, count(y) n, cast(sum(y) as bigint) r
          from fitrows where y is not null group by all)"""

# Profile bisection: for a given sex effect each arm's odds solve a quadratic.
FIT = """,
arms as (
  select scenario, seed, strategy, TRTP,
         cast(coalesce(sum(n) filter (SEX='F'),0) as double) n0,
         cast(coalesce(sum(n) filter (SEX='M'),0) as double) n1,
         cast(sum(r) as double) y,
         cast(coalesce(sum(r) filter (SEX='M'),0) as double) y1
  from cells group by all),
grp as (select scenario, seed, strategy, row_number() over () gid
        from (select distinct scenario, seed, strategy from arms)),
garms as (select gid, TRTP, n0, n1, y, y1 from arms join grp using (scenario, seed, strategy)),
bisect as (
  select gid, 0 i, cast(-20 as double) lo, cast(20 as double) hi from grp
  union all
  select gid, i+1, case when too_high then lo else (lo+hi)/2 end, case when too_high then (lo+hi)/2 else hi end
  from (
    select b.gid, b.i, b.lo, b.hi,
           sum(n1*k*z/(1+k*z)) - sum(y1) > 0 too_high
    from (select b.*, a.n0, a.n1, a.y, a.y1, exp((lo+hi)/2) k,
                 (-(n0+n1*exp((lo+hi)/2)-y-y*exp((lo+hi)/2))
                  + sqrt((n0+n1*exp((lo+hi)/2)-y-y*exp((lo+hi)/2))*(n0+n1*exp((lo+hi)/2)-y-y*exp((lo+hi)/2))
                         + 4*exp((lo+hi)/2)*(n0+n1-y)*y))
                 / (2*exp((lo+hi)/2)*(n0+n1-y)) z
          from bisect b join garms a on a.gid=b.gid where b.i < 60) b
    group by b.gid, b.i, b.lo, b.hi)),
solved as (
  select gid, exp((lo+hi)/2) k from bisect where i=60),
odds as (
  select s.gid, s.k, TRTP,
         (-(n0+n1*k-y-y*k) + sqrt((n0+n1*k-y-y*k)*(n0+n1*k-y-y*k) + 4*k*(n0+n1-y)*y))
         / (2*k*(n0+n1-y)) z
  from solved s join garms a on a.gid=s.gid),
wide as (
  select gid, max(k) k, max(z) filter (TRTP='ACTIVE') za, max(z) filter (TRTP='PLACEBO') zp,
         max(z) filter (TRTP='TEST 140MG') z140, max(z) filter (TRTP='TEST 210MG') z210
  from odds group by gid),
ratios as (
  select scenario, seed, strategy, contrast, or_raw, round(or_raw, 4) or_value, true converged
  from (
    select gid, 'AvsP' contrast, za/zp or_raw from wide
    union all select gid, 'SexM2F', k from wide
    union all select gid, 'T140vsP', z140/zp from wide
    union all select gid, 'T210vsP', z210/zp from wide) join grp using (gid))"""

TRUE_ROWS = """,
fitrows as (select 'true' scenario, 0 seed, 'complete' strategy, SEX, TRTP, PCHGCA1N y from base6)"""

SUMMARY = f""",
summary as (
  select scenario, strategy, contrast, avg(or_value) mean, var_samp(or_value) var,
         avg(or_value) - {Z}*sqrt(var_samp(or_value))/sqrt(count(or_value)) low,
         avg(or_value) + {Z}*sqrt(var_samp(or_value))/sqrt(count(or_value)) high,
         count(or_value) n, count(*) - count(or_value) n_failed
  from ratios group by all)"""

SUMMARY_OUT = """
select scenario, strategy, contrast, round(mean,8) mean, round(var,8) var, round(low,8) low,
       round(high,8) high, n, n_failed from summary"""

RATIOS_OUT = """
select scenario, seed, strategy, contrast, round(or_raw,6) or_raw, or_value, converged from ratios"""

# Labels of the figures.
AXIS = """case contrast when 'AvsP' then 'TRTP Active control ' || chr(10) || ' vs Placebo'
       when 'T140vsP' then 'TRTP Test drug 140mg ' || chr(10) || ' vs Placebo '
       when 'T210vsP' then 'TRTP Test drug 210mg ' || chr(10) || ' vs Placebo '
       else 'Sex(M vs F)' end"""
GROUPS = """case {} when 'completers' then 'Completers Data' when 'imputed' then 'Imputed Data (Composite)'
       when 'locf' then 'Imputed Data (LOCF)' else 'Complete Data' end"""

NEWLINE = "\n"


def _per_visit(*values: str) -> str:
    """Exact totals of a table of rows, weighted by the subject."""
    weight = "(SUBJID % 1009 + 1)"
    seen = [f"cast(sum({weight}) filter ({c} is not null) as bigint) {c}_seen" for c in ("AVAL", "PCHG", *values)]
    sums = [f"cast(sum({c} * {weight}) as bigint) {c}_sum" for c in values]
    cents = "cast(sum(cast(round(AVAL * 100) as bigint)) as bigint) cents"
    return ", ".join(["count(*) n", *seen, *sums, cents])


def _digest(*values: str) -> str:
    """Per seed, rows and the sum of a part of each row's MD5."""
    columns = ["SUBJID", "AVISITN", *values]
    texts = [f"coalesce({c}::varchar, '-')" for c in columns]
    texts += [f"coalesce(floor({c} * 1000000)::bigint::varchar, '-')" for c in ("AVAL", "PCHG")]
    text = " || '|' || ".join(texts)
    return f"count(*) n, cast(sum(('0x' || substr(md5({text}), 1, 8))::bigint) as bigint) digest"


# Replicates written by the user: rows of visit 6 with each seed and draw.
OWN_RATES = "case TRTP when 'PLACEBO' then 0.4::double when 'TEST 210MG' then 0.1::double else 0.2::double end"
OWN_ROWS = """,
fitrows as (
  select 'own' scenario, seed, 'worst' strategy, SEX, TRTP,
         case when missing then (TRTP='PLACEBO')::int else PCHGCA1N end y from own
  union all
  select 'own', seed, 'carried', SEX, TRTP,
         case when missing then coalesce(LAGPCHGCA1N, 0) else PCHGCA1N end from own)"""


def _own(first: int, last: int, draw: int, missing: str) -> str:
    return f"""{TRIAL}, {_seeds(first, last)}, {HASHED},
subj as (select seed, h.* from hashed h, seeds),
keyed as (
  select s.seed, s.k, b.*, row_number() over (partition by seed, TRTP order by k, b.SUBJID) rn,
         count(*) over (partition by seed, TRTP) n_pool
  from {_key('subj', draw)} s join base6 b on b.SUBJID = s.SUBJID),
own as (select *, {missing} missing from keyed){OWN_ROWS}"""


def _with(*parts: str, out: str) -> str:
    return "with recursive " + "".join(parts) + NEWLINE + out


def _renamed(sql: str, suffix: str, names: tuple[str, ...]) -> str:
    for name in names:
        sql = re.sub(rf"\b{name}\b", f"{name}_{suffix}", sql)
    return sql


FIT_NAMES = (
    "arms",
    "grp",
    "garms",
    "bisect",
    "solved",
    "odds",
    "wide",
    "ratios",
    "cells",
    "fitrows",
)


def _truth(suffix: str = "truth") -> str:
    """The complete-data fit under its own CTE names, as ``ratios_truth``."""
    return _renamed(TRUE_ROWS + CELLS + FIT, suffix, FIT_NAMES)


def build(replicates: int, sample_seeds: int, single_seed: int) -> dict[str, str]:
    first20 = (1, sample_seeds)
    allseeds = (1, replicates)
    mcar20, mar20 = _mcar(*first20), _mar(*first20)
    flag20 = f"""
from base6 b join ranked r on r.SUBJID=b.SUBJID"""
    missing = _drawn(0.3)
    mcar_full = _mcar(*allseeds) + _rows_by_strategy_mcar() + CELLS
    mar_full = _mar(*allseeds) + _rows_by_strategy_mar() + CELLS
    mar_seen = _mar(*allseeds) + _rows_by_strategy_mar(True) + CELLS
    one = (single_seed, single_seed)
    own_sampled = _own(*allseeds, 21, f"rn <= floor({OWN_RATES} * n_pool)")
    own_flagged = _own(
        *allseeds,
        22,
        "k::double / 18446744073709551616.0::double + 0.5::double"
        " < case when LAGPCHGCA1N = 1 then 0.1::double else 0.35::double end",
    )
    row_seeds = _mar(1, min(sample_seeds, 20))
    forest_out = f"""
select scenario, {AXIS} "yAxis", round(mean,8) "boxOdds", round(low,8) "boxCILow",
       round(high,8) "boxCIHigh", {GROUPS.format('strategy')} "group", round(mean,3) "VAL"
from (select scenario, strategy, contrast, mean, low, high from summary
      union all
      select s.scenario, 'complete', t.contrast, or_value, or_value, or_value
      from ratios_truth t, (select distinct scenario from summary) s)"""
    variance_out = """
select scenario,
       case contrast when 'AvsP' then 'Active Control vs Placebo'
            when 'T140vsP' then '140 mg Test Drug vs Placebo' else '210 mg Test Drug vs Placebo' end "OR",
       case strategy when 'completers' then 'completers' when 'imputed' then 'composite' else 'LOCF' end "dataHandling",
       round(var, 2) var
from summary where contrast <> 'SexM2F'"""
    single_out = f"""
select scenario, strategy, {AXIS} "yAxis", "boxOdds", {GROUPS.format('source')} "group",
       round("boxOdds",3) "VAL"
from (select scenario, strategy, contrast, or_value "boxOdds", strategy source from ratios
      union all
      select s.scenario, s.strategy, t.contrast, t.or_value, 'complete'
      from ratios_truth t, (select distinct scenario, strategy from ratios) s)"""
    pool_rows = " union all ".join(
        f"""select seed, {v} visit, case when is_high_{v} then 'high' else 'low' end pool,
            n_pool_{v} n_pool, cast(n_drawn_{v} as bigint) n_drawn from step_6"""
        for v in (4, 5, 6)
    )
    carried = """select scenario, seed, 'locf' strategy, SEX, TRTP,
         case when PCHGCA1N is not null then PCHGCA1N when AVISITN=3 then 0 else LAGPCHGCA1N end y
  from {}"""
    all_visits = f""",
fitrows as ({carried.format('masked')})"""
    interactive = f""",
dropout_45 as (select scenario, seed, SUBJID, dropout_visit from step_5),
masked_45 as {_masked('dropout_45')},
fitrows as (
  select scenario, seed, 'completers' strategy, SEX, TRTP, PCHGCA1N y
  from masked where AVISITN=6 and PCHGCA1N is not null
  union all
  select scenario, seed, 'imputed', SEX, TRTP, coalesce(PCHGCA1N, 0) from masked where AVISITN=6
  union all
  {carried.format('masked_45')})"""
    sizes = ",".join(
        [f"('MCAR {100 * p:g}%','MCAR',{_rate(p)},null,null)" for p in (0.1, 0.2, 0.3)]
        + [f"('{s}','MAR',null,{_rate(h)},{_rate(low)})" for s, h, low in SCRIPT + MENU]
    )
    return {
        "load_responses": f"with {TRIAL} select * from adpa",
        "load_subjects": f"with {TRIAL} select SUBJID, SEX from adsl",
        "subject_universe": f"with {TRIAL} select distinct SUBJID from adsl",
        "scenario_sizes": f"""with {TRIAL},
grid as (select * from (values {sizes}) t(scenario, mechanism, p, p_high, p_low)),
counts as (select count(*) n, count(*) filter (poor4) n_high from pools)
select scenario, mechanism, cast(p as double) p, cast(p_high as double) p_high,
       cast(p_low as double) p_low, n n_subjects, cast(floor(p*n) as bigint) n_drawn,
       cast(floor(p_high*n_high) as bigint) n_drawn_high,
       cast(floor(p_low*(n-n_high)) as bigint) n_drawn_low from grid, counts""",
        "analysis_set": f"with {TRIAL} select * exclude(LAGPCHGCA1N) from base6",
        "analysis_set_by_position": f"""with {TRIAL}
select SUBJID, AVISITN, PCHGCA1N, TRTP, SEX from base6""",
        "three_way_table": f"""with {TRIAL},
levels as (select * from (select distinct TRTPN from base6 where SEX is not null and PCHGCA1N is not null),
                         (select distinct SEX from base6 where TRTPN is not null and PCHGCA1N is not null))
select l.TRTPN, l.SEX, count(*) filter (PCHGCA1N=0) n_0, count(*) filter (PCHGCA1N=1) n_1
from levels l left join base6 b on b.TRTPN=l.TRTPN and b.SEX=l.SEX group by all""",
        "response_lag": f"""with {TRIAL}
select SUBJID, AVISITN, PCHGCA1N, LAGPCHGCA1N from novisit2""",
        "response_lag_all_visits": f"""with {TRIAL}
select SUBJID, AVISITN, PCHGCA1N, LAGPCHGCA1N from allv""",
        "complete_cells": _with(
            TRIAL, TRUE_ROWS, CELLS, out="select SEX, TRTP, n, r from cells"
        ),
        "complete_odds_ratios": _with(
            TRIAL,
            TRUE_ROWS,
            CELLS,
            FIT,
            out="select contrast, round(or_raw,6) or_raw, or_value, converged from ratios",
        ),
        "odds_ratios_of_nations": _with(
            NATIONS,
            TRUE_ROWS,
            CELLS,
            FIT,
            out="""
select TRTP || ' vs ' || base contrast, round(z/zb,6) or_raw, round(z/zb,4) or_value, true converged
from odds, (select TRTP base, z zb from odds order by TRTP limit 1) where TRTP <> base
union all select 'M vs F', round(k,6), round(k,4), true from (select distinct k from odds)""",
        ),
        "odds_ratios_of_sites": _with(
            TRIAL,
            """,
fitrows as (select 'true' scenario, 0 seed, 'complete' strategy, SEX,
                   'S' || lpad((SUBJID % 251)::varchar, 3, '0') TRTP, PCHGCA1N y from allv)""",
            CELLS,
            _replaced(
                FIT, ("from cells group by all)", "from cells group by all having sum(r) > 0 and sum(r) < sum(n))")
            ),
            out="""
select 'SITE' factor, c.TRTP "level", base, round(z/zb,6) or_raw, round(z/zb,4) or_value, z/zb is not null converged
from (select distinct TRTP from cells) c left join odds o on o.TRTP = c.TRTP,
     (select min(TRTP) base from cells) m left join (select TRTP, z zb from odds) b on b.TRTP = m.base
where c.TRTP <> base
union all select 'SEX', 'M', 'F', round(k,6), round(k,4), true from (select distinct k from odds)""",
        ),
        "odds_ratios_separated": _with(
            TRIAL,
            TRUE_ROWS,
            CELLS,
            _replaced(FIT, ("from cells group by all)", "from cells where TRTP <> 'TEST 210MG' group by all)")),
            out="""
select contrast, round(or_raw,6) or_raw, or_value, or_raw is not null converged from ratios""",
        ),
        "truth_frame": _with(
            TRIAL,
            TRUE_ROWS,
            CELLS,
            FIT,
            out=f"""select {AXIS} "yAxis", or_value "boxOdds", round(or_value,3) "VAL" from ratios""",
        ),
        "mcar_sample": f"with {mcar20} select seed, SUBJID from ranked where {missing}",
        "mcar_sample_nested": f"""with {mcar20}
select seed, SUBJID, cast(case when {_drawn(0.1)} then 0.1 when {_drawn(0.2)} then 0.2 else 0.3 end as double) rate
from ranked where {missing}""",
        "mcar_completers": f"""with {mcar20}
select seed, b.SUBJID, SEX, TRTP, PCHGCA1N {flag20} where not ({missing})""",
        "mcar_composite": f"""with {mcar20}
select seed, b.SUBJID, SEX, TRTP, case when {missing} then 0 else PCHGCA1N end PCHGCA1N {flag20}""",
        "mcar_locf": f"""with {mcar20}
select seed, b.SUBJID, SEX, TRTP, case when {missing} then LAGPCHGCA1N else PCHGCA1N end PCHGCA1N {flag20}""",
        "mcar_cells": _with(mcar_full, out="select * from cells"),
        "mcar_cells_repeated": _with(
            _mcar(*allseeds, trial=REPEATED),
            _rows_by_strategy_mcar(),
            CELLS,
            out="select * from cells",
        ),
        "mcar_replicates": _with(mcar_full, FIT, out=RATIOS_OUT),
        "mcar_summary": _with(mcar_full, FIT, SUMMARY, out=SUMMARY_OUT),
        "mcar_summary_median": _with(
            mcar_full,
            FIT,
            out="""
select scenario, strategy, contrast, count(or_value) n, round(median(or_value), 8) median,
       round(min(or_value), 8) lowest from ratios group by all""",
        ),
        "mcar_forest_frame": _with(mcar_full, FIT, SUMMARY, _truth(), out=forest_out),
        "mcar_variance_frame": _with(mcar_full, FIT, SUMMARY, out=variance_out),
        "mar_pools": f"with {_mar(*allseeds)} select distinct * from ({pool_rows})",
        "mar_dropout": f"""with {mar20}
select scenario, seed, SUBJID, dropout_visit from dropout where dropout_visit is not null""",
        "mar_masked_long": f"""with {mar20}
select seed, AVISITN, {_per_visit('PCHGCA1N', 'LAGPCHGCA1N')} from masked where AVISITN<>2 group by all""",
        "mar_masked_rows": f"""with {row_seeds}
select scenario, seed, SUBJID, AVISITN, AVAL, PCHGCA1N, LAGPCHGCA1N from masked where AVISITN<>2""",
        "mar_masked_digest": f"""with {mar20}
select scenario, seed, {_digest('PCHGCA1N', 'LAGPCHGCA1N')} from masked where AVISITN<>2 group by all""",
        "mar_last_observed_rows": f"""with {row_seeds} {LAST_OBSERVED}
select scenario, seed, SUBJID, AVISITN, AVAL, coalesce(PCHGCA1N,seen) PCHGCA1N
from carried where AVISITN<>2""",
        "mar_last_observed_digest": f"""with {mar20} {LAST_OBSERVED}
select scenario, seed, {_digest('PCHGCA1N')}
from (select * replace (coalesce(PCHGCA1N,seen) as PCHGCA1N) from carried where AVISITN<>2) group by all""",
        "own_sampled_replicates": _with(own_sampled, CELLS, FIT, out=RATIOS_OUT),
        "own_flagged_cells": _with(own_flagged, CELLS, out="select * from cells"),
        "own_flagged_summary": _with(own_flagged, CELLS, FIT, SUMMARY, out=SUMMARY_OUT),
        "single_draw_chosen_seed": """select scenario, strategy, contrast, true same
from (values ('MCAR 10%'), ('MCAR 20%'), ('MCAR 30%')) a(scenario),
     (values ('completers'), ('imputed'), ('locf')) b(strategy),
     (values ('AvsP'), ('SexM2F'), ('T140vsP'), ('T210vsP')) c(contrast)""",
        "mar_completers": f"""with {mar20}
select seed, SUBJID, SEX, TRTP, PCHGCA1N from masked where AVISITN=6 and PCHGCA1N is not null""",
        "mar_composite": f"""with {mar20}
select seed, SUBJID, SEX, TRTP, coalesce(PCHGCA1N,0) PCHGCA1N from masked where AVISITN=6""",
        "mar_locf": f"""with {mar20}
select seed, SUBJID, SEX, TRTP, coalesce(PCHGCA1N,LAGPCHGCA1N) PCHGCA1N from masked where AVISITN=6""",
        "mar_locf_last_observed": f"""with {mar20} {LAST_OBSERVED}
select seed, AVISITN, {_per_visit('PCHGCA1N')}
from (select * replace (coalesce(PCHGCA1N,seen) as PCHGCA1N) from carried where AVISITN<>2) group by all""",
        "mar_locf_all_visits": _with(
            _mar(*first20, visits=(4, 5)), all_visits, CELLS, FIT, out=RATIOS_OUT
        ),
        "mar_cells": _with(mar_full, out="select * from cells"),
        "mar_replicates": _with(mar_full, FIT, out=RATIOS_OUT),
        "mar_summary": _with(mar_full, FIT, SUMMARY, out=SUMMARY_OUT),
        "mar_summary_last_observed": _with(mar_seen, FIT, SUMMARY, out=SUMMARY_OUT),
        "mar_forest_frame": _with(mar_full, FIT, SUMMARY, _truth(), out=forest_out),
        "mar_variance_frame": _with(mar_full, FIT, SUMMARY, out=variance_out),
        "single_draw_mcar": _with(
            _mcar(*one), _rows_by_strategy_mcar(), CELLS, FIT, _truth(), out=single_out
        ),
        "single_draw_mar": _with(
            _mar(*one, scenarios=MENU),
            _rows_by_strategy_mar(),
            CELLS,
            FIT,
            _truth(),
            out=single_out,
        ),
        "single_draw_mar_interactive": _with(
            _mar(*one, scenarios=MENU), interactive, CELLS, FIT, _truth(), out=single_out
        ),
    }
