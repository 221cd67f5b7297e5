"""The registered queries restated in SQL for DuckDB on the same tables."""

from __future__ import annotations

from demandspark.operators.naive import NAIVE_MODELS
from demandspark.operators.ets import ALPHAS, BETAS, free_parameters, grids
from demandspark.queries import COVERAGE_MINIMUM
from demandspark.schemas import FEATURE_LAGS, FEATURE_WINDOWS, NAMED_EVENTS, SMOOTHING_FORMS, TRACKS
from demandspark.sources.star_schema import DEPARTMENTS, SNAP_DAYS

WEEK = "cast(date_trunc('week', date) as date)"
MONTH = "cast(date_trunc('month', date) as date)"
_DEPT = "[" + ", ".join(f"'{d}'" for d in DEPARTMENTS) + "]"
_SNAP = ", ".join(
    f"cast(day(date) in ({', '.join(map(str, days))}) as int) as snap_{s}"
    for s, days in SNAP_DAYS.items()
)


def _base(item: str) -> str:
    return f"""
sold as (
  select {item} as item_id,
         {_DEPT}[cast(regexp_extract(p_brand, '[0-9]+') as int) % 7 + 1] as dept_id,
         split_part({_DEPT}[cast(regexp_extract(p_brand, '[0-9]+') as int) % 7 + 1], '_', 1) as cat_id,
         n_name as store_id,
         case r_name when 'AMERICA' then 'CA' when 'ASIA' then 'TX' when 'EUROPE' then 'WI'
                     else r_name end as state_id,
         cast(l_shipdate as date) as date, l_quantity, l_extendedprice, l_discount
  from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey
       join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
bounds as (select min(cast(l_shipdate as date)) as d0, max(cast(l_shipdate as date)) as d1 from lineitem),
days as (select d0, cast(unnest(generate_series(d0, d1, interval 1 day)) as date) as date from bounds),
calendar0 as (
  select date,
         cast(10000 + floor(date_diff('day', date '1994-12-31', date) / 7.0) as int) as wm_yr_wk,
         dayname(date) as weekday,
         cast((isodow(date) + 1) % 7 + 1 as int) as wday,
         cast(month(date) as int) as month, cast(year(date) as int) as year,
         'd_' || cast(date_diff('day', d0, date) + 1 as varchar) as d,
         case when month(date) = 10 and day(date) = 31 then 'Halloween'
              when month(date) = 7 and day(date) = 4 then 'IndependenceDay'
              when month(date) = 4 and day(date) = 15 then 'PesachEnd'
              when month(date) = 3 and day(date) = 14 then 'PurimEnd'
              when month(date) = 2 and isodow(date) = 7 and day(date) <= 7 then 'SuperBowl'
              when month(date) = 9 and isodow(date) = 1 and day(date) <= 7 then 'LaborDay'
              when month(date) = 11 and isodow(date) = 4 and day(date) between 22 and 28 then 'Thanksgiving'
              when month(date) = 12 and day(date) = 25 then 'Christmas' end as event_name_1,
         case when month(date) = 4 and day(date) = 15 and isodow(date) = 7 then 'Easter' end as event_name_2,
         {_SNAP}
  from days),
calendar as (
  select date, wm_yr_wk, weekday, wday, month, year, d, event_name_1,
         case when event_name_1 = 'SuperBowl' then 'Sporting'
              when event_name_1 = 'Halloween' then 'Cultural'
              when event_name_1 in ('PurimEnd', 'PesachEnd') then 'Religious'
              when event_name_1 is not null then 'National' end as event_type_1,
         event_name_2, case when event_name_2 is not null then 'Cultural' end as event_type_2,
         snap_CA, snap_TX, snap_WI from calendar0),
facts as (
  select item_id, dept_id, cat_id, store_id, state_id, date, cast(sum(l_quantity) as bigint) as sales
  from sold group by all),
keys as (select distinct item_id, dept_id, cat_id, store_id, state_id from sold),
daily as materialized (
  select k.item_id || '_' || k.store_id || '_evaluation' as id, k.*, c.d, c.date,
         coalesce(f.sales, 0) as sales
  from keys k cross join calendar c left join facts f using (item_id, store_id, date)),
prices as (
  select store_id, item_id,
         cast(10000 + floor(date_diff('day', date '1994-12-31', date) / 7.0) as int) as wm_yr_wk,
         min(l_extendedprice * (1 - l_discount) / l_quantity) as sell_price
  from sold group by all),
promo0 as (
  select * exclude (l), case when len(l) >= 4 then 0.5::double * l[(len(l) + 1) // 2] + 0.5::double * l[len(l) // 2 + 1] end as ref_price
  from (select *, list_sort(list(sell_price) over (partition by item_id, store_id order by wm_yr_wk
                                                   rows between 7 preceding and current row)) as l from prices)),
promo as (
  select *, sell_price < cast(0.95 as double) * ref_price as on_promo, sell_price / ref_price as price_relative_to_ref from promo0),
fresh as materialized (
  select item_id || '__' || store_id as id, {WEEK} as date, cast(sum(sales) as bigint) as sales,
         item_id, store_id, dept_id, cat_id, state_id
  from daily where dept_id = 'FOODS_3' group by all),
folds as (
  select cast(3 - i as int) as fold_id, hi - cast((i + 1) * 28 as int) as train_end,
         hi - cast((i + 1) * 28 - 1 as int) as test_start, hi - cast(i * 28 as int) as test_end
  from (select max(date) as hi from fresh), range(4) t(i)),
train as (select fold_id, id, date, sales from fresh join folds on date <= train_end),
test as (select fold_id, id, date, sales from fresh join folds on date between test_start and test_end)"""


BASE = _base("replace(p_brand, '#', '_')")
FINE = _base("replace(p_brand, '#', '_') || '_' || p_type")
PART = _base("replace(p_brand, '#', '_') || '_' || cast(p_partkey as varchar)")


def _sql(body: str, *ctes: str, base: str = BASE) -> str:
    return "with " + ",\n".join([base.strip(), *ctes]) + "\n" + body


# Shared fragments ---------------------------------------------------------


def _hist_mean(train: str, by: str, horizon: int, date: str) -> str:
    return f"""
  select {by}'HistoricalMean' as model_name, id, {date} as date, m as prediction
  from (select {by}id, avg(sales) as m from {train} group by all)
       join (select {by}max(date) as last from {train} group by all) l using ({by.rstrip(', ')}),
       range(1, {horizon + 1}) t(h)""".replace("using ()", "on true")


def _drift(train: str, by: str, horizon: int, date: str) -> str:
    return f"""
  select {by}'DriftNaive' as model_name, id, {date} as date,
         greatest(0.0, e + case when n > 1 then (e - b) / cast(n - 1 as double) else 0.0 end * h) as prediction
  from (select {by}id, cast(arg_min(sales, date) as double) as b, cast(arg_max(sales, date) as double) as e,
               count(sales) as n from {train} group by all)
       join (select {by}max(date) as last from {train} group by all) l using ({by.rstrip(', ')}),
       range(1, {horizon + 1}) t(h)""".replace("using ()", "on true")


def _seasonal(train: str, by: str, horizon: int, date: str, back: str) -> str:
    on = "hits.fold_id = m.fold_id and hits.id = m.id" if by else "hits.id = m.id"
    match = "x.fold_id = s.fold_id and " if by else ""
    return f"""
  select {by.replace('fold_id', 's.fold_id')}'SeasonalNaive' as model_name, x.id, s.date,
         cast(x.sales as double) as prediction
  from (select {by}{date} as date, {back} as lookback
        from (select {by}max(date) as last from {train} group by all), range(1, {horizon + 1}) t(h)) s
       join {train} x on {match}x.date = s.lookback
  union all
  select {by.replace('fold_id', 'm.fold_id')}'SeasonalNaive', m.id, s.date, m.avg_sales
  from (select {by}id, avg(sales) as avg_sales from {train} group by all) m
       join (select {by}{date} as date from (select {by}max(date) as last from {train} group by all),
             range(1, {horizon + 1}) t(h)) s on {'m.fold_id = s.fold_id' if by else 'true'}
  where not exists (
    select 1 from (select distinct {by.replace('fold_id', 'x.fold_id')}x.id
      from (select {by}{back} as lookback from (select {by}max(date) as last from {train} group by all),
            range(1, {horizon + 1}) t(h)) s join {train} x on {match}x.date = s.lookback) hits
    where {on})"""


W_DATE = "last + cast(7 * h as int)"
W_BACK = "last + cast(7 * h - 7 * 52 as int)"
M_DATE = f"cast(date_trunc('month', last) + to_months(cast(h as int)) as date)"
M_BACK = f"cast(date_trunc('month', last) + to_months(cast(h as int)) - to_months(12) as date)"

PREDS = (
    "preds as ("
    + _hist_mean("train", "fold_id, ", 4, W_DATE)
    + "\n  union all"
    + _seasonal("train", "fold_id, ", 4, W_DATE, W_BACK)
    + "\n  union all"
    + _drift("train", "fold_id, ", 4, W_DATE)
    + ")"
)
FULL_PREDS = (
    "preds as ("
    + _hist_mean("fresh", "", 4, W_DATE)
    + "\n  union all"
    + _seasonal("fresh", "", 4, W_DATE, W_BACK)
    + "\n  union all"
    + _drift("fresh", "", 4, W_DATE)
    + ")"
)
JOINED = "joined as (select model_name, fold_id, id, date, sales, prediction from test join preds using (fold_id, id, date))"

_METRICS = {
    "wmape": "sum(abs(sales - prediction)) / nullif(sum(abs(sales)), 0)",
    "bias": "avg(prediction - sales) / nullif(avg(abs(sales)), 0)",
    "rmse": "sqrt(avg((sales - prediction) * (sales - prediction)))",
    "mae": "avg(abs(sales - prediction))",
}


def _m(name: str, digits: bool = True) -> str:
    e = f"coalesce({_METRICS[name]}, 'nan'::double)"
    return f"round({e}, 6) as {name}" if digits else f"{e} as {name}"


ALL_METRICS = ", ".join(_m(n) for n in _METRICS)
BY_FOLD = (
    "by_fold as (select model_name, fold_id, "
    + ", ".join(_m(n, False) for n in _METRICS)
    + ", count(*) as n_obs from joined group by all)"
)
FOLD_OUT = (
    "select model_name, fold_id, train_end, test_start, test_end, round(wmape, 6) as wmape, round(bias, 6) as bias, "
    "round(rmse, 6) as rmse, round(mae, 6) as mae, n_obs from by_fold join folds using (fold_id)"
)

DRY = f"""dry as materialized (
  select item_id || '__' || state_id as id, {MONTH} as date, cast(sum(sales) as bigint) as sales
  from daily where dept_id in ('FOODS_1', 'FOODS_2', 'HOUSEHOLD_1', 'HOUSEHOLD_2')
  group by item_id, state_id, {MONTH})"""

FLAG15 = """flagged as (
  select *, sales = 0 and rolling_mean > 1 as suspicious_zero from (
    select *, case when count(sales) over w >= 10 then avg(sales) over w end as rolling_mean
    from daily window w as (partition by id order by date rows between 7 preceding and 7 following)))"""

FLAG4 = """flagged as (
  select *, sales = 0 and pos >= 8 and recent > 0 and recent >= 0.5 * series_mean as is_suspicious_zero from (
    select id, date, sales, case when count(sales) over p >= 2 then avg(sales) over p end as recent,
           avg(sales) over (partition by id) as series_mean,
           count(sales) over (partition by id order by date rows between unbounded preceding and current row) as pos,
           (select median(case when x.sales > 0 then x.sales end) from fresh x where x.id = fresh.id) as positive_median
    from fresh window p as (partition by id order by date rows between 4 preceding and 1 preceding)))"""

def _digest(source: str, *columns: str, where: str = "", part: str = MONTH) -> str:
    """Rows per series and month, and MD5 over the text of every cell; NULL is marked."""
    cells = ", ".join(f"coalesce(cast({c} as varchar), '\\N')" for c in columns)
    row = f"concat_ws('|', {cells})"
    return (
        f"select id, {part} as part, count(*) as n, md5(string_agg(row_text, chr(10) order by row_text)) as rows_md5 "
        f"from (select *, {row} as row_text from {source} {where}) group by all"
    )


LAUNCHED = """launched as (
  select d.* from daily d join (select id, min(date) as first_sale from daily where sales > 0 group by id) f
  using (id) where d.date >= f.first_sale)"""
LAUNCHED_TRACK = f"""launched_track as (
  select item_id || '__' || store_id as id, {WEEK} as date, cast(sum(sales) as bigint) as sales
  from launched where dept_id = 'FOODS_3' group by all)"""

_LAGS = ", ".join(f"lag(sales, {k}) over s as sales_lag_{k}" for k in FEATURE_LAGS)
_ROLLS = ", ".join(
    f"round({fn}(sales) over (partition by id order by date rows between {w} preceding and 1 preceding), 6) as sales_roll{w}_{n}"
    for w in FEATURE_WINDOWS
    for n, fn in (("mean", "avg"), ("std", "stddev_samp"))
)
_TIME = (
    "cast(month(date) as int) as month, cast(weekofyear(date) as int) as week_of_year, "
    "cast(year(date) as int) as year, cast(dayofyear(date) as int) as day_of_year"
)
_WS = "window s as (partition by id order by date)"
_NAMED = ", ".join(f"'{e}'" for e in NAMED_EVENTS)
WEEKS = f"""weeks as (
  select {WEEK} as date, sum(snap_CA) as s_ca, sum(snap_TX) as s_tx, sum(snap_WI) as s_wi,
         arg_min(wm_yr_wk, date) as wm_yr_wk,
         {', '.join(f"max(cast(coalesce(event_name_1 = '{e}', false) as int)) as event_{e}_in_week" for e in NAMED_EVENTS)},
         max(cast(event_name_1 is not null and event_name_1 not in ({_NAMED}) as int)) as event_other_in_week,
         max(cast(event_name_1 is not null as int)) as any_event_in_week
  from calendar group by 1)"""
_EVENT_COLS = [f"event_{e}_in_week" for e in NAMED_EVENTS] + ["event_other_in_week", "any_event_in_week"]
_EVENTS = ", ".join(f"cast(coalesce({c}, 0) as int) as {c}" for c in _EVENT_COLS)
_SNAPW = "cast(coalesce(case state_id when 'CA' then s_ca when 'TX' then s_tx when 'WI' then s_wi else 0 end, 0) as bigint) as snap_days_in_week"


def _level(level: str) -> str:
    return f"""lv_{level} as (
  select {level}, date, round(lag(m, 1) over (partition by {level} order by date), 6) as {level}_avg_sales_lag_1
  from (select {level}, date, avg(sales) as m from fresh group by all))"""


LEVELS = ",\n".join(_level(x) for x in ("dept_id", "store_id", "cat_id"))
_LEVEL_COLS = "dept_id_avg_sales_lag_1, store_id_avg_sales_lag_1, cat_id_avg_sales_lag_1"
_LEVEL_JOINS = " ".join(f"left join lv_{x} using ({x}, date)" for x in ("dept_id", "store_id", "cat_id"))
_PROMO_OUT = (
    "cast(coalesce(on_promo, false) as int) as is_on_promo, "
    "round(coalesce(price_relative_to_ref, 1.0), 6) as price_relative_to_ref"
)
MATRIX_CTE = f"""basic as (select id, date, sales, item_id, store_id, dept_id, cat_id, state_id, {_LAGS}, {_ROLLS}, {_TIME}
  from fresh {_WS}),
matrix as (
  select id, date, sales, {', '.join(f'sales_lag_{k}' for k in FEATURE_LAGS)},
         {', '.join(f'sales_roll{w}_{s}' for w in FEATURE_WINDOWS for s in ('mean', 'std'))},
         month, week_of_year, year, day_of_year, {_SNAPW}, {_EVENTS}, {_LEVEL_COLS}, {_PROMO_OUT}
  from basic left join weeks using (date) {_LEVEL_JOINS}
       left join promo using (item_id, store_id, wm_yr_wk))"""
MATRIX = f"{WEEKS},\n{LEVELS},\n{MATRIX_CTE}"

STATE_PROMO = """sp as (
  select item_id, state_id, wm_yr_wk, avg(cast(on_promo as int)) > 0.5 as on_promo, avg(price_relative_to_ref) as price_relative_to_ref
  from promo join (select distinct store_id, state_id from keys) using (store_id) group by item_id, state_id, wm_yr_wk)"""

MONTH_FOLDS = """mfolds as (
  select cast(3 - i as int) as fold_id, cast(hi - to_months(cast((i + 1) * 3 - 1 as int)) as date) - 1 as train_end,
         cast(hi - to_months(cast((i + 1) * 3 - 1 as int)) as date) as test_start,
         last_day(cast(hi - to_months(cast(i * 3 as int)) as date)) as test_end
  from (select date_trunc('month', max(date)) as hi from dry), range(4) t(i))"""

REQUESTS = """ids as (select distinct item_id, store_id, dept_id, state_id, item_id || '__' || store_id as id from sold),
requests as (
  select id, cast((cast(regexp_extract(item_id, '[0-9]+') as int) * 7
                   + cast(regexp_extract(store_id, '[0-9]+') as int)) % 15 as int) as horizon, 'drift' as model_name
  from ids)"""


def _smooth(name: str, source: str, by: str, forms: tuple[str, ...], m: int, horizon: int, date: str) -> str:
    """Point forecasts of the best form per series: every grid row reduced over the list of observations."""
    groups = grids(forms)
    params = ", ".join(
        f"('{t}', '{s}', {i}, {a}::double, {b}::double, {g}::double, {p}::double)"
        for (t, s), rows in groups.items()
        for i, (a, b, g, p) in enumerate(rows)
    )
    kinds = ", ".join(
        f"('{f}', {i}, '{f[0]}', '{f[1:-1]}', '{f[-1]}', {free_parameters(f[1:-1], f[-1], m)})" for i, f in enumerate(forms)
    )
    seasonal = f"""
  union all
  select {by}id, n, lo, ys, 'A' as season, {m} as m, list_transform(ph, lambda v: v - list_sum(ph) / {m}.0) as seas from (
    select {by}id, n, lo, ys, list_transform(range(1, {m + 1}), lambda j: (ys[j] - lev + ys[j + {m}] - lev) / 2) as ph
    from (select *, list_sum(ys[1:{2 * m}]) / {2 * m}.0 as lev from {name}_s where n >= {2 * m}))""" if any(f[-1] == "A" for f in forms) else ""
    return f"""{name}_s as materialized (
  select {by}id, count(*) as n, min(cast(sales as double)) as lo, list(cast(sales as double) order by date) as ys
  from {source} where sales is not null group by {by}id),
{name}_p(trend, season, number, alpha, beta, gamma, phi) as (values {params}),
{name}_f(form, ord, error, trend, season, k) as (values {kinds}),
{name}_c as (select {by}id, n, lo, ys, 'N' as season, 1 as m, [0.0::double] as seas from {name}_s{seasonal}),
{name}_v as (select *, list_transform(range(1, least(10, n) + 1), lambda j: ys[j] - seas[(j - 1) % m + 1]) as v from {name}_c),
{name}_m as (select *, cast(len(v) as double) as c, list_sum(v) / len(v) as mean, (len(v) + 1) / 2.0 as middle from {name}_v),
{name}_b as (
  select *, list_sum(list_transform(range(1, len(v) + 1), lambda j: (j - middle) * v[j]))
            / greatest(list_sum(list_transform(range(1, len(v) + 1), lambda j: (j - middle) * (j - middle))), 1e-12::double) as rise
  from {name}_m),
{name}_r as materialized (
  select {by}id, n, lo, m, p.trend, p.season, p.number, p.alpha, p.beta, p.phi, list_reduce(
    list_transform(ys, lambda y, i: {{'y': y, 'ph': (i - 1) % m + 1, 'level': 0.0::double, 'slope': 0.0::double, 'seas': seas,
      'sse': 0.0::double, 'rel': 0.0::double, 'logs': 0.0::double, 'bad': false}}),
    lambda a, x: {{'y': 0.0::double, 'ph': x.ph,
      'level': (a.level + phi * a.slope) + alpha * (x.y - ((a.level + phi * a.slope) + a.seas[x.ph])),
      'slope': phi * a.slope + beta * (x.y - ((a.level + phi * a.slope) + a.seas[x.ph])),
      'seas': case when p.season = 'N' then a.seas else list_transform(a.seas, lambda s, k:
        case when k = x.ph then s + gamma * (x.y - ((a.level + phi * a.slope) + s)) else s end) end,
      'sse': a.sse + (x.y - ((a.level + phi * a.slope) + a.seas[x.ph])) * (x.y - ((a.level + phi * a.slope) + a.seas[x.ph])),
      'rel': a.rel + case when (a.level + phi * a.slope) + a.seas[x.ph] > 0
        then pow((x.y - ((a.level + phi * a.slope) + a.seas[x.ph])) / ((a.level + phi * a.slope) + a.seas[x.ph]), 2) else 0 end,
      'logs': a.logs + case when (a.level + phi * a.slope) + a.seas[x.ph] > 0 then ln((a.level + phi * a.slope) + a.seas[x.ph]) else 0 end,
      'bad': a.bad or (a.level + phi * a.slope) + a.seas[x.ph] <= 0}},
    {{'y': 0.0::double, 'ph': 1::bigint, 'level': case when p.trend = 'N' then mean else mean - rise * middle end,
      'slope': case when p.trend = 'N' then 0.0::double else rise end, 'seas': seas,
      'sse': 0.0::double, 'rel': 0.0::double, 'logs': 0.0::double, 'bad': false}}) as e
  from {name}_b b join {name}_p p on b.season = p.season),
{name}_j as (
  select *, row_number() over (partition by {by}id order by aicc, ord, number) as place from (
    select r.*, f.form, f.ord,
           n * ln(greatest(case when f.error = 'A' then e.sse else e.rel end, 1e-12::double))
           + case when f.error = 'A' then 0 else 2 * e.logs end + (2.0 * k + 2.0 * k * (k + 1) / (n - k - 1)) as aicc
    from {name}_r r join {name}_f f on r.trend = f.trend and r.season = f.season
    where n > k + 1 and (f.error = 'A' or (not e.bad and lo > 0)))),
{name} as (
  select {by}id, form as route, {date} as date,
         greatest(0.0, e.level + list_sum(list_transform(range(1, h + 1), lambda i: pow(phi, i))) * e.slope
                       + e.seas[(n + h - 1) % len(e.seas) + 1]) as prediction
  from {name}_j join (select {by}max(date) as last from {source} group by all) l {'using (fold_id)' if by else 'on true'},
       range(1, {horizon + 1}) t(h) where place = 1)"""


def _refined(name: str, source: str, m: int, horizon: int, date: str, turns: int) -> str:
    """``_smooth`` of ANN and AAN with finer rows tried around the best one, a number of times."""

    def near(v: str, grid: tuple[float, ...], share: float) -> str:
        known = "[" + ", ".join(f"{x}::double" for x in grid) + "]"
        below = f"coalesce(list_max(list_filter({known}, lambda x: x < {v})), {v} / 2)"
        above = f"coalesce(list_min(list_filter({known}, lambda x: x > {v})), ({v} + 1) / 2)"
        return f"[{v} - ({v} - {below}) * {share}::double, {v}, {v} + ({above} - {v}) * {share}::double]"

    parts = [_smooth(name, source, "", ("ANN", "AAN"), m, horizon, date)]
    parts.append(f"{name}_b0 as (select id, n, form, k, number, alpha, beta, e.level as level, e.slope as slope, aicc "
                 f"from {name}_j join {name}_f using (form) where place = 1)")  # fmt: skip
    for t in range(1, turns + 1):
        share = 0.5**t
        parts.append(f"""{name}_x{t} as (
  select * from (
    select id, form, k, {1000 * t} + ia * 3 + ib as number, {near("alpha", ALPHAS, share)}[ia] as alpha,
           case when form = 'ANN' then beta else {near("beta", BETAS, share)}[ib] end as beta
    from {name}_b{t - 1}, range(1, 4) a(ia), range(1, 4) b(ib) where form = 'AAN' or ib = 1)
  where form = 'ANN' or beta < alpha),
{name}_e{t} as (
  select id, n, form, k, number, alpha, beta, list_reduce(
    list_transform(ys, lambda y: {{'y': y, 'level': 0.0::double, 'slope': 0.0::double, 'sse': 0.0::double}}),
    lambda a, x: {{'y': 0.0::double, 'level': (a.level + a.slope) + alpha * (x.y - (a.level + a.slope)),
      'slope': a.slope + beta * (x.y - (a.level + a.slope)),
      'sse': a.sse + (x.y - (a.level + a.slope)) * (x.y - (a.level + a.slope))}},
    {{'y': 0.0::double, 'level': case when form = 'ANN' then mean else mean - rise * middle end,
      'slope': case when form = 'ANN' then 0.0::double else rise end, 'sse': 0.0::double}}) as e
  from {name}_x{t} join {name}_b using (id)),
{name}_b{t} as (
  select * exclude (place) from (
    select *, row_number() over (partition by id order by aicc, number) as place from (
      select * from {name}_b{t - 1} union all
      select id, n, form, k, number, alpha, beta, e.level, e.slope,
             n * ln(greatest(e.sse, 1e-12::double)) + (2.0 * k + 2.0 * k * (k + 1) / (n - k - 1)) from {name}_e{t}))
  where place = 1)""")
    parts.append(f"""{name}_out as (
  select id, form as route, {date} as date, greatest(0.0, level + h * slope) as prediction
  from {name}_b{turns}, (select max(date) as last from {source}) l, range(1, {horizon + 1}) t(h))""")
    return ",\n".join(parts)


def _lift(rows: str, group: str, cond: str) -> str:
    return f"""select {group}, round(f, 6) as false_avg, round(t, 6) as true_avg,
       round((t / nullif(f, 0) - 1) * 100, 6) as lift_pct
from (select {group}, avg(case when not ({cond}) then sales end) as f, avg(case when {cond} then sales end) as t
      from {rows} group by {group})"""


_PROMO_DAILY = (
    "(select d.*, wm_yr_wk, coalesce(on_promo, false) as on_promo, coalesce(price_relative_to_ref, 1.0) as rel "
    "from daily d left join calendar c using (d) left join promo p using (item_id, store_id, wm_yr_wk))"
)
_SNAP_DAY = "case state_id when 'CA' then snap_CA = 1 when 'TX' then snap_TX = 1 when 'WI' then snap_WI = 1 else false end"
_DAYCAL = "daily join (select d, wday, weekday, wm_yr_wk, event_name_1, event_type_1, snap_CA, snap_TX, snap_WI from calendar) c using (d)"
ZEROS = "zeros as (select id, avg(cast(sales = 0 as int)) as zero_share from daily group by id)"
_IDS = "id, item_id, dept_id, cat_id, store_id, state_id"
DAILY = (*_IDS.split(", "), "d", "date", "sales")
_DAYNO = "cast(substr(d, 3) as bigint)"
_LABEL = (
    "case when zero_share < 0.1 then 'high_volume' when zero_share < 0.5 then 'medium' "
    "when zero_share < 0.8 then 'intermittent' else 'extreme_intermittent' end"
)
SERIES_LABEL = f"labels as (select id, zero_share, {_LABEL} as intermittence_label from (select id, avg(cast(sales = 0 as int)) as zero_share from fresh group by id))"


def _metric(name: str) -> str:
    return _sql(f"select model_name, {_m(name)} from joined group by model_name", PREDS, JOINED)


def _both(weekly: str, monthly: str) -> str:
    return _sql(
        "select id, date, round(prediction, 6) as prediction from w union all select id, date, round(prediction, 6) from m",
        DRY,
        f"w as ({weekly})",
        f"m as ({monthly})",
    )


def _rollup(keys: str, ident: str) -> str:
    return f"select {ident} as id, {keys}, date, cast(sum(sales) as bigint) as sales from daily group by {keys}, date"


def _event_days(order: str) -> str:
    return _sql(
        f"""select c.d, c.date, c.event_name_1, c.event_type_1, total_sales
from calendar c left join (select date, cast(sum(sales) as bigint) as total_sales from daily group by date) t using (date)
where c.event_name_1 is not null order by total_sales {order}, c.date limit 15"""
    )


def statements() -> dict[str, str]:
    q: dict[str, str] = {}
    # sources and reshape
    q["src_calendar"] = _sql("select * from calendar")
    q["src_prices"] = _sql("select * from prices")
    q["src_sales_wide"] = _sql(
        f"select {_IDS}, count(*) as n_days, md5(string_agg(cast(sales as varchar), ',' order by date)) as days_md5 "
        f"from daily group by {_IDS}"
    )
    q["feature_store_latest"] = _sql(
        "select * from matrix where date = (select max(date) from fresh)", MATRIX
    )
    q["melt_sales"] = _sql(
        _digest("daily", *_IDS.split(", "), "d", "sales", part=f"cast(floor({_DAYNO} / 32.0) as bigint)")
    )
    q["melt_sales_dated"] = _sql(_digest("daily", *DAILY))
    q["drop_pre_launch"] = _sql(_digest("launched", *DAILY), LAUNCHED)
    q["subset_stores"] = _sql(
        _digest("daily", *DAILY, where="where store_id in ('NATION_1', 'NATION_2')")
    )
    q["sample_series"] = _sql(
        "select id, date, sales from fresh where id in (select id from (select distinct id from fresh) "
        "order by md5('42:' || id), id limit 20)"
    )
    q["id_hierarchy_item_store"] = _sql(
        "select distinct item_id || '__' || store_id as id, item_id, dept_id, cat_id, store_id, state_id from daily"
    )
    q["id_hierarchy_item_state"] = _sql(
        "select distinct item_id || '__' || state_id as id, item_id, dept_id, cat_id, state_id from daily"
    )
    q["features_for_ids"] = _sql(
        f"select * from (select id, date, sales, {_LAGS}, {_ROLLS}, {_TIME} from fresh {_WS}) "
        "where date = (select max(date) from fresh) and id in (select item_id || '__' || store_id from keys where state_id = 'CA')"
    )
    q["history_last_2y"] = _sql(
        "select id, date, sales from fresh where date >= (select max(date) from fresh) - 730"
    )
    # joins and sets
    q["join_calendar_left"] = _sql(_digest(_DAYCAL, *DAILY, "wday", "wm_yr_wk"))
    q["eval_inner_join"] = _sql(
        "select model_name, fold_id, id, date, sales, round(prediction, 6) as prediction from joined", PREDS, JOINED
    )
    q["ids_missing_anti"] = _sql(
        "select distinct item_id || '__' || store_id as id from keys where item_id || '__' || store_id not in (select id from fresh)"
    )
    q["ids_routed_intersect"] = _sql(
        "select item_id || '__' || store_id as id from keys where state_id <> 'CA' intersect "
        f"select id from launched_track group by id having count(sales) >= {COVERAGE_MINIMUM}",
        LAUNCHED,
        LAUNCHED_TRACK,
    )
    # rollups
    for name, trunc in (("agg_weekly", WEEK), ("agg_monthly", MONTH)):
        q[name] = _sql(
            f"select item_id, store_id, {trunc} as date, cast(sum(sales) as bigint) as sales from daily group by item_id, store_id, {trunc}"
        )
    q["agg_sku_store"] = _sql(
        _digest("lv", "id", "item_id", "store_id", "date", "sales"),
        f"lv as ({_rollup('item_id, store_id', chr(39).join(['item_id || ', '__', ' || store_id']))})",
    )
    q["agg_sku_state"] = _sql(
        _digest("lv", "id", "item_id", "state_id", "date", "sales"),
        "lv as (" + _rollup("item_id, state_id", "item_id || '__' || state_id") + ")",
    )
    q["agg_sku_national"] = _sql(
        "select item_id as id, item_id, date, cast(sum(sales) as bigint) as sales from daily group by item_id, date"
    )
    q["agg_dept_state"] = _sql(_rollup("dept_id, state_id", "dept_id || '__' || state_id"))
    q["track_fresh_weekly"] = _sql("select id, date, sales from fresh")
    q["track_fresh_weekly_fine"] = _sql("select id, date, sales from fresh", base=FINE)
    q["track_fresh_weekly_part"] = _sql("select id, date, sales from fresh", base=PART)
    q["track_dry_monthly"] = _sql("select * from dry", DRY)
    q["track_non_food_monthly"] = _sql(
        f"select item_id || '__' || state_id as id, {MONTH} as date, cast(sum(sales) as bigint) as sales "
        f"from daily where dept_id in ('HOBBIES_1', 'HOBBIES_2') group by item_id, state_id, {MONTH}"
    )
    # stockouts, segments, lifts
    q["stockout_by_series"] = _sql(
        """select id, n_suspicious, n_zeros, round(avg_sales, 6) as avg_sales,
       round(coalesce(n_suspicious / nullif(cast(n_zeros as double), 0), 0.0), 6) as suspicious_share
from (select id, count(*) filter (suspicious_zero) as n_suspicious, count(*) filter (sales = 0) as n_zeros,
             avg(sales) as avg_sales from flagged group by id)""",
        FLAG15,
    )
    q["stockout_by_category"] = _sql(
        """select cat_id, n_suspicious, n_zeros, n_obs,
       round(n_suspicious / nullif(cast(n_zeros as double), 0) * 100, 6) as pct_suspicious_among_zeros,
       round(n_suspicious / nullif(cast(n_obs as double), 0) * 100, 6) as pct_suspicious_among_all
from (select cat_id, count(*) filter (suspicious_zero) as n_suspicious, count(*) filter (sales = 0) as n_zeros,
             count(sales) as n_obs from flagged group by cat_id)""",
        FLAG15,
    )
    q["intermittence_labels"] = _sql(
        "select id, date, sales, round(zero_share, 6) as zero_share, intermittence_label from fresh join labels using (id)",
        SERIES_LABEL,
    )
    q["lift_event"] = _sql(_lift(_DAYCAL, "store_id", "event_name_1 is not null"))
    q["lift_promo"] = _sql(_lift(_PROMO_DAILY, "store_id", "on_promo"))
    q["lift_snap"] = _sql(_lift(_DAYCAL, "state_id", _SNAP_DAY))
    # metrics
    for name in _METRICS:
        q[f"metric_{name}"] = _metric(name)
    q["metrics_by_fold"] = _sql(FOLD_OUT + " where model_name = 'DriftNaive'", PREDS, JOINED, BY_FOLD)
    q["eval_naive"] = _sql(FOLD_OUT + " where model_name = 'HistoricalMean'", PREDS, JOINED, BY_FOLD)
    q["eval_all_naive"] = _sql(FOLD_OUT, PREDS, JOINED, BY_FOLD)
    q["eval_all_naive_fine"] = _sql(FOLD_OUT, PREDS, JOINED, BY_FOLD, base=FINE)
    q["eval_all_naive_part"] = _sql(FOLD_OUT, PREDS, JOINED, BY_FOLD, base=PART)
    q["metrics_by_segment"] = _sql(
        f"select model_name, fold_id, intermittence_label, {ALL_METRICS}, count(*) as n_obs "
        "from joined join labels using (id) group by model_name, fold_id, intermittence_label",
        PREDS,
        JOINED,
        SERIES_LABEL,
    )
    q["summary_by_model"] = _sql(
        """select model_name, round(avg(wmape), 6) as wmape_mean, round(stddev_samp(wmape), 6) as wmape_std,
       round(avg(bias), 6) as bias_mean, round(avg(rmse), 6) as rmse_mean, round(avg(mae), 6) as mae_mean,
       cast(sum(n_obs) as bigint) as n_obs_total from by_fold group by model_name""",
        PREDS,
        JOINED,
        BY_FOLD,
    )
    q["pivot_wmape_by_fold"] = _sql(
        "select fold_id, "
        + ", ".join(f"round(avg(case when model_name = '{m}' then wmape end), 6) as \"{m}\"" for m in NAIVE_MODELS)
        + " from by_fold group by fold_id",
        PREDS,
        JOINED,
        BY_FOLD,
    )
    lines = ["Historical sales", *[f"Forecast ({m})" for m in NAIVE_MODELS]]
    q["pivot_forecast_vs_history"] = _sql(
        "select id, date, "
        + ", ".join(f"round(min(case when series = '{s}' then value end), 6) as \"{s}\"" for s in lines)
        + """ from (select id, date, 'Historical sales' as series, cast(sales as double) as value from fresh
              where date >= (select max(date) from fresh) - 730
              union all select id, date, 'Forecast (' || model_name || ')', prediction from preds) group by id, date""",
        FULL_PREDS,
    )
    q["series_stats"] = _sql(
        "select id, count(*) as n_periods, round(avg(sales), 6) as mean_sales, max(sales) as max_sales, "
        "round(avg(cast(sales = 0 as int)), 6) as zero_share from fresh group by id"
    )
    q["hierarchy_cardinality"] = _sql(
        "select count(distinct state_id) as n_state_id, count(distinct store_id) as n_store_id, "
        "count(distinct cat_id) as n_cat_id, count(distinct dept_id) as n_dept_id, count(distinct item_id) as n_item_id, "
        "count(distinct id) as n_id, count(distinct d) as n_d from daily"
    )
    q["event_type_counts"] = _sql(
        "select event_type_1, count(*) as count from calendar where event_type_1 is not null group by event_type_1"
    )
    for name, least in (("ets_coverage", COVERAGE_MINIMUM), ("ets_coverage_default", 104)):
        q[name] = _sql(
            f"""select count(*) as n_total, count(*) filter (n >= {least}) as n_ets,
       count(*) filter (n < {least}) as n_fallback,
       round(count(*) filter (n >= {least}) / cast(count(*) as double), 6) as ets_share
from (select id, count(sales) as n from launched_track group by id)""",
            LAUNCHED,
            LAUNCHED_TRACK,
        )
    # exploration
    q["eda_daily_total"] = _sql("select date, cast(sum(sales) as bigint) as total_sales from daily group by date")
    dow = f"dow as (select weekday, wday, avg(sales) as avg_sales from {_DAYCAL} group by all)"
    q["eda_dow_avg"] = _sql("select weekday, wday, round(avg_sales, 6) as avg_sales from dow", dow)
    q["eda_dow_amplitude"] = _sql(
        "select round(max(avg_sales) / min(avg_sales), 6) as amplitude, arg_max(weekday, avg_sales) as peak, "
        "arg_min(weekday, avg_sales) as trough from dow",
        dow,
    )
    q["eda_month_avg"] = _sql(
        "select cast(month(date) as int) as month, round(avg(sales), 6) as avg_sales from daily group by 1"
    )
    monthcat = "mc as (select cat_id, cast(month(date) as int) as month, avg(sales) as avg_sales from daily group by all)"
    q["eda_month_cat"] = _sql("select cat_id, month, round(avg_sales, 6) as avg_sales from mc", monthcat)
    q["eda_month_amplitude"] = _sql(
        "select cat_id, round(max(avg_sales), 6) as max, round(min(avg_sales), 6) as min, "
        "round(max(avg_sales) / nullif(min(avg_sales), 0), 6) as amplitude_ratio from mc group by cat_id",
        monthcat,
    )
    q["eda_christmas_totals"] = _sql(
        "select date, cast(sum(sales) as bigint) as total_sales from daily where month(date) = 12 and day(date) = 25 group by date"
    )
    q["eda_event_day_share"] = _sql(
        "select count(event_name_1) as event_days, count(*) as days, "
        "round(count(event_name_1) / cast(count(*) as double) * 100, 6) as pct from calendar"
    )
    q["eda_event_lift"] = _sql(_lift(_DAYCAL, "cat_id", "event_type_1 is not null"))
    q["eda_snap_lift"] = _sql(_lift(f"(select * from {_DAYCAL} where state_id = 'CA')", "cat_id", "snap_CA = 1"))
    q["eda_event_type_lift"] = _sql(
        """select a.cat_id, a.event_type_1, round(a.avg_sales, 6) as avg_sales, round(b.avg_sales, 6) as baseline,
       round((a.avg_sales - b.avg_sales) / nullif(b.avg_sales, 0) * 100, 6) as lift_pct
from m a left join (select * from m where event_type_1 is null) b on a.cat_id = b.cat_id
where a.event_type_1 is not null""",
        f"m as (select cat_id, event_type_1, avg(sales) as avg_sales from {_DAYCAL} group by all)",
    )
    q["eda_event_days_bottom"] = _event_days("asc")
    q["eda_event_days_top"] = _event_days("desc")
    q["eda_zero_share_counts"] = _sql(
        "select count(*) filter (zero_share > 0.5) as over_half, count(*) filter (zero_share > 0.8) as over_80, "
        "count(*) filter (zero_share < 0.1) as under_10, count(*) as n_series from zeros",
        ZEROS,
    )
    q["eda_zero_share_hist"] = _sql(
        "select cast(least(floor(zero_share * 50), 49) as int) as bin, count(*) as n_series from zeros group by 1", ZEROS
    )
    q["eda_suspicious_share"] = _sql(
        """select n_zeros, n_suspicious, round(n_suspicious / nullif(cast(n_zeros as double), 0) * 100, 6) as pct
from (select count(*) filter (sales = 0) as n_zeros, count(*) filter (suspicious_zero) as n_suspicious from flagged)""",
        FLAG15,
    )
    q["eda_stockout_top10"] = _sql(
        """select id, n_suspicious, n_zeros, round(avg_sales, 6) as avg_sales,
       round(coalesce(n_suspicious / nullif(cast(n_zeros as double), 0), 0.0), 6) as suspicious_share
from (select id, count(*) filter (suspicious_zero) as n_suspicious, count(*) filter (sales = 0) as n_zeros,
             avg(sales) as avg_sales from flagged group by id) where avg_sales > 0
order by n_suspicious desc, id limit 10""",
        FLAG15,
    )
    q["eda_promo_frequency"] = _sql(
        "select round(avg(cast(on_promo as int)) * 100, 6) as pct_on_promo, count(on_promo) as n_known from promo"
    )
    q["eda_promo_lift"] = _sql(_lift(_PROMO_DAILY, "cat_id", "on_promo"))
    first = "first_sale as (select id, min(date) as f from daily where sales > 0 group by id), start as (select min(date) as d0 from daily)"
    q["cold_start_share"] = _sql(
        """select n_series, n_cold_start, round(n_cold_start / nullif(cast(n_series as double), 0) * 100, 6) as pct
from (select count(*) as n_series, count(*) filter (f > d0) as n_cold_start from first_sale, start)""",
        first,
    )
    q["eda_cold_start_hist"] = _sql(
        "select cast(date_trunc('month', f) as date) as month, count(*) as n_series from first_sale, start where f > d0 group by 1",
        first,
    )
    # windows and features
    q["feat_lags"] = _sql(f"select id, date, sales, {_LAGS} from fresh {_WS}")
    q["feat_rolling_mean_std"] = _sql(f"select id, date, sales, {_ROLLS} from fresh")
    rolls = ", ".join(
        f"{e.format(f'(partition by id order by date rows between {w} preceding and 1 preceding)')} as sales_roll{w}_{n}"
        for w in (4, 13)
        for n, e in (
            ("min", "min(sales) over {}"),
            ("max", "max(sales) over {}"),
            ("median", "round(quantile_cont(sales, 0.5) over {}, 6)"),
        )
    )
    q["feat_rolling_min_max_median"] = _sql(f"select id, date, sales, {rolls} from fresh")
    q["feat_targets"] = _sql(
        "select id, date, sales, "
        + ", ".join(f"lead(sales, {h}) over s as target_h{h}" for h in range(1, 5))
        + f" from fresh {_WS}"
    )
    q["stockout_daily_flags"] = _sql(
        _digest("flagged", *DAILY, "suspicious_zero", "cast(round(rolling_mean * 360360, 0) as bigint)"),
        FLAG15,
    )
    q["stockout_weekly_flags"] = _sql("select id, date, sales, is_suspicious_zero from flagged", FLAG4)
    for name, value in (("mean", "recent"), ("median", "positive_median")):
        q[f"stockout_corrected_{name}"] = _sql(
            f"select id, date, round(case when is_suspicious_zero then coalesce({value}, sales) else sales end, 6)::double as sales from flagged",
            FLAG4,
        )
    q["stockout_stats"] = _sql(
        """select count(*) as n_total_rows, count(*) filter (is_suspicious_zero) as n_suspicious,
       round(count(*) filter (is_suspicious_zero) / cast(count(*) as double), 6) as share_suspicious,
       round(coalesce(avg(recent) filter (is_suspicious_zero), 'nan'::double), 6) as mean_imputed_value from flagged""",
        FLAG4,
    )
    q["promo_flags"] = _sql(
        "select store_id, item_id, wm_yr_wk, sell_price, ref_price, "
        "on_promo, round(price_relative_to_ref, 6) as price_relative_to_ref from promo"
    )
    q["feat_hier_lags"] = _sql(f"select id, date, sales, {_LEVEL_COLS} from fresh {_LEVEL_JOINS}", LEVELS)
    q["feat_time_basic"] = _sql(f"select id, date, sales, {_TIME} from fresh")
    q["feat_calendar_daily"] = _sql(
        _digest("daily", *DAILY, "isodow(date)", "month(date)", "year(date)", "day(date)", "cast(isodow(date) >= 6 as int)")
    )
    q["feat_snap_day"] = _sql(_digest(_DAYCAL, *DAILY, f"cast({_SNAP_DAY} as int)"))
    q["feat_event_day"] = _sql(
        _digest(_DAYCAL, *DAILY, "event_name_1", "event_type_1")
    )
    q["feat_snap_week"] = _sql(f"select id, date, sales, {_SNAPW} from fresh left join weeks using (date)", WEEKS)
    q["feat_event_week"] = _sql(f"select id, date, sales, {_EVENTS} from fresh left join weeks using (date)", WEEKS)
    q["feat_promo_daily"] = _sql(
        _digest(_PROMO_DAILY, *DAILY, "wm_yr_wk", "cast(on_promo as int)", "cast(round(rel * 1000000, 0) as bigint)")
    )
    q["feat_promo_week_store"] = _sql(
        f"select id, date, sales, {_PROMO_OUT} from fresh left join weeks using (date) left join promo using (item_id, store_id, wm_yr_wk)",
        WEEKS,
    )
    q["feat_promo_week_state"] = _sql(
        f"select id, date, sales, {_PROMO_OUT} from st left join weeks using (date) left join sp using (item_id, state_id, wm_yr_wk)",
        WEEKS,
        f"st as (select item_id || '__' || state_id as id, item_id, state_id, {WEEK} as date, cast(sum(sales) as bigint) as sales from daily group by item_id, state_id, {WEEK})",
        STATE_PROMO,
    )
    q["feature_matrix"] = _sql("select * from matrix", MATRIX)
    q["feature_matrix_fine"] = _sql("select * from matrix", MATRIX, base=FINE)
    q["feature_matrix_part"] = _sql("select * from matrix", MATRIX, base=PART)
    dry_levels = ("dept_id", "cat_id", "state_id")
    dry_cols = ", ".join(f"{x}_avg_sales_lag_1" for x in dry_levels)
    q["feature_matrix_dry_monthly"] = _sql(
        f"""select id, date, sales, {', '.join(f'sales_lag_{k}' for k in FEATURE_LAGS)},
         {', '.join(f'sales_roll{w}_{s}' for w in FEATURE_WINDOWS for s in ('mean', 'std'))},
         month, week_of_year, year, day_of_year, {_SNAPW}, {_EVENTS}, {dry_cols}, {_PROMO_OUT}
  from basic left join weeks using (date) {' '.join(f'left join lv_{x} using ({x}, date)' for x in dry_levels)}
       left join sp using (item_id, state_id, wm_yr_wk)""",
        WEEKS,
        f"""dryf as materialized (
  select item_id || '__' || state_id as id, {MONTH} as date, cast(sum(sales) as bigint) as sales, item_id, dept_id, cat_id, state_id
  from daily where dept_id in ('FOODS_1', 'FOODS_2', 'HOUSEHOLD_1', 'HOUSEHOLD_2') group by item_id, state_id, dept_id, cat_id, {MONTH})""",
        *[_level(x).replace("from fresh", "from dryf") for x in dry_levels],
        STATE_PROMO,
        f"basic as (select *, {_LAGS}, {_ROLLS}, {_TIME} from dryf {_WS})",
    )
    q["feature_matrix_basic"] = _sql(f"select id, date, sales, {_LAGS}, {_ROLLS}, {_TIME} from fresh {_WS}")
    now_rolls = _ROLLS
    for w in FEATURE_WINDOWS:
        now_rolls = now_rolls.replace(f"between {w} preceding and 1 preceding", f"between {w - 1} preceding and current row")
    q["feature_matrix_basic_current"] = _sql(
        f"select id, date, sales, sales as sales_lag_0, {_LAGS}, {now_rolls}, {_TIME} from fresh {_WS}"
    )
    # folds and forecasts
    q["folds"] = _sql("select * from folds")
    q["folds_monthly"] = _sql("select * from mfolds", DRY, MONTH_FOLDS)
    q["eval_naive_monthly"] = _sql(
        FOLD_OUT.replace("folds using", "mfolds using"),
        DRY,
        MONTH_FOLDS,
        "mtrain as (select fold_id, id, date, sales from dry join mfolds on date <= train_end)",
        "preds as (" + " union all ".join([
            _hist_mean("mtrain", "fold_id, ", 3, M_DATE), _seasonal("mtrain", "fold_id, ", 3, M_DATE, M_BACK), _drift("mtrain", "fold_id, ", 3, M_DATE)
        ]) + ")",
        "joined as (select model_name, fold_id, id, date, sales, prediction from "
        "(select fold_id, id, date, sales from dry join mfolds on date between test_start and test_end) join preds using (fold_id, id, date))",
        BY_FOLD,
    )
    q["fold_assignment"] = _sql(
        "select id, date, sales, fold_id, 'train' as role from train union all select id, date, sales, fold_id, 'test' from test"
    )
    q["future_periods"] = _sql(
        f"select cast(h as int) as step, {W_DATE} as date, 'W' as frequency from (select max(date) as last from fresh), range(1, 5) t(h) "
        f"union all select cast(h as int), {M_DATE}, 'M' from (select max(date) as last from dry), range(1, 4) t(h)",
        DRY,
    )
    q["fc_hist_mean"] = _both(_hist_mean("fresh", "", 4, W_DATE), _hist_mean("dry", "", 3, M_DATE))
    q["fc_seasonal_naive"] = _both(
        _seasonal("fresh", "", 4, W_DATE, W_BACK), _seasonal("dry", "", 3, M_DATE, M_BACK)
    )
    q["fc_drift"] = _both(_drift("fresh", "", 4, W_DATE), _drift("dry", "", 3, M_DATE))
    out = "select id, route, date, round(prediction, 6) as prediction from "
    q["fc_ses"] = _sql(out + "ses", _smooth("ses", "fresh", "", ("ANN",), 52, 4, W_DATE))
    q["fc_ets_refined"] = _sql(out + "fine_out", _refined("fine", "fresh", 52, 4, W_DATE, 3))
    q["fc_ets"] = _sql(
        out + "sw union all " + out + "sm", DRY,
        _smooth("sw", "fresh", "", SMOOTHING_FORMS, 52, 4, W_DATE),
        _smooth("sm", "dry", "", TRACKS["dry_monthly"].forms, 12, 3, M_DATE),
    )
    q["eval_ets"] = _sql(
        FOLD_OUT,
        _smooth("se", "train", "fold_id, ", SMOOTHING_FORMS, 52, 4, W_DATE),
        "joined as (select 'ExponentialSmoothing' as model_name, fold_id, id, date, sales, prediction from test join se using (fold_id, id, date))",
        BY_FOLD,
    )
    q["gbt_train_rows"] = _sql(
        "select id, date, cast(step as int) as step, round(label, 6) as label from ("
        + " union all ".join(f"select id, date, {h} as step, lead(y, {h}) over (partition by id order by date) as label from corrected" for h in range(1, 5))
        + ") where label is not null",
        FLAG4,
        "corrected as (select id, date, cast(case when is_suspicious_zero then coalesce(recent, sales) else sales end as double) as y from flagged)",
    )
    q["gbt_prediction_rows"] = _sql(
        f"select id, {W_DATE} as date, true as usable from (select distinct id from fresh), (select max(date) as last from fresh), range(1, 5) t(h)"
    )
    # segments, ages, scaled errors
    q["segment_rotation"] = _sql(
        """select id, volume, r as rotation_rank,
       case when r - 1 < n * 0.2::double then 'fast' when r - 1 < n * 0.8::double then 'medium' else 'slow' end as rotation_tier
from (select id, volume, row_number() over (order by volume desc, id) as r, count(*) over () as n
      from (select id, cast(sum(sales) as bigint) as volume from fresh group by id))""",
        base=FINE,
    )
    tiers = """tiers as (
  select fold_id, id, case when r - 1 < n * 0.2::double then 'fast' when r - 1 < n * 0.8::double then 'medium' else 'slow' end as rotation_tier
  from (select fold_id, id, row_number() over (partition by fold_id order by volume desc, id) as r, count(*) over (partition by fold_id) as n
        from (select fold_id, id, sum(sales) as volume from train group by all)))"""
    by_segment = "select model_name, fold_id, {0}, " + ALL_METRICS + ", count(*) as n_obs from joined join {1} using (fold_id, id) group by all"
    q["metrics_by_rotation"] = _sql(by_segment.format("rotation_tier", "tiers"), PREDS, JOINED, tiers)
    stages = """ends as (select fold_id, max(date) as last from train group by fold_id),
placed as (
  select t.*, date_diff('day', date, last) // 7 as week, last from train t join ends using (fold_id)),
fitted as (
  select fold_id, id, last, min(date) filter (sales > 0) as first_sale, count(y) as n, sum(x) as sx, sum(y) as sy, sum(x * y) as sxy, sum(x * x) as sxx
  from (select *, case when week < 26 then 25 - week end as x, case when week < 26 then sales end as y from placed) group by fold_id, id, last),
sloped as (
  select fold_id, id, cast(date_diff('day', first_sale, last) // 7 as int) as age_weeks, sy, n,
         cast(n * sxy - sx * sy as double) / nullif(cast(n * sxx - sx * sx as double), 0) as slope from fitted),
stages as (
  select fold_id, id, age_weeks, slope, case when age_weeks is null then 'unsold' when age_weeks < 26 then 'new'
    when coalesce(-slope * 26 > 0.25::double * (cast(sy as double) / cast(n as double)), false) then 'declining' else 'mature' end as stage
  from sloped)"""
    q["segment_lifecycle"] = _sql("select fold_id, id, age_weeks, round(slope, 6) as slope, stage from stages", stages, base=FINE)
    q["metrics_by_stage"] = _sql(by_segment.format("stage", "stages"), PREDS, JOINED, stages)
    q["feat_product_age"] = _sql(
        """select id, date, sales, cast(case when date >= first_sale then date_diff('day', first_sale, date) // 7 end as int) as product_age_weeks
from fresh left join (select id, min(date) as first_sale from fresh where sales > 0 group by id) using (id)"""
    )
    q["feat_promo_duration"] = _sql(
        """select item_id, store_id, wm_yr_wk, case when on_ then dense_rank() over (partition by item_id, store_id, on_ order by start) end as promo_run,
       case when on_ then cast(week - start + 1 as int) else 0 end as promo_weeks, cast(week - last_on as int) as weeks_since_promo
from (
  select *, max(case when on_ and not goes_on then week end) over (partition by item_id, store_id order by week) as start,
         max(case when on_ then week end) over (partition by item_id, store_id order by week rows between unbounded preceding and 1 preceding) as last_on
  from (
    select *, coalesce(lag(on_) over w and lag(week) over w = week - 1, false) as goes_on
    from (select item_id, store_id, wm_yr_wk, coalesce(on_promo, false) as on_, week from promo join nweeks using (wm_yr_wk))
    window w as (partition by item_id, store_id order by week)))""",
        "nweeks as (select wm_yr_wk, row_number() over (order by wm_yr_wk) as week from (select distinct wm_yr_wk from calendar))",
    )
    q["metric_mase"] = _sql(
        """select model_name, fold_id, round(coalesce(avg(abs(sales - prediction) / scale) filter (scale > 0), 'nan'::double), 6) as mase,
       count(*) filter (coalesce(scale > 0, false)) as n_obs, count(*) filter (not coalesce(scale > 0, false)) as n_unscaled
from joined left join scales using (fold_id, id) group by model_name, fold_id""",
        PREDS,
        JOINED,
        """scales as (
  select fold_id, id, avg(cast(abs(change) as double)) as scale
  from (select fold_id, id, sales - lag(sales, 52) over (partition by fold_id, id order by date) as change from train) group by fold_id, id)""",
    )
    q["cardinality_sketch"] = _sql(
        """select state_id, count(distinct item_id) as n_item_id, count(distinct store_id) as n_store_id,
       true as item_id_within_error, true as store_id_within_error
from facts where date between date '1996-01-01' and date '1997-12-31' group by state_id""",
        base=FINE,
    )
    # reconciliation
    names = {"total": "'total'", "state_id": "state_id", "store_id": "store_id", "item_id": "item_id", "item_id__store_id": "item_id || '__' || store_id"}
    levels = lambda source, value: " union all ".join(
        f"select date, '{k}' as level, {v} as node, {value} as prediction from {source} group by all" for k, v in names.items()
    )
    places = "places as (select distinct id, item_id, store_id, state_id from fresh)"
    q["reconcile_bottom_up"] = _sql(
        "select date, level, node, cast(prediction as double) as prediction from ("
        + levels("bottom", "sum(cast(round(prediction, 6) as decimal(18, 6)))") + ")",
        FULL_PREDS, places, "bottom as (select * from preds join places using (id) where model_name = 'DriftNaive')",
    )
    q["reconcile_top_down"] = _sql(
        "select date, level, node, cast(prediction as bigint) as prediction from (" + levels("bottom", "sum(units)") + ")",
        "alls as (select 'total' as id, date, sum(sales) as sales from fresh group by date)",
        "preds as (" + _drift("alls", "", 4, W_DATE) + ")",
        "volumes as (select id, item_id, store_id, state_id, cast(sum(sales) as hugeint) as volume, sum(cast(sum(sales) as hugeint)) over () as total from fresh group by all)",
        """quotas as (
  select v.*, p.date, cast(round(p.prediction) as hugeint) as goal, cast(round(p.prediction) as hugeint) * volume // total as whole,
         cast(round(p.prediction) as hugeint) * volume % total as rest from volumes v, preds p)""",
        """bottom as (
  select *, whole + case when row_number() over (partition by date order by rest desc, id) <= goal - sum(whole) over (partition by date) then 1 else 0 end as units
  from quotas)""",
    )
    # scoring
    reason = (
        "case when horizon is null or horizon not between 1 and 12 then 'horizon out of bounds' "
        "when horizon > 4 then 'horizon beyond the trained steps' end"
    )
    q["score_rejects"] = _sql(
        f"select id, horizon, model_name, reason, 'rejected' as status from (select *, {reason} as reason from requests) where reason is not null",
        REQUESTS,
    )
    scored = (
        f"""select id, horizon, r.model_name, case when any_value(p.prediction) is null then 'unknown series' else 'ok' end as status,
       cast(count(p.prediction) filter (step <= horizon) as int) as n_points,
       coalesce(string_agg(cast(p.date as varchar) || '=' || cast(cast(round(p.prediction, 6) as decimal(18, 6)) as varchar), ';' order by p.date)
                filter (step <= horizon), '') as points
from (select * from requests where {reason} is null) r
     left join (select *, row_number() over (partition by id order by date) as step from preds where model_name = 'DriftNaive') p using (id)
group by id, horizon, r.model_name"""
    )
    q["model_info"] = _sql(
        "select name as model_name, 'fresh_weekly' as track_name, (select max(date) from fresh) as train_end, "
        "cast(0 as int) as feature_count, cast(4 as int) as horizon, 'W' as frequency from (values ('drift'), ('mean')) t(name)"
    )
    q["score_models"] = _sql(
        """select id, horizon, r.model_name, reason,
       case when reason is not null then 'rejected' when any_value(p.prediction) is null then 'unknown series' else 'ok' end as status,
       case when reason is null then (select max(date) from fresh) end as train_end,
       cast(count(p.prediction) filter (step <= horizon and reason is null) as int) as n_points,
       coalesce(string_agg(cast(p.date as varchar) || '=' || cast(cast(round(p.prediction, 6) as decimal(18, 6)) as varchar), ';' order by p.date)
                filter (step <= horizon and reason is null), '') as points
from (select id, horizon, m.model_name, case when m.model_name = 'absent' then 'unknown model'
        when horizon is null or horizon not between 1 and 12 then 'horizon out of bounds'
        when horizon > 4 then 'horizon beyond the trained steps' end as reason
      from requests, (values ('drift'), ('mean'), ('absent')) m(model_name)) r
     left join (select case model_name when 'DriftNaive' then 'drift' else 'mean' end as model_name, id, date, prediction,
                       row_number() over (partition by model_name, id order by date) as step
                from preds where model_name in ('DriftNaive', 'HistoricalMean')) p using (model_name, id)
group by id, horizon, r.model_name, reason""",
        REQUESTS,
        FULL_PREDS,
    )
    q["score_batch"] = _sql(scored, REQUESTS, FULL_PREDS)
    q["score_batch_part"] = _sql(scored, REQUESTS, FULL_PREDS, base=PART)
    return q
