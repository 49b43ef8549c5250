"""DuckDB statements that answer the registered queries independently.

They work row by row where the engine aggregates (every order line meets every cap, every residual every
grid point) and solve regressions with the sweep operator on the cross-product matrix, written as a recursive
query.
"""

from __future__ import annotations

from gramwise.plans.catalog import (
    ELASTICITY, FOLDS, LASSO_ALPHA, MARGIN_AT_ZERO, MARGIN_SLOPE, ONE_YEAR, PANEL_FOLDS, PANEL_YEARS,
)
from gramwise.plans.cross_section import FULL, LABEL, REDUCED, SUMMARY
from gramwise.plans.panel import REGRESSORS


def r(expression: str, digits: int = 6) -> str:
    """Rounded, and zero without a sign."""
    return f"(round({expression}, {digits}) + 0.0::double)"


def rounded(columns: dict[str, int | None]) -> str:
    """Select list: each column rounded, or as it is for None."""
    return ", ".join(f'"{c}"' if k is None else f'{r(chr(34) + c + chr(34), k)} as "{c}"' for c, k in columns.items())


KEY_HASH = "cast('0x' || substr(md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber)), 1, 8) as bigint)"
PART = f"case when {KEY_HASH} % 100 < 20 then -1 else cast(({KEY_HASH} // 100) % {FOLDS} as integer) end"
PROFIT = "(l_extendedprice * (0.5::double - l_discount) - 10.0::double * l_quantity)"
QUARTER = "'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate)"

SALES = f"""
lines as (
  select row_number() over () as id, l_orderkey, l_partkey, l_suppkey, l_linenumber,
         l_extendedprice as sales, l_discount as discount, {PROFIT} as profit,
         {PROFIT} / nullif(l_extendedprice, 0) as margin, l_quantity as quantity, l_tax as tax,
         o_orderdate as order_date, p_type as sub_category, c_mktsegment as segment, r_name as region,
         l_returnflag as ship_mode, {QUARTER} as quarter, {PART} as part
  from lineitem
  join orders on l_orderkey = o_orderkey
  join customer on o_custkey = c_custkey
  join nation on c_nationkey = n_nationkey
  join region on n_regionkey = r_regionkey
  join part on l_partkey = p_partkey
)"""
CATEGORIES = ("sub_category", "segment", "region", "ship_mode", "quarter")
KEYS = "l_orderkey, l_partkey, l_suppkey, l_linenumber"

MACRO = """
macro as (
  select n_name as "Country", year, case when balance < 4200 then 0 when balance < 4500 then 1
         when balance < 4800 then 2 else 3 end as income_group_code,
         'C' || n_nationkey as country_code, r_name as region, 'U' || n_nationkey as currency_unit,
         year - 2000 as years_since_2000, year - 1900 as years_since_century, gdp_usd, inflation_rate,
         unemployment_rate, fdi_pct_gdp, healthcare_capacity_index, digital_connectivity_index,
         governance_quality_index
  from (
    select c_nationkey, cast(year(o_orderdate) as integer) as year, sum(o_totalprice) as gdp_usd,
           stddev_samp(o_totalprice) / nullif(avg(o_totalprice), 0) as inflation_rate,
           avg(case when o_orderstatus = 'O' then 1.0::double else 0.0::double end) as unemployment_rate,
           100.0::double * max(o_totalprice) / sum(o_totalprice) as fdi_pct_gdp,
           avg(c_acctbal) / 1000.0::double as healthcare_capacity_index,
           avg(month(o_orderdate)::double) as digital_connectivity_index,
           avg(case when o_orderpriority = '1-URGENT' then 1.0::double else 0.0::double end)
             as governance_quality_index,
           avg(c_acctbal) as balance
    from orders join customer on o_custkey = c_custkey
    group by 1, 2
  ) join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
),
scores as (
  select cast(year(l_shipdate) as integer) as "Year", n_name as "Country", ln(sum(l_extendedprice)) as score
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
  group by 1, 2
)"""
MACRO_COLUMNS = {
    "country_code": None, "region": None, "currency_unit": None, "years_since_2000": None, "years_since_century": None,
    "gdp_usd": 2, "inflation_rate": 6, "unemployment_rate": 6, "fdi_pct_gdp": 6, "healthcare_capacity_index": 6,
    "digital_connectivity_index": 6, "governance_quality_index": 6, "income_group_code": None,
}
PANEL = f"""{MACRO},
panel as (
  select m.year as "Year", m.* exclude (year), s.score
  from macro m join scores s on m.year = s."Year" and m."Country" = s."Country"
  where m.year between {PANEL_YEARS[0]} and {PANEL_YEARS[1]}
)"""

SECTION = f"""
section as (
  select unit, grants_patents, population_mil, randd_perc_gdp, gini_coeff, c_acctbal / 1000.0::double
           as gdp_real_growthrate, emissions_percapita, trade_pc_gdp, gdp_percapita,
         ln(grants_patents / population_mil) as {LABEL}, gdp_percapita / 1000.0::double as gdppc_thousands,
         trade_pc_gdp * (gdp_percapita / 1000.0::double) as interraction_gdppc_trade
  from (
    select o_custkey as unit, sum(l_quantity) as grants_patents, avg(l_discount) * 100.0::double as randd_perc_gdp,
           avg(l_tax) * 100.0::double as gini_coeff, avg(l_extendedprice) / 1e4::double as emissions_percapita,
           avg(p_size::double) as trade_pc_gdp
    from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey group by 1
  ) join (
    select o_custkey as unit, count(*)::double as population_mil, avg(o_totalprice) as gdp_percapita
    from orders group by 1
  ) using (unit) join customer on unit = c_custkey
)"""


def sweep(long: str, name: str = "fit", last: str = "__y") -> str:
    """Regression of ``last`` on all other terms of ``long(id, term, v)``, as common table expressions.

    ``{name}_m(i, j, v)`` is the swept matrix: v(term, last) is a coefficient, v(last, last) the residual sum
    of squares, and v(term, term) the diagonal of the inverse.  A term that depends on earlier ones is skipped;
    ``{name}_used`` lists those that were not.
    """
    return f"""
{name}_terms as (
  select term, row_number() over (order by case term when '_cons' then 0 when '{last}' then 2 else 1 end, term) as k
  from (select distinct term from {long})
),
{name}_gram as (
  select a.k as i, b.k as j, coalesce(s, 0.0::double) as v,
         max(case when a.k = b.k then coalesce(s, 0.0::double) end) over (partition by a.k) as scale
  from {name}_terms a cross join {name}_terms b left join (
    select x.term as t1, y.term as t2, sum(x.v * y.v) as s from {long} x join {long} y using (id) group by 1, 2
  ) g on g.t1 = a.term and g.t2 = b.term
),
{name}_steps as (
  select 0 as step, i, j, v, scale, false as skipped from {name}_gram
  union all
  select step + 1, i, j,
         case when d <= 1e-9 * scale_k then v
              when i = step + 1 and j = step + 1 then 1.0 / d
              when i = step + 1 then v / d
              when j = step + 1 then -v / d
              else v - aik * akj / d end,
         scale, case when i = step + 1 and d <= 1e-9 * scale_k then true else skipped end
  from (
    select *, max(case when i = step + 1 and j = step + 1 then v end) over () as d,
           max(case when i = step + 1 then scale end) over () as scale_k,
           max(case when j = step + 1 then v end) over (partition by i) as aik,
           max(case when i = step + 1 then v end) over (partition by j) as akj
    from {name}_steps where step < (select max(k) - 1 from {name}_terms)
  )
),
{name}_m as (
  select a.term as i, b.term as j, v, skipped from {name}_steps
  join {name}_terms a on a.k = i join {name}_terms b on b.k = j
  where step = (select max(k) - 1 from {name}_terms)
),
{name}_coef as (
  select i as term, v as estimate from {name}_m where j = '{last}' and i <> '{last}' and not skipped
),
{name}_rss as (select v as rss from {name}_m where i = '{last}' and j = '{last}')"""


def density_t(x: str, df: str = "df") -> str:
    return (
        f"exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0) - 0.5 * ln({df} * pi())"
        f" - ({df} + 1) / 2.0 * ln(1.0 + ({x}) * ({x}) / {df}))"
    )


def simpson(density: str, low: str, high: str, steps: int = 4000) -> str:
    """Integral of ``density``, a format string of the point ``x``, by Simpson's rule."""
    h = f"(({high}) - ({low})) / {steps}.0"
    weight = f"case when step_no in (0, {steps}) then 1.0 when step_no % 2 = 1 then 4.0 else 2.0 end"
    value = density.format(x=f"({low}) + step_no * {h}")
    return f"(list_sum(list_transform(range(0, {steps + 1}), lambda step_no: {weight} * {value})) * {h} / 3.0)"


def normal_tail(z: str) -> str:
    return simpson("exp(-0.5 * ({x}) * ({x})) / sqrt(2.0 * pi())", z, f"greatest({z}, 0.0) + 40.0", 8000)


def chi2_tail(value: str, df: str) -> str:
    """The density of the root of chi-squared has no pole at zero."""
    density = f"2.0 * exp(({df} - 1) * ln(greatest({{x}}, 1e-300)) - ({{x}}) * ({{x}}) / 2.0 - lgamma({df} / 2.0) - {df} / 2.0 * ln(2.0))"
    return simpson(density, f"sqrt({value})", f"sqrt({value}) + 40.0", 8000)


def f_tail(value: str, df1: str, df2: str) -> str:
    """The beta density in the angle whose squared sine is the ratio of the sums."""
    a, b = f"({df1}) / 2.0", f"({df2}) / 2.0"
    density = (
        f"2.0 * exp((2.0 * {a} - 1.0) * ln(greatest(sin({{x}}), 1e-300)) + (2.0 * {b} - 1.0) * ln(greatest(cos({{x}}), 1e-300))"
        f" + lgamma({a} + {b}) - lgamma({a}) - lgamma({b}))"
    )
    low = f"asin(sqrt(({df1}) * ({value}) / (({df1}) * ({value}) + ({df2}))))"
    return simpson(density, low, f"least(pi() / 2.0, {low} + 40.0 / sqrt({df2}))", 8000)


def t_table(name: str, n: str, digits: int, unit: str = "1.0::double") -> str:
    """Coefficient table with two-sided p-values by Simpson's rule on the t density, and 95% bounds by Newton's on that."""
    return f"""
{name}_inf as (
  select c.term, estimate, sqrt(m.v * rss / df) as se, estimate / sqrt(m.v * rss / df) as t, df
  from {name}_coef c join {name}_m m on m.i = c.term and m.j = c.term, {name}_rss,
       (select (({n}) - (select count(*) from {name}_coef))::double as df)
),
{name}_reach as (
  select 0 as step, 1.0::double as x, df from (select distinct df from {name}_inf)
  union all
  select step + 1, x + (0.475 - {simpson(density_t("{x}"), "0.0", "x", 2000)}) / {density_t("x")}, df
  from {name}_reach where step < 60
),
{name}_area as (
  select term, {simpson(density_t("{x}"), "0.0", "least(abs(t), 60.0)")} as area from {name}_inf
)
select i.term, {r(f'estimate * {unit}', digits)} as estimate, {r(f'se * {unit}', digits)} as se,
       {r('t', 4)} as t, {r('greatest(1.0::double - 2.0 * area, 0.0::double)', 5)} as p,
       {r(f'(estimate - x * se) * {unit}', digits)} as low, {r(f'(estimate + x * se) * {unit}', digits)} as high
from {name}_inf i join {name}_area a using (term), (select x from {name}_reach where step = 60)"""


def centred(name: str, source: str) -> str:
    """``{name}(fold, n, q, c, m, my, yy)``: means and mean centred products of ``source(fold, a, b, s)`` as lists in the order of terms."""
    return f"""
{name}_n as (select fold, s as n from {source} where a = '_cons' and b = '_cons'),
{name}_all as (select term, k from las_terms union all select '__y', p + 1 from las_p),
{name}_m as (
  select fold, term, k, coalesce(s, 0.0::double) / n as m
  from {name}_n cross join {name}_all left join (select fold, b as term, s from {source} where a = '_cons') using (fold, term)
),
{name}_q as (
  select x.fold, x.term as a, y.term as b, x.k as i, y.k as j, coalesce(s, 0.0::double) / n - x.m * y.m as q
  from {name}_m x join {name}_m y using (fold) join {name}_n using (fold)
  left join {source} g on g.fold = x.fold and g.a = x.term and g.b = y.term
)"""


def listed(name: str) -> str:
    return f"""
{name} as (
  select fold, n, q, c, m, my, yy
  from (
    select fold, list(r order by i) as q from (
      select fold, i, list(q / u.s / w.s order by j) as r
      from {name}_q x join las_scale u on u.term = a join las_scale w on w.term = b group by fold, i
    ) group by fold
  )
  join (select fold, list(q / s order by i) as c from {name}_q join las_scale on term = a where b = '__y' group by fold) using (fold)
  join (select fold, list(m / s order by k) as m from {name}_m join las_scale using (term) group by fold) using (fold)
  join (select fold, m as my from {name}_m where term = '__y') using (fold)
  join (select fold, q as yy from {name}_q where a = '__y' and b = '__y') using (fold)
  join {name}_n using (fold)
)"""


def lasso_sql(long: str, standardize: bool) -> str:
    """Cross-validated Lasso of ``long(id, part, term, v)`` by cyclic coordinate descent, all folds and penalties side by side.

    ``las_path(k, alpha, mse)``, ``las_best(k, alpha)``, ``las_coef(term, estimate, scaled)`` with ``_cons``, and
    ``las_proof(fold, k, alpha, n, objective, gap)``: how far each solution is from meeting the conditions of an optimum.
    """
    scale = "case when q > 0 then sqrt(q) else 1.0::double end" if standardize else "1.0::double"
    new = "c[e[1]::integer] - list_dot_product(q[e[1]::integer], acc) + q[e[1]::integer][e[1]::integer] * acc[e[1]::integer]"
    return f"""
las_terms as (
  select term, row_number() over (order by term) as k
  from (select distinct term from {long} where part >= 0) where term not in ('_cons', '__y')
),
las_p as (select count(*) as p from las_terms),
las_g as (
  select x.part as fold, x.term as a, y.term as b, sum(x.v * y.v) as s from {long} x join {long} y using (id)
  where x.part >= 0 group by all
),
las_t as (
  select f.fold, a, b, sum(s) as s
  from las_g g join (select distinct fold from las_g union all select -1) f on g.fold <> f.fold group by all
),
{centred('las_fit', 'las_t')},
las_scale as (select a as term, {scale} as s from las_fit_q where fold = -1 and a = b and a <> '__y'),
{listed('las_fit')},
{centred('las_held', 'las_g')},
{listed('las_held')},
las_grid as (
  select k, (select list_max(list_transform(c, lambda x: abs(x))) from las_fit where fold = -1) * power(10.0::double, -3.0::double * k / 99.0) as alpha
  from range(0, 100) as s(k)
),
las_cd as (
  select 0 as step, fold, k, alpha, list_transform(range(0, p), lambda x: 0.0::double) as w, 1.0::double as delta
  from las_fit, las_grid, las_p
  union all
  select step + 1, fold, k, alpha, new_w, list_max(list_transform(list_zip(w, new_w), lambda x: abs(x[1] - x[2])))
  from (
    select step, fold, k, alpha, w,
      list_reduce(list_concat([w], list_transform(range(1, len(w) + 1), lambda j: [j::double])), lambda acc, e:
        list_concat(acc[1 : e[1]::integer - 1],
          [case when q[e[1]::integer][e[1]::integer] > 0
            then sign({new}) * greatest(abs({new}) - alpha, 0.0::double) / q[e[1]::integer][e[1]::integer] else 0.0::double end],
          acc[e[1]::integer + 1 : len(acc)])) as new_w
    from las_cd join las_fit using (fold) where delta > 1e-13 and step < 3000
  )
),
las_w as (select fold, k, any_value(alpha) as alpha, arg_max(w, step) as w from las_cd group by fold, k),
las_error as (
  select x.fold, k, alpha, h.yy - 2.0 * list_dot_product(w, h.c)
    + list_dot_product(w, list_transform(h.q, lambda row: list_dot_product(row, w)))
    + power(h.my - f.my - list_dot_product(w, h.m) + list_dot_product(w, f.m), 2) as mse
  from las_w x join las_fit f using (fold) join las_held h using (fold)
),
las_path as (select k, any_value(alpha) as alpha, avg(mse) as mse from las_error group by k),
las_best as (select k, alpha from las_path order by mse, alpha desc limit 1),
las_coef as (
  select term, w[t.k] / s as estimate, w[t.k] as scaled
  from las_w x join las_best using (k), las_terms t join las_scale using (term) where fold = -1
  union all
  select '_cons', my - list_dot_product(w, m), null from las_w join las_best using (k) join las_fit using (fold) where fold = -1
),
las_slope as (
  select fold, k, alpha, n, w, yy, c, list_transform(q, lambda row: list_dot_product(row, w)) as qw
  from las_w join las_fit using (fold)
),
las_proof as (
  select fold, k, alpha, n, (yy - 2.0 * list_dot_product(w, c) + list_dot_product(w, qw)) / 2.0
      + alpha * list_sum(list_transform(w, lambda x: abs(x))) as objective,
    list_max(list_transform(list_zip(w, c, qw), lambda x:
      case when x[1] <> 0 then abs(x[2] - x[3] - alpha * sign(x[1])) else greatest(abs(x[2] - x[3]) - alpha, 0.0::double) end)) / alpha as gap
  from las_slope
)"""


def levels(source: str, where: str) -> str:
    """Dummy terms: every category but the first, among the rows of ``where``."""
    parts = " union all ".join(
        f"select '{c}' as variable, {c} as category from {source} where {where} group by {c}" for c in CATEGORIES
    )
    return f"""
levels as (
  select variable, category, variable || '_' || category as term
  from (select *, row_number() over (partition by variable order by category) as k from ({parts})) where k > 1
)"""


def dummies(source: str) -> str:
    return " union all ".join(
        f"select id, term, 1.0::double as v from {source} join levels on variable = '{c}' and category = {c}"
        for c in CATEGORIES
    )


def numbers(source: str, columns: dict[str, str], intercept: bool = True) -> str:
    parts = [f"select id, '{t}' as term, ({e})::double as v from {source}" for t, e in columns.items()]
    if intercept:
        parts.insert(0, f"select id, '_cons' as term, 1.0::double as v from {source}")
    return " union all ".join(parts)


MARGIN_FIT = f"""{SALES},
train as (select * from lines where part >= 0),
{levels('lines', 'part >= 0')},
long as ({numbers('train', {'discount': 'discount', '__y': 'margin'})} union all {dummies('train')}),
{sweep('long')}"""

ELASTICITY_FIT = f"""
e_levels as (select * from levels),
e_long as ({numbers('lines', {'log1p_discount': 'ln(1.0 + discount)', '__y': 'ln(sales)'})} union all {dummies('lines')}),
{sweep('e_long', 'efit')}"""

MARGIN_LASSO = f"""{SALES},
train as (select * from lines where part >= 0),
{levels('lines', 'part >= 0')},
long as (
  select id, part, term, v
  from ({numbers('train', {'discount': 'discount', '__y': 'margin'})} union all {dummies('train')}) join train using (id)
),
{lasso_sql('long', False)},
fit_coef as (select term, estimate from las_coef)"""

CAPS = "caps as (select k / 100.0::double as cap from range(0, 81) as s(k))"


def cap_rows(margin: str, elasticity: str, mode: str) -> str:
    one = "0.0::double" if mode == "level" else "1.0::double"
    return f"""
priced as (
  select cap, sales, discount, profit, case when discount > cap then cap else discount end as discount_new
  , m0, slope, {elasticity} as e
  from ({margin}) cross join caps
),
moved as (
  select cap, m0 + slope * discount_new as predicted_margin,
         case when discount > cap then sales * ({one} - e * (discount_new - discount)) else sales end as predicted_sales
  from priced
),
totals as (
  select cap as discount_cap, sum(predicted_margin * predicted_sales) as total_profit,
         sum(predicted_sales) as total_sales
  from moved group by cap
),
base as (select sum(profit) as bp, sum(sales) as bs from ({margin})),
result as (
  select discount_cap, total_profit, total_sales, total_profit - bp as "profit_change_$",
         100.0::double * (total_profit - bp) / bp as "profit_change_%",
         100.0::double * (total_sales - bs) / bs as "sales_change_%"
  from totals, base
)"""


CONSTANT_LINES = (
    f"select l_extendedprice as sales, l_discount as discount, {PROFIT} as profit,"
    f" {MARGIN_AT_ZERO}::double as m0, {MARGIN_SLOPE}::double as slope from lineitem"
)
SWEEP_COLUMNS = {
    "discount_cap": 6, "total_profit": 0, "total_sales": 2, "profit_change_$": 0, "profit_change_%": 6,
    "sales_change_%": 6,
}


def constant_sweep(mode: str) -> str:
    return f"with {CAPS}, {cap_rows(CONSTANT_LINES, f'({ELASTICITY}::double)', mode)}"


FITTED_LINES = """
  select sales, discount, profit, m0, (select estimate from fit_coef where term = 'discount') as slope
  from lines join (
    select id, sum(v * estimate) as m0
    from (select id, '_cons' as term, 1.0::double as v from lines union all {dummies}) join fit_coef using (term)
    group by id
  ) using (id)""".format(dummies=dummies("lines"))
def fitted_sweep(margin: str) -> str:
    return f"""
with recursive {margin},
{ELASTICITY_FIT},
{CAPS},
fitted_lines as ({FITTED_LINES}),
{cap_rows('select * from fitted_lines', "(select estimate from efit_coef where term = 'log1p_discount')", 'level')}"""


FITTED_SWEEP = fitted_sweep(MARGIN_FIT)
WHATIF = f"""
select {rounded({'discount_cap': 5, 'total_profit': -1, 'total_sales': -1, 'profit_change_$': -1,
                 'profit_change_%': 5, 'sales_change_%': 5})} from result"""
TEST_METRICS = f"""
test as (select * from lines where part < 0),
score as (
  select id, sum(v * estimate) as yhat
  from ({numbers('test', {'discount': 'discount'})} union all {dummies('test')}) join fit_coef using (term) group by id
)
select count(*) as n, {r('1.0 - sum((margin - yhat) * (margin - yhat)) / (var_pop(margin) * count(*))')} as r2,
       {r('avg(abs(margin - yhat))')} as mae, {r('avg((margin - yhat) * (margin - yhat))')} as mse"""
PANEL_HASH = """cast('0x' || substr(md5(concat_ws('|', "Country", "Year")), 1, 8) as bigint)"""
PANEL_FEATURES = (*REGRESSORS, "income_group_code")
PANEL_LASSO = f"""{PANEL},
rows as (
  select row_number() over () as id, *,
         case when {PANEL_HASH} % 100 < 20 then -1 else cast(({PANEL_HASH} // 100) % {PANEL_FOLDS} as integer) end as part
  from panel
),
long as (
  select id, part, term, v from ({numbers('rows', {c: c for c in PANEL_FEATURES} | {'__y': 'score'})}) join rows using (id)
),
{lasso_sql('long', True)},
guess as (
  select score as y, (select estimate from las_coef where term = '_cons')
         + {" + ".join(f"{c} * (select estimate from las_coef where term = '{c}')" for c in PANEL_FEATURES)} as yhat
  from rows where part < 0
)"""


def section_fit(names: tuple[str, ...]) -> str:
    columns = {c: c for c in names} | {"__y": LABEL}
    source = "(select unit as id, * from section)"
    return f"{SECTION}, long as ({numbers(source, columns)}), {sweep('long')}"


def section_vif(names: tuple[str, ...]) -> str:
    spread = " union all ".join(f"select '{c}' as term, var_pop({c}) * count(*) as ss from section" for c in names)
    return f"""{section_fit(names)},
spread as ({spread}),
vifs as (select term, m.v * ss as vif from spread join fit_m m on m.i = term and m.j = term)"""


FULL_ROWS = f"""{section_fit(FULL)},
predicted as (
  select id as unit, sum(v * estimate) as fitted from long join fit_coef using (term) group by id
),
res as (select unit, fitted, {LABEL} - fitted as residual from section join predicted using (unit))"""


# Wichura's normal quantile (AS 241) as an expression of p.  Fixed values.
def quantile(p: str) -> str:
    centre = (
        ("2509.0809287301226727", "33430.575583588128105", "67265.770927008700853", "45921.953931549871457",
         "13731.693765509461125", "1971.5909503065514427", "133.14166789178437745", "3.387132872796366608"),
        ("5226.495278852854561", "28729.085735721942674", "39307.89580009271061", "21213.794301586595867",
         "5394.1960214247511077", "687.1870074920579083", "42.313330701600911252", "1.0"),
    )
    middle = (
        ("7.7454501427834140764e-4", "0.0227238449892691845833", "0.24178072517745061177", "1.27045825245236838258",
         "3.64784832476320460504", "5.7694972214606914055", "4.6303378461565452959", "1.42343711074968357734"),
        ("1.05075007164441684324e-9", "5.475938084995344946e-4", "0.0151986665636164571966", "0.14810397642748007459",
         "0.68976733498510000455", "1.6763848301838038494", "2.05319162663775882187", "1.0"),
    )
    tail = (
        ("2.01033439929228813265e-7", "2.71155556874348757815e-5", "0.0012426609473880784386",
         "0.026532189526576123093", "0.29656057182850489123", "1.7848265399172913358", "5.4637849111641143699",
         "6.6579046435011037772"),
        ("2.04426310338993978564e-15", "1.4215117583164458887e-7", "1.8463183175100546818e-5",
         "7.868691311456132591e-4", "0.0148753612908506148525", "0.13692988092273580531", "0.59983220655588793769",
         "1.0"),
    )

    def horner(x: str, c: tuple[str, ...]) -> str:
        out = f"{c[0]}::double"
        for value in c[1:]:
            out = f"({out} * {x} + {value}::double)"
        return out

    q = f"({p} - 0.5::double)"
    rr = f"(0.180625::double - {q} * {q})"
    s = f"sqrt(-ln(least({p}, 1.0::double - {p})))"
    m, t = f"({s} - 1.6::double)", f"({s} - 5.0::double)"
    outer = (
        f"case when {s} <= 5 then {horner(m, middle[0])} / {horner(m, middle[1])}"
        f" else {horner(t, tail[0])} / {horner(t, tail[1])} end"
    )
    return (
        f"case when abs({q}) <= 0.425 then {q} * {horner(rr, centre[0])} / {horner(rr, centre[1])}"
        f" else sign({q}) * ({outer}) end"
    )


ORDERED = f"""
ordered as (
  select x, k, n, {quantile('((mean_rank - 0.375::double) / (n + 0.25::double))')} as m
  from (
    select *, avg(k) over (partition by x) as mean_rank
    from (select x, row_number() over (order by x) as k, count(*) over () as n from sample)
  )
)"""

AUXILIARY = [(a, b) for i, a in enumerate(FULL) for b in FULL[i:]]


def im_sql() -> str:
    z = ", ".join(f"({c} - avg({c}) over ()) / stddev_pop({c}) over () as {c}" for c in FULL)
    linear = {c: c for c in FULL}
    products = {f"{a} x {b}": f"{a} * {b}" for a, b in AUXILIARY}
    return f"""with recursive {FULL_ROWS},
zs as (
  select unit as id, {z}, residual / sqrt(avg(residual * residual) over ()) as u
  from section join res using (unit)
),
long2 as ({numbers('zs', linear | products | {'__y': 'u * u - 1.0'})}),
{sweep('long2', 'het')},
long3 as ({numbers('zs', linear | {'__y': 'u * u * u - 3.0 * u'})}),
{sweep('long3', 'skw')},
moments as (
  select count(*) as n, var_pop(u * u - 1.0) * count(*) as t2, sum((u * u * u - 3.0 * u) * (u * u * u - 3.0 * u)) as t3,
         avg(u * u * u * u - 6.0 * u * u + 3.0) as m4,
         avg((u * u * u * u - 6.0 * u * u + 3.0) * (u * u * u * u - 6.0 * u * u + 3.0)) as s4
  from zs
),
parts as (
  select 'heteroskedasticity' as source, n * (1.0 - rss / t2) as chi2,
         (select count(*) - 1 from het_coef)::integer as df from moments, het_rss
  union all
  select 'skewness', n * (1.0 - rss / t3), (select count(*) - 1 from skw_coef)::integer from moments, skw_rss
  union all
  select 'kurtosis', n * m4 * m4 / s4, 1::integer from moments
)
select source, {r('chi2', 4)} as chi2, df, {r(chi2_tail('chi2', 'df'), 5)} as p
from (select * from parts union all select 'total', sum(chi2), sum(df)::integer from parts)"""


def statistics(source: str, values: dict[str, str], digits: int) -> str:
    return " union all ".join(
        f"select '{name}' as statistic, {r(f'({e})::double', digits)} as value from {source}" for name, e in values.items()
    )


def section_table(names: tuple[str, ...]) -> str:
    return f"""
with recursive {section_fit(names)},
s as (
  select count(*)::double as n, {len(names)}::double as k, var_pop({LABEL}) * count(*) as tss, any_value(rss) as rss
  from section, fit_rss
)
{statistics('s', {
    'n': 'n', 'df_model': 'k', 'df_resid': 'n - k - 1', 'ss_model': 'tss - rss', 'ss_resid': 'rss', 'ss_total': 'tss',
    'ms_model': '(tss - rss) / k', 'ms_resid': 'rss / (n - k - 1)', 'f': '((tss - rss) / k) / (rss / (n - k - 1))',
    'r2': '1.0 - rss / tss', 'r2_adj': '1.0 - (rss / (n - k - 1)) / (tss / (n - 1))',
    'root_mse': 'sqrt(rss / (n - k - 1))', 'f_p': f_tail('((tss - rss) / k) / (rss / (n - k - 1))', 'k', '(n - k - 1)'),
}, 6)}"""


def origin_fit() -> str:
    columns = {c: c for c in REGRESSORS} | {"__y": "score"}
    source = "one_year"
    return f"""{PANEL},
one_year as (select row_number() over () as id, * from panel where "Year" = {ONE_YEAR}),
long as ({numbers(source, columns, intercept=False)}),
{sweep('long')}"""


ORACLES: dict[str, str] = {
    "quarter_margin": f"""
select {QUARTER} as quarter, count(*) as n, {r('sum(l_extendedprice)', 2)} as total_sales,
       {r(f'sum({PROFIT})', 0)} as total_profit, {r(f'avg({PROFIT} / nullif(l_extendedprice, 0))')} as mean_margin,
       {r(f'sum({PROFIT}) / nullif(sum(l_extendedprice), 0)')} as margin
from lineitem join orders on l_orderkey = o_orderkey group by 1""",
    "rounded_report": f"""
with {SALES}
select ship_mode, region, round_even(avg(margin) * 100.0::double, 2) as margin_pct,
       round_even(avg(discount) * 100.0::double, 2) as discount_pct
from lines group by 1, 2""",
    "baseline_totals": f"""
select {r(f'sum({PROFIT})', 0)} as total_profit, {r('sum(l_extendedprice)', 2)} as total_sales,
       {r(f'sum({PROFIT}) / nullif(sum(l_extendedprice), 0)')} as margin,
       count(*) filter ({PROFIT} is null or l_extendedprice is null) as n_null
from lineitem""",
    "discount_notes": f"""
select {r('avg(l_discount)', 9)} as mean_discount, count(*) filter (l_discount > 0) as n_discounted,
       count(*) as n_rows from lineitem""",
    "extents": f"""
with {SALES}
select {", ".join(f"{r(f'{f}({c})')} as {f}_{c}" for c in ("sales", "discount", "margin") for f in ("min", "max"))}
from lines""",
    "category_levels": f"""
with {SALES}
{" union all ".join(f"select '{c}' as variable, {c} as category, count(*) as n from lines group by {c}" for c in CATEGORIES)}""",
    "discount_cap_sweep": f"{constant_sweep('level')} select {rounded(SWEEP_COLUMNS)}, 0::bigint as n_null from result",
    "discount_cap_sweep_relative":
        f"{constant_sweep('relative')} select {rounded(SWEEP_COLUMNS)}, 0::bigint as n_null from result",
    "sweep_csv": f"{constant_sweep('level')} select "
        + ", ".join(f'round_even("{c}", 2) + 0.0::double as "{c}"' for c in SWEEP_COLUMNS) + " from result",
    "best_cap": f"""{constant_sweep('level')}
select {r('discount_cap')} as discount_cap, {r('total_profit', 0)} as total_profit
from result order by round(total_profit, 3) desc, discount_cap limit 1""",
    "profit_curve": f"""{constant_sweep('level')}
select {rounded({'discount_cap': 6, 'total_profit': 0, 'total_sales': 2})},
       row_number() over (order by round(total_profit, 3) desc, discount_cap) = 1 as is_max from result""",
    "capped_rows": f"""
select {KEYS}, {r('sales')} as sales, {r('discount')} as discount, {r('dn')} as discount_new,
       {r('dn - discount')} as discount_change, {r('pm')} as predicted_margin, {r('ps')} as predicted_sales,
       {r('pm * ps')} as predicted_profit
from (
  select *, {MARGIN_AT_ZERO}::double + {MARGIN_SLOPE}::double * dn as pm,
         case when discount > 0.04::double then sales * (-({ELASTICITY}::double) * (dn - discount)) else sales end as ps
  from (
    select {KEYS}, l_extendedprice as sales, l_discount as discount,
           case when l_discount > 0.04::double then 0.04::double else l_discount end as dn
    from lineitem
  )
)""",
    "split_counts": f"select {PART} as part, count(*) as n from lineitem group by 1",
    "one_hot": f"""
with {SALES},
seen as (
  select 'ship_mode' as variable, ship_mode as category from lines where year(order_date) < 2001 group by 2
  union all select 'quarter', quarter from lines where year(order_date) < 2001 group by 2
),
ind as (
  select *, variable || '_' || category as indicator
  from (select *, row_number() over (partition by variable order by category) as k from seen) where k > 1
)
select quarter, indicator,
       sum(case when (variable = 'quarter' and category = quarter) or (variable = 'ship_mode' and category = ship_mode)
           then 1.0::double else 0.0::double end) as total
from lines cross join ind group by 1, 2""",
    "standardize": f"""
with base as (
  select *, {PART} as part, l_extendedprice as sales, l_discount as discount, l_quantity as quantity, l_tax as tax
  from lineitem
),
fitted as (
  select {", ".join(f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}" for c in ("sales", "discount", "quantity", "tax"))}
  from base where part >= 0
)
select {KEYS}, {", ".join(f"{r(f'({c} - m_{c}) / s_{c}')} as {c}" for c in ("sales", "discount", "quantity", "tax"))}
from base, fitted where part < 0""",
    "ols_margin": f"with recursive {MARGIN_FIT}, {t_table('fit', 'select count(*) from train', 7)}",
    "ols_margin_fit": f"""
with recursive {MARGIN_FIT},
s as (
  select count(*) as n, (select count(*) - 1 from fit_coef) as k, var_pop(margin) * count(*) as tss, any_value(rss) as rss
  from train, fit_rss
)
{statistics('s', {'n': 'n', 'df_model': 'k', 'df_resid': 'n - k - 1', 'r2': '1.0 - rss / tss',
                  'root_mse': 'sqrt(rss / (n - k - 1))'}, 6)}""",
    "top_coefficients": f"""
with recursive {MARGIN_FIT}
select term, {r('estimate', 7)} as estimate, {r('abs(estimate)', 7)} as magnitude
from fit_coef where term <> '_cons' order by abs(fit_coef.estimate) desc, term limit 15""",
    "holdout_metrics": f"with recursive {MARGIN_FIT}, {TEST_METRICS} from test join score using (id)",
    "elasticity": f"""
with recursive {SALES},
{levels('lines', 'true')},
{ELASTICITY_FIT}
select {r('estimate')} as elasticity, (select count(*) from lines) as n from efit_coef where term = 'log1p_discount'""",
    "whatif_profit": f"{FITTED_SWEEP}{WHATIF}",
    "whatif_lasso": f"{fitted_sweep(MARGIN_LASSO)}{WHATIF}",
    "lasso_margin": f"""
with recursive {MARGIN_LASSO},
{TEST_METRICS}, {r('any_value(alpha)', 10)} as alpha,
       (select count(*) from las_coef where scaled <> 0) as n_selected
from test join score using (id), las_best""",
    "lasso_selected": f"""
with recursive {MARGIN_LASSO}
select term as variable, {r('scaled', 7)} as coefficient from las_coef where scaled <> 0""",
    "lasso_path": f"""
with recursive {MARGIN_LASSO}
select {r('alpha', 10)} as alpha, {r('mse', 10)} as mean_mse, k = (select k from las_best) as is_best from las_path""",
    "lasso_certificate": f"""
with recursive {MARGIN_LASSO}
select fold::integer as fold, {r('alpha', 10)} as alpha, n::bigint as n, {r('objective', 9)} as objective, {r('gap')} as gap from las_proof""",
    "panel_lasso": f"""
with recursive {PANEL_LASSO}
select term as variable, {r('scaled')} as coefficient from las_coef where scaled <> 0""",
    "panel_lasso_fit": f"""
with recursive {PANEL_LASSO}
select count(*) as n, {r('1.0 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*))')} as r2, {r('avg(abs(y - yhat))')} as mae,
       {r('avg((y - yhat) * (y - yhat))')} as mse, {r('any_value(alpha)', 9)} as alpha,
       (select count(*) from las_coef where scaled <> 0) as n_selected
from guess, las_best""",
    "panel_lasso_pairs": f"""
with recursive {PANEL_LASSO},
e as (select min(y) as x0, max(y) as x1, min(yhat) as y0, max(yhat) as y1 from guess)
select least(floor((y - x0) / ((x1 - x0) / 20)), 19)::integer as x_bin,
       case when y1 > y0 then least(floor((yhat - y0) / ((y1 - y0) / 20)), 19) else 0 end::integer as y_bin, count(*) as n,
       {r('any_value(x0)')} as x_min, {r('any_value(x1)')} as x_max, {r('any_value(y0)')} as y_min, {r('any_value(y1)')} as y_max
from guess, e group by 1, 2""",
    "panel_lasso_certificate": f"""
with recursive {PANEL_LASSO}
select fold::integer as fold, {r('alpha', 9)} as alpha, n::bigint as n, {r('objective', 8)} as objective, {r('gap')} as gap from las_proof""",
    "whatif_best": f"""{FITTED_SWEEP}
select {r('discount_cap')} as discount_cap, {r('total_profit', -1)} as total_profit
from result order by round(total_profit, 3) desc, discount_cap limit 1""",
    "lasso_one_feature": f"""
with s as (
  select covar_pop(discount, margin) as c, var_pop(discount) as v, avg(discount) as mx, avg(margin) as my
  from (select l_discount as discount, {PROFIT} / nullif(l_extendedprice, 0) as margin from lineitem)
),
w as (select *, sign(c) * greatest(abs(c) - 2e-4::double, 0.0::double) / v as b from s)
select '_cons' as term, {r('my - b * mx', 8)} as estimate from w
union all select 'discount', {r('b', 8)} from w""",
    "lasso_all_features": f"""
with recursive {MARGIN_FIT},
mean as (select a.j as k, a.v / n.v as mean, n.v as n from fit_gram a, (select v from fit_gram where i = 1 and j = 1) n
         where a.i = 1),
centred as (
  select i - 1 as i, j - 1 as j, v / a.n - a.mean * b.mean as q
  from fit_gram g join mean a on a.k = g.i join mean b on b.k = g.j where i > 1 and j > 1
),
p as (select max(i) - 1 as p from centred),
cd as (
  select 0 as step, i, 0.0::double as w, q as gradient from centred, p where j = p + 1 and i <= p
  union all
  select step + 1, i, case when i = jj then w + delta else w end, gradient - q * delta
  from (
    select *, max(case when i = jj then sign(gradient + q * w)
               * greatest(abs(gradient + q * w) - {LASSO_ALPHA}::double, 0.0::double) / q - w end) over () as delta
    from (
      select cd.step, cd.i, cd.w, cd.gradient, c.q, c.j as jj
      from cd, p, centred c where c.i = cd.i and c.j = (cd.step % p.p) + 1 and cd.step < 40 * p.p
    )
  )
),
w as (select term, w, mean from cd, p, fit_terms t, mean m where step = 40 * p.p and t.k = i + 1 and m.k = i + 1)
select term, {r('w', 8)} as estimate from w
union all
select '_cons', {r('any_value(y.mean) - sum(w.w * w.mean)', 8)} from w, (select mean from mean order by k desc limit 1) y""",
    "lasso_three_features": f"""
with recursive raw as (
  select l_discount as x1, l_quantity as x2, l_tax as x3, {PROFIT} / nullif(l_extendedprice, 0) as y from lineitem
),
s as (
  select covar_pop(x1, y) / stddev_pop(x1) as c1, covar_pop(x2, y) / stddev_pop(x2) as c2,
         covar_pop(x3, y) / stddev_pop(x3) as c3, corr(x1, x2) as q12, corr(x1, x3) as q13, corr(x2, x3) as q23,
         stddev_pop(x1) as s1, stddev_pop(x2) as s2, stddev_pop(x3) as s3, avg(x1) as m1, avg(x2) as m2, avg(x3) as m3,
         avg(y) as my
  from raw
),
cd as (
  select 0 as k, 0.0::double as w1, 0.0::double as w2, 0.0::double as w3
  union all
  select k + 1, a1, a2,
         sign(c3 - q13 * a1 - q23 * a2) * greatest(abs(c3 - q13 * a1 - q23 * a2) - 1e-3::double, 0.0::double)
  from (
    select *, sign(c2 - q12 * a1 - q23 * w3) * greatest(abs(c2 - q12 * a1 - q23 * w3) - 1e-3::double, 0.0::double) as a2
    from (
      select *, sign(c1 - q12 * w2 - q13 * w3)
             * greatest(abs(c1 - q12 * w2 - q13 * w3) - 1e-3::double, 0.0::double) as a1
      from cd, s where k < 300
    )
  )
),
w as (select w1 / s1 as b1, w2 / s2 as b2, w3 / s3 as b3, s.* from cd, s where k = 300)
select '_cons' as term, {r('my - b1 * m1 - b2 * m2 - b3 * m3', 8)} as estimate from w
union all select 'discount', {r('b1', 8)} from w
union all select 'quantity', {r('b2', 8)} from w
union all select 'tax', {r('b3', 8)} from w""",
    "lasso_cv_one_feature": f"""
with obs as (
  select l_discount as x, {PROFIT} / nullif(l_extendedprice, 0) as y, {PART} as part from lineitem
),
train as (select * from obs where part >= 0),
grid as (
  select top * power(10.0::double, -3.0::double * k / 99.0::double) as alpha
  from (select abs(covar_pop(x, y)) as top from train), range(0, 100) as s(k)
),
held as (
  select f.part as fold, covar_pop(x, y) as c, var_pop(x) as v, avg(x) as mx, avg(y) as my
  from (select distinct part from train) f join train t on t.part <> f.part group by 1
),
fits as (
  select fold, alpha, mx, my, sign(c) * greatest(abs(c) - alpha, 0.0::double) / v as b from held cross join grid
),
errors as (
  select alpha, fold, avg((y - my - b * (x - mx)) * (y - my - b * (x - mx))) as mse
  from fits join train on part = fold group by 1, 2
),
path as (select alpha, avg(mse) as mean_mse from errors group by 1)
select {r('alpha', 10)} as alpha, {r('mean_mse', 10)} as mean_mse,
       row_number() over (order by path.mean_mse, path.alpha desc) = 1 as is_best from path""",
    "lasso_cv_three_features": f"""
with recursive raw as (
  select l_discount as x1, l_quantity as x2, l_tax as x3, {PROFIT} / nullif(l_extendedprice, 0) as y, {PART} as part
  from lineitem
),
train as (
  select (x1 - avg(x1) over ()) / stddev_pop(x1) over () as x1, (x2 - avg(x2) over ()) / stddev_pop(x2) over () as x2,
         (x3 - avg(x3) over ()) / stddev_pop(x3) over () as x3, y, part
  from raw where part >= 0
),
units as (select stddev_pop(x1) as s1, stddev_pop(x2) as s2, stddev_pop(x3) as s3 from raw where part >= 0),
grid as (
  select top * power(10.0::double, -3.0::double * k / 99.0::double) as alpha
  from (select greatest(abs(covar_pop(x1, y)), abs(covar_pop(x2, y)), abs(covar_pop(x3, y))) as top from train),
       range(0, 100) as s(k)
),
held as (
  select f.part as fold, covar_pop(x1, y) as c1, covar_pop(x2, y) as c2, covar_pop(x3, y) as c3, var_pop(x1) as q11,
         var_pop(x2) as q22, var_pop(x3) as q33, covar_pop(x1, x2) as q12, covar_pop(x1, x3) as q13,
         covar_pop(x2, x3) as q23, avg(x1) as m1, avg(x2) as m2, avg(x3) as m3, avg(y) as my
  from (select distinct part from train union all select -1) f join train t on t.part <> f.part group by 1
),
cd as (
  select 0 as k, fold, alpha, 0.0::double as w1, 0.0::double as w2, 0.0::double as w3 from held cross join grid
  union all
  select k + 1, fold, alpha, a1, a2,
         sign(c3 - q13 * a1 - q23 * a2) * greatest(abs(c3 - q13 * a1 - q23 * a2) - alpha, 0.0::double) / q33
  from (
    select *, sign(c2 - q12 * a1 - q23 * w3) * greatest(abs(c2 - q12 * a1 - q23 * w3) - alpha, 0.0::double) / q22 as a2
    from (
      select cd.*, held.* exclude (fold), sign(c1 - q12 * w2 - q13 * w3)
             * greatest(abs(c1 - q12 * w2 - q13 * w3) - alpha, 0.0::double) / q11 as a1
      from cd join held using (fold) where k < 60
    )
  )
),
fits as (select cd.*, m1, m2, m3, my from cd join held using (fold) where k = 60),
errors as (
  select alpha, fold, avg(power(y - my - w1 * (x1 - m1) - w2 * (x2 - m2) - w3 * (x3 - m3), 2)) as mse
  from fits join train on part = fold group by 1, 2
),
path as (select alpha, avg(mse) as mean_mse from errors group by 1),
ranked as (select *, row_number() over (order by mean_mse, alpha desc) = 1 as best from path)
select {r('p.alpha', 9)} as alpha, {r('mean_mse', 9)} as mean_mse, best as is_best,
       case when best then {r('w1 / s1', 9)} end as b_discount, case when best then {r('w2 / s2', 9)} end as b_quantity,
       case when best then {r('w3 / s3', 9)} end as b_tax
from ranked p join fits f on f.alpha = p.alpha and f.fold = -1, units""",
    "durbin_watson": f"""
with recursive obs as (
  select row_number() over () as id, *, {PROFIT} / nullif(l_extendedprice, 0) as margin from lineitem
),
long as ({numbers('obs', {'discount': 'l_discount', 'quantity': 'l_quantity', '__y': 'margin'})}),
{sweep('long')},
res as (
  select obs.*, margin - yhat as e
  from obs join (select id, sum(v * estimate) as yhat from long join fit_coef using (term) group by id) using (id)
)
select {r('sum(step * step) / sum(e * e)')} as durbin_watson
from (select e, e - lag(e) over (order by {KEYS}, e) as step from res)""",
    "actual_predicted": f"""
with recursive obs as (
  select row_number() over () as id, *, {PROFIT} / nullif(l_extendedprice, 0) as margin from lineitem
),
long as ({numbers('obs', {'discount': 'l_discount', 'quantity': 'l_quantity', '__y': 'margin'})}),
{sweep('long')},
pairs as (
  select margin as x, yhat as y
  from obs join (select id, sum(v * estimate) as yhat from long join fit_coef using (term) group by id) using (id)
),
e as (select min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from pairs)
select least(floor((x - x0) / ((x1 - x0) / 40)), 39)::integer as x_bin,
       least(floor((y - y0) / ((y1 - y0) / 40)), 39)::integer as y_bin, count(*) as n,
       {r('any_value(x0)')} as x_min, {r('any_value(x1)')} as x_max, {r('any_value(y0)')} as y_min,
       {r('any_value(y1)')} as y_max
from pairs, e group by 1, 2""",
    "panel_macro": f"""
with {MACRO}
select year as "Year", "Country", {rounded(MACRO_COLUMNS)} from macro where year between 1996 and 2000""",
    "panel_score": f"""
with {MACRO}
select "Year", "Country", {r('score')} as score from scores where "Year" between 1996 and 2000""",
    "score_sheet": f"""
with {MACRO}
select "Year", "Country", {r('score')} as score from scores where "Year" between 1996 and 2000""",
    "panel_join": f"""
with {PANEL}
select "Year", "Country", {rounded(MACRO_COLUMNS)}, {r('score')} as score from panel""",
    "panel_csv": f"""
with {PANEL}
select "Year", "Country", {rounded(MACRO_COLUMNS)}, {r('score')} as score from panel""",
    "panel_complete_rows": f"""
with {PANEL}
select {rounded({'score': 6, **{c: (2 if c == 'gdp_usd' else 6) for c in REGRESSORS}, 'income_group_code': None})}
from panel where unemployment_rate <= 0.4::double""",
    "panel_missing": f"""
with {PANEL}
select count(*) as n_rows, count(*) filter (unemployment_rate <= 0.4::double) as n_used,
       count(*) filter (unemployment_rate > 0.4::double) as n_dropped from panel""",
    "ols_origin": f"""
with recursive {origin_fit()},
{t_table('fit', 'select count(*) from one_year', 6, "case when i.term = 'gdp_usd' then 1e9::double else 1.0::double end")}""",
    "ols_origin_fit": f"""
with recursive {origin_fit()},
s as (
  select n, k, tss, rss, -n / 2.0 * (ln(2.0 * pi()) + ln(rss / n) + 1.0) as ll
  from (
    select count(*)::double as n, (select count(*) from fit_coef) as k, sum(score * score) as tss, any_value(rss) as rss
    from one_year, fit_rss
  )
)
{statistics('s', {
    'n': 'n', 'df_model': 'k', 'df_resid': 'n - k', 'r2': '1.0 - rss / tss',
    'r2_adj': '1.0 - (rss / (n - k)) / (tss / n)', 'f': '((tss - rss) / k) / (rss / (n - k))', 'loglik': 'll',
    'aic': '-2.0 * ll + 2.0 * k', 'bic': '-2.0 * ll + k * ln(n)',
    'f_p': f_tail('((tss - rss) / k) / (rss / (n - k))', 'k', '(n - k)'),
}, 5)}""",
    "summarize": f"""
with {SECTION}
{" union all ".join(
    f"select '{c}' as variable, count({c}) as obs, {r(f'avg({c})')} as mean, {r(f'stddev_samp({c})')} as sd,"
    f" {r(f'min({c})')} as min, {r(f'max({c})')} as max from section" for c in SUMMARY
)}""",
    "derived_variables": f"""
with {SECTION}
select unit, {", ".join(f"{c}::float::double as {c}" for c in (LABEL, 'gdppc_thousands', 'interraction_gdppc_trade'))}
from section""",
    "ols_full": f"with recursive {section_fit(FULL)}, {t_table('fit', 'select count(*) from section', 8)}",
    "ols_reduced": f"with recursive {section_fit(REDUCED)}, {t_table('fit', 'select count(*) from section', 8)}",
    "ols_full_fit": section_table(FULL),
    "ols_reduced_fit": section_table(REDUCED),
    "vif_full": f"""
with recursive {section_vif(FULL)}
select term, {r('vif')} as vif, {r('1.0 / vifs.vif')} as tolerance from vifs""",
    "vif_reduced": f"""
with recursive {section_vif(REDUCED)}
select term, {r('vif')} as vif, {r('1.0 / vifs.vif')} as tolerance from vifs""",
    "mean_vif_by_model": f"""
select * from (with recursive {section_vif(FULL)} select {r('avg(vif)')} as mean_vif, 'full' as model from vifs)
union all
select * from (with recursive {section_vif(REDUCED)} select {r('avg(vif)')} as mean_vif, 'reduced' as model from vifs)""",
    "residuals": f"with recursive {FULL_ROWS} select unit, {rounded({'fitted': 6, 'residual': 6})} from res",
    "residual_scatter": f"""
with recursive {FULL_ROWS},
e as (select min(fitted) as x0, max(fitted) as x1, min(residual) as y0, max(residual) as y1 from res)
select least(floor((fitted - x0) / ((x1 - x0) / 20)), 19)::integer as x_bin,
       least(floor((residual - y0) / ((y1 - y0) / 20)), 19)::integer as y_bin, count(*) as n,
       {r('any_value(x0)')} as x_min, {r('any_value(x1)')} as x_max, {r('any_value(y0)')} as y_min,
       {r('any_value(y1)')} as y_max
from res, e group by 1, 2""",
    "residual_shape": f"""
with recursive {FULL_ROWS},
m as (
  select count(*)::double as n, avg(d * d) as m2, avg(d * d * d) as m3, avg(d * d * d * d) as m4
  from (select residual - avg(residual) over () as d from res)
),
a as (
  select n, m3 / power(m2, 1.5) as g, m4 / (m2 * m2) as k, 3.0 * (n - 1) / (n + 1) as ek,
         24.0 * n * (n - 2) * (n - 3) / (power(n + 1, 2) * (n + 3) * (n + 5)) as vk,
         3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) as b2,
         6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) as sb
  from m
),
b as (
  select *, sqrt(2.0 * (b2 - 1)) - 1 as w2, 6.0 + 8.0 / sb * (2.0 / sb + sqrt(1.0 + 4.0 / (sb * sb))) as aa,
         g * sqrt((n + 1) * (n + 3) / (6.0 * (n - 2))) as y
  from a
),
c as (
  select *, 1.0 / sqrt(ln(sqrt(w2))) * ln(y / sqrt(2.0 / (w2 - 1)) + sqrt(y * y * (w2 - 1) / 2.0 + 1.0)) as zs,
         (1.0 - 2.0 / aa) / (1.0 + (k - ek) / sqrt(vk) * sqrt(2.0 / (aa - 4))) as base
  from b
),
d as (
  select *, (1.0 - 2.0 / (9.0 * aa) - sign(base) * power(abs(base), 1.0 / 3.0)) / sqrt(2.0 / (9.0 * aa)) as zk,
         n / 6.0 * (g * g + (k - 3) * (k - 3) / 4.0) as jb
  from c
)
{statistics('d', {
    'n': 'n', 'skew': 'g', 'kurtosis': 'k', 'jarque_bera': 'jb', 'jarque_bera_p': 'exp(-jb / 2.0)',
    'omnibus': 'zs * zs + zk * zk', 'omnibus_p': 'exp(-(zs * zs + zk * zk) / 2.0)',
}, 5)}""",
    "residual_density": f"""
with recursive {FULL_ROWS},
x as (select residual as e, row_number() over (order by residual) as k, count(*) over () as n from res),
q as (
  select any_value(n) as n, avg(e) as mean, stddev_samp(e) as sd, min(e) as low, max(e) as high,
         avg(e) filter (k = ceil(n * 0.25) or (n % 4 = 0 and k = n * 0.25 + 1)) as q1,
         avg(e) filter (k = ceil(n * 0.75) or (n % 4 = 0 and k = n * 0.75 + 1)) as q3
  from x
),
h as (select *, 0.9 * least(sd, (q3 - q1) / 1.349) * power(n, -0.2) as h, least(n, 50) as points from q),
grid as (
  select low - h + k * ((high - low + 2.0 * h) / (points - 1)) as g, h.*
  from h, range(0, 50) as s(k) where k < points
)
select {r('g')} as point,
       {r('sum(case when abs(g - e) < h * sqrt(5.0) then 0.75 * (1.0 - power((g - e) / h, 2) / 5.0) / sqrt(5.0) else 0.0::double end) / (any_value(grid.n) * any_value(h))')} as density,
       {r('exp(-0.5 * power((g - any_value(mean)) / any_value(sd), 2)) / (any_value(sd) * sqrt(2.0 * pi()))')} as normal
from grid cross join x group by g""",
    "shapiro_wilk": f"""
with recursive {FULL_ROWS},
sample as (select residual as x from res),
{ORDERED},
t as (
  select any_value(n) as n, sum(m * m) as ss, power(any_value(n), -0.5) as u, max(m) filter (k = n) as m1,
         max(m) filter (k = n - 1) as m2
  from ordered
),
a as (
  select *, u * (0.221157 + u * (-0.147981 + u * (-2.07119 + u * (4.434685 - 2.706056 * u)))) + m1 / sqrt(ss) as a1,
         u * (0.042981 + u * (-0.293762 + u * (-1.752461 + u * (5.682633 - 3.582633 * u)))) + m2 / sqrt(ss) as a2
  from t
),
f as (select *, sqrt((ss - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) as fac from a),
w as (
  select any_value(f.n) as n, power(corr(x, case when k = 1 then -a1 when k = 2 then -a2 when k = f.n then a1
         when k = f.n - 1 then a2 else m / fac end), 2) as w
  from ordered, f
),
z as (
  select n, w, ln(1.0 - w) as gap, ln(n) as l from w
),
v as (
  select *, -1.5861 + l * (-0.31082 + l * (-0.083751 + l * 0.0038915)) as mu,
         exp(-0.4803 + l * (-0.082676 + l * 0.0030302)) as sd
  from z
)
select n, {r('w')} as w, case when n <= 2000 then {r('exp(gap - mu)', 5)} end as v,
       case when n <= 2000 then {r('(gap - mu) / sd', 5)} end as z,
       case when n <= 2000 then {r(normal_tail('(gap - mu) / sd'), 5)} end as p from v""",
    "shapiro_francia": f"""
with sample as (select l_quantity as x from lineitem),
{ORDERED}
select count(*) as n, {r('power(corr(m, x), 2)', 7)} as w, null::double as z, null::double as p,
       count(*) between 5 and 5000 as calibrated
from ordered""",
    "im_test": im_sql(),
}
ORACLES["lasso_nonzero"] = f"select * from ({ORACLES['lasso_all_features']}) where estimate <> 0 and term <> '_cons'"
ORACLES["durbin_watson_panel"] = f"""
with recursive {origin_fit()},
res as (
  select one_year.*, score - yhat as e
  from one_year join (select id, sum(v * estimate) as yhat from long join fit_coef using (term) group by id) using (id)
)
select {r('sum(step * step) / sum(e * e)')} as durbin_watson
from (select e, e - lag(e) over (order by "Country", e) as step from res)"""
ORACLES["split_exact"] = f"""
with d as (
  select *, row_number() over (order by {KEY_HASH}, {KEYS}) <= ceil(count(*) over () * 0.2) as is_test from lineitem
)
select is_test, cast(l_orderkey % 50 as integer) as part, count(*) as n, sum(l_partkey)::bigint as parts, sum(l_suppkey)::bigint as suppliers
from d group by all"""
ORACLES["many_levels"] = f"""
with recursive obs as (
  select row_number() over () as id, l_partkey as a, l_suppkey as b, l_discount as x, {PROFIT} / nullif(l_extendedprice, 0) as y from lineitem
),
swept as (
  select 0 as step, id, a, b, x, y from obs
  union all
  select step + 1, id, a, b, x - avg(x) over (partition by b), y - avg(y) over (partition by b)
  from (select step, id, a, b, x - avg(x) over (partition by a) as x, y - avg(y) over (partition by a) as y from swept where step < 40)
)
select 'discount' as term, {r('sum(x * y) / sum(x * x)')} as estimate,
       (select count(distinct a) + count(distinct b) - 1 from obs)::integer as terms
from swept where step = 40"""
ORACLES["collinearity"] = f"""
with recursive {section_fit(FULL)},
sizes as (select t.term, sqrt(g.v) as s from fit_gram g join fit_terms t on t.k = g.i where g.i = g.j and t.term <> '__y'),
whole as (
  select list(r order by k) as m from (
    select a.k, list(g.v / x.s / y.s order by b.k) as r
    from fit_gram g join fit_terms a on a.k = g.i join fit_terms b on b.k = g.j join sizes x on x.term = a.term join sizes y on y.term = b.term
    group by a.k)
),
inverse as (
  select list(r order by k) as m from (
    select a.k, list(g.v * x.s * y.s order by b.k) as r
    from fit_m g join fit_terms a on a.term = g.i join fit_terms b on b.term = g.j join sizes x on x.term = a.term join sizes y on y.term = b.term
    group by a.k)
),
power as (
  select 0 as step, kind, m, list_transform(m, lambda x: 1.0::double + x[1] / 7.0) as v, 1.0::double as size
  from (select 'whole' as kind, m from whole union all select 'inverse', m from inverse)
  union all
  select step + 1, kind, m, list_transform(w, lambda x: x / sqrt(list_sum(list_transform(w, lambda y: y * y)))), sqrt(list_sum(list_transform(w, lambda y: y * y)))
  from (select step, kind, m, list_transform(m, lambda row: list_dot_product(row, v)) as w from power where step < 1000)
)
select (select count(*) from section) as n, (select count(*) from sizes)::integer as rank,
       {r('sqrt(max(size) filter (kind = ' + "'whole'" + ') * max(size) filter (kind = ' + "'inverse'" + '))', 5)} as condition, {r('any_value(rss)')} as rss
from power, fit_rss where step = 1000"""
