"""Registered weekly-feature and forecast queries over the sales binding.

Extras: ``discount`` (numeric + discount features), ``l_returnflag`` and
``p_brand`` (categorical).  Doubles that come out of windowed means are
rounded to 6 decimals on both sides; money sums are exact decimals.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import round6
from ..operators import features as W
from ..operators import forecast as L
from ..sources.tables import sales
from . import sql as Q
from .catalog import register

EXTRAS = ["discount", "l_returnflag", "p_brand"]


def weekly(spark, d, series=()):
    return W.weekly_features(sales(spark, d), EXTRAS, series, numeric_extras=["discount"])


def _r6(df, cols):
    return df.withColumns({c: round6(F.col(c).cast("double")) for c in cols})


_WEEKLY = """wk as (
  select cast(date_trunc('week', date) as date) as week_start,
         coalesce(cast(sum(cast(revenue as decimal(38,2))) as double), 0.0) as weekly_revenue,
         coalesce(sum(quantity), 0.0) as weekly_quantity,
         cast(sum(cast(unit_price as decimal(38,2))) as double) / count(unit_price) as avg_unit_price,
         count(distinct product_name) as product_count, count(*) as row_count,
         cast(sum(cast(discount as decimal(38,10))) as double) / count(discount) as discount_mean,
         coalesce(cast(sum(cast(discount as decimal(38,10))) as double), 0.0) as discount_sum,
         min(discount) as discount_min, max(discount) as discount_max,
         cast(sum(cast(case when discount > 1 and discount <= 100 then discount / 100 else discount end as decimal(38,10))) as double)
           / count(discount) as discount_average_discount,
         max(case when discount > 1 and discount <= 100 then discount / 100 else discount end) as discount_max_discount,
         avg(case when coalesce(case when discount > 1 and discount <= 100 then discount / 100 else discount end, 0.0) > 0
                  then 1.0 else 0.0 end) as discount_discounted_sales_ratio
  from sales where date is not null group by 1)"""


def _cat_sql(col: str) -> str:
    return f"""cat_{col} as (
  select t.week_start, coalesce(c.n, 0) as {col}_count, coalesce(c.k, 0) as {col}_nunique,
         coalesce(case when t.total <> 0 then c.top_rev / t.total else 0.0 end, 0.0) as {col}_top_revenue_share
  from (select cast(date_trunc('week', date) as date) as week_start,
               coalesce(cast(sum(cast(revenue as decimal(38,2))) as double), 0.0) as total
        from sales where date is not null group by 1) t
  left join (
    select week_start, sum(n) as n, count(*) as k, max(case when rk = 1 then rev end) as top_rev
    from (select week_start, v, n, rev, row_number() over (partition by week_start order by n desc, v asc) as rk
          from (select cast(date_trunc('week', date) as date) as week_start, {col} as v, count(*) as n,
                       coalesce(cast(sum(cast(revenue as decimal(38,2))) as double), 0.0) as rev
                from sales where date is not null and {col} is not null group by 1, 2) a) b
    group by week_start) c on t.week_start = c.week_start)"""


_ALL = Q.with_(Q.SALES, _WEEKLY, _cat_sql("l_returnflag"), _cat_sql("p_brand"))
_ALL_REC = _ALL.replace("with ", "with recursive ", 1)

_HIST = ["weekly_quantity", "avg_unit_price", "product_count", "row_count",
         "discount_mean", "discount_sum", "discount_min", "discount_max",
         "discount_average_discount", "discount_max_discount", "discount_discounted_sales_ratio",
         "l_returnflag_count", "l_returnflag_nunique", "l_returnflag_top_revenue_share",
         "p_brand_count", "p_brand_nunique", "p_brand_top_revenue_share"]

_JOINED = """, joined as (
  select wk.*, l.l_returnflag_count, l.l_returnflag_nunique, l.l_returnflag_top_revenue_share,
         b.p_brand_count, b.p_brand_nunique, b.p_brand_top_revenue_share
  from wk left join cat_l_returnflag l on wk.week_start = l.week_start
          left join cat_p_brand b on wk.week_start = b.week_start)"""


def _win(expr, frame, n, fn="avg"):
    over = f"over (order by week_start rows between {frame} preceding and 1 preceding)"
    return f"case when count({expr}) {over} = {n} then {fn}({expr}) {over} end"


_FEATS = _JOINED + """, feats as (
  select *, year(week_start) as "year", month(week_start) as "month", quarter(week_start) as "quarter",
         weekofyear(week_start) as week_of_year,
         lag(weekly_revenue, 1) over (order by week_start) as revenue_lag_1,
         lag(weekly_revenue, 2) over (order by week_start) as revenue_lag_2,
         lag(weekly_revenue, 4) over (order by week_start) as revenue_lag_4,
         """ + _win("weekly_revenue", 4, 4) + """ as rolling_revenue_4,
         """ + _win("weekly_revenue", 8, 8) + """ as rolling_revenue_8,
         lag(weekly_quantity, 1) over (order by week_start) as quantity_lag_1,
         """ + _win("weekly_quantity", 4, 4) + """ as rolling_quantity_4,
         """ + ",\n         ".join(
    f"lag(cast({c} as double), 1) over (order by week_start) as prev_{c}, "
    f"{_win(f'cast({c} as double)', 4, 4)} as rolling4_mean_{c}, "
    f"{_win(f'cast({c} as double)', 4, 4, 'sum')} as rolling4_sum_{c}" for c in _HIST) + """
  from joined)"""


def _re(cols):
    return ", ".join(f"round_even(cast({c} as double), 6) as {c}" for c in cols)


@register("weekly_sales", Q.with_(Q.SALES, _WEEKLY) + """
select week_start, weekly_revenue, weekly_quantity, round_even(avg_unit_price, 6) as avg_unit_price,
       product_count, row_count from wk""")
def q_weekly_sales(spark, d):
    return _r6(weekly(spark, d).select("week_start", *W.BASE_WEEKLY), ["avg_unit_price"])


_NUM = ["discount_mean", "discount_sum", "discount_min", "discount_max"]


@register("weekly_numeric_features", Q.with_(Q.SALES, _WEEKLY) + f"select week_start, {_re(_NUM)} from wk")
def q_weekly_numeric(spark, d):
    return _r6(weekly(spark, d).select("week_start", *_NUM), _NUM)


_DISC = ["discount_average_discount", "discount_max_discount", "discount_discounted_sales_ratio"]


@register("weekly_discount_features", Q.with_(Q.SALES, _WEEKLY) + f"select week_start, {_re(_DISC)} from wk")
def q_weekly_discount(spark, d):
    return _r6(weekly(spark, d).select("week_start", *_DISC), _DISC)


_CAT = ["l_returnflag_count", "l_returnflag_nunique", "l_returnflag_top_revenue_share",
        "p_brand_count", "p_brand_nunique", "p_brand_top_revenue_share"]


@register("weekly_categorical_features", _ALL + _JOINED + """
select week_start, l_returnflag_count, l_returnflag_nunique, round_even(l_returnflag_top_revenue_share, 6) as l_returnflag_top_revenue_share,
       p_brand_count, p_brand_nunique, round_even(p_brand_top_revenue_share, 6) as p_brand_top_revenue_share from joined""")
def q_weekly_categorical(spark, d):
    return _r6(weekly(spark, d).select("week_start", *_CAT),
               ["l_returnflag_top_revenue_share", "p_brand_top_revenue_share"])


@register("weekly_feature_join", _ALL + _JOINED + f"""
select week_start, weekly_revenue, {_re(_HIST)} from joined""")
def q_weekly_join(spark, d):
    return _r6(weekly(spark, d).select("week_start", "weekly_revenue", *_HIST), _HIST)


@register("weekly_calendar", _ALL + _FEATS + """
select week_start, cast("year" as integer) as "year", cast("month" as integer) as "month",
       cast("quarter" as integer) as "quarter", cast(week_of_year as integer) as week_of_year from feats""")
def q_weekly_calendar(spark, d):
    return weekly(spark, d).select("week_start", *W.CALENDAR_FEATURES)


@register("weekly_lags", _ALL + _FEATS + """
select week_start, revenue_lag_1, revenue_lag_2, revenue_lag_4, quantity_lag_1 from feats""")
def q_weekly_lags(spark, d):
    return weekly(spark, d).select("week_start", "revenue_lag_1", "revenue_lag_2", "revenue_lag_4", "quantity_lag_1")


_ROLL = ["rolling_revenue_4", "rolling_revenue_8", "rolling_quantity_4"]


@register("weekly_rolling", _ALL + _FEATS + f"select week_start, {_re(_ROLL)} from feats")
def q_weekly_rolling(spark, d):
    return _r6(weekly(spark, d).select("week_start", *_ROLL), _ROLL)


_HF = [f"{p}{c}" for c in _HIST for p in ("prev_", "rolling4_mean_", "rolling4_sum_")]


@register("weekly_history_features", _ALL + _FEATS + f"select week_start, {_re(_HF)} from feats")
def q_weekly_history(spark, d):
    return _r6(weekly(spark, d).select("week_start", *_HF), _HF)


@register("weekly_training_frame", _ALL + _FEATS + """
select week_start, weekly_revenue, round_even(rolling_revenue_8, 6) as rolling_revenue_8 from feats
where revenue_lag_1 is not null and revenue_lag_2 is not null and revenue_lag_4 is not null
  and rolling_revenue_4 is not null and rolling_revenue_8 is not null and quantity_lag_1 is not null
  and rolling_quantity_4 is not null""")
def q_weekly_training(spark, d):
    return _r6(W.training_frame(weekly(spark, d)).select("week_start", "weekly_revenue", "rolling_revenue_8"),
               ["rolling_revenue_8"])


_BRAND_WEEKLY = """bw as (
  select p_brand, cast(date_trunc('week', date) as date) as week_start,
         coalesce(cast(sum(cast(revenue as decimal(38,2))) as double), 0.0) as weekly_revenue,
         coalesce(sum(quantity), 0.0) as weekly_quantity
  from sales where date is not null group by 1, 2)"""


@register("brand_weekly_lags", Q.with_(Q.SALES, _BRAND_WEEKLY) + """
select p_brand, week_start, weekly_revenue,
       lag(weekly_revenue, 1) over (partition by p_brand order by week_start) as revenue_lag_1,
       round_even(case when count(weekly_revenue) over (partition by p_brand order by week_start rows between 4 preceding and 1 preceding) = 4
            then avg(weekly_revenue) over (partition by p_brand order by week_start rows between 4 preceding and 1 preceding) end, 6) as rolling_revenue_4
from bw""")
def q_brand_lags(spark, d):
    wk = W.weekly_features(sales(spark, d), (), ["p_brand"])
    return _r6(wk.select("p_brand", "week_start", "weekly_revenue", "revenue_lag_1", "rolling_revenue_4"),
               ["rolling_revenue_4"])


# ---------------------------------------------------------------------------
# Forecast path with the moving-average model (all SQL-checkable)
# ---------------------------------------------------------------------------

_SPLIT = """, usable as (
  select *, count(*) over () as usable_rows, row_number() over (order by week_start) as rn from feats
  where revenue_lag_1 is not null and revenue_lag_2 is not null and revenue_lag_4 is not null
    and rolling_revenue_4 is not null and rolling_revenue_8 is not null and quantity_lag_1 is not null
    and rolling_quantity_4 is not null),
split as (
  select *, cast(floor(usable_rows * 0.8) as bigint) as train_size,
         case when usable_rows < 10 then 'too_few_usable_rows'
              when floor(usable_rows * 0.8) < 4 or usable_rows - floor(usable_rows * 0.8) < 1 then 'split_too_small'
              else 'ok' end as status,
         case when rn <= floor(usable_rows * 0.8) then 'train' else 'test' end as split
  from usable),
ma as (
  select week_start, coalesce(avg(weekly_revenue) over (order by week_start rows between 4 preceding and 1 preceding), 0.0) as predicted
  from wk),
preds as (
  select s.week_start, s.weekly_revenue as actual, ma.predicted from split s join ma on s.week_start = ma.week_start
  where s.split = 'test' and s.status = 'ok'),
metrics as (
  select 'Moving Average Baseline' as model, avg(abs(actual - predicted)) as mae,
         sqrt(avg((actual - predicted) * (actual - predicted))) as rmse,
         avg(case when (abs(actual) + abs(predicted)) / 2 = 0 then 0.0
                  else abs(actual - predicted) / ((abs(actual) + abs(predicted)) / 2) end) * 100 as smape,
         avg(actual) as mean_actual, count(*) as test_rows
  from preds),
last4 as (select list(weekly_revenue order by week_start) as h, max(week_start) as lw
          from (select * from wk order by week_start desc limit 4) x),
rec as (select 0 as step, h, lw from last4
        union all
        select step + 1,
               list_append(h, greatest(0.0, ((((0.0 + h[len(h) - 3]) + h[len(h) - 2]) + h[len(h) - 1]) + h[len(h)]) / 4)),
               lw
        from rec where step < 12),
future as (select cast(step as integer) as step, cast(lw + to_days(cast(7 * step as integer)) as date) as week_start,
                  round_even(h[len(h)], 2) as future_forecast from rec where step > 0)"""


@register("train_test_split", _ALL + _FEATS + _SPLIT + """
select week_start, usable_rows, train_size, status, split from split""")
def q_split(spark, d):
    return L.train_test_split(weekly(spark, d)).select("week_start", "usable_rows", "train_size", "status", "split")


@register("moving_average_baseline", _ALL + _FEATS + _SPLIT + """
select week_start, actual, round_even(predicted, 6) as predicted from preds""")
def q_ma(spark, d):
    wk = weekly(spark, d)
    p = L.moving_average_predictions(wk, L.train_test_split(wk))
    return _r6(p.select("week_start", "actual", "predicted"), ["predicted"])


_MET = ["mae", "rmse", "smape", "relative_mae", "relative_rmse"]


@register("forecast_metrics", _ALL + _FEATS + _SPLIT + """
select model, round_even(mae, 6) as mae, round_even(rmse, 6) as rmse, round_even(smape, 6) as smape,
       round_even(case when mean_actual <> 0 then mae / mean_actual * 100 end, 6) as relative_mae,
       round_even(case when mean_actual <> 0 then rmse / mean_actual * 100 end, 6) as relative_rmse, test_rows
from metrics""")
def q_metrics(spark, d):
    wk = weekly(spark, d)
    m = L.forecast_metrics(L.moving_average_predictions(wk, L.train_test_split(wk)))
    return _r6(m, _MET)


@register("future_forecast_baseline", _ALL_REC + _FEATS + _SPLIT + "select step, week_start, future_forecast from future")
def q_future_baseline(spark, d):
    return L.future_forecast_baseline(weekly(spark, d))


@register("forecast_horizons", _ALL_REC + _FEATS + _SPLIT + """
select f.step, f.week_start, f.future_forecast, h.horizon
from future f, (values (1), (2), (4), (8), (12)) h(horizon) where f.step <= h.horizon""")
def q_horizons(spark, d):
    return L.forecast_horizons(L.future_forecast_baseline(weekly(spark, d)))


@register("previous_period", Q.with_(Q.SALES, _WEEKLY) + """,
r as (select weekly_revenue, row_number() over (order by week_start desc) as rn from wk)
select h.horizon, case when count(*) >= h.horizon then sum(weekly_revenue) end as previous_period_revenue
from r, (values (1), (2), (4), (8), (12)) h(horizon) where rn <= h.horizon group by h.horizon""")
def q_prev(spark, d):
    return L.previous_period(weekly(spark, d))


_SUM_COLS = ["total", "mean", "min", "max", "first", "last", "previous", "difference", "change_percent",
             "conservative", "expected", "optimistic", "adjustment_percent"]


@register("forecast_summary", _ALL_REC + _FEATS + _SPLIT + """,
hz as (select h.horizon, f.step, f.future_forecast from future f, (values (1), (2), (4), (8), (12)) h(horizon)
       where f.step <= h.horizon),
agg as (select horizon, count(future_forecast) as periods, sum(future_forecast) as total, avg(future_forecast) as mean,
               min(future_forecast) as "min", max(future_forecast) as "max",
               arg_min(future_forecast, step) as "first", arg_max(future_forecast, step) as "last"
        from hz group by horizon),
r as (select weekly_revenue, row_number() over (order by week_start desc) as rn from wk),
prev as (select h.horizon, case when count(*) >= h.horizon then sum(weekly_revenue) end as previous
         from r, (values (1), (2), (4), (8), (12)) h(horizon) where rn <= h.horizon group by h.horizon),
j as (select a.*, p.previous, coalesce(least(greatest(m.smape / 100, 0.0), 0.3), 0.0) as adj,
             case when a."first" = 0 then case when a."last" = 0 then 0.0 else 1.0 end
                  else (a."last" - a."first") / abs(a."first") end as rel
      from agg a left join prev p on a.horizon = p.horizon, metrics m)
select horizon, periods, round_even(total, 6) as total, round_even(mean, 6) as mean, round_even("min", 6) as "min",
       round_even("max", 6) as "max", round_even("first", 6) as "first", round_even("last", 6) as "last",
       round_even(previous, 6) as previous, round_even(total - previous, 6) as difference,
       round_even(case when previous <> 0 then (total - previous) / previous * 100 end, 6) as change_percent,
       round_even(total * (1 - adj), 6) as conservative, round_even(total, 6) as expected,
       round_even(total * (1 + adj), 6) as optimistic, round_even(adj * 100, 6) as adjustment_percent,
       case when periods = 0 then 'not_available' when horizon = 1 or periods = 1 then 'single_period'
            when rel > 0.05 then 'increasing' when rel < -0.05 then 'decreasing' else 'stable' end as direction
from j""")
def q_summary(spark, d):
    wk = weekly(spark, d)
    m = L.forecast_metrics(L.moving_average_predictions(wk, L.train_test_split(wk)))
    out = L.forecast_summary(L.future_forecast_baseline(wk), wk, m)
    return _r6(out, _SUM_COLS)


# ---------------------------------------------------------------------------
# Full model comparison (rows-only check: fitted models)
# ---------------------------------------------------------------------------

@register("feature_selection")
def q_selection(spark, d):
    wk = weekly(spark, d)
    return L.feature_selection(L.train_test_split(wk))


@register("ridge_forecast")
def q_ridge(spark, d):
    wk = weekly(spark, d)
    split = L.train_test_split(wk)
    return L.ridge_forecast(split, wk, L.feature_selection(split))


@register("model_comparison")
def q_comparison(spark, d):
    return L.run_weekly_forecast(weekly(spark, d))["comparison"]


@register("brand_forecast_summary")
def q_brand_summary(spark, d):
    wk = W.weekly_features(sales(spark, d), ["discount"], ["p_brand"], numeric_extras=["discount"])
    return L.run_weekly_forecast(wk, ["p_brand"])["summary"]




def _summary_sql():
    from .catalog import REGISTRY
    return REGISTRY["forecast_summary"].sql


@register("forecast_scenarios", "select horizon, conservative, expected, optimistic, adjustment_percent from ("
          + _summary_sql() + ") s")
def q_scenarios(spark, d):
    return q_summary(spark, d).select("horizon", "conservative", "expected", "optimistic", "adjustment_percent")


@register("forecast_trend", 'select horizon, periods, "first", "last", direction from (' + _summary_sql() + ") s")
def q_trend(spark, d):
    return q_summary(spark, d).select("horizon", "periods", "first", "last", "direction")


@register("forecast_series")
def q_forecast_series(spark, d):
    return L.run_weekly_forecast(weekly(spark, d))["series"]


@register("model_choice")
def q_model_choice(spark, d):
    return L.run_weekly_forecast(weekly(spark, d))["choice"]


@register("forest_forecast")
def q_forest(spark, d):
    """Random forest: test predictions and 12 future weeks."""
    wk = weekly(spark, d)
    split = L.train_test_split(wk)
    return L.forest_forecast(split, wk, L.feature_selection(split))


@register("future_forecast")
def q_future(spark, d):
    """12-week forecast of the model that wins."""
    return L.run_weekly_forecast(weekly(spark, d))["future"]


@register("forecast_series_horizons")
def q_series_horizons(spark, d):
    """Chart series cut at each horizon."""
    return L.series_horizons(L.run_weekly_forecast(weekly(spark, d))["series"])


@register("forecast_status", _ALL.replace("with ", "with ", 1) + _FEATS + """
select count(*) filter (weekly_revenue is not null and revenue_lag_1 is not null and revenue_lag_2 is not null
         and revenue_lag_4 is not null and rolling_revenue_4 is not null and rolling_revenue_8 is not null
         and quantity_lag_1 is not null and rolling_quantity_4 is not null) as usable_rows, 'ok' as status
from feats""")
def q_status(spark, d):
    return L.forecast_status(weekly(spark, d))
