"""Registered queries: task detection, suitability and sentences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as C, evaluate as V, profile as P, tasks as T
from .base import ROW_ORDER, messy_keyed, per_column, query
from .cleaning import CLEAN_SQL
from .profiling import ALL_KINDS, ALL_NAMES, ALL_TYPES, DATES_SQL, DUPLICATES, NUMBERS_SQL, profile_sql

PROFILE = (
    f"{CLEAN_SQL}, {DATES_SQL}, {NUMBERS_SQL}, "
    f"prof as ({profile_sql('messy_keyed', ALL_NAMES, ALL_TYPES, ALL_KINDS, 'dates', 'nums')})"
)
IS_DATE = "(is_date_candidate or kind = 'datetime')"
IS_NUMBER = "kind in ('numerical', 'boolean')"
TASKS = (
    f"tasks as (select \"column\" as target, case when {IS_DATE} then 'unknown' "
    f"when {IS_NUMBER} and (select count(*) from prof where {IS_DATE}) >= 1 and (select count(*) from prof where {IS_DATE}) = "
    "(select count(*) from prof) - 1 then 'forecasting' "
    "when kind = 'categorical' and not is_high_cardinality then 'classification' "
    f"when {IS_NUMBER} and \"unique\" <= 20 then 'classification' when {IS_NUMBER} then 'regression' else 'unknown' end as task, "
    f"ordinal = (select min(ordinal) from prof where not {IS_DATE}) as is_default, kind, \"rows\", \"unique\" from prof)"
)


def profile(t):
    return P.column_profile(messy_keyed(t), ROW_ORDER)


@query("detect_task", f"with {PROFILE}, {TASKS} select * from tasks")
def _(t):
    return T.detect_task(profile(t))


@query(
    "task_metadata",
    f"with {PROFILE}, {TASKS} select target, task, case when task = 'classification' then case when kind = 'categorical' or "
    "\"unique\" <= 5 then 'High' else 'Medium' end when task = 'regression' then case when \"unique\" / \"rows\" > 0.5 then 'High' "
    "else 'Medium' end when task = 'forecasting' then 'Medium' else 'Low' end as confidence, "
    "case when task = 'classification' and kind = 'categorical' then 'Target column ''' || target || ''' is categorical with ' || \"unique\" || ' unique values.' "
    "when task = 'classification' and \"unique\" <= 5 then 'Target column ''' || target || ''' contains only ' || \"unique\" || "
    "' unique numeric values, treated as class labels.' "
    "when task = 'classification' then 'Target column ''' || target || ''' contains ' || \"unique\" || "
    "' unique values and was classified using the low-cardinality rule (≤20 unique).' "
    "when task = 'regression' then 'Target column ''' || target || ''' is numeric with ' || \"unique\" || ' unique values out of ' || \"rows\" || ' rows.' "
    "when task = 'forecasting' then 'Target column ''' || target || ''' is numeric and the dataset structure indicates a time-series.' "
    "else 'Could not determine a supported task type for target ''' || target || '''.' end as reason from tasks",
)
def _(t):
    return T.task_metadata(T.detect_task(profile(t)))


ORDER_NAMES = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
SUITABLE = (
    "with d as (select count(distinct o_orderdate) as n from orders), c as ("
    + per_column("select '{c}' as target", ORDER_NAMES)
    + "), k as (select target, target not in ('o_orderstatus', 'o_orderdate', 'o_orderpriority') as number from c) "
)


@query(
    "forecast_suitability",
    SUITABLE
    + "select target, case when number and n >= 100 then 'High' when number and n >= 30 then 'Medium' else 'Low' end as suitability, "
    "case when not number then 'Target column ''' || target || ''' is not numeric. Forecasting requires a numeric target.' "
    "when n < 10 then 'Datetime information exists but does not appear to represent a continuous time series.' "
    "else 'Datetime column detected: o_orderdate. Numeric target selected: ' || target || '. ' || n || ' chronological observations available.' "
    "end as reason, case when number and n >= 10 then 'o_orderdate' end as date_column from k, d",
)
def _(t):
    df = t.orders
    return T.forecast_suitability(P.column_profile(df, ["o_orderkey"]), T.date_uniques(df, {}))


HIGH = "(select string_agg(\"column\", ', ' order by ordinal) from prof where is_high_cardinality)"
MISSING = "(select sum(missing) from prof)"
REMAINING = "(select cast(sum(" + " + ".join(f"case when {c} is null then 1 else 0 end" for c in ALL_NAMES) + ") as bigint) from cleaned)"


def sentences(category: str, parts: list[str]) -> str:
    union = " union all ".join(f"select {i} as o, {p} as insight" for i, p in enumerate(parts))
    return (
        f"select '{category}' as category, cast(row_number() over (order by o) - 1 as int) as position, insight "
        f"from ({union}) where insight is not null"
    )


@query(
    "insights_dataset",
    f"with {PROFILE} "
    + sentences(
        "dataset",
        [
            f"(select 'The dataset contains ' || count(*) || ' rows and {len(ALL_NAMES)} columns.' from messy_keyed)",
            f"(select case when dups > 0 then 'Removed ' || dups || ' duplicate rows to improve data quality.' end from (select {DUPLICATES.format(t='messy_keyed')} as dups))",
            f"(select case when {MISSING} > 0 then 'Detected ' || {MISSING} || ' missing values initially.' else 'The dataset is completely free of missing values.' end)",
            f"(select case when {MISSING} > 0 and {REMAINING} = 0 then 'All missing values were successfully imputed.' end)",
            f"(select 'High-cardinality columns detected (many unique values): ' || {HIGH} || '.')",
        ],
    ),
)
def _(t):
    df = messy_keyed(t)
    plan = C.plan_cleaning(df, ROW_ORDER)
    return T.insights_dataset(profile(t), P.profile_summary(df), C.cleaning_report(df, plan))


@query(
    "insights_eda",
    f"with {PROFILE} "
    + sentences(
        "eda",
        [
            "(select 'Feature breakdown: ' || count(*) filter (kind = 'numerical') || ' numerical features and ' || count(*) filter (kind = 'categorical') || ' categorical features.' from prof)",
            "(select 'Binary/Boolean features identified: ' || string_agg(\"column\", ', ' order by ordinal) || '.' from prof where is_binary)",
            "'Automatically parsed datetime features: ship_txt.'",
            "'Cleaned and converted text columns to numeric: price_txt.'",
        ],
    ),
)
def _(t):
    df = messy_keyed(t)
    return T.insights_eda(profile(t), C.cleaning_report(df, C.plan_cleaning(df, ROW_ORDER)))


@query(
    "insights_model",
    "with s as (select avg(case when p = o_orderstatus then 1.0 else 0.0 end) as acc from (select *, "
    "case when o_totalprice > 300000 then 'F' when o_totalprice > 150000 then 'O' else 'P' end as p from orders)), "
    "c as (select k, count(*) filter (o_orderstatus = k) as support, count(*) filter (o_orderstatus = k and p = k) as hits, "
    "count(*) filter (p = k) as predicted from (select *, case when o_totalprice > 300000 then 'F' when o_totalprice > 150000 then 'O' else 'P' end as p from orders), "
    "(values ('F'), ('O'), ('P')) l(k) group by k), f as (select sum(support * 2.0 * hits / (support + predicted)) / sum(support) as f1 from c) "
    + sentences(
        "model",
        [
            "'The Price rule algorithm achieved the highest overall performance.'",
            "(select 'The model successfully predicts the correct category ' || printf('%.1f', acc * 100) || '% of the time.' from s)",
            "(select 'F1 Score (balance of precision and recall) is ' || printf('%.3f', f1) || '.' from f)",
        ],
    ),
)
def _(t):
    rule = F.expr("case when o_totalprice > 300000 then 'F' when o_totalprice > 150000 then 'O' else 'P' end")
    scored = t.orders.select(F.lit("Price rule").alias("model"), F.col("o_orderstatus").alias("y_true"), rule.alias("y_pred"))
    return T.insights_model(V.scored_metrics(scored, "classification"))
