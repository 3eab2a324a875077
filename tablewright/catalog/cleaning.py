"""Registered queries: cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as C
from .base import DUP, MESSY, MESSY_KEYED, ROW_ORDER, dup, messy, messy_keyed, query, r, rounded
from .profiling import ALL_NAMES, DUPLICATES, NUMBER_SQL

DATE_SQL = "try_strptime({x}, '%Y-%m-%d')"


def mode_sql(column: str, table: str) -> str:
    return f"(select {column} from {table} where {column} is not null group by 1 order by count(*) desc, 1 limit 1)"


@query("drop_duplicates", f"with {DUP} select distinct * from dup")
def _(t):
    return C.drop_duplicates(dup(t))


@query(
    "numeric_coerce",
    f"with {MESSY} select l_returnflag, {NUMBER_SQL.format(x='price_txt')} as price_txt, count(*) as n from messy group by 1, 2",
)
def _(t):
    return C.numeric_coerce(messy(t), ["price_txt"]).groupBy("l_returnflag", "price_txt").agg(F.count(F.lit(1)).alias("n"))


@query(
    "date_coerce",
    f"with {MESSY} select l_returnflag, {DATE_SQL.format(x='ship_txt')} as ship_txt, count(*) as n from messy group by 1, 2",
)
def _(t):
    return C.date_coerce(messy(t), {"ship_txt": "yyyy-MM-dd"}).groupBy("l_returnflag", "ship_txt").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "median_impute",
    f"with {DUP} select l_returnflag, l_linestatus, l_linenumber, coalesce(qty, (select median(qty) from dup)) as qty from dup",
)
def _(t):
    return C.median_impute(dup(t))


@query(
    "mode_impute",
    f"with {MESSY} select l_linenumber, coalesce(flag, {mode_sql('flag', 'messy')}) as flag, "
    f"coalesce(price_txt, {mode_sql('price_txt', 'messy')}) as price_txt, "
    f"coalesce(ship_txt, {mode_sql('ship_txt', 'messy')}) as ship_txt from messy",
)
def _(t):
    return C.mode_impute(messy(t)).select("l_linenumber", "flag", "price_txt", "ship_txt")


@query("mean_impute", f"with {DUP} select l_returnflag, l_linestatus, l_linenumber, "
       f"{r('coalesce(qty, (select avg(qty) from dup))')} as qty from dup")
def _(t):
    return rounded(C.mean_impute(dup(t)))


@query(
    "mode_or_unknown_impute",
    f"with {MESSY} select l_linenumber, coalesce(flag, {mode_sql('flag', 'messy')}) as flag, 'Unknown' as nothing, "
    f"coalesce(ship_txt, {mode_sql('ship_txt', 'messy')}) as ship_txt from messy",
)
def _(t):
    df = messy(t).withColumn("nothing", F.when(F.col("l_linenumber") < 0, F.col("flag")))
    return C.mode_or_unknown_impute(df).select("l_linenumber", "flag", "nothing", "ship_txt")


@query("drop_missing_target", f"with {MESSY} select * from messy where qty is not null")
def _(t):
    return C.drop_missing_target(messy(t), "qty")


CLEAN_SQL = (
    f"{MESSY_KEYED}, d as (select distinct * from messy_keyed), "
    f"c as (select * replace ({NUMBER_SQL.format(x='price_txt')} as price_txt, {DATE_SQL.format(x='ship_txt')} as ship_txt) from d), "
    "cleaned as (select * replace (coalesce(qty, (select median(qty) from c)) as qty, "
    "coalesce(price_txt, (select median(price_txt) from c)) as price_txt, "
    f"coalesce(ship_txt, {mode_sql('ship_txt', 'c')}) as ship_txt, coalesce(flag, {mode_sql('flag', 'c')}) as flag) from c)"
)


@query("clean_dataset", f"with {CLEAN_SQL} select * from cleaned")
def _(t):
    return C.clean_dataset(messy_keyed(t), order_by=ROW_ORDER)


@query(
    "cleaning_report",
    f"with {CLEAN_SQL} select {DUPLICATES.format(t='messy_keyed')} as duplicates_removed, 'price_txt' as numeric_converted, "
    "'ship_txt' as date_converted, cast(sum("
    + " + ".join(f"case when {c} is null then 1 else 0 end" for c in ALL_NAMES)
    + ") as bigint) as remaining_missing, count(*) as rows_after_cleaning from cleaned",
)
def _(t):
    report = C.cleaning_report(messy_keyed(t), order_by=ROW_ORDER)
    return report.withColumns(
        {c: F.array_join(c, ",") for c in ("numeric_converted", "date_converted")}
    )
