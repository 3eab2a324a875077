"""Registered queries: profiling."""

from __future__ import annotations

from ..operators import profile as P
from ..functions.columns import DATE_FORMATS
from .base import DUP, KEY_COLUMNS, MESSY, MESSY_KEYED, ROW_ORDER, dup, messy, messy_keyed, per_column, query, r, rounded
from pyspark.sql import functions as F

MESSY_NAMES = ["l_returnflag", "l_linestatus", "l_linenumber", "qty", "price_txt", "ship_txt", "flag"]
MESSY_TYPES = ["string", "string", "int", "double", "string", "string", "string"]
MESSY_KINDS = ["categorical", "categorical", "numerical", "numerical", "categorical", "categorical", "categorical"]
TEXT = [n for n, k in zip(MESSY_NAMES, MESSY_KINDS) if k == "categorical"]

# The same date layouts in strptime notation.
STRPTIME = {
    "yyyy": "%Y", "MM": "%m", "dd": "%d", "HH": "%H", "mm": "%M", "ss": "%S",
}


def strptime(fmt: str) -> str:
    if "MMM" in fmt:
        return fmt.replace("MMM", "%b").replace("yyyy", "%Y").replace("d", "%-d")
    for k, v in STRPTIME.items():
        fmt = fmt.replace(k, v)
    return fmt.replace("'", "")


NUMBER_SQL = (
    "case when regexp_matches(regexp_replace({x}, '[,%$+]', '', 'g'), "
    "'^\\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\\s*$') "
    "then try_cast(regexp_replace({x}, '[,%$+]', '', 'g') as double) end"
)

UNIQUE_SQL = per_column("select '{c}' as \"column\", count(distinct {c}) as \"unique\" from messy", MESSY_NAMES)
MISSING_SQL = per_column("select '{c}' as \"column\", count(*) - count({c}) as missing from messy", MESSY_NAMES)

SAMPLES_SQL = per_column(
    "select * from (select '{c}' as \"column\", {c} as v from messy_keyed where {c} is not null order by "
    + ", ".join(ROW_ORDER)
    + " limit 50)",
    TEXT,
)
RATES = ", ".join(
    f"avg(case when try_strptime(v, '{strptime(f)}') is not null then 1.0 else 0.0 end) as f{i}"
    for i, f in enumerate(DATE_FORMATS)
)
BEST = "greatest(" + ", ".join(f"f{i}" for i in range(len(DATE_FORMATS))) + ")"
WINNER = "case " + " ".join(
    f"when f{i} = {BEST} then '{f.replace(chr(39), chr(39) * 2)}'" for i, f in enumerate(DATE_FORMATS)
) + " end"
DATES_SQL = (
    f"samples as ({SAMPLES_SQL}), rates as (select \"column\", {RATES} from samples group by 1), "
    f"dates as (select \"column\", {WINNER} as format, {r(BEST)} as success_rate from rates where {BEST} >= 0.8)"
)
NUMBERS_SQL = (
    f"nums as (select \"column\", {r('avg(case when (' + NUMBER_SQL.format(x='v') + ') is not null then 1.0 else 0.0 end)')} "
    "as success_rate from samples group by 1 having avg(case when ("
    + NUMBER_SQL.format(x="v")
    + ") is not null then 1.0 else 0.0 end) > 0.9)"
)

DUPLICATES = "(select count(*) from {t}) - (select count(*) from (select distinct * from {t}))"
TOTAL_MISSING = "(" + " + ".join(f"(count(*) - count({c}))" for c in MESSY_NAMES) + ")"


@query(
    "profile_summary",
    f"with {MESSY} select count(*) as \"rows\", {len(MESSY_NAMES)} as \"columns\", "
    f"{DUPLICATES.format(t='messy')} as duplicate_rows, {TOTAL_MISSING} as total_missing from messy",
)
def _(t):
    return P.profile_summary(messy(t))


@query("duplicate_rows", f"with {DUP} select {DUPLICATES.format(t='dup')} as duplicate_rows")
def _(t):
    return P.duplicate_rows(dup(t))


@query("missing_by_column", f"with {MESSY} {MISSING_SQL}")
def _(t):
    return P.missing_by_column(messy(t))


@query("missing_summary", f"with {MESSY} select * from ({MISSING_SQL}) where missing > 0")
def _(t):
    return P.missing_summary(messy(t))


@query("unique_values", f"with {MESSY} {UNIQUE_SQL}")
def _(t):
    return P.unique_values(messy(t))


@query(
    "column_kinds",
    f"with {MESSY} "
    + " union all ".join(
        f"select '{c}' as \"column\", {i} as ordinal, '{ty}' as type, '{k}' as kind, count({c}) as non_missing from messy"
        for i, (c, ty, k) in enumerate(zip(MESSY_NAMES, MESSY_TYPES, MESSY_KINDS))
    ),
)
def _(t):
    return P.column_kinds(messy(t))


@query(
    "dtype_summary",
    "select kind, count(name) as columns from (values ('numerical'), ('categorical'), ('datetime')) k(kind) left join "
    "(select column_name as name, case when column_type in ('BIGINT', 'INTEGER', 'DOUBLE') then 'numerical' "
    "when column_type = 'VARCHAR' then 'categorical' when column_type = 'TIMESTAMP' then 'datetime' end as c_kind "
    "from (describe select * from lineitem)) on c_kind = kind group by kind",
)
def _(t):
    return P.dtype_summary(t.lineitem)


@query("binary_columns", f"with {MESSY} select \"column\" from ({UNIQUE_SQL}) where \"unique\" = 2")
def _(t):
    return P.binary_columns(messy(t))


@query("low_cardinality", f"with {MESSY} select * from ({UNIQUE_SQL}) where \"unique\" <= 10")
def _(t):
    return P.low_cardinality(messy(t))


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query(
    "high_cardinality",
    "select \"column\", \"unique\" from ("
    + per_column("select '{c}' as \"column\", count(distinct {c}) as \"unique\", count(*) as n from orders", ORDER_COLUMNS)
    + ") where \"unique\" / n > 0.5",
)
def _(t):
    return P.high_cardinality(t.orders)


@query("date_candidates", f"with {MESSY_KEYED}, {DATES_SQL} select * from dates")
def _(t):
    return rounded(P.date_candidates(messy_keyed(t), ROW_ORDER))


@query("numeric_like_text", f"with {MESSY_KEYED}, samples as ({SAMPLES_SQL}), {NUMBERS_SQL} select * from nums")
def _(t):
    return rounded(P.numeric_like_text(messy_keyed(t), ROW_ORDER))


@query(
    "inspect_dataset",
    f"with {MESSY} select count(*) as \"rows\", {len(MESSY_NAMES)} as \"columns\", '{','.join(MESSY_NAMES)}' as columns_list, "
    f"'{','.join(f'{c}:{ty}' for c, ty in zip(MESSY_NAMES, MESSY_TYPES))}' as dtypes, {TOTAL_MISSING} as missing_values from messy",
)
def _(t):
    pairs = F.transform(F.map_entries("dtypes"), lambda e: F.concat_ws(":", e["key"], e["value"]))
    return P.inspect_dataset(messy(t)).withColumns(
        {"columns_list": F.array_join("columns_list", ","), "dtypes": F.array_join(pairs, ",")}
    )


ALL_NAMES = KEY_COLUMNS + MESSY_NAMES
ALL_TYPES = ["bigint", "bigint", "bigint"] + MESSY_TYPES
ALL_KINDS = ["numerical"] * 3 + MESSY_KINDS


def profile_sql(table: str, names: list[str], types: list[str], kinds: list[str], dates: str, nums: str) -> str:
    facts = " union all ".join(
        f"select '{c}' as \"column\", {i} as ordinal, '{ty}' as type, '{k}' as kind, count(*) as \"rows\", "
        f"count(*) - count({c}) as missing, count(distinct {c}) as \"unique\" from {table}"
        for i, (c, ty, k) in enumerate(zip(names, types, kinds))
    )
    return (
        f"select f.\"column\", ordinal, type, kind, \"rows\", missing, \"unique\", \"unique\" = 2 as is_binary, "
        "d.format is not null as is_date_candidate, d.format as date_format, n.success_rate is not null as is_numeric_like, "
        "\"unique\" <= 10 as is_low_cardinality, \"unique\" / \"rows\" > 0.5 as is_high_cardinality "
        f"from ({facts}) f left join {dates} d on d.\"column\" = f.\"column\" left join {nums} n on n.\"column\" = f.\"column\""
    )


@query(
    "column_profile",
    f"with {MESSY_KEYED}, {DATES_SQL}, {NUMBERS_SQL} " + profile_sql("messy_keyed", ALL_NAMES, ALL_TYPES, ALL_KINDS, "dates", "nums"),
)
def _(t):
    return P.column_profile(messy_keyed(t), ROW_ORDER)
