"""Registered queries: exploratory statistics."""

from __future__ import annotations

from itertools import permutations

from ..operators import correlation as R, eda as E
from .base import MESSY, MESSY_KEYED, messy, messy_keyed, query, r, rounded
from .profiling import MESSY_KINDS, MESSY_NAMES, MESSY_TYPES, TEXT

NUMBERS = [c for c, k in zip(MESSY_NAMES, MESSY_KINDS) if k == "numerical"]


def top_sql(c: str, table: str = "messy") -> str:
    return f"(select v from (select {c} as v, count(*) as n from {table} where {c} is not null group by 1 order by n desc, v limit 1))"


def freq_sql(c: str, table: str = "messy") -> str:
    return f"(select max(n) from (select count(*) as n from {table} where {c} is not null group by {c}))"


def describe_sql(extra: bool) -> str:
    parts = []
    for i, (c, ty, k) in enumerate(zip(MESSY_NAMES, MESSY_TYPES, MESSY_KINDS)):
        head = f"'{c}' as \"column\", {i} as ordinal, count({c}) as \"count\""
        if extra:
            head += (
                f", '{ty}' as type, count(*) - count({c}) as missing_count, "
                f"{r(f'(count(*) - count({c})) * 100.0 / count(*)')} as missing_pct"
            )
        if k == "numerical":
            unique = f"count(distinct {c})" if extra else "null"
            tail = (
                f"{r(f'avg({c})')} as mean, {r(f'stddev_samp({c})')} as std, cast(min({c}) as double) as \"min\", "
                + ", ".join(f"{r(f'quantile_cont({c}, {p})')} as {n}" for n, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)))
                + f", cast(max({c}) as double) as \"max\", null as top, null as freq"
            )
        else:
            unique = f"count(distinct {c})"
            tail = (
                "null as mean, null as std, null as \"min\", null as p25, null as p50, null as p75, null as \"max\", "
                f"{top_sql(c)} as top, {freq_sql(c)} as freq"
            )
        parts.append(f"select {head}, {unique} as \"unique\", {tail} from messy")
    return f"with {MESSY} " + " union all ".join(parts)


@query("summary_statistics", describe_sql(True))
def _(t):
    return rounded(E.summary_statistics(messy(t)))


@query("describe_all", describe_sql(False))
def _(t):
    return rounded(E.describe_all(messy(t)))


@query(
    "top_freq",
    f"with {MESSY} "
    + " union all ".join(f"select '{c}' as \"column\", {top_sql(c)} as top, {freq_sql(c)} as freq" for c in TEXT),
)
def _(t):
    return E.top_freq(messy(t))


CORR_COLUMNS = ["l_linenumber", "l_discount", "l_tax", "qty", "l_extendedprice"]
CORR_VIEW = (
    "nums as (select l_linenumber, l_discount, l_tax, case when l_partkey % 7 = 0 then null else l_quantity end as qty, "
    "l_extendedprice from lineitem)"
)


def corr_frame(t):
    return t.lineitem.selectExpr(
        "l_linenumber", "l_discount", "l_tax", "case when l_partkey % 7 = 0 then null else l_quantity end as qty", "l_extendedprice"
    )


def pearson_sql(columns, table):
    diagonal = [f"select '{c}' as column_a, '{c}' as column_b, 1.0 as correlation" for c in columns]
    cells = [
        f"select '{a}' as column_a, '{b}' as column_b, {r(f'corr({a}, {b})')} as correlation from {table}"
        for a, b in permutations(columns, 2)
    ]
    return " union all ".join(diagonal + cells)


@query("corr_matrix", f"with {CORR_VIEW} {pearson_sql(CORR_COLUMNS, 'nums')}")
def _(t):
    return rounded(R.corr_matrix(corr_frame(t)))


RANK_COLUMNS = ["l_linenumber", "l_discount", "qty", "l_extendedprice"]


def spearman_cell(a: str, b: str) -> str:
    return (
        f"select '{a}' as column_a, '{b}' as column_b, {r('corr(ra, rb)')} as correlation from (select "
        f"rank() over (order by {a}) + (count(*) over (partition by {a}) - 1) / 2.0 as ra, "
        f"rank() over (order by {b}) + (count(*) over (partition by {b}) - 1) / 2.0 as rb "
        f"from nums where {a} is not null and {b} is not null)"
    )


@query(
    "corr_spearman",
    f"with {CORR_VIEW} "
    + " union all ".join(
        [f"select '{c}' as column_a, '{c}' as column_b, 1.0 as correlation" for c in RANK_COLUMNS]
        + [spearman_cell(a, b) for a, b in permutations(RANK_COLUMNS, 2)]
    ),
)
def _(t):
    return rounded(R.corr_spearman(corr_frame(t), RANK_COLUMNS))


KENDALL_COLUMNS = ["l_linenumber", "l_discount", "qty"]


def kendall_cell(a: str, b: str) -> str:
    cells = f"(select {a} as a, {b} as b, cast(count(*) as double) as n from nums where {a} is not null and {b} is not null group by 1, 2)"
    return (
        f"select '{a}' as column_a, '{b}' as column_b, {r('s / sqrt((n0 - n1) * (n0 - n2))')} as correlation from (select "
        f"(select sum(case when (p.a < q.a) = (p.b < q.b) then p.n * q.n else -p.n * q.n end) / 2 from {cells} p join {cells} q "
        "on p.a <> q.a and p.b <> q.b) as s, "
        f"(select sum(n) * (sum(n) - 1) / 2 from {cells}) as n0, "
        f"(select sum(m * (m - 1) / 2) from (select sum(n) as m from {cells} group by a)) as n1, "
        f"(select sum(m * (m - 1) / 2) from (select sum(n) as m from {cells} group by b)) as n2)"
    )


@query(
    "corr_kendall",
    f"with {CORR_VIEW} "
    + " union all ".join(
        [f"select '{c}' as column_a, '{c}' as column_b, 1.0 as correlation" for c in KENDALL_COLUMNS]
        + [kendall_cell(a, b) for a, b in permutations(KENDALL_COLUMNS, 2)]
    ),
)
def _(t):
    return rounded(R.corr_kendall(corr_frame(t), KENDALL_COLUMNS))


TOP_COLUMNS = CORR_COLUMNS


@query(
    "top_correlations",
    f"with {CORR_VIEW}, m as ({pearson_sql(TOP_COLUMNS, 'nums')}), once as (select * from m where column_a < column_b) "
    "select * from (select * from once where correlation > 0 order by correlation desc, column_a, column_b limit 5) union all "
    "select * from (select * from once where correlation < 0 order by correlation, column_a, column_b limit 5)",
)
def _(t):
    return rounded(R.top_correlations(R.corr_matrix(corr_frame(t))))


@query(
    "matrix_export",
    f"with {CORR_VIEW}, m as ({pearson_sql(CORR_COLUMNS, 'nums')}) select column_a as \"column\", "
    + ", ".join(f"max(case when column_b = '{c}' then correlation end) as {c}" for c in CORR_COLUMNS)
    + " from m group by 1",
)
def _(t):
    from ..session import scratch_path
    from ..sources import tables

    path = scratch_path(t.spark, "matrix")
    return tables.matrix_export(rounded(R.corr_matrix(corr_frame(t))), CORR_COLUMNS, path)


def histogram_sql(c: str, table: str, label: str | None = None) -> str:
    return (
        f"select '{label or c}' as \"column\", b as bin, {r('lo + b * w')} as lower, {r('lo + (b + 1) * w')} as upper, "
        f"(select count(*) from {table} where {c} is not null and least(floor(({c} - lo) / w), 29) = b) as \"count\" from "
        f"(select min({c}) as lo, (max({c}) - min({c})) / 30.0 as w from {table}), (select unnest(range(30))::int as b)"
    )


@query("histogram", f"with {CORR_VIEW} " + " union all ".join(histogram_sql(c, "nums") for c in ["qty", "l_extendedprice", "l_discount"]))
def _(t):
    return rounded(E.histogram(corr_frame(t), ["qty", "l_extendedprice", "l_discount"]))


@query("skewness", f"with {CORR_VIEW} " + " union all ".join(f"select '{c}' as \"column\", {r(f'skewness({c})')} as skewness from nums" for c in CORR_COLUMNS))
def _(t):
    return rounded(E.skewness(corr_frame(t)))


@query(
    "log_histogram",
    "select \"column\" || '_log' as \"column\", bin, lower, upper, \"count\", "
    f"case when \"count\" > 0 then {r('log10(\"count\")')} end as log_count from ({histogram_sql('value', 'events')}) "
    "where (select abs(skewness(value)) > 1 from events)",
)
def _(t):
    return rounded(E.log_histogram(t.events.select("user_id", "value")))


BOX = ["qty", "l_extendedprice"]


def fences_sql(c: str, table: str) -> str:
    return (
        f"(select q1, q2, q3, q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from (select quantile_cont({c}, 0.25) as q1, "
        f"quantile_cont({c}, 0.5) as q2, quantile_cont({c}, 0.75) as q3 from {table}))"
    )


@query(
    "boxplot_stats",
    " union all ".join(
        f"select '{c}' as \"column\", {r('any_value(q1)')} as q1, {r('any_value(q2)')} as median, {r('any_value(q3)')} as q3, "
        f"{r('any_value(lo)')} as lower_fence, {r('any_value(hi)')} as upper_fence, "
        f"{r(f'min({c}) filter ({c} between lo and hi)')} as lower_whisker, {r(f'max({c}) filter ({c} between lo and hi)')} as upper_whisker, "
        f"count(*) filter ({c} < lo or {c} > hi) as outliers from events, {fences_sql(c, 'events')}"
        for c in ["user_id", "value"]
    ),
)
def _(t):
    return rounded(E.boxplot_stats(t.events.select("user_id", "value")))


@query(
    "boxplot_outliers",
    f"select 'value' as \"column\", {r('value')} as \"value\" from events, {fences_sql('value', 'events')} where value < lo or value > hi",
)
def _(t):
    return rounded(E.boxplot_outliers(t.events.select("user_id", "value")))


PATTERN_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


@query(
    "missing_pattern_sample",
    f"with {MESSY_KEYED} select {', '.join(PATTERN_KEY)}, "
    + ", ".join(f"({c} is null)::int as {c}" for c in ["qty", "price_txt", "ship_txt", "flag"])
    + " from messy_keyed order by substr(md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber)), 1, 8), "
    + ", ".join(PATTERN_KEY)
    + " limit 200",
)
def _(t):
    return E.missing_pattern_sample(messy_keyed(t), PATTERN_KEY)


@query("target_distribution", "select o_orderstatus as value, count(*) as \"count\" from orders group by 1")
def _(t):
    return E.target_distribution(t.orders, "o_orderstatus")


@query("target_distribution_numeric", histogram_sql("o_totalprice", "orders"))
def _(t):
    return rounded(E.target_distribution(t.orders, "o_totalprice"))


@query(
    "kde",
    f"with s as (select count(value) as n, stddev_samp(value) * pow(count(value), -0.2) as h, min(value) as lo, "
    "(max(value) - min(value)) / 199 as step from events), v as (select value, count(*) as c from events group by 1) "
    f"select b as point, {r('lo + b * step', 7)} as x, {r('(select sum(c * exp(-0.5 * pow((lo + b * step - value) / h, 2))) from v) / (n * h * sqrt(2 * pi()))', 7)} "
    "as density from s, (select unnest(range(200))::int as b)",
)
def _(t):
    return rounded(E.kde(t.events, "value"), 7)
