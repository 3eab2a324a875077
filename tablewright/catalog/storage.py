"""Registered queries: sources, sinks, run tables and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import is_missing, sanitized_name
from ..operators import profile as P
from ..operators.clean import drop_duplicates
from ..session import scratch_path
from ..sources import csv, reports, runs, warehouse
from .base import MESSY, messy, query, r, rounded
from .evaluation import CANDIDATES, candidates
from .profiling import MESSY_NAMES


@query("csv_scan", "select * from orders")
def _(t):
    path = scratch_path(t.spark, "csv")
    csv.csv_sink(t.orders, path)
    return csv.csv_scan(t.spark, path, t.orders.schema)


@query("csv_scan_line_breaks", "select doc_id, nullif(text, '') as text, lang, source, n_chars from documents")
def _(t):
    path = scratch_path(t.spark, "csv")
    docs = t.documents.select("doc_id", "text", "lang", "source", "n_chars")
    csv.csv_sink(docs, path)
    return csv.csv_scan(t.spark, path, docs.schema)


TOKEN_TEXT = (
    "case when l_partkey % 7 = 0 then 'NA' when l_partkey % 7 = 1 then 'n/a' when l_partkey % 7 = 2 then '' "
    "when l_partkey % 7 = 3 then 'nan' when l_partkey % 7 = 4 then 'NONE' else l_returnflag end"
)


@query(
    "na_token_normalise",
    f"select l_orderkey, case when l_partkey % 7 in (0, 1, 2, 3) then null else {TOKEN_TEXT} end as token from lineitem",
)
def _(t):
    return csv.na_token_normalise(t.lineitem.selectExpr("l_orderkey", f"{TOKEN_TEXT} as token"))


TYPED = [
    "cast(l_linenumber as string) as whole",
    "cast(l_discount as string) as fraction",
    "case when l_tax > 0.04 then 'True' else 'false' end as flag",
    "case when l_partkey % 5 = 0 then null else cast(l_suppkey as string) end as holed",
    "l_returnflag as letters",
]


@query(
    "infer_column_types",
    "select l_linenumber::bigint as whole, l_discount as fraction, l_tax > 0.04 as flag, "
    "case when l_partkey % 5 = 0 then null else l_suppkey end as holed, l_returnflag as letters from lineitem",
)
def _(t):
    return csv.infer_column_types(t.lineitem.selectExpr(*TYPED))


@query("preview_head", "select * from orders order by o_orderkey limit 5")
def _(t):
    return csv.preview_head(t.orders, order_by=["o_orderkey"])


@query("csv_sink", "select *, true as saved from customer")
def _(t):
    path = scratch_path(t.spark, "csv")
    saved = csv.csv_sink(t.customer, path)
    return csv.read_table(t.spark, path).withColumns(
        {"c_nationkey": F.col("c_nationkey").cast("int"), "saved": F.lit(saved)}
    )


# Run documents derived from customers; a negative balance stands for a document cut short.
RUN_DOCUMENT = (
    "concat('{\"run_id\": \"', c_name, '\", \"dataset_name\": \"', c_mktsegment, '\", \"prediction_count\": ', cast(c_nationkey as string), "
    "', \"best_model\": null', case when c_acctbal < 0 then '' else '}' end)"
)


@query(
    "run_metadata_scan",
    "select c_name as run_id, c_mktsegment as dataset_name, cast(c_nationkey as bigint) as prediction_count from customer where c_acctbal >= 0",
)
def _(t):
    path = scratch_path(t.spark, "documents")
    t.customer.selectExpr(f"{RUN_DOCUMENT} as value").write.text(f"{path}/runs")
    found = runs.run_metadata_scan(t.spark, path, "*/*.txt", multiline=False)
    return found.select("run_id", "dataset_name", "prediction_count")


# Order lines as update events of the run their order stands for.
EVENT_COLUMNS = [
    "concat('run_', cast(l_orderkey as string)) as run_id",
    "l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey as seq",
    "case when l_returnflag = 'R' then 'regression' when l_returnflag = 'A' then 'classification' end as task_type",
    "case when l_discount > 0.05 then concat('model_', cast(l_suppkey as string)) end as best_model",
    "case when l_tax > 0.04 then l_partkey end as prediction_count",
    "case when l_linestatus = 'O' then true end as forecast_enabled",
]
LAST = "max_by({c}, case when {c} is not null then seq end)"


@query(
    "run_log_merge",
    f"with e as (select {', '.join(EVENT_COLUMNS)} from lineitem) select run_id, {LAST.format(c='task_type')} as task_type, "
    f"{LAST.format(c='best_model')} as best_model, coalesce({LAST.format(c='prediction_count')}, 0) as prediction_count, "
    f"coalesce({LAST.format(c='forecast_enabled')}, false) as forecast_enabled from e group by 1",
)
def _(t):
    return runs.run_log_merge(t.lineitem.selectExpr(*EVENT_COLUMNS))


@query(
    "run_history",
    "select 'run_' || o_orderkey as run_id, case when o_custkey % 9 = 0 then 'Unknown' else 'customer_' || o_custkey end as dataset, "
    "case when o_orderpriority = '5-LOW' then 'Pending' else o_orderpriority end as task, 'Pending' as model, "
    "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as timestamp, 'reports/eda_report.pdf' as eda_pdf, null as training_pdf, null as prediction_pdf, "
    "null as forecast_pdf, case o_orderstatus when 'F' then '✓ (' || o_custkey || ' rows)' when 'O' then 'Skipped' else '✗ Failed' end as sync_dataset, "
    "'N/A' as sync_cleaned, 'N/A' as sync_metrics, case when o_custkey % 2 = 0 then '✗ Unknown' else 'N/A' end as sync_forecast from orders",
)
def _(t):
    docs = t.orders.selectExpr(
        "concat('run_', cast(o_orderkey as string)) as run_id",
        "case when o_custkey % 9 = 0 then null else concat('customer_', cast(o_custkey as string)) end as dataset_name",
        "date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\") as run_timestamp",
        "case when o_orderpriority = '5-LOW' then '' else o_orderpriority end as task_type",
        "cast(null as string) as best_model",
        "'reports/eda_report.pdf' as eda_pdf",
        "named_struct('status', case o_orderstatus when 'F' then 'Uploaded' when 'O' then 'Skipped' else 'Failed' end, "
        "'rows', o_custkey) as bq_uploaded_dataset",
        "case when o_custkey % 2 = 0 then named_struct('status', cast(null as string), 'rows', cast(null as bigint)) end as bq_forecast",
    )
    return runs.run_history(docs)


# Raw names with the characters the rules treat, from part names and types.
RAW_NAME = "concat(' ', p_name, ' (', p_type, ') % R²__', cast(p_size as string), ' é-')"


@query(
    "sanitize_column_names",
    "select p_partkey, trim(regexp_replace(regexp_replace(replace(lower(replace(replace("
    "' ' || p_name || ' (' || p_type || ') % R²__' || p_size || ' é-', 'R²', 'r2'), '%', 'pct')), ' ', '_'), "
    "'[^a-z0-9_]', '', 'g'), '_+', '_', 'g'), '_') as name from part",
)
def _(t):
    return t.part.select("p_partkey", sanitized_name(F.expr(RAW_NAME)).alias("name"))


STAMP = "2024-01-02T03:04:05"


@query(
    "inject_run_columns",
    f"select 'run_1' as run_id, 'orders.csv' as dataset_name, 'regression' as task_type, 'o_totalprice' as target_column, orders.*, "
    f"'{STAMP}' as created_at, '2.1' as app_version from orders",
)
def _(t):
    import datetime

    return warehouse.inject_run_columns(
        t.orders, "run_1", "orders.csv", "regression", "o_totalprice", datetime.datetime.fromisoformat(STAMP)
    )


@query(
    "warehouse_schema_cast",
    "select cast(l_linenumber as bigint) as l_linenumber, l_quantity, l_tax > 0.02 as taxed, l_shipdate, "
    "cast(cast(l_shipdate as date) as varchar) as day, l_returnflag from lineitem",
)
def _(t):
    return warehouse.warehouse_schema_cast(
        t.lineitem.selectExpr(
            "l_linenumber", "l_quantity", "l_tax > 0.02 as taxed", "l_shipdate", "cast(l_shipdate as date) as day", "l_returnflag"
        )
    )


@query(
    "normalize_row_values",
    "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || case when ts = date_trunc('second', ts) then '' else '.' || "
    "lpad(cast(extract(microsecond from ts) % 1000000 as varchar), 6, '0') end as ts, value, null as absent, event_type from events",
)
def _(t):
    return warehouse.normalize_row_values(t.events, ["event_id", "ts", "value", "absent", "event_type"])


@query("record_hash_dedup", "select distinct l_returnflag, l_linestatus, l_linenumber, l_quantity from lineitem")
def _(t):
    rows = t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber", "l_quantity")
    return warehouse.record_hash_dedup(rows).drop("row_id")


@query(
    "replace_by_run",
    "select o_orderpriority as run_id, o_orderkey, case when o_orderpriority in ('1-URGENT', '2-HIGH') then 2 else 1 end as version from orders",
)
def _(t):
    path = scratch_path(t.spark, "runs")
    rows = t.orders.selectExpr("o_orderkey", "1 as version", "o_orderpriority as run_id")
    warehouse.replace_by_run(rows, path)
    again = rows.where("run_id in ('1-URGENT', '2-HIGH')").withColumn("version", F.lit(2))
    warehouse.replace_by_run(again, path)
    return warehouse.read_runs(t.spark, path, rows.schema)


@query(
    "sync_status",
    "with req as (select distinct o_orderstatus as artifact, o_orderpriority as run_id from orders), "
    "c as (select o_orderstatus as artifact, o_orderpriority as run_id, count(*) as n from orders where o_orderpriority <> '5-LOW' group by 1, 2) "
    "select req.artifact, req.run_id, case when n is null then 'Skipped' else 'Uploaded' end as status, n as \"rows\", "
    "case when n is null then 'empty_dataframe' end as reason from req left join c on c.artifact = req.artifact and c.run_id = req.run_id",
)
def _(t):
    # Every (artifact, run) was requested; the low-priority runs had nothing to write.
    requests = t.orders.select(F.col("o_orderstatus").alias("artifact"), F.col("o_orderpriority").alias("run_id")).distinct()
    path = scratch_path(t.spark, "target")
    written = t.orders.where("o_orderpriority <> '5-LOW'").selectExpr(
        "o_orderstatus as artifact", "o_orderkey", "o_orderpriority as run_id"
    )
    warehouse.replace_by_run(written, path)
    return warehouse.sync_status(requests, warehouse.read_runs(t.spark, path, written.schema))


@query(
    "run_metadata_table",
    "select 'run_' || o_orderkey as run_id, 'orders' as dataset_name, 'o_totalprice' as target_column, o_orderstatus as task_type, null as best_model, "
    "o_orderdate as run_timestamp, '2.1' as app_version from orders",
)
def _(t):
    table = warehouse.run_metadata_table(
        t.orders.selectExpr(
            "concat('run_', cast(o_orderkey as string)) as run_id", "'orders' as dataset_name", "'o_totalprice' as target_column",
            "o_orderstatus as task_type", "o_orderdate as run_timestamp",
        )
    )
    return table.withColumn("run_timestamp", F.col("run_timestamp").cast("timestamp_ntz"))


@query(
    "dataset_profiles_table",
    f"with {MESSY} select 'profile_1' as run_id, 'messy' as dataset_name, null as task_type, null as target_column, count(*) as \"rows\", "
    f"{len(MESSY_NAMES)}::bigint as columns, sum((qty is null)::int + (price_txt is null)::int + (ship_txt is null)::int + (flag is null)::int)::bigint as missing_values, "
    "count(*) - (select count(*) from (select distinct * from messy)) as duplicate_rows, null as timestamp, '2.1' as app_version from messy",
)
def _(t):
    profile = P.profile_summary(messy(t)).withColumns({"run_id": F.lit("profile_1"), "dataset_name": F.lit("messy")})
    path = scratch_path(t.spark, "profiles")
    table = warehouse.dataset_profiles_table(profile)
    warehouse.replace_by_run(table, path)
    return warehouse.read_runs(t.spark, path, table.schema)


@query(
    "training_metrics_table",
    f"with {CANDIDATES} select 'run_' || ordinal as run_id, 'regression' as task_type, 'l_extendedprice' as target_column, model as best_model, "
    f"null as accuracy, null as f1, null as precision, null as recall, {r('r2')} as r2, {r('rmse')} as rmse, {r('mae')} as mae, null as timestamp, '2.1' as app_version from mt",
)
def _(t):
    rows = candidates(t).select(
        F.concat(F.lit("run_"), F.col("ordinal").cast("string")).alias("run_id"), F.lit("regression").alias("task_type"),
        F.lit("l_extendedprice").alias("target_column"), F.col("model").alias("best_model"), "r2", "rmse", "mae",
    )
    return rounded(warehouse.training_metrics_table(rows))


# One dataset per order status: the profile of its orders, as a JSON document.


@query(
    "dataset_report",
    "select o_orderstatus, '1.0' as report_version, count(*) as \"rows\", (select count(*) from (describe orders)) as columns, "
    "sum((o_orderkey is null)::int + (o_custkey is null)::int + (o_totalprice is null)::int + (o_orderdate is null)::int + (o_orderpriority is null)::int) as total_missing, "
    "'o_custkey,o_orderkey' as profiled, (select count(*) from (select distinct * from orders) d where d.o_orderstatus = o.o_orderstatus) as rows_after_cleaning "
    "from orders o group by o_orderstatus",
)
def _(t):
    keys = ["o_orderstatus"]
    orders = t.orders
    missing = sum((F.count_if(is_missing(orders, c)) for c in orders.columns), F.lit(0))
    summary = orders.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.lit(len(orders.columns)).alias("columns"), missing.alias("total_missing"))
    facts = t.orders.groupBy(*keys).agg(F.count_distinct("o_custkey").alias("a"), F.count_distinct("o_orderkey").alias("b"))
    columns = facts.select(
        *keys,
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(x).alias("unique")) for c, x in (("o_custkey", "a"), ("o_orderkey", "b"))])),
    )
    kept = drop_duplicates(orders).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_after_cleaning"))
    cleaning = kept.join(summary.select(*keys, "rows"), keys).select(
        *keys, (F.col("rows") - F.col("rows_after_cleaning")).alias("duplicates_removed"), "rows_after_cleaning"
    )
    report = reports.dataset_report(summary, columns, cleaning, keys)
    field = lambda path: F.get_json_object("report", path)
    return report.select(
        *keys, field("$.report_version").alias("report_version"), field("$.profile_summary.rows").cast("bigint").alias("rows"),
        field("$.profile_summary.columns").cast("bigint").alias("columns"),
        field("$.profile_summary.total_missing").cast("bigint").alias("total_missing"),
        F.concat_ws(",", field("$.profile_summary.column_profile[0].column"), field("$.profile_summary.column_profile[1].column")).alias("profiled"),
        field("$.cleaning_summary.rows_after_cleaning").cast("bigint").alias("rows_after_cleaning"),
    )


@query(
    "model_report",
    f"with {CANDIDATES} select '1.0' as report_version, 'regression' as problem_type, 'Mean' as best_model_name, "
    f"(select {r('rmse', 4)} from mt where model = 'Mean') as best_rmse, (select {r('rmse', 4)} from mt where model = 'Quantity') as quantity_rmse",
)
def _(t):
    report = reports.model_report("regression", "Mean", candidates(t))
    field = lambda path: F.get_json_object("report", path)
    return rounded(
        report.select(
            field("$.report_version").alias("report_version"), field("$.problem_type").alias("problem_type"),
            field("$.best_model_name").alias("best_model_name"), field("$.best_model_metrics.rmse").cast("double").alias("best_rmse"),
            field("$.metrics.Quantity.rmse").cast("double").alias("quantity_rmse"),
        ),
        4,
    )
