"""Registered queries: feature preparation, evaluation and prediction tables.

The scored inputs are fixed rules over ``lineitem``, so that both engines
compute on identical predictions.
"""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from ..operators import evaluate as V, features as X, predict as Q
from .base import query, r, rounded

SCORE = "((l_partkey * 7 + l_suppkey * 13 + l_orderkey) % 1000) / 1000.0"
CLASS_COLUMNS = [
    "l_returnflag as y_true",
    "case when l_discount > 0.07 then 'R' when l_tax > 0.05 then 'N' else 'A' end as y_pred",
    f"cast({SCORE} as double) as score",
]
BINARY_COLUMNS = [
    "l_linestatus as y_true",
    "case when l_discount > 0.05 then 'O' else 'F' end as y_pred",
    f"cast({SCORE} as double) as score",
]
REG_COLUMNS = ["l_extendedprice as y_true", "l_quantity * 2000.0 as y_pred"]
PRED_CLASS = f"pred_class as (select {', '.join(CLASS_COLUMNS)} from lineitem)"
PRED_BINARY = f"pred_binary as (select {', '.join(BINARY_COLUMNS)} from lineitem)"
PRED_REG = f"pred_reg as (select {', '.join(REG_COLUMNS)} from lineitem)"


def pred_class(t):
    return t.lineitem.selectExpr(*CLASS_COLUMNS)


def pred_binary(t):
    return t.lineitem.selectExpr(*BINARY_COLUMNS)


def pred_reg(t):
    return t.lineitem.selectExpr(*REG_COLUMNS)


R2 = "1 - sum(pow(y_true - y_pred, 2)) / (var_pop(y_true) * count(*))"
REG_LABEL = "case when r2 < 0.3 then 'Weak predictive power' when r2 < 0.7 then 'Moderate predictive power' else 'Strong predictive power' end"
REG_SQL = (
    f"select {{by}} {R2} as r2, avg(abs(y_true - y_pred)) as mae, sqrt(avg(pow(y_true - y_pred, 2))) as rmse, "
    "avg(abs(y_true - y_pred) / greatest(abs(y_true), 2.220446049250313e-16)) as mape from {t} {group}"
)


def reg_sql(table: str, by: str = "") -> str:
    return REG_SQL.format(t=table, by=f"{by}," if by else "", group=f"group by {by}" if by else "")


@query(
    "regression_metrics",
    f"with {PRED_REG} select {r('r2')} as r2, {r('mae')} as mae, {r('rmse')} as rmse, {r('mape')} as mape, {REG_LABEL} as interpretation "
    f"from ({reg_sql('pred_reg')})",
)
def _(t):
    return rounded(V.regression_metrics(pred_reg(t)))


def classes_sql(table: str) -> str:
    return (
        f"(select c as k, (select count(*) from {table} where y_true = c) as support, "
        f"(select count(*) from {table} where y_pred = c) as predicted, "
        f"(select count(*) from {table} where y_true = c and y_pred = c) as hits "
        f"from (select distinct y_true as c from {table} union select distinct y_pred from {table}))"
    )


RATIOS = (
    "coalesce(hits / nullif(predicted, 0), 0.0) as p, coalesce(hits / nullif(support, 0), 0.0) as r, "
    "coalesce(2.0 * hits / nullif(support + predicted, 0), 0.0) as f"
)
CLASS_LABEL = "case when accuracy < 0.6 then 'Weak performance' when accuracy < 0.8 then 'Moderate performance' else 'Strong performance' end"


@query(
    "classification_metrics",
    f"with {PRED_CLASS}, c as (select *, {RATIOS} from {classes_sql('pred_class')}), m as (select sum(hits) / sum(support) as accuracy, "
    "sum(p * support) / sum(support) as precision, sum(r * support) / sum(support) as recall, sum(f * support) / sum(support) as f1 from c) "
    f"select {r('accuracy')} as accuracy, {r('precision')} as precision, {r('recall')} as recall, {r('f1')} as f1, {CLASS_LABEL} as interpretation from m",
)
def _(t):
    return rounded(V.classification_metrics(pred_class(t)))


@query(
    "classification_metrics_binary",
    f"with {PRED_BINARY}, c as (select *, {RATIOS} from {classes_sql('pred_binary')}), m as (select (select sum(hits) / sum(support) from c) as accuracy, "
    "p as precision, r as recall, f as f1 from c where k = 'O') "
    f"select {r('accuracy')} as accuracy, {r('precision')} as precision, {r('recall')} as recall, {r('f1')} as f1, {CLASS_LABEL} as interpretation from m",
)
def _(t):
    return rounded(V.classification_metrics(pred_binary(t)))


def auc_sql(table: str, positive: str, score: str = "score") -> str:
    return (
        "(select (sum(case when y then rk else 0 end) - sum(y::int) * (sum(y::int) + 1) / 2.0) / (sum(y::int)::double * (count(*) - sum(y::int))) "
        f"from (select {positive} as y, rank() over (order by {score}) + (count(*) over (partition by {score}) - 1) / 2.0 as rk from {table}))"
    )


AUC_BINARY = auc_sql("pred_binary", "y_true = 'O'")


@query("roc_auc", f"with {PRED_BINARY} select {r(AUC_BINARY)} as roc_auc")
def _(t):
    return rounded(V.roc_auc(pred_binary(t), "O"))


@query("roc_auc_ranges", f"with {PRED_BINARY} select {r(AUC_BINARY)} as roc_auc")
def _(t):
    return rounded(V.roc_auc(pred_binary(t).repartition(7, "score"), "O"))


OVR = {"A": "score", "N": "1 - score", "R": "abs(score - 0.5)"}


@query(
    "roc_auc_ovr",
    f"with {PRED_CLASS} select {r(' + '.join(f'{auc_sql('pred_class', f'y_true = {chr(39)}{k}{chr(39)}', s)} * (select avg((y_true = {chr(39)}{k}{chr(39)})::int) from pred_class)' for k, s in OVR.items()))} as roc_auc",
)
def _(t):
    scored = pred_class(t).selectExpr("y_true", *[f"{s} as score_{k}" for k, s in OVR.items()])
    return rounded(V.roc_auc_ovr(scored, {k: f"score_{k}" for k in OVR}))


@query(
    "confusion_matrix",
    f"with {PRED_CLASS}, k as (select distinct y_true as c from pred_class union select distinct y_pred from pred_class) "
    "select a.c as actual, b.c as predicted, (select count(*) from pred_class where y_true = a.c and y_pred = b.c) as \"count\" from k a, k b",
)
def _(t):
    return V.confusion_matrix(pred_class(t))


CURVE = (
    "g as (select score, count(*) filter (y_true = 'O') as pos, count(*) filter (y_true <> 'O') as neg from pred_binary group by 1), "
    "u as (select score, pos, neg, sum(pos) over (order by score desc) as tp, sum(neg) over (order by score desc) as fp, "
    "sum(pos) over () as p, sum(neg) over () as n from g)"
)


@query(
    "roc_curve",
    f"with {PRED_BINARY}, {CURVE} select {r('score')} as threshold, {r('fp / n')} as fpr, {r('tp / p')} as tpr from u union all select null, 0.0, 0.0",
)
def _(t):
    return rounded(V.roc_curve(pred_binary(t), "O"))


@query(
    "roc_curve_area",
    f"with {PRED_BINARY}, {CURVE} select {r('sum((tp + tp - pos) / 2.0 / p * neg / n)')} as area from u",
)
def _(t):
    return rounded(V.roc_curve_area(pred_binary(t), "O"))


@query(
    "pr_curve",
    f"with {PRED_BINARY}, {CURVE} select {r('score')} as threshold, {r('tp / (tp + fp)')} as precision, {r('tp / p')} as recall from u union all select null, 1.0, 0.0",
)
def _(t):
    return rounded(V.pr_curve(pred_binary(t), "O"))


@query(
    "pr_curve_area",
    f"with {PRED_BINARY}, {CURVE}, w as (select score, tp / p as rec, tp / (tp + fp) as pre from u), "
    "x as (select rec - coalesce(lag(rec) over (order by score desc), 0) as d, (pre + coalesce(lag(pre) over (order by score desc), 1)) / 2 as h from w) "
    f"select {r('sum(d * h)')} as area from x",
)
def _(t):
    return rounded(V.pr_curve_area(pred_binary(t), "O"))


@query(
    "predicted_vs_actual",
    f"with {PRED_REG} select y_true, y_pred, (select least(min(y_true), min(y_pred)) from pred_reg) as line_min, "
    "(select greatest(max(y_true), max(y_pred)) from pred_reg) as line_max from pred_reg",
)
def _(t):
    return V.predicted_vs_actual(pred_reg(t))


@query("residuals", f"with {PRED_REG} select {r('y_pred')} as y_pred, {r('y_true - y_pred')} as residual from pred_reg")
def _(t):
    return rounded(V.residuals(pred_reg(t)))


@query(
    "top_feature_importance",
    f"select p_brand as feature, {r('avg(p_retailprice) - 900')} as importance from part group by 1 order by avg(p_retailprice) desc, 1 limit 15",
)
def _(t):
    importance = t.part.groupBy(F.col("p_brand").alias("feature")).agg((F.avg("p_retailprice") - 900).alias("importance"))
    return rounded(V.top_feature_importance(importance))


# Three fixed rules stand for candidate models: (name, prediction).
RULES = [("Quantity", "l_quantity * 2000.0"), ("Mean", "50000.0 + 0 * l_quantity"), ("Discount", "60000.0 - 100000.0 * l_discount")]
CANDIDATES = "cand as (" + " union all ".join(
    f"select '{m}' as model, {i} as ordinal, l_extendedprice as y_true, {e} as y_pred from lineitem" for i, (m, e) in enumerate(RULES)
) + f"), mt as (select model, any_value(ordinal) as ordinal, {R2} as r2, avg(abs(y_true - y_pred)) as mae, sqrt(avg(pow(y_true - y_pred, 2))) as rmse, " \
    "avg(abs(y_true - y_pred) / greatest(abs(y_true), 2.220446049250313e-16)) as mape from cand group by 1)"


def candidates(t):
    entries = [
        F.struct(F.lit(m).alias("model"), F.expr(e).cast("double").alias("y_pred")) for m, e in RULES
    ]
    scored = t.lineitem.select(F.col("l_extendedprice").alias("y_true"), F.inline(F.array(*entries)))
    ordinals = F.create_map(*[F.lit(x) for i, (m, _) in enumerate(RULES) for x in (m, i)])
    return V.scored_metrics(scored, "regression").withColumn("ordinal", ordinals[F.col("model")])


@query("select_best_model", f"with {CANDIDATES} select model as best_model, {r('r2')} as best_score, "
       "case when r2 < 0 then 'All models have negative R2; check data quality' end as warning from mt order by r2 desc, ordinal limit 1")
def _(t):
    return rounded(V.select_best_model(candidates(t), "regression"))


@query("select_best_rmse_f1", f"with {CANDIDATES} select model as best_model, {r('rmse')} as best_score from mt order by rmse, ordinal limit 1")
def _(t):
    return rounded(V.select_best_rmse_f1(candidates(t), "regression"))


@query("negative_r2_warning", f"with {CANDIDATES} select {r('max(r2)')} as best_r2, "
       "case when max(r2) < 0 then 'All models have negative R2; check data quality' end as warning from mt")
def _(t):
    return rounded(V.negative_r2_warning(candidates(t)))


@query("metrics_table", f"with {CANDIDATES} select model, {', '.join(f'{r(c, 4)} as {c}' for c in ('r2', 'mae', 'rmse', 'mape'))} from mt")
def _(t):
    return rounded(V.metrics_table(candidates(t), "regression"), 4)


def text_sql(c: str) -> str:
    return f"case when {c} = 0 then '0.0000' when abs({c}) < 0.001 then printf('%.4e', {c}) else printf('%.4f', {c}) end as {c}"


@query("metrics_table_text", f"with {CANDIDATES} select model, {', '.join(text_sql(c) for c in ('r2', 'mae', 'rmse', 'mape'))} from mt")
def _(t):
    return V.metrics_table(candidates(t), "regression", as_text=True)


@query("best_model_summary", f"with {CANDIDATES} select model as best_model, {r('r2', 4)} as r2, {r('rmse', 4)} as rmse from mt order by mt.r2 desc, ordinal limit 1")
def _(t):
    return rounded(V.best_model_summary(candidates(t), "regression"), 4)


@query(
    "leakage_warning",
    f"with {CANDIDATES} select model, {r('r2')} as r2, {r('rmse')} as rmse, case when r2 >= 0.99 or rmse < 1e-5 then "
    "'Near-perfect performance detected. Verify that target leakage is not present.' end as warning from mt "
    "union all select 'Copy', 1.0, 0.0, 'Near-perfect performance detected. Verify that target leakage is not present.'",
)
def _(t):
    copy = t.lineitem.select(
        F.lit("Copy").alias("model"), F.col("l_extendedprice").alias("y_true"), F.col("l_extendedprice").alias("y_pred")
    )
    metrics = candidates(t).drop("ordinal").unionByName(V.scored_metrics(copy, "regression"))
    return rounded(V.leakage_warning(metrics).select("model", "r2", "rmse", "warning"))


# Feature preparation


@query("select_features", "select o_orderkey, o_custkey, o_orderstatus, o_orderpriority from orders")
def _(t):
    return X.select_features(t.orders, "o_totalprice")


SPLIT_HASH = "substr(md5(cast(o_orderkey as string)), 1, 8)"


@query("train_test_split", f"select o_orderkey, case when {SPLIT_HASH} < '{int(0.2 * 2**32):08x}' then 'test' else 'train' end as split from orders")
def _(t):
    return X.train_test_split(t.orders, ["o_orderkey"]).select("o_orderkey", "split")


@query(
    "stratified_split",
    f"select o_orderkey, o_orderstatus, case when row_number() over (partition by o_orderstatus order by {SPLIT_HASH}, o_orderkey) "
    "<= ceil(0.2 * count(*) over (partition by o_orderstatus)) then 'test' else 'train' end as split from orders",
)
def _(t):
    return X.stratified_split(t.orders, ["o_orderkey"], "o_orderstatus").select("o_orderkey", "o_orderstatus", "split")


@query(
    "stratified_split_duplicates",
    "with k as (select o_orderstatus, o_orderpriority, count(*) as n from orders group by 1, 2), "
    "b as (select k.*, sum(n) over (partition by o_orderstatus order by substr(md5(o_orderpriority), 1, 8)) - n as before, "
    "ceil(0.2 * sum(n) over (partition by o_orderstatus)) as wanted from k) "
    "select o_orderstatus, o_orderpriority, n, cast(greatest(0, least(n, wanted - before)) as bigint) as test from b",
)
def _(t):
    """The key has five values, so that the border of a class is among rows that share one."""
    sides = X.stratified_split(t.orders, ["o_orderpriority"], "o_orderstatus")
    return sides.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("test"))


@query("label_encode", "select o_orderkey, cast(dense_rank() over (order by o_orderpriority) - 1 as int) as label_index from orders")
def _(t):
    return X.label_encode(t.orders, "o_orderpriority").select("o_orderkey", F.col("label_index").cast("int").alias("label_index"))


@query(
    "standard_scale",
    f"select o_orderkey, {r('(o_totalprice - (select avg(o_totalprice) from orders)) / (select stddev_pop(o_totalprice) from orders)')} as o_totalprice from orders",
)
def _(t):
    return rounded(X.standard_scale(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice"]))


@query(
    "one_hot_encode",
    "with top as (select p_name, count(*) as n from part group by 1 order by n desc, 1 limit 49), "
    "k as (select count(distinct p_name) as k from part) "
    "select p_partkey, 'p_brand' as feature, p_brand as category, 1 as value from part union all "
    "select p_partkey, 'p_name', case when (select k from k) <= 50 or p_name in (select p_name from top) then p_name else 'infrequent' end, 1 from part",
)
def _(t):
    return X.one_hot_encode(t.part, ["p_partkey"], ["p_brand", "p_name"])


# Prediction tables


@query("validate_prediction_schema", "select o_totalprice, cast(o_custkey as double) as o_custkey, o_orderstatus from orders")
def _(t):
    features = T.StructType(
        [T.StructField("o_totalprice", T.DoubleType()), T.StructField("o_custkey", T.DoubleType()), T.StructField("o_orderstatus", T.StringType())]
    )
    return Q.validate_prediction_schema(t.orders, features)


@query("prediction_sample", f"with p as (select *, {REG_COLUMNS[1].replace('y_pred', 'Prediction')} from lineitem) "
       "select l_orderkey, l_linenumber, l_partkey, Prediction from p order by l_orderkey, l_linenumber, l_partkey limit 10")
def _(t):
    scored = t.lineitem.selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_quantity * 2000.0 as Prediction")
    return Q.prediction_sample(scored.orderBy("l_orderkey", "l_linenumber", "l_partkey"))


@query(
    "prediction_stats",
    f"select {r('min(p)', 4)} as min, {r('max(p)', 4)} as max, {r('avg(p)', 4)} as mean, {r('median(p)', 4)} as median, {r('stddev_pop(p)', 4)} as std "
    "from (select l_extendedprice * (1 - l_discount) as p from lineitem)",
)
def _(t):
    return rounded(Q.prediction_stats(t.lineitem.selectExpr("l_extendedprice * (1 - l_discount) as Prediction")), 4)


@query("class_distribution", f"with {PRED_CLASS} select y_pred as class, count(*) as \"count\" from pred_class group by 1")
def _(t):
    return Q.class_distribution(pred_class(t), "y_pred")


@query(
    "prediction_summary",
    f"with {PRED_CLASS} select 'lineitem' as source, count(*) as \"count\", 'predictions' as file_location, "
    "(select string_agg(k || '=' || n, ',' order by k) from (select y_pred as k, count(*) as n from pred_class group by 1)) as statistics from pred_class",
)
def _(t):
    out = Q.prediction_summary(pred_class(t), "lineitem", "predictions", "classification", "y_pred")
    text = F.array_join(F.transform(F.map_entries("statistics"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("long"))), ",")
    return out.withColumn("statistics", text)
