"""Registered queries: preprocessing, models, training workflow, scoring.

Linear models are compared with their closed forms, written in SQL for two
features z1 and z2 of zero mean and unit population variance.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import estimators as E, neighbors as N, predict as Q, vector_index
from ..operators.boosting import BoostedTrees
from ..plans import analysis, training as TR
from ..session import scratch_path
from ..sources import models as M
from .base import MESSY_KEYED, ROW_ORDER, messy_keyed, query, r, rounded
from .cleaning import CLEAN_SQL
from .profiling import ALL_KINDS, ALL_NAMES, ALL_TYPES, DATES_SQL, NUMBERS_SQL, profile_sql

Z = (
    "z as (select (l_quantity - avg(l_quantity) over ()) / stddev_pop(l_quantity) over () as z1, "
    "(l_discount - avg(l_discount) over ()) / stddev_pop(l_discount) over () as z2, l_extendedprice as y from lineitem), "
    "m as (select avg(y) as b, covar_pop(z1, y) as c1, covar_pop(z2, y) as c2, covar_pop(z1, z2) as rho, count(*) as n, stddev_pop(y) as s from z)"
)


def linear_sql(diagonal: str, shift: str) -> str:
    """Solves [[d, rho], [rho, d]] w = c - shift * sign(c)."""
    return (
        f"{Z}, v as (select *, c1 - {shift} * sign(c1) as k1, c2 - {shift} * sign(c2) as k2, {diagonal} as d from m), "
        "w as (select (d * k1 - rho * k2) / (d * d - rho * rho) as w1, (d * k2 - rho * k1) / (d * d - rho * rho) as w2, b from v)"
    )


def coefficients_sql(diagonal: str, shift: str, digits: int = 4) -> str:
    return (
        f"with {linear_sql(diagonal, shift)} select 'l_quantity' as feature, {r('w1', digits)} as coefficient, {r('b', digits)} as intercept from w "
        f"union all select 'l_discount', {r('w2', digits)}, {r('b', digits)} from w"
    )


def linear_rows(t):
    return t.lineitem.select("l_quantity", "l_discount", "l_extendedprice")


def coefficients(t, name: str):
    df = linear_rows(t)
    final = TR.retrain_best(df, "l_extendedprice", "regression", name)
    fitted = next(s for s in final.model.stages if hasattr(s, "coefficients"))
    rows = [(n, float(c), float(fitted.intercept)) for n, c in zip(final.names, fitted.coefficients.toArray())]
    return rounded(df.sparkSession.createDataFrame(rows, "feature string, coefficient double, intercept double"), 4)


@query("linear_regression", coefficients_sql("1.0", "0.0"))
def _(t):
    return coefficients(t, "Linear Regression")


@query("ridge", coefficients_sql("1.0 + 1.0 / n", "0.0"))
def _(t):
    return coefficients(t, "Ridge")


@query("lasso", coefficients_sql("1.0", "1.0"))
def _(t):
    return coefficients(t, "Lasso")


@query("elastic_net", coefficients_sql("1.5", "0.5"))
def _(t):
    return coefficients(t, "ElasticNet")


def logistic_sql(steps: int = 12) -> str:
    """Newton's method on the penalised log-likelihood, one CTE per step; the intercept is free."""
    parts = [
        "x as (select (l_quantity - avg(l_quantity) over ()) / stddev_pop(l_quantity) over () as z, "
        "case when l_linestatus = 'O' then 1.0 else 0.0 end as y from lineitem)",
        "b0 as (select 0.0::double as a, 0.0::double as w)",
    ]
    for i in range(steps):
        parts.append(
            f"s{i} as (select any_value(a) as a, any_value(w) as w, sum(y - p) as ga, sum((y - p) * z) - any_value(w) as gw, sum(p * (1 - p)) as haa, "
            f"sum(p * (1 - p) * z) as haw, sum(p * (1 - p) * z * z) + 1 as hww from (select x.*, a, w, 1 / (1 + exp(-(a + w * z))) as p from x, b{i}))"
        )
        parts.append(
            f"b{i + 1} as (select a + (hww * ga - haw * gw) / (haa * hww - haw * haw) as a, "
            f"w + (haa * gw - haw * ga) / (haa * hww - haw * haw) as w from s{i})"
        )
    return (
        f"with {', '.join(parts)} select 'l_quantity' as feature, {r('w', 5)} as coefficient, {r('a', 5)} as intercept from b{steps}"
    )


@query("logistic_regression", logistic_sql())
def _(t):
    df = t.lineitem.select("l_quantity", "l_linestatus")
    final = TR.retrain_best(df, "l_linestatus", "classification", "Logistic Regression")
    fitted = next(s for s in final.model.stages if hasattr(s, "coefficientMatrix"))
    rows = [("l_quantity", float(fitted.coefficients[0]), float(fitted.intercept))]
    return rounded(df.sparkSession.createDataFrame(rows, "feature string, coefficient double, intercept double"), 5)


NB_ROWS = (
    "x as (select o_orderkey, o_orderstatus as y, (o_totalprice - avg(o_totalprice) over ()) / stddev_pop(o_totalprice) over () as z1, "
    "(o_custkey - avg(o_custkey) over ()) / stddev_pop(o_custkey) over () as z2 from orders)"
)


@query(
    "gaussian_nb",
    f"with {NB_ROWS}, c as (select y, ln(count(*) / (select count(*) from x)) as prior, avg(z1) as m1, avg(z2) as m2, "
    "var_pop(z1) + 1e-9 as v1, var_pop(z2) + 1e-9 as v2 from x group by 1), "
    "p as (select o_orderkey, x.y as actual, c.y as predicted, prior - 0.5 * (ln(2 * pi() * v1) + ln(2 * pi() * v2)) "
    "- 0.5 * (pow(z1 - m1, 2) / v1 + pow(z2 - m2, 2) / v2) as ll from x, c) "
    "select actual, predicted, count(*) as \"count\" from (select *, row_number() over (partition by o_orderkey order by ll desc) as k from p) where k = 1 group by 1, 2",
)
def _(t):
    df = t.orders.select("o_totalprice", "o_custkey", "o_orderstatus")
    final = TR.retrain_best(df, "o_orderstatus", "classification", "GaussianNB")
    scored = final.model.transform(df).select(F.col("o_orderstatus").alias("actual"), F.col("predicted_label").alias("predicted"))
    return scored.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("count"))


IS_TEST = f"substr(md5(cast(vec_id as string)), 1, 8) < '{int(0.2 * 2**32):08x}'"


def embedding_sides(t):
    from ..operators.features import train_test_split

    sides = train_test_split(t.embeddings, ["vec_id"]).select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label", "split"
    )
    return sides.where("split = 'train'"), sides.where("split = 'test'")


@query(
    "knn_classifier",
    f"with e as (select vec_id, embedding::double[] as v, label, {IS_TEST} as test from embeddings), "
    "near as (select q.vec_id as id, p.label, row_number() over (partition by q.vec_id order by list_distance(q.v, p.v), p.vec_id) as k "
    "from e q, e p where q.test and not p.test), "
    "votes as (select id, label, count(*) as n from near where k <= 5 group by 1, 2) "
    "select id, label, n as votes from (select *, row_number() over (partition by id order by n desc, label) as k from votes) where k = 1",
)
def _(t):
    return N.knn_classify(*embedding_sides(t), 5)


@query(
    "knn_index",
    f"with e as (select vec_id, embedding::double[] as v, {IS_TEST} as test from embeddings), "
    "near as (select q.vec_id as id, row_number() over (partition by q.vec_id order by list_distance(q.v, p.v), p.vec_id) as k from e q, e p where q.test and not p.test) "
    "select count(*) as pairs, true as enough from near where k <= 5",
)
def _(t):
    """Whether the index finds 95 % of the five nearest rows."""
    train, test = embedding_sides(t)
    told = vector_index.recall(vector_index.index_neighbours(train, test), N.nearest_neighbours(train, test))
    return told.select("pairs", (F.col("recall") >= 0.95).alias("enough"))


def regression_scored(t, name: str):
    """Test rows of one candidate: retail price of a part from its size, brand, type and name."""
    result = TR.train_candidates(t.part, "p_retailprice", "regression", key=["p_partkey"], models=[name])
    return result.scored


def classification_scored(t, name: str):
    """Test rows of one candidate: status of an order from its price, customer and priority."""
    df = t.orders.drop("o_orderdate")
    result = TR.train_candidates(df, "o_orderstatus", "classification", key=["o_orderkey"], models=[name])
    return TR.decoded(result.scored, result.labels).select("model", "y_true", "y_pred")


SPLIT_SQL = (
    "with d as (select p_partkey, cast(p_size as double) as x0, cast(p_partkey % 40 as double) as x1, p_retailprice as y from part), b as (select avg(y) as base from d), "
    "c as (select 0 as f, x0 as v, base - y as g from d, b union all select 1, x1, base - y from d, b), "
    "s as (select f, v, sum(sum(g)) over (partition by f order by v) as gl, sum(count(*)) over (partition by f order by v) as nl, "
    "sum(sum(g)) over (partition by f) as gs, sum(count(*)) over (partition by f) as ns from c group by f, v), "
    "k as (select * from s where nl >= {least} and ns - nl >= {least} order by gl * gl / (nl + {l2}) + (gs - gl) * (gs - gl) / (ns - nl + {l2}) desc, f, v limit 1) "
    "select p_partkey, {out} as prediction from d, b, k"
)
SPLIT_OUT = "base - {step} * case when case when f = 0 then x0 else x1 end <= v then gl / (nl + {l2}) else (gs - gl) / (ns - nl + {l2}) end"


def split_query(name: str, **settings):
    """One round of one split, which SQL can enumerate: retail price by size and a part of the key."""
    told = {k: settings.get(k, d) for k, d in (("step", 0.3), ("l2", 1.0), ("least", 1))}

    @query(name, SPLIT_SQL.format(out=r(SPLIT_OUT.format(**told)), **told))
    def _(t):
        from pyspark.ml.feature import VectorAssembler

        rows = t.part.selectExpr("p_partkey", "cast(p_size as double) as x0", "cast(p_partkey % 40 as double) as x1", "p_retailprice as label")
        rows = VectorAssembler(inputCols=["x0", "x1"], outputCol="features").transform(rows)
        model = BoostedTrees(rounds=1, depth=1, leaves=2, **settings).fit(rows)
        return rounded(model.transform(rows).select("p_partkey", "prediction"))


split_query("xgb_style_split", step=0.3, l2=1.0)
split_query("lgbm_style_split", step=0.1, l2=0.0, least=20)


for _key, _model in {
    "decision_tree_regressor": "Decision Tree",
    "random_forest_regressor": "Random Forest",
    "extra_trees_regressor": "Extra Trees",
    "gradient_boosting_regressor": "Gradient Boosting",
    "xgb_style_regressor": "XGBoost",
    "lgbm_style_regressor": "LightGBM",
}.items():
    query(_key)(lambda t, name=_model: regression_scored(t, name))

for _key, _model in {
    "decision_tree_classifier": "Decision Tree",
    "random_forest_classifier": "Random Forest",
    "extra_trees_classifier": "Extra Trees",
    "gradient_boosting_classifier": "Gradient Boosting",
    "svm_classifier": "SVM",
}.items():
    query(_key)(lambda t, name=_model: classification_scored(t, name))


TOP_NAMES = "top as (select p_name, count(*) as n from part group by 1 order by n desc, 1 limit 49), k as (select count(distinct p_name) as k from part)"


@query(
    "build_preprocessor",
    f"with {TOP_NAMES} select p_partkey, 'p_size' as feature, {r('(p_size - (select avg(p_size) from part)) / (select stddev_pop(p_size) from part)')} as value from part "
    "union all select p_partkey, 'p_brand_' || p_brand, 1.0 from part union all select p_partkey, 'p_name_' || "
    "case when (select k from k) <= 50 or p_name in (select p_name from top) then p_name else 'infrequent' end, 1.0 from part",
)
def _(t):
    df = t.part.select("p_partkey", "p_size", "p_brand", "p_name")
    prepared = E.build_preprocessor(df, ["p_size", "p_brand", "p_name"])
    names = F.array(*[F.lit(n) for n in prepared.names])
    cells = prepared.model.transform(df).select("p_partkey", F.posexplode(vector_to_array("features")).alias("place", "value"))
    return rounded(
        cells.where("place = 0 or value <> 0").select("p_partkey", F.get(names, F.col("place")).alias("feature"), "value")
    )


# The workflow on one linear candidate, every step stated in SQL: split, scaling and fit on the train side, metrics on the test side.
SPLIT = f"substr(md5(cast(o_orderkey as string)), 1, 8) < '{int(0.2 * 2**32):08x}'"


@query(
    "train_linear_candidate",
    f"with a as (select o_totalprice as y, o_custkey as x, {SPLIT} as test from orders), "
    "f as (select regr_slope(y, x) as s, regr_intercept(y, x) as i from a where not test), "
    "p as (select y, i + s * x as p from a, f where test) "
    f"select 'Linear Regression' as model, {r('1 - sum(pow(y - p, 2)) / (var_pop(y) * count(*))')} as r2, {r('avg(abs(y - p))', 4)} as mae, "
    f"{r('sqrt(avg(pow(y - p, 2)))', 4)} as rmse from p",
)
def _(t):
    df = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    result = TR.train_candidates(df, "o_totalprice", "regression", key=["o_orderkey"], models=["Linear Regression"])
    out = result.metrics.select("model", "r2", "mae", "rmse")
    return rounded(rounded(out, 6).select("model", "r2", *[F.round(c, 4).alias(c) for c in ("mae", "rmse")]), 6)


@query("train_candidates")
def _(t):
    result = TR.train_candidates(t.part, "p_retailprice", "regression", key=["p_partkey"])
    return result.candidates.join(result.metrics.drop("ordinal", "training_seconds"), "model", "left")


PRICE = "(select regr_intercept(l_extendedprice, l_quantity) from lineitem) + (select regr_slope(l_extendedprice, l_quantity) from lineitem) * l_quantity"


@query("retrain_best", f"select l_quantity, {r(PRICE, 4)} as prediction, count(*) as n from lineitem group by l_quantity")
def _(t):
    df = t.lineitem.select("l_quantity", "l_extendedprice")
    final = TR.retrain_best(df, "l_extendedprice", "regression", "Linear Regression")
    return rounded(final.model.transform(df).groupBy("l_quantity", "prediction").agg(F.count(F.lit(1)).alias("n")), 4)


@query(
    "feature_importance",
    f"with {linear_sql('1.0', '0.0')} select 'l_quantity' as feature, {r('abs(w1)', 4)} as importance from w union all select 'l_discount', {r('abs(w2)', 4)} from w",
)
def _(t):
    df = linear_rows(t)
    return rounded(TR.retrain_best(df, "l_extendedprice", "regression", "Linear Regression").importance(df), 4)


@query("feature_importance_trees")
def _(t):
    df = t.part.drop("p_partkey")
    return TR.retrain_best(df, "p_retailprice", "regression", "Random Forest").importance(df)


def saved(t):
    df = t.lineitem.select("l_quantity", "l_extendedprice")
    final = TR.retrain_best(df, "l_extendedprice", "regression", "Linear Regression")
    folder = scratch_path(t.spark, "models")
    M.model_save(final, "best_model", folder, t.spark)
    return folder


@query("model_save", "select 'Linear Regression' as model, 'regression' as problem_type, 'l_extendedprice' as target_column, 'l_quantity:double' as features, count(*) as \"rows\" from lineitem")
def _(t):
    final = M.model_load(t.spark, saved(t))
    features = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in final.schema.fields)
    return Q.score(final.model, t.lineitem, final.schema).agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(final.name).alias("model"), F.lit(final.task).alias("problem_type"), F.lit(final.target).alias("target_column"),
        F.lit(features).alias("features"), "rows",
    )


@query("model_load", f"select l_quantity, {r(PRICE, 4)} as \"Prediction\" from lineitem")
def _(t):
    final = M.model_load(t.spark, saved(t))
    return rounded(Q.score(final.model, t.lineitem, final.schema), 4)


@query("score", f"select l_quantity, {r(PRICE, 4)} as \"Prediction\" from lineitem")
def _(t):
    df = t.lineitem.select("l_quantity", "l_extendedprice")
    final = TR.retrain_best(df, "l_extendedprice", "regression", "Linear Regression")
    return rounded(Q.score(final.model, t.lineitem, final.schema), 4)


CLEAN_TYPES = [{"price_txt": "double", "ship_txt": "timestamp_ntz"}.get(c, ty) for c, ty in zip(ALL_NAMES, ALL_TYPES)]
CLEAN_KINDS = [{"price_txt": "numerical", "ship_txt": "datetime"}.get(c, k) for c, k in zip(ALL_NAMES, ALL_KINDS)]


@query(
    "analyze_dataset",
    f"with {CLEAN_SQL}, {DATES_SQL}, {NUMBERS_SQL}, none as (select * from nums where false), nodate as (select * from dates where false) "
    f"select 'raw' as stage, * from ({profile_sql('messy_keyed', ALL_NAMES, ALL_TYPES, ALL_KINDS, 'dates', 'nums')}) union all "
    f"select 'cleaned', * from ({profile_sql('cleaned', ALL_NAMES, CLEAN_TYPES, CLEAN_KINDS, 'nodate', 'none')})",
)
def _(t):
    done = analysis.analyze_dataset(messy_keyed(t), ROW_ORDER)
    return done.profile.withColumn("stage", F.lit("raw")).unionByName(done.cleaned_profile.withColumn("stage", F.lit("cleaned")))


@query(
    "eda_export",
    f"with {MESSY_KEYED}, v as (select value, user_id from events), "
    "q as (select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from events) "
    "select 'missing' as \"table\", 4 as \"rows\" union all select 'correlation', 4 union all select 'histogram', 60 union all select 'boxplot', 2 "
    "union all select 'outliers', count(*) from events, q where value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1)",
)
def _(t):
    numbers = t.events.select("user_id", "value")
    return analysis.eda_export(numbers, messy_keyed(t), scratch_path(t.spark, "eda"), "run_1")


def kept_neighbours(t):
    return TR.retrain_best(t.customer.drop("c_name"), "c_mktsegment", "classification", "KNN", key=["c_custkey"])


@query("knn_retrain_best")
def _(t):
    """Segment of every customer by its five nearest customers."""
    return kept_neighbours(t).model.transform(t.customer).select("c_custkey", "c_mktsegment", F.col("predicted_label").alias("prediction"))


@query("knn_model_load", "select count(*) as \"rows\", count(*) as same from customer")
def _(t):
    final, folder = kept_neighbours(t), scratch_path(t.spark, "models")
    M.model_save(final, "best_model", folder, t.spark)
    one, two = (m.model.transform(t.customer).select("c_custkey", "predicted_label") for m in (final, M.model_load(t.spark, folder)))
    both = one.join(two.withColumnRenamed("predicted_label", "again"), "c_custkey")
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("predicted_label") == F.col("again")).alias("same"))
