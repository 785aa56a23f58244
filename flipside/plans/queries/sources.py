"""Reading, reshaping, storing (A)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from flipside.plans.inputs import FEATURES, OF_SQL, Z_SQL, order_features, pairs, pairs_sql, pred_sql, table, with_predictions
from flipside.plans.registry import R, query, r6, rounded
from flipside.session import checkpoint_dir
from flipside.sources import results, tables


@query(
    "a1_load_table",
    "select l_returnflag as dataset_id, l_orderkey as row_id, l_quantity, l_extendedprice, l_discount, l_tax, l_linestatus as y from lineitem",
)
def a1(spark, sf):
    rows, _ = tables.load_table(
        spark, f"{sf}/lineitem.parquet", "l_orderkey", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
        target="l_linestatus", dataset="l_returnflag",
    )
    return rows


def _run_files(spark, sf) -> str:
    """Write one run-result JSON per event type: the daily mean value is its
    loss, days are its epochs."""
    daily = (
        table(spark, sf, "events")
        .groupBy("event_type", F.dayofmonth("ts").alias("epoch"))
        .agg(F.round(F.avg("value"), 4).alias("loss"))
    )
    runs = daily.groupBy("event_type").agg(
        F.struct(F.first("event_type").alias("name"), F.count(F.lit(1)).cast("int").alias("epochs")).alias("config"),
        F.create_map(F.lit("delta_mse"), F.round(F.max("loss"), 4), F.lit("validity"), F.round(F.min("loss"), 4)).alias("metrics"),
        # At most 31 days: the log of a run is small by construction.
        F.sort_array(F.collect_list(F.struct("epoch", "loss"))).alias("training_log"),
    )
    path = f"{checkpoint_dir(spark).rstrip('/')}/runs-{uuid.uuid4().hex}"
    runs.repartition("event_type").write.partitionBy("event_type").json(path)
    return f"{path}/*/*.json"


_DAILY = "dl_ as (select event_type, dayofmonth(ts) as epoch, round(avg(value),4) as loss from events group by 1, 2)"


@query(
    "a2_read_run_results",
    f"with {_DAILY} select 'event_type=' || event_type as run, event_type as name, count(*) as epochs, max(loss) as delta_mse, min(loss) as validity from dl_ group by event_type",
)
def a2(spark, sf):
    runs = results.read_run_results(spark, _run_files(spark, sf))
    return runs.select(
        "run", "config.name", F.col("config.epochs").cast("long").alias("epochs"),
        F.col("metrics")["delta_mse"].alias("delta_mse"), F.col("metrics")["validity"].alias("validity"),
    )


@query("a3_explode_training_log", f"with {_DAILY} select 'event_type=' || event_type as run, epoch, loss from dl_")
def a3(spark, sf):
    log = results.explode_training_log(results.read_run_results(spark, _run_files(spark, sf)))
    return log.select("run", F.col("epoch").cast("long").alias("epoch"), "loss")


@query(
    "a4_pending_jobs",
    "select o_orderkey as row_id, o_orderstatus as dataset_id from orders where o_orderkey not in (select l_orderkey from lineitem)",
)
def a4(spark, sf):
    jobs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderstatus").alias("dataset_id"))
    done = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("row_id"))
    return results.pending_jobs(jobs, done, ["row_id"])


@query(
    "a4_write_results",
    "select o_orderstatus as method, c_mktsegment as dataset_id, count(*) as n from orders join customer on o_custkey=c_custkey group by 1, 2",
)
def a4w(spark, sf):
    """First write half of the results, then all of them: only the missing half is added."""
    counts = (
        table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("o_orderstatus").alias("method"), F.col("c_mktsegment").alias("dataset_id")).agg(F.count(F.lit(1)).alias("n"))
    )
    path = f"{checkpoint_dir(spark).rstrip('/')}/results-{uuid.uuid4().hex}"
    results.write_results(counts.filter("method = 'F'"), path, ["method", "dataset_id"])
    results.write_results(counts, path, ["method", "dataset_id"])
    return results.read_results(spark, path).select("method", "dataset_id", "n")


@query(
    "a4_overwrite_results",
    """select o_orderstatus as method, c_mktsegment as dataset_id, o_orderkey % 3 as split,
 case when o_orderkey % 3 = 1 then -count(*) else count(*) end as n from orders join customer on o_custkey=c_custkey group by 1, 2, 3""",
)
def a4o(spark, sf):
    """Overwriting one split leaves the other splits of its partition alone."""
    counts = (
        table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("o_orderstatus").alias("method"), F.col("c_mktsegment").alias("dataset_id"), (F.col("o_orderkey") % 3).alias("split"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    path = f"{checkpoint_dir(spark).rstrip('/')}/results-{uuid.uuid4().hex}"
    keys = ["method", "dataset_id", "split"]
    results.write_results(counts, path, keys)
    results.write_results(counts.filter("split = 1").withColumn("n", -F.col("n")), path, keys, mode="overwrite")
    return results.write_results(counts, path, keys, mode="fetch_only").select("method", "dataset_id", "split", "n")


def _list(expr):
    return "[" + ", ".join(f"round({expr(f)},6)+0.0::double" for f in FEATURES) + "]"


@query(
    "a5_export_examples",
    f"""with {Z_SQL}, {pairs_sql('additive_noise')}, {pred_sql()} select dataset_id, row_id, {_list(lambda f: f'coalesce({f},0.0::double)')} as query_x, y_cf_class as target_label,
 {_list(lambda f: 'd_' + f)} as true_delta, {_list(lambda f: 'p_' + f)} as pred_delta, {_list(lambda f: f'coalesce({f},0.0::double)+d_{f}')} as x_cf_true, {_list(lambda f: f'coalesce({f},0.0::double)+p_{f}')} as x_cf_pred
from q_ order by dataset_id, row_id limit 5""",
)
def a5(spark, sf):
    made = with_predictions(pairs(spark, sf, "additive_noise"))
    made = made.withColumns({f: F.coalesce(F.col(f), F.lit(0.0)) for f in FEATURES})
    out = results.example_rows(made, FEATURES, 5)
    arrays = [c for c, t in out.dtypes if t.startswith("array")]
    return out.withColumns({c: F.transform(c, lambda v: F.round(v, 6) + 0.0) for c in arrays})


@query(
    "a6_wide_to_long",
    f"with {OF_SQL} " + " union all ".join(f"select dataset_id, row_id, {i} as feat, {f} as value from of_" for i, f in enumerate(FEATURES)),
)
def a6(spark, sf):
    return tables.wide_to_long(order_features(spark, sf), FEATURES)


@query("a6_long_to_wide", f"with {OF_SQL} select dataset_id, row_id, {', '.join(FEATURES)} from of_")
def a6w(spark, sf):
    return tables.long_to_wide(tables.wide_to_long(order_features(spark, sf), FEATURES), FEATURES)
