"""Splits and samples (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flipside.functions.keyed import cumulative, softmax_weights
from flipside.operators import splits as C
from flipside.plans.inputs import BY, FEATURES, OF_SQL, SEED, U, UT, order_features, s, scored_orders, table
from flipside.plans.registry import query, rounded

_SD = str(SEED)
_BASE = "ob_ as (select c_mktsegment as dataset_id, o_orderkey as row_id, o_orderstatus as y from orders join customer on o_custkey=c_custkey)"


def _base(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(F.col("c_mktsegment").alias("dataset_id"), F.col("o_orderkey").alias("row_id"), F.col("o_orderstatus").alias("y"))


@query(
    "c1_keyed_shuffle",
    f"with {_BASE} select dataset_id, row_id, row_number() over (partition by dataset_id order by {U('13', 'row_id')}, row_id)-1 as pos from ob_",
)
def c1(spark, sf):
    return C.keyed_shuffle(_base(spark, sf), BY, "row_id", 13).select("dataset_id", "row_id", "pos")


@query("c1_keyed_shuffle_global", f"select o_orderkey as row_id, row_number() over (order by {U('13', 'o_orderkey')}, o_orderkey)-1 as pos from orders")
def c1g(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"))
    return C.keyed_shuffle(rows, [], "row_id", 13).select("row_id", "pos")


@query(
    "c2_effective_eval_pos",
    """with a as (select l_suppkey as did, count(*) as n from lineitem group by 1)
select did, n, (case when 600 > least(n, 1000) then floor(least(n,1000)*0.5) else 300 end)::int as eval_pos, (case when 600 > least(n, 1000) then floor(least(n,1000)*0.5) else 300 end)::int*2 as "window" from a""",
)
def c2(spark, sf):
    rows = table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "did")
    return C.effective_eval_pos(rows, ["did"], 1000, 300)


def _valid_sql(bptt, ep):
    starts = ", ".join(f"(case when n > {bptt} then floor({UT(str(sd), 'dataset_id', s('offset'))}*(n-{bptt}+1)) else 0 end)::bigint as s{sd}" for sd in C.SPLIT_SEEDS)
    hits = " union all ".join(
        f"select a.dataset_id, {sd} as seed, any_value(s{sd}) as start, y, max((pos-s{sd} >= 0 and pos-s{sd} < {ep})::int) as a, max((pos-s{sd} >= {ep} and pos-s{sd} < {bptt})::int) as b from a join st using (dataset_id) group by a.dataset_id, y"
        for sd in C.SPLIT_SEEDS
    )
    return f"""with cu_ as (select o_custkey as dataset_id, o_orderkey as row_id, o_orderstatus as y from orders),
a as (select *, row_number() over (partition by dataset_id order by row_id)-1 as pos, count(*) over (partition by dataset_id) as n from cu_),
st as (select dataset_id, {starts} from (select distinct dataset_id, n from a)),
h as ({hits}), j as (select dataset_id, seed, any_value(start) as start from h group by dataset_id, seed having min(least(a,b)) = 1),
f as (select dataset_id, min_by(start, seed) as start, min(seed) as seed from j group by dataset_id)
select dataset_id, row_id, y, seed::int as seed, pos-start as split_pos, case when pos-start < {ep} then 'train' else 'test' end as role from a join f using (dataset_id) where pos-start >= 0 and pos-start < {bptt}"""


@query("c3_valid_split", _valid_sql(10, 5))
def c3(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("dataset_id"), F.col("o_orderkey").alias("row_id"), F.col("o_orderstatus").alias("y")
    )
    ordered = C.split_order(rows, BY, "row_id", 1)
    return C.valid_split(ordered, BY, "y", 10, 5).select("dataset_id", "row_id", "y", "seed", "split_pos", "role")


def _compat_sql(ep, tries=C.LABEL_TRIES):
    ctes = ["p0 as (select o_custkey as dataset_id, o_orderkey as row_id, case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end as y from orders)"]
    outs = []
    for t in range(tries + 1):
        order = "row_id" if t == 0 else f"{U(str(SEED * 1000 + t), 'row_id')}, row_id"
        ctes.append(f"o{t} as (select *, row_number() over (partition by dataset_id order by {order})-1 as pos from p{t})")
        ctes.append(f"k{t} as (select dataset_id, min(least(a,b))=1 and count(*)>1 as ok from (select dataset_id, y, max((pos<{ep})::int) as a, max((pos>={ep})::int) as b from o{t} group by 1,2) group by 1)")
        ctes.append(f"p{t + 1} as (select p{t}.* from p{t} join k{t} using (dataset_id) where not ok)")
        outs.append(f'select dataset_id, row_id, y, pos, {t} as "try" from o{t} join k{t} using (dataset_id) where ok')
    outs.append(f'select dataset_id, row_id, -100, row_number() over (partition by dataset_id order by row_id)-1, {tries + 1} from p{tries + 1}')
    return "with " + ", ".join(ctes) + " " + " union all ".join(outs)


@query("c4_split_compatible_or_ignore", _compat_sql(4))
def c4(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("dataset_id"),
        F.col("o_orderkey").alias("row_id"),
        F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("y"),
    )
    return C.split_compatible_or_ignore(rows, BY, "row_id", "y", 4, SEED)


def _pos_sql(weighted):
    edges = cumulative(C.eval_pos_weights(10, 60, weighted))
    u = U(_SD, "c_custkey", s("pos"))
    return f"(10 + len(list_filter([{', '.join(f'{e!r}::double' for e in edges)}], lambda e: e <= {u})))::int"


@query("c5_sample_eval_pos", f"select c_custkey as row_id, {_pos_sql(False)} as uniform, {_pos_sql(True)} as weighted from customer")
def c5(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("row_id"),
        C.sample_eval_pos(10, 60, False, SEED, k, "pos").alias("uniform"),
        C.sample_eval_pos(10, 60, True, SEED, k, "pos").alias("weighted"),
    )


@query(
    "c6_kfold",
    f"with {_BASE} select dataset_id, row_id, ((row_number() over (partition by dataset_id order by {U(_SD, 'row_id')}, row_id)-1) % 5)::int as fold from ob_",
)
def c6(spark, sf):
    return C.kfold(_base(spark, sf), BY, "row_id", SEED).select("dataset_id", "row_id", "fold")


_PICK = C.subsample_features(FEATURES, 3, SEED)


@query(
    "c8_subsample_features",
    f"""with {OF_SQL} select row_id, {', '.join(f for f in FEATURES if f in _PICK)} from of_""",
)
def c8(spark, sf):
    return order_features(spark, sf).select("row_id", *C.subsample_features(FEATURES, 3, SEED))


@query("c9_subsample_rows", f"select o_orderkey as row_id from orders order by md5(concat_ws('|', '{_SD}', o_orderkey::varchar)), o_orderkey limit 1000")
def c9(spark, sf):
    return C.subsample_rows(table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id")), "row_id", 1000, SEED)


_EDGES = cumulative(softmax_weights([2.0, 0.5]))
_US = U(_SD, "o_orderkey", s("source"))


@query(
    "c10_mix_sources",
    f"""select o_orderkey as row_id, case when {_US} < {_EDGES[0]!r}::double then 0 when {_US} < {_EDGES[1]!r}::double then 1 else 2 end as source,
 case when {_US} < {_EDGES[0]!r}::double then o_totalprice when {_US} < {_EDGES[1]!r}::double then o_custkey::double else -o_totalprice end as value from orders""",
)
def c10(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "row_id")
    sources = [
        o.select("row_id", F.col("o_totalprice").alias("value")),
        o.select("row_id", F.col("o_custkey").cast("double").alias("value")),
        o.select("row_id", (-F.col("o_totalprice")).alias("value")),
    ]
    return C.mix_sources(o.select("row_id"), sources, [2.0, 0.5], "row_id", SEED)


@query("c11_concat_batches", "select s_suppkey as k, s_acctbal as v from supplier union all select c_custkey, c_acctbal from customer")
def c11(spark, sf):
    return C.concat_batches(
        [
            table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v")),
            table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")),
        ]
    )
