"""Dataset catalog (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flipside.operators import catalog as B
from flipside.plans.inputs import FEATURES, OF_SQL, U, UT, order_features, s, table
from flipside.plans.registry import R, query, rounded
from flipside.session import checkpointed

_HOLES = "(" + "+".join(f"({f} is null)::int" for f in FEATURES) + ")"


@query(
    "b1_dataset_profile",
    f"""with {OF_SQL}, c as (select dataset_id, label_str, count(*) as n, sum({_HOLES}) as cells, sum(({_HOLES}>0)::int) as rs from of_ group by 1,2)
select dataset_id, sum(n)::bigint as n_instances, 5 as n_features, 0 as n_symbolic, 5 as n_numeric, 0::bigint as max_nominal, sum(cells)::bigint as n_missing, sum(rs)::bigint as n_rows_missing, count(*) as n_classes, min(n) as minority, max(n) as majority from c group by 1""",
)
def b1(spark, sf):
    return B.dataset_profile(order_features(spark, sf), FEATURES, "label_str")


def supplier_catalog(spark, sf):
    """One dataset per supplier: its line items, labelled by return flag."""
    rows = table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "did")
    prof = B.dataset_profile(rows, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "l_returnflag", by="did")
    sup = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("did"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")
    )
    return prof.join(sup, "did")


CAT_SQL = """ca0_ as (select l_suppkey as did, l_returnflag, count(*) as n from lineitem group by 1,2),
ca_ as (select did, s_name as name, s_nationkey as nation, sum(n)::bigint as n_instances, 4 as n_features, 0 as n_symbolic, 0::bigint as n_missing, 0::bigint as n_rows_missing, count(*) as n_classes, min(n) as minority, max(n) as majority from ca0_ join supplier on s_suppkey = did group by 1,2,3)"""
_COLS = ["did", "name", "n_instances", "n_classes", "minority", "majority"]


@query("b2_catalog_filter", f"with {CAT_SQL} select {', '.join(_COLS)} from ca_ where n_instances >= 590 and n_instances <= 620 and n_features <= 100 and n_classes <= 10 and n_rows_missing = 0")
def b2(spark, sf):
    return B.catalog_filter(supplier_catalog(spark, sf), min_samples=590, max_samples=620, without_missing=True).select(*_COLS)


_CAPS = f"""cp0_ as (select c_mktsegment as dataset_id, o_orderkey as row_id, c_nationkey as y, o_totalprice as f_0, c_acctbal as f_1, {U('13', 'o_orderkey')} as u from orders join customer on o_custkey=c_custkey),
cp1_ as (select *, row_number() over (partition by dataset_id order by u, row_id)-1 as pos from cp0_),
cp2_ as (select * from cp1_ where pos < 2000),
cp3_ as (select dataset_id, y, count(*) as n from cp2_ group by 1,2),
cp4_ as (select *, row_number() over (partition by dataset_id order by y)-1 as place, count(*) over (partition by dataset_id) as k, sum(n) over (partition by dataset_id) as rs from cp3_)"""


def _capped(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select(
        F.col("c_mktsegment").alias("dataset_id"), F.col("o_orderkey").alias("row_id"), F.col("c_nationkey").alias("y"),
        F.col("o_totalprice").alias("f_0"), F.col("c_acctbal").alias("f_1"), F.col("o_orderdate").alias("f_2"),
    )
    return B.apply_caps(rows, ["f_0", "f_1", "f_2"], "y", 2000, 2, 10, categorical=[0, 2])


@query("b3_apply_caps", f"with {_CAPS} select dataset_id, row_id, y, f_0, f_1, pos from cp2_ join cp4_ using (dataset_id, y) where k <= 10 or place < 10")
def b3(spark, sf):
    rows, kept, _ = _capped(spark, sf)
    if kept != [0]:
        raise AssertionError("categorical indices beyond the cap must go")
    return rows.select("dataset_id", "row_id", "y", "f_0", "f_1", "pos")


_FLAGS = "fl_ as (select dataset_id, max(rs)=2000 as samples_capped, true as feats_capped, max(k)>10 as classes_capped from cp4_ group by 1)"


@query("b3_cap_flags", f"with {_CAPS}, {_FLAGS} select * from fl_")
def b3f(spark, sf):
    return _capped(spark, sf)[2]


@query(
    "b4_catalog_dedup",
    f"""with {CAT_SQL}, a as (select *, row_number() over (partition by n_instances, n_classes order by did) as r from ca_),
b as (select *, row_number() over (partition by nation order by did) as q from a where r = 1) select {', '.join(_COLS)}, nation from b where q = 1""",
)
def b4(spark, sf):
    return B.catalog_dedup(supplier_catalog(spark, sf), ["n_instances", "n_classes"], name="nation").select(*_COLS, "nation")


@query(
    "b4_catalog_dedup_signature",
    f"""with s_ as (select l_suppkey as did, count(distinct l_linestatus) as v from lineitem group by 1), {CAT_SQL},
a as (select ca_.did, ca_.name, nation, n_instances, n_classes, minority, majority, row_number() over (partition by majority, v, minority, n_classes, n_instances order by ca_.did) as r from ca_ join s_ using (did)),
b as (select *, row_number() over (partition by name order by did) as q from a where r = 1) select {', '.join(_COLS)} from b where q = 1""",
)
def b4_signature(spark, sf):
    """The profile's own columns are the default signature."""
    rows = table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "did")
    prof = B.dataset_profile(rows, ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus"], "l_returnflag", by="did", symbolic=["l_linestatus"])
    sup = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("did"), F.col("s_name").alias("name"))
    return B.catalog_dedup(prof.join(sup, "did")).select(*_COLS)


_OTHER = "ot_ as (select ca_.*, concat_ws('_', n_classes, n_features, n_instances) as cfi from ca_ join supplier on s_suppkey=did where s_acctbal < 0)"


@query(
    "b5_catalog_exclude",
    f"""with {CAT_SQL}, {_OTHER} select {', '.join(_COLS)} from ca_ where name not in (select name from ot_) and concat_ws('_', n_classes, n_features, n_instances) not in (select cfi from ot_)
 and name not like '%77%' and name not like '%13%' and did not in (3, 4, 5)""",
)
def b5(spark, sf):
    cat = supplier_catalog(spark, sf)
    poor = table(spark, sf, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("did"))
    other = cat.join(poor, "did", "left_semi")
    return B.catalog_exclude(cat, other, ["77", "13"], [3, 4, 5]).select(*_COLS)


@query("b6_class_skew_filter", f"with {CAT_SQL} select {', '.join(_COLS)} from ca_ where minority::double/majority > 0.85")
def b6(spark, sf):
    return B.class_skew_filter(supplier_catalog(spark, sf), 0.85).select(*_COLS)


# Every segment three times: with its own labels, with labels that a price decides, and with one label.
_KINDS_SQL = f"""{OF_SQL}, kd_ as (select dataset_id || '/' || k.k as dataset_id, row_id, f_0, f_1, f_2, f_3, f_4,
  case k.k when 'own' then label_str when 'easy' then case when f_0 > 150000 then 'high' else 'low' end else 'same' end as y from of_ cross join (values ('own'), ('easy'), ('one')) k(k)),
ks_ as (select dataset_id, y, count(*) as n from kd_ group by 1, 2),
kp_ as (select dataset_id, sum(n)::bigint as n_instances, count(*) as n_classes, min(n) as minority, max(n) as majority from ks_ group by 1),
ka_ as (select dataset_id, y = lag(y) over (partition by dataset_id order by row_id) as same from kd_),
kb_ as (select dataset_id, sum(same::int)::double / count(same) as autocorrelation from ka_ group by 1),
kv_ as ({' union all '.join(f"select dataset_id, {i} as feat, coalesce({f}, '-inf'::double) as v, y from kd_" for i, f in enumerate(FEATURES))}),
kc_ as (select dataset_id, feat, v, y, count(*) as c from kv_ group by all),
kg_ as (select u.dataset_id, u.feat, u.v, ks_.y, ks_.n, coalesce(c, 0) as c from (select distinct dataset_id, feat, v from kv_) u join ks_ on ks_.dataset_id = u.dataset_id
  left join kc_ on kc_.dataset_id = u.dataset_id and kc_.feat = u.feat and kc_.v = u.v and kc_.y = ks_.y),
kr_ as (select dataset_id, feat, v, n, sum(c) over (partition by dataset_id, feat, y order by v) as hit from kg_),
kt_ as (select *, sum(n) over g as al, sum(hit) over g as below from kr_ window g as (partition by dataset_id, feat, v)),
ku_ as (select dataset_id, feat, v, 0.5::double + sum(n * abs(hit::double / n - (below - hit)::double / (al - n))) / (2.0::double * any_value(al)) as auc from kt_ where al > n group by 1, 2, 3),
kw_ as (select dataset_id, max(auc) as stump_auc from ku_ group by 1),
kx_ as (select dataset_id, n_instances, n_classes, minority, majority, autocorrelation, stump_auc from kp_ join kb_ using (dataset_id) left join kw_ using (dataset_id))"""
_EASE = ["dataset_id", "n_instances", "n_classes", "minority", "majority", "autocorrelation", "stump_auc"]


def _kinds(spark, sf):
    rows = order_features(spark, sf).withColumn("kind", F.explode(F.array(F.lit("own"), F.lit("easy"), F.lit("one"))))
    price = F.when(F.col("f_0") > 150000, "high").otherwise("low")
    rows = rows.withColumn("y", F.when(F.col("kind") == "own", F.col("label_str")).when(F.col("kind") == "easy", price).otherwise("same"))
    rows = checkpointed(rows.withColumn("dataset_id", F.concat_ws("/", "dataset_id", "kind")))
    return B.dataset_profile(rows, FEATURES, "y", key="row_id").select(*_EASE)


@query("b1_order_and_ease", f"with {_KINDS_SQL} select {', '.join(_EASE[:5])}, {R('autocorrelation', 'autocorrelation', 9)}, {R('stump_auc', 'stump_auc', 9)} from kx_")
def b1_ease(spark, sf):
    return rounded(_kinds(spark, sf), 9)


@query("b6_without_sorted_and_easy", f"with {_KINDS_SQL} select {', '.join(_EASE[:5])} from kx_ where minority::double/majority > 0.02 and autocorrelation <> 1 and (stump_auc is null or stump_auc <> 1)")
def b6_ease(spark, sf):
    """The segments with their own labels stay; one price decides the second kind, the third has one label."""
    return B.class_skew_filter(_kinds(spark, sf), 0.02).select(*_EASE[:5])


@query("b7_restrict_binary", "select vec_id as row_id, label as y from embeddings where label < 2")
def b7(spark, sf):
    return B.restrict_binary(table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").alias("y")))


_BIN = "bi_ as (select c_mktsegment as dataset_id, o_orderkey as row_id, (o_orderstatus='F')::int as y from orders join customer on o_custkey=c_custkey)"


def _binary(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(
        F.col("c_mktsegment").alias("dataset_id"), F.col("o_orderkey").alias("row_id"), (F.col("o_orderstatus") == "F").cast("int").alias("y")
    )


@query(
    "b8_balanced_interleave",
    f"""with {_BIN}, a as (select *, row_number() over (partition by dataset_id, y order by row_id)-1 as i, count(*) over (partition by dataset_id, y) as n, sum(y) over (partition by dataset_id) as ones, count(*) over (partition by dataset_id) as al from bi_),
b as (select *, (case when ones*2 < al then 1 else 0 end) = y as rare, least(ones, al-ones) as m from a), c as (select *, case when rare then i else i-(n-m) end as h from b)
select dataset_id, row_id, y, (m*2-1-(h*2+rare::int))::bigint as pos from c where h >= 0 and h < m""",
)
def b8(spark, sf):
    return B.balanced_interleave(_binary(spark, sf), "y").select("dataset_id", "row_id", "y", "pos")


@query(
    "b8_order_by_label",
    f"""with {_BIN}, a as (select *, row_number() over (partition by dataset_id order by case when {UT('13', 'dataset_id', s('direction'))} < 0.5 then -y else y end, row_id)-1 as i, count(*) over (partition by dataset_id)//2 as h from bi_)
select dataset_id, row_id, y, (case when i < h then i*2 when i < 2*h then (i-h)*2+1 else i end)::bigint as pos from a""",
)
def b8o(spark, sf):
    return B.order_by_label(_binary(spark, sf), "y").select("dataset_id", "row_id", "y", "pos")


@query(
    "b9_capped_name_suffix",
    f"with {_CAPS}, {_FLAGS} select dataset_id, dataset_id || ' [' || case when samples_capped then 's' else '' end || 'f' || case when classes_capped then 'c' else '' end || ']' as name from fl_",
)
def b9(spark, sf):
    return _capped(spark, sf)[2].select("dataset_id", B.capped_name_suffix(F.col("dataset_id")).alias("name"))
