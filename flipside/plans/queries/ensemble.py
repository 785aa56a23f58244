"""Ensembling of predictions (N)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flipside.functions.keyed import uniform01
from flipside.operators import ensemble as N
from flipside.operators.metrics import accuracy
from flipside.plans.inputs import SEED, U, embedding_points, s
from flipside.plans.registry import R, query, rounded
from flipside.operators.transforms import row_zscore

K = 10
_SD = str(SEED)


def _shape(spark, sf) -> tuple[int, int]:
    """Classes and features of the embeddings table."""
    row = embedding_points(spark, sf).agg(F.count_distinct("label"), F.max(F.size("features"))).first()
    return row[0], row[1]


_GRID = f"""n_ as (select count(distinct label) as k, max(len(embedding)) as h from embeddings),
gr0_ as (select i, i % k as class_shift, i // k as feature_shift from n_, (select unnest(range(640)) as i)),
gr1_ as (select *, row_number() over (order by md5(concat_ws('|', '{_SD}', i::varchar)), i)-1 as r from gr0_),
gr_ as (select (r*2+t)::int as config_rank, class_shift::int as class_shift, feature_shift::int as feature_shift, case t when 0 then 'none' else 'power' end as transform from gr1_ cross join (values (0),(1)) x(t) where r*2+t < 10)"""


def _grid(spark, sf, n=10):
    k, h = _shape(spark, sf)
    return N.ensemble_grid(spark, k, h, n, SEED)


@query("n1_ensemble_grid", f"with {_GRID} select * from gr_")
def n1(spark, sf):
    return _grid(spark, sf)


@query("n2_shift_labels", "select vec_id as row_id, (label+3) % 10 as y from embeddings")
def n2(spark, sf):
    return embedding_points(spark, sf).select("row_id", N.shift_labels(F.col("label"), 3, K).alias("y"))


def _outputs(spark, sf, n=10):
    """Logits of every configuration for every row, in the rotated class order:
    place c holds class (c - shift) mod K."""
    k, _ = _shape(spark, sf)
    rows = embedding_points(spark, sf).select("row_id", F.col("label").alias("y"))
    rows = rows.withColumn("c", F.explode(N.config_literals(_grid(spark, sf, n))))
    rows = rows.select("row_id", "y", "c.config_rank", "c.class_shift")
    logits = F.transform(
        F.sequence(F.lit(0), F.lit(k - 1)),
        lambda j: F.round(uniform01(SEED, F.col("row_id"), F.col("config_rank"), j) * 2.0, 4)
        + F.when(F.pmod(j - F.col("class_shift"), F.lit(k)) == F.col("y"), F.lit(0.5)).otherwise(F.lit(0.0)),
    )
    return rows.withColumn("logits", logits)


_LG = f"""lg0_ as (select vec_id as row_id, label as y, config_rank, class_shift, j, (j - class_shift + 10) % 10 as cls,
 (round({U(_SD, 'vec_id', 'config_rank', 'j')}*2.0::double, 4) + case when (j - class_shift + 10) % 10 = label then 0.5::double else 0.0::double end)/0.8::double as z from embeddings cross join gr_ cross join (select unnest(range(10)) as j)),
lg_ as (select *, exp(z)/sum(exp(z)) over (partition by row_id, config_rank) as p from lg0_)"""


def _avg_sql(size: int | None, logits: bool) -> str:
    cond = f"where config_rank < {size}" if size else ""
    if logits:
        return f"select row_id, y, cls, exp(m)/sum(exp(m)) over (partition by row_id) as p from (select row_id, y, cls, avg(z) as m from lg_ {cond} group by row_id, y, cls)"
    return f"select row_id, y, cls, avg(p) as p from lg_ {cond} group by row_id, y, cls"


_PACK = "select row_id, list(round(p,6)+0.0::double order by cls) as probs from a_ group by row_id"


def _arr(df):
    return df.withColumn("probs", F.transform("probs", lambda v: F.round(v, 6) + 0.0))


@query("n3_ensemble_average", f"with {_GRID}, {_LG}, a_ as ({_avg_sql(None, True)}) {_PACK}")
def n3(spark, sf):
    return _arr(N.ensemble_average(_outputs(spark, sf), ["row_id"], K))


@query("n3_ensemble_average_probs", f"with {_GRID}, {_LG}, a_ as ({_avg_sql(None, False)}) {_PACK}")
def n3p(spark, sf):
    return _arr(N.ensemble_average(_outputs(spark, sf), ["row_id"], K, average_logits=False))


@query(
    "n4_predict_label",
    f"with {_GRID}, {_LG}, a_ as ({_avg_sql(None, True)}) select row_id, 'class_' || arg_max(cls, p) as label, {R('max(p)', 'winning_prob')} from a_ group by row_id",
)
def n4(spark, sf):
    avg = N.ensemble_average(_outputs(spark, sf), ["row_id"], K)
    return rounded(N.predict_label(avg, [f"class_{i}" for i in range(K)]).select("row_id", "label", "winning_prob"))


@query(
    "n5_expand_config_rows",
    f"""with {_GRID}, c_ as (select vec_id, unnest(embedding)::double as v, unnest(range(64)) as i from embeddings), m_ as (select vec_id, avg(v) as m, stddev_samp(v) as s from c_ group by vec_id),
e_ as (select vec_id, list(round(v,6)+0.0::double order by i) as a, list(round((v-m)/s,6)+0.0::double order by i) as b from c_ join m_ using (vec_id) group by vec_id),
x_ as (select vec_id as row_id, config_rank, feature_shift, (label+class_shift) % 10 as y_shifted, case transform when 'none' then a else b end as x from e_ join embeddings using (vec_id) cross join gr_)
select row_id, config_rank, y_shifted, x[feature_shift+1:64] || x[1:feature_shift] as x from x_""",
)
def n5(spark, sf):
    def rnd(c):
        return F.transform(c, lambda v: F.round(v, 6) + 0.0)

    pts = embedding_points(spark, sf).select(
        "row_id", "label", rnd(F.col("features")).alias("plain"), rnd(row_zscore(F.col("features"))).alias("scaled")
    )
    out = N.expand_config_rows(pts, _grid(spark, sf), {"none": "plain", "power": "scaled"}, "label", K)
    return out.select("row_id", "config_rank", "y_shifted", "x")


_GRID_100 = _GRID.replace("where r*2+t < 10)", "where r*2+t < 100)")


@query(
    "n6_ensemble_size_sweep",
    f"with {_GRID_100}, {_LG}, "
    + ", ".join(f"a{n}_ as ({_avg_sql(n, True)}), h{n}_ as (select row_id, y, arg_max(cls, p) as c from a{n}_ group by row_id, y)" for n in N.SIZES)
    + " " + " union all ".join(f"select row_id % 5 + 1 as split, {n} as size, {R('avg((c=y)::int)', 'accuracy')} from h{n}_ group by 1" for n in N.SIZES),
)
def n6(spark, sf):
    """Every size up to 100 configurations, on the rows of five splits."""
    out = N.ensemble_size_sweep(_outputs(spark, sf, 100), ["row_id", "y"], K)
    return rounded(out.groupBy((F.col("row_id") % 5 + 1).alias("split"), "size").agg(accuracy().alias("accuracy")))
