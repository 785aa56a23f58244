"""The tables the registered queries run on, built from the given parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flipside.functions.keyed import draw_tag, text_uniform01, uniform01
from flipside.operators.perturb import PerturbConfig, fit_pairs, label_pairs, linear_score, perturb
from flipside.operators.transforms import zscore
from flipside.session import checkpointed

FEATURES = ["f_0", "f_1", "f_2", "f_3", "f_4"]
BY = ["dataset_id"]
SEED = 42
WEIGHTS = {"f_0": 1.0, "f_1": 0.5, "f_3": -0.3, "f_4": 0.2}
SCORE = linear_score(WEIGHTS)

# Strength and noise of each made-up prediction method.
METHODS = {
    "m0": (0.2, 0.9),
    "m1": (0.4, 0.9),
    "m2": (0.6, 0.9),
    "m3": (0.6, 0.9),
    "m4": (0.8, 0.7),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: 5 numeric features, dataset = market segment."""
    # Dealt by the join's key: the join needs it anyway, and a table in one file would stay one task otherwise.
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice").repartition("o_orderkey")
    customer = table(spark, sf_dir, "customer")
    items = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).cast("double").alias("n_items"),
            F.round(F.sum("l_quantity"), 4).alias("sum_qty"),
            F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        )
    )
    return (
        orders.join(items, items.l_orderkey == orders.o_orderkey, "left")
        .join(customer, orders.o_custkey == customer.c_custkey)
        .select(
            F.col("o_orderkey").alias("row_id"),
            F.col("c_mktsegment").alias("dataset_id"),
            F.col("o_orderstatus").alias("label_str"),
            F.col("o_totalprice").alias("f_0"),
            F.col("n_items").alias("f_1"),
            F.col("sum_qty").alias("f_2"),
            F.col("avg_disc").alias("f_3"),
            F.col("c_acctbal").alias("f_4"),
        )
    )


def scored_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z-scored order features with the target score y.

    The joined features are kept as a table: every fit and the final pass read them.
    """
    z = zscore(checkpointed(order_features(spark, sf_dir)), FEATURES, BY)
    return z.withColumn("y", SCORE({f: F.col(f) for f in FEATURES}))


def pairs(spark: SparkSession, sf_dir: str, strategy: str, **options) -> DataFrame:
    """Factual/counterfactual pairs of the z-scored orders under one strategy."""
    return fitted_pairs(spark, sf_dir, strategy, **options)[0]


def fitted_pairs(spark: SparkSession, sf_dir: str, strategy: str, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The pairs, the scored rows they come from, and the frozen thresholds."""
    cfg = PerturbConfig(seed=SEED, score=SCORE, **options)
    rows = scored_orders(spark, sf_dir)
    spread, threshold = fit_pairs(rows, FEATURES, "y", BY)
    made = perturb(rows.drop("y"), FEATURES, strategy, BY, cfg, spread)
    return label_pairs(made, FEATURES, SCORE, BY, threshold), rows, threshold


def with_predictions(made: DataFrame) -> DataFrame:
    """Predicted deltas p_f and mask logits g_f: the true delta plus keyed noise."""
    return made.withColumns(
        {
            **{
                f"p_{f}": F.col(f"d_{f}") * 0.9 + (uniform01(SEED, F.col("row_id"), f, "pred") - 0.5) * 0.4
                for f in FEATURES
            },
            **{f"g_{f}": (uniform01(SEED, F.col("row_id"), f, "logit") - 0.5) * 4.0 + F.when(F.col(f"m_{f}"), F.lit(1.0)).otherwise(F.lit(-1.0)) for f in FEATURES},
        }
    )


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.lit("embeddings").alias("dataset_id"),
        F.col("vec_id").alias("row_id"),
        F.col("embedding").cast("array<double>").alias("features"),
        F.col("label"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary predictions of five methods over five splits for every order.

    The label is 'order status is F'.
    """
    rows = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").alias("row_id"),
            F.col("c_mktsegment").alias("dataset_id"),
            (F.col("o_orderstatus") == "F").cast("int").alias("y"),
        )
        # Every row becomes 25 prediction rows: spread the narrow rows first.
        .repartition("row_id")
    )
    grid = F.explode(
        F.array(
            *[
                F.struct(F.lit(m).alias("method"), F.lit(i).alias("number"), F.lit(s).alias("split"), F.lit(a).alias("strength"), F.lit(n).alias("noise"))
                for i, (m, (a, n)) in enumerate(METHODS.items())
                for s in range(1, 6)
            ]
        )
    )
    out = rows.withColumn("g", grid).select("row_id", "dataset_id", "y", "g.method", "g.number", "g.split", "g.strength", "g.noise")
    draw = uniform01(F.col("row_id") * 64 + F.col("number") * 8 + F.col("split"))
    raw = F.lit(0.5) + (F.col("y") - F.lit(0.5)) * F.col("strength") * 0.5 + (draw - 0.5) * F.col("noise")
    score = F.greatest(F.lit(0.001), F.least(F.lit(0.999), F.round(raw, 4)))
    return out.select(
        "method",
        F.lit(60).alias("max_time"),
        "split",
        "dataset_id",
        F.lit(1000).alias("eval_pos"),
        "row_id",
        "y",
        F.array(F.lit(1.0) - score, score).alias("probs"),
        (F.lit(10.0) * (1 + F.substring("method", 2, 1).cast("int")) + F.col("split")).cast("double").alias("time_s"),
    )


def class_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-class predictions for every embedding, two made-up methods."""
    pts = embedding_points(spark, sf_dir).select("dataset_id", "row_id", F.col("label").alias("y"))
    pts = pts.withColumn("method", F.explode(F.array(F.lit("m0"), F.lit("m1"))))
    raw = F.transform(
        F.sequence(F.lit(0), F.lit(9)),
        lambda k: F.round(
            text_uniform01(F.col("method"), F.col("row_id"), k)
            + F.when(k == F.col("y"), F.when(F.col("method") == "m1", F.lit(0.6)).otherwise(F.lit(0.2))).otherwise(F.lit(0.0)),
            3,
        ),
    )
    total = F.aggregate("raw", F.lit(0.0), lambda a, v: a + v)
    return (
        pts.withColumn("raw", raw)
        .withColumn("probs", F.transform("raw", lambda v: v / total))
        .select("method", "dataset_id", "row_id", "y", "probs")
    )


# ---------------------------------------------------------------------------
# The same tables as DuckDB text, for the checks.
# ---------------------------------------------------------------------------

OF_SQL = """of_ as (
select o.o_orderkey as row_id, c.c_mktsegment as dataset_id, o.o_orderstatus as label_str,
       o.o_totalprice as f_0, l.n_items as f_1, l.sum_qty as f_2, l.avg_disc as f_3, c.c_acctbal as f_4
from orders o join customer c on o.o_custkey = c.c_custkey
left join (select l_orderkey, cast(count(*) as double) n_items,
                  round(sum(l_quantity),4) sum_qty, round(avg(l_discount),6) avg_disc
           from lineitem group by l_orderkey) l on l.l_orderkey = o.o_orderkey)"""


def UT(*parts: str) -> str:
    """Keyed uniform of a text key as SQL; parts are SQL expressions."""
    key = ", ".join(f"cast({p} as varchar)" for p in parts)
    return f"(('0x'||substr(md5(concat_ws('|', {key})),1,8))::bigint/4294967296.0::double)"


# Multipliers of the public 64-bit xxHash.
XX = [0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5]
_LOW = f"{2**64 - 1}::uhugeint"


def _let(expr: str, body: str) -> str:
    return f"list_transform([{expr}], lambda h: {body})[1]"


def _xx_step(seed: str, column: str) -> str:
    """xxHash of one 64-bit integer, in 128-bit arithmetic."""
    def times(x: str, i: int) -> str:
        return f"((({x})*{XX[i]}::uhugeint)&{_LOW})"

    def rotate(x: str, n: int) -> str:
        return _let(x, f"(((h*{2**n}::uhugeint)&{_LOW})+(h>>{64 - n}))")

    def fold(x: str, n: int) -> str:
        return _let(x, f"xor(h, (h>>{n}))")

    value = times(rotate(times(f"({column})::uhugeint", 1), 31), 0)
    h = f"xor(((({seed})+{(XX[4] + 8) % 2**64}::uhugeint)&{_LOW}), {value})"
    h = f"(({times(rotate(h, 27), 0)}+{XX[3]}::uhugeint)&{_LOW})"
    return fold(times(fold(times(fold(h, 33), 1), 29), 2), 32)


def _xx_known(seed: int, value: int) -> int:
    """The same step for a value known when the text is written."""
    wrap = 2**64

    def rotate(x: int, n: int) -> int:
        return (x << n) % wrap | x >> (64 - n)

    h = (seed + XX[4] + 8) % wrap ^ rotate(value % wrap * XX[1] % wrap, 31) * XX[0] % wrap
    h = (rotate(h, 27) * XX[0] + XX[3]) % wrap
    h = (h ^ h >> 33) * XX[1] % wrap
    h = (h ^ h >> 29) * XX[2] % wrap
    return h ^ h >> 32


def _is_value(part: str) -> bool:
    return part.isdigit() or (part.startswith("'") and part.endswith("'"))


def U(*parts: str) -> str:
    """Keyed uniform of integer columns as SQL; numbers and quoted texts are plain values."""
    known = _xx_known(42, draw_tag(*[p.strip("'") for p in parts if _is_value(p)]))
    columns = [p for p in parts if not _is_value(p)]
    while columns and columns[0].endswith("::bigint") and columns[0].removesuffix("::bigint").isdigit():
        known = _xx_known(known, int(columns.pop(0).removesuffix("::bigint")))
    h = f"{known}::uhugeint"
    for p in columns:
        h = _xx_step(h, p)
    return f"((({h})>>11)::double/9007199254740992.0::double)"


def s(text: str) -> str:
    return f"'{text}'"


def normal_sql(*parts: str) -> str:
    return f"(sqrt(-2.0::double*ln(1.0::double-{U(*parts, s('a'))}))*cos(2.0::double*pi()*{U(*parts, s('b'))}))"


def sign_sql(*parts: str) -> str:
    return f"(case when {U(*parts)} > 0.5 then 1.0::double else -1.0::double end)"


def _zscores_sql() -> str:
    stats = ", ".join(f"avg({f}) as mu_{f}, stddev_samp({f}) as sd_{f}" for f in FEATURES)
    z = ", ".join(
        f"greatest(-100.0::double, least(100.0::double, ({f}-mu_{f})/(sd_{f}+0.000001::double))) as z_{f}" for f in FEATURES
    )
    zz = ", ".join(f"case when {f} is null then null else z_{f} end as {f}" for f in FEATURES)
    y = " + ".join(f"{w}::double*coalesce({f},0.0::double)" for f, w in WEIGHTS.items())
    return f"""zs_ as (select dataset_id, {stats} from of_ group by dataset_id),
z0_ as (select row_id, of_.dataset_id, label_str, {', '.join(FEATURES)}, {z} from of_ join zs_ on of_.dataset_id = zs_.dataset_id),
z1_ as (select row_id, dataset_id, label_str, {zz} from z0_),
so_ as (select *, {y} as y from z1_),
th_ as (select dataset_id, quantile_disc(y, 0.5) as threshold from so_ group by dataset_id)"""


Z_SQL = f"{OF_SQL},\n{_zscores_sql()}"


def score_sql(name) -> str:
    """SQL of the target score; `name(f)` gives the column expression of a feature."""
    return "(" + " + ".join(f"{w}::double*coalesce({name(f)},0.0::double)" for f, w in WEIGHTS.items()) + ")"


def pairs_sql(strategy: str, p: float = 0.5, magnitude: float = 2.0, k: float = 1.0, step: float = 0.1, cell: str = "", tag: str = "") -> str:
    """CTEs ending in p<tag>_ : the pair table, spelled out for DuckDB."""
    seed = str(SEED)
    tail = [cell] if cell else []

    def key(f: str, purpose: str) -> list[str]:
        return [seed, *tail, "row_id", s(f), s(purpose)]

    stats = ", ".join(f"greatest(stddev_samp({f}), 0.000001::double) as sd_{f}, min({f}) as lo_{f}, max({f}) as hi_{f}" for f in FEATURES)
    ok = {f: f"({f} is not null)" for f in FEATURES}
    n_known = " + ".join(f"({f} is not null)::int" for f in FEATURES)
    m0 = ", ".join(f"({ok[f]} and {U(*key(f, 'mask'))} < {p}::double) as m0_{f}" for f in FEATURES)
    none = " and ".join(f"not m0_{f}" for f in FEATURES)
    marks = []
    for j, f in enumerate(FEATURES):
        before = " + ".join(f"({g} is not null)::int" for g in FEATURES[:j]) or "0"
        marks.append(f"(m0_{f} or ({none} and {f} is not null and ({before}) = pick_)) as m_{f}")
    raw = {}
    for f in FEATURES:
        if strategy == "additive_noise":
            raw[f] = f"{normal_sql(*key(f, 'noise'))}*sd_{f}*{magnitude}::double"
        elif strategy == "marginal_replacement":
            raw[f] = f"donor_{f}"
        elif strategy == "fixed_magnitude":
            raw[f] = f"{k}::double*sd_{f}*{sign_sql(*key(f, 'sign'))}"
        elif strategy == "uniform_random":
            raw[f] = f"(lo_{f} + {U(*key(f, 'value'))}*(hi_{f}-lo_{f}))"
        else:
            up = score_sql(lambda g, f=f: f"({g}+0.001::double)" if g == f else g)
            slope = f"({up} - {score_sql(lambda g: g)})"
            way = f"(case when {slope} > 0 then 1.0::double when {slope} < 0 then -1.0::double else {sign_sql(*key(f, 'flat'))} end)"
            raw[f] = f"{way}*{sign_sql(*key(f, 'coin'))}*{step}::double*sd_{f}*{magnitude}::double"
    if strategy in ("marginal_replacement", "uniform_random"):  # the new value itself; the delta follows from it
        delta = ", ".join(f"case when m_{f} then coalesce({raw[f]}, {f}) else {f} end as cf_{f}" for f in FEATURES)
        cf = ", ".join(f"coalesce(cf_{f}-{f}, 0.0::double) as d_{f}" for f in FEATURES)
    else:
        delta = ", ".join(f"case when m_{f} then coalesce({raw[f]}, 0.0::double) else 0.0::double end as d_{f}" for f in FEATURES)
        cf = ", ".join(f"{f}+d_{f} as cf_{f}" for f in FEATURES)
    t = tag
    if strategy == "marginal_replacement":
        donors = ", ".join(f"b.{f} as donor_{f}" for f in FEATURES)
        src = f"""dn{t}_ as (select *, row_number() over (partition by dataset_id order by row_id)-1 as pos_, count(*) over (partition by dataset_id) as n_ from so_),
sr{t}_ as (select a.*, {donors} from (select *, floor({U(*key('', 'donor'))}*n_)::bigint as donor_ from dn{t}_) a join dn{t}_ b on a.dataset_id=b.dataset_id and a.donor_=b.pos_)"""
    else:
        src = f"sr{t}_ as (select * from so_)"
    return f"""ps{t}_ as (select dataset_id, {stats} from so_ group by dataset_id),
{src},
pm{t}_ as (select sr{t}_.*, ps{t}_.* exclude (dataset_id), {m0}, floor({U(*key('', 'one'))}*({n_known}))::int as pick_ from sr{t}_ join ps{t}_ on sr{t}_.dataset_id = ps{t}_.dataset_id),
pn{t}_ as (select *, {', '.join(marks)} from pm{t}_),
pd{t}_ as (select *, {delta} from pn{t}_),
pc{t}_ as (select *, {cf} from pd{t}_),
py{t}_ as (select pc{t}_.*, threshold, {score_sql(lambda f: f)} as y_f, {score_sql(lambda f: f'cf_{f}')} as y_cf from pc{t}_ join th_ on pc{t}_.dataset_id = th_.dataset_id),
p{t}_ as (select *, (y_f > threshold)::int as y_f_class, (y_cf > threshold)::int as y_cf_class, (y_f > threshold) <> (y_cf > threshold) as label_flipped from py{t}_)"""


def pred_sql(tag: str = "") -> str:
    """CTE q_: the pair table with predicted deltas and mask logits."""
    p = ", ".join(f"d_{f}*0.9::double + ({U('42', 'row_id', s(f), s('pred'))}-0.5::double)*0.4::double as p_{f}" for f in FEATURES)
    g = ", ".join(f"({U('42', 'row_id', s(f), s('logit'))}-0.5::double)*4.0::double + (case when m_{f} then 1.0::double else -1.0::double end) as g_{f}" for f in FEATURES)
    return f"q_ as (select *, {p}, {g} from p{tag}_)"


def _predictions_sql() -> str:
    grid = ", ".join(f"('{m}', {sp}, {a}::double, {n}::double)" for m, (a, n) in METHODS.items() for sp in range(1, 6))
    draw = U("(row_id*64 + substr(method,2,1)::int*8 + split)")
    return f"""pg_ as (select * from (values {grid}) t(method, split, strength, noise)),
pr0_ as (select o_orderkey as row_id, c_mktsegment as dataset_id, (o_orderstatus='F')::int as y from orders join customer on o_custkey=c_custkey),
pr1_ as (select method, split, dataset_id, row_id, y,
 greatest(0.001::double, least(0.999::double, round(0.5::double + (y-0.5::double)*strength*0.5::double + ({draw}-0.5::double)*noise, 4))) as score,
 (10.0*(1+substr(method,2,1)::int)+split)::double as time_s from pr0_ cross join pg_),
pred_ as (select method, 60 as max_time, split, dataset_id, 1000 as eval_pos, row_id, y, 1.0::double-score as p0, score as p1, time_s from pr1_)"""


PRED_SQL = _predictions_sql()

CLASS_SQL = f"""cp0_ as (select m.method, 'embeddings' as dataset_id, vec_id as row_id, label as y, k.k,
 round({UT('m.method', 'vec_id', 'k.k')} + case when k.k = label then case when m.method='m1' then 0.6::double else 0.2::double end else 0.0::double end, 3) as raw
 from embeddings cross join (values ('m0'),('m1')) m(method) cross join (select unnest(range(10)) as k) k),
cp1_ as (select *, raw / sum(raw) over (partition by method, row_id order by k rows between unbounded preceding and unbounded following) as p from cp0_)"""
