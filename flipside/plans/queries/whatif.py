"""Keyed draws, perturbation strategies, interventions and layouts (G, H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flipside.functions import keyed as K
from flipside.operators import causal, layout, perturb
from flipside.operators.pair_metrics import pair_distances, proximity, validity
from flipside.operators.transforms import fit_pair_stats, normalize_with_stats
from flipside.plans.inputs import (
    BY,
    FEATURES,
    SCORE,
    SEED,
    U,
    Z_SQL,
    fitted_pairs,
    order_features,
    pairs,
    pairs_sql,
    pred_sql,
    normal_sql,
    s,
    score_sql,
    scored_orders,
    sign_sql,
    table,
    with_predictions,
)
from flipside.plans.registry import R, query, r6, rounded
from flipside.schema import to_pair_table

# --- distances in SQL --------------------------------------------------------

_D = {f: f"coalesce(cf_{f}-{f}, 0.0::double)" for f in FEATURES}
_NA = "sqrt(" + " + ".join(f"coalesce({f},0.0::double)*coalesce({f},0.0::double)" for f in FEATURES) + ")"
_NB = "sqrt(" + " + ".join(f"coalesce(cf_{f},0.0::double)*coalesce(cf_{f},0.0::double)" for f in FEATURES) + ")"
DIST_SQL = {
    "l1": " + ".join(f"abs({d})" for d in _D.values()),
    "l2": "sqrt(" + " + ".join(f"{d}*{d}" for d in _D.values()) + ")",
    "linf": "greatest(" + ", ".join(f"abs({d})" for d in _D.values()) + ")",
    "cosine": "(" + " + ".join(f"coalesce({f},0.0::double)*coalesce(cf_{f},0.0::double)" for f in FEATURES) + f")/(greatest({_NA},1e-8::double)*greatest({_NB},1e-8::double))",
    "changed_share": "(" + " + ".join(f"(abs({d})>1e-8::double)::int" for d in _D.values()) + ")/5.0::double",
}


def dist_cte(tag: str = "") -> str:
    return f"d{tag}_ as (select *, " + ", ".join(f"{e} as {n}" for n, e in DIST_SQL.items()) + f" from p{tag}_)"


PROX_SQL = ", ".join(
    f"{R(f'avg({c})', c + '_mean')}, {R(f'coalesce(stddev_samp({c}),0)', c + '_std')}, {R(f'quantile_disc({c},0.5)', c + '_median')}"
    for c in DIST_SQL
)


@query(
    "flagship_flip_report",
    f"""with {Z_SQL}, {pairs_sql('fixed_magnitude')}, {dist_cte()}
select dataset_id, {R('avg(label_flipped::int)', 'validity')}, sum(label_flipped::int)::bigint as n_valid,
 sum((not label_flipped)::int)::bigint as n_invalid, count(*) as n_total, count(*) as num_pairs, {PROX_SQL}
from d_ group by dataset_id""",
)
def flagship(spark, sf):
    measured = pair_distances(pairs(spark, sf, "fixed_magnitude"), FEATURES)
    measured = measured.select("dataset_id", "label_flipped", *DIST_SQL)
    return rounded(proximity(measured, BY, more=validity()))


# --- G: keyed draws ----------------------------------------------------------


def _draws(spark, sf, *cols):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), *cols)


_OK = ["42", "o_orderkey"]


@query("g1_rand_uniform", f"select o_orderkey as row_id, {R('-1.0::double + 3.0::double*' + U(*_OK, s('g1')), 'u')} from orders")
def g1(spark, sf):
    return _draws(spark, sf, r6(K.rand_uniform(-1.0, 2.0, SEED, F.col("o_orderkey"), "g1"), "u"))


@query("g2_rand_normal", f"select o_orderkey as row_id, {R('0.5::double + 2.0::double*' + normal_sql(*_OK, s('g2')), 'z')} from orders")
def g2(spark, sf):
    return _draws(spark, sf, r6(K.rand_normal(0.5, 2.0, SEED, F.col("o_orderkey"), "g2"), "z"))


@query("g3_rand_sign", f"select o_orderkey as row_id, {sign_sql(*_OK, s('g3'))} as s from orders")
def g3(spark, sf):
    return _draws(spark, sf, K.rand_sign(SEED, F.col("o_orderkey"), "g3").alias("s"))


@query(
    "g4_rand_int",
    f"""select o_orderkey as row_id, (3 + floor({U(*_OK, s('g4'))}*7.0::double))::int as i,
 floor(2.0::double + 8.0::double*{U(*_OK, s('g4r'))} + 0.5::double)::int as i_rounded from orders""",
)
def g4(spark, sf):
    k = F.col("o_orderkey")
    return _draws(
        spark, sf, K.rand_int(3, 10, SEED, k, "g4").alias("i"), K.rand_int_rounded(2, 10, SEED, k, "g4r").alias("i_rounded")
    )


def _choice_sql(weights, u):
    edges = K.cumulative(weights)[:-1]
    return "case " + " ".join(f"when {u} < {e!r}::double then {i}" for i, e in enumerate(edges)) + f" else {len(weights) - 1} end"


@query("g5_rand_choice", f"select o_orderkey as row_id, {_choice_sql([0.5, 0.2, 0.2, 0.1], U(*_OK, s('g5')))} as c from orders")
def g5(spark, sf):
    return _draws(spark, sf, K.rand_choice([0.5, 0.2, 0.2, 0.1], SEED, F.col("o_orderkey"), "g5").alias("c"))


@query("g6_rand_zipf", f"select o_orderkey as row_id, 1 + {_choice_sql(K.zipf_weights(0.8, 1, 10), U(*_OK, s('g6')))} as k from orders")
def g6(spark, sf):
    return _draws(spark, sf, K.rand_zipf(0.8, 1, 10, SEED, F.col("o_orderkey"), "g6").alias("k"))


# --- H1-H7: masks and strategies ---------------------------------------------


@query(
    "h1_select_targets",
    f"with {Z_SQL}, {pairs_sql('fixed_magnitude', p=0.3)} select row_id, {', '.join('m_' + f for f in FEATURES)} from p_",
)
def h1(spark, sf):
    cfg = perturb.PerturbConfig(p=0.3, seed=SEED)
    return perturb.select_targets(scored_orders(spark, sf), FEATURES, cfg).select("row_id", *[f"m_{f}" for f in FEATURES])


_PAIR_COLS = ", ".join(
    ["row_id", "dataset_id", R("y_f", "y_f"), R("y_cf", "y_cf"), "y_f_class", "y_cf_class", "label_flipped"]
    + [R(f"d_{f}", f"d_{f}") for f in FEATURES]
    + [R(f"cf_{f}", f"cf_{f}") for f in FEATURES]
)


def _pair_query(name, strategy):
    @query(name, f"with {Z_SQL}, {pairs_sql(strategy)} select {_PAIR_COLS} from p_")
    def run(spark, sf, strategy=strategy):
        made = pairs(spark, sf, strategy)
        cols = ["y_f", "y_cf", "y_f_class", "y_cf_class", "label_flipped", *[f"d_{f}" for f in FEATURES], *[f"cf_{f}" for f in FEATURES]]
        return rounded(made.select("row_id", "dataset_id", *cols))

    return run


for _n, _s in (
    ("h2_perturb_additive_noise", "additive_noise"),
    ("h3_perturb_marginal_replacement", "marginal_replacement"),
    ("h4_perturb_gradient_guided", "gradient_guided"),
    ("h5_perturb_fixed_magnitude", "fixed_magnitude"),
    ("h6_perturb_uniform_random", "uniform_random"),
):
    _pair_query(_n, _s)


@query(
    "h7_apply_perturbation",
    "with " + Z_SQL + ", "
    + ", ".join(pairs_sql(st, tag=str(i)) for i, st in enumerate(perturb.STRATEGIES))
    + " " + " union all ".join(
        f"select '{st}' as strategy, dataset_id, count(*) as n, sum(label_flipped::int)::bigint as flips, "
        + ", ".join(R(f"avg(d_{f})", f"d_{f}") for f in FEATURES)
        + f" from p{i}_ group by dataset_id"
        for i, st in enumerate(perturb.STRATEGIES)
    ),
)
def h7(spark, sf):
    rows = scored_orders(spark, sf)
    spread, threshold = perturb.fit_pairs(rows, FEATURES, "y", BY)
    cfg = perturb.PerturbConfig(seed=SEED, score=SCORE)
    out = None
    for st in list(perturb.STRATEGIES)[:5]:
        made = perturb.perturb(rows.drop("y"), FEATURES, st, BY, cfg, spread)
        one = perturb.label_pairs(made, FEATURES, SCORE, BY, threshold).groupBy("dataset_id").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col("label_flipped").cast("long")).alias("flips"),
            *[F.avg(f"d_{f}").alias(f"d_{f}") for f in FEATURES]
        ).withColumn("strategy", F.lit(st))
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query(
    "pair_table",
    f"""with {Z_SQL}, {pairs_sql('uniform_random')}
select dataset_id, row_id, y_f_class, y_cf_class, label_flipped, [{', '.join('m_' + f for f in FEATURES)}] as mask,
 [{', '.join(f'round(d_{f},6)+0.0::double' for f in FEATURES)}] as delta from p_""",
)
def pair_table(spark, sf):
    packed = to_pair_table(pairs(spark, sf, "uniform_random"), FEATURES)
    return packed.select(
        "dataset_id", "row_id", "y_f_class", "y_cf_class", "label_flipped", "mask",
        F.transform("delta", lambda v: F.round(v, 6) + 0.0).alias("delta"),
    )


# --- H8-H12: equations, interventions, rescoring -----------------------------

NODES = FEATURES
EQUATIONS = {
    "f_1": lambda at: F.lit(0.4) * at["f_0"],
    "f_2": lambda at: F.lit(0.8) * at["f_1"] + F.lit(0.1) * at["f_0"],
    "f_3": lambda at: F.lit(-0.2) * at["f_2"],
}
_EQ = {"f_1": "0.4::double*{0}f_0", "f_2": "0.8::double*{0}f_1 + 0.1::double*{0}f_0", "f_3": "-0.2::double*{0}f_2"}


@query(
    "h8_abduct",
    f"with {Z_SQL} select row_id, " + ", ".join(R(f"{n} - ({e.format('')})", f"u_{n}") for n, e in _EQ.items()) + " from so_",
)
def h8(spark, sf):
    out = causal.abduct(scored_orders(spark, sf), NODES, EQUATIONS)
    return rounded(out.select("row_id", *[f"u_{n}" for n in EQUATIONS]))


def _do_sql(scope: str) -> str:
    steps = [f"e0_ as (select p_.*, " + ", ".join(f"{n} - ({e.format('')}) as u_{n}" for n, e in _EQ.items()) + ", " + ", ".join(f"case when m_{f} then cf_{f} end as set_{f}" for f in FEATURES) + " from p_)"]
    prev = "e0_"
    for i, n in enumerate(NODES, 1):
        natural = f"({_EQ[n].format('do_')} + u_{n})" if n in _EQ else n
        value = f"coalesce(set_{n}, {n if scope == 'column' else natural})"
        steps.append(f"e{i}_ as (select *, {value} as do_{n} from {prev})")
        prev = f"e{i}_"
    y = score_sql(lambda f: f"do_{f}")
    return f"with {Z_SQL}, {pairs_sql('fixed_magnitude', p=0.3)}, {', '.join(steps)} select row_id, {', '.join(R(f'do_{f}', f'do_{f}') for f in FEATURES)}, {R(y, 'y_do')} from {prev}"


def _do_query(name, scope):
    @query(name, _do_sql(scope))
    def run(spark, sf, scope=scope):
        made = causal.abduct(pairs(spark, sf, "fixed_magnitude", p=0.3), NODES, EQUATIONS)
        values = {f: F.when(F.col(f"m_{f}"), F.col(f"cf_{f}")) for f in FEATURES}
        out = causal.do_intervene(made, NODES, EQUATIONS, values, scope, prefix="do_")
        out = out.withColumn("y_do", SCORE({f: F.col(f"do_{f}") for f in FEATURES}))
        return rounded(out.select("row_id", *[f"do_{f}" for f in FEATURES], "y_do"))


_do_query("h9_do_intervene", "row")
_do_query("h9_do_intervene_column", "column")


@query("h10_score_linear", f"with {Z_SQL} select row_id, {R('y', 'y')} from so_")
def h10(spark, sf):
    return rounded(scored_orders(spark, sf).select("row_id", "y"))


@query(
    "h11_label_flip",
    f"with {Z_SQL}, {pairs_sql('additive_noise')} select row_id, y_f_class, y_cf_class, label_flipped from p_",
)
def h11(spark, sf):
    return pairs(spark, sf, "additive_noise").select("row_id", "y_f_class", "y_cf_class", "label_flipped")


@query(
    "h12_validity_by_rescore",
    f"""with {Z_SQL}, {pairs_sql('uniform_random')}, {pred_sql()},
y_ as (select dataset_id, y_cf_class as t, ({score_sql(lambda f: f'({f}+p_{f})')} > threshold)::int as c from q_)
select dataset_id, {R('avg((c=t)::int)', 'validity')}, sum((c=t)::int)::bigint as n_valid, count(*) as n_points from y_ group by dataset_id""",
)
def h12(spark, sf):
    made, rows, threshold = fitted_pairs(spark, sf, "uniform_random")
    made = with_predictions(made).withColumn("target_label", F.col("y_cf_class"))
    stats = fit_pair_stats(rows, FEATURES, BY)
    # Predictions live in standardised units; rescoring brings them back with the same stats.
    scaled = normalize_with_stats(made, FEATURES, stats, BY, delta="p_")
    return rounded(causal.rescore_validity(scaled, FEATURES, SCORE, threshold, BY, stats))


# --- H13-H20 -----------------------------------------------------------------


def _tries_sql() -> str:
    """Two tries spelled out: the second one runs when the first flips less than a fifth of the rows."""
    def facts(t: int, strategy: str) -> str:
        return f"select dataset_id, {t + 1} as tries, '{strategy}' as strategy, avg(label_flipped::int) as validity, sum(label_flipped::int)::bigint as n_valid, sum((not label_flipped)::int)::bigint as n_invalid, count(*) as n_total from pt{t}_ group by dataset_id"

    first = pairs_sql("gradient_guided", magnitude=2.0, cell=s("try0"), tag="t0")
    second = pairs_sql("uniform_random", magnitude=3.0, cell=s("try1"), tag="t1")
    return f"""with {Z_SQL}, {first}, {second}, rate_ as (select avg(label_flipped::int) as rate from pt0_)
select a.* from ({facts(0, 'gradient_guided')}) a cross join rate_ where rate >= 0.2 union all select b.* from ({facts(1, 'uniform_random')}) b cross join rate_ where rate < 0.2"""


@query("h13_retry_until_flip_rate", _tries_sql())
def h13(spark, sf):
    rows = scored_orders(spark, sf)
    spread, threshold = perturb.fit_pairs(rows, FEATURES, "y", BY)

    def make(strategy, magnitude, attempt):
        cfg = perturb.PerturbConfig(seed=SEED, score=SCORE, magnitude=magnitude, salt=f"try{attempt}")
        return perturb.label_pairs(perturb.perturb(rows.drop("y"), FEATURES, strategy, BY, cfg, spread), FEATURES, SCORE, BY, threshold)

    made, log = perturb.retry_until_flip_rate(make, "gradient_guided", 2.0)
    return made.groupBy("dataset_id").agg(
        F.lit(len(log)).alias("tries"), F.lit(log[-1]["strategy"]).alias("strategy"), *validity()
    )


# Places per dataset from its counts of flipped (nf) and other rows (nk), so that every row has one: half of the
# flipped rows as queries; all of them, repeated in turn; or half of all rows as queries, filled up by others.
_HALF = "(nf//2)::bigint as q, (nk+nf-nf//2)::bigint as c"
_CYCLE = "(2*nf+1)::bigint as q, nk::bigint as c"
_FILL = "((nf+nk+1)//2)::bigint as q, ((nf+nk)//2)::bigint as c"
_PLACES = {
    _HALF: (lambda nf, nk: nk + nf - F.floor(nf / 2), lambda nf, nk: F.floor(nf / 2)),
    _CYCLE: (lambda nf, nk: nk, lambda nf, nk: 2 * nf + 1),
    _FILL: (lambda nf, nk: F.floor((nf + nk) / 2), lambda nf, nk: F.floor((nf + nk + 1) / 2)),
}


def _layout_sql(flip_only: bool, strategy: str, share: str, extra: str) -> str:
    """Layout where every dataset's rows are split: half context, half query."""
    jit = ", ".join(
        f"case when cyc then {f} + 0.01::double*{normal_sql('42', 'row_id', s(f), 'slot', s('jitter'))} else {f} end as {f}" for f in FEATURES
    )
    fo = "true" if flip_only else "false"
    return f"""with {Z_SQL}, {pairs_sql(strategy)},
a_ as (select *, row_number() over (partition by dataset_id, label_flipped order by row_id)-1 as i,
 sum(label_flipped::int) over (partition by dataset_id) as nf, sum((not label_flipped)::int) over (partition by dataset_id) as nk from p_),
b_ as (select *, {share} from a_),
ctx_ as (select *, case when nf >= q then case when not label_flipped then i when i >= q then nk+i-q end
  when {fo} and nf > 0 then case when not label_flipped then i end
  else case when not label_flipped and i >= q-nf then i-(q-nf) end end as slot from b_),
qry_ as (select *, case when nf >= q then case when label_flipped then i end
  when {fo} and nf > 0 then null
  else case when label_flipped then i when i < q-nf then nf+i end end as slot from b_),
cyc_ as (select b_.*, t.j as slot from b_ join (select unnest(range(2500)) as j) t on label_flipped and nf < q and nf > 0 and {fo} and t.j < q and t.j % nf = i),
all_ as (
 select row_id, dataset_id, slot as pos, 'context' as role, y_f_class as y, false as cyc, slot, {', '.join(FEATURES)}, {extra} from ctx_ where slot is not null and slot < c
 union all select row_id, dataset_id, slot + c, 'query', y_cf_class, false, slot, {', '.join(FEATURES)}, {extra} from qry_ where slot is not null and slot < q
 union all select row_id, dataset_id, slot + c, 'query', y_cf_class, slot >= nf, slot, {', '.join(FEATURES)}, {extra} from cyc_),
lay_ as (select row_id, dataset_id, pos::int as pos, role, y, {jit}, {extra} from all_)"""


_DM = ", ".join([f"d_{f}" for f in FEATURES] + [f"m_{f}" for f in FEATURES])
_LAY_OUT = "dataset_id, pos, role, row_id, y, " + ", ".join(R(f, f) for f in FEATURES)


def _layout(spark, sf, strategy, places, flip_only=True):
    made = pairs(spark, sf, strategy)
    eval_pos, n_query = _PLACES[places]
    return layout.context_query_layout(made, FEATURES, eval_pos, n_query, BY, flip_only=flip_only, seed=SEED)


@query(
    "h14_context_query_layout",
    _layout_sql(True, "uniform_random", _HALF, _DM) + f" select {_LAY_OUT} from lay_",
)
def h14(spark, sf):
    return rounded(_layout(spark, sf, "uniform_random", _HALF).select("dataset_id", "pos", "role", "row_id", "y", *FEATURES))


@query(
    "h14_context_query_layout_mixed",
    _layout_sql(False, "gradient_guided", _FILL, _DM) + f" select {_LAY_OUT} from lay_",
)
def h14_mixed(spark, sf):
    return rounded(
        _layout(spark, sf, "gradient_guided", _FILL, False).select("dataset_id", "pos", "role", "row_id", "y", *FEATURES)
    )


@query(
    "h15_fill_queries_by_cycling",
    _layout_sql(True, "gradient_guided", _CYCLE, _DM) + f" select {_LAY_OUT} from lay_ where role='query'",
)
def h15(spark, sf):
    lay = _layout(spark, sf, "gradient_guided", _CYCLE).filter("role = 'query'")
    return rounded(lay.select("dataset_id", "pos", "role", "row_id", "y", *FEATURES))


_TARGET_SQL = ", ".join([f"round(d_{f},6)+0.0::double" for f in FEATURES] + [f"m_{f}::int::double" for f in FEATURES])


@query(
    "h16_encode_targets",
    _layout_sql(True, "uniform_random", _HALF, _DM) + f" select dataset_id, pos, [{_TARGET_SQL}] as target from lay_",
)
def h16(spark, sf):
    lay = _layout(spark, sf, "uniform_random", _HALF).withColumn("target", layout.encode_targets(FEATURES))
    return lay.select("dataset_id", "pos", F.transform("target", lambda v: F.round(v, 6) + 0.0).alias("target"))


@query(
    "h17_source_row_map",
    _layout_sql(True, "uniform_random", _HALF, _DM)
    + " select dataset_id, pos, row_id as source_row from lay_ where role='query'",
)
def h17(spark, sf):
    return layout.source_row_map(_layout(spark, sf, "uniform_random", _HALF))


@query(
    "h18_context_ablation",
    _layout_sql(True, "uniform_random", _HALF, _DM)
    + """, id_ as (select dataset_id, row_number() over (order by dataset_id)-1 as q, count(*) over () as n from (select distinct dataset_id from lay_)),
mp_ as (select a.dataset_id as tgt, b.dataset_id as src from id_ a join id_ b on b.q = (a.q+1) % a.n),
v_ as (select 'correct' as variant, dataset_id, pos, role, y, f_0 from lay_
 union all select 'wrong', tgt, pos, role, y, f_0 from lay_ join mp_ on src = dataset_id where role='context'
 union all select 'wrong', dataset_id, pos, role, y, f_0 from lay_ where role='query'
 union all select 'none', dataset_id, pos, role, case when role='context' then 0 else y end, f_0 from lay_)"""
    + f" select variant, dataset_id, pos, role, y, {R('f_0', 'f_0')} from v_",
)
def h18(spark, sf):
    lay = _layout(spark, sf, "uniform_random", _HALF)
    return rounded(layout.context_ablation(lay, ["f_0"]))


_VARIANTS = {"default": (2.0, 1.0, 0.5), "high": (4.0, 2.0, 0.5), "low": (0.5, 0.3, 0.3)}


def _sweep_sql():
    ctes, selects, i = [], [], 0
    for st in perturb.STRATEGIES:
        for c, (v, (mag, k, p)) in enumerate(_VARIANTS.items()):
            for rep in range(2):
                ctes.append(pairs_sql(st, p=p, magnitude=mag, k=k, cell=f"{c * 2 + rep}::bigint", tag=f"s{i}"))
                ctes.append(dist_cte(f"s{i}"))
                selects.append(
                    f"select '{st}' as strategy, '{v}' as variant, {rep} as repeat, {R('avg(label_flipped::int)', 'validity')}, count(*) as n, {R('avg(l1)', 'l1')}, {R('avg(l2)', 'l2')}, {R('avg(changed_share)', 'changed')} from ds{i}_"
                )
                i += 1
    return f"with {Z_SQL}, {', '.join(ctes)} " + " union all ".join(selects)


@query("h19_sweep", _sweep_sql())
def h19(spark, sf):
    from flipside.plans.reports import sweep

    scored = scored_orders(spark, sf)
    rows = scored.drop("y")
    spread, threshold = perturb.fit_pairs(scored, FEATURES, "y", BY)
    configs = {
        v: perturb.PerturbConfig(p=p, magnitude=mag, k=k, seed=SEED, score=SCORE) for v, (mag, k, p) in _VARIANTS.items()
    }
    return rounded(sweep(rows, FEATURES, BY, list(perturb.STRATEGIES)[:5], configs, 2, SCORE, threshold, spread))


@query(
    "h20_multiple_cf",
    f"""with {Z_SQL}, st_ as (select dataset_id, greatest(stddev_samp(f_0),0.000001::double) as sd_f_0 from so_ group by dataset_id),
k_ as (select unnest(range(1,4))::int as cf_index)
select row_id, cf_index, {R("f_0 + sd_f_0*" + sign_sql('42', 'row_id', 'cf_index', s('f_0'), s('sign')), 'cf_f_0')}
from so_ join st_ on so_.dataset_id = st_.dataset_id cross join k_""",
)
def h20(spark, sf):
    base = scored_orders(spark, sf).select("row_id", "dataset_id", "f_0")
    cfg = perturb.PerturbConfig(p=1.0, seed=SEED, key=["row_id", "cf_index"])
    spread = perturb.fit_spread(base, ["f_0"], BY)
    made = perturb.perturb(perturb.multiple_counterfactuals(base, 3), ["f_0"], "fixed_magnitude", BY, cfg, spread)
    return rounded(made.select("row_id", "cf_index", "cf_f_0"))
