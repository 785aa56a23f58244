"""Pair metrics and scores of predicted deltas (I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flipside.operators import pair_metrics as P
from flipside.functions.fitted import attach
from flipside.plans.inputs import BY, FEATURES, SCORE, Z_SQL, fitted_pairs, pairs, pairs_sql, pred_sql, score_sql, with_predictions
from flipside.plans.queries.whatif import DIST_SQL, PROX_SQL, dist_cte
from flipside.plans.registry import R, query, rounded

_UR = f"with {Z_SQL}, {pairs_sql('uniform_random')}"
_AN = f"with {Z_SQL}, {pairs_sql('additive_noise')}"
_N = len(FEATURES)


def _ur(spark, sf):
    return pairs(spark, sf, "uniform_random")


def _pred(spark, sf):
    return with_predictions(pairs(spark, sf, "additive_noise"))


@query(
    "i1_validity",
    f"{_UR} select dataset_id, {R('avg(label_flipped::int)', 'validity')}, sum(label_flipped::int)::bigint as n_valid, sum((not label_flipped)::int)::bigint as n_invalid, count(*) as n_total from p_ group by dataset_id",
)
def i1(spark, sf):
    return rounded(_ur(spark, sf).groupBy("dataset_id").agg(*P.validity()))


@query("i2_pair_distances", f"{_UR}, {dist_cte()} select row_id, " + ", ".join(R(c, c) for c in DIST_SQL) + " from d_")
def i2(spark, sf):
    return rounded(P.pair_distances(_ur(spark, sf), FEATURES).select("row_id", *P.DISTANCES))


@query("i3_proximity", f"{_UR}, {dist_cte()} select dataset_id, count(*) as num_pairs, {PROX_SQL} from d_ group by dataset_id")
def i3(spark, sf):
    return rounded(P.proximity(P.pair_distances(_ur(spark, sf), FEATURES), BY))


@query(
    "i3_proximity_valid",
    f"{_UR}, {dist_cte()} select dataset_id, count(*) as num_pairs, {PROX_SQL} from d_ where label_flipped group by dataset_id",
)
def i3v(spark, sf):
    return rounded(P.proximity(P.pair_distances(_ur(spark, sf), FEATURES), BY, valid_only=True))


_MAD = "m_ as (" + " union all ".join(
    f"select dataset_id, {i} as feat, avg(abs(coalesce(cf_{f}-{f},0.0::double))) as mad from p_ group by dataset_id" for i, f in enumerate(FEATURES)
) + ")"


@query("i4_per_feature_mad", f"{_UR}, {_MAD} select dataset_id, feat, {R('mad', 'mad')} from m_")
def i4(spark, sf):
    return rounded(P.per_feature_mad(_ur(spark, sf), FEATURES, BY))


@query("i4_mad_summary", f"{_UR}, {_MAD} select dataset_id, {R('avg(mad)', 'mad_mean')}, {R('stddev_samp(mad)', 'mad_std')} from m_ group by dataset_id")
def i4s(spark, sf):
    return rounded(P.mad_summary(P.per_feature_mad(_ur(spark, sf), FEATURES, BY), BY))


@query(
    "i5_proximity_ratio",
    f"{_UR}, {dist_cte()} select dataset_id, {R('avg(l2)', 'l2_all')}, {R('avg(case when label_flipped then l2 end)', 'l2_valid')}, {R('avg(case when label_flipped then l2 end)/avg(l2)', 'l2_ratio')} from d_ group by dataset_id",
)
def i5(spark, sf):
    return rounded(P.proximity_ratio(P.pair_distances(_ur(spark, sf), FEATURES), BY))


_NP = "(" + "+".join(f"m_{f}::int" for f in FEATURES) + ")"


@query(
    "i6_features_perturbed",
    f"{_UR} select dataset_id, {R(f'avg({_NP})', 'mean_all')}, {R(f'stddev_samp({_NP})', 'std_all')}, {R(f'avg(case when label_flipped then {_NP} end)', 'mean_valid')}, {R(f'stddev_samp(case when label_flipped then {_NP} end)', 'std_valid')} from p_ group by dataset_id",
)
def i6(spark, sf):
    return rounded(P.features_perturbed(_ur(spark, sf), FEATURES, BY))


_CELLS = "c_ as (" + " union all ".join(
    f"select dataset_id, row_id, {i} as feat, p_{f} as p, d_{f} as d, m_{f} as m, g_{f} as g from q_" for i, f in enumerate(FEATURES)
) + ")"
_PRED = f"{_AN}, {pred_sql()}, {_CELLS}"
_NORM = "n_ as (select dataset_id, row_id, sqrt(" + "+".join(f"p_{f}*p_{f}" for f in FEATURES) + ") as nrm from q_)"
_SIGN = "coalesce(sum(case when abs(d) > 1e-6::double then ((p>0)=(d>0))::int end)::double/nullif(sum((abs(d) > 1e-6::double)::int),0), -1.0::double)"
_ZERO = "coalesce(sum(case when abs(d) < 1e-6::double then (abs(p)<0.1::double)::int end)::double/nullif(sum((abs(d) < 1e-6::double)::int),0), -1.0::double)"
_CELL_AGG = f"{R('avg((p-d)*(p-d))', 'delta_mse')}, {R('avg((abs(p)<0.05::double)::int)', 'sparsity')}, {R(_SIGN, 'sign_accuracy')}, {R(_ZERO, 'zero_feature_accuracy')}"
_ROW_AGG = f"{R('avg((nrm>0.01::double)::int)', 'validity_rate')}, {R('avg(nrm)', 'proximity_mean')}, {R('stddev_samp(nrm)', 'proximity_std')}, count(*) as num_query_points"


def _cell(name, sql, build):
    @query(name, f"{_PRED} select dataset_id, {sql} from c_ group by dataset_id")
    def run(spark, sf):
        return rounded(_pred(spark, sf).groupBy("dataset_id").agg(build()))



_cell("i7_delta_mse", R("avg((p-d)*(p-d))", "delta_mse"), lambda: P.delta_mse(FEATURES).alias("delta_mse"))
_cell("i10_pred_sparsity", R("avg((abs(p)<0.05::double)::int)", "sparsity"), lambda: P.pred_sparsity(FEATURES).alias("sparsity"))
_cell("i11_sign_accuracy", R(_SIGN, "sign_accuracy"), lambda: P.sign_accuracy(FEATURES).alias("sign_accuracy"))
_cell("i12_zero_feature_accuracy", R(_ZERO, "zero_feature_accuracy"), lambda: P.zero_feature_accuracy(FEATURES).alias("zero_feature_accuracy"))


@query("i8_heuristic_validity", f"{_PRED}, {_NORM} select dataset_id, {R('avg((nrm>0.01::double)::int)', 'v')} from n_ group by dataset_id")
def i8(spark, sf):
    return rounded(_pred(spark, sf).groupBy("dataset_id").agg(P.heuristic_validity(FEATURES).alias("v")))


@query("i9_pred_proximity", f"{_PRED}, {_NORM} select dataset_id, {R('avg(nrm)', 'mean')}, {R('stddev_samp(nrm)', 'std')} from n_ group by dataset_id")
def i9(spark, sf):
    n = P.pred_norm(FEATURES)
    return rounded(_pred(spark, sf).groupBy("dataset_id").agg(F.avg(n).alias("mean"), F.stddev_samp(n).alias("std")))


@query(
    "i13_eval_metrics",
    f"""{_PRED}, {_NORM}, a_ as (select dataset_id, {_CELL_AGG} from c_ group by dataset_id), b_ as (select dataset_id, {_ROW_AGG} from n_ group by dataset_id),
v_ as (select dataset_id, {R(f"avg((({score_sql(lambda f: f'({f}+p_{f})')} > threshold)::int = y_cf_class)::int)", 'scm_validity')} from q_ group by dataset_id)
select * from a_ join b_ using (dataset_id) join v_ using (dataset_id)""",
)
def i13(spark, sf):
    made, _, threshold = fitted_pairs(spark, sf, "additive_noise")
    out = attach(with_predictions(made), threshold, BY)
    y = SCORE({f: F.col(f) + F.col(f"p_{f}") for f in FEATURES})
    hit = ((y > F.col("threshold")).cast("int") == F.col("y_cf_class")).cast("double")
    return rounded(out.groupBy("dataset_id").agg(*P.eval_metrics(FEATURES), F.avg(hit).alias("scm_validity")))


@query("i14_per_feature_mse", f"{_PRED} select dataset_id, feat, {R('avg((p-d)*(p-d))', 'mse')} from c_ group by dataset_id, feat")
def i14(spark, sf):
    return rounded(P.per_feature_mse(_pred(spark, sf), FEATURES, BY))


@query(
    "i15_masked_delta_loss",
    f"""{_PRED}, l_ as (select dataset_id, row_id, sum(case when m then (p-d)*(p-d) else 0.0::double end)/greatest(sum(m::int),1) as a,
 avg(greatest(g,0.0::double) - g*m::int + ln(1.0::double+exp(-abs(g)))) as b from c_ group by dataset_id, row_id)
select dataset_id, {R('avg(a+0.5::double*b)', 'loss')} from l_ group by dataset_id""",
)
def i15(spark, sf):
    return rounded(_pred(spark, sf).groupBy("dataset_id").agg(P.masked_delta_loss(FEATURES, 0.5).alias("loss")))


@query(
    "i16_gaussian_nll",
    f"""{_PRED} select dataset_id, {R('avg(0.5::double*(least(greatest(g*6.0::double,-10.0::double),10.0::double)+(d-p)*(d-p)/exp(least(greatest(g*6.0::double,-10.0::double),10.0::double))))', 'nll', 3)} from c_ group by dataset_id""",
)
def i16(spark, sf):
    cell = sum((P.gaussian_nll(F.col(f"p_{f}"), F.col(f"g_{f}") * 6.0, F.col(f"d_{f}")) for f in FEATURES), F.lit(0.0))
    return rounded(_pred(spark, sf).groupBy("dataset_id").agg(F.avg(cell / F.lit(float(_N))).alias("nll")), 3)


@query(
    "i17_validity_objective",
    f"""{_PRED}, v_ as (select dataset_id, {score_sql(lambda f: f'({f}+p_{f})')} - threshold as z, y_cf_class as t, sqrt({'+'.join(f'p_{f}*p_{f}' for f in FEATURES)}) as nrm, ({'+'.join(f'abs(p_{f})' for f in FEATURES)})/5.0::double as sz from q_),
w_ as (select dataset_id, avg(greatest(z,0.0::double)-z*t+ln(1.0::double+exp(-abs(z)))) as b from v_ group by dataset_id)
select {R('(select avg(b) from w_) + 0.1::double*avg(nrm) + 0.01::double*avg(sz)', 'objective')}, {R('(select avg(b) from w_)', 'validity_loss')}, {R('avg(nrm)', 'proximity_loss')}, {R('avg(sz)', 'sparsity_loss')} from v_""",
)
def i17(spark, sf):
    made, _, threshold = fitted_pairs(spark, sf, "additive_noise")
    out = attach(with_predictions(made), threshold, BY)
    margin = SCORE({f: F.col(f) + F.col(f"p_{f}") for f in FEATURES}) - F.col("threshold")
    return rounded(P.validity_objective(out, FEATURES, margin, F.col("y_cf_class"), BY))


@query(
    "i18_apply_predicted_mask",
    f"{_AN}, {pred_sql()} select row_id, " + ", ".join(R(f"case when 1.0::double/(1.0::double+exp(-g_{f})) > 0.5 then p_{f} else 0.0::double end", f"p_{f}") for f in FEATURES) + " from q_",
)
def i18(spark, sf):
    return rounded(P.apply_predicted_mask(_pred(spark, sf), FEATURES).select("row_id", *[f"p_{f}" for f in FEATURES]))
