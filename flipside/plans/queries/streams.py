"""Streaming operators (R), run to the end of the available input."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from flipside.operators.labels import calibrate_threshold
from flipside.operators.transforms import fit_pair_stats
from flipside.plans.inputs import table
from flipside.plans.registry import query, rounded
from flipside.session import checkpoint_dir
from flipside.streaming import online as S

BY = ["event_type"]


def _stream(spark, sf):
    return S.file_stream(spark, sf, "events.parquet", table(spark, sf, "events").schema)


def _paths(spark, name):
    base = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/state"


@query(
    "r1_stream_normalize",
    """with p as (select event_type, avg(value) as m, greatest(stddev_samp(value),0.000001::double) as s from events group by 1)
select event_id, event_type, round((value-m)/s,6)+0.0::double as value from events join p using (event_type)""",
)
def r1(spark, sf):
    params = fit_pair_stats(table(spark, sf, "events"), ["value"], BY)
    out = S.stream_normalize(_stream(spark, sf), ["value"], params, BY).select("event_id", "event_type", "value")
    return rounded(S.run_to_table(out, *_paths(spark, "normalize")))


@query(
    "r2_stream_label",
    """with p as (select event_type, quantile_disc(value,0.5) as t from events group by 1) select event_id, (value > t)::int as y_class from events join p using (event_type)""",
)
def r2(spark, sf):
    threshold = calibrate_threshold(table(spark, sf, "events"), "value", BY)
    out = S.stream_label(_stream(spark, sf), "value", threshold, BY).select("event_id", "y_class")
    return S.run_to_table(out, *_paths(spark, "label"))


_W = """w as (select time_bucket(interval 1 day, ts) as window_start, event_type, value from events), mx as (select max(ts) - interval 10 minutes as mark from events)"""


@query(
    "r3_stream_window_stats",
    f"""with {_W} select window_start, window_start + interval 1 day as window_end, event_type, count(*) as n, round(avg(value),6)+0.0::double as mean, round(stddev_samp(value),6)+0.0::double as std, min(value) as min, max(value) as max
from w cross join mx where window_start + interval 1 day <= mark group by window_start, event_type""",
)
def r3(spark, sf):
    out = S.stream_window_stats(_stream(spark, sf), "ts", "value", BY, "1 day", "10 minutes")
    got = S.run_to_table(out, *_paths(spark, "windows"))
    return rounded(got).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query(
    "r3_stream_sliding_stats",
    """with h as (select time_bucket(interval 12 hours, ts) as b, event_type, value from events), mx as (select max(ts) - interval 10 minutes as mark from events),
w as (select b - k * interval 12 hours as window_start, event_type, value from h cross join (values (0), (1)) t(k))
select window_start, window_start + interval 1 day as window_end, event_type, count(*) as n, round(avg(value),6)+0.0::double as mean, round(stddev_samp(value),6)+0.0::double as std, min(value) as min, max(value) as max
from w cross join mx where window_start + interval 1 day <= mark group by window_start, event_type""",
)
def r3_sliding(spark, sf):
    out = S.stream_window_stats(_stream(spark, sf), "ts", "value", BY, "1 day", "10 minutes", slide="12 hours")
    got = S.run_to_table(out, *_paths(spark, "sliding"))
    return rounded(got).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query(
    "r4_stream_drift",
    f"""with {_W}, b as (select event_type, min(value) as lo, max(value) as hi from events group by 1),
base as (select event_type, least(49, greatest(0, floor((value-lo)/((hi-lo)/50.0::double)+1e-9::double)))::int as bin, count(*)::double as f from events join b using (event_type) group by 1, 2),
win as (select window_start, event_type, least(49, greatest(0, floor((value-lo)/((hi-lo)/50.0::double)+1e-9::double)))::int as bin, count(*)::double as c from w join b using (event_type) cross join mx where window_start + interval 1 day <= mark group by 1, 2, 3),
ky as (select distinct window_start, event_type from win), gr as (select window_start, event_type, g.bin, (hi-lo)/50.0::double as wd from ky join b using (event_type) cross join (select unnest(range(50)) as bin) g),
j as (select gr.window_start, gr.event_type, gr.bin, wd, coalesce(f,0.0::double) as f, coalesce(c,0.0::double) as c from gr left join base on base.event_type=gr.event_type and base.bin=gr.bin left join win on win.window_start=gr.window_start and win.event_type=gr.event_type and win.bin=gr.bin),
d as (select window_start, event_type, f/(sum(f) over g*wd)+1e-10::double as p, c/(sum(c) over g*wd)+1e-10::double as q from j window g as (partition by window_start, event_type)),
e as (select window_start, event_type, p/sum(p) over g as p, q/sum(q) over g as q from d window g as (partition by window_start, event_type))
select window_start, event_type, round(sum(0.5::double*(p*ln(p/((p+q)/2))+q*ln(q/((p+q)/2)))),6)+0.0::double as js from e group by 1, 2""",
)
def r4(spark, sf):
    bounds, baseline = S.fit_histogram(table(spark, sf, "events"), "value", BY)
    out, state = _paths(spark, "drift")
    q = S.stream_drift(_stream(spark, sf), "ts", "value", bounds, baseline, BY, "1 day", "10 minutes", out, state)
    q.awaitTermination()
    got = spark.read.parquet(out).select("window_start", "event_type", "js")
    return rounded(got).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
