"""Frozen statistics on endless input: the stream side of fit/apply.

The parameter tables come from a batch fit and are joined as static tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flipside.functions.fitted import materialise
from flipside.operators.labels import binarize_threshold
from flipside.operators.plausibility import histogram_bin, js_from_counts


def file_stream(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> DataFrame:
    """Stream of the files in `folder` that match `name`."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def stream_normalize(stream: DataFrame, cols: Sequence[str], params: DataFrame, by: Sequence[str]) -> DataFrame:
    """(x-mean)/std with frozen statistics; stateless, append mode.

    Rows of groups that have no statistics stay, with unknown values.
    """
    out = stream.join(params, list(by), "left")
    out = out.withColumns({c: (F.col(c) - F.col(f"{c}_mu")) / F.col(f"{c}_sd") for c in cols})
    return out.drop(*[c for c in params.columns if c not in by])


def stream_label(stream: DataFrame, target: str, threshold: DataFrame, by: Sequence[str], name: str = "y_class") -> DataFrame:
    """Classes under frozen thresholds; a group without one has an unknown class."""
    return stream.join(threshold, list(by), "left").withColumn(name, binarize_threshold(target, "threshold")).drop("threshold")


def event_time(stream: DataFrame, ts: str) -> DataFrame:
    """Watermarks need a TIMESTAMP; files often carry one without a time zone."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def stream_window_stats(stream: DataFrame, ts: str, value: str, by: Sequence[str], window: str, watermark: str, slide: str | None = None) -> DataFrame:
    """Moments per event-time window and group; rows later than the watermark are dropped."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return (
        event_time(stream, ts).withWatermark(ts, watermark)
        .groupBy(w.alias("w"), *by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(value).alias("mean"),
            F.stddev_samp(value).alias("std"),
            F.min(value).alias("min"),
            F.max(value).alias("max"),
        )
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n", "mean", "std", "min", "max")
    )


def fit_histogram(df: DataFrame, value: str, by: Sequence[str], bins: int = 50) -> tuple[DataFrame, DataFrame]:
    """Baseline histogram: (bounds per group, counts per group and bin), both computed here and kept."""
    bounds = materialise(df.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi")))
    counts = materialise(
        df.join(bounds, list(by))
        .groupBy(*by, histogram_bin(F.col(value), F.col("lo"), F.col("hi"), bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("f"))
    )
    return bounds, counts


def stream_histogram(stream: DataFrame, ts: str, value: str, bounds: DataFrame, by: Sequence[str], window: str, watermark: str, bins: int = 50) -> DataFrame:
    """Bin counts per window; values beyond the baseline range go to the edge bins."""
    at = histogram_bin(F.col(value), F.col("lo"), F.col("hi"), bins)
    return (
        event_time(stream, ts).withWatermark(ts, watermark)
        .join(bounds, list(by), "left")
        .groupBy(F.window(ts, window).alias("w"), *by, at.alias("bin"))
        .agg(F.count(F.lit(1)).alias("cf"))
        .select(F.col("w.start").alias("window_start"), *by, "bin", "cf")
    )


def drift_of(window_counts: DataFrame, bounds: DataFrame, baseline: DataFrame, by: Sequence[str], bins: int = 50) -> DataFrame:
    """JS divergence between each finished window and the baseline; NULL for groups without one."""
    by = list(by)
    keys = ["window_start", *by]
    seen = window_counts.select(*keys).distinct()
    both = (
        seen.join(baseline, by)
        .select(*keys, "bin", "f", F.lit(0).cast("long").alias("cf"))
        .unionByName(window_counts.select(*keys, "bin", F.lit(0).cast("long").alias("f"), "cf"))
        .groupBy(*keys, "bin")
        .agg(F.sum("f").alias("f"), F.sum("cf").alias("cf"))
    )
    width = bounds.select(*by, ((F.col("hi") - F.col("lo")) / F.lit(float(bins))).alias("width"))
    measured = js_from_counts(both.join(width, by), keys, bins)
    return seen.join(measured, keys, "left")


def stream_drift(stream: DataFrame, ts: str, value: str, bounds: DataFrame, baseline: DataFrame, by: Sequence[str], window: str, watermark: str, out_path: str, checkpoint: str, bins: int = 50):
    """Start a query that writes one JS row per finished window and group.

    Append mode hands a window over once, with all of its bins, when the
    watermark passes its end.  The batch number is part of the folder, so a
    batch that is run again replaces its own output.
    """
    counts = stream_histogram(stream, ts, value, bounds, by, window, watermark, bins)

    def emit(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()  # one row per window, group and bin; read more than once below
        drift_of(kept, bounds, baseline, by, bins).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
        kept.unpersist()

    return (
        counts.writeStream.outputMode("append")
        .foreachBatch(emit)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def run_to_table(stream: DataFrame, out_path: str, checkpoint: str) -> DataFrame:
    """Process what is available, append it to parquet files and read them back."""
    schema = stream.schema
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", out_path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(schema).parquet(out_path)
