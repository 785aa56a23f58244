"""Tables kept between steps: shuffle files on the way there are released, and a table can be given up."""

import os
import time

from pyspark.sql import functions as F

from flipside.session import checkpointed, given_up


def shuffled(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_shuffle_files_of_a_kept_table_are_released(spark):
    before = shuffled(spark)
    kept = checkpointed(spark.range(5000).groupBy((F.col("id") % 1000).alias("k")).count())
    for _ in range(50):
        if not shuffled(spark) - before:
            break
        time.sleep(0.2)
    assert not shuffled(spark) - before
    assert kept.agg(F.sum("count")).first()[0] == 5000


def test_only_kept_tables_are_given_up(spark):
    kept = checkpointed(spark.range(10))
    other = spark.range(10)
    assert os.path.isdir(kept.kept_path.removeprefix("file:"))
    given_up(kept, other)
    assert not os.path.exists(kept.kept_path.removeprefix("file:"))
    assert other.count() == 10
