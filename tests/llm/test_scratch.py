"""What intermediate tables leave behind."""

import time

from pyspark.sql import functions as F

from corvane.llm.common import CLEANUP, put


def shuffle_files(spark) -> int:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(1 for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_"))


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    spark.conf.set(CLEANUP, "false")
    try:
        kept = put(spark.range(1000).repartition(3, F.col("id") % 7), "scratch-test")
        assert spark.conf.get(CLEANUP) == "false"
    finally:
        spark.conf.unset(CLEANUP)
    for _ in range(50):
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffle_files(spark) <= before and kept.count() == 1000
