import time

import pytest
from pyspark.sql import functions as F

from tessera.llm import common


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    rows = spark.range(50_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.sum("id").alias("n"))
    out = common.saved(rows.join(spark.range(900).withColumnRenamed("id", "k").hint("merge"), "k"), "rows")
    end = time.time() + 10
    while (left := shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.1)
    assert not left
    assert out.count() == 900


@pytest.mark.parametrize("own", [None, "true", "false"])
def test_the_session_keeps_its_setting(spark, own):
    if own:
        spark.conf.set(common.CLEANUP, own)
    try:
        common.saved(spark.range(3), "rows")
        assert spark.conf.get(common.CLEANUP) == (own or "false")
        with pytest.raises(Exception, match="nothing"):
            common.saved(spark.range(3).select(F.raise_error(F.lit("nothing")).alias("x")), "rows")
        assert spark.conf.get(common.CLEANUP) == (own or "false")
    finally:
        spark.conf.unset(common.CLEANUP)
