import time

import pytest
from pyspark.sql import functions as F

from cuesheet.session import DROP_SHUFFLES, materialise, written


@pytest.mark.parametrize("keep", [materialise, written])
def test_kept_tables_leave_no_shuffle_files(spark, keep):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return sum("shuffle_" in str(disk.getAllFiles().apply(i)) for i in range(disk.getAllFiles().size()))

    held, before = files(), spark.conf.get(DROP_SHUFFLES)
    sums = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("n"))
    kept = keep(sums.join(spark.range(7).withColumnRenamed("id", "k").hint("merge"), "k"))
    end = time.monotonic() + 20
    while files() > held and time.monotonic() < end:
        time.sleep(0.1)
    assert files() <= held
    assert spark.conf.get(DROP_SHUFFLES) == before
    assert {r["k"]: r["n"] for r in kept.collect()} == {k: sum(range(k, 1000, 7)) for k in range(7)}
