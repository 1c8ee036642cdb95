import os
import time

import pandas as pd

from veilgraph.plans.staging import BATCH, CLEANUP, staged


def shuffles(spark):
    """Names of the shuffle files that are on disk."""
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in dirs for _, _, files in os.walk(d) for f in files if f.startswith("shuffle_")}


def test_staged_tables_leave_no_shuffles(spark):
    own, before = spark.conf.get(CLEANUP), shuffles(spark)
    out = staged(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count())
    assert out.count() == 7 and spark.conf.get(CLEANUP) == own
    again = staged(out.repartition(3, "k"))  # read after its shuffle went
    assert sorted(r["k"] for r in again.collect()) == list(range(7))
    for _ in range(50):
        left = shuffles(spark) - before
        if not left:
            break
        time.sleep(0.2)
    assert not left


def test_staged_tables_bound_batches(spark):
    def size(parts):
        for part in parts:
            yield pd.DataFrame({"n": [len(part)]})

    rows, own = spark.range(0, 4000, 1, 1).selectExpr("repeat('x', 1000) AS t"), spark.conf.get(BATCH)
    sizes = lambda df: [r["n"] for r in df.collect()]
    small = sizes(staged(rows.mapInPandas(size, "n long"), "sizes", "64k"))
    assert sum(small) == 4000 and max(small) <= 100 and spark.conf.get(BATCH) == own
    assert sizes(staged(rows.mapInPandas(size, "n long"), "sizes")) == [4000]
