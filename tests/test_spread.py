from veilgraph.plans import staging
from veilgraph.sources import graphs


def test_partitions_grow_with_the_lines(spark, monkeypatch):
    monkeypatch.setattr(staging, "ROWS", 20)
    lines = spark.createDataFrame([(o, 7 * o % 50 + i) for o in range(100) for i in range(3)], "l_orderkey long, l_partkey long")
    for least in (1, 2):
        pairs = graphs.co_purchase(lines, least)
        assert pairs.rdd.getNumPartitions() == 30  # two pairs a line
        counts = {}
        for o in range(100):
            p = sorted({7 * o % 50 + i for i in range(3)})
            for x in ((a, b) for i, a in enumerate(p) for b in p[i + 1 :]):
                counts[x] = counts.get(x, 0) + 1
        assert sorted(map(tuple, pairs.collect())) == sorted(x for x, c in counts.items() if c >= least)
