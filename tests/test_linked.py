"""Links by symbol, in cells of pairs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from driftwake.operators import contracts

IMPORTS, EXPORTS = "symbol string, node int, lang string, confidence double", "symbol string, node int, lang string"


def test_a_symbol_that_many_name_is_no_task_of_its_own(spark, monkeypatch):
    for name in ("TAKERS", "GIVERS"):
        monkeypatch.setattr(contracts, name, 64, raising=False)
    i = spark.createDataFrame([("s", n, "c", 0.5) for n in range(600)], IMPORTS).coalesce(1)
    e = spark.createDataFrame([("s", n, "java") for n in range(500)], EXPORTS).coalesce(1)
    sizes = [r["count"] for r in contracts.linked_by_symbol(i, e).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 300_000 and max(sizes) < 75_000


@pytest.mark.parametrize("sizes", [(3, 4, 2), (4096, 65_536, 256)])
def test_each_pair_once(spark, monkeypatch, sizes):
    for name, n in zip(("TAKERS", "GIVERS", "TOGETHER"), sizes):
        monkeypatch.setattr(contracts, name, n)
    rng = random.Random(5)
    some = lambda values: rng.choice([*values, None])
    i = [(some("aaaabc"), rng.randrange(30), some(["c", "java", "f"]), some([0.1, 0.5, 0.9])) for _ in range(60)]
    e = [(some("aaabd"), rng.randrange(30), some(["c", "java"])) for _ in range(50)]
    want = sorted((a[1], b[1], a[0], 0.8 if a[3] is None else min(a[3], 0.8)) for a, b in itertools.product(i, e) if a[0] and a[0] == b[0] and a[2] and b[2] and a[2] != b[2])
    got = contracts.linked_by_symbol(spark.createDataFrame(i, IMPORTS), spark.createDataFrame(e, EXPORTS))
    assert got.columns == ["src", "dst", "symbol", "confidence"] and sorted(map(tuple, got.collect())) == want and len(want) > 200
