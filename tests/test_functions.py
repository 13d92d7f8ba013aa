import math
import random

import pytest
from pyspark.sql import functions as F

from eqtlake.functions import formatting, stats
from eqtlake.functions.regions import Region, kb_to_bp, parse_region_column, parse_regions, split_ids

from . import support


def p_values(spark, pairs):
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, b double, s double")
    found = rows.select("i", stats.p_value(F.col("b"), F.col("s")).alias("p")).orderBy("i").collect()
    return [r.p for r in found]


def test_p_value_on_a_grid(spark):
    rng = random.Random(1)
    pairs = [(rng.gauss(0, 2), rng.choice([0.0, -1.0, rng.random() + 0.01])) for _ in range(500)]
    for got, pair in zip(p_values(spark, pairs), pairs, strict=True):
        assert got == pytest.approx(support.p_value(*pair), abs=1e-12)


@pytest.mark.parametrize(
    "pair,want",
    [
        ((1.0, 0.0), 1.0),
        ((1.0, -1.0), 1.0),
        ((1e9, 1e-12), 0.0),
        ((0.0, 1.0), 0.9999999989999999),
        ((1.96, 1.0), 0.04999565221644775),
        ((5.0, 1.0), 5.742100266381556e-07),
        ((8.3, 1.0), 0.0),
        ((math.nan, 1.0), 1.0),
        ((1.0, math.nan), 1.0),
        ((math.inf, 1.0), 1.0),
        ((1.0, math.inf), 1.0),
    ],
)
def test_p_value_edges(spark, pair, want):
    assert p_values(spark, [pair])[0] == pytest.approx(want, abs=1e-15)


def test_regions():
    assert Region.parse("1:1191870") == Region("1", 1191870, 1191870)
    assert Region.parse("1:100000-2000000") == Region("1", 100000, 2000000)
    assert parse_regions("1:5, X:2-3,1:5") == [Region("1", 5, 5), Region("X", 2, 3), Region("1", 5, 5)]
    for bad in ("1:200-100", "1:abc", "1:1-2-3", "1:-5", "1", "", "1:5,"):
        with pytest.raises(ValueError):
            parse_regions(bad)


def test_kilobases_truncate():
    assert kb_to_bp(1191.87) == 1191870
    assert kb_to_bp(1140.818) == 1140818
    assert Region("1", 1001, 1001).through_kb() == Region("1", 1000, 1000)
    assert split_ids(" a, b,,a") == ["a", "b", "", "a"]


def test_region_column(spark):
    texts = ["1:5", "X:2-9", "1:9-2", "1", "1:a", "1:1-2-3", "1:-5"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", parse_region_column(F.col("t")).alias("r"))
    found = {r.t: r.r and tuple(r.r) for r in rows.collect()}
    assert found == {"1:5": ("1", 5, 5), "X:2-9": ("X", 2, 9), **dict.fromkeys(texts[2:])}


def test_fixed_rounds_ties_to_even(spark):
    values = [0.0078125, 0.0234375, 0.5, -0.43608, 1e-9, -1e-9, 0.0, 12.3456785, float("nan")]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r.t for r in rows.select("i", formatting.fixed(F.col("v")).alias("t")).orderBy("i").collect()]
    assert got[:-1] == [f"{v:.6f}" for v in values[:-1]]
    assert got[-1].lower() == "nan"
