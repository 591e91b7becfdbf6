import random

from pyspark.sql import functions as F

from chunkloom.operators.scan import latest, latest_value, number_rows, page_ranges, position_ranges, running


def test_ranges_equal_the_plain_window(spark):
    rng = random.Random(3)
    rows = [(d, p, rng.randint(0, 5), rng.choice([None, "a", "b", "c"])) for d in "xyz" for p in rng.sample(range(200), 60)]
    df = spark.createDataFrame(rows, "d string, p bigint, v int, s string")
    aggs = {
        "total": ("sum", F.col("v")),
        "top": ("max", F.col("v")),
        "low": ("min", F.col("v")),
        "last": latest(["p"], F.col("s")),
    }
    for inclusive in (True, False):
        out = []
        for ranges in ((), position_ranges("p", 7), [position_ranges("p", 7)[0]]):
            r = running(df, ["d"], ["p"], aggs, ranges, inclusive)
            out.append(sorted(r.withColumn("last", latest_value("last")).collect(), key=str))
        assert out[0] == out[1] == out[2]


def test_numbers_over_pages(spark):
    rng = random.Random(4)
    rows = [(d, rng.randint(1, 30), p) for d in "xy" for p in range(150)]
    df = spark.createDataFrame(rows, "d string, page bigint, p bigint")
    a = number_rows(df, ["d"], ["page", "p"], "n", ()).collect()
    b = number_rows(df, ["d"], ["page", "p"], "n", page_ranges("page", "p", 10)).collect()
    assert sorted(a) == sorted(b)
