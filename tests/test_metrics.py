"""Instruments: what is kept, merged and summed."""

from palimpsest.operators import metrics


def measure(name, at, seconds, n):
    return (name, f"{name} {at}", float(at), {"seconds": float(seconds)}, {"n": n})


def test_latest_and_slowest_are_kept():
    one = metrics.Instruments(3)
    for i, s in enumerate([5, 1, 5, 2, 9, 1]):
        one.add(measure("a", i, s, i))
    assert [m[2] for m in one.recent["a"]] == [3, 4, 5] and [m[3]["seconds"] for m in one.slowest["a"]] == [9, 5, 5]
    two = metrics.Instruments(3)
    for i, s in enumerate([7, 8]):
        two.add(measure("a", 10 + i, s, 1))
    two.add(measure("b", 20, 1, 1))
    one.merge(two)
    assert [m[2] for m in one.recent["a"]] == [5, 10, 11] and [m[3]["seconds"] for m in one.slowest["a"]] == [9, 8, 7] and len(one.recent["b"]) == 1


def test_totals_and_averages(spark):
    one = metrics.Instruments(20)
    for i in range(30):
        one.add(measure("a", i, 1 + i % 2, 3))
    with one.measured("b", "x") as counters:
        counters["n"] = 7
    rows = {(r["group"], r["name"], r["instance"]): r for r in one.table(spark).collect()}
    assert len(rows) == 2 * (20 + 1) + 2 * 4
    total, mean = rows["Slowest", "a", "Total"], rows["Slowest", "a", "Average"]
    assert total["timers"]["seconds"] == 15 * 2 + 5 and total["counters"]["n"] == 60 and mean["counters"]["n"] == 3 and mean["timers"]["seconds"] == 1.75
    assert rows["Recent", "b", "Total"]["counters"] == {"n": 7}


def test_without_measures(spark):
    assert metrics.Instruments().table(spark).count() == 0


def test_history_of_rows(spark):
    df = spark.createDataFrame([measure("a", i, i % 5, i) for i in range(10)], metrics.MEASURES)
    got = metrics.history(df, "seconds", 3).collect()
    assert sorted((r["group"], r["at"]) for r in got) == [("Recent", 7), ("Recent", 8), ("Recent", 9), ("Slowest", 3), ("Slowest", 4), ("Slowest", 9)]
