from datetime import datetime

from spanloom.operators import redelivery as R

SCHEMA = "trace_id string, span_id string, received_at timestamp_ntz, delivery_id bigint, copies string, _row int"
KEYS, ORDER = ["trace_id", "span_id"], ["received_at", "delivery_id"]


def at(m):
    return datetime(2026, 1, 1, 0, m)


def write(spark, tmp_path, rows, parts=2):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(parts).write.parquet(path)
    return path


def test_one_copy_of_each_with_uneven_ids_ties_and_nulls(spark, tmp_path):
    rows = [
        ("AB-cd", "01", at(5), 2, "x", 0), ("abcd", " 01 ", at(1), 9, "y", 1), ("0xABCD", "01", at(1), 8, "z", 2),  # the earliest, then the smaller id
        ("abcd", "02", at(1), 3, None, 3), (None, "01", at(1), 4, "", 4), (None, "01", at(1), 5, "", 5), (" ", "01", None, 6, "", 6), ("ef", "03", None, 7, "", 7), ("EF", "03", at(9), 1, "", 8),
    ]
    path = write(spark, tmp_path, rows)
    kept = {r["delivery_id"] for r in R.read_once(spark, path, KEYS, ORDER).collect()}
    assert kept == {8, 3, 4, 5, 6, 1}
    assert {(r["trace_id"], r["span_id"], r["copies"]) for r in R.redelivered(spark, path, KEYS, ORDER).collect()} == {("abcd", "01", 3), ("ef", "03", 2)}
    assert R.read_once(spark, path, KEYS, ORDER).columns == [x.split()[0] for x in SCHEMA.split(", ")]  # clashing names stay


def test_hot_key_against_brute_force(spark, tmp_path):
    rows = [(f"{i % 700:032x}" if i % 3 else "f" * 32, f"{i % 2:016x}", at(i % 60), i, None, i) for i in range(6000)]
    path = write(spark, tmp_path, rows, 3)
    best = {}
    for t, s, a, d, *_ in rows:
        best[t, s] = min(best.get((t, s), (a, d)), (a, d))
    assert sorted(r["delivery_id"] for r in R.read_once(spark, path, KEYS, ORDER).collect()) == sorted(d for _, d in best.values())


def test_empty_table(spark, tmp_path):
    path = write(spark, tmp_path, [], 1)
    assert R.read_once(spark, path, KEYS, ORDER).count() == 0
    assert R.redelivered(spark, path, KEYS, ORDER).count() == 0


def test_plan_combines_before_its_only_exchange(spark, tmp_path):
    path = write(spark, tmp_path, [("a", "b", at(1), 1, None, 1)])
    plan = R.redelivered(spark, path, KEYS, ORDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("HashAggregate") == 2 and "Sort" not in plan
