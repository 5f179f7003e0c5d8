"""The partition-level engine against a plain model, over reducers and splits."""

import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.operators import text_jobs
from millrace.operators.text_jobs import distinct_map, values_in_order
from millrace.plans import mapreduce


def texts(seed: int, n: int = 400) -> list[str]:
    r = random.Random(seed)
    return [r.choice(["", " ", "x", "y\tz", " é ", "k1", "k2\t1", "k2\t"]) + str(r.randint(0, 9)) * r.randint(0, 2) for _ in range(n)]


@pytest.mark.parametrize("reduces", [1, 2, 4, 7])
@pytest.mark.parametrize("splits", [1, 5])
def test_distinct_against_model(spark, reduces, splits):
    given = texts(reduces * 10 + splits)
    df = spark.createDataFrame([(t,) for t in given], "value string").repartition(splits)
    made = mapreduce.partitions(df, distinct_map, mapreduce.by_key(lambda k, v: [k], rows_a_batch=3), reduces)
    assert made.rdd.getNumPartitions() == reduces
    from millrace.functions.text import WHITE_SPACE

    want = sorted({s.split("\t")[0] for t in given if (s := t.strip(WHITE_SPACE))}, key=str.encode)
    assert [r.line for r in mapreduce.in_order(made).collect()] == want


@pytest.mark.parametrize("size", ["1", "50", "10000"])
def test_state_survives_batches(spark, size):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        df = spark.createDataFrame([("a",)] * 120 + [("b",)] * 7, "value string")
        reduce = mapreduce.by_key(lambda k, v: [f"{k}\t{sum(1 for _ in v)}"])
        rows = mapreduce.partitions(df, distinct_map, reduce, 2).collect()
        assert sorted(r.line for r in rows) == ["a\t120", "b\t7"]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_unread_values_are_passed_over(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "value string")
    rows = mapreduce.partitions(df, distinct_map, mapreduce.by_key(lambda k, v: [f"{k}{next(v)}"]), 1).collect()
    assert [r.line for r in rows] == ["a1", "b1"]


def test_value_order(spark):
    df = spark.range(0, 300, 1, 3).select((F.col("id") % 4).cast("string").alias("key"), F.col("id").cast("string").alias("value"))
    found = mapreduce.shuffled(df, 3, value_order=True).collect()
    for k in "0123":
        assert [int(r.value) for r in found if r.key == k] == list(range(int(k), 300, 4))


def test_values_in_given_order(spark):
    df = spark.createDataFrame([("a", "x", 3), ("a", "y", 1), ("b", None, 2)], "k string, v string, o int")
    assert {r.key: r.found for r in values_in_order(df, "k", "v", ["o"]).collect()} == {"a": "y,x", "b": ""}


def test_bytes_functions(spark):
    def count(given: bytes) -> bytes:
        return b"".join(b"%s\t1\n" % w for w in given.split())

    def total(given: bytes) -> bytes:
        out: dict[bytes, int] = {}
        for line in given.splitlines():
            k, _, v = line.partition(b"\t")
            out[k] = out.get(k, 0) + int(v)
        return b"".join(b"%s\t%d\n" % x for x in out.items())

    df = spark.createDataFrame([("b a",), ("a a",), (None,)], "value string")
    made = mapreduce.partitions(df, mapreduce.as_bytes(count, "map"), mapreduce.as_bytes(total, "reduce"), 2)
    assert [r.line for r in mapreduce.in_order(made).collect()] == ["a\t3", "b\t1"]


def batches_of(columns: list[str], rows: list[tuple], size: int):
    for at in range(0, len(rows), size):
        yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*rows[at : at + size])], names=columns)


@pytest.mark.parametrize("piece", [1, 7, 40, 1 << 20])
def test_pieces_give_what_the_whole_gives(monkeypatch, piece):
    monkeypatch.setattr(mapreduce, "PIECE", piece)
    given = [(t,) for t in texts(5)] + [(None,), ("é" * 30,), ("",)]
    seen: list[bytes] = []

    def odd(pieces):
        """Gives its input in parts that end anywhere."""
        for x in pieces:
            seen.append(x)
            yield from (x[k : k + 3] for k in range(0, len(x), 3))

    whole = "".join(f"{t}\n" for (t,) in given if t is not None)
    want = [(k, v if t else None) for k, t, v in (x.partition("\t") for x in whole.split("\n") if x)]
    for fn in (mapreduce.as_pieces(odd, "map"), mapreduce.as_bytes(lambda b: b, "map")):
        made = [tuple(r.values()) for b in fn(batches_of(["value"], given, 9)) for r in b.to_pylist()]
        assert made == want
    assert b"".join(seen) == whole.encode() and all(x.endswith(b"\n") and len(x) < piece + 70 for x in seen)
    records = sorted(want, key=lambda r: r[0].encode())
    lines = [k if v is None else f"{k}\t{v}" for k, v in records if v is not None or k]
    for fn in (mapreduce.as_pieces(odd, "reduce"), mapreduce.as_bytes(lambda b: b, "reduce")):
        assert [x for b in fn(batches_of(["key", "value"], records, 9)) for x in b.column(0).to_pylist()] == lines


def test_pieces_have_a_size_guard_and_are_not_asked_for_without_lines():
    batch = pa.record_batch([pa.array(["x"] * 10)], names=["value"])
    made = mapreduce.as_pieces(lambda pieces: (b"y\n" * 400 for _ in range(10**9)), "map", most_ratio=4)
    with pytest.raises(ValueError, match="map made 1600 bytes of 20"):
        list(made(iter([batch])))
    assert list(mapreduce.as_pieces(lambda pieces: [b"a\n"], "reduce")(iter([]))) == []


def test_lines_of_files_hold_neither_a_partition_nor_a_key(monkeypatch, tmp_path, spark):
    caught = []
    monkeypatch.setattr(mapreduce, "partitions", lambda df, map, reduce, n=None: caught.append((map, reduce)) or df.selectExpr("value line"))  # noqa: A002
    text_jobs.distinct_lines_of_files(spark, str(tmp_path))
    map_, reduce = caught[0]
    many = 400

    def lines(key):
        for k in range(many):
            yield pa.record_batch([pa.array([f"{key(k * 1000 + i)} {'x' * 80}" for i in range(1000)])], names=["value"])

    def records(key):
        for b in lines(key):
            yield pa.record_batch([b.column(0), pa.array(["1"] * 1000)], names=["key", "value"])

    for fn, given, rows in ((map_, lines(str), many * 1000), (reduce, records("{:09d}".format), many * 1000), (reduce, records(lambda _: "one"), 1)):
        tracemalloc.start()
        found = sum(b.num_rows for b in fn(given))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert found == rows and most < 12e6  # of 36 MB and more of text


def test_bad_utf8_and_size_guard():
    batch = pa.record_batch([pa.array(["x"])], names=["value"])
    with pytest.raises(UnicodeDecodeError):
        list(mapreduce.as_bytes(lambda b: b"\xff\xfe", "map")(iter([batch])))
    out = next(mapreduce.as_bytes(lambda b: b"\xff", "map", strict_utf8=False)(iter([batch])))
    assert out.column(0).to_pylist() == ["�"]
    with pytest.raises(ValueError, match="bytes"):
        list(mapreduce.as_bytes(lambda b: b"x" * 5000, "map", most_ratio=4)(iter([batch])))


def test_lines_sort_with_their_end(spark):
    df = spark.createDataFrame([("a",), ("a\tb",), ("b",)], "line string")
    assert [r.line for r in mapreduce.in_order(df).collect()] == ["a\tb", "a", "b"]


def test_number_of_reduces_is_checked(spark):
    with pytest.raises(ValueError):
        mapreduce.partitions(spark.range(1).selectExpr("'a' value"), distinct_map, distinct_map, 0)


def test_native_plan_adds_up_before_the_shuffle(spark):
    df = spark.createDataFrame([("a",)], "text string")
    plan = mapreduce.columns(df, F.col("text"), [F.count(F.lit(1)).alias("n")])._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan


def test_reduces_follow_the_session(spark):
    df = spark.createDataFrame([("a",), ("b",)], "value string")
    made = mapreduce.partitions(df, distinct_map, mapreduce.by_key(lambda k, v: [k]))
    assert made.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_task_that_makes_too_much_fails(spark):
    def grows(batches):
        for _ in batches:
            for _ in range(100):
                yield pa.record_batch([pa.array(["x" * 100] * 50), pa.array(["1"] * 50)], names=["key", "value"])

    df = spark.createDataFrame([("a" * 100,)] * 20, "value string").coalesce(1)
    one = mapreduce.by_key(lambda k, v: [k])
    with pytest.raises(Exception, match="a task made"):
        mapreduce.partitions(df, grows, one, 1, most_ratio=4).collect()
    assert mapreduce.partitions(df, distinct_map, one, 1, most_ratio=4).count() == 1
