"""Sources, sinks, the job handle and streams."""

import os
import time

import pytest
from pyspark.sql import functions as F

from millrace import storage
from millrace.operators.text_jobs import distinct_map
from millrace.plans import job, mapreduce
from millrace.sources.text import generated_lines, read_lines, write_text
from millrace.streaming import lines as stream

ONE = mapreduce.by_key(lambda k, v: [k])


def put(folder, name: str, data: bytes) -> str:
    path = os.path.join(folder, name)
    with open(path, "wb") as f:
        f.write(data)
    return path


def test_lines_are_cut_at_lf_only_and_never_inside(spark, tmp_path):
    long = b"y" * 20_000
    path = put(tmp_path, "a.txt", b"x\ry\n" + long + b"\nlast")
    assert [r.value for r in read_lines(spark, path).collect()] == ["x\ry", long.decode(), "last"]
    path = put(tmp_path, "b.txt", b"".join(b"%06d\n" % k for k in range(40_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        df = read_lines(spark, path)
        assert df.rdd.getNumPartitions() > 2
        assert [int(r.value) for r in df.collect()] == list(range(40_000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_empty_file_and_bad_bytes(spark, tmp_path):
    assert read_lines(spark, put(tmp_path, "e.txt", b"")).count() == 0
    bad = put(tmp_path, "bad.txt", b"a\xff\xfeb\n")
    with pytest.raises(Exception, match="(?i)utf"):
        read_lines(spark, bad).collect()
    assert "�" in read_lines(spark, bad, strict_utf8=False).first().value


def test_generator(spark):
    a, b = generated_lines(spark, 1, 7), generated_lines(spark, 1, 7)
    assert a.agg(F.sum(F.length("value") + 1)).first()[0] >= 1 << 20
    assert a.exceptAll(b).count() == 0
    assert a.where(~F.col("value").rlike("^[a-z]{3,20}$")).count() == 0
    assert generated_lines(spark, 0).count() == 0
    assert generated_lines(spark, 1, 8).intersect(a).count() < a.count() / 10


def test_text_sink(spark, tmp_path):
    df = spark.createDataFrame([("b",), ("a",)], "value string").orderBy("value")
    write_text(df, f"{tmp_path}/out", one_file=True)
    parts = [p for p in os.listdir(f"{tmp_path}/out") if p.startswith("part")]
    assert [open(f"{tmp_path}/out/{p}").read() for p in parts] == ["a\nb\n"]


def test_job_life(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",)], "value string")
    h = job.submit(spark, distinct_map, ONE, df, num_reduces=2)
    h.wait()
    assert h.status()["status"] == "done" and h.status()["reduce_progress"] == 1.0
    assert list(h.result()) == ["a", "b"]
    with pytest.raises(job.Gone):
        h.result()
    h.close()


def test_generated_job_and_validation(spark):
    h = job.submit(spark, distinct_map, ONE, generate_mb=0)
    assert list(h.wait().result()) == []
    with pytest.raises(ValueError):
        job.submit(spark, distinct_map, ONE)
    with pytest.raises(ValueError):
        job.submit(spark, distinct_map, ONE, generate_mb=0, num_reduces=0)


def test_failed_job(spark):
    def broken(batches):
        raise RuntimeError("no")
        yield

    h = job.submit(spark, broken, ONE, spark.range(1).selectExpr("'a' value")).wait()
    assert h.status()["status"] == "failed"
    with pytest.raises(RuntimeError):
        h.result()


def test_deadline_stops_an_endless_function(spark):
    def endless(batches):
        while True:
            time.sleep(0.05)
        yield

    began = time.time()
    h = job.submit(spark, endless, ONE, spark.range(1).selectExpr("'a' value"), deadline=2.0)
    h.wait(60)
    assert h.state is job.State.FAILED and isinstance(h.error, TimeoutError) and time.time() - began < 50


def test_the_second_attempt_succeeds(spark, tmp_path):
    mark = os.path.join(tmp_path, "tried")

    def breaks_once(batches):
        if not os.path.exists(mark):
            open(mark, "w").close()
            raise RuntimeError("no")
        yield from distinct_map(batches)

    df = spark.createDataFrame([("b",), ("a",)], "value string").coalesce(1)
    h = job.submit(spark, breaks_once, ONE, df, num_reduces=1).wait()
    assert h.status()["status"] == "done" and h.attempt == 2 and list(h.result()) == ["a", "b"]
    os.remove(mark)
    h = job.submit(spark, breaks_once, ONE, df, num_reduces=1, attempts=1).wait()
    assert h.status()["status"] == "failed" and h.attempt == 1
    with pytest.raises(ValueError):
        job.JobHandle(spark, lambda: df, attempts=0)


def test_a_job_on_a_path_is_found_by_its_id_and_leaves_no_files(spark, tmp_path):
    path = put(tmp_path, "in.txt", b"b\n a\nb\n\n")
    h = job.submit(spark, distinct_map, ONE, path, num_reduces=2, most_ratio=100).wait()
    assert job.find(h.id) is h and job.find(h.id).status()["status"] == "done"
    at = h._path.removeprefix("file://")
    assert os.path.isdir(at)
    lines = h.result()
    assert next(lines) == "a" and os.path.isdir(at)
    assert list(lines) == ["b"] and not os.path.exists(at)
    h.close()
    with pytest.raises(job.Unknown):
        job.find(h.id)


def test_a_result_that_cannot_be_opened_can_be_asked_for_again(spark, monkeypatch):
    h = job.submit(spark, distinct_map, ONE, spark.range(1).selectExpr("'a' value"), num_reduces=1).wait()
    order = mapreduce.in_order
    monkeypatch.setattr(job.mapreduce, "in_order", lambda lines: order(lines).select((1 / 0)))
    with pytest.raises(ZeroDivisionError):
        h.result()
    monkeypatch.setattr(job.mapreduce, "in_order", order)
    assert list(h.result()) == ["a"]


def test_tables_go_when_nothing_reads_them(spark):
    made = []
    with storage.collected(made):
        a = storage.materialize(spark.range(3), "test-a")
        b = storage.materialize(a.where("id > 0"), "test-b")
    assert len(made) == 2 and storage.read_by(b) and a.count() == 3
    kept = storage.discard(spark, made, keep=b.select("id").distinct())
    assert len(kept) == 1 and b.count() == 2
    assert storage.discard(spark, kept) == []


@pytest.mark.parametrize("form", ["{}", "{}//", "file:{}", "file://{}", "file://{}/x/.."])
def test_what_is_read_stays_however_the_folder_is_written(spark, tmp_path, monkeypatch, form):
    monkeypatch.setattr(storage, "shared_dir", lambda _: form.format(tmp_path))
    made = []
    with storage.collected(made):
        a = storage.materialize(spark.range(3), "test-a")
        b = storage.materialize(a.where("id > 0"), "test-b")
    kept = storage.discard(spark, made, keep=b)
    assert kept == made[1:] and b.count() == 2
    assert [x[:6] for x in os.listdir(tmp_path / "millrace")] == ["test-b"]


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Fake:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(Fake)


def test_streams(spark, tmp_path):
    folder, mark = tmp_path / "in", tmp_path / "mark"
    folder.mkdir()
    put(folder, "1.txt", b"a\n b \n")
    put(folder, "2.txt", b"b\nc\tx\n\n")
    q = stream.new_lines(stream.stream_lines(spark, str(folder))).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(mark)).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.key for r in spark.table("seen").collect()) == ["a", "b", "c"]
    events = spark.createDataFrame([("2024-01-01 00:10:00", "x"), ("2024-01-01 00:20:00", "x"), ("2024-01-01 05:00:00", "y")], "t string, event_type string").selectExpr("cast(t as timestamp) ts", "event_type")
    events.write.parquet(f"{tmp_path}/ev")
    live = stream.counts_by_window(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/ev"))
    q = live.writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.event_type, r.n) for r in spark.table("windows").collect()] == [("x", 2)]


def test_a_stream_of_new_lines_with_a_time_forgets(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "a"), ("2024-01-01 00:10:00", "a "), ("2024-01-01 00:20:00", "b")]
    spark.createDataFrame(rows, "t string, value string").selectExpr("cast(t as timestamp) t", "value").write.parquet(f"{tmp_path}/timed")
    live = stream.new_lines(spark.readStream.schema("t timestamp, value string").parquet(f"{tmp_path}/timed"), "t", "30 minutes")
    q = live.writeStream.format("memory").queryName("timed").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.key for r in spark.table("timed").collect()) == ["a", "b"]
