"""Readers, writers and the streaming route over small folders."""

from fathomline.operators.messages import request_lines
from fathomline.schema import CHUNKS
from fathomline.sources import files
from fathomline.streaming.ingest import stream_chunks


def test_scan_files(spark, tmp_path):
    (tmp_path / "course" / "A").mkdir(parents=True)
    (tmp_path / "course" / "A" / "x.md").write_bytes(b"# T\r\nbody \xff here")
    (tmp_path / "course" / "A" / "_skip.md").write_bytes(b"no")
    (tmp_path / "course" / "A" / "y.csv").write_bytes(b"no")
    got = files.scan_files(spark, str(tmp_path)).collect()
    assert [(g.rel, g.text) for g in got] == [("course/A/x.md", "# T\nbody  here")]


def test_round_trips(spark, tmp_path):
    rows = spark.createDataFrame([("i1", "C", "course", "raw", None, "s", 1, "文本")], CHUNKS)
    files.write_chunks(rows, str(tmp_path / "c"))
    assert files.read_chunks(spark, str(tmp_path / "c")).collect() == rows.collect()
    vec = spark.createDataFrame([("i1", [0.5, 0.25])], "id string, vec array<float>")
    files.append_vectors(vec, str(tmp_path / "v"))
    files.append_vectors(files.embed(rows.select("id", "text"), lambda: lambda ts: [[float(len(t))] for t in ts]), str(tmp_path / "v"))
    assert files.read_vectors(spark, str(tmp_path / "v")).count() == 2
    files.write_requests(request_lines(rows, "m"), str(tmp_path / "r"))
    assert '"custom_id":"i1"' in spark.read.text(str(tmp_path / "r")).first().value


def test_stream(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("Notes/a.txt", "word " * 400)], "rel string, text string").write.parquet(source)
    stream_chunks(spark, source, target, str(tmp_path / "ck")).awaitTermination()
    first = spark.read.parquet(target).count()
    spark.createDataFrame([("Notes/b.txt", "more " * 100)], "rel string, text string").write.mode("append").parquet(source)
    stream_chunks(spark, source, target, str(tmp_path / "ck")).awaitTermination()
    assert first == 2 and spark.read.parquet(target).count() == 3
