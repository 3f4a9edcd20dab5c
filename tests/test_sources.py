"""XES, CSV, the stored log, and the stream."""

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from tracelake.sources import store, xes
from tracelake.streaming.ingest import for_each_log

XES = """<?xml version="1.0"?><log xmlns="http://www.xes-standard.org/"><string key="concept:name" value="the log"/>
<global scope="event"><string key="concept:name" value="global"/></global>
<trace><string key="concept:name" value="1001"/>
<event><string key="concept:name" value="NA"/><date key="time:timestamp" value="2016-01-01T09:00:00.123+01:00"/><string key="org:resource" value="null"/><string key="lifecycle:transition" value="complete"/></event>
<event><list key="x"><string key="concept:name" value="WRONG"/></list><string key="concept:name" value="B"/></event></trace>
<trace><event><string key="concept:name" value="C"/></event><event ><date key="time:timestamp" value="x"/></event><string key="concept:name" value="late"/></trace></log>"""


@pytest.mark.parametrize("ending", ["xes", "xes.gz"])
def test_xes(spark, tmp_path, ending):
    path = tmp_path / f"log.{ending}"
    path.write_bytes(gzip.compress(XES.encode()) if ending.endswith("gz") else XES.encode())
    rows = sorted(map(tuple, xes.read_xes(spark, str(path)).collect()), key=lambda r: r[:2])
    assert rows == [("1001", 0, "NA", "complete", "2016-01-01T09:00:00.123+01:00", "null"), ("1001", 1, "B", None, None, None), ("late", 0, "C", None, None, None), ("late", 1, None, None, "x", None)]
    assert xes.count_raw_events(spark, str(path)) == 4


def test_stored_log(spark, tmp_path):
    rows = [("1", 0, "NA", None, "null", None, None), ("1", 1, "B", None, None, None, "done")]
    log = spark.createDataFrame(rows, store.LOG_SCHEMA)
    store.write_log_csv(log, str(tmp_path / "csv"))
    store.write_log_csv(quoted := log.withColumn("activity", F.lit('say "x", y')), str(tmp_path / "quoted.csv"), one_file=True)
    assert sorted(map(tuple, store.read_log_csv(spark, str(tmp_path / "quoted.csv")).collect())) == sorted(map(tuple, quoted.collect()))
    assert sorted(map(tuple, store.read_log_csv(spark, str(tmp_path / "csv")).collect())) == rows
    swapped = log.select("event_index", "case_id", *log.columns[2:])
    store.write_log_csv(swapped, str(tmp_path / "swapped"), one_file=True)
    with pytest.raises(Exception, match="CSV header"):
        store.read_log_csv(spark, str(tmp_path / "swapped")).collect()
    at = str(tmp_path / "log")
    assert store.replace_log(log, at) == 2 and store.replace_log(log.limit(1), at) == 1
    with pytest.raises(store.RowCountMismatch):
        store.replace_log(log.union(log), at)
    assert store.read_log(spark, at).count() == 1 and spark.read.parquet(at + "_runs").count() == 2
    assert store.versions(spark, at) == [1, 2] and not list((tmp_path / "log").glob("_new*"))
    assert store.replace_log(log, at) == 2 and store.versions(spark, at) == [2, 3]
    assert [r.event_index for r in store.read_log(spark, at, ordered=True).collect()] == [0, 1]
    with pytest.raises(FileNotFoundError):
        store.read_log(spark, str(tmp_path / "none"))


def test_events_are_counted_by_line(spark, tmp_path):
    (tmp_path / "lines.xes").write_text("<log><trace><event\n key='x'/><event/>\n<events/><event >x</event>\n</trace></log>")
    assert xes.count_raw_events(spark, str(tmp_path / "lines.xes")) == 3


def test_fetch(tmp_path):
    source = tmp_path / "a"
    source.write_bytes(b"abc")
    good = hashlib.sha256(b"abc").hexdigest()
    assert store.fetch(source.as_uri(), good, tmp_path / "b").read_bytes() == b"abc"
    with pytest.raises(store.ChecksumMismatch):
        store.fetch(source.as_uri(), "0" * 64, tmp_path / "c")
    assert not (tmp_path / "c").exists()


def test_stream(spark, tmp_path):
    spark.createDataFrame([("1", 0, "A", None, "2016-01-01", None)], store.RAW_SCHEMA).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(store.RAW_SCHEMA).parquet(str(tmp_path / "in"))
    for_each_log(stream, lambda df, n: seen.append(df.count()), str(tmp_path / "state")).awaitTermination(60)
    assert sum(seen) == 1


def test_one_file_keeps_order_and_content(spark, tmp_path):
    """Many parts, some empty, behind one header; a rewrite takes the place of a file or a folder, and nothing else stays."""
    at = tmp_path / "out" / "table.csv"
    rows = [(k, None if k % 7 == 0 else "" if k % 5 == 0 else f'a,"{k}"\nb') for k in range(3000)]
    found = spark.createDataFrame(rows, 'k int, `odd,"name"` string').repartitionByRange(8, "k").sortWithinPartitions("k")
    at.mkdir(parents=True)
    store.write_one_csv(found, str(at))
    assert at.is_file() and [p.name for p in at.parent.iterdir() if not p.name.endswith(".crc")] == ["table.csv"]
    again = spark.read.schema(found.schema).options(header=True, enforceSchema=False, multiLine=True, escape='"').csv(str(at))
    with open(at, newline="") as f:
        assert f.readline() == 'k,"odd,""name"""\n'
    assert found.rdd.getNumPartitions() == 8 and [tuple(r) for r in again.collect()] == [(k, v or None) for k, v in rows]
    assert '\n5,""\n' in at.read_text() and at.read_text().startswith('k,"odd,""name"""\n0,\n')
    store.write_one_csv(found.where("k < 0"), str(at))
    assert at.read_text().count("\n") == 1
    store.write_one_csv(found.where("k = 1").select("k"), str(at))
    assert at.read_text() == "k\n1\n"


def test_a_failed_write_leaves_the_file_before(spark, tmp_path):
    at = tmp_path / "table.csv"
    store.write_one_csv(spark.range(3).orderBy("id"), str(at))
    with pytest.raises(Exception, match="no row"):
        store.write_one_csv(spark.range(3).selectExpr("cast(raise_error('no row') AS bigint) AS id"), str(at))
    assert at.read_text() == "id\n0\n1\n2\n" and [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["table.csv"]
