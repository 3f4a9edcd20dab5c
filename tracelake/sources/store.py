"""Event logs and reports as files: typed CSV, Parquet with a checked replacement, and verified downloads."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tempfile
import urllib.request
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = "case_id string, event_index bigint, activity string, timestamp timestamp, resource string, cost double, outcome string"
RAW_SCHEMA = "case_id string, event_index bigint, activity string, lifecycle string, timestamp string, resource string"
TIMES, TIME = "yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd HH:mm:ss.SSSSSS"
BUFFER = 1 << 20


class ChecksumMismatch(ValueError):
    """A file's content is not the expected one."""


class RowCountMismatch(ValueError):
    """What was read back is not what was written."""


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir; a local one only where the session runs
    on one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="tracelake-")
    return f"{shared}/{uuid.uuid4().hex}"


def sha256_of(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def fetch(url: str, sha256: str, to: str | Path, force: bool = False) -> Path:
    """The file behind a URL, verified; a verified copy is used again. A failed fetch leaves nothing behind."""
    to = Path(to)
    if to.exists() and not force and sha256_of(to) == sha256:
        return to
    to.parent.mkdir(parents=True, exist_ok=True)
    part = to.with_name(f"{to.name}.{uuid.uuid4().hex}.part")
    try:
        with urllib.request.urlopen(url) as source, open(part, "wb") as out:
            shutil.copyfileobj(source, out)
        if (found := sha256_of(part)) != sha256:
            raise ChecksumMismatch(f"{url}: expected {sha256}, found {found}")
        os.replace(part, to)
    finally:
        part.unlink(missing_ok=True)
    return to


def read_log_csv(spark: SparkSession, path: str, schema: str = LOG_SCHEMA) -> DataFrame:
    """A log from CSV with a header; only the empty cell is null, so NA and null are texts. Columns must stand in the
    schema's order: another header is an error when the log is read."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("timestampFormat", TIMES).option("escape", '"').csv(path)


def write_log_csv(log: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with headers, ordered by case and position within and between files; one_file: path is a file then."""
    ordered = log.orderBy("case_id", "event_index")
    if one_file:
        return write_one_csv(ordered, path)
    times = {c: F.date_format(c, TIME) for c, kind in log.dtypes if kind.startswith("timestamp")}  # with and without zone
    ordered.withColumns(times).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_one_csv(df: DataFrame, path: str) -> None:
    """df as one CSV file with a header, in df's order. Null is the empty cell, an empty text is "" (Spark
    reads both as null), a quote is doubled.

    The parts are written by as many tasks as df has, beside path, then put together behind the header: by the store
    itself where it can (HDFS links their blocks), else copied one after the other through a buffer of BUFFER bytes. The
    file gets its name by one rename, so a reader sees the one before or the whole new one; a crash leaves only files
    beside it.
    """
    spark, aside = df.sparkSession, f"{path}.{uuid.uuid4().hex}"
    times = {c: F.date_format(c, TIME) for c, kind in df.dtypes if kind.startswith("timestamp")}
    fs, folder = _files(spark, f"{aside}.parts")
    try:
        df.withColumns(times).write.option("header", False).option("escape", '"').csv(folder.toString())
        parts = sorted((f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-") and f.getLen()), key=lambda f: f.getName())
        quoted = [f'"{c.replace(chr(34), chr(34) * 2)}"' if any(x in c for x in ',"\n\r') else c for c in df.columns]
        write_text(spark, ",".join(quoted) + "\n", aside)
        _join_files(spark, fs, _files(spark, aside)[1], parts)
        _rename_over(spark, aside, path)
    finally:
        fs.delete(folder, True)
        fs.delete(_files(spark, aside)[1], False)


def _join_files(spark: SparkSession, fs, head, parts: list) -> None:
    """Put files behind head, in their order."""
    gateway, hadoop = spark.sparkContext._gateway, spark.sparkContext._jvm.org.apache.hadoop
    if not parts:
        return
    if fs.hasPathCapability(head, "fs.capability.paths.concat"):
        named = gateway.new_array(hadoop.fs.Path, len(parts))
        for k, part in enumerate(parts):
            named[k] = part
        fs.concat(head, named)
        return
    begun = fs.makeQualified(head).suffix(".head")
    fs.rename(head, begun)
    out = fs.create(head, True)
    try:
        for part in [begun, *parts]:
            source = fs.open(part)
            try:
                hadoop.io.IOUtils.copyBytes(source, out, BUFFER, False)
            finally:
                source.close()
    finally:
        out.close()
        fs.delete(begun, False)


def _rename_over(spark: SparkSession, old: str, new: str) -> None:
    """Name a file new, in place of the file there; a folder there, as earlier versions left it, goes first."""
    gateway, hadoop = spark.sparkContext._gateway, spark.sparkContext._jvm.org.apache.hadoop
    fs, at = _files(spark, new)
    if fs.exists(at) and fs.getFileStatus(at).isDirectory():
        fs.delete(at, True)
    options = gateway.new_array(getattr(hadoop.fs, "Options$Rename"), 1)
    options[0] = getattr(hadoop.fs, "Options$Rename").OVERWRITE
    hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(_files(spark, old)[1]), fs.makeQualified(at), options)


def _files(spark: SparkSession, at: str):
    """Hadoop's file system of a path, and the path: any store that Spark reaches."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions of the stored log; each got its name by one rename, after it was checked."""
    fs, at = _files(spark, path)
    found = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n[2:]) for n in found if n.startswith("v=") and n[2:].isdigit())


def staged(df: DataFrame, at: str) -> DataFrame:
    """df, written at a path and read from there by all that follows."""
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


def replace_log(log: DataFrame, path: str, audit: dict | None = None) -> int:
    """Replace the log at path by a new version: written aside, read back, checked, then named by one rename.

    The version before stays readable until then, so neither a failed check nor a crash loses it; older ones are
    removed. Each replacement adds a row to path_runs.
    """
    spark, seen = log.sparkSession, Observation()
    fs, aside = _files(spark, f"{path}/_new_{uuid.uuid4().hex}")
    log.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(aside.toString())
    written = spark.read.parquet(aside.toString())
    rows = written.count()
    twice = not written.groupBy("case_id", "event_index").count().where("count > 1").isEmpty()
    if twice or rows != seen.get["rows"]:
        fs.delete(aside, True)
        raise RowCountMismatch("rows with the same case and position" if twice else f"{rows} rows were written")
    held = versions(spark, path)
    if not fs.rename(aside, _files(spark, f"{path}/v={max(held, default=0) + 1}")[1]):
        raise OSError(f"the new version of {path} could not be named")
    for old in held[:-1]:
        fs.delete(_files(spark, f"{path}/v={old}")[1], True)
    run = spark.range(1).select(F.lit(uuid.uuid4().hex).alias("run_id"), F.current_timestamp().alias("ingested_at"), F.lit(rows).alias("rows"), F.lit(json.dumps(audit or {}, sort_keys=True)).alias("report"))
    run.write.mode("append").parquet(f"{path}_runs")
    return rows


def read_log(spark: SparkSession, path: str, ordered: bool = False) -> DataFrame:
    """The latest version of a stored log; ordered: by case and position."""
    held = versions(spark, path)
    if not held:
        raise FileNotFoundError(f"no log is stored at {path}")
    log = spark.read.parquet(f"{path}/v={held[-1]}")
    return log.orderBy("case_id", "event_index") if ordered else log


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text (a report, a model) as one file, in any store that Spark reaches."""
    fs, at = _files(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, None where there is none."""
    fs, at = _files(spark, path)
    return "\n".join(r.value for r in spark.read.text(path).collect()) if fs.exists(at) else None
