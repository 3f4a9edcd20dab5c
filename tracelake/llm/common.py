"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII letters only; other alphabets keep their case, as the contracts ask.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

BATCH_ROWS = 512  # of whole texts

#: Words between ASCII white space, and runs of ASCII letters, digits and any non-ASCII character.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where a session on one machine names none (tests) a local folder is set; on a cluster that is an error, since
    what one executor writes to its own disk is lost to the others.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(found)
        return found
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tracelake-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder, without their lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def small_batches(df: DataFrame) -> DataFrame:
    """df, its session set to hand rows to Python workers in batches of BATCH_ROWS at most, since each batch holds whole
    texts, in the JVM's memory beside the heap and in the worker's. A session with smaller batches keeps them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= BATCH_ROWS:
        df.sparkSession.conf.set(name, str(BATCH_ROWS))
    return df


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased. Where a text has one byte a character, lower does just that, and quicker."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is worked out once although `use` names it many times, lambdas included."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unused(name: str, df: DataFrame) -> str:
    """A column name that df has not got, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def any_case(pattern: str) -> str:
    """A word pattern that takes A-Z as well, for texts that are not lower-cased."""
    return pattern.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")


def alnum_words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; null gives no words."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), ALNUM_BREAK), "")


def row_key(*columns: Column) -> list[Column]:
    """Two hashes that name a row by its content; equal rows share them, and so their results."""
    return [F.xxhash64(*columns).alias("__k1"), F.xxhash64(F.lit(1), *columns).alias("__k2")]


SALTS = 64


def salted(df: DataFrame) -> DataFrame:
    """df with a column salt that spreads rows evenly, whatever they hold. Write the rows down (cut) before lookup reads
    them: a number by place is only the same again where the rows are."""
    return df.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))


def lookup(rows: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    """rows (with salt) and the columns of found, which has one row a key; nulls where there is none.

    A key that holds a third of all rows would meet in one task. So each key is first given to the salts that occur with
    it, SALTS at most, and rows join on key and salt.
    """
    spread = rows.select(*on, "salt").distinct().join(found, on)
    return rows.join(spread, [*on, "salt"], "left").drop("salt")


def bounded_sample(labelled: DataFrame, key: str, bound: int) -> DataFrame:
    """About `bound` labelled rows at most, the same ones on every run: those whose hash falls under a share.

    Only for fitting: the share is counted first, so that the sample's size does not grow with the table.
    """
    n, parts = labelled.count(), 1_000_000
    if n <= bound:
        return labelled
    return labelled.where(F.pmod(F.xxhash64(F.lit(7), F.col(key)), F.lit(parts)) < parts * bound // n)
