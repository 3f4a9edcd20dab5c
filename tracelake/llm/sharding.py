"""Sharding over fixed virtual slots, with DataFrame functions.

Every record is hashed into one of a few thousand virtual slots for good. A versioned map says which shard holds which
virtual slot; it is the only thing that is edited when shards are added or loads shift. The first map is made from the
bytes per virtual slot (law `bytes`): the heaviest slots first, each to the lightest shard. Slots number in thousands
whatever the input's size, so the map is edited on the driver and broadcast.

Versions of the map are stored as Parquet folders with the bytes per slot that they were made for, under a name that
the caller gives. A run reads the latest one and keeps it while loads and shards are the same; otherwise it stores the
next version, which moves only the slots that the edit names.

Hash input is the key with the text's hash, so that one key with very many rows still spreads over slots. Rows equal in
both have one slot for good, so only such rows can make a shard much larger than others. The places of records within a
shard are counted by part of a virtual slot and then offset by the parts before; rows are dealt to parts by their place
in the input and written, so no task orders a shard, and equal rows by the million are many tasks' work.

Cases: a text of any length counts by its bytes, so one larger than the mean shard makes its shard the largest; equal
loads go to the shard with the lower number; a null text has size 1 and the checksum of the empty text; null keys are hashed like any value; equal rows may
swap their places, which changes nothing; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import cut, shared_dir

VIRTUAL_SLOTS = 4096
SHARDS = 8
PARTS = 32  # order parts of a virtual slot
RUNS_AT_ONCE = 20


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", virtual_slots: int = VIRTUAL_SLOTS) -> DataFrame:
    """Per row: key, size, text_crc32, __hash, __virtual."""
    bytes_of = F.coalesce(F.col(text), F.lit(""))
    named = F.xxhash64(F.col(key), F.xxhash64(F.col(text)))
    return docs.select(F.col(key), (F.octet_length(bytes_of) + 1).cast("bigint").alias("size"), F.crc32(bytes_of).alias("text_crc32"), named.alias("__hash"), F.pmod(named, F.lit(virtual_slots)).cast("int").alias("__virtual"))


def slot_loads(rows: DataFrame) -> dict[int, int]:
    """Bytes per virtual slot; at most as many as there are slots."""
    return {r["__virtual"]: r["bytes"] for r in rows.groupBy("__virtual").agg(F.sum("size").alias("bytes")).collect()}


def first_map(loads: dict[int, int], shards: int = SHARDS, virtual_slots: int = VIRTUAL_SLOTS) -> dict:
    """Version 1 of the map."""
    heap = [(0, s) for s in range(shards)]
    to = {}
    for slot in sorted(range(virtual_slots), key=lambda v: (-loads.get(v, 0), v)):
        load, shard = heapq.heappop(heap)
        to[slot] = shard
        heapq.heappush(heap, (load + loads.get(slot, 0), shard))
    return {"version": 1, "shards": shards, "slots": to}


def rebalanced(held: dict, loads: dict[int, int], shards: int) -> dict:
    """The next version for other shards or loads: slots of shards that go, then of the heaviest shard, move to the lightest while that evens them out."""
    to = dict(held["slots"])
    total = {s: 0 for s in range(shards)}
    of = {s: [] for s in range(shards)}
    for slot, shard in to.items():
        if shard < shards:
            total[shard] += loads.get(slot, 0)
            of[shard].append(slot)
    for slot in sorted((v for v, s in to.items() if s >= shards), key=lambda v: (-loads.get(v, 0), v)):
        to[slot] = min(total, key=lambda s: (total[s], s))
        total[to[slot]] += loads.get(slot, 0)
        of[to[slot]].append(slot)
    for s in of:
        of[s].sort(key=lambda v: (loads.get(v, 0), -v))
    for _ in range(len(to)):
        low, high = min(total, key=lambda s: (total[s], s)), max(total, key=lambda s: (total[s], -s))
        gap = total[high] - total[low]
        movable = [v for v in of[high] if 0 < loads.get(v, 0) < gap]
        if not movable:
            break
        slot = min(movable, key=lambda v: abs(gap / 2 - loads.get(v, 0)))
        of[high].remove(slot)
        of[low].append(slot)
        to[slot] = low
        total[high] -= loads.get(slot, 0)
        total[low] += loads.get(slot, 0)
    return {"version": held["version"] + 1, "shards": shards, "slots": to}


def map_table(spark, held: dict, loads: dict[int, int]) -> DataFrame:
    """The map as a table to store: version, shards, virtual_slot, shard, bytes."""
    rows = [(held["version"], held["shards"], v, s, loads.get(v, 0)) for v, s in sorted(held["slots"].items())]
    return spark.createDataFrame(rows, "version int, shards int, virtual_slot int, shard int, bytes bigint")


def _files(spark, at: str):
    """Hadoop's file system of a path, and the path: any store that Spark reaches."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def stored_versions(spark, at: str) -> list[int]:
    """Versions of the map under `at` that were written whole."""
    files, path = _files(spark, at)
    if not files.exists(path):
        return []
    names = [(f.getPath().getName(), f.getPath()) for f in files.listStatus(path)]
    done = [n for n, p in names if n.startswith("v=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n[2:]) for n in done)


def load_map(spark, at: str) -> tuple[dict, dict[int, int]] | None:
    """The latest version stored under `at` and the bytes per slot that it was made for."""
    versions = stored_versions(spark, at)
    if not versions:
        return None
    rows = spark.read.parquet(f"{at}/v={versions[-1]}").select("version", "shards", "virtual_slot", "shard", "bytes").collect()
    return {"version": rows[0].version, "shards": rows[0].shards, "slots": {r.virtual_slot: r.shard for r in rows}}, {r.virtual_slot: r.bytes for r in rows if r.bytes}


def store_map(spark, held: dict, loads: dict[int, int], at: str) -> bool:
    """Store a version under a name that no other run has given: written aside, then named by one rename. False if
    another run was first, whose version is then the stored one."""
    aside, name = f"_new_{uuid.uuid4().hex}", f"v={held['version']}"
    map_table(spark, held, loads).coalesce(1).write.parquet(f"{at}/{aside}")
    (files, new), (_, to) = _files(spark, f"{at}/{aside}"), _files(spark, f"{at}/{name}")
    if not files.exists(to):
        files.rename(new, to)
        if not files.exists(spark._jvm.org.apache.hadoop.fs.Path(to, aside)):
            return not files.exists(new)
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(to, aside), True)  # moved into a folder that came in between
    files.delete(new, True)
    return False


def current_map(spark, loads: dict[int, int], shards: int, at: str, virtual_slots: int = VIRTUAL_SLOTS) -> dict:
    """The map to place rows by: the stored one, or its next version where loads or shards have changed, which is stored.
    Of two runs at once one names a version; the other goes on from what it finds then."""
    for _ in range(RUNS_AT_ONCE):
        found = load_map(spark, at)
        if found is None:
            held = first_map(loads, shards, virtual_slots)
        elif len(found[0]["slots"]) != virtual_slots:
            raise ValueError(f"the map under {at} has {len(found[0]['slots'])} virtual slots, not {virtual_slots}: records are hashed for good")
        elif found[0]["shards"] == shards and found[1] == {v: b for v, b in loads.items() if b}:
            return found[0]
        else:
            held = rebalanced(found[0], loads, shards)
        if store_map(spark, held, loads, at):
            return held
    raise OSError(f"{RUNS_AT_ONCE} other runs have changed the map under {at} meanwhile")


def placed(rows: DataFrame, held: dict) -> DataFrame:
    """rows with shard and slot, the place within the shard, gapless from 0."""
    slots = [held["slots"][v] for v in range(len(held["slots"]))]
    shard = F.get(F.split(F.lit(",".join(map(str, slots))), ",").cast("array<int>"), F.col("__virtual"))
    parted = cut(rows.withColumn("shard", shard).withColumn("__part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int")))
    counts = parted.groupBy("shard", "__virtual", "__part").agg(F.count("*").alias("__n"))  # slots x PARTS rows at most
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("shard").orderBy("__virtual", "__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
    offsets = counts.select("__virtual", "__part", before.alias("__before"))
    within = F.row_number().over(Window.partitionBy("__virtual", "__part").orderBy("__hash", "size", "text_crc32"))
    return parted.withColumn("__in", within).join(F.broadcast(offsets), ["__virtual", "__part"]).withColumn("slot", (F.col("__before") + F.col("__in") - 1).cast("bigint"))


def report(docs: DataFrame, shards: int = SHARDS, at: str | None = None) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version.

    at: the folder of the stored map of this table; without one the map is stored in a new folder, as version 1.
    """
    rows, spark = measured(docs.select("doc_id", "text")), docs.sparkSession
    held = current_map(spark, slot_loads(rows), shards, at or f"{shared_dir(spark)}/shard-map-{uuid.uuid4().hex}")
    return placed(rows, held).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        F.col("__virtual").alias("virtual_slot"), F.lit(held["version"]).alias("map_version"),
    )
