"""The stored slot map: read again, edited for more rows or shards, never made anew."""

from collections import Counter

from tracelake.llm import sharding


def slots(rows):
    return {r.virtual_slot: r.shard for r in rows}


def moved(spark, at, version):
    old, new = (slots(spark.read.parquet(f"{at}/v={v}").collect()) for v in (version - 1, version))
    return {v for v in old if old[v] != new[v]}


def test_stored_map(spark, small_docs, tmp_path):
    at = str(tmp_path / "map")
    first = sharding.report(small_docs, at=at).collect()
    assert {r.map_version for r in first} == {1} and sharding.stored_versions(spark, at) == [1]
    again = sharding.report(small_docs, at=at).collect()
    assert sorted(again) == sorted(first) and sharding.stored_versions(spark, at) == [1]
    more = small_docs.unionByName(small_docs.where("doc_id % 3 = 0").selectExpr("doc_id + 100000 as doc_id", *small_docs.columns[1:]))
    grown = sharding.report(more, at=at).collect()
    assert {r.map_version for r in grown} == {2}
    edit, was, now = moved(spark, at, 2), slots(first), slots(grown)
    assert {v for v in was if was[v] != now[v]} <= edit and len(edit) < len(was) / 2
    ninth = sharding.report(more, shards=9, at=at).collect()
    assert {r.map_version for r in ninth} == {3} and {r.shard for r in ninth} == set(range(9))
    edit = moved(spark, at, 3)
    assert {v for v in now if now[v] != slots(ninth)[v]} <= edit and len(edit) < len(now) / 2
    fewer = sharding.report(more, shards=4, at=at).collect()
    load = Counter()
    for r in fewer:
        load[r.shard] += r["size"]
    assert {r.map_version for r in fewer} == {4} and set(load) == set(range(4))
