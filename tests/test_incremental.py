import pytest
from pyspark.sql import functions as F

from corvine.operators import incremental, orphans
from corvine.operators.identifiers import allocated

FILES = "id long, file_path string, filename string, size long, modified_at long, content_hash string"


def versions(spark, rows):
    return spark.createDataFrame(rows, "file_path string, modified_at long, content_hash string, file_path2 int")


def test_newest_version_ties_nulls_and_repeats(spark):
    rows = versions(spark, [("a", 1, "X", 0), ("a", 2, "Y", 0), ("a", 2, "Y", 1), ("b", None, "Z", 0), ("b", None, None, 0), ("c", 5, None, 0), ("c", 5, "Q", 0), (None, 9, "W", 0)])
    got = {r.key: (r.version, r.hash) for r in incremental.newest_versions(rows).collect()}
    assert got == {"a": (2, "y"), "b": (None, "z"), "c": (5, "q")}
    assert incremental.newest_versions(rows.limit(0)).count() == 0


def test_changed_by_hash_else_by_time(spark):
    now = spark.createDataFrame([("same", 9, "h"), ("other", 1, "i"), ("nohash", 4, None), ("nohash2", 4, None), ("new", 1, "x"), ("lost", 3, "h")], "key string, version long, hash string")
    was = spark.createDataFrame([("same", 1, "h"), ("other", 1, "h"), ("nohash", 4, "h"), ("nohash2", 5, None), ("gone", 1, "h"), ("lost", 3, None)], "key string, version long, hash string")
    got = {r.key: r.is_new for r in incremental.changed(now, was).collect()}
    assert got == {"other": False, "nohash2": False, "new": True, "lost": False}


def test_log_counts_only_successful_runs(spark):
    log = spark.createDataFrame([(1, "./a", 1, "AA"), (2, "a", 2, "BB"), (3, "a", 3, "CC"), (1, "b", 1, "DD"), (1, "b", 1, "DD"), (9, "z", 1, "EE"), (1, None, 1, "F")], "run_id long, file_path string, modified_at long, content_hash string")
    runs = spark.createDataFrame([(1, "ok"), (2, "ok"), (3, "failed"), (4, "ok")], "run_id long, status string")
    assert {r.key: (r.version, r.hash) for r in incremental.committed_from_log(log, runs).collect()} == {"a": (2, "bb"), "b": (1, "dd")}


def test_state_store_survives_a_failure_before_the_swap(spark, tmp_path, monkeypatch):
    store = incremental.StateStore(spark, f"file://{tmp_path}/state")
    first = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], store.SCHEMA)
    assert store.changes(first).count() == 2
    with monkeypatch.context() as m:
        m.setattr(store, "_swap", lambda pointer: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            store.commit(first)
    assert store.state().count() == 0 and store.changes(first).count() == 2  # nothing skipped
    assert store.commit(first) == 1
    assert store.changes(first).count() == 0  # nothing repeated
    second = spark.createDataFrame([("a", 2, "z"), ("b", 9, "y"), ("c", 1, None)], store.SCHEMA)
    todo = store.changes(second)
    assert sorted(r.key for r in todo.collect()) == ["a", "c"]
    gone = spark.createDataFrame([("b",)], "key string")
    assert store.commit(todo, gone) == 2
    assert sorted(r.key for r in incremental.StateStore(spark, f"file://{tmp_path}/state").state().collect()) == ["a", "c"]


def test_two_runs_cannot_both_commit(spark, tmp_path, monkeypatch):
    one, two = (incremental.StateStore(spark, f"file://{tmp_path}/state") for _ in range(2))
    rows = lambda *keys: spark.createDataFrame([(k, 1, "x") for k in keys], one.SCHEMA)
    assert one.commit(rows("a")) == 1
    stale = two.pointer()
    assert one.commit(rows("b")) == 2
    monkeypatch.setattr(two, "pointer", lambda: stale)  # looked before the other committed, commits after it
    with pytest.raises(RuntimeError):
        two.commit(rows("c"))
    monkeypatch.undo()
    assert sorted(r.key for r in two.state().collect()) == ["a", "b"] and two.commit(rows("c")) == 3
    assert sorted(r.key for r in one.state().collect()) == ["a", "b", "c"]


def test_small_commits_write_little_and_parts_merge_by_tiers(spark, tmp_path, monkeypatch):
    store = incremental.StateStore(spark, f"file://{tmp_path}/state")
    monkeypatch.setattr(store, "FAN", 3)
    size = lambda: sum(f.stat().st_size for f in (tmp_path / "state").rglob("*.parquet"))
    store.commit(spark.range(100_000).selectExpr("concat('k', id) AS key", "id AS version", "sha2(string(id), 256) AS hash"))
    before = size()
    store.commit(spark.createDataFrame([("k1", 7, "new"), ("z", 1, None)], store.SCHEMA), spark.createDataFrame([("k2",)], "key string"))
    assert size() - before < 0.01 * before
    for i in range(4):
        store.commit(spark.createDataFrame([(f"y{i}", i, "h")], store.SCHEMA))
    parts = store.pointer()["parts"]
    assert parts[0][1] == 100_000 and len(parts) <= 4 and size() - before < 0.02 * before
    got = {r.key: (r.version, r.hash) for r in store.state().where("key IN ('k1', 'k2', 'z', 'y3')").collect()}
    assert got == {"k1": (7, "new"), "z": (1, None), "y3": (3, "h")} and store.state().count() == 100_000 - 1 + 1 + 4


def test_tiers():
    from corvine.sources.snapshots import mergeable

    assert mergeable([10**9] + [1] * 7, 8) == 0 and mergeable([10**9] + [1] * 8, 8) == 8 and mergeable([10**9, 64, 1, 64], 2) == 3 and mergeable([], 8) == 0


def test_missing_hashes_are_made_of_the_content(spark):
    rows = spark.createDataFrame([("a", 1, None, "hello world"), ("b", 1, "AB", "x"), ("c", 1, None, None)], "file_path string, modified_at long, content_hash string, body string")
    got = {r.key: r.hash for r in incremental.newest_versions(rows, content="body").collect()}
    assert got == {"a": "b94d27b9934d3e08a52e52d7da7dabfac484efe37a5380ee9088f7ace2efcde9", "b": "ab", "c": None}


@pytest.mark.parametrize("places", [[], [0], [65535], list(range(0, 65536, 3)), list(range(100))])
def test_bitmaps_round_trip(places):
    import numpy as np

    assert np.flatnonzero(orphans.unpack(orphans.pack(np.array(places, dtype=int)))).tolist() == places


def test_dangling_by_brute_force(spark):
    import random

    r = random.Random(5)
    refs = [(f"t{r.randrange(2)}", i, r.choice(["2024-01", "none"]), "p", r.choice([None, 7, r.randrange(-3, 200_000)])) for i in range(2000)]
    parents = [("p", k) for k in range(0, 200_000, 2)] + [("q", k) for k in range(1, 99, 2)]
    rows = spark.createDataFrame(refs + refs[:50], "table_name string, row_id long, period string, parent string, key long")
    there = spark.createDataFrame(parents, "parent string, key long")
    got = sorted((x.table_name, x.row_id, x.period, x.key) for x in orphans.dangling(rows, there).collect())
    assert got == sorted((t, i, p, k) for t, i, p, _, k in refs if k is not None and ("p", k) not in set(parents))
    assert orphans.dangling(rows, there.limit(0)).count() == sum(k is not None for *_, k in refs)
    assert orphans.dangling(rows.limit(0), there).count() == 0


def test_keys_of_other_types_get_codes(spark):
    rows = spark.createDataFrame([("b",), ("a",), (None,), ("a",)], "k string")
    codes = {r.key: r.code for r in orphans.encode_keys(rows, "k").collect()}
    assert set(codes) == {"a", "b"} and len(set(codes.values())) == 2


def test_allocated_ids_are_consecutive(spark):
    rows = spark.createDataFrame([(f"p{i:03}",) for i in range(50)], "path string")
    got, free = allocated(rows, "id", 10, ["path"])
    assert [r.id for r in got.orderBy("path").collect()] == list(range(10, 60)) and free == 60
    none, free = allocated(rows.limit(0), "id", 3, ["path"])
    assert none.count() == 0 and free == 3 and "id" in none.columns


def test_extra_columns_with_clashing_names(spark):
    rows = versions(spark, [("a", 1, "X", 0)]).withColumns({"key": F.lit("other"), "n": F.lit(1), "v": F.lit(2), "h": F.lit("z"), "hash": F.lit("q")})
    assert [tuple(r) for r in incremental.newest_versions(rows).collect()] == [("a", 1, "x")]
