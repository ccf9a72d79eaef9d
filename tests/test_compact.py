"""Small-file consolidation: dirty listings, verification and real folders."""

import os

import pytest

from viewmill.operators import compact
from viewmill.session import scratch_path

SCHEMA = "file_id long, output_root string, view_cache_dir string, file_name string, payload string, record_key string"


def listing(spark, rows):
    return spark.createDataFrame([(i, "r", d, n, p, "clash") for i, d, n, p in rows], SCHEMA)


def test_copies_and_look_alikes(spark):
    df = listing(
        spark,
        [
            (1, "a/b/u", "view_003.pcd", "0.5 0 1\n-0.0 1 2\n"),
            (2, "A\\B\\x\\..\\U\\", ".VIEW_3.pcd.tmp", "# c\r\n0 1.0 2\r\n+.50\t0\t1e0\r\n0 1 2"),
            (3, "./a//b/./u", "view_003 (1).pcd", "0.5 0 1\n0 1 2\n7 8"),
            (4, "a/b/u", "view_004.pcd", "0.5 0 1\n0 1 2\n"),
            (5, "a/b/u2", "view_003.pcd", "0.5 0 1\n0 1 2\n"),
            (6, "a/b/u", "view_003.pcd", ""),
            (7, "a/b/u", "view_003.pcd", ""),
            (8, "a/b/u", "view_003.pcd", None),
            (9, None, "view_003.pcd", "0.5 0 1"),
            (10, None, "view_003.pcd", "0.5 0 1"),
            (11, "a/b/u", None, "0.5 0 1"),
            (1, "a/b/u", "view_003.pcd", "0.5 0 1\n-0.0 1 2\n"),
        ],
    )
    out = compact.consolidate_view_cache(df)
    pairs = {tuple(r) for r in compact.copy_pairs(out["members"]).collect()}
    assert pairs == {(1, 2), (1, 3), (2, 3)}
    assert out["members"].count() == 11 and out["records"].count() == 9


def test_empty(spark):
    out = compact.consolidate_view_cache(listing(spark, []))
    assert out["records"].count() == 0 and compact.copy_pairs(out["members"]).count() == 0


def test_few_files_and_no_loss(spark):
    path = scratch_path(spark, "few")
    df = spark.range(20000).repartition(64)
    compact.consolidate(df, path)
    assert len([f for f in os.listdir(path) if f.endswith(".parquet")]) == 1
    assert spark.read.parquet(path).agg({"id": "sum"}).first()[0] == sum(range(20000))


def test_a_target_that_exists_is_refused(spark):
    path = scratch_path(spark, "twice")
    compact.consolidate(spark.range(10), path)
    with pytest.raises(FileExistsError):
        compact.consolidate(spark.range(40), path)
    assert spark.read.parquet(path).count() == 10 and not [d for d in os.listdir(os.path.dirname(path)) if "twice" in d and "staging" in d]


def test_target_size_stays_out_of_the_session(spark):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before, path = spark.conf.get(key), scratch_path(spark, "sized")
    compact.consolidate(spark.range(400_000).selectExpr("uuid() as u", "id"), path, 2 << 20)
    assert spark.conf.get(key) == before and spark.read.parquet(path).count() == 400_000
    sizes = [os.path.getsize(os.path.join(path, f)) for f in os.listdir(path) if f.endswith(".parquet")]
    assert len(sizes) > 2 and max(sizes) < 3 * (sum(sizes) / len(sizes))


def test_unidentified_files_without_id_stay_apart(spark):
    out = compact.consolidate_view_cache(listing(spark, [(None, "a", "view_1", ""), (None, "a", "view_2", ""), (None, "a", "view_2", "")]))
    assert out["members"].count() == out["records"].count() == 2


def test_hot_record_is_salted(spark):
    rows = [(i, "a", "view_1", "1 2 3") for i in range(40)] + [(i, "b", "view_1", "1 2 3") for i in (50, 51)]
    members = compact.cache_members(listing(spark, rows))
    got = [tuple(r) for r in compact.copy_pairs(members, hot=7).collect()]
    assert sorted(got) == sorted([(a, b) for a in range(40) for b in range(a + 1, 40)] + [(50, 51)])


def test_nothing_committed_when_rows_differ(spark, monkeypatch):
    path = scratch_path(spark, "bad")
    real, calls = compact.multiset_checksum, []

    def tampered(columns):
        calls.append(1)
        aggregates = real(columns)
        return aggregates if len(calls) == 1 else [(aggregates[0] + 1).alias("n"), *aggregates[1:]]

    monkeypatch.setattr(compact, "multiset_checksum", tampered)
    with pytest.raises(RuntimeError):
        compact.consolidate(spark.range(10), path)
    assert not os.path.exists(path)
