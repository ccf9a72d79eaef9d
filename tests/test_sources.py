"""Readers and writers on small dirty files."""

import json

import pytest
from pyspark.sql import functions as F

from viewmill.operators.compact import consolidate_view_cache, copy_pairs
from viewmill.sources import readers, sinks


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()] if order else [tuple(r) for r in df.collect()]


def test_jsonl_skips_or_keeps_bad_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"uid": "u1", "n": 1}\n\n{bad\n{"uid": "u2"}\n')
    assert rows(readers.jsonl(spark, str(tmp_path / "*.jsonl"), "uid string, n int"), "uid") == [("u1", 1), ("u2", None)]
    kept = readers.jsonl(spark, str(tmp_path), "uid string, n int", keep_bad=True).cache()
    assert kept.where("_corrupt_record is not null").count() == 1 and kept.count() == 3
    with pytest.raises(Exception):
        readers.jsonl(spark, str(tmp_path / "none*.jsonl"), "uid string").count()


def test_polymorphic_containers(spark, tmp_path):
    (tmp_path / "map.json").write_text('{"k1": {"v": 1}, "k2": {"uid": "own", "v": 2}}')
    (tmp_path / "list.json").write_text('[{"uid": "x", "v": 3}]')
    assert rows(readers.keyed_records(spark, str(tmp_path / "map.json"), "uid:string,v:int"), "v") == [("k1", 1), ("own", 2)]
    assert rows(readers.keyed_records(spark, str(tmp_path / "list.json"), "uid:string,v:int")) == [("x", 3)]
    shapes = [["a", "b", "a"], [{"uid": "a"}, {"UID": "b"}], {"uids": ["a", "b"]}, {"success_uids": [{"uid": "a"}, "b"]}]
    for i, shape in enumerate(shapes):
        path = tmp_path / f"u{i}.json"
        path.write_text(json.dumps(shape))
        assert sorted(r.uid for r in readers.uid_list(spark, str(path)).collect()) == ["a", "b"]


def test_key_values_and_curves(spark, tmp_path):
    (tmp_path / "u1.txt").write_text("A_fit: 0.5\nfit_type: log: normal\n\ncurve_raw:\n4: 1.5\n8: 2.5\n\n9: 7\ncurve_other:\n1: 1\n")
    (tmp_path / "u2.txt").write_text("fit_type: x\r\ncurve_raw:\r\nbroken\r\n3: 4\r\n")
    got = readers.key_value_texts(spark, str(tmp_path), ["A_fit", "fit_type"])
    assert rows(got, "stem") == [("u1", "0.5", "log: normal"), ("u2", None, "x")]
    assert rows(readers.key_value_texts(spark, str(tmp_path), ["A_fit", "fit_type"], ["A_fit"]).select("stem")) == [("u1",)]
    assert [(r.stem, r.missing) for r in readers.missing_keys(spark, str(tmp_path), ["A_fit", "fit_type"]).collect()] == [("u2", ["A_fit"])]
    with pytest.raises(Exception, match="no A_fit in"):
        readers.key_value_texts(spark, str(tmp_path), ["A_fit"], ["A_fit"], strict=True).collect()
    assert rows(readers.curve_blocks(spark, str(tmp_path), "curve_raw"), "stem", "n") == [("u1", 4, 1.5), ("u1", 8, 2.5)]


def test_view_sets_points_and_objects(spark, tmp_path):
    (tmp_path / "v.txt").write_text("3 0 4\n\n0  1\t0\n")
    assert rows(readers.view_set(spark, str(tmp_path / "v.txt"), 10.0, normalise=True), "view_id") == [("v", 0, 6.0, 0.0, 8.0), ("v", 1, 0.0, 10.0, 0.0)]
    (tmp_path / "bad.txt").write_text("1 2\n")
    with pytest.raises(Exception, match="not three numbers"):
        readers.view_set(spark, str(tmp_path / "bad.txt")).collect()
    (tmp_path / "p.pcd").write_text("# head\n1 2 3\n4 5\n-1e0,2,.5\n")
    assert rows(readers.point_texts(spark, str(tmp_path / "p.pcd")), "x") == [("p", -1.0, 2.0, 0.5), ("p", 1.0, 2.0, 3.0)]
    (tmp_path / "o.obj").write_text("v 0 0 0\nv 1 0 0\nvt 0 0\nf 1 2 2\n# f\n")
    assert rows(readers.obj_counts(spark, str(tmp_path / "o.obj"))) == [("o", 2, 1, True, False)]


def test_folder_of_tiny_files_is_consolidated(spark, tmp_path):
    for run, view, text in (("a/u1", 1, "1 2 3\n"), ("a/u1", 2, "1 2 3\n"), ("b/u1", 1, "1 2 3\n")):
        folder = tmp_path / run
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"view_{view:03}.pcd").write_text(text)
    (tmp_path / "a/u1/view_001 (1).pcd").write_text("1.0 2 3")
    out = consolidate_view_cache(readers.small_text_files(spark, str(tmp_path)))
    assert out["records"].count() == 3 and out["members"].count() == 4 and copy_pairs(out["members"]).count() == 1


def test_sinks(spark, tmp_path):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(3, "q")], "x int, z string")
    sinks.write_csv_union([a, b], str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["x", "y", "z"]
    assert sinks.write_once(a, str(tmp_path / "w")) and not sinks.write_once(b, str(tmp_path / "w"))
    path = str(tmp_path / "m")
    assert sinks.append_missing(a.union(a), path, ["x"]).count() == 1
    assert sinks.append_missing(spark.createDataFrame([(1, 9), (5, 6)], "x int, y int"), path, ["x"]).count() == 1
    assert rows(spark.read.parquet(path), "x") == [(1, 2), (5, 6)]
    jobs = spark.createDataFrame([("a",), ("b",), ("c",)], "job_id string")
    ended = spark.createDataFrame([("a", "algorithm"), ("b", "exception")], "job_id string, terminal_source string")
    assert sorted(r.job_id for r in sinks.job_status(jobs, ended).collect()) == ["b", "c"]
    sinks.write_jsonl(a, str(tmp_path / "j"))
    assert readers.json_document(spark, str(tmp_path / "j"), "x int, y int").count() == 1
    files = readers.checksums(spark, str(tmp_path / "c"))
    assert files.where(F.length("sha256") == 64).count() == files.count() > 0


def test_equal_stems_of_two_folders_stay_apart(spark, tmp_path):
    for folder, value in (("a", "1"), ("b", "2")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "u.txt").write_text(f"k: {value}\nc:\n{value}: 5\n")
    assert rows(readers.key_value_texts(spark, str(tmp_path / "*"), ["k"]), "k") == [("u", "1"), ("u", "2")]
    assert rows(readers.curve_blocks(spark, str(tmp_path / "*"), "c"), "n") == [("u", 1, 5.0), ("u", 2, 5.0)]


def test_changed_files(spark):
    kind = "path string, length long, modificationTime timestamp"
    at = [__import__("datetime").datetime(2030, 1, d) for d in (1, 2)]
    source = spark.createDataFrame([("a", 1, at[0]), ("b", 2, at[0]), ("c", 3, at[1])], kind)
    target = spark.createDataFrame([("a", 1, at[0]), ("b", 9, at[0]), ("c", 3, at[0])], kind)
    assert rows(readers.changed_files(source, target).select("path"), "path") == [("b",), ("c",)]
