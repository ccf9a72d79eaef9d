"""Nested records against a plain recursive reader, and the defined dirty cases."""

import json
import re

from viewmill.operators.nested import list_occurrences, shred
from viewmill.session import table


def plain_reader(record_id, text):
    """Brute force: walk one parsed record."""

    def load(v):
        if isinstance(v, str):
            try:
                return json.loads(v)
            except ValueError:
                return v
        return v

    def level(v):
        v = load(v)
        if isinstance(v, list):
            return v
        if isinstance(v, dict) and v:
            if all(k.isdigit() for k in v):
                return [v[k] for k in sorted(v, key=int)]
            return [v]
        return []

    try:
        v = json.loads((text or "").removeprefix("﻿"))
    except ValueError:
        return
    v = load(load(v))
    if isinstance(v, dict) and "rollouts" not in v:
        v = next((x for x in map(load, v.values()) if isinstance(x, dict) and "rollouts" in x), v)
    if not isinstance(v, dict):
        return
    for i, r in enumerate(level(v.get("rollouts"))):
        for j, s in enumerate(level(r.get("steps")) if isinstance(r, dict) else []):
            if isinstance(s, dict):
                seen = s.get("visited_view_ids")
                seen = seen if seen is not None else s.get("visitedViewIds")
                plain = isinstance(seen, str) and not isinstance(load(seen), list)
                for k, e in enumerate(re.split("[,; ]", seen) if plain else level(seen)):
                    if e not in (None, ""):
                        yield record_id, i, j, k, int(float(e))


def rows(df):
    return sorted((r[0], r[1], r[2], r[3], int(r[4])) for r in df.where("elem is not null").collect())


def test_equals_plain_reader(spark):
    raw = table(spark, "/root/testdata/sf0.01", "rollouts_raw")
    expected = sorted(x for r in raw.collect() for x in plain_reader(r.record_id, r.raw_json))
    assert rows(list_occurrences(shred(raw))) == expected and expected


def test_dirty_cases(spark):
    step = {"step_id": 0, "visited_view_ids": [3, None, "4", 5.0, ""]}
    doc = {"uid": "u", "rollouts": [{"start_view_id": 3, "steps": [step]}]}
    cases = [
        (1, json.dumps(doc)),
        (2, json.dumps(json.dumps(doc))),
        (3, json.dumps({"data": doc, "schema": 2})),
        (4, "﻿" + json.dumps(doc)),
        (5, json.dumps(doc)[:-3]),
        (6, json.dumps(doc) + " {}"),
        (7, None),
        (8, ""),
        (9, json.dumps({"rollouts": {"10": None, "9": {"steps": {"2": {"visitedViewIds": "[7]"}, "1": None}}}})),
        (10, json.dumps({"rollouts": {"steps": {"step_id": 1, "visited_view_ids": []}}})),
        (11, '{"rollouts": [{"steps": [{"covered_ratio": NaN, "visited_view_ids": [1, 2]}]}]}'),
        (12, '{"rollouts": [{"steps": [{"visited_view_ids": "4,,6"}]}]}'),
        (1, json.dumps(doc)),
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in cases], "record_id long, raw_json string, root_id string")
    tables = shred(df)
    whole = [(0, 0, 0, 3), (0, 0, 2, 4), (0, 0, 3, 5)]
    expected = [(i, *x) for i in (1, 2, 3, 4) for x in whole] + [(9, 0, 1, 0, 7), (11, 0, 0, 0, 1), (11, 0, 0, 1, 2), (12, 0, 0, 0, 4), (12, 0, 0, 2, 6)]
    assert rows(list_occurrences(tables)) == sorted(expected)
    roots = {r.record_id: r.root_id for r in tables["occurrences"].collect()}
    assert roots[1] == roots[2] == roots[3] == roots[4] and roots[1] != roots[9]
    assert tables["objects"].where("kind = 'step'").count() == tables["objects"].where("kind = 'step'").select("object_id").distinct().count()


def test_empty(spark):
    df = spark.createDataFrame([], "record_id long, raw_json string")
    assert list_occurrences(shred(df)).count() == 0


def rebuilt(tables, record_id):
    """The record from its tables: fields under their canonical names, scalars as text."""
    objects = {bytes(r.object_id): r.attrs for r in tables["objects"].collect()}
    lists, links = {}, {}
    for r in tables["lists"].collect():
        lists.setdefault(bytes(r.list_id), {})[r.elem_pos] = r.elem
    for r in tables["bridge"].collect():
        links.setdefault(bytes(r.parent_id), []).append((r.field, r.ordinal, bytes(r.child_id)))

    def node(i):
        if i in lists:
            return [lists[i][k] for k in sorted(lists[i])]
        out = dict(objects.get(i, {}))
        for field, ordinal, child in sorted(links.get(i, [])):
            out.setdefault(field, []).append((ordinal, node(child)))
        return out

    roots = {r.record_id: bytes(r.root_id) for r in tables["occurrences"].collect()}
    return node(roots[record_id])


def test_any_depth_keeps_its_links(spark):
    deep = {"a": {"bC": [{"d": [1, 2.0, "x"]}, None, {"d": [[1], [2, {"e": True}]]}], "f": {"g": {"h": None, "i": "3.50"}}}, "tags": [{"k": 1}, 7]}
    same = json.dumps({"tags": [{"k": "1.0"}, "7"], "a": {"f": {"g": {"i": 3.5}}, "b_c": [{"d": ["1", 2, " x"]}, None, {"d": {"0": [1.0], "1": [2, {"e": True}]}}]}})
    df = spark.createDataFrame([(1, json.dumps(deep)), (2, same), (3, same.replace("3.5", "3.6"))], "record_id long, raw_json string")
    tables = {k: v.cache() for k, v in shred(df).items()}
    got = rebuilt(tables, 1)
    assert got == rebuilt(tables, 2) != rebuilt(tables, 3)
    assert got["tags"] == [(-1, [None, "7"]), (0, {"k": "1"})] and got["a"][0][1]["f"] == [(0, {"g": [(0, {"i": "3.5"})]})]
    first, third = got["a"][0][1]["b_c"]
    assert first == (0, {"d": [(0, ["1", "2", "x"])]}) and third[0] == 2
    assert third[1]["d"] == [(0, {"d": [(0, ["1"])]}), (1, {"d": [(-1, ["2", None]), (1, {"e": "true"})]})]
    roots = {r.record_id: bytes(r.root_id) for r in tables["occurrences"].collect()}
    assert roots[1] == roots[2] != roots[3]
    assert tables["objects"].where("kind = 'g'").count() == 2  # of three occurrences two are the same


def test_shared_subtrees_are_salted(spark):
    text = json.dumps({"rollouts": [{"steps": [{"visited_view_ids": [1, 2]}] * 3}]})
    df = spark.createDataFrame([(i, text) for i in range(50)], "record_id long, raw_json string")
    tables = shred(df)
    assert tables["objects"].count() == 3 and tables["lists"].count() == 2
    want = [(i, 0, s, k, k + 1) for i in range(50) for s in range(3) for k in range(2)]
    assert rows(list_occurrences(tables, hot=20)) == want == rows(list_occurrences(tables))


def test_sessions_keep_their_settings(spark):
    key = "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(key, None)
    shred(spark.createDataFrame([(1, "{}")], "record_id long, raw_json string"))
    assert spark.conf.get(key, None) == before
