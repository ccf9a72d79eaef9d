"""Deeply nested JSON records into flat tables that keep parent and child together (problem 6).

Every record becomes a tree of objects and lists of any depth. Field names are brought to snake case, scalars
to one spelling, and each object and list gets the hash of its own scalars and of its children's hashes in
order (bottom up). Equal subtrees therefore get equal ids wherever and however they were written, are stored
once, and every occurrence stays as bridge rows parent, field, ordinal, child.

Tables (``shred``); ids are 16 bytes
* ``occurrences``  record_id, root_id
* ``objects``      object_id, kind (``file`` for the root, else its field's name without a final s), attrs map<string,string>
* ``bridge``       parent_id, field, ordinal, child_id; the child is an object or a list
* ``lists``        list_id, elem_pos, elem: the scalars of a list (null elements keep their position)

A list of objects has no row of its own: its objects hang on the parent by their position, null elements
leave a gap. Scalars between objects form a list with gaps, at ordinal -1. A list of scalars hangs at
ordinal 0; lists in a list hang on the same field by their position.

A task parses a record, hashes it bottom up and gives each different subtree of a batch once; the nodes are
written once to the shared folder, and Spark removes what several batches share, by hash.

Defined results
* text that isn't one complete JSON object (null, empty, cut off, followed by more) gives no rows; a
  byte order mark and NaN or Infinity literals are tolerated, the latter as null;
* text encoded twice, a record inside one outer field, a level written as an object with numeric keys
  (order of the numbers), a single object in place of a level's list and a list written as a string are read
  as what they stand for; null, missing and empty levels have no children;
* of a key that stands twice the last counts, of two spellings of a name the first that isn't null;
* repeated rows of one record_id with equal text are one;
* redelivered records share one root_id and keep one occurrence each;
* JSON that nests deeper than the parser's recursion limit counts as unreadable.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewmill.operators.salted import salted_join
from viewmill.session import scratch_path, spread

#: Fields whose value is a list even where it is written as one object, and those whose plain text is a list.
LEVELS = ("rollouts", "steps")
LIST_FIELDS = ("visited_view_ids", "candidate_view_ids", "candidate_marginal_gains", "residual_set_cover_view_ids")

CAPITAL = re.compile(r"(?<=[a-z0-9])([A-Z])")
INTEGER = re.compile(r"[-+]?[0-9]{1,15}\Z")
NUMBER = re.compile(r"[-+.0-9eE]+\Z")
BRACKETS = re.compile(r"\A[\[(]\s*|\s*[\])]\Z")
SEPARATOR = re.compile(r"[,;|]")

OCCURRENCE, OBJECT, LIST = 0, 1, 2
NODES = (
    "kind_of_row byte, record_id long, id binary, kind string, attrs map<string,string>, "
    "links array<struct<field: string, ordinal: int, child: binary>>, elems array<string>"
)
ARROW_NODES = pa.schema(
    [
        ("kind_of_row", pa.int8()), ("record_id", pa.int64()), ("id", pa.binary()), ("kind", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())),
        ("links", pa.list_(pa.struct([("field", pa.string()), ("ordinal", pa.int32()), ("child", pa.binary())]))), ("elems", pa.list_(pa.string())),
    ]
)


def whole_json(text: str) -> Any:
    """The value of a text that is exactly one JSON value; else None."""
    try:
        return json.loads(text.removeprefix("﻿"), parse_constant=lambda _: None)
    except (ValueError, RecursionError):
        return None


def decoded(value: Any) -> Any:
    """A JSON object or list inside a string becomes its value; anything else stays."""
    if isinstance(value, str) and value.lstrip()[:1] in ("{", "[", '"'):
        inside = whole_json(value)
        return value if inside is None else inside
    return value


@lru_cache(maxsize=100_000)
def snake(name: str) -> str:
    return CAPITAL.sub(r"_\1", name).lower()


def fields_of(value: dict[str, Any]) -> dict[str, Any]:
    """The fields under snake-case names."""
    if all(snake(name) == name for name in value):
        return value
    out: dict[str, Any] = {}
    for name, v in value.items():
        name = snake(name)
        if out.get(name) is None:
            out[name] = v
    return out


def scalar(value: Any) -> str | None:
    """One spelling: 12, 12.0 and "12" are the same number, "" is nothing."""
    if type(value) is int:
        return str(value)
    if value is None or isinstance(value, bool):
        return None if value is None else str(value).lower()
    if isinstance(value, str):
        value = value.strip()
        if value == "" or value.lower() in ("null", "none"):
            return None
        if INTEGER.match(value):
            return str(int(value))
        if not NUMBER.match(value):
            return value
        try:
            value = float(value)
        except ValueError:
            return value
    if value - value != 0:  # infinite
        return None
    return str(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)


def listed(value: Any) -> list[Any] | None:
    """A list, or an object with numeric keys as the list in the order of the numbers; else None."""
    if isinstance(value, dict) and value and all(k.isascii() and k.isdigit() for k in value):
        return [value[k] for k in sorted(value, key=int)]
    return value if isinstance(value, list) else None


def text_list(value: Any) -> list[Any]:
    """The elements of a list of scalars that is written as text, or as a single scalar."""
    if not isinstance(value, str):
        return [value]
    plain = BRACKETS.sub("", value.strip())
    return (SEPARATOR.split(plain) if SEPARATOR.search(plain) else plain.split()) if plain else []


def digest(*parts: Any) -> bytes:
    return hashlib.blake2b(repr(parts).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def list_digest(spelled: list[str | None]) -> bytes:
    """The id of a list of scalars; a length before each keeps their borders, -1 stands for a null."""
    text = "".join("-1," if e is None else f"{len(e)},{e}" for e in spelled)
    return hashlib.blake2b(b"list" + text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


class Shredder:
    """The different nodes of a batch of records, by id."""

    def __init__(self, levels: tuple[str, ...], lists: tuple[str, ...]) -> None:
        self.levels, self.list_fields = frozenset(levels), frozenset(lists)
        self.objects: dict[bytes, tuple[str, dict[str, str], list[tuple[str, int, bytes]]]] = {}
        self.lists: dict[bytes, list[str | None]] = {}
        self.number_lists: dict[tuple[int, ...], bytes] = {}

    def root(self, text: str, holder: str | None) -> bytes | None:
        """The id of a record; ``holder``: the field that a record has, looked for one field deeper if it is missing."""
        value = whole_json(text)
        for _ in range(2):
            value = decoded(value)
        if not isinstance(value, dict):
            return None
        if holder and not any(k.lower() == holder for k in value):
            inner = (decoded(v) for v in value.values())
            value = next((v for v in inner if isinstance(v, dict) and holder in fields_of(v)), value)
        return self.add_object(value, "file")

    def add_object(self, value: dict[str, Any], kind: str) -> bytes:
        attrs: dict[str, str] = {}
        links: list[tuple[str, int, bytes]] = []
        for name, v in fields_of(value).items():
            if v is None:
                continue
            v = decoded(v)
            elements = listed(v)
            if elements is None and name in self.levels:
                elements = [v] if isinstance(v, dict) and v else []
            elif elements is None and name in self.list_fields and not isinstance(v, dict):
                elements = text_list(v)
            if elements is not None:
                if elements or name not in self.levels:
                    self.add_list(elements, name, links)
            elif isinstance(v, dict):
                links.append((name, 0, self.add_object(v, name.removesuffix("s"))))
            elif (spelled := scalar(v)) is not None:
                attrs[name] = spelled
        links.sort()
        own = digest(kind, sorted(attrs.items()), links)
        self.objects.setdefault(own, (kind, attrs, links))
        return own

    def add_list(self, elements: list[Any], name: str, links: list[tuple[str, int, bytes]]) -> None:
        """Adds what hangs on the parent for a list."""
        if elements and set(map(type, elements)) == {int}:  # the usual case, looked up as it is
            if (own := self.number_lists.get(key := tuple(elements))) is None:
                spelled = list(map(str, elements))
                own = self.number_lists[key] = list_digest(spelled)
                self.lists.setdefault(own, spelled)
            links.append((name, 0, own))
            return
        nested = [(i, e) for i, e in enumerate(elements) if isinstance(e, (dict, list))]
        for i, e in nested:
            if (inner := listed(e)) is None:
                links.append((name, i, self.add_object(e, name.removesuffix("s"))))
            else:
                below: list[tuple[str, int, bytes]] = []
                self.add_list(inner, name, below)
                own = digest("lists", sorted(below))
                self.objects.setdefault(own, ("list", {}, sorted(below)))
                links.append((name, i, own))
        spelled = [None if isinstance(e, (dict, list)) else scalar(e) for e in elements]
        if not nested or any(e is not None for e in spelled):
            own = list_digest(spelled)
            self.lists.setdefault(own, spelled)
            links.append((name, -1 if nested else 0, own))


def lists_of(rows: Iterable[list[Any]], values: pa.Array) -> pa.Array:
    """A column of lists whose elements, one after the other, are ``values``."""
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), values)


def filled(kind: int, n: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """``n`` rows of one kind; the other columns are null."""
    columns = {"kind_of_row": pa.array(np.full(n, kind, np.int8))} | columns
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in ARROW_NODES], schema=ARROW_NODES)


def nodes(records: DataFrame, id_col: str, json_col: str, levels: tuple[str, ...], lists: tuple[str, ...]) -> DataFrame:
    """All nodes, written once, those that several batches have as often; no shuffle but to spread a small scan."""
    holder = levels[0] if levels else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shredder, roots = Shredder(levels, lists), []
            for record, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (root := shredder.root(text, holder)) is not None:
                    roots.append((record, root))
            yield filled(OCCURRENCE, len(roots), {"record_id": pa.array([r[0] for r in roots], pa.int64()), "id": pa.array([r[1] for r in roots], pa.binary())})
            kinds, attrs, links = ([o[i] for o in shredder.objects.values()] for i in range(3))
            flat = [link for own in links for link in own]
            parts = [pa.array([x[i] for x in flat], t) for i, t in enumerate((pa.string(), pa.int32(), pa.binary()))]
            names, texts = (pa.array([x for own in attrs for x in pick(own)], pa.string()) for pick in (dict.keys, dict.values))
            yield filled(
                OBJECT,
                len(kinds),
                {
                    "id": pa.array(list(shredder.objects), pa.binary()),
                    "kind": pa.array(kinds, pa.string()),
                    "attrs": pa.MapArray.from_arrays(pa.array(np.cumsum([0, *map(len, attrs)]), pa.int32()), names, texts),
                    "links": lists_of(links, pa.StructArray.from_arrays(parts, ["field", "ordinal", "child"])),
                },
            )
            elems = list(shredder.lists.values())
            yield filled(LIST, len(elems), {"id": pa.array(list(shredder.lists), pa.binary()), "elems": lists_of(elems, pa.array([e for own in elems for e in own], pa.string()))})

    source = spread(records.select(F.col(id_col).cast("long").alias("r"), F.col(json_col).alias("t")).where("t is not null"))
    path = scratch_path(records.sparkSession, "shred-nodes")
    source.mapInArrow(run, NODES).write.partitionBy("kind_of_row").parquet(path)
    return records.sparkSession.read.schema(NODES).parquet(path)


def shred(
    records: DataFrame, id_col: str = "record_id", json_col: str = "raw_json", levels: tuple[str, ...] = LEVELS, lists: tuple[str, ...] = LIST_FIELDS
) -> dict[str, DataFrame]:
    """The four tables of the module's docstring."""
    all_nodes = nodes(records, id_col, json_col, levels, lists)
    of = lambda kind: all_nodes.where(F.col("kind_of_row") == kind)
    objects = of(OBJECT).where("kind != 'list'").select(F.col("id").alias("object_id"), "kind", "attrs").dropDuplicates(["object_id"])
    links = of(OBJECT).select(F.col("id").alias("parent_id"), F.explode("links").alias("l"))
    elements = of(LIST).select(F.col("id").alias("list_id"), "elems").dropDuplicates(["list_id"])
    return {
        "occurrences": of(OCCURRENCE).select("record_id", F.col("id").alias("root_id")).distinct(),
        "objects": objects,
        "bridge": links.select("parent_id", F.col("l.field").alias("field"), F.col("l.ordinal").alias("ordinal"), F.col("l.child").alias("child_id")).distinct(),
        "lists": elements.select("list_id", F.posexplode("elems").alias("elem_pos", "elem")),
    }


def list_occurrences(tables: dict[str, DataFrame], field: str = "visited_view_ids", hot: int = 1_000_000) -> DataFrame:
    """Every element of ``field`` of every step with its full parent chain, through the bridge.

    A subtree that more than ``hot`` parents share is salted.
    """

    def level(name: str, parent: str, child: str, pos: str) -> DataFrame:
        rows = tables["bridge"].where(F.col("field") == name)
        return rows.select(F.col("parent_id").alias(parent), F.col("ordinal").alias(pos), F.col("child_id").alias(child))

    steps = (
        tables["occurrences"]
        .join(level("rollouts", "root_id", "rollout_id", "rollout_pos"), "root_id")
        .join(level("steps", "rollout_id", "step_id", "step_pos"), "rollout_id")
    )
    chain = salted_join(steps, level(field, "step_id", "list_id", "list_no"), "step_id", hot)
    found = salted_join(chain.select("record_id", "rollout_pos", "step_pos", "list_id"), tables["lists"], "list_id", hot)
    return found.select("record_id", "rollout_pos", "step_pos", "elem_pos", "elem")
