"""Deeply nested records as flat node tables with interval labels.

Every object of the types in CHILDREN becomes a row, as does each document's root. A depth-first traversal numbers it on
entry (pre) and on exit (post); node A contains node B exactly if A.pre < B.pre and B.post < A.post within the same record
and document, so each row leads to its parent and to all its ancestors without a path. linked() reads parents and the
positions of ancestors from these intervals alone.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE_SCHEMA = (
    "record_id string, document string, node string, pre int, post int, parent_pre int, depth int, "
    "position int, job_pos int, role_pos int, project_pos int, attributes string"
)


def read_object(text: str | None) -> dict | None:
    """The object a JSON text holds, or the object within the JSON string it holds; None for all else."""
    for _ in range(2):
        if not isinstance(text, str):
            return None
        try:
            value = json.loads(text)
        except (ValueError, RecursionError):
            return None
        if isinstance(value, dict):
            return value
        text = value
    return None


def profile_of(record: dict) -> dict:
    """The object ``profile``, or the whole record where it holds none."""
    inner = record.get("profile")
    return inner if isinstance(inner, dict) else record


def _objects(value: object) -> list[tuple[int, dict]]:
    """(position, object) of an array; an object alone is an array of one; other elements keep their place."""
    items = value if isinstance(value, list) else [value]
    return [(i, x) for i, x in enumerate(items) if isinstance(x, dict)]


#: Child node types by parent type: (fields tried in turn, node name).
CHILDREN: dict[str, tuple[tuple[str, ...], str]] = {
    "profile": (("experience", "positions"), "job"),
    "job": (("roles",), "role"),
    "role": (("projects",), "project"),
}
_LEVEL = {"job": 0, "role": 1, "project": 2}


def _children(node: str, value: dict) -> tuple[str | None, list[tuple[int, dict]], tuple[str, ...]]:
    fields, name = CHILDREN.get(node, ((), None))
    for field in fields:
        if isinstance(value.get(field), (list, dict)):
            return name, _objects(value[field]), fields
    return name, [], fields


def label(root: str, value: dict) -> list[list]:
    """[node, pre, post, position, attributes] of one document in pre-order; the traversal keeps its own stack, so depth is
    no limit. position is the place in the array that holds the object, -1 for the root."""
    rows: list[list] = []
    counter = 0
    stack: list[tuple] = [(root, value, -1, None)]
    while stack:
        node, obj, position, leaving = stack.pop()
        if leaving is not None:
            rows[leaving][2] = counter
            counter += 1
            continue
        name, below, used = _children(node, obj)
        rows.append([node, counter, -1, position, json.dumps({k: v for k, v in obj.items() if k not in used}, ensure_ascii=False)])
        counter += 1
        stack.append((node, obj, position, len(rows) - 1))
        stack += [(name, child, i, None) for i, child in reversed(below)]
    return rows


def linked(record_id: str, document: str, rows: list[list]) -> list[tuple]:
    """NODE_SCHEMA rows of a document's labelled nodes in pre-order, linked by interval containment.

    The nodes that contain a node are those whose intervals are still open where its own begins; the innermost is its parent,
    and the jobs, roles and projects among them, and itself, give the positions.
    """
    out, around = [], []
    for node, pre, post, position, attributes in rows:
        while around and not (around[-1][1] < pre and post < around[-1][2]):
            around.pop()
        at = [-1, -1, -1]
        for kind, _, _, place, _ in [*around, (node, pre, post, position, attributes)]:
            if kind in _LEVEL:
                at[_LEVEL[kind]] = place
        out.append((record_id, document, node, pre, post, around[-1][1] if around else -1, len(around), position, *at, attributes))
        around.append((node, pre, post, position, attributes))
    return out


def _label_rows(attributes: bool) -> Callable[[Iterator], Iterator]:
    import pandas as pd

    names = [c.split()[0] for c in NODE_SCHEMA.split(",")]

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            out: list[tuple] = []
            for rid, raw, before in zip(batch["record_id"], batch["raw"], batch["before"]):
                if (record := read_object(raw)) is not None:
                    out += linked(rid, "raw", label("profile", profile_of(record)))
                if (record := read_object(before)) is not None:
                    out += linked(rid, "previous", label("previous", record))
            frame = pd.DataFrame(out, columns=names)
            yield frame if attributes else frame.assign(attributes=None)

    return run


def nodes(df: DataFrame, record_id: str, raw: str, before: str, attributes: bool = True) -> DataFrame:
    """NODE_SCHEMA rows of all profile objects in the JSON columns ``raw`` and ``before``.

    One narrow pass; nothing is shuffled. Unreadable, null and blank texts give no rows; a JSON string that holds an
    object is opened once; elements that are no objects give no row but keep their position; an object in place of an
    array counts as an array of one. A null ``record_id`` is kept as null. Rows of repeated records repeat.
    ``attributes`` holds the node's own fields as JSON, nested arrays of child nodes left out.
    """
    narrow = df.select(F.col(record_id).cast("string").alias("record_id"), F.col(raw).alias("raw"), F.col(before).alias("before"))
    narrow = narrow.filter("raw is not null or before is not null")
    return narrow.mapInPandas(_label_rows(attributes), NODE_SCHEMA)


def contained(ancestors: DataFrame, descendants: DataFrame) -> DataFrame:
    """Pairs (record_id, document, ancestor_pre, descendant_pre) by interval containment, joined within a record."""
    a = ancestors.select("record_id", "document", F.col("pre").alias("ancestor_pre"), F.col("post").alias("ancestor_post"))
    d = descendants.select("record_id", "document", F.col("pre").alias("descendant_pre"), F.col("post").alias("descendant_post"))
    inside = (F.col("ancestor_pre") < F.col("descendant_pre")) & (F.col("descendant_post") < F.col("ancestor_post"))
    return a.join(d, ["record_id", "document"]).filter(inside).select("record_id", "document", "ancestor_pre", "descendant_pre")


def typed(node_rows: DataFrame, node: str, fields: list[str]) -> DataFrame:
    """The table of one node type with ``fields`` taken from its attributes as text."""
    picked = [F.get_json_object("attributes", f"$['{f}']").alias(f) for f in fields]
    return node_rows.filter(F.col("node") == node).select("record_id", "document", "pre", "post", "parent_pre", "position", *picked)
