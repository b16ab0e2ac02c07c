"""State over events: the latest result wins, toggles, undo and redo."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """The row of the highest version of each key; stale results go.  A partial aggregate, so a hot key is no burden.

    Of rows of equal version the one with the largest other columns stays, from
    the first column on; those that have no order (maps, variants) count as their JSON.
    """
    rest = [c for c in df.columns if c not in keys]
    unordered = {c for c, kind in df.dtypes if "map<" in kind or "variant" in kind}
    order = [F.col(version).alias("__v"), *[F.col(c).alias(f"v_{c}") for c in rest if c not in unordered]]
    if not unordered & set(rest):
        top = F.max(F.struct(*order))
    else:
        as_json = [F.to_json(F.struct(c)).alias(f"j_{c}") for c in rest if c in unordered]
        top = F.max_by(F.struct(*[F.col(c).alias(f"v_{c}") for c in rest]), F.struct(*order, *as_json))
    return df.groupBy(*keys).agg(top.alias("m")).select(*keys, *[F.col(f"m.v_{c}").alias(c) for c in rest])


def _with_hidden(r: Column, hidden) -> Column:
    return F.struct(r["detection"].alias("detection"), r["boxes"].alias("boxes"), hidden.alias("hidden"))


def toggle(regions: Column, index: Column) -> Column:
    """One region shown or hidden (0-based)."""
    return F.transform(regions, lambda r, i: _with_hidden(r, F.when(i == index, ~r["hidden"]).otherwise(r["hidden"])))


def toggle_all(regions: Column) -> Column:
    """All hidden if any is visible, else all shown."""
    any_visible = F.exists(regions, lambda r: ~r["hidden"])
    return F.transform(regions, lambda r: _with_hidden(r, any_visible))


BOX = "struct<x:double,y:double,w:double,h:double>"


def replayed(log) -> list:
    """Boxes after a log of (action, box, index): a list of edits with a cursor, moved by undo and redo; a new edit cuts off what was undone."""
    boxes, edits, cursor = [], [], 0

    def apply(kind, at, box):
        boxes.insert(at, box) if kind == "add" else boxes.pop(at)

    for action, box, index in log:
        edit = None
        if action == "add":
            edit = "add", len(boxes), box
        elif action == "delete" and index is not None and 0 <= index < len(boxes):
            edit = "delete", index, boxes[index]
        elif action == "undo" and cursor:
            cursor -= 1
            kind, at, was = edits[cursor]
            apply("delete" if kind == "add" else "add", at, was)
        elif action == "redo" and cursor < len(edits):
            apply(*edits[cursor])
            cursor += 1
        if edit:
            del edits[cursor:]
            edits.append(edit)
            apply(*edit)
            cursor += 1
    return boxes


def manual_boxes(events: DataFrame, key: str = "session_id", order: str = "seq") -> DataFrame:
    """Hand-drawn boxes after a log of add, delete (by 0-based index), undo and redo.

    The log of one session is gathered and replayed in one go: a person's actions,
    each an edit and not a copy of all boxes, so a session costs time in proportion
    to its events.
    """
    kind = dict(events.select(key).dtypes)[key]
    log = events.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("action").alias("action"), F.col("box").cast(BOX).alias("box"), F.col("index").cast("int").alias("index")))).alias("log"))

    def each(batches):
        for b in batches:
            made = [replayed((e["action"], e["box"], e["index"]) for e in entries) for entries in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, _BOXES)], [key, "boxes"])

    return log.mapInArrow(each, f"`{key}` {kind}, boxes array<{BOX}>")


_BOXES = pa.list_(pa.struct([(c, pa.float64()) for c in "xywh"]))
