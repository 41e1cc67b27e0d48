"""Literal frames and plain-Python references for the tests."""

from __future__ import annotations

from datetime import datetime, timedelta

BASE = datetime(2026, 1, 1, 10, 0, 0)


def task_frame(spark, specs, batch=1):
    """Tasks from (id, top class, top id) triples, one second apart."""
    rows = [
        (batch, t, BASE + timedelta(seconds=k), None, "PENDING", None, cls, rid)
        for k, (t, cls, rid) in enumerate(specs)
    ]
    return spark.createDataFrame(
        rows,
        "batch_id bigint, task_id string, created_at timestamp, timeout_at timestamp, state string, "
        "cursor string, top_resource_class string, top_resource_id string",
    )


def resource_frame(spark, footprints):
    """Footprint rows from ``{task: ["class:id", ...]}``."""
    rows = [(t, *r.split(":", 1)) for t, rs in footprints.items() for r in rs]
    return spark.createDataFrame(rows, "task_id string, resource_class string, resource_id string")


def admission_frame(spark, *rows):
    """Class decisions from (class, admitted, pressure)."""
    return spark.createDataFrame(
        list(rows), "resource_class string, admitted boolean, pressure double"
    )


def neighbours(footprints):
    """Tasks sharing a resource with each task."""
    holders = {}
    for t, rs in footprints.items():
        for r in rs:
            holders.setdefault(r, set()).add(t)
    return {t: set().union(*[holders[r] for r in rs]) - {t} for t, rs in footprints.items()}


def greedy(footprints, estimates):
    """One-by-one greedy colouring over adjacency sets."""
    near = neighbours(footprints)
    colours = {}
    for t in sorted(near, key=lambda t: (-estimates[t], -len(near[t]), t)):
        held = {colours[v] for v in near[t] if v in colours}
        colours[t] = next(c for c in range(len(near) + 1) if c not in held)
    return colours


def components(footprints):
    """Smallest member of each task's component, by repeated search."""
    near, found = neighbours(footprints), {}
    for start in sorted(near):
        todo = [start]
        while todo:
            t = todo.pop()
            if t not in found:
                found[t] = start
                todo += near[t]
    return found
