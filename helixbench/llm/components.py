"""Connected components of a link table by contraction: forests within tasks, then links between their roots."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixbench.llm.common import forget, stored

#: Links that a task turns into a forest at once, a bound on its memory.
PART = 1 << 18
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links (a, b): each node that has a smaller one in its component, and the component's smallest node."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = _labels(len(nodes), flat[: len(a)], flat[len(a) :])
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _labels(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest number reachable from each of n nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _draw(nodes: np.ndarray, level: int) -> np.ndarray:
    """A random order of the nodes, another one at each level, so that long chains shrink by a constant share."""
    x = (nodes.view(np.uint64) + np.uint64(level + 1)) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX2
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def _roots(level: int):
    """Links (a, b) to rows (v, p, r): each node with the root of its tree in the task's forest and the root's draw."""

    def trees(a: np.ndarray, b: np.ndarray):
        nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
        order = np.lexsort((nodes, _draw(nodes, level)))
        place = np.empty(len(nodes), np.int64)
        place[order] = np.arange(len(nodes))
        root = order[_labels(len(nodes), place[flat[: len(a)]], place[flat[len(a) :]])]
        r = np.empty(len(nodes), np.int64)
        r[order] = nodes[root]
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(_draw(r, level)), pa.array(r)], names=["v", "p", "r"])

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if sum(len(a) for a, _ in held) >= PART:
                yield trees(*map(np.concatenate, zip(*held, strict=True)))
                held = []
        if held and sum(len(a) for a, _ in held):
            yield trees(*map(np.concatenate, zip(*held, strict=True)))

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, component): for each node that ``links`` (two long columns, any order) joins to another one, a node of
    its component, the same for all of the component. Self links and repeated links count once or not at all; an
    empty table gives an empty one.

    Each task turns its links into a forest. A node that has roots in several tasks follows one of them, drawn at
    random but the same everywhere, and links it with the others; these links, between roots only, are the next
    level's table, until none are left. Then labels go back from level to level. No key gathers a component's links:
    a node has a row a task at most. Each level is written to the shared folder.
    """
    a, b = links.columns
    now = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    levels: list[DataFrame] = []
    while True:
        rows = now.mapInArrow(_roots(len(levels)), "v long, p long, r long")
        met = rows.groupBy("v").agg(F.sort_array(F.collect_set(F.struct("p", "r"))).alias("roots"))
        rest = F.transform(F.slice("roots", 2, F.size("roots")), lambda x: x["r"])
        levels.append(stored(met.select("v", F.get("roots", F.lit(0))["r"].alias("m"), rest.alias("others")), "level"))
        now = levels[-1].where(F.size("others") > 0).select(F.explode("others").alias("a"), F.col("m").alias("b"))
        if now.isEmpty():
            break
    label = levels[-1].select("v", F.col("m").alias("label"))
    for level in reversed(levels[:-1]):
        known = label.select(F.col("v").alias("m"), "label")
        label = level.select("v", "m").join(known, "m", "left").select("v", F.coalesce("label", "m").alias("label"))
    out = stored(label.select(F.col("v").alias("node"), F.col("label").alias("component")), "components")
    for level in levels:
        forget(level)
    return out
