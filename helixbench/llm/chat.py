"""Chat formatting of reply trees, in DataFrame functions only.

A tree is rows of (tree, node, parent): pointers to ancestors are doubled by self-joins until they reach the roots,
and the leaves then unfold along them, again by self-joins, into their paths. The paths of a tree are ranked by
score, and each chosen one becomes one conversation: turns between a template's marks, with the spans that are learned
from. Control strings within texts and roles are escaped so that reading a conversation back gives what went in.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixbench.llm.common import forget, stored

#: Strings that mark turns in common chat formats; no text may hold one as it is.
CONTROLS = (
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>", "<|endoftext|>", "<|begin_of_text|>", "<|end_of_text|>",
)
#: A control string's first letter, backslashes, and the rest of it. Escaping puts one more backslash there.
_CONTROL = r"([<\[])(\\*)(" + "|".join(sorted({c[1:].replace("|", r"\|").replace("]", r"\]") for c in CONTROLS}, key=len, reverse=True)) + ")"
#: Parts of a tree's branches that are ranked apart before they are ranked together.
_PARTS = 64


class Template(NamedTuple):
    """What stands before a turn's role, between its role and its text, and after its text; roles whose texts are
    learned from. ``start`` and ``end`` are control strings (``end`` may go on), ``middle`` has a line break, which no
    encoded role has."""

    start: str = "<|im_start|>"
    middle: str = "\n"
    end: str = "<|im_end|>\n"
    learned: tuple[str, ...] = ("assistant",)


CHAT = Template()
HEADERS = Template("<|start_header_id|>", "<|end_header_id|>\n\n", "<|eot_id|>")


def escaped(text: Column) -> Column:
    """``text`` without control strings: each gets a backslash behind its first letter, one more if it has some."""
    return F.regexp_replace(text, _CONTROL, r"$1$2\\$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL.replace(r"(\\*)", r"\\(\\*)"), "$1$2$3")


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def ancestors(nodes: DataFrame) -> list[DataFrame]:
    """Tables (tree, node, up) of the ancestors 1, 2, 4 ... steps above, as far as any node has one; stored tables."""
    up = stored(nodes.select("tree", "node", F.col("parent").alias("up")).where("up is not null"), "up-0")
    floors, most = [up], nodes.count()
    while not floors[-1].isEmpty() and 1 << len(floors) <= most:
        last = floors[-1]
        above = last.select(F.col("tree").alias("t"), F.col("node").alias("via"), F.col("up").alias("far"))
        met = last.join(above, _same("tree", "t") & (F.col("up") == F.col("via")))
        floors.append(stored(met.select("tree", "node", F.col("far").alias("up")), f"up-{len(floors)}"))
    return floors


def paths(rows: DataFrame, tree: str = "tree", node: str = "node", parent: str = "parent") -> DataFrame:
    """(tree, leaf, node, depth, length): for every leaf each node on the way from its root, ``depth`` from 0 at the
    root, ``length`` the number of nodes on the path; a stored table.

    A node is a leaf if no other names it as its parent. A parent that is not there, null or the node itself makes a
    root. Rows of one (tree, node) count once, with the smallest parent; a null tree is a tree, rows without a node
    are in none. Nodes that only reach a ring of parents have no root, and so no path. Trees may be of any size and
    depth: joins go by (tree, node), their number by the logarithm of the depth."""
    own = rows.where(F.col(node).isNotNull()).groupBy(F.col(tree).alias("tree"), F.col(node).alias("node")).agg(F.min(parent).alias("parent"))
    own = stored(own, "nodes")
    there = own.select(F.col("tree").alias("t"), F.col("node").alias("p"))
    nodes = own.join(there, _same("tree", "t") & (F.col("parent") == F.col("p")) & (F.col("parent") != F.col("node")), "left")
    nodes = stored(nodes.select("tree", "node", F.col("p").alias("parent")), "tree-nodes")
    floors = ancestors(nodes)
    named = nodes.where("parent is not null").select(F.col("tree").alias("t"), F.col("parent").alias("p")).distinct()
    found = nodes.join(named, _same("tree", "t") & (F.col("node") == F.col("p")), "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("above"))
    grown: list[DataFrame] = []
    for k, floor in reversed(list(enumerate(floors))):
        far = floor.select(F.col("tree").alias("t"), F.col("node").alias("via"), "up")
        more = found.join(far, _same("tree", "t") & (F.col("node") == F.col("via"))).select("tree", "leaf", F.col("up").alias("node"), (F.col("above") + (1 << k)).alias("above"))
        found = stored(found.unionByName(more), f"steps-{k}")  # else each join would run anew for all that follow
        grown.append(found)
    # A node's steps from the leaf turn into its depth; below a ring the steps repeat nodes and end in no root.
    steps = stored(found, "steps") if not grown else found
    roots = nodes.where("parent is null").select(F.col("tree").alias("t"), F.col("node").alias("root"))
    ends = steps.join(roots, _same("tree", "t") & (F.col("node") == F.col("root"))).select(F.col("tree").alias("t"), F.col("leaf").alias("l"), (F.col("above") + 1).alias("length"))
    out = steps.join(ends, _same("tree", "t") & (F.col("leaf") == F.col("l"))).select("tree", "leaf", "node", (F.col("length") - 1 - F.col("above")).alias("depth"), "length")
    out = stored(out, "paths")
    for done in (own, nodes, steps, *grown[:-1], *floors):
        forget(done)
    return out


def ranked(branches: DataFrame, best: int) -> DataFrame:
    """The ``best`` branches (tree, leaf, score) of each tree with their ``rank`` from 1: highest score first, equal
    ones by the smaller leaf, null scores last. A tree's branches are ranked in parts first, so that one with very
    many leaves fills no task."""
    order = [F.desc_nulls_last("score"), F.asc("leaf")]
    part = branches.withColumn("part", F.pmod(F.xxhash64("leaf"), F.lit(_PARTS)))
    some = part.withColumn("rank", F.row_number().over(Window.partitionBy("tree", "part").orderBy(*order))).where(F.col("rank") <= best)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(*order))).where(F.col("rank") <= best).drop("part")


def format_turns(turns: DataFrame, keys: list[str], template: Template = CHAT) -> DataFrame:
    """(keys, formatted, turns) of rows (keys, at, role, text), one conversation for each value of the keys with its
    turns in the order of ``at``: ``turns`` has (start, text_start, text_end, learned) of each, in code points from 0.
    Null roles and texts are empty. A conversation becomes one row, and so is in one task."""
    role = F.coalesce(F.col("role"), F.lit(""))
    head = F.concat(F.lit(template.start), F.url_encode(role), F.lit(template.middle))
    piece = turns.select(*keys, "at", head.alias("head"), escaped(F.coalesce(F.col("text"), F.lit(""))).alias("body"), role.isin(*template.learned).alias("learned"))
    size = F.length("head").cast("long") + F.length("body") + len(template.end)
    before = F.sum(size).over(Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - size
    placed = piece.withColumn("start", before)
    text_start = F.col("start") + F.length("head")
    span = F.struct("start", text_start.alias("text_start"), (text_start + F.length("body")).alias("text_end"), "learned")
    rows = placed.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("at", F.concat("head", "body", F.lit(template.end)).alias("piece"), span.alias("span")))).alias("all"))
    return rows.select(*keys, F.array_join(F.transform("all", lambda x: x["piece"]), "").alias("formatted"), F.transform("all", lambda x: x["span"]).alias("turns"))


def conversations(rows: DataFrame, best: int = 1, score: str | None = None, tree: str = "tree", node: str = "node", parent: str = "parent", role: str = "role", text: str = "text", template: Template = CHAT) -> DataFrame:
    """(tree, leaf, rank, formatted, turns): the ``best`` root-to-leaf paths of each reply tree, each as one
    conversation. A branch's score is the mean of its nodes' ``score`` (without one, or where all are null, null);
    several rows of a node count as the smallest of (parent, role, text). Other columns are left out."""
    value = F.lit(None).cast("double") if score is None else F.col(score).cast("double")
    rows = rows.select(F.col(tree).alias("t"), F.col(node).alias("n"), F.col(parent).alias("p"), F.col(role).alias("role"), F.col(text).alias("text"), value.alias("value"))
    rows = stored(rows.where("n is not null"), "turns")  # texts are made ready once, whatever the plan behind them
    way = paths(rows, "t", "n", "p")
    scored = rows.groupBy("t", "n").agg(F.avg("value").alias("value"))
    branches = way.join(scored, _same("tree", "t") & (F.col("node") == F.col("n"))).groupBy("tree", "leaf").agg(F.avg("value").alias("score"))
    if score is None:
        branches = way.select("tree", "leaf").distinct().withColumn("score", F.lit(None).cast("double"))
    chosen = ranked(branches, best).select(F.col("tree").alias("ct"), F.col("leaf").alias("cl"), "rank")
    kept = way.join(chosen, _same("tree", "ct") & (F.col("leaf") == F.col("cl"))).select("tree", "leaf", "rank", "node", F.col("depth").alias("at"))
    said = rows.select("t", "n", "p", "role", "text")
    turns = kept.join(said, _same("tree", "t") & (F.col("node") == F.col("n"))).select("tree", "leaf", "rank", "at", "p", "role", "text")
    # Several rows of a node are told apart where the conversation's turns are together anyway.
    again = F.lag("at").over(Window.partitionBy("tree", "leaf", "rank").orderBy("at", "p", "role", "text"))
    turns = turns.withColumn("again", again.eqNullSafe(F.col("at"))).where("not again").select("tree", "leaf", "rank", "at", "role", "text")
    out = stored(format_turns(turns, ["tree", "leaf", "rank"], template), "conversations")
    for done in (way, rows):
        forget(done)
    return out


def read_back(formatted: DataFrame, template: Template = CHAT) -> DataFrame:
    """``formatted`` with ``read``: of each turn (role, text, loss), taken from the formatted text and unescaped;
    ``loss`` is what the turn's span, if it is learned from, cuts out of it, unescaped, else null."""
    pieces = F.split("formatted", rf"\Q{template.end}\E")
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)  # nothing is behind the last end
    middle = len(template.middle)

    def turn(piece: Column, span: Column) -> Column:
        at = F.instr(piece, template.middle)
        role = F.url_decode(F.substring(piece, F.lit(len(template.start) + 1), at - len(template.start) - 1))
        text = F.substring(piece, at + middle, F.length(piece))
        cut = F.substring(piece, (span["text_start"] - span["start"] + 1).cast("int"), (span["text_end"] - span["text_start"]).cast("int"))
        return F.struct(role.alias("role"), unescaped(text).alias("text"), F.when(span["learned"], unescaped(cut)).alias("loss"))

    return formatted.withColumn("read", F.zip_with(pieces, "turns", turn))


def chained(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Plain conversations as reply trees (tree, node, parent, role, text): each row answers the one before it in the
    order of turn, role and text (nulls first). A null key is a conversation; repeated rows are turns of their own."""
    order = F.row_number().over(Window.partitionBy(key).orderBy(turn, role, text)).cast("long")
    at = rows.select(F.col(key).alias("tree"), order.alias("node"), F.col(role).alias("role"), F.col(text).alias("text"))
    return at.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text")
