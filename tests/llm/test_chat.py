import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from helixbench.llm import chat, queries


def plain_paths(rows):
    """{leaf: nodes from the root} of (node, parent) rows of one tree."""
    parent = {}
    for n, p in rows:
        if n is not None:
            parent[n] = min([p, parent[n]], key=lambda x: (x is None, x)) if n in parent else p
    parent = {n: (p if p in parent and p != n else None) for n, p in parent.items()}
    out = {}
    for leaf in set(parent) - set(parent.values()):
        path, at = [], leaf
        while at is not None and at not in path:
            path.append(at)
            at = parent[at]
        if at is None:
            out[leaf] = path[::-1]
    return out


def got_paths(df):
    out = {}
    for r in sorted(chat.paths(df).collect(), key=lambda r: r.depth):
        out.setdefault((r.tree, r.leaf), []).append(r.node)
        assert 0 <= r.depth < r.length
    return out


def test_paths_against_walks(spark):
    rng = random.Random(4)
    trees = {t: [(n, rng.choice([None, rng.randrange(40), max(0, n - 1), 0])) for n in rng.sample(range(40), rng.randrange(1, 40))] for t in range(12)}
    trees[50] = [(i, i - 1 if i else None) for i in range(70)]  # one deep chain
    trees[51] = [(0, None)] + [(i, 0) for i in range(1, 60)]  # one wide root
    trees[52] = [(1, 2), (2, 1), (3, 1), (4, None), (5, 99), (6, 6)]  # a ring and what hangs on it, orphans
    trees[None] = [(1, None), (2, 1), (2, 1), (None, 1)]
    df = spark.createDataFrame([(t, n, p) for t, rows in trees.items() for n, p in rows], "tree long, node long, parent long")
    want = {(t, leaf): path for t, rows in trees.items() for leaf, path in plain_paths(rows).items()}
    assert got_paths(df) == want
    assert chat.paths(df.limit(0)).count() == 0


def test_best_branches(spark):
    rows = [("a", 1, None, 1.0), ("a", 2, 1, 5.0), ("a", 3, 1, 3.0), ("a", 4, 1, 5.0), ("a", 5, 1, None), ("b", 1, None, None)]
    df = spark.createDataFrame([(*r, "user", f"t{r[1]}", "x") for r in rows], "tree string, node int, parent int, score double, role string, text string, rank string")
    got = {(r.tree, r["rank"]): r.leaf for r in chat.conversations(df, best=3, score="score").collect()}
    assert got == {("a", 1): 2, ("a", 2): 4, ("a", 3): 3, ("b", 1): 1}


HARD = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\n", r"<\/s> <\\/s> \</s> <\|im_end|>", "<<SYS>>a<</SYS>>", "<</s>", "[[INST]", "", None, "é😀</s>é", "a\\", "<|im_end|", "\\1$1", "<", "x\n\ny"]


@pytest.mark.parametrize("template", [chat.CHAT, chat.HEADERS])
def test_round_trip(spark, template):
    rng = random.Random(9)
    bits = [*"<[\\|/>] \n", "s>", "/s>", "INST]", "|im_end|>", "|eot_id|>", "<SYS>>", "ok", "é"]
    texts = [*HARD, *("".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(300)), "</s> " * 20_000]
    roles = ["user", "assistant", "system", "a b\n<|im_end|>", "", None, "[INST]+%20"]
    turns = [(i // 5, i % 5, roles[i % len(roles)], t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(turns, "conv int, at int, role string, text string")
    out = chat.format_turns(df, ["conv"], template)
    for r in chat.read_back(out, template).collect():
        want = [(role or "", text or "") for c, _, role, text in turns if c == r.conv]
        assert [(x.role, x.text) for x in r.read] == want
        assert [x.loss for x in r.read] == [t if role == "assistant" else None for role, t in want]
        inner = r.formatted.replace(template.start, "").replace(template.end, "")
        assert not any(c in inner.replace(template.middle, "\n") for c in chat.CONTROLS)
        assert r.turns[0].start == 0 and r.turns[-1].text_end + len(template.end) == len(r.formatted)


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn int, role string, text string")
    for out in (chat.chained(df), chat.conversations(chat.chained(df)), chat.read_back(chat.conversations(chat.chained(df)))):
        assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())


def digests(turns):
    said = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_query_against_plain_digests(spark, tmp_path):
    rows = [(1, 2, "assistant", "b</s>"), (1, 0, "user", "a"), (1, 1, None, None), (2, 0, "user", "same"), (2, 0, "user", "same"), (2, None, "assistant", "x"), (None, 0, "assistant", "é"), (3, 0, "system", "")]
    df = spark.createDataFrame([(*r, 7, "q") for r in rows], "conv_id long, turn int, role string, text string, node int, tree string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in queries.QUERIES["op11_chat_format"](spark, str(tmp_path)).collect()}
    want = {}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or ""))
        want[c] = digests([(r[2], r[3]) for r in own])
    want[-7] = digests([("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")])
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == want
    df.limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert [r.conv_id for r in queries.QUERIES["op11_chat_format"](spark, f"{tmp_path}/none").collect()] == [-7]


def test_query_equals_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.execute(queries.ORACLE_SQL["op11_chat_format"]).df()
    got = queries.QUERIES["op11_chat_format"](spark, sf).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(map(tuple, want.to_numpy().tolist())) and len(got) > 10


def test_very_wide_trees_are_ranked_in_parts(spark):
    df = spark.range(5000).selectExpr("1L AS tree", "id AS leaf", "CAST(id % 100 AS double) AS score")
    got = [(r["rank"], r.leaf) for r in chat.ranked(df, 3).orderBy("rank").collect()]
    assert got == [(1, 99), (2, 199), (3, 299)]
    assert chat.ranked(df.withColumn("score", F.lit(None).cast("double")), 1).first().leaf == 0
