"""Queries of the training-data operators over whole tables, and their DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixbench.llm import chat, debruijn, decontaminate, language_id, licenses, media, mixing, search, simhash, token_store, toxicity, whitening
from helixbench.llm import url_filter as urls
from helixbench.llm.common import remainder, table

#: The rules of the contract.
URL_RULES = [
    urls.Rule("allow", "com/"),
    urls.Rule("block", "example.com/en/"),
    urls.Rule("allow", "www.example.com/en/"),
    urls.Rule("block", "net/es/"),
    urls.Rule("block", "net/fr/"),
]
#: Hosts and paths that no rule names: advertising, tracking and account pages.
URL_METHOD = [
    urls.Rule("block", "ads-*"),
    urls.Rule("block", "*-ads.*"),
    urls.Rule("block", "*track.*"),
    urls.Rule("block", "*/*/login*"),
    urls.Rule("block", "*/*/cart*"),
    urls.Rule("block", "*/*.exe"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_filter(table(spark, sf_dir, "pages"), ["page_id"], URL_RULES, URL_METHOD)


OP1_SQL = r"""
WITH a AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a
), r AS (
  SELECT page_id, host, path,
    CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
         WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
         WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
         WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule
  FROM p
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN ('.' || host) LIKE '%.ads-%' OR ('.' || host) LIKE '%.%-ads.%' OR ('.' || host) LIKE '%.%track.%'
         OR (host LIKE '%' AND (path LIKE '/%/login%' OR path LIKE '/%/cart%' OR regexp_matches(path, '^/.*[.]exe'))) THEN 'block'
       ELSE 'allow' END AS verdict
FROM r
"""

def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.drop_repeats(table(spark, sf_dir, "documents"), kept_text=False).drop("kept")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Every window of 13 words with 11 equal ones has a run of four, so runs of four find the diagonals to compare.
OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
dt AS (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS i FROM d WHERE len(w) >= 13),
bt AS (SELECT item_id, unnest(w) AS t, unnest(range(len(w))) AS j FROM b WHERE len(w) >= 13),
dg AS (SELECT doc_id, i, t || ' ' || lead(t) OVER w || ' ' || lead(t, 2) OVER w || ' ' || lead(t, 3) OVER w AS g FROM dt WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
bg AS (SELECT item_id, j, t || ' ' || lead(t) OVER w || ' ' || lead(t, 2) OVER w || ' ' || lead(t, 3) OVER w AS g FROM bt WINDOW w AS (PARTITION BY item_id ORDER BY j)),
diagonals AS (SELECT DISTINCT doc_id, item_id, i - j AS diag FROM dg JOIN bg USING (g)),
same AS (SELECT x.doc_id, x.item_id, x.diag, bt.j, dt.t = bt.t AS e FROM diagonals x JOIN bt ON bt.item_id = x.item_id
         JOIN dt ON dt.doc_id = x.doc_id AND dt.i = bt.j + x.diag),
win AS (SELECT doc_id, item_id, diag, j, sum(CASE WHEN e THEN 1 ELSE 0 END) OVER w AS m, count(*) OVER w AS n FROM same
        WINDOW w AS (PARTITION BY doc_id, item_id, diag ORDER BY j ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING))
SELECT doc_id, item_id, min(j + diag) AS first_word, max(j + diag) + 12 AS last_word FROM win WHERE m >= 11 AND n = 13 GROUP BY doc_id, item_id
"""

#: A window starts in a row; rows of one doc_id are one document, so that none is the other's source.
OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT r, doc_id, unnest(w) AS t, unnest(range(len(w))) AS i FROM d),
g AS (SELECT r, doc_id, i, concat_ws(' ', GRAMS) AS g, count(*) OVER (PARTITION BY r) AS n FROM t WINDOW o AS (PARTITION BY r ORDER BY i)),
f AS (SELECT g, min(doc_id) AS first FROM g WHERE i + 13 <= n GROUP BY g),
h AS (SELECT r, i FROM g JOIN f USING (g) WHERE i + 13 <= n AND doc_id > first),
k AS (SELECT t.r, t.t, t.i, max(h.i) OVER (PARTITION BY t.r ORDER BY t.i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM t LEFT JOIN h ON h.r = t.r AND h.i = t.i),
s AS (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(t, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM k GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (r)
""".replace("GRAMS", ", ".join(f"lead(t, {j}) OVER o" if j else "t" for j in range(13)))

#: Fixed values of the contract: the tokenizer's file and the id that ends a document.
TOKENIZER, END_ID = "word_bpe_49k.json", 2


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_rows(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.store_media(table(spark, sf_dir, "documents")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 3) == 1
    model = language_id.train(docs, ~held_out)
    return language_id.identify(docs.drop("score"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_spans(table(spark, sf_dir, "documents"))


#: Fixed values of the contract: a conversation whose texts are control strings.
CONTROL_CONVERSATION = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    one = "inline(array(" + ", ".join(f"named_struct('conv_id', {c}, 'turn', {t}, 'role', '{r}', 'text', '{x}')" for c, t, r, x in CONTROL_CONVERSATION) + "))"
    rows = rows.unionByName(spark.range(1).selectExpr(one).select(*(F.col(f.name).cast(f.dataType) for f in rows.schema)))
    read = chat.read_back(chat.conversations(chat.chained(rows)))
    said = F.array_join(F.transform("read", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.filter(F.transform("read", lambda x: x["loss"]), lambda x: x.isNotNull()), "")
    return read.select(
        F.col("tree").alias("conv_id"), F.size("read").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP11_SQL = (
    r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(text, 'CONTROL', '\1\2\\\3', 'g') AS body FROM rows
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS loss_sha256,
  CAST(sum(length(url_encode(role)) + length(body) + MARKS) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""".replace("CONTROL", chat._CONTROL).replace("MARKS", str(sum(map(len, chat.CHAT[:3]))))
)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
dn AS (SELECT *, len(w) AS n FROM d WHERE len(w) > 0),
s AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM dn),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
u AS (SELECT r, doc_id, n, unnest(w) AS t FROM dn),
tf AS (SELECT r, doc_id, n, t, count(*) AS tf FROM u WHERE t IN (SELECT t FROM b) GROUP BY r, doc_id, n, t),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM df, s),
sc AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // l)))) AS BIGINT) AS score FROM tf JOIN b USING (t) JOIN w USING (t), s GROUP BY item_id, r, doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM k WHERE rank <= 10
"""


QUERIES = {"op10_license_scan": op10_license_scan, "op9_mixing": op9_mixing, "op4_toxicity": op4_toxicity, "op6_language_id": op6_language_id, "op3_decontamination": op3_decontamination, "op8_media": op8_media, "op7_token_store": op7_token_store, "op5_debruijn_dedup": op5_debruijn_dedup, "op1_url_filter": op1_url_filter, "op2_simhash": op2_simhash, "op11_chat_format": op11_chat_format, "op12_whitening": op12_whitening, "op13_search": op13_search}
ORACLE_SQL = {"op1_url_filter": OP1_SQL, "op3_decontamination": OP3_SQL, "op5_debruijn_dedup": OP5_SQL, "op11_chat_format": OP11_SQL, "op13_search": OP13_SQL}
