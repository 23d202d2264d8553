"""The operators applied to their whole tables, with DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import conversation_repair, decontaminate, filter_audit, host_reputation, iblt, language_id, partenum, sharding, sp_sampling, style_tree, suffix_dedup, token_counts, warc
from tessera.llm.store import stored
from tessera.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return deco


#: Rows with texts that a task hands to Python at once: some MB, also where texts are long.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts; the session is set to hand its rows to Python in small batches."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


# -- 1: benchmark decontamination ------------------------------------------
_DECONTAMINATE_SQL = r"""
WITH toks AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
  WHERE item_id IS NOT NULL AND text IS NOT NULL),
windows AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM toks, sizes WHERE len(w) >= n),
hits AS (
  SELECT r, i, p.n, item FROM (SELECT r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win FROM places) p
  JOIN windows USING (win, n)),
words AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM hits) GROUP BY r),
found AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hits
  GROUP BY r)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM toks LEFT JOIN words USING (r) LEFT JOIN found USING (r)
"""


@query("op1_decontaminate", _DECONTAMINATE_SQL)
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document lies in benchmark windows, and whether that contaminates it."""
    judged = decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"),
                                 carry=["doc_id"])
    return judged.select("doc_id", "n_words", "n_hit", "n_items",
                         F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


# -- 2: SentencePiece encoding and decoding ---------------------------------
SAMPLES = 2


@query("op2_gumbel_top_k")
def op2_gumbel_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best sampled segmentations of every document without replacement, with inclusion scores,
    and what they decode to."""
    return sp_sampling.encode_digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), SAMPLES)


# -- 3: WARC ----------------------------------------------------------------
_WARC_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest
  FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f USING (digest)
"""


@query("op3_warc", _WARC_SQL)
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives in the shared folder, and read back from them."""
    folder = scratch_path(spark, "warc")
    manifest = warc.write_warc(table(spark, sf_dir, "pages"), folder)
    records = stored(warc.read_warc(manifest, folder, with_payload=False), "warc-records")
    return warc.with_referred_pages(records).select("page_id", "payload_bytes", "payload_digest", "record_type",
                                                    "refers_to")


# -- 4: n-gram Jaccard join -------------------------------------------------
_JACCARD_SQL = r"""
WITH RECURSIVE toks AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(4, len(w)) - 1), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM toks WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS c FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y
  WHERE 100 * i >= 85 * (p.c + q.c - i)),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT d.doc_id, CAST(coalesce(n.c, 0) AS BIGINT) AS n_shingles, m.y AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS y FROM reach GROUP BY x) m ON m.x = d.doc_id
"""


@query("op4_partenum_jaccard", _JACCARD_SQL)
def op4_partenum_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under links of 4-word shingle Jaccard 0.85 or more."""
    joined = partenum.jaccard_components(table(spark, sf_dir, "documents"))
    return joined.rows.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


# -- 5: token counts --------------------------------------------------------
def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is (the same on every machine)."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


TOKEN_LIMIT = 512


@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and which are over 512 tokens."""
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"),
                                        carry=["doc_id"])
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


# -- 6: document fingerprints -----------------------------------------------
@query("op6_iblt")
def op6_iblt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sketch against its edited text and the next document."""
    return iblt.fingerprint_edits(table(spark, sf_dir, "documents"))


# -- 7: language ID ---------------------------------------------------------
LANGUAGES = ("en", "de", "fr", "es")


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, its probability, and whether the document is accepted
    (``lang`` is the declaration, ``source`` the host)."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs, LANGUAGES)
    return language_id.identify(docs, model, declared=F.col("lang"), host=F.col("source"), carry=["doc_id", "lang"])


# -- 8: sharding ------------------------------------------------------------
_SHARDS = 16
_CRC_SQL = """
WITH steps(i, c) AS (
  SELECT range, list_reduce(list_prepend(range, range(8)), lambda c, j:
    CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) FROM range(256)),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM steps),
sized AS (
  SELECT doc_id, coalesce(text, '') AS body, strlen(coalesce(text, '')) + 1 AS size FROM documents),
summed AS (
  SELECT doc_id, body, size,
    2 * (sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - size) + size AS twice_middle,
    sum(size) OVER () AS total FROM sized),
dealt AS (SELECT doc_id, body, size, least(15, (16 * twice_middle) // (2 * total)) AS shard FROM summed),
bytes AS (
  SELECT doc_id, list_transform(string_split(regexp_replace(hex(encode(body)), '(..)', '\\1,', 'g'), ','),
    lambda x: CASE WHEN x = '' THEN -1 ELSE CAST('0x' || x AS BIGINT) END) AS b FROM dealt)
SELECT doc_id, CAST(size AS BIGINT) AS size,
  xor(list_reduce(list_prepend(4294967295, b), lambda c, x:
    CASE WHEN x < 0 THEN c ELSE xor(c // 256, t[1 + xor(c % 256, x)]) END), 4294967295) AS text_crc32,
  'bytes' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM dealt JOIN bytes USING (doc_id), crc_table
"""


@query("op8_sharding", _CRC_SQL)
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 contiguous shards of nearly equal bytes."""
    placed = sharding.balanced_shards(table(spark, sf_dir, "documents"), _SHARDS)
    return placed.select(F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"),
                         "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


# -- 9: url filters ---------------------------------------------------------
URL_RULES = [
    host_reputation.Rule("block", "net", "/"),
    host_reputation.Rule("allow", "example.net", "/en/"),
    host_reputation.Rule("block", "example.com", "/de/"),
    host_reputation.Rule("allow", "org", "/fr/"),
]
# Names under which anyone can register: the hosts of the tables lie below these.
HOST_SUFFIXES = ["example.com", "example.net", "example.org"]
MAX_BAD_RATE, BOUND_Z = 0.3, 1.64

_FIT = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
_RULE_SQL = " ".join(f"WHEN {_FIT.format(h=r.host, p=r.path)} THEN '{r.text}'"
                     for r in sorted(URL_RULES, key=lambda r: -len(r.text)))
_ACTION_SQL = " ".join(f"WHEN {_FIT.format(h=r.host, p=r.path)} THEN '{r.action}'"
                       for r in sorted(URL_RULES, key=lambda r: -len(r.text)))
_STRENGTH_SQL = """(SELECT CASE WHEN coalesce(s, 0) <= 0 THEN 1000.0 WHEN o / s <= 1.0 / 1001 THEN 1000.0
  ELSE greatest(1.0, s / o - 1) END FROM (SELECT
  sum((bad - n * mean) * (bad - n * mean) - n * mean * (1 - mean)) AS o, sum(n * (n - 1) * mean * (1 - mean)) AS s
  FROM {t}))"""
_REPUTATION_SQL = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parsed AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
lab AS (
  SELECT doc_id, count(*) AS n, sum(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels
  WHERE doc_id IS NOT NULL AND (toxic IS NOT NULL OR quality IS NOT NULL) GROUP BY doc_id),
h0 AS (
  SELECT host, CASE WHEN host IN ('example.com', 'example.net', 'example.org')
      OR regexp_matches(host, '[.]example[.](com|net|org)$') THEN regexp_extract(host, 'example[.](com|net|org)$')
    ELSE regexp_extract(host, '[^.]*$') END AS suffix,
    CAST(coalesce(sum(n), 0) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS bad
  FROM parsed LEFT JOIN lab ON page_id = doc_id GROUP BY host),
h AS (
  SELECT host, suffix, n, bad, CASE WHEN host = suffix THEN host ELSE
    regexp_extract(substr(host, 1, length(host) - length(suffix) - 1), '[^.]*$') || '.' || suffix END AS domain FROM h0),
s1 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT CASE WHEN sum(n) > 0 THEN sum(bad) / sum(n) ELSE 0.5 END
  FROM h) AS mean FROM h GROUP BY suffix),
ks AS (SELECT {_STRENGTH_SQL.format(t='s1')} AS k),
s2 AS (SELECT suffix, (bad + k * mean) / (n + k) AS mean FROM s1, ks),
d1 AS (SELECT domain, sum(n) AS n, sum(bad) AS bad, any_value(mean) AS mean FROM h JOIN s2 USING (suffix)
  GROUP BY suffix, domain),
kd AS (SELECT {_STRENGTH_SQL.format(t='d1')} AS k),
d2 AS (SELECT domain, (bad + k * mean) / (n + k) AS mean FROM d1, kd),
h1 AS (SELECT host, n, bad, mean FROM h JOIN d2 USING (domain)),
kh AS (SELECT {_STRENGTH_SQL.format(t='h1')} AS k),
post AS (SELECT host, (bad + k * mean) / (n + k) AS rate, n + k AS strength FROM h1, kh)
SELECT page_id, host, path, CASE {_RULE_SQL} END AS rule,
  CASE {_ACTION_SQL} ELSE CASE WHEN rate - {BOUND_Z} * sqrt(rate * (1 - rate) / (strength + 1)) > {MAX_BAD_RATE}
    THEN 'block' ELSE 'allow' END END AS verdict
FROM parsed JOIN post USING (host)
"""


@query("op9_host_reputation", _REPUTATION_SQL)
def op9_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's url: the longest fitting rule, else the host's posterior."""
    judged = host_reputation.judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES,
                                        HOST_SUFFIXES, MAX_BAD_RATE, BOUND_Z)
    return judged.select("page_id", "host", "path", "rule", "verdict")


# -- 10: HTML extraction ----------------------------------------------------
@query("op10_style_tree")
def op10_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return style_tree.extract_text(table(spark, sf_dir, "pages"), carry=["page_id", "url"])


# -- 11: suffix-array dedup ------------------------------------------------------
@query("op11_suffix_dedup")
def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of every document is covered by 100-byte strings that also start earlier, and what stays."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


# -- 12: filter interaction audit ---------------------------------------------
_AUDIT_SQL = r"""
WITH lab AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
  FROM labels GROUP BY doc_id),
docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
toks AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM docs),
masks AS (
  SELECT part, good, toxic, CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w)
    THEN 2 ELSE 0 END + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask
  FROM toks LEFT JOIN lab USING (doc_id)),
counters AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM masks GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS b),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND (a.b | b.b | c.b | d.b | e.b) = 31),
steps AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS prior
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
told AS (
  SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (prior | bit) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & prior = 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & prior <> 0), 0) AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & prior = 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & prior = 0), 0) AS toxic_lost
  FROM counters, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM told
"""


@query("op12_filter_audit", _AUDIT_SQL)
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes from all documents, in every order of them."""
    return filter_audit.audit(spark, f"{sf_dir.rstrip('/')}/documents.parquet", table(spark, sf_dir, "labels"))


# -- 13: conversation structure repair -----------------------------------------
@query("op13_conversation_repair")
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation, and the cheapest edits that mend it."""
    return conversation_repair.repair(conversation_repair.damaged(table(spark, sf_dir, "conversations")))
