"""The registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adsearch, chunked, convtrie, htmlcrf, minhash, packing, pii, quality, rabitq, suffix, tokenstore, toxicity, veccodes
from .bpe import public_path
from .common import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=2)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(_table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rabitq.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked.round_trip(_table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlcrf.extract(_table(spark, sf_dir, "pages"))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adsearch.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeat_digests(_table(spark, sf_dir, "documents"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    path = tokenstore.write_store(docs, public_path("word_bpe_49k.json"))
    return tokenstore.look_up(spark, path, docs.select("doc_id"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return veccodes.digests(_table(spark, sf_dir, "embeddings"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(_table(spark, sf_dir, "documents"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convtrie.conversation_trie(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_minhash, op2_toxicity, op3_packing, op4_pii, op5_embedding_dedup, op6_bpe, op7_html, op8_ann, op9_suffix_dedup, op10_token_store,
                            op11_vector_codes, op12_quality_rules, op13_conversation_trie)
}

ORACLES: dict[str, str] = {}

_BYTES = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"

ORACLES["op1_minhash"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_BYTES} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
             ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
k AS MATERIALIZED (SELECT doc_id, dense_rank() OVER (ORDER BY g) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM k x
      JOIN n nx ON nx.doc_id = x.doc_id JOIN k y ON x.g = y.g AND x.doc_id < y.doc_id
      JOIN n ny ON ny.doc_id = y.doc_id AND ny.n * 100 >= nx.n * 80 AND nx.n * 100 >= ny.n * 80 GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
      WHERE 100 * i >= 80 * (na.n + nb.n - i)),
u AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node),
c AS (SELECT node, min(root) AS root FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.root AS component_id, d.doc_id = c.root AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.node = d.doc_id
"""

#: Positions as characters of Latin-1 would not be bytes; the SQL cuts the hex form, two digits to a byte.
ORACLES["op9_suffix_dedup"] = """
WITH h AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
p AS (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 49)) AS pos FROM h),
s AS MATERIALIZED (SELECT doc_id, pos, md5_number(substr(x, 2 * pos + 1, 100)) AS g FROM p),
f AS (SELECT g, min(doc_id) AS first FROM s GROUP BY 1),
m AS (SELECT s.doc_id, s.pos FROM s JOIN f USING (g) WHERE s.doc_id > f.first),
o AS (SELECT doc_id, pos, pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS gap FROM m),
i AS (SELECT doc_id, pos, sum(CASE WHEN gap <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM o),
spans AS (SELECT doc_id, min(pos) AS lo, max(pos) + 50 AS hi FROM i GROUP BY doc_id, island),
g AS (SELECT doc_id, list(lo ORDER BY lo) AS lo, list(hi ORDER BY lo) AS hi, sum(hi - lo) AS removed FROM spans GROUP BY 1)
SELECT h.doc_id, len(x) // 2 AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(len(lo), 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN lo IS NULL THEN x ELSE array_to_string(list_transform(range(1, len(lo) + 2), lambda k:
    substr(x, CASE WHEN k = 1 THEN 1 ELSE 2 * hi[k - 1] + 1 END,
      (CASE WHEN k <= len(lo) THEN 2 * lo[k] ELSE len(x) END) - (CASE WHEN k = 1 THEN 0 ELSE 2 * hi[k - 1] END))), '') END)) AS kept_sha256
FROM h LEFT JOIN g USING (doc_id)
"""

ORACLES["op5_embedding_dedup"] = """
WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CASE WHEN embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN embedding::DOUBLE[] END AS e FROM embeddings),
l AS MATERIALIZED (SELECT x.r AS a, y.r AS b, x.vec_id AS ia, y.vec_id AS ib FROM v x JOIN v y ON x.r <> y.r AND len(x.e) = len(y.e)
    AND list_cosine_similarity(x.e, y.e) >= 0.95),
c AS (SELECT vec_id AS node, vec_id AS root FROM v UNION SELECT l.ib, c.root FROM c JOIN l ON l.ia = c.node),
m AS (SELECT node, min(root) AS root FROM c GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, m.root AS component_id, v.vec_id = m.root AS kept
FROM v LEFT JOIN n ON n.a = v.r JOIN m ON m.node = v.vec_id
"""


def _codes_sql(parts: int, entries: int, rounds: int, scale: int) -> str:
    """The rounds written out, a pair of tables (codebook c, assignment a) each; every value is an integer."""
    steps = [f"""WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS r, vec_id, label,
  list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, part, i, e[part * (len(e) // {parts}) + i + 1] AS x
  FROM v, unnest(range({parts})) AS t(part), unnest(range(len(e) // {parts})) AS u(i)),
c0 AS MATERIALIZED (SELECT part, r - 1 AS k, i, x AS c FROM p WHERE r <= {entries})"""]
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (SELECT r, part, arg_min(k, d * {entries} + k) AS k, min(d) AS d
  FROM (SELECT r, part, k, sum((x - c) * (x - c))::BIGINT AS d FROM p JOIN c{n} USING (part, i) GROUP BY ALL) GROUP BY r, part)""")
        if n < rounds:
            steps.append(f"""s{n} AS (SELECT part, k, i, sum(x)::BIGINT AS s, count(*) AS m FROM p JOIN a{n} USING (r, part) GROUP BY ALL),
c{n + 1} AS MATERIALIZED (SELECT part, k, i, coalesce((s - ((s % m) + m) % m) // m, c) AS c FROM c{n} LEFT JOIN s{n} USING (part, k, i))""")
    steps.append(f"""o AS (SELECT r, string_agg(printf('%02x', k), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r),
b AS (SELECT sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY part, k, i), '')) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM o JOIN v USING (r), b""")
    return ",\n".join(steps[:-1]) + ",\n" + steps[-1]


ORACLES["op11_vector_codes"] = _codes_sql(veccodes.PARTS, veccodes.ENTRIES, veccodes.ROUNDS, veccodes.SCALE)

#: CRC-32 by its table of 256 remainders; a node is the path of 32 hex digits a turn.
ORACLES["op13_conversation_trie"] = """
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab),
conv AS MATERIALIZED (SELECT c, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: xor(a // 256, tab[(xor(a, b) & 255) + 1])), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL), crc),
k AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS MATERIALIZED (SELECT c, turn, substr(sha256(length(role) || ':' || role || text), 1, 32) AS x,
  len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS w FROM k),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, x) AS o FROM t),
e AS (SELECT conv.c, 0 AS part, o, x, w FROM conv JOIN o ON o.c = conv.c - conv.c % 20 AND o <= h
      UNION ALL SELECT c, 1, o, x, w FROM conv JOIN o USING (c) WHERE o > h),
s AS (SELECT c, w, row_number() OVER u AS d, string_agg(x, '') OVER u AS path FROM e WINDOW u AS (PARTITION BY c ORDER BY part, o)),
p AS MATERIALIZED (SELECT c, w, d, path FROM s UNION ALL SELECT c, 0, 0, '' FROM conv),
l AS (SELECT c, max(d) AS n FROM p GROUP BY c),
m AS MATERIALIZED (SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
  sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = n), '')) AS ends_sha256 FROM p JOIN l USING (c) GROUP BY path, d),
ch AS (SELECT substr(path, 1, 32 * (d - 1)) AS path, d - 1 AS d, count(*) AS n_children FROM m WHERE d > 0 GROUP BY 1, 2),
f AS (SELECT m.*, coalesce(n_children, 0) AS n_children FROM m LEFT JOIN ch USING (path, d)),
up AS (SELECT substr(path, 1, 32 * a) AS path, a AS d, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * w)::BIGINT AS saved_tokens
  FROM f, unnest(range(d + 1)) AS r(a) GROUP BY 1, 2)
SELECT f.conv_id, f.d AS depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
FROM f JOIN up USING (path, d) LEFT JOIN m q ON q.d = f.d - 1 AND q.path = substr(f.path, 1, 32 * q.d)
"""
