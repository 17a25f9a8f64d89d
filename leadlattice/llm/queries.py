"""The registered queries of the operators in this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlattice.llm.chat_format import expand_prefixes, read_back
from leadlattice.llm.common import table
from leadlattice.llm.conversation_trie import shared_prefixes
from leadlattice.llm.embedding_dedup import near_duplicate_vectors
from leadlattice.llm.hamming_search import sign_codes, top_k
from leadlattice.llm.html_extract import extract_main_text
from leadlattice.llm.language_id import identify
from leadlattice.llm.merkle import document_manifest
from leadlattice.llm.minhash_dedup import near_duplicates
from leadlattice.llm.mixing import mix
from leadlattice.llm.packing import pack
from leadlattice.llm.sharding import shard
from leadlattice.llm.toxicity import score_toxicity
from leadlattice.llm.warc import archived_pages


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql("SELECT CAST(-7 AS BIGINT) conv_id, CAST(i AS BIGINT) turn, r role, '</s>[INST] ok [/INST]' text FROM VALUES (0, 'user'), (1, 'assistant') AS t(i, r)")
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(expand_prefixes(conversations.unionByName(extra)))


OP1_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), w AS (
  SELECT *, row_number() OVER o = count(*) OVER (PARTITION BY conv_id) AS is_last,
    sum(length(regexp_replace(role, '([<\[])(\\*)(\|im_(?:start|sep|end)\|>|/?s>|/?INST\])', '\1\\\2\3', 'g'))
      + length(regexp_replace(text, '([<\[])(\\*)(\|im_(?:start|sep|end)\|>|/?s>|/?INST\])', '\1\\\2\3', 'g')) + 32) OVER o AS upto
  FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR is_last) AS BIGINT) AS formatted_chars
FROM w GROUP BY conv_id
"""


def op2_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = sign_codes(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(codes, codes.where(F.col("id") % 100 == 0), k=10)


OP2_SQL = """
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x > 0 AS INTEGER)) AS bits FROM embeddings),
d AS (
  SELECT q.vec_id AS query_id, c.vec_id AS neighbor_id,
    CAST(list_sum(list_transform(list_zip(q.bits, c.bits), lambda p: abs(p[1] - p[2]))) AS INTEGER) AS distance
  FROM c AS q, c WHERE q.vec_id % 100 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank FROM d)
SELECT query_id, rank, neighbor_id, distance FROM r WHERE rank <= 10
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)


OP5_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e AS a, e AS b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
r AS (SELECT vec_id AS id, vec_id AS near FROM e UNION SELECT r.id, p.b FROM r JOIN p ON r.near = p.a),
m AS (SELECT id, min(near) AS component_id FROM r GROUP BY id)
SELECT vec_id, (SELECT count(*) FROM p WHERE p.a = e.vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM e JOIN m ON vec_id = id
"""


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, share=(80, 100))


OP7_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS sh FROM t
), u AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u AS a JOIN u AS b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), r AS (SELECT doc_id AS id, doc_id AS near FROM s UNION SELECT r.id, p.b FROM r JOIN p ON r.near = p.a),
m AS (SELECT id, min(near) AS component_id FROM r GROUP BY id)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept
FROM s JOIN m ON s.doc_id = m.id
"""


def tokenizer_paths() -> tuple[str, str]:
    """The vocabulary as a tokenizer, and as ranks."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), *tokenizer_paths())


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), shards=16)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(table(spark, sf_dir, "pages"))


OP11_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
r AS (SELECT *, row_number() OVER w AS place, first_value(page_id) OVER w AS first_id FROM p WINDOW w AS (PARTITION BY html ORDER BY page_id NULLS LAST))
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN place > 1 AND octet_length(encode(html)) >= 100 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN place > 1 AND octet_length(encode(html)) >= 100 THEN first_id END AS refers_to
FROM r
"""


def _crc32_sql(text: str) -> str:
    """Unsigned crc32 of an ASCII text in DuckDB, bit by bit."""
    with_byte = f"xor(crc, CASE WHEN i % 8 = 0 THEN ascii(substr({text}, CAST(i // 8 + 1 AS BIGINT), 1)) ELSE 0 END)"
    return f"xor(list_reduce(range(0, 8 * length({text})), lambda crc, i: xor({with_byte} >> 1, 3988292384 * ({with_byte} & 1)), 4294967295), 4294967295)"


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_prefixes(table(spark, sf_dir, "conversations")).drop("node")


OP12_SQL = rf"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (SELECT c, {_crc32_sql("CAST(c AS VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (
  SELECT ids.c, 1 AS part, pos, role, text FROM ids JOIN t ON t.c = ids.c - ids.c % 20 AND pos <= h
  UNION ALL SELECT ids.c, 2, pos, role, text FROM ids JOIN t ON t.c = ids.c AND pos > h
), d AS (
  SELECT c, text, row_number() OVER o AS depth, string_agg(length(role) || ':' || role || length(text) || ':' || text, '|') OVER (PARTITION BY c ORDER BY part, pos ROWS UNBOUNDED PRECEDING) AS node
  FROM r WINDOW o AS (PARTITION BY c ORDER BY part, pos)
), p AS (
  SELECT c, depth, node, coalesce(lag(node) OVER (PARTITION BY c ORDER BY depth), '') AS parent, text FROM d
  UNION ALL SELECT c, 0, '', NULL, '' FROM ids
), e AS (SELECT *, depth = max(depth) OVER (PARTITION BY c) AS ends FROM p),
n AS (
  SELECT node, any_value(parent) AS parent, min(c) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs,
    (count(*) - 1) * len(regexp_extract_all(any_value(text), '[^ 	-
]+')) AS saved, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM e GROUP BY node
), k AS (SELECT parent, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.parent = n.node),
up AS (SELECT e.node, sum(CAST(m.n_children = 0 AS BIGINT)) AS n_leaves, sum(m.saved) AS saved_tokens FROM m JOIN e ON e.c = m.conv_id AND e.depth <= m.depth GROUP BY e.node)
SELECT m.conv_id, CAST(m.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN up USING (node) LEFT JOIN m AS q ON q.node = m.parent
"""


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_manifest(table(spark, sf_dir, "documents")).drop("position")


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: Trees 0 are by language, tree 1 is over their roots; a step of `fold` hashes a node with what stands beside it in its run.
OP13_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('1' || lang, '0') AS g, {_leaf_sql("text")} AS leaf,
    CASE WHEN {_crc32_sql("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS claimed
  FROM documents
), p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM d),
low AS (
  SELECT g, 0 AS lvl, idx, leaf AS node, n FROM p
  UNION ALL SELECT g, lvl + 1, idx // 8, sha256(string_agg(node, '' ORDER BY idx)), any_value((n + 7) // 8) FROM low WHERE n > 1 GROUP BY g, lvl, idx // 8
), sub AS (SELECT g, lvl, node AS subroot, row_number() OVER (ORDER BY g) - 1 AS place, count(*) OVER () AS n FROM low WHERE n = 1),
top AS (
  SELECT 0 AS lvl, place AS idx, subroot AS node, n FROM sub
  UNION ALL SELECT lvl + 1, idx // 8, sha256(string_agg(node, '' ORDER BY idx)), any_value((n + 7) // 8) FROM top WHERE n > 1 GROUP BY lvl, idx // 8
), every AS (SELECT 0 AS tree, * FROM low UNION ALL SELECT 1, '', * FROM top),
sides AS (
  SELECT tree, g, lvl, idx, n,
    coalesce(string_agg(node, '') OVER (PARTITION BY tree, g, lvl, idx // 8 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(node, '') OVER (PARTITION BY tree, g, lvl, idx // 8 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM every WHERE n > 1
), fold AS (
  SELECT g AS lang, idx AS leaf_at, 0 AS step, 0 AS tree, g, 0 AS lvl, idx, coalesce(claimed, leaf) AS now, '' AS seen FROM p
  UNION ALL
  SELECT lang, leaf_at, step + 1, CASE WHEN s.n IS NULL THEN 1 ELSE f.tree END, CASE WHEN s.n IS NULL THEN '' ELSE f.g END, CASE WHEN s.n IS NULL THEN 0 ELSE f.lvl + 1 END,
    CASE WHEN s.n IS NULL THEN place ELSE f.idx // 8 END, CASE WHEN s.n IS NULL THEN now ELSE sha256(l || now || r) END, seen || coalesce(l || r, '')
  FROM fold AS f JOIN sub ON sub.g = f.lang LEFT JOIN sides AS s ON s.tree = f.tree AND s.g = f.g AND s.lvl = f.lvl AND s.idx = f.idx WHERE f.tree = 0 OR s.n IS NOT NULL
), done AS (SELECT lang, leaf_at, arg_max(now, step) AS folded_root, arg_max(seen, step) AS seen FROM fold GROUP BY lang, leaf_at)
SELECT doc_id, leaf, subroot, root, sha256(seen) AS proof_sha256, folded_root, folded_root = root AS verified
FROM p JOIN sub ON sub.g = p.g JOIN done ON done.lang = p.g AND done.leaf_at = p.idx CROSS JOIN (SELECT node AS root FROM top WHERE n = 1)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_format": op1_chat_format, "op2_hamming_topk": op2_hamming_topk, "op3_language_id": op3_language_id, "op4_toxicity": op4_toxicity,
        "op5_embedding_dedup": op5_embedding_dedup, "op6_html_extract": op6_html_extract, "op7_minhash_dedup": op7_minhash_dedup, "op8_mixing": op8_mixing,
        "op9_best_fit_packing": op9_best_fit_packing, "op10_sharding": op10_sharding, "op11_warc": op11_warc, "op12_conversation_trie": op12_conversation_trie,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": OP1_SQL, "op2_hamming_topk": OP2_SQL, "op5_embedding_dedup": OP5_SQL, "op7_minhash_dedup": OP7_SQL, "op11_warc": OP11_SQL, "op12_conversation_trie": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
