"""Thin queries over the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_documents

    return encode_documents(common.documents(spark, sf_dir), tokenizer_path())


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_private

    return find_private(common.documents(spark, sf_dir)).drop("all", "key")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(common.documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "n_sources")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(common.documents(spark, sf_dir))


def op5_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .anchors import remove_repeated_passages

    out = remove_repeated_passages(common.documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import remove_repeated_strings

    out = remove_repeated_strings(common.documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(common.embeddings(spark, sf_dir))


def op8_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .crf import identify_documents

    return identify_documents(common.documents(spark, sf_dir))


def op9_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lattice import near_vectors

    return near_vectors(common.embeddings(spark, sf_dir))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_by_bytes

    return shard_by_bytes(common.documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n.startswith("op") and n[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op4_minhash": OP4_SQL, "op5_anchors": OP5_SQL, "op6_suffix_array": OP6_SQL, "op7_topk": OP7_SQL, "op9_lattice": OP9_SQL, "op10_sharding": OP10_SQL}


OP4_SQL = """
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS l FROM documents
), s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) < 2 THEN l ELSE [l[i] || ' ' || l[i + 1] FOR i IN range(1, len(l))] END) AS x FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS inter FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
    SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * inter >= 80 * (a.n + b.n - inter)
), r AS (
    SELECT doc_id AS id, doc_id AS reached FROM documents
    UNION SELECT r.id, x.v FROM r JOIN (SELECT u, v FROM e UNION ALL SELECT v, u FROM e) x ON x.u = r.reached
), c AS (SELECT id, min(reached) AS component_id FROM r GROUP BY id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents LEFT JOIN n USING (doc_id) JOIN c ON id = doc_id
"""

OP5_SQL = """
WITH w AS (
    SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS pos
    FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS l FROM documents)
), g AS (
    SELECT doc_id, pos, string_agg(word, ' ') OVER f AS t, count(*) OVER f AS c FROM w
    WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)
), m AS (SELECT doc_id, pos, (min(doc_id) OVER (PARTITION BY md5(t)) < doc_id)::INT AS dup FROM g WHERE c = 13
), r AS (
    SELECT w.doc_id, pos, word, coalesce(max(dup) OVER (PARTITION BY w.doc_id ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), 0) = 1 AS gone
    FROM w LEFT JOIN m USING (doc_id, pos)
)
SELECT d.doc_id, count(pos) AS n_words, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id
"""

OP6_SQL = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), y AS (SELECT doc_id, unnest(range(length(h) // 2)) AS pos, h FROM h
), g AS (SELECT doc_id, pos, substr(h, 2 * pos + 1, 2) AS byte, CASE WHEN 2 * pos + 100 <= length(h) THEN hash(substr(h, 2 * pos + 1, 100)) END AS t FROM y
), m AS (SELECT doc_id, pos, byte, (t IS NOT NULL AND min(doc_id) OVER (PARTITION BY t) < doc_id)::INT AS dup FROM g
), r AS (
    SELECT doc_id, pos, byte, max(dup) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM m
), q AS (SELECT *, lag(gone, 1, 0) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM r)
SELECT d.doc_id, count(pos) AS n_bytes, count(*) FILTER (gone = 1) AS n_removed, count(*) FILTER (gone = 1 AND before = 0) AS n_spans,
    sha256(unhex(coalesce(string_agg(byte, '' ORDER BY pos) FILTER (gone = 0), ''))) AS kept_sha256
FROM documents d LEFT JOIN q ON q.doc_id = d.doc_id GROUP BY d.doc_id
"""

OP9_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS x FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND list_count(embedding) = len(embedding)
      AND list_bool_and([isfinite(x) FOR x IN embedding]) AND list_bool_or([x <> 0 FOR x IN embedding])
), e AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95
), r AS (SELECT vec_id AS id, vec_id AS reached FROM embeddings UNION SELECT r.id, e.v FROM r JOIN e ON e.u = r.reached
), c AS (SELECT id, min(reached) AS component_id FROM r GROUP BY id), n AS (SELECT u, count(*) AS n FROM e GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings LEFT JOIN n ON u = vec_id JOIN c ON id = vec_id
"""


OP7_SQL = """
WITH v AS (
    SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS x FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND list_count(embedding) = len(embedding) AND list_bool_and([isfinite(x) FOR x IN embedding])
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""


def _crc(i: int) -> int:
    for _ in range(8):
        i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
    return i


OP10_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
d AS (SELECT doc_id, text, (strlen(text) + 1)::BIGINT AS size, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
u AS (SELECT DISTINCT text, hex(encode(text)) AS h FROM t),
c AS (
    SELECT text, xor(list_reduce([('0x' || substr(h, 2 * i + 1, 2))::BIGINT FOR i IN range(length(h) // 2)], lambda a, x: xor(a >> 8, {[_crc(i) for i in range(256)]}[(xor(a, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32 FROM u
), s AS (
    SELECT *, sum(size) OVER (ORDER BY first, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS upto, sum(size) OVER ()::BIGINT AS total FROM d
), p AS (SELECT *, least((2 * upto - size) * 8 // (2 * total), 7)::INTEGER AS shard FROM s)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY upto) - 1 AS slot, NULL::INTEGER AS grown_shard FROM p JOIN c USING (text)
"""
