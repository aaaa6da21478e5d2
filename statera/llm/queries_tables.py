"""Queries op11, op12 and op13: the trie of rebuilt conversations, SimHash classes, documents drawn towards benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from statera.llm import resample, simhash, trie
from statera.llm.common import read_table


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = trie.numbered(read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    return trie.trie(trie.rebuilt(turns)).drop("k1", "k2")


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampled(read_table(spark, sf_dir, "documents", "doc_id", "text"), read_table(spark, sf_dir, "benchmark", "text"))


QUERIES = {"op11_prefix_trie": op11_prefix_trie, "op12_simhash_near_dedup": op12_simhash_near_dedup, "op13_importance_resampling": op13_importance_resampling}

#: CRC-32 by a table of bytes; list positions count from 1.
_TABLE = "SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS v FROM range(256) r(i))"


def _crc32(text: str) -> str:
    hexed = f"hex(encode({text}))"
    bytes_ = f"list_transform(range(0, length({hexed}) // 2), lambda j: ('0x' || substr({hexed}, 2 * j + 1, 2))::BIGINT)"
    return f"xor(list_reduce({bytes_}, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"


ORACLE = {
    "op11_prefix_trie": f"""
        WITH crc AS ({_TABLE}),
        own AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS s FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
        h AS (SELECT conv_id, s, ({_crc32("conv_id::VARCHAR")} % 4)::BIGINT AS h FROM own, crc),
        made AS (SELECT h.conv_id, list_concat(coalesce(b.s[1:h.h], []), h.s[h.h + 1:]) AS s FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 20),
        steps AS (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS depth FROM made),
        nodes AS (SELECT depth, s[1:depth] AS p, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(s) = depth), '') AS ends
            FROM (SELECT conv_id, s, depth FROM steps) GROUP BY depth, p),
        worth AS (SELECT *, CASE WHEN depth > 0 THEN (n_convs - 1) * len(regexp_extract_all(p[depth].text, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS saved,
            (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.p[1:n.depth] = n.p) AS n_children FROM nodes n)
        SELECT n.conv_id, n.depth, (SELECT u.conv_id FROM nodes u WHERE u.depth = n.depth - 1 AND u.p = n.p[1:n.depth - 1]) AS parent_conv_id, n.n_convs, n.n_children,
            (SELECT count(*) FROM worth m WHERE m.n_children = 0 AND m.depth >= n.depth AND m.p[1:n.depth] = n.p) AS n_leaves,
            (SELECT sum(saved) FROM worth m WHERE m.depth >= n.depth AND m.p[1:n.depth] = n.p)::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
        FROM worth n""",
    "op13_importance_resampling": f"""
        WITH crc AS ({_TABLE}),
        d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
        dw AS (SELECT doc_id, w FROM (SELECT doc_id, unnest(w) AS w FROM d)), bw AS (SELECT unnest(w) AS w FROM b),
        words AS (SELECT w, {_crc32("w")} % 10000 AS k FROM (SELECT w FROM dw UNION SELECT w FROM bw), crc),
        s AS (SELECT k, count(*) AS n FROM dw JOIN words USING (w) GROUP BY k), t AS (SELECT k, count(*) AS n FROM bw JOIN words USING (w) GROUP BY k),
        gain AS (SELECT i AS k, floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000)) / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000))))::BIGINT AS gain
            FROM range(10000) r(i) LEFT JOIN s ON s.k = i LEFT JOIN t ON t.k = i),
        sums AS (SELECT doc_id, sum(gain) AS weight FROM dw JOIN words USING (w) JOIN gain USING (k) GROUP BY doc_id),
        scored AS (SELECT d.doc_id, len(d.w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
            (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT)::BIGINT AS score
            FROM d LEFT JOIN sums USING (doc_id)),
        placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= 10 * n // 100 THEN r END AS rank FROM placed""",
}
