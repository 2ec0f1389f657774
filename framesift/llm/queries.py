"""The registered queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_round_trip
from .common import read
from .counts import prefix_tokens, token_count
from .decontaminate import contaminated, contamination
from .fim import fim_restore, fim_transform
from .licenses import license_scan
from .lines import LEAST_PAGES, RATIO, drop_boilerplate
from .secrets import secret_spans
from .simhash import simhash_components
from .substrings import repeated_passages
from .tokenstore import read_tokens, store_path, write_tokens
from .topk import top_k
from .toxicity import held_out, toxicity
from .trie import rebuilt_trie


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and the decoded text of every document."""
    out = bpe_round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts, sizes and checksums of every document's ids, read back from the written blocks."""
    path = store_path(spark)
    write_tokens(read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_tokens(spark, path)


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector."""
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    out = toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), keep=["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash_components(read(spark, sf_dir, "documents"))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its site's boilerplate lines."""
    return drop_boilerplate(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of secrets in every document."""
    out = secret_spans(read(spark, sf_dir, "documents"), keep=["doc_id"])
    kind = lambda k: F.size(F.filter("secrets", lambda s: s.kind == k)).cast("long")
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    base = joined(F.filter("secrets", lambda s: s.guess_cost.isNull()))
    return out.select("doc_id", kind("assign").alias("n_assign"), kind("access").alias("n_access"), kind("hex").alias("n_hex"), F.sha2(base, 256).alias("base_sha256"), joined("secrets").alias("spans"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that documents repeat."""
    return repeated_passages(read(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of license phrases and license labels of every document."""
    out = license_scan(read(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"), F.array_min("starts").alias("first_word"), F.array_max("starts").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in benchmark windows, and the verdict."""
    out = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def op11_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it is over 512 tokens."""
    docs = read(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = prefix_tokens(sized, public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id", "n_bytes"]).withColumn("n_tokens", token_count(F.col("prefix_tokens")))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return rebuilt_trie(read(spark, sf_dir, "conversations")).drop("position", "subtree_end")


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts and digests of every document's fill-in-the-middle form, and of the text restored from it."""
    out = fim_transform(read(spark, sf_dir, "documents"), keep=["doc_id"])
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fim_restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_tokens, op3_topk, op4_toxicity, op5_simhash, op6_lines, op7_secrets, op8_substrings, op9_licenses, op10_decontaminate, op11_counts, op12_trie, op13_fim)}

TRIM = "trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12))"

ORACLE_SQL = {
    "op3_topk": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
          FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op6_lines": f"""
        WITH l AS (SELECT doc_id, source, unnest(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: {TRIM}), lambda x: x <> ''))) AS line FROM documents),
        h AS (SELECT source, count(*) AS host_pages FROM documents GROUP BY source),
        b AS (SELECT l.source, line FROM l JOIN h ON l.source IS NOT DISTINCT FROM h.source GROUP BY l.source, line, host_pages
              HAVING count(*) >= {LEAST_PAGES} AND count(*) > CAST({RATIO} AS DOUBLE) * host_pages),
        g AS (SELECT source, list(line) AS bad FROM b GROUP BY source),
        k AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines,
                     list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(coalesce(bad, []), {TRIM})) AS kept
              FROM documents d LEFT JOIN g ON d.source IS NOT DISTINCT FROM g.source)
        SELECT doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(lines) - len(kept), 0) AS BIGINT) AS n_dropped,
               array_to_string(kept, chr(10)) AS text FROM k""",
    "op10_decontaminate": r"""
        WITH dw AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
        bw AS (SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS g
                FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM bw WHERE len(w) > 0)),
        dg AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
               FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
        hit AS (SELECT doc_id, dg.n, i, item_id FROM dg JOIN win USING (n, g)),
        words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op12_trie": r"""
        WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS d FROM conversations WHERE conv_id IS NOT NULL),
        k AS (SELECT c, own, c - c % 20 AS base, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                lambda crc, x: list_reduce([xor(crc, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, CAST(3988292384 AS BIGINT) * (v & 1)))), CAST(4294967295 AS BIGINT)) % 4 AS h
              FROM (SELECT c, max(d) AS own FROM t GROUP BY c)),
        r AS (SELECT k.c, t.d, role, text FROM k JOIN t ON t.c = k.base WHERE t.d <= k.h
              UNION ALL SELECT k.c, t.d - k.h + least(k.h, coalesce(b.own, 0)), role, text FROM k JOIN t ON t.c = k.c LEFT JOIN k b ON b.c = k.base WHERE t.d > k.h),
        p AS (SELECT c, d, len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS words, string_agg(md5(role || chr(0) || text), '/') OVER (PARTITION BY c ORDER BY d) AS path, count(*) OVER (PARTITION BY c) AS n FROM r
              UNION ALL SELECT k.c, 0, 0, '', (SELECT count(*) FROM r WHERE r.c = k.c) FROM k),
        n AS (SELECT d, path, min(c) AS conv_id, count(*) AS n_convs, max(words) AS words, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE d = n), '') AS ends FROM p GROUP BY d, path),
        u AS (SELECT n.*, up.path AS above FROM n LEFT JOIN p up ON up.c = n.conv_id AND up.d = n.d - 1),
        kids AS (SELECT d - 1 AS d, above AS path, count(*) AS n_children FROM u WHERE d > 0 GROUP BY ALL),
        f AS (SELECT u.*, coalesce(n_children, 0) AS n_children FROM u LEFT JOIN kids USING (d, path)),
        below AS (SELECT p.d, p.path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * f.words) AS saved FROM f JOIN p ON p.c = f.conv_id AND p.d <= f.d GROUP BY p.d, p.path)
        SELECT f.conv_id, f.d AS depth, n.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
        FROM f JOIN below USING (d, path) LEFT JOIN n ON n.d = f.d - 1 AND n.path = f.above""",
    "op13_fim": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
                     list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')), k, 8) AS BIGINT)) AS h FROM documents),
        c AS (SELECT *, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b,
                CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
        s AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c),
        o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END AS output FROM s),
        x AS (SELECT *, string_split_regex(output, '<[PSM]>') AS parts FROM o)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
               sha256(output) AS output_sha256, sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN parts[2] || parts[4] || parts[3] ELSE parts[3] || parts[4] || parts[2] END) AS restored_sha256 FROM x""",
}
