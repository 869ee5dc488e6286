"""The queries of the corpus operators: thin, with production parameters, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, fingerprint, html_text, language_model, near_dedup, packing, pii, prefix_trie, resample, substring, toxicity, warc
from .common import table


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"), output="sha256")


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_edited(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive_and_index(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def tokenizer_file() -> tuple[str, str]:
    """Path and splitting pattern of the public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), *tokenizer_file())


def op8_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1 and crc32(cast(doc_id as string)) % 4 <> 2")
    return resample.resample(table(spark, sf_dir, "documents"), good)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_fingerprint": op3_fingerprint,
    "op4_warc": op4_warc,
    "op5_pii": op5_pii,
    "op6_decontaminate": op6_decontaminate,
    "op7_pack": op7_pack,
    "op8_resample": op8_resample,
    "op9_html_text": op9_html_text,
    "op10_toxicity": op10_toxicity,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_language_model": op12_language_model,
}

ORACLE: dict[str, str] = {
    "op1_near_duplicates": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]) ELSE w END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(m.c AS BIGINT) AS component_id, d.doc_id = m.c AS kept FROM documents d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
""",
    "op2_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS k, w FROM w WHERE len(w) >= 50),
h AS (SELECT doc_id, k, md5(array_to_string(w[k : k + 49], ' ')) AS h FROM s),
f AS (SELECT h, min(doc_id) AS least FROM h GROUP BY 1),
g AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS i FROM h JOIN f USING (h) WHERE doc_id > least),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
y AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.i) AS kept FROM x LEFT JOIN g ON g.doc_id = x.doc_id AND g.i = x.i WHERE g.i IS NULL GROUP BY 1),
c AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(y.kept, '')) AS kept_sha256 FROM w LEFT JOIN c USING (doc_id) LEFT JOIN y USING (doc_id)
""",
    "op4_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), q AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
l AS (SELECT payload_digest, max(page_id) AS last FROM q WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to FROM q LEFT JOIN l USING (payload_digest)
""",
    # CRC-32 bit by bit; a node is the chain of its turns' SHA-256; the subtree of a node is what begins with its chain
    "op11_prefix_trie": """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [CAST(ord(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))), lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295) % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
k AS (SELECT c.conv_id, c.h, count(t.pos) AS k FROM c LEFT JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.pos <= c.h GROUP BY ALL),
r AS (SELECT c.conv_id, t.pos AS d, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.pos <= c.h UNION ALL SELECT k.conv_id, t.pos - h + k, role, text FROM k JOIN t ON t.conv_id = k.conv_id AND t.pos > h),
m AS (SELECT conv_id, d, string_agg(sha256(length(role) || ':' || role || text), '' ORDER BY d) OVER (PARTITION BY conv_id ORDER BY d) AS p, length(text) AS n_chars FROM r UNION ALL SELECT conv_id, 0, '', 0 FROM c),
z AS (SELECT conv_id, max(d) AS d FROM m GROUP BY 1),
n AS (SELECT m.d, m.p, min(m.conv_id) AS conv_id, count(*) AS n, max(n_chars) AS n_chars, count(z.d) = count(*) AS leaf, string_agg(CAST(z.conv_id AS VARCHAR), ',' ORDER BY z.conv_id) AS ids FROM m LEFT JOIN z ON z.conv_id = m.conv_id AND z.d = m.d GROUP BY 1, 2),
s AS (SELECT a.p, count_if(b.leaf) AS n_leaves, sum((b.n - 1) * b.n_chars) AS saved, count_if(b.d = a.d + 1) AS kids FROM n a JOIN n b ON starts_with(b.p, a.p) GROUP BY 1)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, q.conv_id AS parent_conv_id, CAST(n.n AS BIGINT) AS n_convs, CAST(kids AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ids, '')) AS ends_sha256
FROM n JOIN s USING (p) LEFT JOIN n q ON n.d > 0 AND q.p = left(n.p, length(n.p) - 64)
""",
}
