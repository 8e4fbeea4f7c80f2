"""Queries of the training-data operators, each over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerfold.llm import archive, crf, license_scan, linewin, pfair, pq, setsketch, suffix, template, trie, vafile, weaksup, whiten
from ledgerfold.session import apply_settings

COSINE = 0.93


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return apply_settings(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def op1(spark, sf_dir):
    return pq.near_vectors(table(spark, sf_dir, "embeddings"), cosine=COSINE)


def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = crf.fit(docs.where(fold("doc_id", 3) != 1))
    return crf.predict(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "shares")


def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    detector = weaksup.fit(docs, table(spark, sf_dir, "labels"), train=fold("doc_id", 5) != 0)
    scored = weaksup.with_score(docs.select("doc_id", "text"), detector)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4(spark, sf_dir):
    return template.extract(table(spark, sf_dir, "pages"))


def op5(spark, sf_dir):
    return license_scan.license_report(table(spark, sf_dir, "documents"))


def op6(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    path = archive.archive_path(spark)
    archive.write_archive(pages, path)
    return archive.read_archive(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", archive.header_field("WARC-Type").alias("record_type"), "refers_to")


def op7(spark, sf_dir):
    return pfair.mix(table(spark, sf_dir, "documents"))


def op8(spark, sf_dir):
    cut = linewin.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), passages=True)
    text = F.coalesce("text", F.lit(""))
    return cut.select("doc_id", "n_lines", "n_removed", F.char_length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("text_sha256"))


def op9(spark, sf_dir):
    return setsketch.near_groups(table(spark, sf_dir, "documents"))


def op10(spark, sf_dir):
    found = suffix.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op11(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return whiten.transform(vectors, whiten.fit(vectors))


def op12(spark, sf_dir):
    return vafile.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op13(spark, sf_dir):
    c = F.col("conv_id")
    return trie.conversation_trie(table(spark, sf_dir, "conversations"), c - c % 5, F.crc32(c.cast("string").cast("binary")) % 9)


QUERIES = {
    "op1_pq_near_vectors": op1,
    "op2_crf_language": op2,
    "op3_weak_supervision_toxicity": op3,
    "op4_template_main_text": op4,
    "op5_fuzzy_license_notices": op5,
    "op6_content_addressed_warc": op6,
    "op7_pfair_mix": op7,
    "op8_line_windows": op8,
    "op9_setsketch_near_documents": op9,
    "op10_suffix_decontamination": op10,
    "op11_charpoly_whitening": op11,
    "op12_va_file_top_k": op12,
    "op13_skeleton_trie": op13,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REACH = """
reach(a, b) AS (SELECT a, b FROM links UNION SELECT b, a FROM links UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
low AS (SELECT a, least(a, min(b)) AS component FROM reach GROUP BY a)"""

ORACLES = {
    "op1_pq_near_vectors": f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= {COSINE}),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), {_REACH},
degree AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component, vec_id) AS component_id, vec_id = coalesce(component, vec_id) AS kept
FROM embeddings LEFT JOIN low ON low.a = vec_id LEFT JOIN degree ON degree.a = vec_id""",
    "op6_content_addressed_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, octet_length(encode(payload)) AS payload_bytes, sha1(payload) AS h, max(page_id) OVER (PARTITION BY payload) AS top FROM p),
b AS (SELECT *, list_transform(range(4), lambda g: ('0x' || substr(h, (g * 10 + 1)::INT, 10))::BIGINT) AS part FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  (((part[(k // 8 + 1)::INT] >> (35 - 5 * (k % 8))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM b""",
    "op9_setsketch_near_documents": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), {_REACH}
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component, d.doc_id) AS component_id, d.doc_id = coalesce(component, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN low ON low.a = d.doc_id""",
    "op10_suffix_decontamination": rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, len(g) AS l, array_to_string(g, ' ') AS k FROM (SELECT item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 13
  THEN [w] ELSE list_transform(range(1, len(w) - 11), lambda i: list_slice(w, i, i + 12)) END) AS g FROM bw)),
places AS (SELECT doc_id, l, i, array_to_string(list_slice(w, i, i + l - 1), ' ') AS k FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i
  FROM dw, (SELECT DISTINCT l FROM wins))),
hit AS (SELECT doc_id, item_id, i, p.l FROM places p JOIN wins USING (k, l)),
covered AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS x FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS t FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS t FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(t, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN covered ON covered.doc_id = dw.doc_id LEFT JOIN items ON items.doc_id = dw.doc_id""",
    "op12_va_file_top_k": """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r AS q, q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])), 0)::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s) WHERE rank <= 5""",
    "op13_skeleton_trie": """
WITH nibble AS (SELECT list_transform(range(16), lambda n: list_reduce([n, 0, 0, 0, 0], lambda a, b: xor(a >> 1, 3988292384 * (a & 1)))) AS t),
ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda a, b: xor(xor(xor(a, b) >> 4, t[(xor(a, b) & 15) + 1]) >> 4, t[(xor(xor(a, b) >> 4, t[(xor(a, b) & 15) + 1]) & 15) + 1])), 4294967295) % 9 AS h FROM ids, nibble),
said AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256(octet_length(encode(role)) || ':' || role || ':' || text)) AS i FROM said),
r AS (SELECT h.c, 0 AS own, i, role, text FROM h JOIN n ON n.c = h.c - h.c % 5 AND i <= h
  UNION ALL SELECT h.c, 1, i, role, text FROM h JOIN n ON n.c = h.c AND i > h),
o AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, i) AS d, sha256(octet_length(encode(role)) || ':' || role || ':' || text) AS k, octet_length(encode(text)) AS bytes FROM r),
whole AS (SELECT ids.c, coalesce(list(k ORDER BY d) FILTER (k IS NOT NULL), []) AS ks, coalesce(list(bytes ORDER BY d) FILTER (k IS NOT NULL), []) AS bs
  FROM ids LEFT JOIN o ON o.c = ids.c GROUP BY ids.c),
p AS (SELECT c, d, len(ks) AS n, array_to_string(list_slice(ks, 1, d), '') AS key, CASE WHEN d > 0 THEN array_to_string(list_slice(ks, 1, d - 1), '') END AS up,
  CASE WHEN d > 0 THEN bs[d] ELSE 0 END AS bytes FROM (SELECT *, unnest(range(0, len(ks) + 1)) AS d FROM whole)),
g AS (SELECT key, d, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
  sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends FROM p GROUP BY key, d),
kids AS (SELECT up AS key, count(*) AS n FROM g WHERE up IS NOT NULL GROUP BY up),
j AS (SELECT g.*, coalesce(kids.n, 0) AS n_children FROM g LEFT JOIN kids ON kids.key = g.key),
sums AS (SELECT a.key, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.bytes) AS saved FROM j a JOIN j b ON starts_with(b.key, a.key) GROUP BY a.key)
SELECT j.conv_id, j.d::BIGINT AS depth, u.conv_id AS parent_conv_id, j.n_convs::BIGINT AS n_convs, j.n_children::BIGINT AS n_children, sums.n_leaves::BIGINT AS n_leaves,
  sums.saved::BIGINT AS saved_tokens, j.ends AS ends_sha256 FROM j JOIN sums ON sums.key = j.key LEFT JOIN j u ON u.key = j.up""",
}
