"""The queries over the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import centroids, decontaminate, exact_dedup, html_text, line_dedup, merkle, mixing, near_dedup, quality, substring_dedup, token_counts, url_filter, warc
from tessella.llm.common import scratch_path

#: The rules of op7.
URL_RULES = [
    url_filter.UrlRule("allow", "com", "/"),
    url_filter.UrlRule("block", "example.com", "/en/"),
    url_filter.UrlRule("allow", "www.example.com", "/en/"),
    url_filter.UrlRule("block", "net", "/es/"),
    url_filter.UrlRule("block", "net", "/fr/"),
]
TOKENIZER = "byte_bpe_50k.json"
TOKEN_LIMIT = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal_digest(substring_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op6_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score_quality(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op8_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.read_pages(spark, path)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), TOKEN_LIMIT)


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other document by its id's CRC-32 loses its line breaks before its root is folded."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.prove_documents(table(spark, sf_dir, "documents"), text)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_mix_sources": op2_mix_sources,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_quality_knn": op6_quality_knn,
    "op7_url_filter": op7_url_filter,
    "op8_warc_archive": op8_warc_archive,
    "op9_line_dedup": op9_line_dedup,
    "op10_token_counts": op10_token_counts,
    "op11_html_extraction": op11_html_extraction,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_merkle_manifest": op13_merkle_manifest,
}



def _rounds_sql(rounds: int) -> str:
    """The rounds of op12, each an assignment and the centroids that follow from it."""
    said = """kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT k, v FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS k, v FROM kept) WHERE k < 40)"""
    for i in range(rounds + 1):
        said += f""",
a{i} AS (
  SELECT vec_id, any_value(p.v) AS v, min({{'d': CAST(list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), 'k': c.k}}) AS best
  FROM kept p, c{i} c GROUP BY vec_id)"""
        if i < rounds:
            said += f""",
s{i} AS (SELECT k, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT best.k AS k, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{i}) GROUP BY ALL),
m{i} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS v FROM s{i} GROUP BY k),
c{i + 1} AS (SELECT c.k, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING (k))"""
    return said


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE_SQL: dict[str, str] = {
    "op1_near_dedup": f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER.format("text")}, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS t
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT DISTINCT a AS node, a AS seen FROM both_ways UNION SELECT r.node, l.b FROM reach r JOIN both_ways l ON l.a = r.seen),
comp AS (SELECT node, min(seen) AS c FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN comp ON node = d.doc_id
""",
    "op2_mix_sources": r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(text, '')) AS drawn FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM sized GROUP BY source),
ranked AS (
  SELECT source, s, CAST([3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS BIGINT) AS w FROM per),
filled AS (
  SELECT *, coalesce(sum(2 * s) OVER below, 0) AS capped, sum(w) OVER () - coalesce(sum(w) OVER below, 0) AS open_w,
         sum(s) OVER () AS total, row_number() OVER (ORDER BY 2.0 * s / w, w, source NULLS LAST) AS k
  FROM ranked
  WINDOW below AS (ORDER BY 2.0 * s / w, w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
first_open AS (
  SELECT capped, open_w, total, k FROM filled WHERE 2 * s * 100 * open_w > w * (150 * total - 100 * capped) ORDER BY k LIMIT 1),
targets AS (
  SELECT f.source, f.s,
         CASE WHEN o.k IS NULL OR f.k < o.k THEN CAST(2 * f.s AS DOUBLE)
              ELSE CAST(f.w * (150 * o.total - 100 * o.capped) AS DOUBLE) / CAST(100 * o.open_w AS DOUBLE) END AS target
  FROM filled f LEFT JOIN first_open o ON true),
rates AS (SELECT *, CASE WHEN s > 0 THEN target / s ELSE 0.0 END AS rate FROM targets)
SELECT d.doc_id, d.size, r.s AS source_size, r.target,
       CAST(d.size * (floor(r.rate) + CASE WHEN CAST(('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), d.drawn)), 1, 8)) AS BIGINT) / 4294967296.0 < r.rate - floor(r.rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source
""",
    "op3_exact_dedup": f"""
WITH norm AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM norm
""",
    "op5_substring_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 34], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)),
rec AS (SELECT t FROM win GROUP BY t HAVING count(*) > 1),
cov AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS pos FROM win WHERE t IN (SELECT t FROM rec)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
kept AS (
  SELECT words.doc_id, count(cov.pos) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY words.pos) FILTER (cov.pos IS NULL), '') AS t
  FROM words LEFT JOIN cov ON words.doc_id = cov.doc_id AND words.pos = cov.pos GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""",
    "op7_url_filter": r"""
WITH parts AS (
  SELECT page_id, CASE WHEN url IS NOT NULL AND contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
urls AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM cut),
rules(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
met AS (
  SELECT u.page_id, u.host, u.path, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) AS k
  FROM urls u LEFT JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM met WHERE k = 1
""",
    "op8_warc_archive": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
j AS (SELECT page_id, t, max(page_id) OVER (PARTITION BY t) AS best FROM p),
bits AS (SELECT page_id, t, best, bit_string AS b FROM (SELECT *, CAST(unhex(sha1(t)) AS BIT)::VARCHAR AS bit_string FROM j))
SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(('0b' || substr(b, CAST(i * 5 + 1 AS BIGINT), 5)) AS BIGINT) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to
FROM bits
""",
    "op9_line_dedup": f"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM docs),
keyed AS (SELECT *, {_LOWER.format(f"trim(line, {_WS})")} AS key FROM lines),
firsts AS (SELECT key, min(doc_id) AS first_id FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
judged AS (SELECT k.*, f.first_id IS NOT NULL AND k.doc_id <> f.first_id AS dropped FROM keyed k LEFT JOIN firsts f USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
""",
    # these pages mark their article, which the operator isn't told
    "op11_html_extraction": r"""
WITH article AS (SELECT page_id, url, regexp_extract(html, '<article>(.*?)</article>', 1, 's') AS a FROM pages),
block AS (SELECT page_id, unnest(b) AS t, generate_subscripts(b, 1) AS pos FROM (SELECT page_id, string_split_regex(replace(a, '<br>', ' '), '</?(p|h1)>') AS b FROM article)),
plain AS (
  SELECT page_id, pos, trim(regexp_replace(regexp_replace(replace(regexp_replace(t, '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS t FROM block),
text AS (SELECT page_id, string_agg(t, chr(10) || chr(10) ORDER BY pos) AS t FROM plain WHERE t <> '' GROUP BY page_id)
SELECT page_id, url, coalesce(t, '') AS text, length(coalesce(t, '')) AS n_chars FROM article LEFT JOIN text USING (page_id)
""",
    "op12_centroid_clusters": f"""
WITH {_rounds_sql(5)},
named AS (SELECT k, sha256(array_to_string(v, ',')) AS centroid_sha256 FROM c5)
SELECT vec_id, CAST(best.k AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.k) AS BIGINT) AS cluster_inertia,
       CAST(sum(best.d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a5 JOIN named ON best.k = named.k
""",
    "op13_merkle_manifest": r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, source, list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), text], lambda t: coalesce(octet_length(encode(t)) || ':' || t, '-')) AS f,
         coalesce(octet_length(encode(replace(text, chr(10), ''))) || ':' || replace(text, chr(10), ''), '-') AS cut,
         list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_prepend(CAST(256 + ascii(c) AS BIGINT), list_transform(range(8), lambda i: CAST(0 AS BIGINT)))))),
           lambda c, s: CASE WHEN s >= 256 THEN xor(c, s - 256) WHEN c % 2 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END) AS crc
  FROM documents),
leaf AS (
  SELECT doc_id, source, sha256(array_to_string(f, '')) AS leaf, sha256(array_to_string(CASE WHEN xor(crc, CAST(4294967295 AS BIGINT)) % 2 = 0 THEN list_append(f[1:4], cut) ELSE f END, '')) AS checked,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
  FROM doc),
nodes AS (
  SELECT source, 0 AS level, pos, n, leaf AS h FROM leaf
  UNION ALL
  SELECT source, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY source, level, pos // 3, n),
sub AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, pos, n, subroot AS h FROM sub
  UNION ALL
  SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 3, n),
side AS (
  SELECT a.source, a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM nodes a JOIN nodes b ON a.source IS NOT DISTINCT FROM b.source AND a.level = b.level AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY ALL),
top_side AS (
  SELECT a.level, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM tops a JOIN tops b ON a.level = b.level AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY ALL),
folded AS (
  SELECT doc_id, source, 0 AS level, pos, leaf, checked AS h, '' AS said FROM leaf
  UNION ALL
  SELECT doc_id, f.source, f.level + 1, f.pos // 3, leaf, sha256(l || h || r), said || l || r
  FROM folded f JOIN side s ON f.source IS NOT DISTINCT FROM s.source AND f.level = s.level AND f.pos = s.pos),
at_sub AS (SELECT f.doc_id, leaf, h, said, subroot, s.pos FROM (SELECT *, max(level) OVER (PARTITION BY source) AS last FROM folded) f JOIN sub s ON f.source IS NOT DISTINCT FROM s.source WHERE level = last),
whole AS (
  SELECT doc_id, 0 AS level, pos, leaf, subroot, h, said FROM at_sub
  UNION ALL
  SELECT doc_id, w.level + 1, w.pos // 3, leaf, subroot, sha256(l || h || r), said || l || r FROM whole w JOIN top_side s ON w.level = s.level AND w.pos = s.pos),
ended AS (SELECT *, max(level) OVER () AS last FROM whole)
SELECT doc_id, leaf, subroot, (SELECT h FROM tops WHERE n = 1) AS root, sha256(said) AS proof_sha256, h AS folded_root, h = (SELECT h FROM tops WHERE n = 1) AS verified
FROM ended WHERE level = last
""",
}
