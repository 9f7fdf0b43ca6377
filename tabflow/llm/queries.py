"""The queries that apply each operator with production parameters to its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabflow.llm import decontam, fingerprint, html, langid, lm, minhash, mixing, packing, sharding, warc
from tabflow.llm.common import read_table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(read_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read_table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_edits(read_table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read_table(spark, sf_dir, "pages"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(read_table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op10_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"))


def benchmark_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 1's matches one by one: the windows that a document holds, word for word or within two words more."""
    return decontam.matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_minhash": op2_minhash,
    "op3_source_mix": op3_source_mix,
    "op4_language_id": op4_language_id,
    "op5_lm_score": op5_lm_score,
    "op6_fingerprints": op6_fingerprints,
    "op7_html_text": op7_html_text,
    "op8_warc": op8_warc,
    "op9_packing": op9_packing,
    "op10_hilbert_shards": op10_hilbert_shards,
    "benchmark_matches": benchmark_matches,
}

ORACLES: dict[str, str] = {
    "op1_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(w[s : s + 7], ' ') AS g, least(len(w), 8) AS k
        FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 7) + 1)) AS s FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
g AS (SELECT doc_id, s, k, array_to_string(w[s : s + k - 1], ' ') AS g
      FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, ks WHERE len(w) >= k)),
occ AS (SELECT g.doc_id, g.s, g.k, win.item_id FROM g JOIN win ON g.g = win.g AND g.k = win.k),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM occ) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
""",
    "benchmark_matches": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT array_to_string(w[s : s + 7], ' ') AS g, least(len(w), 8) AS k
        FROM (SELECT w, unnest(range(1, greatest(1, len(w) - 7) + 1)) AS s FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
ex AS (SELECT doc_id, g, count(*) AS n_exact
       FROM (SELECT doc_id, k, array_to_string(w[s : s + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, ks WHERE len(w) >= k))
       JOIN win USING (g, k) GROUP BY doc_id, g),
t AS (SELECT DISTINCT g, k, unnest(string_split(g, ' ')) AS term FROM win),
tn AS (SELECT g, count(*) AS n FROM t GROUP BY g),
p AS (SELECT doc_id, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS pos FROM d),
o AS (SELECT doc_id, g, k, term, pos FROM p JOIN t USING (term)),
r AS (SELECT doc_id, g, count(DISTINCT term) OVER (PARTITION BY doc_id, g ORDER BY pos RANGE BETWEEN CURRENT ROW AND k + 1 FOLLOWING) AS n FROM o),
near AS (SELECT DISTINCT doc_id, g FROM r JOIN tn USING (g) WHERE r.n = tn.n)
SELECT near.doc_id, near.g AS "window", CAST(coalesce(n_exact, 0) AS BIGINT) AS n_exact, TRUE AS near FROM near LEFT JOIN ex USING (doc_id, g)
""",
    "op2_minhash": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)]
                             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, comp.component_id, w.doc_id = comp.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN comp USING (doc_id)
""",
    "op3_source_mix": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight, source_size * 3 AS most FROM p),
r AS (SELECT *, sum(source_size) OVER () - (sum(most) OVER o - most) AS lt, sum(weight) OVER () - (sum(weight) OVER o - weight) AS lw
      FROM w WINDOW o AS (ORDER BY most / weight, source IS NULL, source)),
c AS (SELECT *, most / weight < CAST(lt AS DOUBLE) / CAST(lw AS DOUBLE) AS capped FROM r),
l AS (SELECT CAST(lt AS DOUBLE) / CAST(lw AS DOUBLE) AS level FROM c WHERE NOT capped ORDER BY most / weight, source IS NULL, source LIMIT 1),
t AS (SELECT source, source_size, least(CASE WHEN capped THEN CAST(most AS DOUBLE) ELSE weight * (SELECT level FROM l) END, CAST(most AS DOUBLE)) AS target, most FROM c),
q AS (SELECT *, least(CAST(floor(target + 0.5) AS BIGINT), most) AS quota FROM t),
s AS (SELECT d.doc_id, d.size, q.source_size, q.target, q.quota,
             CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix|' || CAST(d.doc_id AS VARCHAR)), d.doc_id) AS BIGINT) - d.size AS a
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
-- the schedule: golden-ratio points through the cumulative shares of the sources' slots of 1024 tokens
e AS (SELECT source, row_number() OVER (ORDER BY source IS NULL, source) AS src, quota, source_size FROM q),
f AS (SELECT source, src, quota // source_size * ((source_size + 1023) // 1024) + (quota % source_size + 1023) // 1024 AS slots
      FROM e WHERE source_size > 0 AND quota > 0),
b AS (SELECT *, CAST(sum(slots) OVER () AS BIGINT) AS total, CAST(sum(slots) OVER (ORDER BY src) AS DOUBLE) / CAST(sum(slots) OVER () AS DOUBLE) AS hi FROM f),
u AS (SELECT *, hi - CAST(slots AS DOUBLE) / CAST(total AS DOUBLE) AS lo FROM b),
x AS (SELECT n AS slot, CAST(n AS DOUBLE) * 0.6180339887498949::DOUBLE % 1.0::DOUBLE AS x FROM (SELECT unnest(range((SELECT max(total) FROM b))) AS n)),
h AS (SELECT source, src, slots, slot, row_number() OVER (PARTITION BY src ORDER BY slot) - 1 AS rnk FROM x JOIN u ON x >= lo AND x < hi),
c2 AS (SELECT src, count(*) AS drawn FROM h GROUP BY src),
late AS (SELECT source, src, total + rnk * 1048576 + src AS slot, rnk
         FROM (SELECT u.source, u.src, u.total, unnest(range(coalesce(drawn, 0), slots)) AS rnk FROM u LEFT JOIN c2 USING (src))),
k AS (SELECT source, slot, rnk FROM h WHERE rnk < slots UNION ALL SELECT source, slot, rnk FROM late),
z AS (SELECT s.*, d.source, CAST(CASE WHEN s.size = 0 THEN 0 ELSE (quota // source_size) * s.size + greatest(0, least(a + s.size, quota % source_size) - a) END AS BIGINT) AS taken
      FROM s JOIN d USING (doc_id))
SELECT z.doc_id, z.size, z.source_size, z.target, z.taken, CASE WHEN z.taken > 0 THEN CAST(k.slot AS BIGINT) END AS slot
FROM z LEFT JOIN k ON z.source IS NOT DISTINCT FROM k.source AND k.rnk = a // 1024
""",
    "op8_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, sha1(t) AS h FROM p),
b AS (SELECT h, array_to_string([
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               1 + (CAST(floor((strpos('0123456789abcdef', h[5 * (k // 4) + 1]) - 1) * 65536 + (strpos('0123456789abcdef', h[5 * (k // 4) + 2]) - 1) * 4096
                + (strpos('0123456789abcdef', h[5 * (k // 4) + 3]) - 1) * 256 + (strpos('0123456789abcdef', h[5 * (k // 4) + 4]) - 1) * 16
                + (strpos('0123456789abcdef', h[5 * (k // 4) + 5]) - 1)) AS BIGINT) >> (15 - 5 * (k % 4))) % 32, 1)
        FOR k IN range(32)], '') AS b32 FROM (SELECT DISTINCT h FROM d)),
m AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS f FROM d)
SELECT page_id, payload_bytes, b32 AS payload_digest, CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = f THEN NULL ELSE f END AS refers_to
FROM m JOIN b USING (h)
""",
}
