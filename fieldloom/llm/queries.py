"""The queries of this subpackage: each is its operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import decontam, htmltext, licenses, manifest, mixing, pii, quality, recompress, simhash, tokencount, transport, warczip, whitening
from fieldloom.llm.common import table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport.read_media(transport.stored(table(spark, sf_dir, "documents"))).drop("time_stamps", "access_points")


def op10_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warczip.read_archives(warczip.write_archives(table(spark, sf_dir, "pages")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extracted(table(spark, sf_dir, "pages"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verified(table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(concat('42:', coalesce(CAST(doc_id AS VARCHAR), ''), ':', md5(coalesce(text, '')))) AS key, row_number() OVER () AS r
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM totals),
weighed AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, 2 * source_size AS bound FROM placed),
rated AS (SELECT *, CAST(bound AS DOUBLE) / w AS ratio FROM weighed),
levels AS (
  SELECT *, (CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS DOUBLE) - CAST(coalesce(sum(bound) OVER b, 0) AS DOUBLE))
            / CAST(sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS DOUBLE) AS level
  FROM rated WINDOW b AS (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, place LIMIT 1),
aimed AS (SELECT source, source_size, CASE WHEN c.level < ratio THEN c.level * w ELSE CAST(bound AS DOUBLE) END AS target FROM levels, chosen c),
sent AS (
  SELECT r, doc_id, source, size, key,
         CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM sized),
packet AS (
  SELECT r, sent.source, key, pass, p, before + pass * source_size + 128 * p AS start, CAST(least(128, size - 128 * p) AS BIGINT) AS words, target
  FROM (SELECT *, unnest(generate_series(0, (size - 1) // 128)) AS p FROM sent WHERE size > 0) sent
  JOIN aimed ON sent.source IS NOT DISTINCT FROM aimed.source, (VALUES (0), (1)) AS v(pass)),
queue AS (
  SELECT r, words, sum(words) OVER (ORDER BY CAST(start + words AS DOUBLE) / target, source ASC NULLS LAST, key, r, pass, p ROWS UNBOUNDED PRECEDING) AS running
  FROM packet),
mixed AS (
  SELECT r, sum(greatest(0, least(words, (SELECT 3 * sum(size) // 2 FROM sized) - (running - words)))) AS taken FROM queue GROUP BY r)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM sent JOIN aimed ON sent.source IS NOT DISTINCT FROM aimed.source LEFT JOIN mixed ON mixed.r = sent.r
"""


OP10_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
held AS (SELECT payload_digest, max(page_id) AS holder FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN page_id <> holder THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> holder THEN holder END AS refers_to
FROM p LEFT JOIN held ON payload_bytes >= 1000 AND p.payload_digest = held.payload_digest
"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LETTERS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP5_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, {_LETTERS}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, {_LETTERS}) AS w FROM benchmark),
phrase AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s
           FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)),
place AS (SELECT r, n, w, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM phrase) WHERE len(w) >= n),
found AS (SELECT p.r, p.i, p.n, item_id FROM (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM place) p JOIN phrase ON phrase.s = p.s AND phrase.n = p.n),
hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS j FROM found) GROUP BY r),
item AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit ON hit.r = d.r LEFT JOIN item ON item.r = d.r
"""

OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT r, doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d WHERE len(w) >= 13)),
gone AS (SELECT DISTINCT r, unnest(generate_series(i, i + 12)) AS j FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY s) AS first_id FROM win) WHERE first_id < doc_id),
word AS (SELECT r, unnest(w) AS v, generate_subscripts(w, 1) AS j FROM d),
kept AS (SELECT r, count(*) AS n, string_agg(v, ' ' ORDER BY j) AS t FROM word WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.r = word.r AND gone.j = word.j) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.r = d.r
"""


def op3_sql() -> str:
    """The matches without retrieval: every text against every template."""
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in licenses.TEMPLATES.items())
    return rf"""
WITH t AS (SELECT * FROM (VALUES {values}) AS v(template, text)),
tw AS (SELECT template, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM t),
ts AS (SELECT DISTINCT template, array_to_string(w[i:i + 4], ' ') AS s
       FROM (SELECT template, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM tw)),
tn AS (SELECT template, count(*) AS n FROM ts GROUP BY template),
dw AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
ds AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s
       FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM dw WHERE len(w) > 0)),
hit AS (SELECT doc_id, template, count(DISTINCT ds.s) AS k, min(i) - 1 AS first_word FROM ds JOIN ts ON ds.s = ts.s GROUP BY doc_id, template)
SELECT doc_id, hit.template, CAST(k AS DOUBLE) / n AS containment, CAST(first_word AS INTEGER) AS first_word
FROM hit JOIN tn ON hit.template = tn.template WHERE k >= 0.8 * n
"""


def op12_sql(levels: int = 40) -> str:
    """Levels one after another, up to 2^levels leaves of a group; the checksum bit by bit."""
    fields = [f"coalesce(concat(strlen(CAST({c} AS VARCHAR)), ':', {c}), '-')" for c in ("doc_id", "source", "lang", "N_CHARS", "text")]
    leaf = f"sha256(concat({', '.join(fields)}))"
    above, folds = [], []
    for tree, below in (("n", "leaf"), ("u", "subroots")):
        above.append(f"{tree}0 AS (SELECT g, k, d, c FROM {below})")
        for i in range(1, levels + 1):
            above.append(
                f"{tree}{i} AS MATERIALIZED (SELECT g, k // 2 AS k, sha256(string_agg(d, '' ORDER BY k)) AS d, count(*) OVER (PARTITION BY g) AS c FROM {tree}{i - 1} WHERE c > 1 GROUP BY g, k // 2)"
            )
        if tree == "n":
            tops = " UNION ALL ".join(f"SELECT g AS lang, d FROM n{i} WHERE c = 1" for i in range(levels + 1))
            above.append(f"subroots AS MATERIALIZED (SELECT 0 AS g, row_number() OVER (ORDER BY lang ASC NULLS FIRST) - 1 AS k, d, count(*) OVER () AS c, lang FROM ({tops}))")
    above.append("root AS (" + " UNION ALL ".join(f"SELECT d FROM u{i} WHERE c = 1" for i in range(levels + 1)) + ")")
    folds.append("f0 AS (SELECT r, g, k, k AS j, '' AS proof, fold FROM leaf)")
    for tree in ("n", "u"):
        last = f"f{len(folds) - 1}"
        if tree == "u":
            folds.append(f"f{len(folds)} AS (SELECT r, 0 AS g, s.k AS k, s.k AS j, proof, fold FROM {last} f JOIN subroots s ON f.g IS NOT DISTINCT FROM s.lang)")
        for i in range(levels):
            last = f"f{len(folds) - 1}"
            folds.append(
                f"f{len(folds)} AS (SELECT r, f.g, f.k, j // 2 AS j, concat(proof, s.d) AS proof, CASE WHEN m.c IS NULL OR m.c = 1 THEN fold WHEN s.d IS NULL THEN sha256(fold) WHEN j % 2 = 1 THEN sha256(concat(s.d, fold)) "
                f"ELSE sha256(concat(fold, s.d)) END AS fold FROM {last} f LEFT JOIN {tree}{i} m ON m.g IS NOT DISTINCT FROM f.g AND m.k = j LEFT JOIN {tree}{i} s ON s.g IS NOT DISTINCT FROM f.g AND s.k = xor(j, 1) AND s.c > 1)"
            )
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, *, {leaf.replace("N_CHARS", "n_chars")} AS d FROM documents),
bits AS (SELECT *, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: [CAST(ord(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
         lambda a, v: CASE WHEN v >= 0 THEN xor(a, v) ELSE xor(a >> 1, 3988292384 * (a & 1)) END) AS crc FROM d),
leaf AS MATERIALIZED (SELECT r, doc_id, lang AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id ASC NULLS FIRST, d) - 1 AS k, d, count(*) OVER (PARTITION BY lang) AS c,
         CASE WHEN xor(crc, 4294967295) % 7 = 0 AND n_chars IS NOT NULL THEN {leaf.replace("N_CHARS", "(CAST(n_chars AS HUGEINT) + 1)")} ELSE d END AS fold FROM bits),
{", ".join(above)}, {", ".join(folds)}
SELECT doc_id, leaf.d AS leaf, s.d AS subroot, root.d AS root, sha256(proof) AS proof_sha256, f.fold AS folded_root, f.fold = root.d AS verified
FROM leaf JOIN f{len(folds) - 1} f ON f.r = leaf.r JOIN subroots s ON s.lang IS NOT DISTINCT FROM leaf.g, root
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash_near_dedup, op2_mix_sources, op3_license_scan, op4_quality_classifier, op5_benchmark_decontamination, op6_personal_data, op7_token_counts, op8_substring_dedup, op9_transport_stream, op10_warc_archives, op11_html_extraction, op12_merkle_manifest,
                                       op13_embedding_whitening)}


def oracle_sql() -> dict[str, str]:
    return {"op2_mix_sources": OP2_SQL, "op3_license_scan": op3_sql(), "op5_benchmark_decontamination": OP5_SQL, "op8_substring_dedup": OP8_SQL, "op10_warc_archives": OP10_SQL, "op12_merkle_manifest": op12_sql()}
