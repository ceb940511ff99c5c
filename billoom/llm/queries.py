"""The queries of the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bm25, divergence, kneserney, langid, licenses, mixing, packing, permutation, simhash, slots, sstable, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(column: str, n: int):
    """The unsigned CRC-32 of a number as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def op1_permutation_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest found of the vectors whose vec_id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings")
    return permutation.search(rows, rows.filter("vec_id % 100 = 0"), k=10)


def op2_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of the documents whose doc_id is divisible by 100 against all documents."""
    docs = table(spark, sf_dir, "documents")
    return bm25.search(docs, docs.filter("doc_id % 100 = 0"), k=10)


OP2_SQL = r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents WHERE doc_id IS NOT NULL),
stats AS (SELECT count(*) AS n, sum(len(ws))::DOUBLE / count(*) AS average FROM texts),
words AS (SELECT doc_id, len(ws) AS dl, unnest(ws) AS w FROM texts),
tfs AS (SELECT doc_id, dl, w, count(*)::DOUBLE AS tf FROM words GROUP BY ALL),
idfs AS (SELECT w, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tfs, stats GROUP BY w),
impacts AS (
  SELECT doc_id, w, floor(idf * (tf * (1.2::DOUBLE + 1) / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl::DOUBLE / average))) * 16777216.0::DOUBLE + 0.5) AS impact
  FROM tfs JOIN idfs USING (w), stats),
scores AS (
  SELECT q.doc_id AS query_id, d.doc_id, sum(q.tf * d.impact) / 16777216.0::DOUBLE AS score
  FROM tfs q JOIN impacts d ON q.w = d.w AND q.doc_id <> d.doc_id WHERE q.doc_id % 100 = 0 GROUP BY ALL),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10
"""


def op3_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as token ids in shards, read back: place, number and checksum of each one's ids."""
    manifest = sstable.write_tables(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return sstable.checked(sstable.read_tables(manifest))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages have no capture time: page_id seconds after 2000-01-01 stand for it."""
    runs = warc.write_archives(table(spark, sf_dir, "pages"), captured=F.timestamp_seconds(F.lit(946_684_800) + F.col("page_id")))
    records = warc.read_records(warc.captures(warc.merge_index(runs)))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")


OP4_SQL = r"""
WITH rows AS (
  SELECT page_id, coalesce(html, '') AS payload, regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)(?::[0-9]*)?([^?#]*)(?:[?]([^#]*))?', ['host', 'path', 'query']) AS u FROM pages),
sized AS (SELECT *, strlen(payload) AS n, sha256(payload) AS digest, regexp_replace(lower(u.host), '^www[.]', '') AS host FROM rows),
firsts AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest, n) ELSE page_id END AS first_id FROM sized)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first_id <> page_id THEN first_id END AS refers_to,
  CASE WHEN coalesce(host, '') = '' THEN '-' ELSE lower(array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN u.path = '' THEN '/' ELSE u.path END
    || CASE WHEN u.query = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(u.query, '&')), '&') END) END AS url_key,
  strftime(TIMESTAMP '2000-01-01' + to_seconds(page_id), '%Y%m%d%H%M%S') AS captured
FROM firsts
"""


def op5_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources flattened to the square roots of their sizes, as many bytes as there are."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), temperature=0.5, budget=1.0, seed=5)
    return mixed.select("doc_id", "source", "lang", "text", "n_chars", "copy", "n_copies", "shuffle_key")


OP5_SQL = """
WITH RECURSIVE sizes AS (
  SELECT coalesce(source, '') AS s, sum(coalesce(strlen(text), 0))::DOUBLE AS n FROM documents GROUP BY 1),
totals AS (SELECT sum(CASE WHEN n > 0 THEN pow(n, 0.5) END) AS w, sum(n) AS n FROM sizes),
rates AS (SELECT s, CASE WHEN sizes.n > 0 THEN pow(sizes.n, 0.5) * (1.0 * totals.n / totals.w) / sizes.n ELSE 1.0 END AS rate FROM sizes, totals),
means AS (SELECT s, greatest(1, ceil(rate / 128.0))::INT AS parts, rate / greatest(1, ceil(rate / 128.0)) AS m FROM rates),
cdf AS (
  SELECT s, m, 0 AS k, exp(-m) AS p, exp(-m) AS c, ceil(m + 12 * sqrt(m) + 24) AS far FROM means
  UNION ALL SELECT s, m, k + 1, p * m / (k + 1), c + p * m / (k + 1), far FROM cdf WHERE k < far),
lists AS (SELECT s, list(c ORDER BY k) AS cs FROM cdf GROUP BY s),
draws AS (
  SELECT documents.*, lists.cs, part,
    ('0x' || substr(md5('5|' || coalesce(doc_id::VARCHAR, '') || '|' || part), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM documents JOIN means ON means.s = coalesce(source, '') JOIN lists ON lists.s = coalesce(source, ''), unnest(range(1, parts + 1)) AS t(part)),
counted AS (SELECT doc_id, source, lang, text, n_chars, sum(len(list_filter(cs, lambda x: x <= u)))::INT AS n_copies FROM draws GROUP BY ALL)
SELECT doc_id, source, lang, text, n_chars, copy::INT AS copy, n_copies,
  md5('5-order|' || coalesce(doc_id::VARCHAR, '') || '|' || copy) AS shuffle_key
FROM counted, unnest(range(1, n_copies + 1)) AS t(copy)
"""


def op6_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as token ids in sequences of 4096: the place of each piece."""
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def language_of(docs: DataFrame) -> DataFrame:
    """docs with held_out, lang_pred, score and coverage; learned from the folds 0 and 2 of crc32(doc_id) mod 3."""
    docs = docs.withColumn("held_out", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)))
    return langid.predict(docs.select("doc_id", "text", "held_out"), langid.fit(docs.filter(~F.col("held_out"))))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return language_of(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "coverage")


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigram and unigram log10 probabilities of every document; learned from all folds but 1 of crc32(doc_id) mod 5."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(fold("doc_id", 5) == 1, F.lit(False)))
    return kneserney.score(docs, kneserney.fit(docs.filter(~F.col("held_out"))), keep=["doc_id", "held_out"])


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: source / thousands / fifties of doc_id; each twentieth is its directory's LICENSE."""
    d = F.col("doc_id")
    name = F.when(d % 20 == 0, "LICENSE").otherwise(F.concat(d.cast("string"), F.lit(".txt")))
    place = F.concat_ws("/", F.coalesce("source", F.lit("")), F.floor(d / 1000).cast("string"), F.when(d % 20 == 0, d.cast("string")).otherwise(F.floor(d / 50).cast("string")))
    place = F.when(d % 40 == 0, F.concat_ws("/", F.coalesce("source", F.lit("")), F.floor(d / 1000).cast("string"))).otherwise(place)
    files = table(spark, sf_dir, "documents").withColumn("path", F.concat_ws("/", place, name))
    return licenses.inherit(files.select("doc_id", "path"), licenses.scan(files)).select("doc_id", "path", "license", "score", "via", "from_dir")


OP9_SQL = r"""
WITH placed AS (
  SELECT doc_id, text,
    CASE WHEN doc_id % 40 = 0 THEN concat_ws('/', coalesce(source, ''), floor(doc_id / 1000.0)::BIGINT::VARCHAR)
      ELSE concat_ws('/', coalesce(source, ''), floor(doc_id / 1000.0)::BIGINT::VARCHAR,
        CASE WHEN doc_id % 20 = 0 THEN doc_id::VARCHAR ELSE floor(doc_id / 50.0)::BIGINT::VARCHAR END) END AS place,
    CASE WHEN doc_id % 20 = 0 THEN 'LICENSE' ELSE doc_id::VARCHAR || '.txt' END AS name
  FROM documents),
files AS (SELECT doc_id, text, concat_ws('/', place, name) AS path FROM placed),
parted AS (
  SELECT path, unnest(string_split(regexp_replace(text, '([.;!?])[ \t\r\f]+', '\1' || chr(10), 'g'), chr(10))) AS unit
  FROM files WHERE regexp_matches(lower(text), '@speaks')),
units AS (SELECT DISTINCT path, unit FROM parted WHERE regexp_matches(lower(unit), '@speaks')),
total AS (SELECT count(*)::DOUBLE AS n FROM units),
words AS (SELECT path, unit, unnest(regexp_extract_all(lower(unit), '[a-z0-9]+(?:[.+-][a-z0-9]+)*')) AS term FROM units),
tfs AS (SELECT path, unit, term, count(*)::DOUBLE AS tf FROM words GROUP BY ALL),
dfs AS (SELECT term, count(*)::DOUBLE AS df FROM tfs GROUP BY term),
templates(license, text) AS (VALUES @templates),
template_words AS (SELECT license, unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:[.+-][a-z0-9]+)*')) AS term FROM templates),
template_tfs AS (SELECT license, term, count(*)::DOUBLE AS tf FROM template_words GROUP BY ALL),
fixed AS (SELECT license, term, tf * (ln((1 + n) / (1 + coalesce(df, 0))) + 1) AS tw FROM template_tfs LEFT JOIN dfs USING (term), total),
template_norms AS (SELECT license, sqrt(sum(tw * tw)) AS tnorm FROM fixed GROUP BY license),
weighed AS (SELECT path, unit, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tfs JOIN dfs USING (term), total),
norms AS (SELECT path, unit, sqrt(sum(w * w)) AS norm FROM weighed GROUP BY ALL),
dots AS (SELECT path, unit, license, sum(w * tw) AS dot FROM weighed JOIN fixed USING (term) GROUP BY ALL),
scored AS (SELECT path, license, round(dot / (norm * tnorm), 6) AS score FROM dots JOIN norms USING (path, unit) JOIN template_norms USING (license)),
found AS (
  SELECT path, license, score FROM scored WHERE score >= @least
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, license) = 1),
given AS (
  SELECT regexp_replace(path, '/?[^/]*$', '') AS above, min(license) AS given FROM found
  WHERE regexp_matches(regexp_extract(path, '([^/]*)$', 1), '@name') GROUP BY 1),
dirs AS (SELECT DISTINCT regexp_replace(path, '/?[^/]*$', '') AS dir FROM files),
ancestors AS (SELECT dir, depth, array_to_string(string_split(dir, '/')[1:depth], '/') AS above FROM (SELECT dir, unnest(range(0, len(string_split(dir, '/')) + 1)) AS depth FROM dirs)),
nearest AS (SELECT dir, above, given FROM ancestors JOIN given USING (above) QUALIFY row_number() OVER (PARTITION BY dir ORDER BY depth DESC) = 1)
SELECT doc_id, files.path, coalesce(license, given) AS license, score,
  CASE WHEN license IS NOT NULL THEN 'own' WHEN given IS NOT NULL THEN 'inherited' ELSE 'none' END AS via,
  CASE WHEN license IS NULL AND given IS NOT NULL THEN above END AS from_dir
FROM files LEFT JOIN found USING (path) LEFT JOIN nearest ON nearest.dir = regexp_replace(files.path, '/?[^/]*$', '')
"""
for _key, _value in {"speaks": licenses.SPEAKS, "name": licenses.LICENSE_NAME, "least": str(licenses.LEAST_COSINE), "templates": ", ".join(f"('{k}', '{v}')" for k, v in licenses.TEMPLATES.items())}.items():
    OP9_SQL = OP9_SQL.replace(f"@{_key}", _value)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source of each language against the others and, by term, against the language."""
    return divergence.audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents),
words AS (SELECT id, lang, source, unnest(ws) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS c FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
vs AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY ALL),
ns AS (SELECT lang, source, sum(c) AS n FROM counts GROUP BY ALL),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(x.c, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(x.c, 0) + 1) // (coalesce(ns.n, 0) + vs.v) AS p,
    1 + 1000000000::HUGEINT * (k.c + 1) // (vs.n + vs.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN vs USING (lang) LEFT JOIN ns ON ns.lang = g.lang AND ns.source = g.source
  LEFT JOIN counts x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
summed AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM shares WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def op12_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 16 shards by 4096 virtual slots of their doc_id, evened out by bytes; read back from the shards' files."""
    rows = slots.shard(table(spark, sf_dir, "documents"), 16).rows
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return rows.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "even_shard")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of every document by a byte-level and a sentencepiece vocabulary."""
    return alignment.alignments(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_permutation_knn": op1_permutation_knn,
    "op2_block_max_wand": op2_block_max_wand,
    "op3_sstable": op3_sstable,
    "op4_warc": op4_warc,
    "op5_poisson_mix": op5_poisson_mix,
    "op6_pattern_packing": op6_pattern_packing,
    "op7_language_id": op7_language_id,
    "op8_kneser_ney": op8_kneser_ney,
    "op9_license_scan": op9_license_scan,
    "op10_simhash": op10_simhash,
    "op11_source_divergence": op11_source_divergence,
    "op12_virtual_slots": op12_virtual_slots,
    "op13_token_alignment": op13_token_alignment,
}
ORACLE_SQL: dict[str, str] = {"op2_block_max_wand": OP2_SQL, "op4_warc": OP4_SQL, "op5_poisson_mix": OP5_SQL, "op9_license_scan": OP9_SQL, "op11_source_divergence": OP11_SQL}
