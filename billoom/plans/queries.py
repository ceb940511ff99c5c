"""The bill queries over the driver's tables, and their SQL. Inputs are made in plans/inputs.py, SQL rules in plans/sql.py."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billoom.functions import render
from billoom.functions import scalars as S
from billoom.operators import lists, replies, staged, store, totals
from billoom.sources import files, ndjson
from billoom.streaming import inbox

from . import inputs as I
from . import sql as Q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query under its name, with its SQL where SQL can express it."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# Totals


@query(f"WITH {I.BILLS} SELECT path, arg_min({Q.trim('currency')}, page) AS currency, sum(gross_cents)::BIGINT AS cents, count(*) AS counted, min(page) AS first_page FROM bills WHERE status = 'ok' AND gross_cents IS NOT NULL GROUP BY path, lower({Q.trim('currency')})")
def file_totals(spark, sf_dir):
    return totals.file_totals(I.bills(spark, sf_dir), ("file_id",)).select(I.path(), "currency", "cents", "counted", "first_page")


_COVER = """a AS (SELECT path, count(*) AS present, count(*) FILTER (status = 'ok' AND gross_cents IS NOT NULL) AS counted, count(*) FILTER (status <> 'ok') AS failed, greatest(max(page_count), count(*)) AS expected FROM bills GROUP BY path)"""


@query(f"WITH {I.BILLS}, {_COVER} SELECT *, greatest(0, present - failed - counted) AS unamounted, counted > 0 AND failed = 0 AND counted >= expected AS complete FROM a")
def file_coverage(spark, sf_dir):
    return totals.file_coverage(I.bills(spark, sf_dir), ("file_id",)).select(I.path(), "present", "counted", "failed", "expected", "unamounted", "complete")


@query(f"WITH {I.BILLS}, {Q.file_sums('bills')} SELECT path, '  sum  ' || money || '  (' || {Q.COVERED} || ')' AS line FROM sums WHERE present > 1")
def file_sum_lines(spark, sf_dir):
    rows = totals.file_sums(I.bills(spark, sf_dir), ("file_id",)).filter("present > 1")
    return rows.select(I.path(), F.concat(F.lit("  sum  "), render.joined_money(F.col("parts")), F.lit("  ("), totals.coverage_text(), F.lit(")")).alias("line"))


@query(f"WITH {I.BILLS}, {Q.file_sums('bills')} SELECT path, CASE WHEN n_parts = 1 THEN regexp_extract(money, '^[^ ]*') ELSE '' END AS amount FROM sums")
def bare_amount(spark, sf_dir):
    return totals.file_sums(I.bills(spark, sf_dir), ("file_id",)).select(I.path(), render.bare_amount(F.col("parts")).alias("amount"))


@query(f"""WITH {I.BILLS}, {Q.file_sums('bills')} SELECT path, CASE WHEN money = '' THEN '—' ELSE money END AS money,
CASE WHEN complete THEN counted || CASE WHEN counted = 1 THEN ' Beleg' ELSE ' Belege' END ELSE counted || ' von ' || expected || ' Belegen' || CASE WHEN failed > 0 THEN ', ' || failed || ' nicht gelesen' ELSE '' END END AS note FROM sums""")
def widget_totals(spark, sf_dir):
    """A file's sum and coverage in the widget's words."""
    rows = totals.file_sums(I.bills(spark, sf_dir), ("file_id",))
    note = render.coverage_note(F.col("counted"), F.col("expected"), F.col("failed"), F.col("complete"))
    return rows.select(I.path(), render.or_else(render.joined_money(F.col("parts")), "—").alias("money"), note.alias("note"))


@query(f"""WITH {I.BILLS}, w AS (SELECT count(*) AS expected, count(*) FILTER (status = 'ok' AND gross_cents IS NOT NULL) AS all_counted, count(*) FILTER (status <> 'ok') AS failed FROM bills),
c AS (SELECT arg_min({Q.trim('currency')}, file_id * 1000 + page) AS currency, sum(gross_cents)::BIGINT AS cents, count(*) AS counted FROM bills WHERE status = 'ok' AND gross_cents IS NOT NULL GROUP BY lower({Q.trim('currency')}))
SELECT currency, cents, counted, expected, failed, expected - failed - all_counted AS unamounted, all_counted > 0 AND failed = 0 AND all_counted >= expected AS complete FROM c, w""")
def list_total(spark, sf_dir):
    return totals.list_total(I.bills(spark, sf_dir), ("file_id", "page"))


@query(f"WITH {I.BILLS} SELECT count(*) AS processed, count(*) FILTER (status <> 'ok') AS failed, CASE WHEN bool_and(status = 'ok') THEN 0 ELSE 1 END AS exit_status FROM bills")
def run_outcome(spark, sf_dir):
    return totals.outcome(I.bills(spark, sf_dir))


@query(f"WITH {I.BILLS} SELECT path, bool_and(status = 'ok') AS archive FROM bills GROUP BY 1")
def archive_gate(spark, sf_dir):
    return totals.archivable(I.bills(spark, sf_dir).withColumn("path", I.path()))


# The list


@query(f"WITH {I.LISTED} SELECT event_id, event_type, run_id FROM runs")
def document_runs(spark, sf_dir):
    """The whole list in order of event_id, cut into ranges."""
    return totals.runs(I.table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", "event_id")


@query(f"WITH {I.LISTED} SELECT max(run_id) AS documents FROM runs")
def run_count(spark, sf_dir):
    return totals.run_count(I.table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", "event_id")


@query(f"""WITH {I.LISTED}, {Q.file_sums('runs', 'run_id', 'event_id')}
SELECT event_id, runs.run_id, CASE WHEN present > 1 AND event_id = max(event_id) OVER (PARTITION BY runs.run_id) THEN money END AS money,
  CASE WHEN present > 1 AND event_id = max(event_id) OVER (PARTITION BY runs.run_id) THEN {Q.COVERED} END AS covered FROM runs JOIN sums USING (run_id)""")
def run_subtotals(spark, sf_dir):
    marked = totals.run_subtotals(I.listed(spark, sf_dir), "event_type", "event_id")
    return marked.select("event_id", "run_id", F.when(F.col("parts").isNotNull(), render.joined_money(F.col("parts"))).alias("money"), "covered")


_MERGE = """shown AS (SELECT o_orderkey AS pos, CASE WHEN o_custkey % 5 = 0 THEN '' ELSE '/in/' || o_custkey END AS path, 'f' || o_custkey AS file, o_orderkey % 3 + 1 AS bill FROM orders),
fresh AS (SELECT * FROM shown WHERE path = '/in/1' OR (path = '' AND file = 'f10')),
keys AS (SELECT DISTINCT CASE WHEN path = '' THEN file ELSE path END AS k FROM fresh),
merged AS (SELECT 0 AS part, * FROM fresh UNION ALL SELECT 1, * FROM shown WHERE CASE WHEN path = '' THEN file ELSE path END NOT IN (SELECT k FROM keys))"""


def _shown(spark, sf_dir):
    c = F.col("o_custkey")
    return I.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.when(c % 5 == 0, "").otherwise(F.concat(F.lit("/in/"), c)).alias("path"), F.concat(F.lit("f"), c).alias("file"), (F.col("o_orderkey") % 3 + 1).alias("bill"))


@query(f"WITH {_MERGE} SELECT part, pos, path, file, bill FROM merged")
def replace_merge(spark, sf_dir):
    shown = _shown(spark, sf_dir)
    return lists.replace_merge(shown, shown.filter("path = '/in/1' OR (path = '' AND file = 'f10')"))


@query(f"WITH {_MERGE} SELECT part, pos, path, file, bill FROM merged ORDER BY part, pos LIMIT 8")
def list_cap(spark, sf_dir):
    shown = _shown(spark, sf_dir)
    return lists.replace_merge(shown, shown.filter("path = '/in/1' OR (path = '' AND file = 'f10')"), 8)


@query("""WITH shown AS (SELECT o_orderkey AS pos, CASE WHEN o_custkey % 5 = 0 THEN 'f' || o_custkey ELSE '/in/' || o_custkey END AS k, o_orderkey % 3 + 1 AS bill FROM orders),
opened AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'f' || c_custkey ELSE '/in/' || c_custkey END AS k, c_custkey % 4 + 1 AS bill FROM customer)
SELECT c_custkey, opened.bill, min(pos) AS found FROM opened LEFT JOIN shown ON shown.k = opened.k AND shown.bill = opened.bill GROUP BY 1, 2""")
def reopened_bill(spark, sf_dir):
    c = F.col("c_custkey")
    opened = I.table(spark, sf_dir, "customer").select("c_custkey", F.when(c % 5 == 0, "").otherwise(F.concat(F.lit("/in/"), c)).alias("path"), F.concat(F.lit("f"), c).alias("file"), (c % 4 + 1).alias("bill"))
    return lists.reopened(opened, _shown(spark, sf_dir)).select("c_custkey", "bill", "found")


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def deferred_paths(spark, sf_dir):
    """A queue of customers that takes each once."""
    return lists.first_of_each(I.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")


# Scalars


@query(f"WITH {I.AMOUNT_ROWS}, {Q.amount_steps('parsed', 'amounts', 'p_partkey')} SELECT p_partkey, amount FROM parsed")
def parse_amount(spark, sf_dir):
    return I.amounts(spark, sf_dir).select("p_partkey", S.parse_amount(F.col("t")).alias("amount"))


@query(f"WITH {I.DATE_ROWS} SELECT o_orderkey, {Q.date('t')} AS iso FROM dates")
def normalise_date(spark, sf_dir):
    return I.dates(spark, sf_dir).select("o_orderkey", S.normalise_date(F.coalesce("t", F.lit(""))).alias("iso"))


_LINES = """lines AS (SELECT o_orderkey, 'Shop ' || o_custkey || chr(10) || CASE WHEN o_orderkey % 4 = 0 THEN 'Gestern' WHEN o_orderkey % 4 = 1 THEN 'RECHNUNGSDATUM: ' WHEN o_orderkey % 4 = 2 THEN 'Invoice Date ' ELSE 'Zahlbar bis ' END
  || coalesce(t, '') || chr(10) || CASE WHEN o_orderkey % 6 = 0 THEN 'Ausgestellt am 03.04.2024' ELSE 'Danke 1.1.2020' END AS t FROM dates JOIN (SELECT o_orderkey, o_custkey FROM orders) USING (o_orderkey))"""


@query(f"WITH {I.DATE_ROWS}, {_LINES} SELECT o_orderkey, {Q.labelled_date('t')} AS iso FROM lines")
def labelled_date(spark, sf_dir):
    k = F.col("o_orderkey")
    label = F.element_at(F.array(*map(F.lit, ("Gestern", "RECHNUNGSDATUM: ", "Invoice Date ", "Zahlbar bis "))), (k % 4 + 1).cast("int"))
    orders = I.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    text = F.concat(F.lit("Shop "), F.col("o_custkey"), F.lit("\n"), label, S.text_of(F.col("t")), F.lit("\n"), F.when(k % 6 == 0, "Ausgestellt am 03.04.2024").otherwise("Danke 1.1.2020"))
    return I.dates(spark, sf_dir).join(orders, "o_orderkey").select("o_orderkey", S.find_labelled_date(text).alias("iso"))


@query(f"WITH c AS (SELECT c_custkey, {Q.choice(I.CURRENCIES, 'c_custkey')} AS t FROM customer) SELECT c_custkey, {Q.currency('t')} AS currency FROM c")
def normalise_currency(spark, sf_dir):
    return I.table(spark, sf_dir, "customer").select("c_custkey", S.normalise_currency(I.choice(I.CURRENCIES, F.col("c_custkey"))).alias("currency"))


_PLACES = [*S.PLACEHOLDERS, *[p.upper() for p in S.PLACEHOLDERS], *[f" {p} (shop)" for p in S.PLACEHOLDERS], "Nail Studio", "Na Bistro", "--", "?", "–", "...", "", "\u00a0", "a-b", None]


@query(f"WITH c AS (SELECT c_custkey, {Q.choice(_PLACES, 'c_custkey')} AS t FROM customer) SELECT c_custkey, {Q.placeholder('t')} AS nothing FROM c")
def placeholder(spark, sf_dir):
    return I.table(spark, sf_dir, "customer").select("c_custkey", S.is_placeholder(I.choice(_PLACES, F.col("c_custkey"))).alias("nothing"))


_ANSWERS = ["SUMME -35,01", "12.50 or 13.50", "the total is 1.190,00 EUR", "NONE", "", "-5", "3 items: 4", "12'000.50", "7.", None]


@query(f"WITH c AS (SELECT c_custkey, {Q.choice(_ANSWERS, 'c_custkey')} AS answer FROM customer), n AS (SELECT c_custkey, regexp_extract_all(coalesce(answer, ''), '-?[0-9][0-9.,'']*') AS found FROM c), one AS (SELECT c_custkey, CASE WHEN len(found) = 1 THEN found[1] END AS t FROM n), {Q.amount_steps('parsed', 'one', 'c_custkey')} SELECT c_custkey, amount FROM parsed")
def amount_from_answer(spark, sf_dir):
    return I.table(spark, sf_dir, "customer").select("c_custkey", S.amount_from_answer(I.choice(_ANSWERS, F.col("c_custkey"))).alias("amount"))


@query(rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(regexp_replace(coalesce(text, ''), '[\s\p{{Z}}\x0B]+', ' ', 'g'), '^ | $', '', 'g') AS line FROM documents)
SELECT doc_id, CASE WHEN length(line) > 160 THEN regexp_replace(left(line, 160), ' $', '') || '...' ELSE line END AS line, regexp_replace(string_split({Q.trim('text')}, chr(10))[1], '[\s\p{{Z}}]+$', '') AS first_line FROM t""")
def single_line(spark, sf_dir):
    return I.table(spark, sf_dir, "documents").select("doc_id", S.single_line(F.col("text")).alias("line"), render.first_line(F.col("text")).alias("first_line"))


@query("""SELECT c_custkey, lower(array_to_string(regexp_extract_all(c_name || ' & Söhne-' || c_mktsegment, '[\\p{L}\\p{N}]+'), ' ')) AS folded,
CASE c_custkey % 3 WHEN 0 THEN regexp_matches(lower(array_to_string(regexp_extract_all(c_name || ' & Söhne-' || c_mktsegment, '[\\p{L}\\p{N}]+'), ' ')), 's.hne b') WHEN 1 THEN TRUE ELSE c_mktsegment = 'BUILDING' END AS same FROM customer""")
def vendor_compare(spark, sf_dir):
    name = F.concat("c_name", F.lit(" & Söhne-"), "c_mktsegment")
    expected = F.when(F.col("c_custkey") % 3 == 0, "/S.hne B/").when(F.col("c_custkey") % 3 == 1, "*").otherwise(F.concat(F.upper("c_name"), F.lit(" söhne building")))
    return I.table(spark, sf_dir, "customer").select("c_custkey", S.fold_vendor(name).alias("folded"), S.vendor_matches(expected, name).alias("same"))


@query("""SELECT s_suppkey, substr(sha256('model=m' || s_suppkey % 7 || ';pages=' || s_suppkey % 3 || ';dpi=200;longEdge=1600;minShortEdge=1000;threshold=120;ocr=' || s_suppkey % 2 || ';ocrLang=deu;prompt=11'), 1, 16) AS fingerprint,
's' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE ':' || s_suppkey % 5 END AS model, s_suppkey % 2 = 0 OR s_suppkey % 3 = 0 AS installed FROM supplier""")
def fingerprints(spark, sf_dir):
    k = F.col("s_suppkey")
    key = S.fingerprint(F.concat(F.lit("m"), k % 7), k % 3, F.lit(200), F.lit(1600), F.lit(1000), F.lit(120), k % 2, F.lit("deu"))
    model = F.concat(F.lit("s"), k, F.when(k % 2 == 0, "").otherwise(F.concat(F.lit(":"), k % 5)))
    present = F.array(F.when((k % 2 == 0) | (k % 3 == 0), F.concat(F.lit("s"), k, F.lit(":latest"))).otherwise("other"), F.lit("x:1"))
    return I.table(spark, sf_dir, "supplier").select("s_suppkey", key.alias("fingerprint"), model.alias("model"), S.model_installed(model, present).alias("installed"))


_URLS = ["/in/2025-05 Rechnung.PDF", "/in/a#b?c.pdf", "/in/it's (1)!~*.pdf", "/in/ä+%.png", "", None]


@query(f"""WITH c AS (SELECT c_custkey, c_name, {Q.choice(_URLS, 'c_custkey')} AS p FROM customer)
SELECT c_custkey, CASE WHEN coalesce(p, '') = '' THEN '' ELSE 'file://' || {Q.choice(['/in/2025-05%20Rechnung.PDF', '/in/a%23b%3Fc.pdf', "/in/it's%20(1)!~*.pdf", '/in/%C3%A4%2B%25.png', '', None], 'c_custkey')} END AS url, p AS back,
  chr(39) || replace(c_name || chr(39) || 'x', chr(39), chr(39) || chr(92) || chr(39) || chr(39)) || chr(39) AS quoted, coalesce(nullif(p, ''), 'f' || c_custkey) AS file_key, lower(regexp_extract(coalesce(p, ''), '\\.([^./]*)$', 1)) AS suffix,
  CASE WHEN lower(regexp_extract(coalesce(p, ''), '\\.([^./]*)$', 1)) = 'pdf' THEN 'pdf' WHEN lower(regexp_extract(coalesce(p, ''), '\\.([^./]*)$', 1)) IN ('jpg', 'png') THEN 'image' ELSE 'unsupported' END AS route,
  coalesce(p, '') <> '' AS retryable FROM c""")
def paths_and_urls(spark, sf_dir):
    p, c = I.choice(_URLS, F.col("c_custkey")), I.table(spark, sf_dir, "customer")
    url = render.file_url(p)
    return c.select("c_custkey", url.alias("url"), F.when(p.isNotNull(), render.dropped_path(url)).alias("back"), render.shell_quote(F.concat("c_name", F.lit("'x"))).alias("quoted"), S.file_key(p, F.concat(F.lit("f"), "c_custkey")).alias("file_key"), S.suffix(S.text_of(p)).alias("suffix"), files.route(S.text_of(p)).alias("route"), S.retryable(p).alias("retryable"))


_COUNTS = ["0", " 12\n", "-1", "3 bills", "", "usage: x", "007", None]


@query(f"""WITH c AS (SELECT c_custkey, regexp_replace(coalesce({Q.choice(_COUNTS, 'c_custkey')}, ''), '^\\s+|\\s+$', '', 'g') AS t FROM customer), n AS (SELECT c_custkey, CASE WHEN regexp_matches(t, '^[0-9]+$') THEN CAST(t AS BIGINT) ELSE -1 END AS stored FROM c) SELECT c_custkey, stored, stored = 0 AND c_custkey % 3 > 0 AS wiped FROM n""")
def stored_count(spark, sf_dir):
    n = S.stored_count(I.choice(_COUNTS, F.col("c_custkey")))
    return I.table(spark, sf_dir, "customer").select("c_custkey", n.alias("stored"), S.wiped(n, F.col("c_custkey") % 3).alias("wiped"))


@query("""WITH p AS (SELECT p_partkey, (p_size - 3) * 10.0::DOUBLE AS w, (p_partkey % 900) * 1.0::DOUBLE AS h, (p_partkey * 37 % 3000 - 20)::INT AS pw, CASE WHEN p_partkey % 41 <> 0 THEN (p_partkey * 91 % 2500 - 5)::INT END AS ph FROM part),
z AS (SELECT *, CASE WHEN w > 0 AND h > 0 THEN least(greatest(200.0::DOUBLE / 72, 1000.0::DOUBLE / least(w, h)), sqrt(20000000.0::DOUBLE / (w * h))) ELSE 200.0::DOUBLE / 72 END AS zoom,
  CASE WHEN pw > 0 AND ph > 0 THEN greatest(pw, ph)::DOUBLE END AS long, CASE WHEN pw > 0 AND ph > 0 THEN least(pw, ph)::DOUBLE END AS short, least(pw, ph)::DOUBLE AS least_edge FROM p),
s AS (SELECT *, CASE WHEN long > 1600 THEN 1600.0::DOUBLE / long ELSE 1.0::DOUBLE END AS s0 FROM z),
t AS (SELECT *, CASE WHEN s0 < 1 AND short * s0 < 700 THEN least(700.0::DOUBLE / short, 1.0::DOUBLE) ELSE s0 END AS s1 FROM s),
u AS (SELECT *, CASE WHEN short IS NOT NULL THEN CASE WHEN s1 >= 0.999 OR s1 <= 0 THEN 1.0::DOUBLE ELSE s1 END END AS scale FROM t)
SELECT p_partkey, round(zoom, 9) AS zoom, round(scale, 9) AS scale, CASE WHEN scale IS NULL THEN NULL WHEN scale = 1 THEN pw ELSE greatest(1, floor(pw * scale + 0.5::DOUBLE)::BIGINT) END AS width, CASE WHEN scale IS NULL THEN NULL WHEN scale = 1 THEN ph ELSE greatest(1, floor(ph * scale + 0.5::DOUBLE)::BIGINT) END AS height,
  round(CASE WHEN least_edge > 0 AND least_edge < 1400 AND least(1400.0::DOUBLE / least_edge, 4.0::DOUBLE) > 1.05 THEN least(1400.0::DOUBLE / least_edge, 4.0::DOUBLE) ELSE 1.0::DOUBLE END, 9) AS ocr,
  CASE WHEN p_partkey % 2 = 0 AND least_edge > 0 AND least_edge < 400 THEN 'only ' || least_edge::INT || ' px across: values are unverified' ELSE '' END AS warning FROM u""")
def page_geometry(spark, sf_dir):
    """Zoom, downscale, OCR magnification and legibility of pages and images, among them edges that are null, zero or negative."""
    k = F.col("p_partkey")
    w, h, pw, ph = (F.col("p_size") - 3) * 10.0, (k % 900) * 1.0, (k * 37 % 3000 - 20).cast("int"), F.when(k % 41 != 0, (k * 91 % 2500 - 5).cast("int"))
    rows = I.table(spark, sf_dir, "part").select("p_partkey", w.alias("w"), h.alias("h"), pw.alias("pw"), ph.alias("ph"))
    s, z = S.downscale(F.col("pw"), F.col("ph"), 1600, 700), S.zoom(F.col("w"), F.col("h"))
    return rows.select("p_partkey", F.round(z, 9).alias("zoom"), s.alias("s"), "pw", "ph").select("p_partkey", "zoom", F.round("s.scale", 9).alias("scale"), "s.width", "s.height", F.round(S.ocr_factor(F.col("pw"), F.col("ph")), 9).alias("ocr"), S.legibility(k % 2 != 0, F.lit(True), F.col("pw"), F.col("ph")).alias("warning"))


@query("""WITH p AS (SELECT p_partkey, (p_size - 3) * 10.0::DOUBLE AS w, (p_partkey % 9000) * 1.0::DOUBLE AS h FROM part), q AS (SELECT *, w > 0 AND h > 0 AS page, CASE WHEN w > 0 AND h > 0 THEN 1000.0::DOUBLE / least(w, h) END AS wanted, CASE WHEN w > 0 AND h > 0 THEN sqrt(20000000.0::DOUBLE / (w * h)) END AS cap FROM p)
SELECT p_partkey, array_to_string(list_filter([CASE WHEN page AND wanted > 200.0::DOUBLE / 72 THEN 'resolution raised to ' || printf('%.0f', round(wanted * 72)) || ' dpi for a ' || printf('%.0f', round(least(w, h) * 25.4::DOUBLE / 72)) || ' mm narrow page' END,
  CASE WHEN page AND greatest(200.0::DOUBLE / 72, wanted) > cap THEN 'resolution limited to ' || printf('%.0f', round(cap * 72)) || ' dpi by the pixel budget' END], lambda x: x IS NOT NULL), '; ') AS notes FROM q""")
def zoom_notes(spark, sf_dir):
    """Pages with an edge of 0 or less have no note."""
    w, h = (F.col("p_size") - 3) * 10.0, (F.col("p_partkey") % 9000) * 1.0
    return I.table(spark, sf_dir, "part").select("p_partkey", F.array_join(render.zoom_notes(w, h), "; ").alias("notes"))


@query("""SELECT '{"file":"' || p_partkey || '.pdf","path":"/in/' || p_partkey || '.pdf","kind":"' || CASE WHEN p_partkey % 2 = 0 THEN 'pdf' ELSE 'image' END || '","status":"' || CASE WHEN p_partkey % 5 = 0 THEN 'error","error":"damaged' ELSE 'ok' END || '","has_text_layer":' || (p_partkey % 2 = 0) || ',"bill_count":' || p_size
|| ',"text_chars":' || length(p_type) || ',"notes":["' || p_brand || '"],"text":"' || p_type || '"}' AS value FROM part""")
def extraction_report(spark, sf_dir):
    k = F.col("p_partkey")
    docs = I.table(spark, sf_dir, "part").select(F.concat(F.lit("/in/"), k, F.lit(".pdf")).alias("path"), F.when(k % 2 == 0, "pdf").otherwise("image").alias("kind"), F.when(k % 5 == 0, "damaged").alias("error"), (k % 2 == 0).alias("has_text_layer"), F.col("p_size").alias("bill_count"), F.array("p_brand").alias("notes"), F.col("p_type").alias("text"))
    return files.extraction_report(docs)


# Replies and their settling


@query(rf"""WITH {I.REPLY_ROWS}, a AS (SELECT p_partkey, {Q.trim('reply')} AS t FROM replies),
b AS (SELECT p_partkey, CASE WHEN t LIKE '```%' THEN regexp_replace(regexp_replace(t, '\A[^\n]*\n', ''), '(?s)\A(.*)```.*\z', '\1') ELSE t END AS t FROM a),
c AS (SELECT p_partkey, CASE WHEN regexp_matches(t, '(?s)\{{.*\}}') THEN regexp_extract(t, '(?s)\{{.*\}}') ELSE {Q.trim('t')} END AS body FROM b),
j AS (SELECT p_partkey, body, TRY_CAST(body AS JSON) AS j FROM c),
f AS (SELECT p_partkey, body, coalesce(json_type(j) = 'OBJECT', FALSE) AS good, j FROM j),
g AS (SELECT p_partkey, body, good, CASE WHEN good THEN j->>'$.vendor' END AS v, CASE WHEN good THEN j->>'$.date' END AS day, CASE WHEN good THEN j->>'$.currency' END AS cur, CASE WHEN good THEN replace(j->>'$.iban', ' ', '') END AS iban,
  CASE WHEN good AND json_type(j, '$.gross_total') = 'VARCHAR' THEN j->>'$.gross_total' END AS t, CASE WHEN good AND json_type(j, '$.gross_total') IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN CAST(j->>'$.gross_total' AS DOUBLE) END AS num FROM f),
{Q.amount_steps('parsed', 'g', 'p_partkey, body, good, v, day, cur, iban, num')}
SELECT p_partkey, CASE WHEN body = '' THEN 'the model returned nothing' WHEN NOT good THEN 'the reply is not a JSON object' ELSE '' END AS error,
  CASE WHEN good THEN {Q.cleaned('v')} END AS vendor, CASE WHEN good THEN {Q.date('day')} END AS date, CASE WHEN good THEN {Q.currency('cur')} END AS currency, iban, NULL::DOUBLE AS net_total, coalesce(num, amount) AS gross_total,
  good AND coalesce({Q.cleaned('v')}, '') <> '' AND coalesce(num, amount) IS NOT NULL AS plausible FROM parsed""")
def json_reply(spark, sf_dir):
    rows = replies.from_reply(I.replies(spark, sf_dir))
    return rows.select("p_partkey", "error", "vendor", "date", "currency", "iban", "net_total", "gross_total", S.plausible(F.col("vendor"), F.col("gross_total")).alias("plausible"))


_SETTLE = f"""settle AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Datum: ' || coalesce(t, '') ELSE 'nothing ' || coalesce(t, '') END AS page, CASE WHEN o_orderkey % 2 = 0 THEN {Q.choice(I.DATES, 'o_orderkey // 2')} END AS asked, {Q.choice(['2024-01-01', '', None], 'o_orderkey')} AS reply FROM dates)"""


@query(f"""WITH {I.DATE_ROWS}, {_SETTLE}, x AS (SELECT o_orderkey, {Q.labelled_date('page')} AS l, {Q.date("coalesce(asked, '')")} AS a, coalesce(reply, '') AS r FROM settle)
SELECT o_orderkey, CASE WHEN l <> '' THEN l WHEN a <> '' THEN a ELSE r END AS date, CASE WHEN l <> '' THEN 'text' WHEN a <> '' THEN 'asked' WHEN r <> '' THEN 'reply' ELSE 'none' END AS source FROM x""")
def reconcile_date(spark, sf_dir):
    k = F.col("o_orderkey")
    page = F.concat(F.when(k % 3 == 0, "Datum: ").otherwise("nothing "), S.text_of(F.col("t")))
    asked = F.when(k % 2 == 0, I.choice(I.DATES, F.floor(k / 2)))
    return I.dates(spark, sf_dir).select("o_orderkey", replies.settled_date(page, asked, I.choice(["2024-01-01", "", None], k)).alias("s")).select("o_orderkey", "s.*")


@query(f"""WITH q AS (SELECT o_orderkey, {Q.choice(I.TOTALS, 'o_orderkey')}::DOUBLE AS r, ({Q.choice(I.TOTALS, 'o_orderkey // 3')} + (o_orderkey % 2) * 0.004)::DOUBLE AS a, ({Q.choice(I.TOTALS, 'o_orderkey // 9')} + (o_orderkey % 2) * 0.008)::DOUBLE AS b FROM orders),
n AS (SELECT *, coalesce(abs(a - r) < 0.005, FALSE) AS ar, coalesce(abs(b - a) < 0.005, FALSE) AS ba FROM q)
SELECT o_orderkey, CASE WHEN ar OR (a IS NOT NULL AND ba) THEN a ELSE r END AS total, a IS NOT NULL AND NOT ar AS asked_twice, a IS NOT NULL AND NOT ar AND ba AS corrected FROM n""")
def reconcile_total(spark, sf_dir):
    k = F.col("o_orderkey")
    a, b = I.choice(I.TOTALS, F.floor(k / 3)) + (k % 2) * 0.004, I.choice(I.TOTALS, F.floor(k / 9)) + (k % 2) * 0.008
    return I.table(spark, sf_dir, "orders").select("o_orderkey", replies.settled_total(I.choice(I.TOTALS, k), a, b).alias("s")).select("o_orderkey", "s.*")


def _stub(messages):
    """A model that answers by the length of the page: at once, only when it is asked again, with a vendor alone, or not at all."""
    n, again = len(messages[1]["content"]), len(messages) > 2
    if n % 5 == 4:
        raise replies.ModelError("timeout", "no answer")
    return json.dumps({"vendor": f"V{n}", "gross_total": n / 4} if n % 5 == 0 or (n % 5 == 1 and again) else {"vendor": f"V{n}"}) if n % 5 != 3 else "no idea"


@query(f"""WITH d AS (SELECT doc_id, {Q.trim("coalesce(text, '')")} = '' AS blank, length(coalesce(text, '')) AS n FROM documents)
SELECT doc_id, CASE WHEN blank THEN 0 WHEN n % 5 IN (0, 4) THEN 1 ELSE 2 END AS attempts, CASE WHEN NOT blank AND n % 5 IN (0, 1) THEN 'ok' ELSE 'error' END AS status,
  CASE WHEN blank THEN 'nothing to send' WHEN n % 5 IN (0, 1) THEN '' WHEN n % 5 = 4 THEN 'timeout: no answer' WHEN n % 5 = 3 THEN 'the reply is not a JSON object' ELSE 'the model returned no usable fields' END AS error,
  CASE WHEN NOT blank AND n % 5 < 3 THEN 'V' || n END AS vendor, CASE WHEN NOT blank AND n % 5 < 2 THEN n / 4.0::DOUBLE END AS gross_total FROM d""")
def asked_again(spark, sf_dir):
    """Documents as pages that a model is asked about once, and once more where the answer doesn't count."""
    pages = I.table(spark, sf_dir, "documents").select("doc_id", F.lit("/in/x").alias("path"), F.lit(1).alias("page"), "text")
    return replies.analysed(pages, _stub).select("doc_id", "attempts", "status", "error", "vendor", "gross_total")


# Store, cache, history


@query(f"WITH {I.GENERATIONS} SELECT sha256, fingerprint, file_name, write_seq FROM new_docs UNION ALL SELECT sha256, fingerprint, file_name, write_seq FROM old_docs WHERE sha256 NOT IN (SELECT sha256 FROM new_docs)")
def store_upsert(spark, sf_dir):
    old, _, new, _ = I.generations(spark, sf_dir)
    return store.upsert(old, new, ["sha256"])


@query(f"WITH {I.GENERATIONS} SELECT * FROM new_bills UNION ALL SELECT * FROM old_bills WHERE sha256 NOT IN (SELECT sha256 FROM new_bills)")
def store_bills(spark, sf_dir):
    """Fewer pages the second time: the pages that went don't stay."""
    _, old, _, new = I.generations(spark, sf_dir)
    return store.replace_bills(old, new)


@query(f"WITH {I.GENERATIONS} SELECT * FROM old_bills WHERE sha256 NOT IN (SELECT sha256 FROM new_docs)")
def forget(spark, sf_dir):
    _, old, new, _ = I.generations(spark, sf_dir)
    return store.forget(old, new)


@query(f"""WITH {I.GENERATIONS}, incoming AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE sha256 END AS sha256, 'fp' || (doc_id % 2 + 1) AS fingerprint FROM hashed),
held AS (SELECT DISTINCT sha256, fingerprint FROM old_docs WHERE sha256 IN (SELECT sha256 FROM old_bills WHERE page = 2)) SELECT doc_id, held.sha256 IS NOT NULL AS hit FROM incoming LEFT JOIN held USING (sha256, fingerprint)""")
def cache_probe(spark, sf_dir):
    old, bills, _, _ = I.generations(spark, sf_dir)
    d, k = I.table(spark, sf_dir, "documents"), F.col("doc_id")
    base = d.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    incoming = base.select("doc_id", F.when(k % 7 == 0, "").otherwise(F.sha2(F.concat(k.cast("string"), F.lit("|"), F.col("text")), 256)).alias("sha256"), F.concat(F.lit("fp"), k % 2 + 1).alias("fingerprint"))
    return store.cache_probe(incoming, old, bills.filter("page = 2")).select("doc_id", "hit")


@query(f"WITH {I.GENERATIONS} SELECT page, gross_cents, file_name FROM old_bills JOIN old_docs USING (sha256) WHERE sha256 = (SELECT sha256 FROM hashed WHERE doc_id = 5) ORDER BY page")
def bills_of_document(spark, sf_dir):
    old, bills, _, _ = I.generations(spark, sf_dir)
    sha = old.filter("file_name = 'f5.pdf'").select("sha256").first()
    docs = old.withColumn("source_path", F.lit("")).withColumn("model", F.lit(""))
    return store.bills_of(bills, docs, sha["sha256"] if sha else "").select("page", "gross_cents", "file_name")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey ORDER BY o_orderdate DESC, l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey DESC, l_suppkey DESC LIMIT 20""")
def history_topk(spark, sf_dir):
    """Lines are bills, orders their documents."""
    li = I.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sha256"), "l_linenumber", "l_partkey", (F.col("l_orderkey") * 1_000_000 + F.col("l_linenumber") * 100_000 + F.col("l_partkey")).alias("write_seq"), "l_suppkey")
    docs = I.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sha256"), F.col("o_custkey").alias("file_name"), F.lit("").alias("source_path"), F.lit("").alias("model"), F.col("o_orderdate").alias("created_at"))
    bills = li.join(docs.select("sha256", "created_at"), "sha256")
    top = store.history(bills, docs.drop("created_at"), 20, ("created_at", "write_seq", "l_suppkey"))
    return top.select(F.col("sha256").alias("l_orderkey"), "l_linenumber", "l_partkey", F.col("file_name").alias("o_custkey"))


@query("SELECT count(*) AS bills FROM lineitem")
def history_count(spark, sf_dir):
    return store.bill_count(I.table(spark, sf_dir, "lineitem"))


@query(f"""WITH {I.BILLS}, t AS (SELECT *, CASE WHEN gross_cents IS NULL THEN '-' ELSE {Q.bare_money('gross_cents / 100.0::DOUBLE')} || ' ' || currency END AS amount FROM bills)
SELECT path, page, date || ' 08:30  ' || rpad(vendor, 20, ' ') || '  ' || rpad(date, 10, ' ') || '  ' || CASE WHEN length(amount) < 12 THEN lpad(amount, 12, ' ') ELSE amount END || '  p' || page || ' ' || file_id || '.pdf' AS line FROM t""")
def history_lines(spark, sf_dir):
    line = render.history_line(F.concat("date", F.lit("T08:30:00")), F.col("vendor"), F.col("date"), S.from_cents(F.col("gross_cents")), F.col("currency"), F.col("page"), F.concat("file_id", F.lit(".pdf")))
    return I.bills(spark, sf_dir).select(I.path(), "page", line.alias("line"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders")
def newest_documents(spark, sf_dir):
    """All documents with their place from the newest."""
    docs = I.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sha256"), F.col("o_orderdate").alias("created_at"))
    return store.placed_documents(docs).select(F.col("sha256").alias("o_orderkey"), "place")


def _stored(spark, sf_dir):
    """A store in the shared folder with both generations saved one after the other; what went before is the second's file names."""
    old, old_bills, new, new_bills = I.generations(spark, sf_dir)
    out = store.Store(spark, f"{staged.shared_folder(spark)}/store-{uuid.uuid4().hex}", buckets=8)
    names = {t: [x.split() for x in schema.split(", ")] for t, schema in (("documents", store.DOCUMENTS), ("bills", store.BILLS))}
    whole = lambda rows, t: rows.select(*[F.col(n) if n in rows.columns else F.lit(None).cast(kind).alias(n) for n, kind in names[t]])
    at = F.format_string("%d-%s", "write_seq", F.substring("sha256", 1, 6))
    for docs, bills in ((old, old_bills), (new, new_bills)):
        bills = bills.withColumn("gross_total", F.col("gross_cents").cast("double")).withColumn("created_at", at)
        out.save(whole(docs.withColumn("created_at", at), "documents"), whole(bills, "bills"))
    return out


_NOW = """now_docs AS (SELECT * FROM new_docs UNION ALL SELECT * FROM old_docs WHERE sha256 NOT IN (SELECT sha256 FROM new_docs)),
now_bills AS (SELECT * FROM new_bills UNION ALL SELECT * FROM old_bills WHERE sha256 NOT IN (SELECT sha256 FROM new_docs))"""


@query(f"WITH {I.GENERATIONS}, {_NOW} SELECT sha256, page, gross_cents::DOUBLE AS gross_total, write_seq FROM now_bills")
def stored_bills(spark, sf_dir):
    """Two saves to a store on files, then its bills: pages that a document no longer has are gone."""
    return _stored(spark, sf_dir).numbered_bills().select("sha256", "page", "gross_total", "write_seq")


@query(f"WITH {I.GENERATIONS}, {_NOW} SELECT sha256, page, file_name, gross_cents::DOUBLE AS gross_total FROM now_bills JOIN now_docs USING (sha256) ORDER BY now_bills.write_seq || '-' || left(sha256, 6) DESC, now_bills.write_seq DESC, page DESC, sha256 DESC LIMIT 50")
def stored_history(spark, sf_dir):
    """The latest bills of a store on files, read newest file first."""
    return _stored(spark, sf_dir).history(50).select("sha256", "page", "file_name", "gross_total")


@query(f"""WITH {I.GENERATIONS}, {_NOW}, asked AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 11 = 0 THEN 'none' || doc_id ELSE sha256 END AS sha256, 'fp' || (doc_id % 2 + 1) AS fingerprint FROM hashed)
SELECT asked.doc_id, now_docs.sha256 IS NOT NULL AS hit FROM asked LEFT JOIN now_docs USING (sha256, fingerprint)""")
def stored_probe(spark, sf_dir):
    """The cache of a store on files: its filters tell misses, hits are looked up in their buckets."""
    d, k = I.table(spark, sf_dir, "documents"), F.col("doc_id")
    base = d.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    sha = F.sha2(F.concat(k.cast("string"), F.lit("|"), F.col("text")), 256)
    asked = base.select("doc_id", F.when(k % 7 == 0, "").when(k % 11 == 0, F.concat(F.lit("none"), k)).otherwise(sha).alias("sha256"), F.concat(F.lit("fp"), k % 2 + 1).alias("fingerprint"))
    return _stored(spark, sf_dir).probe(asked).select("doc_id", "hit")


# Rendering


@query(f"""WITH {I.BILLS}, t AS (SELECT *, {Q.bare_money('gross_cents / 100.0::DOUBLE')} AS n, file_id || '.pdf' AS name FROM bills)
SELECT path, page, CASE WHEN page_count > 1 THEN name || ':' || page ELSE name END AS label, CASE WHEN page_count > 1 THEN name || ', S. ' || page ELSE name END AS place,
  CASE WHEN vendor = '' THEN '?' ELSE vendor END || ', ' || date || ', ' || CASE WHEN gross_cents IS NULL THEN '?' ELSE n || ' ' || currency END AS summary,
  name || '  ' || CASE WHEN vendor = '' THEN '-' ELSE vendor END || '  ' || date || '  ' || CASE WHEN gross_cents IS NULL THEN '-' ELSE n || ' ' || currency END AS line, {Q.money('gross_cents / 100.0::DOUBLE', 'currency')} AS money FROM t""")
def bill_labels(spark, sf_dir):
    p, gross = I.path(), S.from_cents(F.col("gross_cents"))
    return I.bills(spark, sf_dir).select(
        p, "page", render.label(p, F.col("page"), F.col("page_count")).alias("label"), render.place(render.base_name(p), F.col("page"), F.col("page_count")).alias("place"),
        render.summary(F.col("vendor"), F.col("date"), gross, F.col("currency")).alias("summary"), render.analysis_line(render.base_name(p), F.col("vendor"), F.col("date"), gross, F.col("currency")).alias("line"), render.money(gross, F.col("currency")).alias("money"),
    )


@query(f"""WITH {I.BILLS}, {Q.file_sums('bills', 'file_id')}, l AS (SELECT file_id, string_agg(file_id || '.pdf' || CASE WHEN n > 1 THEN ' p' || page ELSE '' END || ': ' || CASE WHEN status = 'ok' THEN CASE WHEN vendor = '' THEN '?' ELSE vendor END || ', ' || date || ', '
  || CASE WHEN gross_cents IS NULL THEN '?' ELSE {Q.bare_money('gross_cents / 100.0::DOUBLE')} || ' ' || currency END ELSE 'unreadable page' END, chr(10) ORDER BY page) AS lines FROM (SELECT *, count(*) OVER (PARTITION BY file_id) AS n FROM bills) GROUP BY 1)
SELECT '/inbox/' || file_id || '.pdf' AS path, lines || CASE WHEN present > 1 THEN chr(10) || file_id || '.pdf: sum ' || money || CASE WHEN complete THEN '' ELSE ' (' || {Q.COVERED} || ')' END ELSE '' END AS body FROM l JOIN sums USING (file_id)""")
def notification(spark, sf_dir):
    return lists.notifications(I.bills(spark, sf_dir).withColumn("path", I.path()), ("file_id", "path"))


@query("SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM pages")
def escape_html(spark, sf_dir):
    return I.table(spark, sf_dir, "pages").select("page_id", render.escape_html(F.col("html")).alias("escaped"))


_DETAIL = f"""d AS (SELECT *, file_id || '.pdf' AS file FROM bills),
h AS (SELECT path, page, 'Datei: ' || CASE WHEN page_count > 1 THEN file || ', S. ' || page ELSE file END || chr(10) || 'Pfad: ' || path || chr(10) || 'Status: ' || status || CASE WHEN status = 'error' THEN chr(10) || 'Fehler: unreadable page' ELSE '' END AS head,
  CASE WHEN vendor = '' THEN '' ELSE 'Aussteller: ' || vendor || ' & Co <x>' || chr(10) END AS vendor, 'Datum: ' || date AS date, CASE WHEN gross_cents IS NULL THEN '' ELSE 'Betrag: ' || {Q.money('gross_cents / 100.0::DOUBLE', 'currency')} END AS gross, 'Textlayer: ' || CASE WHEN page % 2 = 0 THEN 'ja' ELSE 'nein' END
  || chr(10) || 'Extrahiert: ' || page || ' ms' || CASE WHEN page % 3 = 0 THEN chr(10) || 'Notiz: third' ELSE '' END || chr(10) || 'batch: ' || page AS rest FROM d)"""


@query(f"""WITH {I.BILLS}, {_DETAIL} SELECT path, page, head || chr(10) || chr(10) || vendor || date || CASE WHEN gross = '' THEN '' ELSE chr(10) || gross END || chr(10) || chr(10) || rest AS text,
  replace(replace(head, '&', '&amp;'), chr(10), '<br>') || '<br><br>' || replace(replace(replace(replace(vendor, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '<br>') || '<b>' || date || '</b>' || CASE WHEN gross = '' THEN '' ELSE '<br><b>' || gross || '</b>' END || '<br><br>' || replace(rest, chr(10), '<br>') AS html FROM h""")
def detail_text(spark, sf_dir):
    p, page = I.path(), F.col("page")
    bill = {"file": render.base_name(p), "path": p, "bill": page, "bill_count": F.col("page_count"), "status": F.col("status"), "error": F.col("error"), "vendor": F.when(F.col("vendor") != "", F.concat("vendor", F.lit(" & Co <x>"))), "date": F.col("date"), "currency": F.col("currency"), "gross_total": S.from_cents(F.col("gross_cents")), "has_text_layer": page % 2 == 0, "extract_ms": page, "notes": F.when(page % 3 == 0, F.array(F.lit("third")))}
    extra = F.create_map(F.lit("batch"), page.cast("string"), F.lit("zzz"), F.lit(""), F.lit("vendor"), F.lit("known"))
    return render.with_details(I.bills(spark, sf_dir).withColumn("path", p), bill, extra).select("path", "page", "text", "html")


# Comparison with expectations


@query("""SELECT o_orderkey AS document, o_orderkey % 3 + 1 AS bill, o_orderkey % 3 < 2 AS found, o_orderkey % 3 < 2 AS vendor_ok, o_orderkey % 3 < 2 AND o_orderkey % 4 <> 1 AS date_ok, o_orderkey % 3 < 2 AND o_orderkey % 5 <> 0 AS currency_ok, o_orderkey % 3 < 2 AND o_orderkey % 7 <> 0 AS total_ok FROM orders""")
def expectation(spark, sf_dir):
    """Each document has two pages; every third expectation asks for a third. The wrong date is one that no order can have."""
    o, k = I.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    actual = o.select(k.alias("document"), F.explode(F.array(F.lit(1), F.lit(2))).alias("bill"), F.lit("Bäcker-Meier GmbH").alias("vendor"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.when(k % 5 == 0, "USD").otherwise("EUR").alias("currency"), F.col("o_totalprice").alias("gross_total"))
    wrong = F.when(k % 4 == 1, "1999-02-30").when(k % 4 == 2, "*").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    expected = o.select(k.alias("document"), (k % 3 + 1).cast("int").alias("bill"), F.when(k % 2 == 0, "/^b.cker/").otherwise("bäcker meier gmbh").alias("vendor"), wrong.alias("date"), F.lit("EUR").alias("currency"), F.format_string("%.2f", F.col("o_totalprice") + F.when(k % 7 == 0, 0.02).otherwise(0.0)).alias("gross_total"))
    return lists.compared(expected, actual)


_PATTERNS = ["/^b.cker/", "/[/", "/(a/", "/*x/", "bäcker meier gmbh", "/a{2,1}/", "/meier|huber/", "[", "//", None]


@query(f"""WITH e AS (SELECT o_orderkey, {Q.choice(_PATTERNS, 'o_orderkey')} AS vendor FROM orders)
SELECT o_orderkey AS document, coalesce(vendor IN ('/^b.cker/', '/meier|huber/', 'bäcker meier gmbh'), FALSE) AS vendor_ok, CASE WHEN vendor IN ('/[/', '/(a/', '/*x/', '/a{{2,1}}/') THEN 'invalid pattern ' || vendor END AS finding FROM e""")
def bad_patterns(spark, sf_dir):
    """Expectations among which some patterns are none: findings of their own rows."""
    k = F.col("o_orderkey")
    o = I.table(spark, sf_dir, "orders").select(k.alias("document"), F.lit(1).alias("bill"))
    actual = o.select("document", "bill", F.lit("Bäcker-Meier GmbH").alias("vendor"), F.lit("").alias("date"), F.lit("").alias("currency"), F.lit(1.0).alias("gross_total"))
    expected = o.select("document", "bill", I.choice(_PATTERNS, F.col("document")).alias("vendor"), *[F.lit("*").alias(c) for c in ("date", "currency", "gross_total")])
    return lists.compared(expected, actual).select("document", "bill", "vendor_ok").join(lists.pattern_findings(expected), ["document", "bill"], "left").select("document", "vendor_ok", "finding")


# Lines of JSON


_NDJSON = ["", "  ", "0", "null", "[1]", "{broken", '"text"', '{"file": "a.pdf"}']


@query(f"""WITH l AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN {Q.choice(_NDJSON, 'event_id // 4')} ELSE props END AS value FROM events) SELECT event_id, coalesce(json_type(TRY_CAST(value AS JSON)) = 'OBJECT', FALSE) AS is_bill FROM l WHERE trim(coalesce(value, '')) <> ''""")
def ndjson_parse(spark, sf_dir):
    k = F.col("event_id")
    lines = I.table(spark, sf_dir, "events").select("event_id", F.when(k % 4 == 0, I.choice(_NDJSON, F.floor(k / 4))).otherwise(F.col("props")).alias("value"))
    return ndjson.parsed(lines).select("event_id", "is_bill")


@query(f"""WITH l AS (SELECT CASE WHEN event_id % 4 = 0 THEN {Q.choice(_NDJSON, 'event_id // 4')} ELSE props END AS value FROM events), o AS (SELECT coalesce(json_type(TRY_CAST(value AS JSON)) = 'OBJECT', FALSE) AS is_bill FROM l WHERE trim(coalesce(value, '')) <> '') SELECT count(*) FILTER (is_bill) AS bills, count(*) FILTER (NOT is_bill) AS broken FROM o""")
def ndjson_broken(spark, sf_dir):
    k = F.col("event_id")
    return ndjson.broken(I.table(spark, sf_dir, "events").select(F.when(k % 4 == 0, I.choice(_NDJSON, F.floor(k / 4))).otherwise(F.col("props")).alias("value")))


def _emitted(spark, sf_dir):
    no = F.lit(None).cast("double")
    rows = I.bills(spark, sf_dir).select(
        I.path(), "page", "page_count", "status", "error", F.lit("").alias("quality_warning"), F.lit(False).alias("has_text_layer"), F.lit(True).alias("from_cache"), F.lit(3).alias("extract_ms"), F.lit(0).alias("inference_ms"), F.array(F.lit("n")).alias("notes"),
        no.alias("confidence"), S.normalise_currency(F.col("currency")).alias("currency"), "date", F.lit("").alias("due_date"), S.from_cents(F.col("gross_cents")).cast("decimal(18,2)").alias("gross_total"), F.lit("").alias("iban"), F.lit("").alias("invoice_number"), no.alias("net_total"), no.alias("tax_total"), "vendor", F.lit("").alias("vendor_address"),
    )
    return ndjson.emitted(rows)


_CODE = "CASE WHEN currency IN ('EUR', 'eur ') THEN 'EUR' ELSE currency END"


@query(f"""WITH {I.BILLS} SELECT '{{"file":"' || file_id || '.pdf","path":"' || path || '","bill":' || page || ',"bill_count":' || page_count || ',"status":"' || status || '"' || CASE WHEN status = 'error' THEN ',"error":"unreadable page"' ELSE '' END
  || ',"has_text_layer":false,"from_cache":true,"extract_ms":3,"inference_ms":0,"notes":["n"],"confidence":null,"currency":"' || {_CODE} || '","date":"' || date || '","due_date":"","gross_total":' || coalesce(printf('%.2f', gross_cents / 100.0::DOUBLE), 'null')
  || ',"iban":"","invoice_number":"","net_total":null,"tax_total":null,"vendor":"' || vendor || '","vendor_address":""}}' AS value FROM bills""")
def ndjson_emit(spark, sf_dir):
    return _emitted(spark, sf_dir)


@query(f"""WITH {I.BILLS} SELECT path, page, page_count, status, CASE WHEN status = 'error' THEN 'unreadable page' ELSE '' END AS error, vendor, date, {_CODE} AS currency, gross_cents / 100.0::DOUBLE AS gross_total FROM bills""")
def ndjson_round_trip(spark, sf_dir):
    """Bills written as lines and read back."""
    b = ndjson.with_bill(_emitted(spark, sf_dir), name="b")
    return b.select("b.path", "b.page", "b.page_count", "b.status", "b.error", "b.invoice.vendor", "b.invoice.date", "b.invoice.currency", "b.invoice.gross_total")


# Documents and pages


def _text_pages(spark, sf_dir):
    d = I.table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL")
    return d.select(F.col("doc_id").alias("path"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n"))).select("path", (F.col("pos") + 1).alias("page"), F.col("col").alias("text"))


_PAGES = "texts AS (SELECT doc_id AS path, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents WHERE doc_id IS NOT NULL), pp AS (SELECT path, len(ls) AS n, generate_subscripts(ls, 1) AS page, unnest(ls) AS text FROM texts)"


@query(f"WITH {_PAGES} SELECT path, count(*) AS pages, sum(length(text))::DOUBLE / count(*) AS mean_chars, CASE WHEN sum(length(text))::DOUBLE / count(*) >= 120 THEN 'text' ELSE 'raster' END AS route FROM pp GROUP BY 1")
def text_layer_route(spark, sf_dir):
    """Lines of a document as its pages."""
    return files.text_layer(_text_pages(spark, sf_dir))


@query(f"WITH {_PAGES} SELECT path, page, text, n AS page_count, greatest(0, n - 3) AS skipped FROM pp WHERE page <= 3")
def page_limit(spark, sf_dir):
    return files.limited(_text_pages(spark, sf_dir), 3)


@query(f"""WITH RECURSIVE words AS (SELECT doc_id::VARCHAR AS path, string_split(trim(coalesce(text, '')), ' ') AS ws FROM documents WHERE doc_id IS NOT NULL),
numbered AS (SELECT path, i, {Q.trim("ws[i + 1]")} AS text FROM (SELECT path, ws, unnest(range(len(ws))) AS i FROM words)),
boxes AS (SELECT path, (i // 120 + 1)::INT AS page, (i * 3 % 10) * 50.0::DOUBLE + CASE WHEN i * 3 % 10 >= 5 THEN 20.0::DOUBLE ELSE 0.0::DOUBLE END AS x0, (i // 10) * 9.0::DOUBLE + (i * 7 % 8) * 0.25::DOUBLE AS y0, 4.0::DOUBLE + (i % 4) * 3.0::DOUBLE AS tall, text FROM numbered WHERE text <> ''),
mids AS (SELECT path, page, x0, x0 + 48 AS x1, text, (y0 + (y0 + tall)) / 2 AS mid, tall FROM boxes),
steps AS (SELECT *, CASE WHEN mid - lag(mid) OVER (PARTITION BY path, page ORDER BY mid) > 1 THEN 1 ELSE 0 END AS step FROM mids),
heights AS (SELECT *, sum(step) OVER (PARTITION BY path, page ORDER BY mid) AS height FROM steps),
placed AS (SELECT *, row_number() OVER w AS n, lag(x1) OVER w AS right_edge FROM heights WINDOW w AS (PARTITION BY path, page ORDER BY height, x0, x1, text)),
fold AS (SELECT path, page, n, mid, tall, TRUE AS fresh FROM placed WHERE n = 1
  UNION ALL SELECT p.path, p.page, p.n, CASE WHEN abs(p.mid - f.mid) > 0.6::DOUBLE * greatest(f.tall, p.tall) THEN p.mid ELSE f.mid END, CASE WHEN abs(p.mid - f.mid) > 0.6::DOUBLE * greatest(f.tall, p.tall) THEN p.tall ELSE greatest(f.tall, p.tall) END, abs(p.mid - f.mid) > 0.6::DOUBLE * greatest(f.tall, p.tall)
  FROM fold f JOIN placed p ON p.path = f.path AND p.page = f.page AND p.n = f.n + 1)
SELECT path, page, string_agg(CASE WHEN n = 1 THEN '' WHEN fresh THEN chr(10) WHEN x0 - right_edge > 6 THEN '    ' ELSE ' ' END || text, '' ORDER BY n) AS text FROM placed JOIN fold USING (path, page, n) GROUP BY path, page""")
def layout_rows(spark, sf_dir):
    """Words of a document as boxes, ten to a height and not in order: heights with broken offsets, sizes that differ, a wide gap after every fifth."""
    d = I.table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL")
    w = d.select(F.col("doc_id").cast("string").alias("path"), F.posexplode(F.split(F.trim(F.coalesce("text", F.lit(""))), " ")).alias("i", "text"))
    at = F.col("i") * 3 % 10
    x, y, tall = at * 50.0 + F.when(at >= 5, 20.0).otherwise(0.0), F.floor(F.col("i") / 10) * 9.0 + (F.col("i") * 7 % 8) * 0.25, 4.0 + (F.col("i") % 4) * 3.0
    boxes = w.select("path", (F.floor(F.col("i") / 120) + 1).cast("int").alias("page"), x.alias("x0"), y.alias("y0"), (x + 48).alias("x1"), (y + tall).alias("y1"), "text")
    return files.layout_rows(boxes)


@query(f"SELECT doc_id, sha256(coalesce(text, '')) AS sha256, CASE WHEN {Q.trim("coalesce(text, '')")} = '' THEN 'no text found' ELSE '' END AS error FROM documents")
def content_hashes(spark, sf_dir):
    d = I.table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    return files.text_or_error(d).select("doc_id", files.content_hash(F.col("text").cast("binary")).alias("sha256"), "error")


# The inbox


_SCANS = """scans AS (SELECT tick, path, min(size) AS size, min(size) * 7 AS mtime_ms FROM (SELECT event_id // 40 AS tick, user_id % 97 AS path, floor(value / 60)::BIGINT AS size FROM events) GROUP BY 1, 2)"""


def _scans(spark, sf_dir):
    e = I.table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 40).alias("tick"), (F.col("user_id") % 97).cast("string").alias("path"), F.floor(F.col("value") / 60).alias("size"))
    return e.groupBy("tick", "path").agg(F.min("size").alias("size")).withColumn("mtime_ms", F.col("size") * 7)


_REPLAY = f"""{_SCANS}, numbered AS (SELECT *, dense_rank() OVER (ORDER BY tick) AS n FROM scans),
g AS (SELECT *, CASE WHEN n - lag(n) OVER (PARTITION BY path ORDER BY n) = 1 THEN 0 ELSE 1 END AS fresh FROM numbered), s AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY n ROWS UNBOUNDED PRECEDING) AS seen FROM g),
z AS (SELECT *, CASE WHEN size IS NOT DISTINCT FROM lag(size) OVER (PARTITION BY path, seen ORDER BY n) THEN 0 ELSE 1 END AS moved FROM s), r AS (SELECT *, sum(moved) OVER (PARTITION BY path, seen ORDER BY n ROWS UNBOUNDED PRECEDING) AS run FROM z),
k AS (SELECT *, row_number() OVER (PARTITION BY path, seen, run ORDER BY n) AS nth FROM r), reports AS (SELECT path, tick, size, mtime_ms FROM k WHERE nth = 3)"""


@query(f"WITH {_REPLAY} SELECT path::VARCHAR AS path, tick, size, mtime_ms FROM reports")
def settle_replay(spark, sf_dir):
    return inbox.settle_replay(_scans(spark, sf_dir))


@query(f"WITH {_REPLAY} SELECT path::VARCHAR AS path FROM k WHERE tick = (SELECT max(tick) FROM scans) AND nth < 3")
def inbox_pending(spark, sf_dir):
    return inbox.pending(_scans(spark, sf_dir))


@query("SELECT doc_id AS path, n_chars AS size, doc_id AS mtime_ms FROM documents d WHERE doc_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND d.doc_id % 3 > 0)")
def handled_anti(spark, sf_dir):
    """Labelled documents have been handled; every third has changed since."""
    docs = I.table(spark, sf_dir, "documents").filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("size"), F.col("doc_id").alias("mtime_ms"))
    done = docs.join(I.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("path")).distinct(), "path", "left_semi")
    return lists.handled_anti(docs, done.withColumn("mtime_ms", F.when(F.col("path") % 3 > 0, F.col("mtime_ms")).otherwise(-1)))
