"""Bill-shaped views of the driver's tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from billoom.functions import scalars

from . import sql as Q

# Edge cases by kind; queries take them in turn among rendered values.
AMOUNTS = ["1190.00", "1190,00", "1.190,00", "1'190.00", "€ 1.190,00", "EUR 18,48", "18,48-", "-35,01", "SUMME -35,01", "-1.190,00", "1.190.000,55", "42", "0,00", "0.123", "1190.000", "-0.123", "-123.456", "123.456", "134,60.", "1,190,00", "1,190,000", "12-5", "--5", "1190,", "1.190.00", "", "N/A", "-", "unbekannt", "EUR", "keine Angabe 12", None]
DATES = ["2025-05-07", "2025-05-07T11:37:45", "07/05/2025", "01.05.2025", "01.05.2025 - 07.09.2025", "17.07.2025 11:37:45", "17.07.25", "20250717", "  17.07.2025 ", "", "not visible", "01341698", "17.13.2025", "gestern", "31.02.2025", "70.23.22.57", "5.6.99", "2025-13-01", "x20250717", "unleserlich 2025-05-07", None]
CURRENCIES = ["€", "eur", "Euro", "$", "£", "CHF", "PLN", "5 dkk", "usd 3", "not visible", "nil", "", "??", "abcd", "Pln 3", "€ 5 USD", None]
TOTALS = [10.0, 12.5, None]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def choice(values: list, key: Column) -> Column:
    """One of the values by key modulo their number."""
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as bills: an order is a file (file_id), its lines are pages. One shuffle, by order."""
    li = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("file_id").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    gross = F.when(F.col("l_discount") == 0, None).when(F.col("l_tax") == 0, -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice"))
    failed = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (F.col("l_quantity") > 45)
    rows = li.select(F.col("l_orderkey").alias("file_id"), "l_linenumber", "l_partkey", "l_suppkey", F.when(failed, "error").otherwise("ok").alias("status"), gross.alias("gross"), choice(["EUR", "eur ", "USD", ""], F.col("l_suppkey")).alias("currency"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"))
    return rows.select(
        "file_id", F.row_number().over(w).alias("page"),
        (F.count("*").over(Window.partitionBy("file_id")) + F.when(F.col("file_id") % 7 == 0, 2).otherwise(0)).alias("page_count"),
        "status", scalars.to_cents(F.col("gross")).alias("gross_cents"), "currency", "date", F.when(F.col("l_suppkey") % 9 == 0, "").otherwise(F.concat(F.lit("Vendor "), F.col("l_suppkey"))).alias("vendor"),
        F.when(F.col("status") == "error", "unreadable page").alias("error"),
    )


def path() -> Column:
    return F.concat(F.lit("/inbox/"), F.col("file_id"), F.lit(".pdf")).alias("path")


BILLS = """bills AS (SELECT l_orderkey AS file_id, '/inbox/' || l_orderkey || '.pdf' AS path,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS page,
  count(*) OVER (PARTITION BY l_orderkey) + CASE WHEN l_orderkey % 7 = 0 THEN 2 ELSE 0 END AS page_count,
  CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity > 45 THEN 'error' ELSE 'ok' END AS status,
  CAST(round(CASE WHEN l_discount = 0 THEN NULL WHEN l_tax = 0 THEN -l_extendedprice ELSE l_extendedprice END * 100) AS BIGINT) AS gross_cents,
  CASE l_suppkey % 4 WHEN 0 THEN 'EUR' WHEN 1 THEN 'eur ' WHEN 2 THEN 'USD' ELSE '' END AS currency,
  strftime(l_shipdate, '%Y-%m-%d') AS date, CASE WHEN l_suppkey % 9 = 0 THEN '' ELSE 'Vendor ' || l_suppkey END AS vendor FROM lineitem)"""


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as one list of bills in order of event_id; a file is an event type."""
    e, v = table(spark, sf_dir, "events"), F.col("value")
    k = F.col("event_id")
    return e.select("event_id", "event_type", F.when(k % 11 == 0, "error").otherwise("ok").alias("status"), F.when(k % 7 != 0, scalars.to_cents(v)).alias("gross_cents"), choice(["EUR", "EUR", "USD"], k).alias("currency"), F.lit(1).alias("page_count"))


LISTED = """listed AS (SELECT event_id, event_type, CASE WHEN event_id % 11 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN event_id % 7 <> 0 THEN CAST(round(value * 100) AS BIGINT) END AS gross_cents,
  (['EUR', 'EUR', 'USD'])[event_id % 3 + 1] AS currency, 1 AS page_count FROM events),
flagged AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (ORDER BY event_id) AND row_number() OVER (ORDER BY event_id) > 1 THEN 0 ELSE 1 END AS n FROM listed),
runs AS (SELECT * EXCLUDE (n), sum(n) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run_id FROM flagged)"""


def amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part prices written five ways, every third an edge case."""
    p, price = F.col("p_partkey"), F.col("p_retailprice")
    plain = F.format_string("%.2f", price)
    grouped = F.regexp_replace(plain, r"(\d)(?=(\d{3})+\.)", "$1,")
    ways = F.array(plain, F.replace(plain, F.lit("."), F.lit(",")), grouped, F.translate(grouped, ",.", ".,"), F.concat(F.lit("EUR "), F.translate(grouped, ",.", "',")))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(p % 3 == 0, choice(AMOUNTS, F.floor(p / 3))).otherwise(F.element_at(ways, (p % 5 + 1).cast("int"))).alias("t"))


PLAIN = "printf('%.2f', p_retailprice)"
GROUPED = f"CASE WHEN length({PLAIN}) > 6 THEN left({PLAIN}, -6) || ',' || right({PLAIN}, 6) ELSE {PLAIN} END"
AMOUNT_ROWS = f"""amounts AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN {Q.choice(AMOUNTS, 'p_partkey // 3')}
  ELSE ([{PLAIN}, replace({PLAIN}, '.', ','), {GROUPED}, translate({GROUPED}, ',.', '.,'), 'EUR ' || translate({GROUPED}, ',.', chr(39) || ',')])[p_partkey % 5 + 1] END AS t FROM part)"""


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written six ways, edge cases, and every placeholder."""
    o, d, k = table(spark, sf_dir, "orders"), F.col("o_orderdate"), F.col("o_orderkey")
    ways = F.array(*[F.date_format(d, f) for f in ("yyyy-MM-dd", "dd.MM.yyyy", "yyyyMMdd", "dd/MM/yyyy", "d.M.yy")], F.concat(F.lit("am "), F.date_format(d, "d.M.yyyy"), F.lit(", 12:00")))
    other = F.when(k % 2 == 0, choice(DATES, F.floor(k / 10))).otherwise(choice(scalars.PLACEHOLDERS, F.floor(k / 10)))
    return o.select("o_orderkey", F.when(k % 5 == 0, other).otherwise(F.element_at(ways, (k % 6 + 1).cast("int"))).alias("t"))


DATE_ROWS = f"""dates AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN {Q.choice(DATES, 'o_orderkey // 10')} ELSE {Q.choice(scalars.PLACEHOLDERS, 'o_orderkey // 10')} END
  ELSE ([strftime(o_orderdate, '%Y-%m-%d'), strftime(o_orderdate, '%d.%m.%Y'), strftime(o_orderdate, '%Y%m%d'), strftime(o_orderdate, '%d/%m/%Y'), day(o_orderdate) || '.' || month(o_orderdate) || '.' || strftime(o_orderdate, '%y'),
    'am ' || day(o_orderdate) || '.' || month(o_orderdate) || '.' || year(o_orderdate) || ', 12:00'])[o_orderkey % 6 + 1] END AS t FROM orders)"""

#: Wrappings of a reply's object.
WRAPS = [("", ""), ("```json\n", "\n```"), ("Here it is: ", " Anything else?"), ("  \n", "\n "), ("```\n", "\n``` done")]


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a model's replies: JSON bare, fenced or in prose, fields missing, misspelt or of other types, and no JSON at all."""
    k, price = F.col("p_partkey"), F.format_string("%.2f", F.col("p_retailprice"))
    vendor = F.when(k % 13 == 0, "N/A").otherwise(F.concat(F.lit("Shop "), k))
    gross = F.when(k % 3 == 0, price).when(k % 3 == 1, F.concat(F.lit('"'), F.replace(price, F.lit("."), F.lit(",")), F.lit(' EUR"'))).otherwise("null")
    body = F.concat(F.lit('{"vendor": "'), vendor, F.lit('", "date": "'), choice(["2025-05-07", "17.07.25", "unknown"], k), F.lit('", "currency": "'), choice(["€", "PLN", "nil"], k), F.lit('", "iban": "AT 12 34", "net_total": true, "gross_total": '), gross, F.lit("}"))
    wrapped = F.concat(choice([a for a, _ in WRAPS], k), body, choice([z for _, z in WRAPS], k))
    # Parts are short rows in few pieces, their replies long work.
    return table(spark, sf_dir, "part").select("p_partkey", "p_retailprice").repartition("p_partkey").select("p_partkey", F.when(k % 17 == 0, "").when(k % 19 == 0, "no object here").when(k % 23 == 0, "[1, 2]").when(k % 29 == 0, "{broken}").otherwise(wrapped).alias("reply"))


REPLY_ROWS = f"""replies AS (SELECT p_partkey, CASE WHEN p_partkey % 17 = 0 THEN '' WHEN p_partkey % 19 = 0 THEN 'no object here' WHEN p_partkey % 23 = 0 THEN '[1, 2]' WHEN p_partkey % 29 = 0 THEN '{{broken}}' ELSE
  {Q.choice([a for a, _ in WRAPS], 'p_partkey')} || '{{"vendor": "' || CASE WHEN p_partkey % 13 = 0 THEN 'N/A' ELSE 'Shop ' || p_partkey END || '", "date": "' || {Q.choice(["2025-05-07", "17.07.25", "unknown"], 'p_partkey')}
  || '", "currency": "' || {Q.choice(["€", "PLN", "nil"], 'p_partkey')} || '", "iban": "AT 12 34", "net_total": true, "gross_total": '
  || CASE p_partkey % 3 WHEN 0 THEN {PLAIN} WHEN 1 THEN '"' || replace({PLAIN}, '.', ',') || ' EUR"' ELSE 'null' END || '}}' || {Q.choice([z for _, z in WRAPS], 'p_partkey')} END AS reply FROM part)"""


def generations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """documents as a store and a second write: (old documents, old bills, new documents, new bills). A document has up to three bills, the second time up to two."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    base = d.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    doc = lambda gen: base.select(F.sha2(F.concat(k.cast("string"), F.lit("|"), F.col("text")), 256).alias("sha256"), "doc_id", F.lit(f"fp{gen}").alias("fingerprint"), F.concat(F.lit("f"), k, F.lit(".pdf")).alias("file_name"), F.lit(gen).alias("write_seq"))
    bill = lambda docs, n: docs.select("sha256", F.explode(F.sequence(F.lit(1), (k % n + 1).cast("int"))).alias("page"), (k * 10 + F.col("write_seq")).alias("gross_cents"), "write_seq")
    old, new = doc(1).filter("doc_id % 3 <> 0"), doc(2).filter("doc_id % 2 = 0")
    return old.drop("doc_id"), bill(old, 3), new.drop("doc_id"), bill(new, 2)


GENERATIONS = """base AS (SELECT doc_id, min(coalesce(text, '')) AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY 1),
hashed AS (SELECT doc_id, sha256(doc_id || '|' || text) AS sha256, 'f' || doc_id || '.pdf' AS file_name FROM base),
old_docs AS (SELECT sha256, doc_id, 'fp1' AS fingerprint, file_name, 1 AS write_seq FROM hashed WHERE doc_id % 3 <> 0),
new_docs AS (SELECT sha256, doc_id, 'fp2' AS fingerprint, file_name, 2 AS write_seq FROM hashed WHERE doc_id % 2 = 0),
old_bills AS (SELECT sha256, unnest(range(1, doc_id % 3 + 2)) AS page, doc_id * 10 + write_seq AS gross_cents, write_seq FROM old_docs),
new_bills AS (SELECT sha256, unnest(range(1, doc_id % 2 + 2)) AS page, doc_id * 10 + write_seq AS gross_cents, write_seq FROM new_docs)"""
