"""The list of bills that a reader sees: merging replies into it, capping it, finding a bill again, comparing with expectations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from billoom.functions import render
from billoom.functions import scalars as S


def key_of():
    return S.file_key(F.col("path"), F.col("file"))


def replace_merge(shown: DataFrame, fresh: DataFrame, limit: int = 0) -> DataFrame:
    """fresh's rows before those of shown, without shown's rows of the file that fresh is about; the first ``limit`` of them (0: all).

    Both have pos (place in the list); the result's pos is the rank in (fresh, shown) order as (part, pos) pairs tell it. A batch whose key is
    empty replaces nothing; an empty batch changes nothing.
    """
    keys = fresh.select(key_of().alias("_key")).filter("_key <> ''").distinct()
    kept = shown.withColumn("_key", key_of()).join(keys, "_key", "left_anti").drop("_key")
    merged = fresh.withColumn("part", F.lit(0)).unionByName(kept.withColumn("part", F.lit(1)))
    return merged.orderBy("part", "pos").limit(limit) if limit > 0 else merged


def concatenated(*lists: DataFrame) -> DataFrame:
    """The lists one after the other, told apart by part."""
    out = None
    for k, rows in enumerate(lists):
        rows = rows.withColumn("part", F.lit(k))
        out = rows if out is None else out.unionByName(rows)
    return out


def reopened(opened: DataFrame, shown: DataFrame) -> DataFrame:
    """opened with found (the pos in shown of the same page of the same file, the first of several, or null where it is gone)."""
    at = shown.groupBy(key_of().alias("_key"), F.col("bill").alias("_bill")).agg(F.min("pos").alias("found"))
    rows = opened.withColumn("_k", key_of())
    return rows.join(at, (F.col("_k") == F.col("_key")) & F.col("bill").eqNullSafe(F.col("_bill")), "left").select(*opened.columns, "found")


def first_of_each(rows: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """Each key once, where it came first: a queue that takes no path twice."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(pos))).filter("_r = 1").drop("_r")


def handled_anti(seen: DataFrame, handled: DataFrame) -> DataFrame:
    """seen without what has been handled with the same path, size and time of change."""
    return seen.join(handled.select("path", "size", "mtime_ms").distinct(), ["path", "size", "mtime_ms"], "left_anti").select(*seen.columns)


def patterns(expected: DataFrame) -> DataFrame:
    """(vendor, valid): each distinct /pattern/ among the expectations, compiled once; those that are none don't raise."""
    distinct = expected.select("vendor").filter(S.vendor_pattern(F.col("vendor")) != "").distinct()
    return distinct.withColumn("valid", S.compiles(S.vendor_pattern(F.col("vendor"))))


def pattern_findings(expected: DataFrame) -> DataFrame:
    """(document, bill, finding) of the expectations whose pattern is none: faults of the list itself, apart from what the bills say."""
    bad = patterns(expected).filter(~F.col("valid")).select("vendor")
    return expected.join(bad, "vendor").select("document", "bill", F.concat(F.lit("invalid pattern "), "vendor").alias("finding"))


def compared(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """expected(document, bill, vendor, date, currency, gross_total as text) with a verdict for each field against actual's.

    A null expectation must be empty, '*' is not checked, totals differ by less than half a cent; a page that is not there fails all.
    A vendor's /pattern/ that is none fails its own row's vendor alone (pattern_findings() names it).
    """
    expected = expected.drop("_valid").join(patterns(expected).withColumnRenamed("valid", "_valid"), "vendor", "left")
    a = actual.select("document", "bill", *[F.col(c).alias(f"_{c}") for c in ("vendor", "date", "currency", "gross_total")], F.lit(True).alias("_there"))
    j = expected.join(a, ["document", "bill"], "left")
    there = F.coalesce(F.col("_there"), F.lit(False))
    same = lambda c, equal: there & F.coalesce(F.when(F.col(c) == "*", True).when(F.col(c).isNull(), S.text_of(F.col(f"_{c}").cast("string")) == "").otherwise(equal), F.lit(False))
    near = F.abs(F.col("gross_total").try_cast("double") - F.col("_gross_total")) < 0.005
    j = j.withColumn("vendor_ok", same("vendor", S.vendor_matches(F.col("vendor"), S.text_of(F.col("_vendor")), F.coalesce("_valid", F.lit(False))))).withColumn("date_ok", same("date", F.col("date") == F.col("_date")))
    j = j.withColumn("currency_ok", same("currency", F.col("currency") == F.col("_currency"))).withColumn("total_ok", same("gross_total", near))
    return j.select("document", "bill", there.alias("found"), "vendor_ok", "date_ok", "currency_ok", "total_ok")


def notifications(bills: DataFrame, by: tuple[str, ...] = ("path",)) -> DataFrame:
    """(path, body): a line for each bill of a file in order of page, and its sum with a caveat where it is not complete.

    by: what tells a file, the path among it. A file's lines and sums come out of the same grouping.
    """
    from .totals import coverage_text, file_sums

    name = render.base_name(F.col("path"))
    text = F.when(F.coalesce(F.col("status") == "ok", F.lit(False)), render.summary(F.col("vendor"), F.col("date"), S.from_cents(F.col("gross_cents")), F.col("currency"))).otherwise(S.text_of(F.col("error")))
    files = file_sums(bills.filter("path IS NOT NULL"), by, lines=F.struct("page", text.alias("text"))).withColumn("_name", name)
    several, name = F.col("present") > 1, F.col("_name")
    # Where there are several, a bill without a page's number has no line.
    line = lambda x: F.concat(name, F.when(several, F.concat(F.lit(" p"), x["page"].cast("string"))).otherwise(""), F.lit(": "), x["text"])
    total = F.concat(name, F.lit(": sum "), render.joined_money(F.col("parts")), F.when(F.col("complete"), "").otherwise(F.concat(F.lit(" ("), coverage_text(), F.lit(")"))))
    return files.select("path", F.concat_ws("\n", F.array_join(F.transform("lines", line), "\n"), F.when(several, total)).alias("body"))
