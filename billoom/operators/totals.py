"""Sums in exact cents with an account of what they cover; currencies are never mixed. And runs of a list.

Bills are rows (path, page, page_count, status, gross_cents, currency, ...). A status other than 'ok', null too, is a failure. Extra
columns are ignored unless said otherwise; empty tables give no row (or zeros, where one row is promised).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billoom.functions import render
from billoom.functions.scalars import text_of, trim


def is_ok() -> Column:
    return F.coalesce(F.col("status") == "ok", F.lit(False))


def counts() -> Column:
    return is_ok() & F.col("gross_cents").isNotNull()


def code() -> Column:
    return trim(text_of(F.col("currency")))


def complete(counted: Column, failed: Column, expected: Column) -> Column:
    """A sum that covers all that is expected."""
    return (counted > 0) & (failed == 0) & (counted >= expected)


def file_totals(bills: DataFrame, by: tuple[str, ...] = ("path",), order: str = "page") -> DataFrame:
    """(*by, currency, cents, counted, first_page): by file and trimmed, case-insensitive currency; the label first seen shows."""
    counted = bills.filter(counts()).withColumn("_label", code())
    sums = counted.groupBy(*by, F.lower("_label").alias("_key")).agg(F.min_by("_label", order).alias("currency"), F.sum("gross_cents").alias("cents"), F.count("*").alias("counted"), F.min(order).alias("first_page"))
    return sums.drop("_key")


def file_coverage(bills: DataFrame, by: tuple[str, ...] = ("path",)) -> DataFrame:
    """One row for each file: pages present, expected, counted, failed, without an amount, complete."""
    a = bills.groupBy(*by).agg(F.count("*").alias("present"), F.max("page_count").alias("_pages"), F.count_if(counts()).alias("counted"), F.count_if(~is_ok()).alias("failed"))
    a = a.withColumn("expected", F.greatest("_pages", "present").cast("bigint")).withColumn("unamounted", F.greatest(F.lit(0), F.col("present") - F.col("failed") - F.col("counted")).cast("bigint"))
    return a.withColumn("complete", complete(F.col("counted"), F.col("failed"), F.col("expected"))).drop("_pages")


def file_sums(bills: DataFrame, by: tuple[str, ...] = ("path",), order: str = "page", lines: Column | None = None) -> DataFrame:
    """file_coverage with parts array<struct<currency, cents>> in order of first sight, in one pass over the files.

    First by file and currency, then by file: a file's pages meet in one place once. lines: what each bill gives, if asked for, as a sorted array of that name.
    """
    inner, outer = ([], []) if lines is None else ([F.collect_list(lines).alias("lines")], [F.array_sort(F.flatten(F.collect_list("lines"))).alias("lines")])
    part = bills.withColumn("_key", F.when(counts(), F.lower(code()))).groupBy(*by, "_key").agg(
        F.count("*").alias("n"), F.max("page_count").alias("_pages"), F.count_if(~is_ok()).alias("_failed"), F.sum("gross_cents").alias("cents"), F.min_by(code(), order).alias("currency"), F.min(order).alias("at"), *inner,
    )
    seen = F.col("_key").isNotNull()
    a = part.groupBy(*by).agg(
        F.sum("n").alias("present"), F.max("_pages").alias("_pages"), F.coalesce(F.sum(F.when(seen, F.col("n"))), F.lit(0)).alias("counted"), F.sum("_failed").alias("failed"),
        F.array_sort(F.collect_list(F.when(seen, F.struct("at", "currency", "cents")))).alias("parts"), *outer,
    )
    a = a.withColumn("parts", F.transform("parts", lambda p: F.struct(p["currency"].alias("currency"), p["cents"].alias("cents"))))
    a = a.withColumn("expected", F.greatest("_pages", "present").cast("bigint")).withColumn("unamounted", F.greatest(F.lit(0), F.col("present") - F.col("failed") - F.col("counted")).cast("bigint"))
    return a.withColumn("complete", complete(F.col("counted"), F.col("failed"), F.col("expected"))).drop("_pages")


def coverage_text() -> Column:
    return render.coverage(F.col("counted"), F.col("expected"), F.col("failed"), F.col("unamounted"), F.col("complete"))


def sum_lines(bills: DataFrame) -> DataFrame:
    """(path, line): what a file of several bills adds up to, and what that covers."""
    return file_sums(bills).filter("present > 1").select("path", render.sum_line(F.col("path"), F.col("parts"), coverage_text()).alias("line"))


def list_total(bills: DataFrame, order: tuple[str, ...] = ("path", "page")) -> DataFrame:
    """(currency, cents, counted, and of the whole list expected, failed, unamounted, complete): the sum by currency, labelled as first seen.

    Expected are all listed rows, not pages; rows listed twice count twice. A list without a countable bill has one row with null currency.
    """
    sums = file_totals(bills.withColumn("_at", F.struct(*order)), (), "_at").select("currency", "cents", "counted")
    whole = list_coverage(bills).select("expected", F.col("counted").alias("_counted"), "failed", "unamounted")
    out = whole.join(F.broadcast(sums), F.lit(True), "left")  # one row by a row for each currency
    return out.select("currency", "cents", F.coalesce("counted", F.lit(0)).alias("counted"), "expected", "failed", "unamounted", complete(F.col("_counted"), F.col("failed"), F.col("expected")).alias("complete"))


def list_coverage(bills: DataFrame) -> DataFrame:
    """One row for the whole list, what list_total covers: rows expected (all listed), counted, failed, without an amount."""
    a = bills.agg(F.count("*").alias("expected"), F.count_if(counts()).alias("counted"), F.count_if(~is_ok()).alias("failed"))
    return a.withColumn("unamounted", F.greatest(F.lit(0), F.col("expected") - F.col("failed") - F.col("counted")).cast("bigint"))


def outcome(bills: DataFrame) -> DataFrame:
    """One row: bills processed and failed, and the exit status of a run (0 if every bill is ok)."""
    return bills.agg(F.count("*").alias("processed"), F.count_if(~is_ok()).alias("failed")).withColumn("exit_status", F.when(F.col("failed") == 0, 0).otherwise(1))


def archivable(bills: DataFrame) -> DataFrame:
    """(path, archive): a file may leave the inbox when it has bills and all of them are ok."""
    return bills.groupBy("path").agg((F.bool_and(is_ok()) & (F.count("*") > 0)).alias("archive"))


def range_of(value: Column, cuts: list) -> Column:
    """How many of the sorted cuts lie below a value: among every k-th of them first, then among the k that follow."""
    if not cuts:
        return F.lit(0)
    k = math.isqrt(len(cuts)) + 1
    every, all_ = F.array(*map(F.lit, cuts[::k])), F.array(*map(F.lit, cuts))
    below = lambda a: F.size(F.filter(a, lambda c: c < value))
    first = below(every)
    return F.when(first == 0, 0).otherwise((first - 1) * k + below(F.slice(all_, F.greatest((first - 1) * k + 1, F.lit(1)), F.lit(k))))


def numbered(rows: DataFrame, by: str, name: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """rows numbered from 1 in order of the number ``by``, then ``ties``: by ranges of it, each numbered in a task, after the counts of the ranges before.

    Rows of one number stand in one range. A null comes first.
    """
    n = rows.sparkSession.sparkContext.defaultParallelism
    # Cuts are fixed once, so that every reading of rows finds the same ranges.
    cuts = rows.select(F.percentile_approx(by, [k / n for k in range(1, n)], 10_000).alias("c")).first()["c"] if n > 1 else None
    parts = rows.withColumn("_part", F.when(F.col(by).isNull(), 0).otherwise(range_of(F.col(by), sorted(set(cuts or [])))))
    counts = parts.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = counts.select("_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_before"))  # a row for each range
    within = F.row_number().over(Window.partitionBy("_part").orderBy(by, *ties))
    return parts.withColumn("_k", within).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_k")).drop("_part", "_k", "_before")


def runs(rows: DataFrame, key: str, pos: str, partition: str | None = None, parts: int | None = None) -> DataFrame:
    """Adds run_id (from 1): consecutive rows of one key in order of pos, whose values differ from row to row.

    With ``partition`` each of its values is a list of its own. Without it the rows are one list, cut into ranges of pos: a range is numbered on
    its own, then moved on by the runs of the ranges before it; a run that goes on over a border is one run. No range is brought to
    one task with another.
    """
    key_of = F.struct(F.col(key).alias("k"))
    if partition:
        w = Window.partitionBy(partition).orderBy(pos)
        new = F.when(key_of.eqNullSafe(F.lag(key_of).over(w)), 0).otherwise(1)
        return rows.withColumn("_new", new).withColumn("run_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.select(F.percentile_approx(pos, [k / n for k in range(1, n)], 10_000).alias("c")).first()["c"] if n > 1 else None
    ranged = rows.withColumn("_part", range_of(F.col(pos), sorted(set(cuts or []))))
    w = Window.partitionBy("_part").orderBy(pos)
    new = F.when(F.row_number().over(w) == 1, 0).when(key_of.eqNullSafe(F.lag(key_of).over(w)), 0).otherwise(1)
    local = ranged.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # One row for each range: its first and last key and its runs after the first.
    edges = local.groupBy("_part").agg(F.min_by(key_of, pos).alias("first"), F.max_by(key_of, pos).alias("last"), F.max("_run").alias("more"))
    w = Window.orderBy("_part")
    opens = F.when(F.col("first").eqNullSafe(F.lag("last").over(w)), 0).otherwise(1)
    edges = edges.withColumn("_opens", opens).withColumn("_base", F.sum(F.col("_opens") + F.coalesce(F.lag("more").over(w), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return local.join(F.broadcast(edges.select("_part", "_base")), "_part").withColumn("run_id", F.col("_run") + F.col("_base")).select(*rows.columns, "run_id")


def run_count(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """(documents): how many runs a list has; a file that comes twice counts twice."""
    return runs(rows, key, pos).agg(F.coalesce(F.max("run_id"), F.lit(0)).alias("documents"))


def run_subtotals(bills: DataFrame, key: str, pos: str, parts: int | None = None) -> DataFrame:
    """bills with run_id, and parts and covered (text) on the last row of each run of several bills, null elsewhere."""
    listed = runs(bills, key, pos, parts=parts)
    sums = file_sums(listed, ("run_id",), pos).filter("present > 1").withColumn("covered", coverage_text())
    ends = listed.groupBy("run_id").agg(F.max(pos).alias(pos))
    return listed.join(sums.join(ends, "run_id").select("run_id", pos, "parts", "covered"), ["run_id", pos], "left").select(*bills.columns, "run_id", "parts", "covered")
