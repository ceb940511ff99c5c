"""Bills as lines of JSON: reading with an account of broken lines, writing, and a line back to a bill."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billoom.functions.scalars import base_name, text_of, trim
from billoom.operators.replies import FIELDS, TEXTS, amounts_are_plain, fields_of, is_object, let, texts_are_strings, with_record


def parsed(lines: DataFrame, column: str = "value") -> DataFrame:
    """lines without blank ones, with is_bill: whether a line holds a JSON object. Others are broken and stay, to be counted."""
    rows = lines.filter(trim(text_of(F.col(column))) != "")
    return rows.withColumn("is_bill", F.coalesce(F.schema_of_variant(F.try_parse_json(column)).startswith("OBJECT"), F.lit(False)))


def broken(lines: DataFrame, column: str = "value") -> DataFrame:
    """(bills, broken): one row."""
    return parsed(lines, column).agg(F.count_if("is_bill").alias("bills"), F.count_if(~F.col("is_bill")).alias("broken"))


_TEXTS, _NUMBERS, _FLAGS = ("path", "file", "status", "error", "quality_warning"), ("bill", "bill_count", "extract_ms", "inference_ms"), ("has_text_layer", "from_cache")


def with_bill(lines: DataFrame, column: str = "value", name: str = "bill") -> DataFrame:
    """lines with a line's bill as a struct: the path falls back to the file's name, page and count to 1, the fields are cleaned.

    A line that is none gives an empty bill: null in every field of its invoice, else what is said above for fields that are not there. A
    line whose fields are of the types in which emitted() writes them is read as they stand, others are asked for their types.
    """
    f, v = F.col("_f"), F.col("_v")
    rows = lines.withColumn("_v", F.try_parse_json(column)).withColumn("_f", fields_of(F.when(F.col("_v").isNotNull() & is_object(F.col(column)), F.col(column)), *_TEXTS, *_NUMBERS, *_FLAGS))
    whole = F.concat_ws("\n", *[f[k] for k in _NUMBERS]).rlike(r"\A(?:(?:0|[1-9]\d{0,8})(?:\n|\z))*\z")
    flags = F.concat_ws("\n", *[f[k] for k in _FLAGS]).rlike(r"\A(?:(?:true|false)(?:\n|\z))*\z")
    plain = f.isNotNull() & texts_are_strings(f, (*TEXTS, *_TEXTS)) & amounts_are_plain(f) & whole & flags
    rows = with_record(rows.withColumn("_as_read", plain), "_invoice", "_v", "_f", F.col("_as_read"))
    own = F.when(F.col("_as_read"), _head(lambda k, t: f[k].try_cast(t))).otherwise(let(v, lambda x: _head(lambda k, t: F.try_variant_get(x, F.lit(f"$.{k}"), t))))
    rows = rows.withColumn("_head", own)
    return rows.withColumn(name, F.struct("_head.*", F.col("_invoice").alias("invoice"))).drop("_v", "_f", "_as_read", "_head", "_invoice")


def _head(get: Callable[[str, str], Column]) -> Column:
    """A bill without its invoice."""
    flag = lambda k: F.coalesce(get(k, "boolean"), F.lit(False))
    return F.struct(
        F.coalesce(F.nullif(text_of(get("path", "string")), F.lit("")), text_of(get("file", "string"))).alias("path"),
        F.coalesce(get("bill", "int"), F.lit(1)).alias("page"), F.coalesce(get("bill_count", "int"), F.lit(1)).alias("page_count"),
        F.when(get("status", "string") == "ok", "ok").otherwise("error").alias("status"), text_of(get("error", "string")).alias("error"), text_of(get("quality_warning", "string")).alias("quality_warning"),
        flag("has_text_layer").alias("has_text_layer"), flag("from_cache").alias("from_cache"),
        F.coalesce(get("extract_ms", "bigint"), F.lit(0)).alias("extract_ms"), F.coalesce(get("inference_ms", "bigint"), F.lit(0)).alias("inference_ms"),
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every line of the files with is_bill, and bill where it is one."""
    return with_bill(parsed(spark.read.text(path))).withColumn("bill", F.when(F.col("is_bill"), F.col("bill")))


def emitted(bills: DataFrame) -> DataFrame:
    """(value): a compact JSON object for each row; error and quality_warning only where there is one, missing numbers as null.

    bills: path, page, page_count, status, error, quality_warning, has_text_layer, from_cache, extract_ms, inference_ms, notes and the record's fields.
    """
    some = lambda c: F.nullif(text_of(F.col(c)), F.lit(""))
    part = lambda drop, *cols: F.to_json(F.struct(*cols), {"ignoreNullFields": drop})
    head = part("true", base_name(F.col("path")).alias("file"), F.col("path"), F.col("page").alias("bill"), F.col("page_count").alias("bill_count"), F.col("status"), some("error").alias("error"), some("quality_warning").alias("quality_warning"))
    rest = part("false", "has_text_layer", "from_cache", "extract_ms", "inference_ms", "notes", *FIELDS)
    rows = bills.select(head.alias("h"), rest.alias("r"))
    return rows.select(F.concat(F.expr("substring(h, 1, length(h) - 1)"), F.lit(","), F.expr("substring(r, 2)")).alias("value"))


def write(bills: DataFrame, path: str) -> None:
    """A line for each bill, never a summary."""
    emitted(bills).write.text(path)
