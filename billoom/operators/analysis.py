"""A bill's whole way: files, cache, pages, model, settling, notes, store; each step is written before the next reads it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billoom.functions import scalars as S
from billoom.sources import files

from . import replies
from .model import settled
from .staged import Stages
from .store import BILLS, DOCUMENTS, Store, from_stored

#: Columns of a bill that every result has, with those of its record.
RESULT = ("path", "page", "page_count", "status", "error", "from_cache", "notes", "quality_warning", *replies.FIELDS)


def _typed(rows: DataFrame, schema: str) -> DataFrame:
    """rows with the columns of a schema, null where they have none."""
    names = [c.split() for c in schema.split(", ")]
    return rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(kind).alias(n) for n, kind in names])


def _failures(rows: DataFrame, error: str, count: str = "1") -> DataFrame:
    """A file that could not be read as its one bill."""
    none = [F.lit(None).cast("double" if c in replies.AMOUNTS else "string").alias(c) for c in replies.FIELDS]
    return rows.select("path", F.lit(1).alias("page"), F.expr(count).cast("int").alias("page_count"), F.lit("error").alias("status"), F.col(error).alias("error"), F.lit(False).alias("from_cache"), F.array().cast("array<string>").alias("notes"), F.lit("").alias("quality_warning"), *none)


def analyse(paths: DataFrame, reader: Callable, model: Callable, store: Store | None, fingerprint: str, model_name: str, folder: str, limit: int = 0) -> DataFrame:
    """RESULT for each page of the files paths(path): from the store where it has the file's hash under ``fingerprint``, else read, asked about and stored.

    Steps: inspect and hash the files; probe the store; read the pages of misses (reader: see files.read_pages; the first ``limit``, 0: all); ask
    the model about each page, once more where the answer doesn't count; settle date and total; save documents with their bills. Each is a
    table in ``folder`` and is not made again there, so a job that was cut off goes on where it stopped; a later run takes a new folder.

    A file that can't be read is one bill with an error and is not stored; a page that failed is stored with its error. Without a store nothing is
    probed or saved. Paths are taken once each however often they come; files of equal bytes are read, asked about and stored once and
    answered under each path. An empty table gives an empty result.
    """
    stages = Stages(paths.sparkSession, folder)
    seen = stages.keep("files", lambda: files.inspected(paths.select("path").distinct()))
    good = seen.filter((F.col("error") == "") & (F.col("sha256") != "")).withColumn("fingerprint", F.lit(fingerprint))
    probed = stages.keep("probed", lambda: store.probe(good) if store else good.withColumn("hit", F.lit(False)))
    misses = probed.filter(~F.col("hit"))
    # One path for each content.
    one = stages.keep("misses", lambda: misses.groupBy("sha256").agg(F.min("path").alias("path")))
    pages = stages.keep("pages", lambda: files.read_pages(one, reader, limit).withColumnRenamed("error", "page_error"))
    asked = replies.analysed(pages.filter(~F.col("failed")), model, stages)

    def decided() -> DataFrame:
        ok = F.col("status") == "ok"
        done = settled(asked.filter(ok), model).unionByName(asked.filter(~ok), allowMissingColumns=True)
        error = F.when((F.col("attempts") == 0) & (F.col("page_error") != ""), F.col("page_error")).otherwise(F.col("error"))
        told = F.array(
            F.when(F.col("page_error") != "", F.col("page_error")), F.when(F.col("date_source") == "asked", "issue date from a question of its own"),
            F.when(F.col("total_corrected"), "total from a question of its own, the reply had another"),
        )
        warning = S.legibility(F.col("from_text"), F.coalesce(F.octet_length("jpeg"), F.lit(0)) > 0, F.col("width"), F.col("height"))
        out = done.withColumns({"error": error, "notes": F.concat("notes", F.array_compact(told)), "quality_warning": F.coalesce(warning, F.lit("")), "created_at": F.lit(datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"))})
        return out.join(one, "path").select("sha256", "path", "page", "page_count", "status", "error", "from_text", "notes", "quality_warning", "created_at", *replies.FIELDS)

    bills = stages.keep("bills", decided)
    if store:

        def saved() -> DataFrame:
            documents = bills.groupBy("sha256", "path").agg(F.max("page_count").alias("page_count"), F.bool_or("from_text").alias("has_text_layer"), F.max("created_at").alias("created_at"))
            documents = documents.withColumns({"fingerprint": F.lit(fingerprint), "source_path": F.col("path"), "file_name": S.base_name(F.col("path")), "model": F.lit(model_name)})
            rows = bills.withColumn("payload", replies.to_json()).withColumnRenamed("date", "bill_date")
            store.save(_typed(documents, DOCUMENTS), _typed(rows, BILLS))
            return paths.sparkSession.range(1)

        stages.keep("saved", saved)
    fresh = misses.select("path", "sha256").join(bills.drop("path"), "sha256").withColumn("from_cache", F.lit(False)).select(*RESULT)
    broken = pages.filter("failed").select("path", "page_error").join(one, "path").drop("path")
    broken = _failures(misses.select("path", "sha256").join(broken, "sha256"), "page_error")
    missing = _failures(seen.filter((F.col("error") != "") | (F.col("sha256") == "")), "error")
    out = fresh.unionByName(broken).unionByName(missing)
    if store:

        def answered() -> DataFrame:
            hits, pages_of = probed.filter("hit").select("path", "sha256"), store.documents().select("sha256", "page_count")
            stored = hits.join(store.bills().select("sha256", "page", "status", "payload", "quality_warning", "created_at"), "sha256").join(pages_of, "sha256")
            warned = stored.select("path", "page", F.coalesce("quality_warning", F.lit("")).alias("quality_warning"))
            return from_stored(stored).join(warned, ["path", "page"]).select(*RESULT)

        out = out.unionByName(stages.keep("answered", answered))
    return out
