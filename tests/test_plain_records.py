"""Bills and replies read as they stand equal those whose fields are asked for their types, whatever the types; short parts are dealt to tasks."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from billoom.operators import replies
from billoom.plans import queries
from billoom.sources import ndjson

VALUES = ['"A"', '"12"', "12", "-0", '"-0"', "1.190", '"1.190"', "1190.00", '"1190,00 EUR"', "1e3", '"1e3"', "true", '"true"', "null", "[1]", '"[1]"', '{"a": 1}', '""', '" n/a "', '"20250717"', '"17.07.25"', '"a\\n12"', "12345678901234567890", '"ü  "', '"EUR"']


def _texts():
    for name in ("vendor", "date", "currency", "iban", "vendor_address", "gross_total", "confidence", "path", "bill", "bill_count", "status", "error", "from_cache", "extract_ms"):
        for v in VALUES:
            yield '{"vendor": "V", "file": "f.pdf", "gross_total": 2.50, "x": 1}' if name == "file" else "{" + ", ".join(f"{json.dumps(k)}: {w}" for k, w in ({"vendor": '"V"', "file": '"f.pdf"', "gross_total": "2.50"} | {name: v}).items()) + "}"
    yield from ["[1]", "nothing", "", '{"vendor": "a", "vendor": "b"}', "{'vendor': 1}", '{"vendor": NaN}', '{"vendor": "a"} x', ' {"vendor": "a"} ']


def test_fields_as_they_stand(spark):
    rows = spark.createDataFrame([(t,) for t in _texts()], "value string").withColumn("v", F.try_parse_json("value"))
    asked = replies.let(F.when(F.schema_of_variant("v").startswith("OBJECT"), F.col("v")), lambda v: F.when(v.isNotNull(), replies.record(v)))
    got = ndjson.with_bill(rows.withColumn("want", asked).withColumn("is", F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)))).withColumn("head", F.struct("bill.path", "bill.page", "bill.page_count", "bill.status", "bill.error", "bill.from_cache", "bill.extract_ms"))
    head = ndjson._head(lambda k, t: F.try_variant_get("v", F.lit(f"$.{k}"), t))
    for r in got.withColumn("asked", head).filter("is").collect():
        assert repr(r["bill"]["invoice"]) == repr(r["want"]), r["value"]
        assert all(r["head"][k] == r["asked"][k] for k in ("path", "page", "page_count", "status", "error", "from_cache", "extract_ms")), r["value"]
    told = replies.from_reply(got.select(F.col("value").alias("reply"), "want", "is")).filter("is").collect()
    assert len(told) > 300
    for r in told:
        assert repr([r[k] for k in (*replies.TEXTS, *replies.AMOUNTS)]) == repr(list(r["want"])), r["reply"]


def test_replies_are_dealt_to_tasks(spark):
    assert "Exchange hashpartitioning(p_partkey" in queries.QUERIES["json_reply"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
