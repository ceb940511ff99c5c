"""Replies of a model as records: finding the JSON, cleaning its fields, settling date and total among several sources.

All of it is Column logic, so replies of any number are one pass over their table. The model itself is a function from the caller (analysed()).
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from billoom.functions import scalars as S

from .staged import Stages

#: Two totals closer than this are the same.
NEAR = 0.005
TEXTS = ("vendor", "vendor_address", "invoice_number", "date", "due_date", "currency", "iban")
AMOUNTS = ("net_total", "tax_total", "gross_total", "confidence")
#: Fields in the order in which a record is written.
FIELDS = ("confidence", "currency", "date", "due_date", "gross_total", "iban", "invoice_number", "net_total", "tax_total", "vendor", "vendor_address")


def json_object(reply: Column) -> Column:
    """What looks like the JSON object of a reply: out of a code fence, from the first brace to the last; else the trimmed text."""
    t = S.trim(S.text_of(reply))
    inner = F.regexp_replace(F.regexp_replace(t, r"(?s)\A[^\n]*\n", ""), r"(?s)\A(.*)```.*\z", "$1")
    body = F.when(t.startswith("```"), inner).otherwise(t)
    found = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    return F.when(found != "", found).otherwise(S.trim(body))


def _kind(variant: Column, field: str) -> Column:
    """The JSON type of a field."""
    return F.schema_of_variant(F.try_variant_get(variant, F.lit(f"$.{field}"), "variant"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_object(json: Column) -> Column:
    """Whether a text that is JSON is an object."""
    return F.ltrim(json, F.lit(" \t\r\n")).startswith("{")


#: What cleaned texts go through, by field.
_FINISH = {"vendor_address": S.single_line, "date": S.first_date_in, "due_date": S.first_date_in, "currency": S.normalise_currency, "iban": lambda t: F.replace(t, F.lit(" "), F.lit(""))}


def record(variant: Column) -> Column:
    """The cleaned fields of a reply's object as a struct.

    Texts count where they are JSON strings, placeholders as ''. Amounts may be numbers, taken as they are, or strings, parsed.
    """

    def raw(field: str) -> Column:
        kind = lambda k: F.coalesce(k, F.lit(""))
        get = lambda t: F.try_variant_get(variant, F.lit(f"$.{field}"), t)
        number = lambda k: kind(k).isin("BIGINT", "DOUBLE") | kind(k).startswith("DECIMAL")
        return let(_kind(variant, field), lambda k: F.struct(F.when(kind(k) == "STRING", get("string")).alias("text"), F.when(number(k), get("double")).alias("number")))

    def cut(r: Column) -> Column:
        amount = lambda x: F.struct(F.when(~S.is_placeholder(x["text"]), S.amount_characters(x["text"])).alias("kept"), x["number"].alias("number"))
        return F.struct(*[S.cleaned(r[k]["text"]).alias(k) for k in TEXTS], *[amount(r[k]).alias(k) for k in AMOUNTS])

    def clean(c: Column) -> Column:
        texts = [_FINISH.get(k, lambda t: t)(c[k]).alias(k) for k in TEXTS]
        return F.struct(*texts, *[F.coalesce(c[k]["number"], S.amount_of(c[k]["kept"])).alias(k) for k in AMOUNTS])

    return let(let(F.struct(*[raw(k).alias(k) for k in (*TEXTS, *AMOUNTS)]), cut), clean)


#: JSON numbers, and those of them that are the same amount whether they are numbers or texts (-0 is not).
_NUMBER, _SIMPLE = r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?", r"(?:0|-?[1-9]\d{0,12})(?:\.\d{1,2})?"


def fields_of(json: Column, *more: str) -> Column:
    """A JSON object's fields as texts, those of a record and ``more``: a string's own text, of anything else the JSON; null where there is none."""
    return F.from_json(json, ", ".join(f"{k} string" for k in (*TEXTS, *AMOUNTS, *more)))


def texts_are_strings(fields: Column, names: tuple[str, ...] = TEXTS) -> Column:
    """Whether none of the texts can be anything but a string in JSON. False doesn't mean that one is: '12' may be either."""
    return ~F.concat_ws("\n", *[fields[k] for k in names]).rlike(rf"(?m)^(?:[\[{{]|(?:true|false|{_NUMBER})$)")


def amounts_are_plain(fields: Column) -> Column:
    """Whether each amount is the same read as a number and as a text, or can only be a text."""
    return ~F.concat_ws("\n", *[fields[k] for k in AMOUNTS]).rlike(rf"(?m)^(?:[\[{{]|(?!{_SIMPLE}$){_NUMBER}$)")


def with_record(rows: DataFrame, name: str, variant: str, fields: str, plain: Column) -> DataFrame:
    """rows with the record of a variant as ``name``, as record() gives it; null where the variant is.

    Where the rows are plain, their fields_of() hold all that record() would ask the variant for, field by field, at many times the
    cost. The others, whose texts leave open of which type a field is, are asked. In steps, so that nothing is computed twice.
    """
    f, some = F.col(fields), F.col(variant).isNotNull()
    simple = lambda x: F.when(x.isNotNull() & ~S.is_placeholder(x), S.amount_characters(x))
    rows = rows.withColumn("_plain", plain).withColumn("_texts", F.when(F.col("_plain"), F.transform(F.array(*[f[k] for k in TEXTS]), S.cleaned)))
    rows = rows.withColumn("_kept", F.when(F.col("_plain"), F.transform(F.array(*[f[k] for k in AMOUNTS]), simple)))
    rows = rows.withColumn("_amounts", F.transform("_kept", lambda x: F.when(x.isNotNull(), S.amount_of(x))))
    texts = [_FINISH.get(k, lambda t: t)(F.get("_texts", F.lit(i))).alias(k) for i, k in enumerate(TEXTS)]
    amounts = [F.get("_amounts", F.lit(i)).alias(k) for i, k in enumerate(AMOUNTS)]
    out = F.when(some, F.when(F.col("_plain"), F.struct(*texts, *amounts)).otherwise(record(F.col(variant))))
    return rows.withColumn(name, out).drop("_plain", "_texts", "_kept", "_amounts")


def from_reply(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """replies with error and the record's fields: null fields and a text where the reply is empty or holds no JSON object."""
    parsed = replies.withColumn("_body", json_object(F.col(reply))).withColumn("_v", F.try_parse_json("_body"))
    # What parses and begins with a brace is an object.
    parsed = parsed.withColumn("_v", F.when(is_object(F.col("_body")), F.col("_v"))).withColumn("_f", fields_of(F.when(F.col("_v").isNotNull(), F.col("_body"))))
    error = F.when(F.col("_body") == "", "the model returned nothing").when(F.col("_v").isNull(), "the reply is not a JSON object").otherwise("")
    out = with_record(parsed, "_r", "_v", "_f", texts_are_strings(F.col("_f")) & amounts_are_plain(F.col("_f"))).withColumn("error", error)
    return out.select(*[c for c in replies.columns if c not in (*TEXTS, *AMOUNTS, "error")], "error", "_r.*")


def to_json() -> Column:
    """The record as compact JSON, keys in order of name; missing numbers are null."""
    return F.to_json(F.struct(*[F.col(k) for k in FIELDS]), {"ignoreNullFields": "false"})


def settled_date(text: Column, asked: Column, reply: Column) -> Column:
    """struct(date, source): the labelled date of the text, else the answer to the question about it, else the reply's."""
    labelled, answer, own = S.find_labelled_date(text), S.normalise_date(S.text_of(asked)), S.text_of(reply)
    date = F.when(labelled != "", labelled).when(answer != "", answer).otherwise(own)
    source = F.when(labelled != "", "text").when(answer != "", "asked").when(own != "", "reply").otherwise("none")
    return F.struct(date.alias("date"), source.alias("source"))


def settled_total(reply: Column, first: Column, second: Column) -> Column:
    """struct(total, asked_twice, corrected) of the reply's total and the answers to one or two questions about it.

    An answer near the reply's total is taken. Otherwise a second answer decides: near the first it makes that the total, else the reply stands.
    """
    near = lambda a, b: F.coalesce(F.abs(a - b) < NEAR, F.lit(False))
    agreed, again = near(first, reply), first.isNotNull() & ~near(first, reply)
    corrected = again & near(second, first)
    return F.struct(F.when(agreed | corrected, first).otherwise(reply).alias("total"), again.alias("asked_twice"), corrected.alias("corrected"))


class ModelError(Exception):
    """kind: unreachable, timeout, not_installed, refused (the service says why) or http."""

    def __init__(self, kind: str, text: str):
        super().__init__(f"{kind}: {text}")
        self.kind = kind


def answer(model: Callable[[list[dict]], str], messages: list[dict]) -> tuple[str | None, str | None]:
    """(reply, failure) of a call; a model that fails is told in the row and ends no task."""
    try:
        return model(messages), None
    except ModelError as e:
        return None, str(e)


def answer_schema() -> dict:
    """The record as a JSON schema, which goes along with a request: the fields' types, vendor and total required."""
    text, amount = {"type": "string"}, {"type": ["number", "null"]}
    return {"type": "object", "properties": {k: amount if k in AMOUNTS else text for k in FIELDS}, "required": ["vendor", "gross_total"]}


def user_message(content: str, image: bytes | None = None) -> dict:
    """A message with the page's image, if it has one, in base64."""
    images = {"images": [base64.b64encode(image).decode()]} if image else {}
    return {"role": "user", "content": content} | images


def extraction_messages(text: str | None, complaint: str | None = None, image: bytes | None = None) -> list[dict]:
    """The messages that ask for a page's record."""
    ask = "Answer with one JSON object with the keys " + ", ".join(FIELDS) + ". Use null for what is not on the page."
    messages = [{"role": "system", "content": ask}, user_message(text or "", image)]
    return messages + ([{"role": "user", "content": f"That answer can't be used: {complaint}. Answer again."}] if complaint else [])


def to_send(batch: pd.DataFrame) -> tuple[pd.Series, list[bytes | None]]:
    """Which rows have a text or an image, and the images."""
    images = [x or None for x in batch["jpeg"]] if "jpeg" in batch else [None] * len(batch)
    text = batch["text"].notna() & (batch["text"].fillna("").str.strip() != "")
    return text | pd.Series([x is not None for x in images], index=batch.index, dtype=bool), images


def analysed(pages: DataFrame, model: Callable[[list[dict]], str], stages: Stages | None = None) -> DataFrame:
    """pages(path, page, text, ..., jpeg if there are images) with status, error, attempts, model_error and the record's fields.

    The model is asked once, and once more where its reply doesn't count. Both rounds are written (as ``first`` and ``second`` of stages, a new
    folder if none are given) and only read from there, so that however often the result is read, a page is asked about no more, and
    a model that varies puts it in one round. Only a task that is run again asks again.

    Pages without text and image are not sent: an error. A reply that doesn't count after the second time keeps its fields and is an
    error. A model that can't be reached is an error of the row (model_error), and is not tried again. Columns of these names are
    replaced; repeated rows are asked about each; an empty table gives an empty result.
    """
    stages = stages or Stages(pages.sparkSession)
    pages = pages.drop("reply", "attempts", "model_error", "error", "status")
    schema = StructType(pages.schema.fields[:]).add("reply", "string").add("attempts", "integer").add("model_error", "string")
    reader = model.answering(answer_schema()) if hasattr(model, "answering") else model

    def ask(batches: Iterator, attempt: int) -> Iterator:
        for b in batches:
            send, images = to_send(b)
            complaints = b["_complaint"] if attempt > 1 else [None] * len(b)
            got = [answer(reader, extraction_messages(t, w, i)) if s else (None, None) for t, w, i, s in zip(b["text"], complaints, images, send, strict=True)]
            b["reply"], b["model_error"] = [x[0] for x in got], [x[1] for x in got]
            b["attempts"] = send.astype("int32") * attempt
            yield b[schema.names]

    first = stages.keep("first", lambda: from_reply(pages.mapInPandas(lambda bs: ask(bs, 1), schema)))
    counts = S.plausible(F.col("vendor"), F.col("gross_total"))
    done = counts | (F.col("attempts") == 0) | F.col("model_error").isNotNull()
    complaint = F.when(F.col("error") == "", "vendor or total is missing").otherwise(F.col("error")).alias("_complaint")
    again = first.filter(~done).select(*[c for c in pages.columns if c not in (*TEXTS, *AMOUNTS)], *[F.lit(None).cast(pages.schema[c].dataType).alias(c) for c in pages.columns if c in (*TEXTS, *AMOUNTS)], complaint)
    second = stages.keep("second", lambda: from_reply(again.mapInPandas(lambda bs: ask(bs, 2), schema)))
    both = first.filter(done).unionByName(second)
    nothing = F.col("attempts") == 0
    error = F.when(nothing, "nothing to send").when(counts, "").when(F.col("model_error").isNotNull(), F.col("model_error")).when(F.col("error") != "", F.col("error")).otherwise("the model returned no usable fields")
    return both.withColumn("error", error).withColumn("status", F.when(counts, "ok").otherwise("error"))
