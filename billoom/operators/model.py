"""A model behind HTTP, the questions it is asked, and what settles a bill's date and total. Asked in the workers, batch by batch."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from billoom.functions import scalars as S

from .replies import NEAR, ModelError, answer, settled_date, settled_total, to_send, user_message

Model = Callable[[list[dict]], str]


@dataclass
class HttpModel:
    """A chat service: POST {url}/api/chat answers {"message": {"content": ...}}, GET {url}/api/tags lists models."""

    url: str
    model: str
    timeout: float = 120.0
    #: What an answer must look like, as a JSON schema; and whether the model may reason, and how long it stays loaded.
    schema: dict | None = None
    think: bool | None = None
    keep_alive: str | None = None

    def answering(self, schema: dict) -> HttpModel:
        """The same model, held to a schema."""
        return replace(self, schema=schema)

    def _call(self, path: str, payload: dict | None, timeout: float) -> dict:
        request = urllib.request.Request(self.url + path, None if payload is None else json.dumps(payload).encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                body = answer.read()
        except urllib.error.HTTPError as e:
            body, code = e.read(), e.code
            why = self._object(body).get("error")
            if why:
                raise ModelError("not_installed" if "not found" in str(why).lower() else "refused", str(why)) from e
            raise ModelError("http", f"status {code}") from e
        except (TimeoutError, urllib.error.URLError) as e:
            late = isinstance(e, TimeoutError) or isinstance(getattr(e, "reason", None), TimeoutError)
            raise ModelError("timeout" if late else "unreachable", f"{self.url}: {getattr(e, 'reason', e)}") from e
        out = self._object(body)
        if out.get("error"):
            raise ModelError("refused", str(out["error"]))
        return out

    @staticmethod
    def _object(body: bytes) -> dict:
        try:
            out = json.loads(body)
        except ValueError:
            return {}
        return out if isinstance(out, dict) else {}

    def __call__(self, messages: list[dict]) -> str:
        more = {k: v for k, v in (("format", self.schema), ("think", self.think), ("keep_alive", self.keep_alive)) if v is not None}
        out = self._call("/api/chat", {"model": self.model, "messages": messages, "stream": False, "options": {"temperature": 0}} | more, self.timeout)
        return (out.get("message") or {}).get("content") or ""

    def installed(self) -> list[str]:
        """Names of the models that the service has; one short call before a job."""
        return [m.get("name", "") for m in self._call("/api/tags", None, 5.0).get("models") or []]


def date_messages(text: str, image: bytes | None = None) -> list[dict]:
    return [user_message(f"On which date was this bill issued? Answer with the date alone, or NONE.\n\n{text}", image)]


def total_messages(text: str, image: bytes | None = None) -> list[dict]:
    return [user_message(f"Which amount does this bill ask for in all? Answer with the number alone, or NONE.\n\n{text}", image)]


def asked(rows: DataFrame, model: Model, messages: Callable[..., list[dict]], when: Column, name: str) -> DataFrame:
    """rows with the model's answer about their text and image as ``name`` where ``when`` is true; null elsewhere, and where the model fails."""
    rows = rows.drop(name).withColumn("_ask", F.coalesce(when, F.lit(False)))
    schema = StructType([f for f in rows.schema.fields if f.name != "_ask"]).add(name, "string")

    def ask(batches: Iterator) -> Iterator:
        for b in batches:
            b[name] = [answer(model, messages(t or "", i))[0] if a else None for t, i, a in zip(b["text"], to_send(b)[1], b["_ask"], strict=True)]
            yield b[[f.name for f in schema]]

    return rows.mapInPandas(ask, schema)


def settled(bills: DataFrame, model: Model) -> DataFrame:
    """bills(text, date, gross_total, ..., jpeg if there are images) with date and gross_total settled, and date_source, total_corrected and total_asked_twice.

    The date is asked for only where the text has no labelled one; the total always, and again where the answer differs from the
    reply's. Bills without text and image are not asked about; a model that fails counts as no answer. Write the result before reading it twice.
    """
    some = S.trim(S.text_of(F.col("text"))) != ""
    if "jpeg" in bills.columns:
        some = some | (F.coalesce(F.octet_length("jpeg"), F.lit(0)) > 0)
    out = asked(bills, model, date_messages, some & (S.find_labelled_date(F.col("text")) == ""), "_date")
    out = asked(out, model, total_messages, some, "_first").withColumn("_a", S.amount_from_answer(F.col("_first")))
    differs = F.col("_a").isNotNull() & (F.col("gross_total").isNull() | (F.abs(F.col("_a") - F.col("gross_total")) >= NEAR))
    out = asked(out, model, total_messages, differs, "_second")
    date, total = settled_date(F.col("text"), F.col("_date"), F.col("date")), settled_total(F.col("gross_total"), F.col("_a"), S.amount_from_answer(F.col("_second")))
    out = out.withColumn("_d", date).withColumn("_t", total)
    kept = [F.col("_d.date").alias(c) if c == "date" else F.col("_t.total").alias(c) if c == "gross_total" else F.col(c) for c in bills.columns if c not in ("date_source", "total_corrected", "total_asked_twice")]
    return out.select(*kept, F.col("_d.source").alias("date_source"), F.col("_t.corrected").alias("total_corrected"), F.col("_t.asked_twice").alias("total_asked_twice"))


def diagnosis(checks: list[tuple[str, bool, Callable[[], str], str]]) -> tuple[list[tuple[str, str, str]], int]:
    """(lines (name, mark, detail), exit status) of checks (name, required, look, fix): look() tells what it found, or raises what is wrong.

    A required check that fails shows its fix and makes the status 1; others are marked '--'.
    """
    lines, status = [], 0
    for name, required, look, fix in checks:
        try:
            lines.append((name, "ok", look()))
        except Exception as e:  # noqa: BLE001 whatever is wrong is what the report is for
            lines.append((name, "FAIL" if required else "--", f"{e}; {fix}" if required and fix else str(e)))
            status |= required
    return lines, int(status)
