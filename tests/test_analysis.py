"""How often a model is asked, what its failures become, and a bill's whole way through files, cache, model and store."""

from __future__ import annotations

import json
import sys
import uuid
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import functions as F

from billoom.operators import analysis, replies, staged, store
from billoom.operators import model as M
from billoom.sources import files


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't import tests


class Counting:
    """A model that leaves a file for each call, named by the page's text; answers by page, or another at every call."""

    def __init__(self, folder: Path, varies: bool = False):
        self.folder, self.varies = str(folder), varies
        folder.mkdir(exist_ok=True)

    def __call__(self, messages):
        text = next(m["content"] for m in messages if m["role"] == "user").strip()
        name = text.split()[-1] if text else "image"
        calls = len(list(Path(self.folder).glob(f"{name}-*")))
        (Path(self.folder) / f"{name}-{uuid.uuid4().hex}").write_text(json.dumps(messages))
        if name == "down":
            raise M.ModelError("unreachable", "no route")
        if "?" in text:
            return "NONE"
        if self.varies:
            return json.dumps({"vendor": "V", "gross_total": calls} if (calls + len(name)) % 2 else {"vendor": "only"})
        again = len(messages) > 2
        return json.dumps({"vendor": "V", "gross_total": 2} if name == "good" or (name == "late" and again) or name == "image" else {"vendor": "only"})

    def calls(self):
        out: dict[str, int] = {}
        for p in Path(self.folder).iterdir():
            out[p.name.split("-")[0]] = out.get(p.name.split("-")[0], 0) + 1
        return out


def test_each_page_is_asked_once(spark, tmp_path):
    rows = [("a", 1, "good"), ("a", 2, "late"), ("b", 1, "never"), ("c", 1, " "), ("c", 2, None), ("d", 1, "down")]
    model = Counting(tmp_path / "calls")
    got = replies.analysed(spark.createDataFrame(rows, "path string, page int, text string").withColumn("error", F.lit("clash")).withColumn("reply", F.lit(1)), model)
    for _ in range(3):  # however often the result is read
        told = {(r["path"], r["page"]): (r["status"], r["attempts"], r["error"]) for r in got.collect()}
    assert model.calls() == {"good": 1, "late": 2, "never": 2, "down": 1}
    assert told == {("a", 1): ("ok", 1, ""), ("a", 2): ("ok", 2, ""), ("b", 1): ("error", 2, "the model returned no usable fields"), ("c", 1): ("error", 0, "nothing to send"), ("c", 2): ("error", 0, "nothing to send"), ("d", 1): ("error", 1, "unreachable: no route")}


def test_a_model_that_varies_neither_loses_nor_doubles_a_page(spark, tmp_path):
    rows = [(f"p{k}", 1, f"t{'x' * (k % 5)}{k}") for k in range(40)]
    model = Counting(tmp_path / "calls", varies=True)
    got = replies.analysed(spark.createDataFrame(rows, "path string, page int, text string").repartition(4), model)
    first, second = ([tuple(r) for r in got.select("path", "page", "status", "attempts", "gross_total").orderBy("path").collect()] for _ in range(2))
    assert first == second and sorted(r[0] for r in first) == sorted(r[0] for r in rows)
    assert {r[0][1:]: r[3] for r in first} == {k.lstrip("tx"): n for k, n in model.calls().items()}


def test_empty_table(spark, tmp_path):
    assert replies.analysed(spark.createDataFrame([], "path string, page int, text string"), Counting(tmp_path / "calls")).count() == 0


def test_images_and_schema_go_along():
    sent = replies.extraction_messages("text", None, b"\x00\xff")
    assert sent[1] == {"role": "user", "content": "text", "images": ["AP8="]} and "images" not in replies.extraction_messages("text")[1]
    model = M.HttpModel("http://x", "m").answering(replies.answer_schema())
    assert model.schema["required"] == ["vendor", "gross_total"] and set(model.schema["properties"]) == set(replies.FIELDS) and M.HttpModel("http://x", "m").schema is None


def test_stages_are_made_once(spark, tmp_path):
    stages, made = staged.Stages(spark, f"file://{tmp_path}/s"), []
    make = lambda: (made.append(1), spark.range(3))[1]
    assert stages.keep("a", make).count() == 3 == staged.Stages(spark, stages.folder).keep("a", make).count() and len(made) == 1
    (tmp_path / "s" / "a" / "_SUCCESS").unlink()  # cut off
    assert stages.keep("a", make).count() == 3 and len(made) == 2


def reader(data: bytes):
    """Pages by '|'; '!' is a page that failed, '#' an image without text; of 'bad' nothing can be read."""
    if data == b"bad":
        raise ValueError("damaged")
    made = {"!": ValueError("page is broken"), "#": files.Page(None, b"jpg", 300, 900)}
    return [made.get(t, t) for t in data.decode().split("|")]


def test_whole_way(spark, tmp_path):
    box = tmp_path / "in"
    box.mkdir()
    for name, data in (("a.pdf", b"good|late|!"), ("copy.pdf", b"good|late|!"), ("b.png", b"#"), ("bad.pdf", b"bad"), ("x.txt", b"good"), ("n.pdf", b"never")):
        (box / name).write_bytes(data)
    s, model = store.Store(spark, f"file://{tmp_path}/db", buckets=4), Counting(tmp_path / "calls")
    paths = spark.createDataFrame([(str(box / n),) for n in ("a.pdf", "copy.pdf", "b.png", "bad.pdf", "x.txt", "n.pdf", "none.pdf", "a.pdf")], "path string")
    run = lambda k: {(Path(r["path"]).name, r["page"]): r for r in analysis.analyse(paths, reader, model, s, "fp", "m", f"file://{tmp_path}/run{k}").collect()}
    got = run(1)
    assert {k: (r["status"], r["page_count"], r["vendor"], r["gross_total"], r["from_cache"]) for k, r in got.items()} == {
        ("a.pdf", 1): ("ok", 3, "V", 2.0, False), ("a.pdf", 2): ("ok", 3, "V", 2.0, False), ("a.pdf", 3): ("error", 3, None, None, False),
        ("copy.pdf", 1): ("ok", 3, "V", 2.0, False), ("copy.pdf", 2): ("ok", 3, "V", 2.0, False), ("copy.pdf", 3): ("error", 3, None, None, False),
        ("b.png", 1): ("ok", 1, "V", 2.0, False), ("n.pdf", 1): ("error", 1, "only", None, False),
        ("bad.pdf", 1): ("error", 1, None, None, False), ("x.txt", 1): ("error", 1, None, None, False), ("none.pdf", 1): ("error", 1, None, None, False),
    }
    assert got[("a.pdf", 3)]["error"] == "page is broken" and got[("bad.pdf", 1)]["error"] == "damaged" and got[("none.pdf", 1)]["error"] == "file does not exist" and got[("b.png", 1)]["quality_warning"].startswith("only 300 px")
    assert s.documents().count() == 3 and s.bills().count() == 5
    calls = model.calls()
    assert calls["never"] == 2
    # The same run again reads its stages; another finds all in the store: only files that were not stored are looked at again. Nothing is asked.
    assert run(1).keys() == got.keys() and run(2).keys() == got.keys() and model.calls() == calls
    again = run(3)
    assert {k for k, r in again.items() if r["from_cache"]} == {k for k in got if k[0] in ("a.pdf", "copy.pdf", "b.png", "n.pdf")}
    assert all((again[k]["status"], again[k]["vendor"], again[k]["gross_total"], again[k]["quality_warning"]) == (r["status"], r["vendor"] or again[k]["vendor"], r["gross_total"], r["quality_warning"]) for k, r in got.items())
    # Other settings ask anew and replace; without a store nothing is kept.
    analysis.analyse(paths.filter(F.col("path").endswith("n.pdf")), reader, model, s, "other", "m", f"file://{tmp_path}/run4").collect()
    assert model.calls()["never"] == 4 and s.find(s.documents().filter("fingerprint = 'other'").first()["sha256"], "fp").count() == 0
    assert analysis.analyse(paths.limit(0), reader, model, s, "fp", "m", f"file://{tmp_path}/run5").count() == 0
    assert analysis.analyse(paths.filter(F.col("path").endswith("b.png")), reader, model, None, "fp", "m", f"file://{tmp_path}/run6").count() == 1
