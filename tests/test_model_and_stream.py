"""The model client against a small service, settling with a model, the self-check, the folder stream, wiping, images."""

from __future__ import annotations

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from billoom.functions import render
from billoom.operators import model as M
from billoom.operators import replies, store
from billoom.sources import files, snapshots
from billoom.streaming import inbox


class Service(BaseHTTPRequestHandler):
    def _answer(self, code: int, body: object) -> None:
        self.send_response(code)
        self.end_headers()
        self.wfile.write(body if isinstance(body, bytes) else json.dumps(body).encode())

    def do_GET(self):
        self._answer(200, {"models": [{"name": "m:latest"}, {"name": "n"}]})

    def do_POST(self):
        sent = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        {"m": lambda: self._answer(200, {"message": {"content": sent["messages"][-1]["content"][-3:]}}), "gone": lambda: self._answer(404, {"error": "model 'gone' not found"}), "sick": lambda: self._answer(500, {"error": "out of memory"}),
         "plain": lambda: self._answer(503, b"busy"), "slow": lambda: (time.sleep(2), self._answer(200, {})), "odd": lambda: self._answer(200, b"[1]")}[sent["model"]]()

    def log_message(self, *a):
        pass


@pytest.fixture(scope="module")
def url():
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_client(url):
    assert M.HttpModel(url, "m")([{"role": "user", "content": "say abc"}]) == "abc" and M.HttpModel(url, "m").installed() == ["m:latest", "n"] and M.HttpModel(url, "odd")([]) == ""
    for name, kind in (("gone", "not_installed"), ("sick", "refused"), ("plain", "http"), ("slow", "timeout")):
        with pytest.raises(M.ModelError) as e:
            M.HttpModel(url, name, timeout=0.5)([])
        assert e.value.kind == kind
    with pytest.raises(M.ModelError) as e:
        M.HttpModel("http://127.0.0.1:9", "m", timeout=2)([])
    assert e.value.kind == "unreachable"


def test_what_goes_along(url, monkeypatch):
    """Schema, image and settings are in the request; a plain model sends none of them."""
    sent = []
    monkeypatch.setattr(M.HttpModel, "_call", lambda self, path, payload, timeout: sent.append(payload) or {"message": {"content": "x"}})
    M.HttpModel(url, "m", think=False, keep_alive="5m").answering(replies.answer_schema())(replies.extraction_messages("t", None, b"jpg"))
    M.HttpModel(url, "m")(M.date_messages("t"))
    assert sent[0]["format"] == replies.answer_schema() and sent[0]["think"] is False and sent[0]["keep_alive"] == "5m" and sent[0]["messages"][1]["images"] == ["anBn"]
    assert not {"format", "think", "keep_alive"} & set(sent[1]) and "images" not in sent[1]["messages"][0] and sent[1]["options"] == {"temperature": 0}


def test_settled_by_images(spark):
    """A page without text is asked about by its image; a model that fails counts as no answer."""
    rows = [(1, None, bytearray(b"i"), "2024-01-01", 5.0), (2, "down", None, "2024-01-01", 5.0), (3, " ", bytearray(), "2024-01-01", 5.0)]

    def model(messages):
        if "down" in messages[0]["content"]:
            raise M.ModelError("timeout", "late")
        assert messages[0]["images"] == ["aQ=="]
        return "3.4.2025" if "date" in messages[0]["content"] else "7"

    got = M.settled(spark.createDataFrame(rows, "k int, text string, jpeg binary, date string, gross_total double"), model).orderBy("k").collect()
    assert [(r["date"], r["gross_total"], r["date_source"], r["total_corrected"]) for r in got] == [("2025-04-03", 7.0, "asked", True), ("2024-01-01", 5.0, "reply", False), ("2024-01-01", 5.0, "reply", False)]


def test_self_check(url):
    lines, status = M.diagnosis([("endpoint", True, lambda: f"{len(M.HttpModel(url, 'm').installed())} models", ""), ("ocr", False, lambda: 1 / 0, "x"), ("store", True, lambda: {}["no"], "make it")])
    assert [x[:2] for x in lines] == [("endpoint", "ok"), ("ocr", "--"), ("store", "FAIL")] and status == 1 and "make it" in lines[2][2]
    assert M.diagnosis([("ocr", False, lambda: 1 / 0, "")])[1] == 0 == M.diagnosis([])[1]


def test_settled(spark):
    rows = [(1, "Datum: 01.02.2025 A", "2024-01-01", 5.0), (2, "plain B", "2024-01-01", 5.0), (3, "plain C", "2024-01-01", 5.0), (4, "plain D", "", None), (5, None, "2024-01-01", 5.0), (6, "plain E", "2024-01-01", 5.0)]

    def model(messages):
        text = messages[0]["content"]
        if "date" in text.split("?")[0]:
            return {"B": "3.4.2025", "C": "NONE", "D": "20250607"}.get(text[-1], "NONE")
        return {"A": "5,00", "B": "7.50", "C": "NONE", "D": "12", "E": "1 or 2"}[text[-1]]

    got = M.settled(spark.createDataFrame([(*r, "clash") for r in rows], "k int, text string, date string, gross_total double, date_source string"), model)
    assert [tuple(r)[0:1] + tuple(r)[2:] for r in got.orderBy("k").collect()] == [
        (1, "2025-02-01", 5.0, "text", False, False), (2, "2025-04-03", 7.5, "asked", True, True), (3, "2024-01-01", 5.0, "reply", False, False),
        (4, "2025-06-07", 12.0, "asked", True, True), (5, "2024-01-01", 5.0, "reply", False, False), (6, "2024-01-01", 5.0, "reply", False, False),
    ]


def test_folder_stream(spark, tmp_path):
    box = tmp_path / "box"
    box.mkdir()
    (box / "a.pdf").write_bytes(b"123")
    (box / ".hidden.pdf").write_bytes(b"1")
    (box / "note.txt").write_bytes(b"1")
    (box / "link.pdf").symlink_to(box / "a.pdf")
    assert [p.rpartition("/")[2] for p, _, _ in snapshots.listing(str(box))] == ["a.pdf"]
    spark.dataSource.register(snapshots.FolderScans)
    scans, got = spark.readStream.format("folder_scans").load(str(box)), []
    query = inbox.settle_stream(scans).writeStream.foreachBatch(lambda df, n: got.extend(r["path"].rpartition("/")[2] for r in df.collect())).option("checkpointLocation", f"file://{tmp_path}/c").trigger(processingTime="0 seconds").start()
    try:
        until = time.time() + 120
        while time.time() < until and "b.png" not in got:
            if "a.pdf" in got and not (box / "b.png").exists():
                (box / "b.png").write_bytes(b"12")
            time.sleep(0.2)
    finally:
        query.stop()
    assert got == ["a.pdf", "b.png"]


def test_wipe(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/db")
    s.create()
    for name in ("archive/a", "archive/sub/b", "inbox/c"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"1")
    with pytest.raises(ValueError, match="confirmed"):
        s.wipe(f"file://{tmp_path}/archive", f"file://{tmp_path}/inbox")
    assert s.wipe(f"file://{tmp_path}/archive", f"file://{tmp_path}/inbox", confirmed=True) == {"bills": 0, "documents": 0, "archived": 2, "waiting": 1, "failed": 0}
    assert list((tmp_path / "archive").iterdir()) == [] == list((tmp_path / "inbox").iterdir())


def test_cache_bypassed(spark):
    asked = spark.createDataFrame([("h", "f"), ("x", "f")], "sha256 string, fingerprint string")
    docs, bills = asked.filter("sha256 = 'h'"), asked.filter("sha256 = 'h'")
    assert sorted(tuple(r)[0::2] + (r["save"],) for r in store.cache_plan(asked, docs, bills).collect()) == [("h", True, False), ("x", False, True)]
    assert {(r["hit"], r["save"]) for r in store.cache_plan(asked, docs, bills, use_cache=False).collect()} == {(False, False)}


def test_images(spark, tmp_path):
    df = spark.createDataFrame([("/i/a.b.pdf", 1, bytearray(b"x")), ("/i/a.b.pdf", 2, None), ("/i/a.b.pdf", 3, bytearray())], "path string, page int, jpeg binary")
    assert [r["file"] for r in files.write_images(df, f"file://{tmp_path}/out").collect()] == ["a.b-p1.jpg"] and (tmp_path / "out" / "a.b-p1.jpg").read_bytes() == b"x"
    a = np.arange(6).reshape(2, 3)
    assert [files.upright(a, k).tolist() for k in (1, 2, 3, 4, 6, 8)] == [a.tolist(), [[2, 1, 0], [5, 4, 3]], [[5, 4, 3], [2, 1, 0]], [[3, 4, 5], [0, 1, 2]], [[3, 0], [4, 1], [5, 2]], [[2, 5], [1, 4], [0, 3]]]
    assert files.upright(a, 5).tolist() == a.T.tolist() and files.upright(a, 7).tolist() == [[5, 2], [4, 1], [3, 0]]
    assert [tuple(r[0]) for r in spark.range(4, 7).select(files.upright_size(F.lit(3), F.lit(2), F.col("id"))).collect()] == [(3, 2), (2, 3), (2, 3)]
    assert [r[0] for r in spark.createDataFrame([(100.0, 900.0), (5000.0, 5000.0), (0.0, 1.0), (600.0, 800.0)], "w double, h double").select(render.zoom_notes(F.col("w"), F.col("h"))).collect()] == [["resolution raised to 720 dpi for a 35 mm narrow page"], ["resolution limited to 64 dpi by the pixel budget"], [], []]
