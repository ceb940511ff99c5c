"""Language identification by language-bitmask n-gram filters.

Training counts character n-grams per language over all labelled texts. An n-gram belongs to a language if
its share of the language's n-grams is at least ``min_rate`` and at least ``min_ratio`` of its largest share
in any language (so that foreign passages inside a text do not leak). One bit-sliced Bloom filter holds all
languages: each cell is a mask with a bit per language, and the AND of an n-gram's cells is the set of
languages that contain it. A text goes to the language with the largest number of its n-grams, corrected for
the filter's false positives in that language.

``min_rate`` bounds a language's n-grams by 1 / min_rate, so the filter that is broadcast has a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import few_rows

UNKNOWN = "und"
ORDER = 3
MIN_RATE = 1e-5
MIN_RATIO = 0.1
PROBES = 3
#: Characters taken through numpy at a time.
BLOCK = 1 << 18
#: N-grams of a language that a task holds before it tells their counts.
HELD_GRAMS = 1 << 19
SPACE = 32
_LETTERS = None


def _letters() -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTERS


def normal(text: str) -> np.ndarray:
    """Lower-cased letters as code points, every run of other characters one space; no letters: empty."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_letters()[codes], codes, SPACE)
    codes = np.concatenate([[SPACE], codes, [SPACE]])
    codes = codes[np.r_[True, (codes[1:] != SPACE) | (codes[:-1] != SPACE)]]
    return codes.astype(np.uint64) if len(codes) > 1 else codes[:0].astype(np.uint64)


def grams(codes: np.ndarray, order: int = ORDER) -> np.ndarray:
    """A 64-bit value of each n-gram of normal text (exact up to order 3, mixed beyond)."""
    n = len(codes) - order + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = codes[:n].copy()
    for k in range(1, order):
        out = out * np.uint64(1 << 21) + codes[k : k + n] if order <= 3 else (out ^ codes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _cells(g: np.ndarray, bits: int, probes: int) -> Iterator[np.ndarray]:
    h = _mix(g)
    step = (h >> np.uint64(32)) | np.uint64(1)
    for k in range(probes):
        yield ((h + np.uint64(k) * step) & np.uint64((1 << bits) - 1)).astype(np.int64)


@dataclass
class Filters:
    """The model: languages in order of their bit, the masks (a 64-bit word for each 64 languages), fill per language."""

    languages: list[str]
    commonest: str
    order: int
    probes: int
    bits: int
    masks: np.ndarray
    false_rate: np.ndarray

    @classmethod
    def build(cls, languages: list[str], commonest: str, found: dict[str, np.ndarray], order: int, probes: int = PROBES):
        """found: the n-grams of each language. 16 cells for each n-gram of the largest language."""
        most = max((len(x) for x in found.values()), default=0)
        bits = max(10, int(np.ceil(np.log2(16 * max(most, 1)))))
        masks = np.zeros(((len(languages) + 63) // 64 or 1, 1 << bits), np.uint64)
        fill = np.zeros(len(languages))
        for k, lang in enumerate(languages):
            bit = np.uint64(1) << np.uint64(k % 64)
            for cells in _cells(found.get(lang, np.empty(0, np.uint64)), bits, probes):
                masks[k // 64][cells] |= bit
            fill[k] = np.count_nonzero(masks[k // 64] & bit) / (1 << bits)
        return cls(languages, commonest, order, probes, bits, masks, fill**probes)

    def counts(self, g: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(texts, languages) n-grams that the filters return, of texts whose n-grams begin at starts."""
        out, cells = np.zeros((len(starts), len(self.languages)), np.int64), list(_cells(g, self.bits, self.probes))
        ends = np.r_[starts[1:], len(g)]
        for w, words in enumerate(self.masks):
            hit = words[cells[0]]
            for c in cells[1:]:
                hit &= words[c]
            for k in range(64 * w, min(64 * w + 64, len(self.languages))):
                upto = np.r_[0, np.cumsum((hit >> np.uint64(k % 64)) & np.uint64(1), dtype=np.int64)]
                out[:, k] = upto[ends] - upto[starts]
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """(language, score, coverage) of each text.

        coverage: the corrected share of the text's n-grams in the language's filter; score: that language's
        part of the corrected shares of all languages. Null or without a letter: und, 0. A text none of
        whose n-grams is known gets the commonest language, score 0. Ties go to the first language by name.
        """
        out: list[tuple[str, float, float]] = []
        for at in self._blocks(texts):
            codes = [normal(t or "") for t in at]
            each = [grams(c, self.order) for c in codes]
            sizes = np.array([len(g) for g in each], np.int64)
            hits = self.counts(np.concatenate(each), np.cumsum(sizes) - sizes)
            share = hits / np.maximum(sizes, 1)[:, None]
            share = np.clip((share - self.false_rate) / np.maximum(1 - self.false_rate, 1e-9), 0, 1)
            for c, s in zip(codes, share, strict=True):
                if not len(c) or not self.languages:
                    out.append((UNKNOWN, 0.0, 0.0))
                elif not s.sum():
                    out.append((self.commonest, 0.0, 0.0))
                else:
                    k = int(s.argmax())
                    out.append((self.languages[k], float(s[k] / s.sum()), float(s[k])))
        return out

    @staticmethod
    def _blocks(texts: list[str | None]) -> Iterator[list[str | None]]:
        block, size = [], 0
        for t in texts:
            block.append(t)
            size += len(t or "")
            if size >= BLOCK:
                yield block
                block, size = [], 0
        if block:
            yield block


def gram_counts(labelled: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n) over all rows of labelled(text, lang): counted in each task, then summed."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts):
            g = np.concatenate([p[0] for p in parts])
            at, back = np.unique(g, return_inverse=True)
            return at, np.bincount(back, np.concatenate([p[1] for p in parts])).astype(np.int64)

        def block(lang: str, codes: list[np.ndarray]) -> None:
            parts = held.setdefault(lang, [])
            g, n = np.unique(np.concatenate([grams(c, order) for c in codes]), return_counts=True)
            parts.append((g, n))
            if len(parts) >= 16:
                held[lang] = [merged(parts)]

        def told(lang: str) -> pa.RecordBatch:
            g, n = merged(held.pop(lang))
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

        for b in few_rows(batches):
            by: dict[str, list[np.ndarray]] = {}
            size: dict[str, int] = {}
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                by.setdefault(lang, []).append(c := normal(text))
                size[lang] = size.get(lang, 0) + len(c)
                if size[lang] >= BLOCK:
                    block(lang, by.pop(lang))
                    size[lang] = 0
            for lang, codes in by.items():
                block(lang, codes)
            for lang in [k for k, v in held.items() if sum(len(p[0]) for p in v) > HELD_GRAMS]:
                yield told(lang)
        for lang in list(held):
            yield told(lang)

    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    return rows.mapInArrow(scan, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, order: int = ORDER, min_rate: float = MIN_RATE, min_ratio: float = MIN_RATIO) -> Filters:
    """Filters of labelled(text, lang). Rows whose text or lang is null teach nothing; no rows: no languages."""
    from .common import Scratch

    scratch = Scratch(labelled.sparkSession, "langid")
    counts = scratch.keep(gram_counts(labelled, order), "counts")
    sums = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(sums)
    rate = F.col("n") / F.sum("n").over(Window.partitionBy("lang"))
    if languages:  # the sums are a row for each language: literals instead of a window over a language's rows
        rate = F.col("n") / F.element_at(F.create_map(*[x for k, v in sums.items() for x in (F.lit(k), F.lit(float(v)))]), F.col("lang"))
    rated = counts.withColumn("rate", rate).filter(F.col("rate") >= min_rate)
    best = rated.groupBy("gram").agg(F.max("rate").alias("best"))
    rows = rated.join(best, "gram").filter(F.col("rate") >= min_ratio * F.col("best")).select("lang", "gram").toPandas()
    found = {k: np.sort(g["gram"].to_numpy(np.int64).view(np.uint64)) for k, g in rows.groupby("lang")}
    scratch.drop(counts)
    return Filters.build(languages, max(languages, key=lambda k: (sums[k], k), default=UNKNOWN), found, order)


def predict(docs: DataFrame, model: Filters) -> DataFrame:
    """Every row of docs with lang_pred string, score double and coverage double added (clashing columns are replaced)."""
    spark, rest = docs.sparkSession, [c for c in docs.columns if c not in ("lang_pred", "score", "coverage")]
    shared = spark.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_rows(batches):
            got = shared.value.predict(b.column("text").to_pylist())
            lang, score, cover = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(cover, pa.float64())], [*b.schema.names, "lang_pred", "score", "coverage"])

    docs = docs.select(*rest)
    schema = StructType(docs.schema.fields[:]).add("lang_pred", "string").add("score", "double").add("coverage", "double")
    return docs.mapInArrow(scan, schema)
