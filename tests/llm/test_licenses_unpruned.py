"""The licence scan's pruning (marks, bounds) against the cosine of every unit to every template."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from billoom.llm import licenses

KNOWN = licenses.long_templates() + list(licenses.TEMPLATES.items())


def units(text):
    """(kind, unit): the whole text, its paragraphs, its lines and sentences; equal ones of a kind once."""
    sentences = re.sub(r"([.;!?])[ \t\r\f]+", r"\1\n", text)
    return {(0, text), *((1, p) for p in re.split(r"\n[ \t\r\f]*\n\s*", text)), *((2, u) for u in text.split("\n")), *((2, u) for u in sentences.split("\n"))}


def unpruned(texts, least):
    vectors, idf, most = licenses.weights([t for _, t in KNOWN])
    out = set()
    for path, text in texts.items():
        for kind, unit in units(text):
            w = {t: (math.log(n) + 1) * idf.get(t, most) for t, n in Counter(re.findall(licenses.TERM, unit.lower())).items()}
            norm = math.sqrt(sum(x * x for x in w.values()))
            for t, v in enumerate(vectors):
                score = round(sum(x * v[k] for k, x in w.items() if k in v) / norm, 6) if norm else 0.0
                if score >= least:
                    out.add((path, KNOWN[t][0], score, 1 if t < len(KNOWN) - len(licenses.TEMPLATES) else 3, kind))
    return out


def mixed(seed, n):
    """Pieces of templates with words dropped, doubled, exchanged and put in, so that many cosines lie near the threshold."""
    draw, out = random.Random(seed), {}
    other = "the of and to this work file source program data model bread water seven licence copyright held by a person under no terms".split()
    for k in range(n):
        text = draw.choice(KNOWN)[1] if k % 3 else draw.choice(licenses.HEADERS)[1]
        words = re.findall(r"\S+|\n+", text)
        at = draw.randrange(len(words))
        piece = words[at : at + draw.choice([6, 20, 80, 400])] if draw.random() < 0.6 else words[:1500]
        rate = draw.choice([0, 0.1, 0.3, 0.5])
        noisy = [x for w in piece for x in ([w] if draw.random() > rate else draw.choice([[], [w, w], [draw.choice(other)], [w, draw.choice(other), draw.choice(other)]]))]
        out[f"f{k}"] = " ".join(noisy).replace(" \n ", "\n")
    return out


@pytest.mark.parametrize("least", [0.7, 0.5])
def test_pruning_loses_nothing(spark, least):
    texts = mixed(11, 150)
    files = spark.createDataFrame(list(texts.items()), "path string, text string").repartition(6)
    got = {(r["path"], r["license"], r["score"], r["part"], r["kind"]) for r in licenses.scan_texts(files, least=least).collect()}
    want = unpruned(texts, least)
    far = lambda a, b: {x for x in a - b if not any((x[0], x[1], round(x[2] + d, 6), x[3], x[4]) in b for d in (-1e-6, 1e-6)) and abs(x[2] - least) > 2e-6}  # noqa: E731  sums in another order
    assert far(want, got) == set() == far(got, want) and len(want) > 150
