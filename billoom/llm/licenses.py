"""License scans by sparse TF-IDF cosine and inheritance from the nearest ancestor directory. DataFrame functions only.

Three parts name a file's licence; the first that finds one decides.

1. Its SPDX-License-Identifier tag, as written.
2. Whole texts, paragraphs (runs of lines, so comment blocks too), lines and sentences against whole licence texts
   (``license_texts``) and standard headers. The widest unit near enough decides.
3. Notices of one line: lines and sentences that speak of licensing, with document frequencies counted over all such
   units (this part alone has SQL); then, with the weights of part 2, every other unit.

Parts 2 and 3b take document frequencies from the templates, 1 + ln(tf) as term weight, and the greatest idf for terms
of no template. Of a template whose terms' squared weights sum to 1, a unit that has none of some terms with more than
1 - least^2 of that sum has a cosine below ``least``; files and units without such a marking term of any template go,
and so do units with too many terms of no template (may_be_near).

A file whose name says that it is a licence gives its directory a licence; a file without one of its own takes that of
the nearest directory above it.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, boxed

# Notices by SPDX id.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License.",
    "LicenseRef-All-Rights-Reserved": "All rights reserved.",
}
SPEAKS = "licen[sc]|copyright|spdx|rights reserved"
# Standard headers of source files by SPDX id.
_GNU = """This {it} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version.

This {it} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.

You should have received a copy of the GNU {name} along with this {it}. If not, see <https://www.gnu.org/licenses/>."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"""
HEADERS = [
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", _APACHE + """ http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    *((k, part) for k, it, name, v in [("GPL-2.0", "program", "General Public License", "2"), ("GPL-3.0", "program", "General Public License", "3"), ("LGPL-2.1", "library", "Lesser General Public License", "2.1"), ("LGPL-3.0", "library", "Lesser General Public License", "3"), ("AGPL-3.0", "program", "Affero General Public License", "3")] for part in (_GNU.format(it=it, name=name, v=v), _GNU.format(it=it, name=name, v=v).split("\n")[0])),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MIT", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file or at https://opensource.org/licenses/MIT."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
]
SPDX = r"(?i)spdx-license-identifier:[ \t]*(\(*[a-z0-9](?:[a-z0-9.+:-]*[a-z0-9+])?\)*(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(*[a-z0-9](?:[a-z0-9.+:-]*[a-z0-9+])?\)*)*)"
TERM = "[a-z0-9]+(?:[.+-][a-z0-9]+)*"
# Marking terms are taken among others first, so that fewer units have one.
COMMON = frozenset("""a about above after all also am an and another any are as at be because been before being below between both but by can cannot could did do does down each else
few for form from further had has have he her here him his how however i if in into is it its itself may me might mit more most must my new no nor not now of off on once one only or other our out
over own part per same shall she should so some such than that the their them then there these they this those through to too two under until up upon us use used very was way we well were what
when where whether which while who whom whose why will with within without work would you your 0 1 2 3 4 5 6 7 8 9 10""".split())
LICENSE_NAME = "(?i)^(licen[sc]e|copying|notice)([.].*)?$"
LEAST_COSINE = 0.7


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def long_templates() -> list[tuple[str, str]]:
    """(SPDX id, text) of the standard headers and of the whole licence texts."""
    folder = Path(__file__).parent / "license_texts"
    return HEADERS + [(p.name.removesuffix(".txt"), p.read_text(encoding="utf-8")) for p in sorted(folder.glob("*.txt"))]


def weights(texts: list[str]) -> tuple[list[dict[str, float]], dict[str, float], float]:
    """Unit vectors of the texts' terms, the terms' idf over the texts, and the idf of any other term."""
    counts = [Counter(re.findall(TERM, t.lower())) for t in texts]
    idf = {w: math.log((1 + len(texts)) / (1 + n)) + 1 for w, n in Counter(w for c in counts for w in c).items()}
    raw = [{w: (1 + math.log(n)) * idf[w] for w, n in c.items()} for c in counts]
    norms = [math.sqrt(sum(x * x for x in v.values())) for v in raw]
    return [{w: x / n for w, x in v.items()} for v, n in zip(raw, norms, strict=True)], idf, math.log(1 + len(texts)) + 1


def marks(vectors: list[dict[str, float]], least: float) -> list[str]:
    """Terms of which a unit has at least one where its rounded cosine to any of the vectors is ``least``."""
    out: set[str] = set()
    for v in vectors:
        held = 0.0
        for w in sorted(v, key=lambda w: (w in COMMON, -v[w], w)):
            if held > 1 - (least - 1e-5) ** 2:
                break
            out.add(w)
            held += v[w] ** 2
    return sorted(out)


def may_be_near(found: Column, idf: dict[str, float], most: float, least: float) -> Column:
    """False only where terms ``found`` are too far from every template, whichever it is.

    Its cosine is at most sqrt(K / (K + U)): K and U are the squared weights of its terms in and out of the templates.
    U >= most^2 for each different term. (1 + ln n)^2 is concave, so k different terms of idf at most m with n places
    add at most m^2 k (1 + ln(n / k))^2 to K.
    """
    groups: dict[int, list[str]] = {}
    for w, x in idf.items():
        groups.setdefault(min(int(2 * x), 6), []).append(w)

    def both(k: Column, n: Column, m: float) -> Column:
        return F.struct(k.cast("double").alias("k"), F.when(k > 0, k * F.pow(1 + F.log(n / k), F.lit(2)) * m**2).otherwise(0.0).alias("most"))

    def of(words: list[str]) -> Column:
        return F.transform(F.array(F.filter(found, lambda w: w.isin(words))), lambda f: both(F.size(F.array_distinct(f)), F.size(f), max(idf[w] for w in words)))[0]

    start = F.struct(F.size(F.array_distinct(found)).cast("double").alias("others"), F.lit(0.0).alias("most"))
    share = (least - 1e-5) ** 2
    return F.aggregate(F.array(*[of(words) for words in groups.values()]), start, lambda a, g: F.struct((a["others"] - g["k"]).alias("others"), (a["most"] + g["most"]).alias("most")), lambda a: a["most"] * (1 - share) >= a["others"] * most**2 * share)


def _literal(spark, rows: list[dict], schema: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def scan(files: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST_COSINE) -> DataFrame:
    """(path, license, score): the licence of each path by the first of the three parts that finds one; score has 6 decimals, ties go to the first id.

    Null and empty texts have no unit; rows that repeat a path count together; other columns are ignored. ``templates`` stands for the notices.
    """
    tag = F.regexp_replace(F.regexp_extract("text", SPDX, 1), "[ \\t]+", " ")
    tags = files.filter(F.col("text").contains("-") & F.lower("text").contains("spdx-license-identifier:")).select("path", tag.alias("license")).filter("license <> ''")
    lines = scan_notices(files, templates, least)
    order = [F.lit(0).alias("part"), F.lit(0).alias("kind")]
    every = tags.select("path", "license", F.lit(1.0).alias("score"), *order)
    every = every.unionByName(lines.select("path", "license", "score", F.lit(2).alias("part"), F.lit(0).alias("kind"))).unionByName(scan_texts(files, templates, least))
    best = every.groupBy("path").agg(F.min(F.struct("part", "kind", (-F.col("score")).alias("s"), "license")).alias("b"))
    return best.select("path", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))


def scan_texts(files: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST_COSINE) -> DataFrame:
    """(path, license, score, part, kind) of every unit near a template: part 1 for licence texts and headers, 3 for notices; kind 0 whole text, 1 paragraph, 2 line or sentence."""
    spark = files.sparkSession
    long = long_templates()
    known = long + list((templates or TEMPLATES).items())
    vectors, idf, most = weights([t for _, t in known])
    kept_marks = marks(vectors, least)
    cut = lambda text, at: F.array_distinct(F.split(text, at))
    sentences = F.regexp_replace("text", "([.;!?])[ \\t\\r\\f]+", "$1\n")
    cuts = [F.array("text"), cut(F.col("text"), "\n[ \\t\\r\\f]*\n\\s*"), F.array_union(cut(F.col("text"), "\n"), cut(sentences, "\n"))]
    termed = lambda c: F.transform(c, lambda u: F.struct(F.xxhash64(u).alias("uid"), terms(u).alias("terms")))
    has_mark = lambda u: F.exists(u["terms"], lambda w: w.isin(kept_marks))
    near = F.transform(F.array(*cuts), lambda c: F.filter(F.filter(termed(c), has_mark), lambda u: may_be_near(u["terms"], idf, most, least)))
    units = files.filter(F.exists(terms(F.col("text")), lambda w: w.isin(kept_marks))).select("path", F.monotonically_increasing_id().alias("row"), F.posexplode(near).alias("kind", "units"))
    units = Scratch(spark, "licenses").keep(units.select("path", "row", "kind", F.inline("units")), "texts")
    key = ["path", "row", "kind", "uid"]
    rows = units.select(*key, F.explode("terms").alias("term")).groupBy(*key, "term").agg(F.count("*").alias("tf"))
    idfs = _literal(spark, [{"term": w, "idf": x} for w, x in idf.items()], "term: string, idf: double")
    fixed = _literal(spark, [{"t": t, "term": w, "tw": x} for t, v in enumerate(vectors) for w, x in v.items()], "t: int, term: string, tw: double")
    names = F.array(*[F.lit(k) for k, _ in known])
    weighed = rows.join(F.broadcast(idfs), "term", "left").select(*key, "term", ((F.log("tf") + 1) * F.coalesce("idf", F.lit(most))).alias("w"))
    norm = weighed.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(F.broadcast(fixed), "term").groupBy(*key, "t").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    near = dots.join(norm, key).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).filter(F.col("score") >= least)
    return near.select("path", names[F.col("t")].alias("license"), "score", F.when(F.col("t") < len(long), 1).otherwise(3).alias("part"), "kind")


def scan_notices(files: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST_COSINE) -> DataFrame:
    """(path, license, score): the best notice of each path among lines and sentences that speak of licensing."""
    spark = files.sparkSession
    marked = F.regexp_replace("text", "([.;!?])[ \\t\\r\\f]+", "$1\n")
    units = files.filter(F.lower("text").rlike(SPEAKS)).select("path", F.explode(F.split(marked, "\n")).alias("unit")).filter(F.lower("unit").rlike(SPEAKS)).distinct()
    units = Scratch(spark, "licenses").keep(units.select("path", F.xxhash64("unit").alias("uid"), terms(F.col("unit")).alias("terms")), "units")
    n = units.count()
    rows = units.select("path", "uid", F.explode("terms").alias("term")).groupBy("path", "uid", "term").agg(F.count("*").alias("tf"))
    df = rows.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(F.lit(1.0 + n) / (1.0 + F.coalesce("df", F.lit(0)))) + 1.0
    known = F.create_map(*[F.lit(x) for kv in (templates or TEMPLATES).items() for x in kv])
    fixed = spark.range(1).select(F.explode(known).alias("license", "text")).select("license", F.explode(terms(F.col("text"))).alias("term")).groupBy("license", "term").agg(F.count("*").alias("ttf"))
    fixed = fixed.join(df, "term", "left").select("license", "term", (F.col("ttf") * idf).alias("tw"))
    norms = fixed.groupBy("license").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("tnorm"))
    fixed = fixed.join(norms, "license")  # as many rows as the templates have terms
    weighed = rows.join(df, "term").select("path", "uid", "term", (F.col("tf") * idf).alias("w"))
    norm = weighed.groupBy("path", "uid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(F.broadcast(fixed), "term").groupBy("path", "uid", "license", "tnorm").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    scored = dots.join(norm, ["path", "uid"]).withColumn("score", F.round(F.col("dot") / (F.col("norm") * F.col("tnorm")), 6)).filter(F.col("score") >= least)
    best = scored.groupBy("path").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    return best.select("path", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))


def inherit(files: DataFrame, found: DataFrame) -> DataFrame:
    """files(path, ...) with license, score and via (own, inherited, none) and from_dir added; columns of these names are replaced, all others stay whatever their names.

    A null path has no licence. The root '' is above every directory. A directory with several licence files takes the first id among theirs.
    """
    files = files.drop("license", "score", "via", "from_dir")
    # Read twice below, so written once.
    found = Scratch(files.sparkSession, "licenses").keep(found.select("path", "license", "score"), "found")
    parent = F.regexp_replace("path", "/?[^/]*$", "")
    name = F.regexp_extract("path", "([^/]*)$", 1)
    given = found.filter(name.rlike(LICENSE_NAME)).groupBy(parent.alias("above")).agg(F.min("license").alias("given"))
    dirs = files.select(parent.alias("_dir")).filter("_dir IS NOT NULL").distinct()
    parts = F.split("_dir", "/")
    above = dirs.select("_dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("above")))).alias("a")).select("_dir", "a.*")
    nearest = above.join(given, "above").groupBy("_dir").agg(F.max_by(F.struct("above", "given"), "depth").alias("near"))
    rows = files.select(boxed(files).alias("file"), "path", parent.alias("_dir"))
    out = rows.join(found, "path", "left").join(nearest, "_dir", "left")
    own = F.col("license").isNotNull()
    via = F.when(own, "own").when(F.col("near").isNotNull(), "inherited").otherwise("none")
    out = out.withColumn("via", via).withColumn("from_dir", F.when(F.col("via") == "inherited", F.col("near.above"))).withColumn("license", F.coalesce("license", F.col("near.given")))
    return out.select("file.*", "license", "score", "via", "from_dir")
