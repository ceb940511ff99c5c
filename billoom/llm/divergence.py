"""Divergence of a language's sources: how far apart their term distributions are, and which terms stand out.

Each (lang, source) group and each language gives every kept term a share in whole billionths, with add-one smoothing. A
source is held against each other source of its language by the sum of f over all kept terms, and against the language by f
of single terms. All arithmetic is on whole numbers.

Nearly all (group, term) cells are empty, and an empty cell's share p0 is the same for all terms of a group. The terms of a
language are therefore split:

* heavy terms stand in at least a quarter of the groups: dense tiles of groups by terms, summed by numpy;
* light terms: all pairs of groups start from (light terms) x f of two empty cells. A light term that stands in a group alters
  that as if it stood nowhere else, which depends on its count alone, so cells of equal counts are taken together
  (one-sided sums). Where it stands in both groups, a correction for that pair of its postings is added.

The partial sums of both kinds are added up by pair.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, default_partitions, few_rows

#: Letters and all that is not ASCII make terms; every other ASCII byte ends one. A-Z are lower-cased.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
#: A kept term stands in so many documents of its language at least.
LEAST_DOCUMENTS = 3
#: Terms listed for a group.
TERMS_LISTED = 200
#: A term that stands in one of so many groups of its language, or more, is heavy.
HEAVY_ONE_IN = 4
#: Entries that a task counts up before it hands them on.
ENTRIES = 1_200_000
#: A dense tile: heavy terms on average, and groups on each side. One-sided sums and light cells a task.
TILE_TERMS, TILE_GROUPS, ONE_SIDED, LIGHT_CELLS = 1024, 256, 1 << 16, 1 << 14
#: Pairs of postings looked at together.
PAIRS = 1 << 20
#: Up to so many groups go to all tasks; more are merge-joined.
BROADCAST_GROUPS = 10_000


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d) as each task has counted them: occurrences n by source, and with a null source the documents d."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms: dict[tuple[str, str], Counter] = defaultdict(Counter)
        found: dict[str, Counter] = defaultdict(Counter)

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), c in terms.items():
                yield rows(lang, source, c, True)
            for lang, c in found.items():
                yield rows(lang, None, c, False)
            terms.clear()
            found.clear()

        def rows(lang, source, c, occurrences):
            words, many = pa.array(list(c), pa.binary()).cast(pa.string()), np.fromiter(c.values(), np.int64, len(c))
            none = np.zeros(len(many), np.int64)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(many), pa.string()), pa.array([source] * len(many), pa.string()), words, pa.array(many if occurrences else none), pa.array(none if occurrences else many)], ["lang", "source", "term", "n", "d"])

        for b in few_rows(batches):
            texts = b.column("text").cast(pa.binary())
            for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), texts, strict=True):
                words = text.as_py().translate(TERM_BYTES).split()
                terms[lang, source].update(words)
                found[lang].update(set(words))
            if sum(map(len, terms.values())) + sum(map(len, found.values())) > ENTRIES:
                yield from flush()
        yield from flush()

    return docs.mapInArrow(scan, "lang string, source string, term string, n long, d long")


def share(count: str, of: str) -> str:
    """SQL of 1 + floor(10^9 * count / of), count <= of, in steps of three digits so that no step leaves 64 bits (of < 9 * 10^15)."""
    first, left = f"(({count}) * 1000 div ({of}))", f"(({count}) * 1000 % ({of}))"
    return f"1 + {first} * 1000000 + ({left} * 1000 div ({of})) * 1000 + (({left} * 1000 % ({of})) * 1000 div ({of}))"


def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _sums(lang: str, g: np.ndarray, h: np.ndarray, value: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"lang": lang, "g": g.astype(np.int64), "h": h.astype(np.int64), "value": value.astype(np.int64)})


def dense_tile(rows: pd.DataFrame, block: int = TILE_GROUPS) -> pd.DataFrame:
    """Sums over a tile's heavy terms for the pairs of its two blocks of groups. Rows without a term have the groups' empty shares."""
    lang, a, b = rows["lang"].iat[0], int(rows["ga"].iat[0]), int(rows["gb"].iat[0])
    empty = rows[rows["term"].isna()].sort_values("g")
    groups, cells = empty["g"].to_numpy(), rows[rows["term"].notna()]
    column, names = pd.factorize(cells["term"])
    tile = np.repeat(empty["p"].to_numpy()[:, None], len(names), axis=1)
    tile[np.searchsorted(groups, cells["g"].to_numpy()), column] = cells["p"].to_numpy()
    out = []
    for k, g in enumerate(groups):
        other = (groups != g) if a == b else (groups // block == (b if g // block == a else a))
        out.append(_sums(lang, np.full(other.sum(), g), groups[other], f(tile[k], tile[other]).sum(axis=1)))
    return pd.concat(out)


def one_sided(rows: pd.DataFrame, block: int = TILE_GROUPS) -> pd.DataFrame:
    """For the pairs of two blocks: light cells of equal shares (p, times) against the other groups' empty shares.

    Rows without times have the groups' empty shares; in base rows times is the number of light terms, for pairs of two empty cells.
    """
    lang, a, b = rows["lang"].iat[0], int(rows["ga"].iat[0]), int(rows["gb"].iat[0])
    empty = rows[rows["kind"] == 0].sort_values("g")
    groups, p0, light = empty["g"].to_numpy(), empty["p"].to_numpy(), empty["times"].to_numpy()
    sums = np.zeros((len(groups), len(groups)), np.int64)
    if rows["part"].iat[0] == 0:
        sums += f(p0[:, None], p0[None, :]) * light[:, None]
    for g, own in rows[rows["kind"] == 1].groupby("g"):
        k, p, times = int(np.searchsorted(groups, g)), own["p"].to_numpy()[:, None], own["times"].to_numpy()[:, None]
        sums[k] += ((f(p, p0[None, :]) - f(p0[k], p0)[None, :]) * times).sum(axis=0)
        sums[:, k] += ((f(p0[None, :], p) - f(p0, p0[k])[None, :]) * times).sum(axis=0)
    side = groups // block
    across = (groups[:, None] != groups[None, :]) if a == b else (side[:, None] != side[None, :])
    g, h = np.nonzero(across)
    return _sums(lang, groups[g], groups[h], sums[g, h])


def posting_pairs(rows: pd.DataFrame) -> pd.DataFrame:
    """For light terms in several groups: what each pair of a term's postings changes against the one-sided sums, added up by pair of groups."""
    lang = rows["lang"].iat[0]
    rows = rows.sort_values(["term", "g"], kind="stable")
    g, p, p0 = (rows[c].to_numpy() for c in ("g", "p", "p0"))
    code, (groups, at) = pd.factorize(rows["term"])[0], np.unique(g, return_inverse=True)
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    size = np.diff(np.r_[first, len(code)])
    keys, values = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

    def collapse():
        key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, inverse, np.concatenate(values))
        keys[:], values[:] = [key], [total]

    for k in np.unique(size[size > 1]).tolist():
        starts, step = first[size == k], max(1, PAIRS // k)
        for away in range(1, k):  # each posting with the one so many places on in its list, around its end
            for lo in range(0, len(starts), step):
                x = (starts[lo : lo + step, None] + np.arange(k)).ravel()
                y = (starts[lo : lo + step, None] + (np.arange(k) + away) % k).ravel()
                keys.append(at[x] * len(groups) + at[y])
                values.append(f(p[x], p[y]) - f(p[x], p0[y]) - f(p0[x], p[y]) + f(p0[x], p0[y]))
                if sum(map(len, keys)) > PAIRS:
                    collapse()
    collapse()
    return _sums(lang, groups[keys[0] // len(groups)], groups[keys[0] % len(groups)], values[0])


def _paired(rows: DataFrame, block: int) -> DataFrame:
    """Each row for every pair of blocks (ga <= gb) that its group is in; the number of blocks follows from the language's groups."""
    own = F.floor(F.col("g") / block)
    other = F.explode(F.sequence(F.lit(0), F.floor((F.col("s") - 1) / block).cast("int"))).alias("_other")
    return rows.select("*", other).withColumns({"ga": F.least(own, "_other").cast("int"), "gb": F.greatest(own, "_other").cast("int")}).drop("_other")


def audit(docs: DataFrame, terms_listed: int = TERMS_LISTED, block: int = TILE_GROUPS) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs(lang, source, text, ...); other columns are ignored.

    Null lang, source and text count as ''. Every row is a document, so repeated rows count each. A source alone in its language has no
    pairs; a language without kept terms has 0 in all pairs and no terms; ties go by the item's UTF-8; an empty table gives an empty result.
    A language with s sources gives s * (s - 1) pairs, so what is kept by group (numbering, ranks) is small beside the result.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "divergence")
    n = default_partitions(spark)
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    by_term = Window.partitionBy("lang", "term")
    cells = counted(docs).repartition(n, "lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    cells = cells.withColumns({"docs": F.sum("d").over(by_term), "all": F.sum("n").over(by_term), "k": F.count("source").over(by_term), "first": F.row_number().over(by_term.orderBy(F.col("source").asc_nulls_last())) == 1})
    cells = scratch.keep(cells.filter((F.col("docs") >= LEAST_DOCUMENTS) & F.col("source").isNotNull()).select("lang", "source", "term", "n", "all", "k", "first"), "cells")

    named = scratch.keep(docs.select("lang", "source").distinct(), "named")
    named = named.withColumns({"g": F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1, "s": F.count("*").over(Window.partitionBy("lang"))})
    own = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = scratch.keep(named.select("lang", "s").distinct(), "sizes")
    heavy = F.col("k") * HEAVY_ONE_IN >= F.col("s")
    few = named.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    side = (lambda t: F.broadcast(t)) if few else (lambda t: t.hint("merge"))
    langs = cells.join(side(sizes), "lang").groupBy("lang").agg(
        F.count_if("first").alias("v"), F.sum("n").alias("all_terms"), F.count_if(F.col("first") & heavy).alias("heavy"), F.count_if(F.col("first") & ~heavy).alias("light"), F.count_if(~heavy).alias("light_cells")
    )
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("total", "v", "all_terms", "heavy", "light", "light_cells")}
    groups = named.join(own, ["lang", "source"], "left").join(langs, "lang", "left").withColumns(zero)
    groups = scratch.keep(groups.withColumn("p0", F.expr(share("1", "greatest(total + v, 1)"))), "groups")

    known = groups.select("lang", "source", "g", "s", "total", "v", "all_terms", "heavy", "light_cells", "p0")
    full = cells.join(side(known), ["lang", "source"]).withColumn("p", F.expr(share("n + 1", "total + v")))
    full = scratch.keep(full.select("lang", "source", "term", "g", "s", "k", "p", "p0", F.expr(share("all + 1", "all_terms + v")).alias("q"), "heavy", "light_cells"), "shares")

    sums = "lang string, g long, h long, value long"
    base = groups.select("lang", "g", "s", "p0", "light", "heavy", "light_cells")
    # Heavy terms: dense tiles.
    tiles = F.greatest(F.lit(1), F.ceil(F.col("heavy") / TILE_TERMS)).cast("int")
    dense = full.filter(heavy).select("lang", F.pmod(F.xxhash64("term"), tiles).cast("int").alias("tile"), "term", "g", "s", "p")
    blank = base.filter("heavy > 0").select("lang", F.explode(F.sequence(F.lit(0), tiles - 1)).alias("tile"), F.lit(None).cast("string").alias("term"), "g", "s", F.col("p0").alias("p"))
    dense = _paired(dense.unionByName(blank), block).drop("s").groupBy("lang", "tile", "ga", "gb").applyInPandas(lambda rows: dense_tile(rows, block), sums)
    # Light terms: one-sided sums of equal cells over the pairs of empty cells.
    cut = F.greatest(F.lit(1), F.ceil(F.col("light_cells") / ONE_SIDED)).cast("int")
    equal = full.filter(~heavy).groupBy("lang", "g", "s", "p", "light_cells").agg(F.count("*").alias("times"))
    equal = equal.select("lang", F.pmod(F.xxhash64("g", "p"), cut).cast("int").alias("part"), F.lit(1).alias("kind"), "g", "s", "p", "times")
    blank = base.select("lang", F.explode(F.sequence(F.lit(0), cut - 1)).alias("part"), F.lit(0).alias("kind"), "g", "s", F.col("p0").alias("p"), F.col("light").alias("times"))
    single = _paired(equal.unionByName(blank), block).drop("s").groupBy("lang", "part", "ga", "gb").applyInPandas(lambda rows: one_sided(rows, block), sums)
    # Light terms in several groups: corrections for pairs of postings.
    cut = F.greatest(F.lit(1), F.ceil(F.col("light_cells") / LIGHT_CELLS)).cast("int")
    double = full.filter(~heavy & (F.col("k") > 1)).select("lang", F.pmod(F.xxhash64("term"), cut).cast("int").alias("part"), "term", "g", "p", "p0")
    double = double.groupBy("lang", "part").applyInPandas(posting_pairs, sums)

    pairs = scratch.keep(dense.unionByName(single).unionByName(double).groupBy("lang", "g", "h").agg(F.sum("value").alias("value")), "pairs")
    names = groups.select("lang", "source", "g")
    of = pairs.join(side(names), ["lang", "g"]).join(side(names.select("lang", F.col("source").alias("item"), F.col("g").alias("h"))), ["lang", "h"])
    ordered = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    of = of.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ordered).alias("rank"))
    out = full.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    out = out.withColumn("rank", F.row_number().over(ordered)).filter(F.col("rank") <= terms_listed)
    return of.unionByName(out)
