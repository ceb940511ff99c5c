"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate: its target share of the output over its share of the input. A
document's number of copies is drawn from the Poisson distribution with that mean, by inverting its
cumulative distribution at a uniform number that a hash of the seed and the document gives, so the draw is
the same in any run, order or partitioning. Documents are exploded by their counts and dealt globally in the
order of another hash. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, boxed, default_partitions

#: A mean above this is split in equal parts, each with a draw of its own: the sum has the same distribution and exp(-mean) cannot vanish.
PART = 128.0
BROADCAST_SOURCES = 10_000
#: Above that, into how many parts a source's documents are cut for the join.
CUTS = 64
HEX_DIGITS = 13
#: Bytes of text in a partition of the output.
PARTITION_BYTES = 128 << 20


def uniform(*parts: Column | str) -> Column:
    """A double in [0, 1) from the first 52 bits of the MD5 of the parts joined by '|'."""
    text = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, HEX_DIGITS), 16, 10).cast("double") / F.lit(float(16**HEX_DIGITS))


def source_sizes(docs: DataFrame) -> DataFrame:
    """(_source, _size): UTF-8 bytes of each source's texts; a null source is the source ''."""
    return docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_source")).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).alias("_size"))


def rates(sizes: DataFrame, weights: dict[str, float] | None, temperature: float, budget: float) -> DataFrame:
    """(_source, _rate): mean copies of a document of the source, for an output of budget x the input's bytes.

    weights: target share by source (scaled to sum 1; sources not named get none). Without weights the share
    is proportional to size ** temperature. A source without a byte has rate 1.
    """
    if weights is None:
        weighted = sizes.withColumn("_weight", F.pow(F.col("_size").cast("double"), F.lit(float(temperature))))
    else:
        named = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]) if weights else None
        weighted = sizes.withColumn("_weight", F.coalesce(F.try_element_at(named, F.col("_source")), F.lit(0.0)) if weights else F.lit(0.0))
    totals = weighted.agg(F.sum(F.when(F.col("_size") > 0, F.col("_weight"))).alias("w"), F.sum("_size").alias("n")).first()
    scale = budget * float(totals["n"] or 0) / (totals["w"] or 1.0)
    return weighted.select("_source", F.when(F.col("_size") > 0, F.col("_weight") * F.lit(scale) / F.col("_size")).otherwise(F.lit(1.0)).alias("_rate"))


def cumulative(mean: Column) -> Column:
    """Array of P(X <= k), k = 0, 1, ..., far into the upper tail (what lies beyond is below 1e-15)."""
    far = F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int")
    grown = F.aggregate(
        F.sequence(F.lit(1), far),
        F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c")),
        lambda s, k: F.struct((s["p"] * mean / k).alias("p"), F.concat(s["c"], F.array(F.element_at(s["c"], -1) + s["p"] * mean / k)).alias("c")),
    )
    return grown["c"]


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, budget: float = 1.0, seed: int = 0) -> DataFrame:
    """Every row of docs(doc_id, text, source, ...) as often as drawn, globally shuffled.

    Adds copy int (from 1), n_copies int and shuffle_key string, by which the output is range-partitioned and
    sorted; input columns of these names are replaced, all others stay whatever their names. A null source is the source ''; a null text has size 0;
    a null doc_id draws like the id ''; repeated rows draw alike; an empty table gives an empty result.
    """
    docs = docs.drop("copy", "n_copies", "shuffle_key")
    scratch = Scratch(docs.sparkSession, "mixing")
    sizes = scratch.keep(source_sizes(docs), "sizes")
    size = sizes.agg(F.sum("_size")).first()[0] or 0
    table = rates(sizes, weights, temperature, budget)
    parts = F.greatest(F.lit(1), F.ceil(F.col("_rate") / PART)).cast("int")
    table = table.withColumn("_parts", parts).withColumn("_cdf", cumulative(F.col("_rate") / F.col("_parts")))
    table = scratch.keep(table, "rates")
    few = table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    side = F.broadcast(table) if few else table.withColumn("_cut", F.explode(F.sequence(F.lit(0), F.lit(CUTS - 1))))
    key = F.coalesce(F.col("_doc.doc_id").cast("string"), F.lit(""))
    draw = lambda k: F.size(F.filter("_cdf", lambda c: c <= uniform(str(seed), key, k.cast("string"))))
    drawn = docs.select(boxed(docs).alias("_doc"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_source"))
    if few:
        drawn = drawn.join(side, "_source")
    else:  # a large source goes to many tasks
        drawn = drawn.withColumn("_cut", F.pmod(F.xxhash64("_doc.doc_id", "_doc.text"), F.lit(CUTS)).cast("int")).join(side, ["_source", "_cut"])
    one = F.size(F.filter("_cdf", lambda c: c <= F.col("_u")))
    more = F.aggregate(F.sequence(F.lit(2), F.col("_parts")), F.lit(0), lambda s, k: s + draw(k))
    drawn = drawn.withColumn("_u", uniform(str(seed), key, "1")).withColumn("n_copies", F.when(F.col("_parts") == 1, one).otherwise(one + more))
    copies = drawn.filter("n_copies > 0").select("_doc", "n_copies").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(f"{seed}-order"), key, F.col("copy").cast("string"))))
    # The key is uniform, so its ranges are known without sampling.
    n = max(default_partitions(docs.sparkSession), math.ceil(budget * size / PARTITION_BYTES))
    place = (F.conv(F.substring("shuffle_key", 1, HEX_DIGITS), 16, 10).cast("double") / F.lit(float(16**HEX_DIGITS)) * F.lit(n)).cast("int")
    return keyed.repartitionById(n, place).sortWithinPartitions("shuffle_key", "_doc.doc_id").select("_doc.*", "copy", "n_copies", "shuffle_key")

