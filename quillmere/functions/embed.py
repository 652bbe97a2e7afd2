"""The hashing embedder (SC19, U2), as SQL expressions over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.functions.text import normalize

DIMENSIONS = 256
# Weights of words, of pairs of words, and of runs of four characters.
WORD, PAIR, RUN = 1.0, 0.7, 0.25


def features(text: Column) -> Column:
    """Features of a text with their weights: words, joined neighbours, and runs of four characters."""
    norm = normalize(text)
    words = F.filter(F.split(norm, " "), lambda w: w != "")

    def weighted(names: Column, weight: float) -> Column:
        return F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(weight).alias("weight")))

    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.lit(0), F.size(words) - 1)), F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws("_", a, b))
    starts = F.when(F.length(norm) > 3, F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(norm) - 3))).otherwise(F.array().cast("array<int>"))
    runs = F.transform(starts, lambda i: F.concat(F.lit("c:"), F.substring(norm, i, F.lit(4))))
    return F.concat(weighted(words, WORD), weighted(pairs, PAIR), weighted(runs, RUN))


def embedded(rows: DataFrame, keys: list[str], text: str = "text", dimensions: int = DIMENSIONS) -> DataFrame:
    """Unit vectors of texts: keys, embedding (array<double>, rounded to 8 places).

    Equal texts are embedded once. A feature's MD5 gives its place (first four
    bytes, little-endian) and its sign (parity of the fifth). Weights are summed
    by text and place before any vector is put together. A text without words is
    a zero vector.
    """
    texts = rows.select(F.coalesce(F.col(text), F.lit("")).alias("t")).distinct()
    flat = texts.select("t", F.explode(features(F.col("t"))).alias("f")).select("t", F.md5("f.name").alias("m"), "f.weight")
    little = F.concat(*(F.substring("m", i, 2) for i in (7, 5, 3, 1)))
    place = F.pmod(F.conv(little, 16, 10).cast("long"), F.lit(dimensions)).cast("int")
    sign = F.when(F.pmod(F.conv(F.substring("m", 9, 2), 16, 10).cast("int"), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    sums = flat.select("t", place.alias("at"), (sign * F.col("weight")).alias("x")).groupBy("t", "at").agg(F.sum("x").alias("x"))
    found = sums.groupBy("t").agg(F.map_from_entries(F.collect_list(F.struct("at", "x"))).alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"))
    unit = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.coalesce(F.round(F.try_divide(F.element_at("m", i), F.col("size")), 8), F.lit(0.0)))
    vectors = texts.join(found, "t", "left").select("t", unit.alias("embedding"))
    return rows.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("t")).join(vectors, "t").select(*keys, "embedding")
