"""Mix sources to target weights by Poisson replication.

Each document is repeated as often as a Poisson variable says whose mean is its source's
repetition rate. The variable is inverted from a hash of seed and id, so a rerun or a
retried task repeats the same documents. The copies are dealt out by a hash, which shuffles them globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skysift.llm.common import let
from skysift.session import staged

# Larger means are the sum of equal parts below this; the table of one part then ends below 2 ** -52.
PART = 8.0
TERMS = 64


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 of the parts."""
    text = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    return F.conv(F.substr(text, F.lit(1), F.lit(13)), 16, 10).cast("bigint") / F.lit(float(16**13))


def repetition_rates(
    docs: DataFrame, weights: DataFrame | None = None, temperature: float = 0.5, rows: int | None = None, source: str = "source"
) -> DataFrame:
    """(source, rate): mean copies of a document such that sources take their target shares.

    ``weights`` (source, weight) sets the targets; a source without one has weight zero. Without
    a table a source weighs its number of documents to the power ``temperature``. ``rows`` is the
    size to reach, by default that of ``docs``. A null source is a source.
    """
    counts = docs.groupBy(F.col(source).cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighed = counts.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(temperature)))
    else:
        given = weights.groupBy(F.col("source").alias("_s")).agg(F.sum("weight").cast("double").alias("weight"))
        weighed = counts.join(given, F.col("source").eqNullSafe(F.col("_s")), "left").select(
            "source", "n", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight")
        )
    weighed = staged(weighed, "weights")
    all_weight, all_rows = weighed.agg(F.sum("weight"), F.sum("n")).first()  # two numbers
    if not all_weight:
        return weighed.select("source", F.lit(0.0).alias("rate"))
    rate = F.col("weight") / F.lit(all_weight) * F.lit(float(all_rows if rows is None else rows)) / F.col("n")
    return weighed.select("source", rate.alias("rate"))


def _tables(rates: DataFrame) -> DataFrame:
    """Per source the number of equal parts of its mean and the distribution function of one part."""
    parts = F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int")
    mean = F.col("rate") / F.col("parts")
    first = F.struct(F.exp(-F.col("mean")).alias("p"), F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("f"))

    def step(state: Column, k: Column) -> Column:
        total = state["s"] + state["p"]
        return F.struct(
            (state["p"] * F.col("mean") / (k + 1)).alias("p"), total.alias("s"), F.concat(state["f"], F.array(total)).alias("f")
        )

    table = F.aggregate(F.sequence(F.lit(0), F.lit(TERMS - 1)), first, step, lambda state: state["f"])
    return rates.withColumn("parts", parts).withColumn("mean", mean).select(
        F.col("source").alias("_source"), "parts", table.alias("steps")
    )


def mixed(docs: DataFrame, rates: DataFrame, seed: int = 0, key: str = "doc_id", source: str = "source") -> DataFrame:
    """Copies of the documents in a global random order.

    Returns struct ``row`` (the document's own columns), ``copy`` (0, 1, …) and ``place`` (the random
    order; ties by key). Repeated rows of one id are repeated alike. A row without an id draws by a hash of its columns. A source
    missing from ``rates`` has rate zero. Texts, null or not, are passed on as they are.
    """
    # Written first: its true size is known, and Spark broadcasts it only if that is small.
    steps = staged(_tables(rates), "rates")
    plain = [f.name for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    own = F.concat(F.lit("-"), F.xxhash64(*plain).cast("string"))
    held = docs.select(
        F.struct("*").alias("row"), F.coalesce(F.col(key).cast("string"), own).alias("id"), F.col(source).cast("string").alias("_s")
    )
    drawn = held.join(steps, F.col("_s").eqNullSafe(F.col("_source")))
    count = F.aggregate(
        F.sequence(F.lit(0), F.col("parts") - 1),
        F.lit(0),
        lambda total, part: total + let(
            unit_hash(F.lit(seed), F.col("id"), part),
            lambda u: F.aggregate(F.col("steps"), F.lit(0), lambda n, s: n + (u >= s).cast("int")),
        ),
    )
    counted = drawn.select("row", "id", count.alias("n")).filter("n > 0")
    copies = counted.select("row", "id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy"))
    place = unit_hash(F.lit(seed), F.lit("place"), F.col("id"), F.col("copy"))
    dealt = copies.withColumn("place", place).repartition("place").sortWithinPartitions("place", "id", "copy")
    return dealt.select("row", "copy", "place")


def flat(copies: DataFrame) -> DataFrame:
    """The documents' columns beside ``copy`` and ``place``; where a document has a column of that name, the added one ends in ``_``."""
    taken = {name.lower() for name in copies.schema["row"].dataType.names}

    def free(name: str) -> str:
        return free(f"{name}_") if name in taken else name

    return copies.select("row.*", *[F.col(name).alias(free(name)) for name in ("copy", "place")])
