import pytest
from pyspark.sql import types as T

from skysift.llm.common import ready

#: Columns that operators use for their own purposes, to show that such names do no harm.
CLASHING = ["id", "row", "n", "n_words", "score", "spans", "keys", "copy", "place", "part", "cluster", "quality", "toxic"]


@pytest.fixture(autouse=True)
def prepared(spark):
    return ready(spark)


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text[, source]) with all columns of the table and clashing extra ones."""

    def build(rows):
        kinds = [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType())]
        schema = T.StructType([T.StructField(n, k) for n, k in kinds] + [T.StructField(n, T.StringType()) for n in CLASHING])
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None, *["x"] * len(CLASHING)) for r in rows]
        return spark.createDataFrame(full, schema)

    return build


@pytest.fixture
def quality_labels(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
