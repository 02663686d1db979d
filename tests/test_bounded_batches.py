"""What queries send to Python at once is bounded by bytes, whatever the texts."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioworks.plans import document_queries  # noqa: F401  registers them
from folioworks.plans.registry import QUERIES
from folioworks.session import SENT, SENT_BYTES


@pytest.mark.parametrize("name", ["normal_forms", "content_digest"])
def test_texts_reach_python_in_bounded_batches(spark, tmp_path, name):
    text = F.concat(F.lit("é"), F.repeat(F.lit("word "), 2000))
    spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.unset(SENT)
    assert QUERIES[name](spark, str(tmp_path)).count() == 3000

    @F.pandas_udf("long")
    def batch_bytes(texts: pd.Series) -> pd.Series:
        return pd.Series([texts.str.len().sum()] * len(texts))

    texts = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert texts.select(F.max(batch_bytes("text"))).first()[0] <= 2 * SENT_BYTES
