from pyspark.sql import functions as F

from folioworks.llm.batches import BYTES, SENT, map_texts


def test_batches_are_bounded_and_whole(spark):
    """Texts reach Python a few MB at a time, every one whole, in any number of batches."""
    docs = spark.range(0, 900, 1, 1).select("id", F.when(F.col("id") % 7 > 0, F.repeat(F.lit("né "), F.when(F.col("id") == 450, 2_000_000).otherwise(5_000).cast("int"))).alias("text"))
    spark.conf.unset(SENT)
    sizes = map_texts(docs, lambda texts: ((len(x),) for x in texts), "n long")
    assert spark.conf.get(SENT) == str(BYTES)
    assert {r.id: r.n for r in sizes.collect()} == {i: 0 if i % 7 == 0 else 8_000_000 if i == 450 else 20_000 for i in range(900)}
    sent = docs.mapInArrow(lambda batches: (b.select([0]).slice(0, 1) for b in batches), "id long")
    assert sent.count() > 3


def test_a_named_bound_stays(spark):
    spark.conf.set(SENT, "1m")
    map_texts(spark.createDataFrame([(1, "a")], "id int, text string"), lambda texts: ((len(x),) for x in texts), "n long").collect()
    assert spark.conf.get(SENT) == "1m"
    spark.conf.unset(SENT)
