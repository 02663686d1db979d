import corpus_pipeline
from folioworks.llm import bpe
from folioworks.llm.queries import VOCABULARY


def test_the_last_stage_decodes(spark):
    rows = [(1, "Bread and Café, twice: bread!", "en", "s", 29), (2, "", "en", "s", 0), (3, None, "en", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    after = dict(corpus_pipeline.STAGES)["bpe_encoding"](spark, docs, None)
    assert after.columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "ids", "decoded"]
    own = bpe.load(VOCABULARY)
    for r in after.collect():
        assert r.decoded == own.decode(bytes(r.ids)).decode() and bool(r.decoded) == (r.doc_id == 1)
