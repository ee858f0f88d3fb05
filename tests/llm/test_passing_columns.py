"""What goes through Python beside the work."""
from tests.llm.helpers import DOCS, rows
from tickloom.llm import byte_cnn


def test_a_text_that_passes_goes_to_python_once(spark):
    docs = spark.createDataFrame(rows(), DOCS).select("doc_id", "text", "lang", "source", "n_chars")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = byte_cnn.classify(docs, labels, keep=True)
    assert kept.columns == [*docs.columns, "score"] and "_text" not in kept._jdf.queryExecution().analyzed().toString()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "")
    got, want = sorted(kept.drop("score").collect(), key=key), sorted(docs.collect(), key=key)
    assert got == want
