"""Listed files hold a bounded number of documents, whatever the size of a source."""

from types import SimpleNamespace

from framegate.plans import q_sources
from framegate.sources import readers


def test_a_large_source_is_spread_over_bounded_files(spark):
    docs = spark.range(0, 1000, 1, 4).selectExpr("id AS doc_id", "if(id % 3 = 0, 'a', 'b') AS source", "'text' AS text")
    folder = q_sources.bounded_text_files(SimpleNamespace(spark=spark, documents=docs), rows=50)
    files = readers.list_images(spark, folder, suffixes=("txt",)).select(q_sources.source_of("path"), "size").collect()
    assert max(r["size"] for r in files) <= 50 * 5
    assert {s: sum(r["size"] for r in files if r["source"] == s) for s in "ab"} == {"a": 334 * 5, "b": 666 * 5}
