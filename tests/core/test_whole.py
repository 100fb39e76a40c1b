import pytest

from quillon import catalog


@pytest.mark.parametrize("name, every", [("embed_text", 1), ("table_groups", 5)])
def test_no_document_is_left_out(spark, name, every):
    """On a table where only some documents have a vector."""
    sf = "/root/testdata/sf0.01"
    ids = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    held = {r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect()}
    got = {r.chunk_idx for r in catalog.queries()[name](spark, sf).select("chunk_idx").collect()}
    assert ids - held and {i for i in ids if i % every == 0} <= got <= ids
