"""The path of op1_lmscore for filters beyond the broadcast bound."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabkit.llm import lmscore


def test_hashes_survive_packing():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5000):
        h = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64, endpoint=False))
        assert (lmscore.unpack(lmscore.pack(h)) == h).all()
    assert lmscore.unpack(lmscore.pack(np.array([0, 2**64 - 1], np.uint64))).tolist() == [0, 2**64 - 1]


@pytest.mark.parametrize("block_bytes", [200, 8 << 20])
def test_segments_answer_all_blocks_at_once(spark, monkeypatch, block_bytes):
    """Blocks travel as compressed texts, not as eight bytes a token, and every segment is searched once, whatever the number of blocks."""
    monkeypatch.setattr(lmscore, "BLOCK_BYTES", block_bytes)
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit("w"), (F.col("id") * k) % 37) for k in range(1, 30)]).alias("text"))
    docs = docs.withColumn("text", F.when(F.col("doc_id") == 7, None).when(F.col("doc_id") == 8, "").otherwise(F.col("text")))
    rows = lambda bound: sorted(lmscore.score(docs, lmscore.train(docs.where("doc_id % 3 > 0"), filter_bytes=bound), keep=["doc_id"]).collect())
    staged = []
    keep = lmscore.stage
    monkeypatch.setattr(lmscore, "stage", lambda df, label: staged.append((label, out := keep(df, label))) or out)
    assert rows(0) == rows(lmscore.FILTER_BYTES)
    blocks = dict(staged)["lmblocks"]
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    assert blocks.columns == ["block", "body"]
    if block_bytes > size:
        assert blocks.agg(F.sum(F.octet_length("body"))).first()[0] < size < 8 * docs.agg(F.sum(F.size(F.split("text", " ")))).first()[0]
    else:
        assert blocks.count() >= 2
