"""What a worker holds."""

import pyarrow as pa
import pytest
import public_tokenizers

from framesift.llm import bpe, common


def test_bpe_cuts_texts_in_small_portions(spark, monkeypatch):
    def spy(batches, rows=common.BATCH_ROWS, size=common.BATCH_BYTES):
        for b in cut(batches, rows, size):
            if b.num_rows > 1:
                assert b.nbytes <= 1 << 19, b.nbytes
            yield b

    cut = common.cut_batches
    monkeypatch.setattr(common, "cut_batches", spy)
    df = spark.range(900).selectExpr("id AS doc_id", "repeat(concat('word', id % 50, ' '), 500) AS text").coalesce(1)
    got = bpe.bpe_round_trip(df, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"]).select("doc_id", "n_tokens").collect()
    assert len(got) == 900 and all(r.n_tokens >= 500 for r in got)


def test_lean_gives_all_batches():
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k))], names=["x"]) for k in (3, 0, 5)]
    assert [b.num_rows for b in common.lean(lambda it: (b.slice(1) for b in it))(iter(batches))] == [2, 0, 4]
    with pytest.raises(ZeroDivisionError):
        list(common.lean(lambda it: (1 // 0 for _ in it))(iter(batches)))
