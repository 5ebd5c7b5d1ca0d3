"""Texts are encoded a bounded number of bytes at once, with the same ids."""

import public_tokenizers
import pyarrow as pa

from driftline.llm.tokens import encode_rows


def test_smaller_slices_give_the_same_ids():
    texts = [f"word number {k}, and again" * 5 for k in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(texts)], ["doc_id", "text"])
    path = public_tokenizers.path("word_bpe_49k.json")
    whole, parts = list(encode_rows([batch], path, 2)), list(encode_rows([batch], path, 2, 1000))
    assert len(whole) == 1 and len(parts) > 5
    assert [x for _, ids, _ in parts for x in ids.tolist()] == whole[0][1].tolist()
