"""Ids of packed pieces: they stay with their piece, also where documents repeat."""

from collections import defaultdict

from grantlake.llm import packing, registered


def test_ids_after_packing(spark):
    rows = [(k % 40, "word " * (k % 37) + f"x{k % 40}") for k in range(400)] + [(None, None), (7, "long " * 900), (7, "long " * 900), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    file = registered.tokenizer_file()
    plain = packing.pieces(docs, file, 256, with_ids=True).collect()
    packed = packing.pack_documents(docs, file, capacity=256, with_ids=True, per_task=100)
    assert "row" not in packed.columns
    got = packed.collect()
    key = lambda r: (r.doc_id or -1, r.piece, r.length, r.ids_crc32, tuple(r.ids))
    assert sorted(map(key, got)) == sorted(map(key, plain))
    sequences = defaultdict(list)
    for r in got:
        assert len(r.ids) == r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= 256
