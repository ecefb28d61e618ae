"""Groups follow the number of pieces, not of documents."""

from gridscope.llm import packing


def test_long_documents_are_dealt_into_groups(spark, frame, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 8)
    docs = frame("doc_id long, text string", *[(k, "word other " * 10_000) for k in range(4)])
    rows = packing.packed(docs).collect()
    groups = {}
    for r in rows:
        groups[r["sequence_id"] >> 32] = groups.get(r["sequence_id"] >> 32, 0) + 1
    assert len(rows) >= 36 and len(groups) >= 3 and max(groups.values()) < len(rows) / 2
    assert sum(r["length"] for r in rows) == sum(r["length"] for r in packing.token_pieces(docs).collect())
