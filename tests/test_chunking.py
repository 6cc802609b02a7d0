"""Chunks by the tokens of a model against the tokenizer itself."""

import random

import pytest

from lodestone.operators import chunking

public_tokenizers = pytest.importorskip("public_tokenizers")
TEXTS = [
    None, "", " ", "one", "a b  c\n\nd e", "é ü 漢字仮名 😀😀😀 end", "word " * 700, "<|endoftext|> is text", "x" * 3_000, "\ttab nbsp em",
]


def plain(tokenizer, text, size, overlap):
    """(start, end, n) by a walk over the tokens."""
    spans = tokenizer.encode(text, add_special_tokens=False).offsets
    out, at = [], 0
    while True:
        piece = spans[at:at + size]
        last = at + size >= len(spans)
        out.append((piece[0][0] if at else 0, len(text) if last else spans[at + size][0], len(piece)))
        if last:
            return out
        at += size - overlap


@pytest.mark.parametrize("name,size,overlap", [
    ("byte_bpe_50k.json", 4, 0), ("byte_bpe_50k.json", 512, 0), ("byte_bpe_50k.json", 5, 2), ("word_bpe_49k.json", 3, 0), ("byte_bpe_50k.json", 1, 0)])
def test_chunks_are_runs_of_tokens(spark, name, size, overlap):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    rng = random.Random(size)
    texts = TEXTS + ["".join(rng.choices("ab é漢😀 \n.", k=rng.randrange(1, 60))) for _ in range(20)]
    rows = spark.createDataFrame([(i, t, f"s{i}") for i, t in enumerate(texts)], "doc_id bigint, text string, _chunks string")
    found = {}
    chunks = chunking.chunk_subwords(rows, chunking.tokenizer_starts(path), size, overlap, batch_size=3)
    assert chunks.columns == ["doc_id", "_chunks", "chunk_id", "position", "start_char", "end_char", "n_tokens", "text_content"]
    for r in chunks.collect():
        assert r.text_content == texts[r.doc_id][r.start_char:r.end_char] and r._chunks == f"s{r.doc_id}"
        assert r.chunk_id == (r.doc_id << 20) + r.position
        found.setdefault(r.doc_id, {})[r.position] = (r.start_char, r.end_char, r.n_tokens)
    for i, text in enumerate(texts):
        tokens = text and tokenizer.encode(text, add_special_tokens=False).ids
        want = plain(tokenizer, text, size, overlap) if tokens else []
        got = found.get(i, {})
        assert [got[p] for p in sorted(got)] == want and sorted(got) == list(range(len(want))), text
        if want and not overlap:
            assert "".join(text[a:b] for a, b, _ in want) == text
    assert chunking.chunk_subwords(rows.limit(0), chunking.tokenizer_starts(path)).count() == 0


def test_overlap_must_be_below_the_size(spark):
    rows = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    with pytest.raises(ValueError):
        chunking.chunk_subwords(rows, lambda: None, 4, 4)


def test_results_leave_a_worker_in_small_slices():
    import pyarrow as pa

    from lodestone.operators import infer

    calls = []
    batch = pa.RecordBatch.from_pydict({"k": list(range(1_000)), "text": [str(i) for i in range(1_000)]})
    slices = infer._answered(batch, lambda texts: calls.append(len(texts)) or [t * 2 for t in texts], ["text"], "out", pa.string(), 64)
    first = next(slices)
    assert first.num_rows == sum(calls) == infer.ROWS_OUT and max(calls) == 64
    rest = [r for b in slices for r in b.to_pylist()]
    assert [r["out"] for r in first.to_pylist() + rest] == [str(i) * 2 for i in range(1_000)]
