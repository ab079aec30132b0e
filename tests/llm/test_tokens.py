"""Cached chunk encoding against the tokenizers library's encoding of whole texts; packing and counting on odd rows."""

import collections
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attestry.llm.packing import PackParams, pack, piece_lengths
from attestry.llm.tokencount import CountParams, count_tokens, read_cache, version_of
from attestry.llm.tokens import ChunkCounter, ChunkEncoder, slices
from attestry.session import scratch_path

from oddrows import rows

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
encoder, counter = ChunkEncoder(BYTES), ChunkCounter(WORDS)


def whole(tokenizer, text):
    return tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t\r'.,aAsS19éß<|>\x1c  ́")), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_any_text(text):
    assert np.frombuffer(encoder.ids(text), "<u4").tolist() == whole(encoder.tokenizer, text)
    assert counter.counts([text])[0] == len(whole(counter.tokenizer, text))


@pytest.mark.parametrize("text", ["I'LL don't we're", "x<|endoftext|>y <|startoftext|> z", "a  b \n c\n\n d", " lead", "end ", "ΟΔΟΣ İ", "Word, word. WORD"])
def test_known_texts(text):
    for _ in range(2):      # cold and from the cache
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == whole(encoder.tokenizer, text)
        assert counter.counts([text, text]) == [len(whole(counter.tokenizer, text))] * 2


def test_slices_cover_all():
    texts = ["x" * n for n in (0, 5, 3_000_000, 1, 1, 2_000_000, 7)]
    assert [i for a, b in slices(texts) for i in range(a, b)] == list(range(len(texts)))


def test_piece_lengths():
    assert piece_lengths(1024 * 2 + 5, 1024) == [1024, 1024, 4, 1] and piece_lengths(0, 8) == []


def test_packing_round_trip(odd, none):
    found = collections.defaultdict(list)
    pieces = pack(odd, PackParams(BYTES)).collect()
    assert len({r.sequence_id for r in pieces}) == len(pieces) and {r.offset for r in pieces} == {0}
    for r in pieces:
        assert r.length & (r.length - 1) == 0 and r.length <= 1024 and len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        found[r.doc_id].append(r)
    want = collections.defaultdict(list)
    for i, text, *_ in rows():
        want[i].append(whole(encoder.tokenizer, text or "") + [0])
    for i, texts in want.items():
        at = {(r.start, r.ids) for r in found[i]}
        assert sum(r.length for r in found[i]) == sum(map(len, texts))
        for ids in texts:
            start = 0
            for n in piece_lengths(len(ids), 1024):
                assert (start, np.array(ids[start:start + n], "<u4").tobytes()) in at
                start += n
    assert pack(none, PackParams(BYTES)).collect() == []
    with pytest.raises(ValueError):
        pack(none, PackParams(BYTES, length=1000))


def test_count_and_cache(spark, odd, none):
    p, cache = CountParams(WORDS), scratch_path(spark, "cache")
    assert count_tokens(none, cache, p).collect() == []
    for _ in range(2):      # the second run finds every content in the cache
        got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(odd, cache, p).collect())
        want = [(str(i), len((t or "").encode()), n := len(whole(counter.tokenizer, t or "")), n > 2048) for i, t, *_ in rows()]
        assert got == sorted(want)
        stored = read_cache(spark, cache, version_of(WORDS))
        assert spark.read.parquet(cache).count() == stored.count()      # distinct contents, each encoded once
    assert read_cache(spark, cache, "another version").count() == 0
