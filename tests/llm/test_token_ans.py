import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from turfline.llm import token_ans as T
from turfline.llm.subwords import word_tokenizer
from turfline.session import scratch_path


def test_blocks_round_trip():
    rng = np.random.default_rng(2)
    ids = (rng.zipf(1.2, 200_000) % 5000).astype("<u2")
    table = T.Frequencies.of_counts(np.bincount(ids, minlength=T.SYMBOLS))
    assert table.frequency.sum() == 1 << T.BITS
    cuts = [0, 1, 33, 70_000, 70_500, 200_000]
    blocks = [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    frames = [T.pack_frame([7, None], [1, len(b) - 1], b, c, table) for b, c in zip(blocks, T.encode(blocks, table), strict=True)]
    for block, (docs, lengths, back) in zip(blocks, T.open_frames(frames, table), strict=True):
        assert docs == [7, None] and lengths.sum() == len(block) and np.array_equal(block, back)
    # Decoding may start at any checkpoint.
    words, states, places, n = T.open_frame(frames[2], table)["job"]
    step = T.TURNS * T.LANES
    tail = T.decode([(words, states[2:], places[2:], n - 2 * step)], table)[0]
    assert np.array_equal(tail, blocks[2][2 * step :])


def test_damage_is_noticed():
    ids = np.arange(5000, dtype="<u2") % 97
    table = T.Frequencies.of_counts(np.bincount(ids, minlength=T.SYMBOLS))
    frame = bytearray(T.pack_frame([1], [5000], ids, T.encode([ids], table)[0], table))
    frame[-20] ^= 1
    with pytest.raises(ValueError):
        list(T.open_frames([bytes(frame)], table))


def test_one_symbol_and_all_symbols():
    for ids in (np.full(1000, 9, "<u2"), np.arange(65536, dtype="<u2")):
        table = T.Frequencies.of_counts(np.bincount(ids, minlength=T.SYMBOLS))
        frame = T.pack_frame([1], [len(ids)], ids, T.encode([ids], table)[0], table)
        assert np.array_equal(next(T.open_frames([frame], table))[2], ids)


def test_files_hold_the_librarys_ids(spark, frame, odd):
    rows = odd + [(50, "x<|endoftext|>. <|ENDOFTEXT|> don't I'LL 12ab word*** a't. ﬁne áb ſt İ ΑΣ é., a_b (x)")]
    path = scratch_path(spark, "test-tokens")
    T.write_tokens(frame(rows), path)
    got = T.read_tokens(spark, path).collect()
    library = Tokenizer.from_file(word_tokenizer())
    want = sorted(
        ((d is not None, d or 0), tuple(library.encode(t or "", add_special_tokens=False).ids + [2])) for d, t in rows
    )
    have = sorted(((r.doc_id is not None, r.doc_id or 0), tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got)
    assert have == want
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start and r.ids_crc32 == zlib.crc32(r.ids) and r.n_tokens == len(r.ids) // 4
        start += r.n_tokens
    order = [(r.doc_id is not None, r.doc_id or 0) for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)


def test_empty_table(spark, frame):
    path = scratch_path(spark, "test-tokens")
    T.write_tokens(frame([]), path)
    assert T.read_tokens(spark, path).collect() == []
