import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from coffer.llm import bestfit, mixture, tokens
from helpers import documents, odd_rows, prose

PATH = tokens.word_bpe_path()
PLAIN = Tokenizer.from_file(PATH)


def plain_ids(text, end):
    return PLAIN.encode(text or "", add_special_tokens=False).ids + [end]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_ids_are_the_tokenizers(texts):
    import pyarrow as pa

    texts += ["It's I'LL don't we've 12 345!!'s", "a<|endoftext|>b <|startoftext|>", "ÀÉß x̂ ﬁ İstanbul ΣΑΣ", "x\x1cy\x85z w v", "日本語 テキスト"]
    ids, offsets = tokens.word_ids(PATH).encode(pa.array(texts), 2)
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == plain_ids(t, 2)


def test_words_with_and_without_marks_share_one_cached_word():
    import pyarrow as pa

    texts = ["Stone stone, STONE. stone! stone; stone's st0ne <|stone stone<| ,, .", "stone?stone éstone, stone,, 'stone'"]
    coder = tokens.WordIds(PATH)
    ids, offsets = coder.encode(pa.array(texts), 2)
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == plain_ids(t, 2)
    assert {"stone", ",", "."} <= set(coder.words.new)
    assert not {"Stone", "stone,", "STONE.", "stone!", "stone;"} & set(coder.chunks.new)


def check_cover(rows, wanted):
    """Each id of each document lies in exactly one piece."""
    pieces = defaultdict(list)
    for doc, start, ids in rows:
        pieces[doc].append((start, ids))
    for doc, parts in pieces.items():
        assert len(parts) >= len(wanted[doc])
        joined = sorted(parts, key=lambda p: p[0])
        if len(wanted[doc]) == 1:
            assert sum((ids for _, ids in joined), []) == wanted[doc][0]
    assert sum(len(ids) for parts in pieces.values() for _, ids in parts) == sum(len(t) for v in wanted.values() for t in v)


def test_mixture_pack_is_a_partition(spark):
    rows = odd_rows()
    got = mixture.pack(documents(spark, rows).repartition(3), length=64, window=1024, with_ids=True).collect()
    wanted = defaultdict(list)
    for doc, text in rows:
        wanted[doc].append(plain_ids(text, 2))
    check_cover([(r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in got], wanted)
    sequences = defaultdict(list)
    for r in got:
        assert r.length * 4 == len(r.ids) and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for k, parts in sequences.items():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]]
        assert ends[-1] == 64 or k == len(sequences) - 1


def test_windows_hold_the_target_mixture(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 40), "en", "big" if i % 3 else "small") for i in range(600)]
    df = documents(spark, rows).repartition(5)
    got = mixture.pack(df, length=128, window=4096, with_ids=False)
    shares = defaultdict(lambda: defaultdict(int))
    for r in got.collect():
        shares[r.window_id][r.queue] += r.length
    target = sum(w["big"] for w in shares.values()) / sum(sum(w.values()) for w in shares.values())
    upto = defaultdict(int)
    for k in sorted(shares)[:-1]:
        # the deficit that a queue carries is below one packet
        for q, part in (("big", target), ("small", 1 - target)):
            upto[q] += shares[k][q]
            assert 0 <= (k + 1) * 4096 * part - upto[q] <= 128 + 1
    even = mixture.pack(df, length=128, window=4096, weights={"big": 1, "small": 1})
    first = defaultdict(int)
    for r in even.where("window_id = 0").collect():
        first[r.queue] += r.length
    assert abs(first["big"] - first["small"]) <= 256


def test_best_fit_decreasing_matrices(spark):
    rows = odd_rows()
    got = bestfit.packed_matrices(documents(spark, rows).repartition(2), length=128, block_tokens=3000).collect()
    wanted = defaultdict(list)
    for doc, text in rows:
        wanted[doc].append(plain_ids(text, 49407))
    out = []
    for r in got:
        ids, positions = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(positions) == 128 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        for a, b, doc, start in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.starts, strict=False):
            out.append((doc, start, ids[a:b].tolist()))
            assert positions[a:b].tolist() == list(range(b - a))
        assert not ids[r.n_tokens :].any() and not positions[r.n_tokens :].any()
    check_cover(out, wanted)


@given(st.lists(st.integers(1, 20), max_size=40))
def test_best_fit_chooses_the_tightest_bin(sizes):
    bins = bestfit.best_fit_decreasing(np.array(sizes, int), 20)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    room, made = [], []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [r for r in room if r >= sizes[i]]
        if fits:
            k = room.index(min(fits))
            room[k] -= sizes[i]
            made[k].append(sizes[i])
        else:
            room.append(20 - sizes[i])
            made.append([sizes[i]])
    # bins of equal room are interchangeable
    assert sorted(sum(sizes[i] for i in b) for b in bins) == sorted(sum(b) for b in made)


@pytest.mark.parametrize("pack", [mixture.pack, bestfit.packed_matrices])
def test_empty(spark, pack):
    assert pack(documents(spark, [])).count() == 0
