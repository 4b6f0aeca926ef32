import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from granary.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def whole(text):
    ids = Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [0]
    return [(k, at, ids[at : at + 2048]) for k, at in enumerate(range(0, len(ids), 2048))]


def check(frame, sample=40):
    rows = packing.packed(frame, PATH).collect()
    want = defaultdict(list)
    for r in frame.collect():
        for k, at, ids in whole(r.text):
            want[r.doc_id].append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        bins[r.sequence_id].append((r.offset, r.length))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(bins), sum(r.length for r in rows) / 2048


def test_pieces_and_places(docs, odd, empty):
    n, least = check(docs)
    assert n <= least + 2
    check(odd)
    assert packing.packed(empty, PATH).count() == 0


def test_word_ids_equal_the_tokenizer():
    words, tokenizer = packing.WordIds(PATH), Tokenizer.from_file(PATH)
    assert words.by_word
    for text in (
        "It's DON'T we'll 12a3 a,b.c ÀÉÎ ß ÿ ×÷ µ ª º",
        "ſ İI ı Σ ΑΣ",
        "é a b\x1cc\x85d",
        "½ ² 3³ ¼",
        "<|endoftext|> x",
        "naïve…—“q”",
        "日本語 тест",
        "a­b",
        "'s 'S 'Re",
        " ",
        "",
    ):
        assert words.ids(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_every_latin_character_alone_and_in_words():
    words, tokenizer = packing.WordIds(PATH), Tokenizer.from_file(PATH)
    for c in map(chr, range(9, 256)):
        for text in (c, f"a{c}b", f"a {c}{c} B{c}", f"1{c}2"):
            assert words.ids(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_place_makes_the_sum_of_squares_smallest():
    rnd = np.random.default_rng(3)
    for fresh in (True, False):
        bins, gaps = packing.Bins(50, fresh), []
        opened = 0
        for length in sorted(rnd.integers(1, 51, 400).tolist(), reverse=True):
            before = np.bincount(gaps, minlength=51)
            fits = sorted({g for g in gaps if g >= length})
            _, offset = bins.place(length)
            gap = 50 - offset

            def squares(g):
                """After the piece goes to a sequence of this gap, or to a new one."""
                after = before.copy()
                after[g] -= g < 50
                after[g - length] += 1
                return int((after[1:50] ** 2).sum())

            options = fits + [50] * (fresh or not fits)
            assert squares(gap) == min(map(squares, options)), (length, gap, fits)
            if offset:
                gaps.remove(gap)
            else:
                opened += bool(fits)
            if gap > length:
                gaps.append(gap - length)
        assert (opened > 0) == fresh


def test_places_fill_what_the_first_pass_leaves_open():
    rnd = np.random.default_rng(4)
    for _ in range(20):
        lengths = sorted(rnd.integers(1, 200, 800).tolist(), reverse=True)
        found = packing.places(lengths, 200)
        inside = defaultdict(list)
        for length, (number, at) in zip(lengths, found, strict=True):
            inside[number].append((at, length))
        for parts in inside.values():
            end = 0
            for at, length in sorted(parts):
                assert at == end
                end += length
            assert end <= 200
        alone = packing.Bins(200)
        for x in lengths:
            alone.place(x)
        assert len(inside) <= alone.made and len(inside) <= 1.05 * sum(lengths) / 200 + 1
    assert packing.places([], 200) == []


def test_names_that_clash(spark):
    parts = spark.createDataFrame([(1, 0, 30, "mine", 7)], "doc_id long, piece int, length long, sequence_id string, Offset int")
    out = packing.pack(parts, 50)
    assert out.columns == ["doc_id", "piece", "length", "sequence_id_before", "offset_before", "sequence_id", "offset"]
    assert [(r.sequence_id_before, r.offset_before, r.offset) for r in out.collect()] == [("mine", 7, 0)]
