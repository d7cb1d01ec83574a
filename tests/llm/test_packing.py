"""Packing: an exact round trip, every capacity, defined results for odd input."""

import os
import random
import zlib

import numpy as np
import pytest

from devident.llm.packing import REMEMBERED, Capacity, best_fit, pack, pieces, token_bytes, word_ids
from devident.llm.queries.packing import CAPACITY, END_ID, SEQUENCE, query, tokenizer_path

SF_DIR = "/root/testdata/sf0.001"


def check(packed, capacity):
    by = {}
    for r in packed:
        by.setdefault(r.sequence_id, []).append(r)
    for members in by.values():
        members.sort(key=lambda r: r.offset)
        at = 0
        for r in members:
            assert r.offset == at
            at += r.length
        assert at <= capacity.tokens and len(members) <= capacity.documents
        assert sum(r.length**2 for r in members) <= capacity.attention
    return by


def ids_of(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path()).encode(text or "", add_special_tokens=False).ids + [END_ID]


def test_query_packs_every_id_once(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    packed = query(spark, SF_DIR).collect()
    by = check(packed, CAPACITY)
    got = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in packed}
    want = {}
    for doc_id, text in texts.items():
        ids = ids_of(text)
        for piece, start in enumerate(range(0, len(ids), SEQUENCE)):
            part = np.array(ids[start : start + SEQUENCE], dtype="<u4")
            want[doc_id, piece] = (start, len(part), zlib.crc32(part.tobytes()))
    assert got == want and len(packed) == len(want)
    assert len(by) <= 1 + -(-sum(v[1] for v in want.values()) // SEQUENCE)


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_every_capacity_binds(score):
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 100, 500)
    capacity = Capacity(100, 4, 6000, score=score)
    lengths = lengths[lengths**2 <= 6000]
    bins, offsets = best_fit(lengths, capacity)
    for b in range(bins.max() + 1):
        own = bins == b
        assert lengths[own].sum() <= 100 and own.sum() <= 4 and (lengths[own] ** 2).sum() <= 6000
        assert sorted(offsets[own]) == [0, *np.cumsum(lengths[own][np.argsort(offsets[own])])[:-1]]


def test_a_piece_that_fits_no_bin_is_refused():
    with pytest.raises(ValueError):
        best_fit(np.array([10]), Capacity(100, 4, 50))


def test_odd_input(spark, rows):
    data = [(1, None), (1, ""), (None, "a b"), (2, "Σας ΣΑΣ é é <|endoftext|> it's x\x00y"), (3, "word " * 500)]
    frame = rows("doc_id long, text string", data).selectExpr("*", "1 AS piece", "'x' AS length", "2 AS deal")
    packed = pack(pieces(frame, tokenizer_path(), 64, END_ID), Capacity(64, 64, 64 * 64), group_pieces=4).collect()
    check(packed, Capacity(64, 64, 64 * 64))
    total = {}
    for r in packed:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == {1: 2, None: 3, 2: len(ids_of(data[3][1])), 3: 501}
    assert pack(pieces(rows("doc_id long, text string", []), tokenizer_path(), 64, END_ID), CAPACITY).count() == 0


def test_ids_like_the_tokenizer():
    """Words of every kind, met again after they were forgotten, in small and large batches."""
    from tokenizers import Tokenizer

    rng = random.Random(11)
    whole = Tokenizer.from_file(tokenizer_path())
    bits = ["the", "The", "thaned", "Über", "naïve", "don't", "DON'T", "'S", "''", "_a_1", "12a", "--", "...", "x", "é", "×", "÷", "é", "ﬁ", "½",
            "日本語", "𝒳", "😀👍🏽", "Σίσυφος", "ΟΔΟΣ", "İstanbul", "a\u0085b", "\x1c\x1d", "<|endoftext|>", "a<|startoftext|>b", "<|ENDOFTEXT|>", "�", "a" * 60,
            "ontiontion" * 30, "Ab" * 200, "‍́", "ÿß", "#$%&"]
    texts = [" ".join("".join(rng.choices(bits, k=rng.randint(1, 3))) for _ in range(rng.randint(0, 40))).encode() for _ in range(300)]
    texts += [None, b"", b" \n\t ", b"\n".join(b.encode() for b in bits), b"\xff\xfe broken \xc3"]
    known = word_ids(tokenizer_path())
    for limit in (REMEMBERED, 2000):
        known.limit = limit
        for start in range(0, len(texts), 50):
            part = texts[start : start + 50]
            for text, ids in zip(part, token_bytes(known, part), strict=True):
                expected = whole.encode((text or b"").decode("utf-8", "replace"), add_special_tokens=False).ids
                assert np.frombuffer(ids, dtype="<u4").tolist() == expected, text


def test_other_tokenizers_encode_whole_words():
    from tokenizers import Tokenizer

    path = os.path.join(os.path.dirname(tokenizer_path()), "byte_bpe_50k.json")
    known = word_ids(path)
    expected = [i for w in ("Hello", "wörld", "don't") for i in Tokenizer.from_file(path).encode(w, add_special_tokens=False).ids]
    assert np.frombuffer(next(iter(token_bytes(known, ["Hello wörld don't".encode()]))), dtype="<u4").tolist() == expected


def test_a_long_text_without_white_space(rows):
    text = "añb" * 330_000
    frame = rows("doc_id long, text string", [(1, text), (2, "z" * 1_000_000)])
    got = pieces(frame, tokenizer_path(), 4096, END_ID).collect()
    ids = np.array(ids_of(text), dtype="<u4")
    own = sorted((r for r in got if r.doc_id == 1), key=lambda r: r.piece)
    assert sum(r.length for r in own) == len(ids) and own[0].ids_crc32 == zlib.crc32(ids[:4096].tobytes())
    assert [r.start for r in own] == list(range(0, len(ids), 4096)) and own[-1].ids_crc32 == zlib.crc32(ids[own[-1].start :].tobytes())


def test_parts_are_written_as_by_the_alphabet():
    """All parts at once as one by one; the words asked for, which are keys of what is remembered, stay as they are."""
    from devident.llm.packing import _rewritten, _splitter
    from tokenizers import Tokenizer

    _, written = _splitter(Tokenizer.from_file(tokenizer_path()))
    parts = ["plain", "\n", "café", "ÿßà", "naïve-", "é", "è" * 3]
    before = list(parts)
    assert written and _rewritten(parts, written) == [p.translate(str.maketrans(written)) for p in before]
    assert parts == before and _rewritten(["a", "\n"], written) == ["a", "\n"] and _rewritten([], written) == []


def test_remembered_words_are_worked_out_once():
    """Words of the older generation move to the younger one and aren't made again."""
    from devident.llm.text import Recent

    asked = []
    known = Recent(lambda words: asked.extend(words) or [w * 2 for w in words], limit=300)
    for own in ([b"a", b"b", b"a"], [b"c", b"a"], [b"a", b"d", b"c"], [b"a", b"e"]):
        assert list(known.of(own)) == [w * 2 for w in own]
    assert sorted(asked) == [b"a", b"b", b"c", b"d", b"e"]


def test_the_texts_of_a_batch_are_worked_on_together():
    """A word that a batch repeats is looked for among those remembered once per group of texts."""
    from devident.llm import packing

    class Known:
        calls = 0

        def words(self, text):
            return text.split()

        def of(self, own):
            self.calls += 1
            return iter([w[:4] for w in own])

    known, texts = Known(), [b"word " * 50_000 + b"%04d" % n for n in range(12)]
    assert sum(map(len, texts)) > 2 << 20
    assert list(packing.token_bytes(known, texts)) == [b"word" * 50_000 + b"%04d" % n for n in range(12)]
    assert known.calls == 1
