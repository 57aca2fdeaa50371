"""Ids by parts against ids of whole texts, and packing of texts that are hard to encode."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

pytest.importorskip("skygraph.llm")

from skygraph.llm import packing, token_ids

VOCABULARIES = ("byte_bpe_50k.json", "word_bpe_49k.json")


@pytest.mark.parametrize("name", VOCABULARIES)
@pytest.mark.parametrize("most", (40, 250_000))
def test_parts_give_the_ids_of_whole_texts(name, most):
    path = public_tokenizers.path(name)
    whole, own = Tokenizer.from_file(path), token_ids.Encoder(path, most=most, parts=200)
    r = random.Random(6)
    letters = [chr(i) for i in range(0x250)] + list("  \n\t'") * 20 + list("abcst.,!?'\"") * 6 + ["<|endoftext|>", "<|startoftext|>", "中", "'s", "'LL", "123", "é", "́", "я", "᠎", " ", "\x85", "\x1c", "İ", "Σ", "😀", "ñ̃", "  \n"]
    texts = ["".join(r.choices(letters, k=r.randint(0, 40))) for _ in range(3000)] + ["".join(r.choices(letters, k=2000)) for _ in range(20)] + ["", " ", "\n"]
    texts += [" ".join(r.choices(["word", "don't", "rock'n'roll,", "x.y", "(a)", "12,5", "foo''s", "'tis", "A'", "'.s"], k=r.randint(1, 300))) for _ in range(100)]
    for i in range(0, len(texts), 97):
        for x, ids in zip(texts[i : i + 97], own.encode(texts[i : i + 97])):
            assert np.frombuffer(ids, dtype="<u4").tolist() == whole.encode(x, add_special_tokens=False).ids, repr(x)
    assert len(own.kept) <= most + 30_000


@pytest.mark.parametrize("text", ["start" + "\n" * 1_000_000 + "end", " " * 1_000_000 + "x", "a" * 300_000, "a " * 700_000, "ab, " * 300_000 + "\t" * 1000], ids=["newlines", "spaces", "letter", "words", "marks"])
def test_very_long_texts_are_encoded_and_packed(spark, text):
    whole = [*Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids, 1]
    got = sorted(packing.pack(spark.createDataFrame([(1, text), (2, "short")], "doc_id bigint, text string")).where("doc_id = 1").collect(), key=lambda r: r.start)
    assert sum(r.length for r in got) == len(whole) == got[0].doc_tokens
    assert all(r.ids_crc32 == zlib.crc32(np.array(whole[r.start : r.start + r.length], dtype="<u4").tobytes()) for r in got)


def test_the_fitted_plan_is_not_longer_than_greedy_packing():
    for seed, window, most in ((2, 256, 400), (5, 256, 60), (7, 512, 5000)):
        h = np.append(0, np.random.default_rng(seed).integers(0, most, window)).astype(np.int64)
        h[window] = 0
        fitted = packing.plan(h, window)
        greedy = packing._rounded(h, window, [], np.zeros(0))
        n_fitted, n_greedy = (sum(n for n, _ in x) for x in (fitted, greedy))
        # greedy packing is next to the shortest for many even histograms
        assert n_fitted < n_greedy if seed == 2 else n_fitted <= n_greedy * 1.0001
        used = np.zeros_like(h)
        for n, lengths in fitted:
            assert sum(lengths) <= window
            np.add.at(used, list(lengths), n)
        assert (used == h).all()


def test_ranks_are_gapless_in_groups_of_any_size(spark):
    assert [packing.salts(n) for n in (0, 1, 2000, 2001, 10**6, 10**10)] == [1, 1, 1, 2, 256, 100_000]
    text = ["same words here"] * 5000 + ["other words in this one"] * 10
    got = packing.pack(spark.createDataFrame([(i % 7, x) for i, x in enumerate(text)], "doc_id bigint, text string"), window=16).collect()
    assert len(got) == len(text)
    by_seq = {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(by_seq) == list(range(len(by_seq)))
    for p in map(sorted, by_seq.values()):
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:])) and sum(p[-1]) <= 16


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_new_words_are_encoded_without_marks(name, monkeypatch):
    import public_tokenizers

    from skygraph.llm import token_ids

    own = token_ids.Encoder(public_tokenizers.path(name), joined=7)
    words = [" " + "".join(chr(97 + (7 * i + j * j) % 26) for j in range(1 + i % 12)) for i in range(60)] + [" Straße", " ÉTÉ", " łódź", " Čeština", " s", " t", " LL", " ǅ"]
    words += [" " + chr(c) * k for c in range(0xC0, 0x240) if c not in (0xD7, 0xF7, 0x130) for k in (1, 2)]
    parts = list(dict.fromkeys(x.encode() for x in words))
    assert all(token_ids.WORD.fullmatch(x) for x in parts)
    want = {x: own._whole([x.decode()])[0] for x in parts}
    assert not any(token_ids.WORD.fullmatch(x.encode()) for x in ("word", " a b", " a's", " İ", " ×", " 1", "  a", " "))
    whole = []
    real = token_ids.Encoder._whole
    monkeypatch.setattr(token_ids.Encoder, "_whole", lambda self, texts: whole.extend(texts) or real(self, texts))
    assert dict(own._new(parts)) == want
    assert not any(own.mark in x for x in whole)
    # others still are
    odd = [b" a's", b"x", b" 1", b"...", " İ".encode(), own.mark.encode(), *parts[:5]]
    assert dict(own._new(odd)) == {x: real(own, [x.decode()])[0] for x in odd}
    # where ids can't be told apart, marks are used
    monkeypatch.setattr(token_ids.Encoder, "_words", lambda *_: None)
    assert dict(own._new(parts)) == want


def test_plain_words_need_no_expression(monkeypatch):
    """Words of plain letters are told by the bytes alone, and their ids are the library's."""

    class Refused:
        def fullmatch(self, x):
            assert not (x[:1] == b" " and x[1:].isalpha()), x
            return None

    monkeypatch.setattr(token_ids, "WORD", Refused())
    texts = ["one Two  three\tfour, x9 naïve Ünder ", "", " a b\n c", None, " zq" * 300 + " é"]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        library = Tokenizer.from_file(path)
        want = [np.asarray(library.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
        own = token_ids.Encoder(path, most=5, parts=7)
        assert own.encode(texts) == want and own.encode(pa.array(["cut", *texts]).slice(1)) == want
