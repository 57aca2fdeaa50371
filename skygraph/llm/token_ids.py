"""Token ids of whole texts by ``tokenizers``: texts are cut where no token can cross, and each distinct part of a batch is encoded once."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa

# Classes of characters, held by each of their bytes.
OTHER, SPACE, LATIN, MARK, ODD = range(5)
#: Digits and the marks that neither contractions nor special tokens hold.
MARKS = b'0123456789.,;:!?()"*-'
#: White space, and characters next to which nothing is cut: libraries differ in which of them are white space.
SPACES, ODD_SPACES = b" \n\t\r", b"\x0b\x0c\x1c\x1d\x1e\x1f"


def _classes() -> np.ndarray:
    of = np.zeros(256, dtype=np.uint8)
    for kind, chars in ((SPACE, SPACES), (ODD, ODD_SPACES), (MARK, MARKS)):
        of[list(chars)] = kind
    of[ord("A") : ord("Z") + 1] = of[ord("a") : ord("z") + 1] = LATIN
    return of


def _cuts() -> np.ndarray:
    """Whether a cut stands between two characters, by class of the first times 5 and of the second."""
    cut = np.zeros((5, 5), dtype=bool)
    cut[[OTHER, LATIN, MARK], SPACE] = True
    cut[LATIN, MARK] = cut[MARK, LATIN] = True
    return cut.ravel()


CLASS_OF, CUT = _classes(), _cuts()


def classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte of UTF-8. Letters of U+00C0 to U+024F are Latin but for two signs and the dotted capital I, which is two characters in lower case."""
    out = CLASS_OF[data]
    wide = np.flatnonzero(data >= 0xC2)
    if wide.size:
        lead = data[wide]
        two = wide[(lead >= 0xC3) & (lead <= 0xC9)]
        # a character may be cut off at the end of a window, which nobody looks at
        two = two[two + 1 < len(data)]
        first, second = data[two], data[two + 1]
        sign = ((first == 0xC3) & ((second == 0x97) | (second == 0xB7))) | ((first == 0xC4) & (second == 0xB0)) | ((first == 0xC9) & (second > 0x8F))
        two = two[~sign]
        out[two] = out[two + 1] = LATIN
        # among those of U+0080 to U+00BF and of U+1000 to U+3FFF are all other white space
        for low, high, size in ((0xC2, 0xC2, 2), (0xE1, 0xE3, 3)):
            at = wide[(lead >= low) & (lead <= high)]
            for k in range(size):
                out[at[at + k < len(data)] + k] = ODD
    return out


def cuts(data: np.ndarray, window: int = 4 << 20) -> np.ndarray:
    """Places before which a text may be cut, so that the ids of the parts, one after the other, are the text's.

    Both byte-level and lower-casing word vocabularies first split texts into words by letters, digits, marks and white space, and no
    token crosses two words. Cuts lie before white space that follows something else, and between Latin letters and marks or
    digits; never at an apostrophe (contractions), within the strings of special tokens or next to odd white space.
    """
    out = []
    for at in range(0, len(data), window):
        low = max(0, at - 8)
        of = classes(data[low : at + window + 8])
        found = np.flatnonzero(CUT[of[:-1] * 5 + of[1:]]) + 1 + low
        out.append(found[(found >= at) & (found < at + window)])
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


#: A space and Latin letters (one character each in lower case, whole in composed form): a word of its own wherever it stands before another such part or the end.
WORD = re.compile(rb" (?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|[\xc5-\xc8][\x80-\xbf])+")


class Encoder:
    """Texts to the ids that ``tokenizers`` gives for them, as little-endian 32-bit unsigned bytes; no special token is added.

    The parts of a batch are told apart by Arrow, and only distinct ones are looked up. The ids of up to ``most`` parts are kept, those met
    first, which are the common ones; others are encoded anew for each batch. New parts are encoded many at a time: words as one text of
    words, whose ids are told apart by what the vocabulary says of each token (the bytes it stands for, or that it ends a word), other parts as one
    text with a special token between, which the library cuts out before anything else, at nearly twice the time.
    """

    def __init__(self, path: str, most: int = 300_000, parts: int = 200_000, joined: int = 4_000):
        # a task has one core: the library's threads would cost memory alone
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # the library's own cache serves texts that repeat words, which reach it once here
        self.tokenizer.model._resize_cache(0)
        self.most, self.parts, self.joined = most, parts, joined
        special = self.tokenizer.get_added_tokens_decoder()
        self.stop, token = next(((i, t) for i, t in special.items() if t.special and not (t.lstrip or t.rstrip or t.single_word)), (None, None))
        self.mark = token.content if token else None
        self.kept: dict[bytes, bytes] = {}
        self.sizes = self.ends = None
        before, suffix = self.tokenizer.pre_tokenizer, getattr(self.tokenizer.model, "end_of_word_suffix", None)
        plain = type(before).__name__ == "ByteLevel" and getattr(before, "use_regex", False) and not before.add_prefix_space and self.tokenizer.normalizer is None
        if suffix or plain:
            vocab = self.tokenizer.get_vocab()
            at = np.fromiter(vocab.values(), dtype=np.int64, count=len(vocab))
            of = np.zeros(int(at.max()) + 1, dtype=np.int32)
            # a character of a byte-level token is a byte
            of[at] = [x.endswith(suffix) for x in vocab] if suffix else [*map(len, vocab)]
            if suffix:
                self.ends = of.astype(bool)
            else:
                self.sizes = of

    def _words(self, words: list[bytes]) -> list[bytes] | None:
        """The ids of parts that are a ``WORD`` each, encoded as one text; None where they can't be told apart."""
        data = self._whole([b"".join(words).decode()])[0]
        ids = np.frombuffer(data, dtype="<u4")
        if self.ends is not None:
            upto = np.flatnonzero(self.ends[ids]) + 1
            fine = len(upto) == len(words) and upto[-1] == len(ids)
        else:
            ends, wanted = np.cumsum(self.sizes[ids]), np.cumsum([*map(len, words)])
            at = np.minimum(np.searchsorted(ends, wanted), len(ends) - 1)
            upto, fine = at + 1, bool((ends[at] == wanted).all() and ends[-1] == wanted[-1])
        if not fine:
            return None
        upto = (upto * 4).tolist()
        return [data[a:b] for a, b in zip([0, *upto], upto)]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _new(self, new: list[bytes]) -> Iterable[tuple[bytes, bytes]]:
        if not self.mark:
            return zip(new, self._whole([x.decode() for x in new]))
        told = []
        if self.sizes is not None or self.ends is not None:
            words, rest = [], []
            for x in new:
                # plain letters after a space, as nearly all are, need no expression
                (words if (x[:1] == b" " and x[1:].isalpha()) or WORD.fullmatch(x) else rest).append(x)
            new = rest
            for i in range(0, len(words), self.joined):
                some = words[i : i + self.joined]
                if (found := self._words(some)) is None:
                    new += some
                else:
                    told += zip(some, found)
        first = self.mark[0].encode()
        odd, plain = [x for x in new if first in x], [x for x in new if first not in x]
        told += zip(odd, self._whole([x.decode() for x in odd]))
        for i in range(0, len(plain), self.joined):
            some = plain[i : i + self.joined]
            data = self._whole([self.mark.encode().join(some).decode()])[0]
            ends = (np.flatnonzero(np.frombuffer(data, dtype="<u4") == self.stop) * 4).tolist()
            if len(ends) != len(some) - 1:
                raise ValueError("the mark between parts was not kept apart")
            told += [(x, data[a:b]) for x, a, b in zip(some, [0, *(e + 4 for e in ends)], [*ends, len(data)])]
        return told

    def _ids(self, starts: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number in each part) of parts of ``data`` that begin at ``starts``, the first at 0."""
        offsets = np.append(starts, len(data)).astype(np.int32)
        told = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        # cut from one string of bytes by their offsets: a third of the time of to_pylist
        _, offsets, held = told.dictionary.buffers()
        held, offsets = held.to_pybytes(), np.frombuffer(offsets, dtype=np.int32)[: len(told.dictionary) + 1].tolist()
        distinct = [held[a:b] for a, b in zip(offsets, offsets[1:])]
        got = [*map(self.kept.get, distinct)]
        if None in got:
            new = dict(self._new([x for x, ids in zip(distinct, got) if ids is None]))
            got = [new[x] if ids is None else ids for x, ids in zip(distinct, got)]
            if len(self.kept) < self.most:
                self.kept.update((x, ids) for x, ids in new.items() if len(x) <= 64)
        code = told.indices.to_numpy()
        size = np.fromiter(map(len, got), dtype=np.int64, count=len(got)) // 4
        begin = np.cumsum(size) - size
        ids, n = np.frombuffer(b"".join(got), dtype="<u4"), size[code]
        upto = np.cumsum(n)
        at = np.repeat(begin[code] - (upto - n), n)
        at += np.arange(len(at))
        return ids.take(at), n

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text; none for null."""
        column = (texts if isinstance(texts, pa.Array) else pa.array(texts, type=pa.string())).fill_null("").cast(pa.large_binary())
        ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        held = column.buffers()[2]
        data = np.frombuffer(held, dtype=np.uint8)[ends[0] : ends[-1]] if held is not None else np.zeros(0, dtype=np.uint8)
        ends = ends - ends[0]
        begins = np.zeros(len(data), dtype=bool)
        begins[cuts(data)] = True
        begins[ends[:-1][np.diff(ends) > 0]] = True
        starts = np.flatnonzero(begins)
        out, counts = [], []
        for i in range(0, len(starts), self.parts):
            low, high = int(starts[i]), int(starts[i + self.parts]) if i + self.parts < len(starts) else len(data)
            ids, n = self._ids(starts[i : i + self.parts] - low, data[low:high])
            out.append(ids)
            counts.append(n)
        ids = np.concatenate(out) if out else np.zeros(0, dtype="<u4")
        upto = np.append(0, np.cumsum(np.concatenate(counts))) if counts else np.zeros(1, dtype=np.int64)
        places = upto[np.searchsorted(starts, ends)].tolist()
        return [ids[a:b].tobytes() for a, b in zip(places, places[1:])]


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, most: int = 300_000) -> Encoder:
    """The encoder of a vocabulary, one a process: a worker keeps what it has learned from one task to the next. A kept part takes some 300 bytes."""
    if (path, most) not in _ENCODERS:
        _ENCODERS[path, most] = Encoder(path, most)
    return _ENCODERS[path, most]
