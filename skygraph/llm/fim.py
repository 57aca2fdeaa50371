"""Fill-in-middle: one scan of bytes by a table-driven automaton counts characters, lines and sentinels; a second pass locates the cuts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skygraph.llm.common import map_slices, texts

# Classes of bytes.
NEWLINE, OPEN, NAME, CLOSE, PLAIN, MORE, LEAD2, LEAD3, LEAD4, PAD = range(10)
N_CLASSES = 10
# States: at the start of a line, within one, after "<", after "<P", "<S" or "<M", and with one to three bytes of a character to come.
START, INSIDE, OPENED, NAMED, REST1, REST2, REST3 = range(7)
N_STATES = 7
#: What a transition counts, as parts of one number: characters, ended lines, sentinels.
CHARACTER, LINE, SENTINEL = 1, 1 << 21, 1 << 42
FIELD = (1 << 21) - 1
LANE, LANES = 256, 8192


def _classes() -> np.ndarray:
    of = np.full(256, PLAIN, dtype=np.uint8)
    of[0x80:0xC0], of[0xC0:0xE0], of[0xE0:0xF0], of[0xF0:] = MORE, LEAD2, LEAD3, LEAD4
    of[ord("\n")], of[ord("<")], of[ord(">")] = NEWLINE, OPEN, CLOSE
    of[list(b"PSM")] = NAME
    return of


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(next state, count) by state times ``N_CLASSES`` plus class."""
    to, count = np.zeros((N_STATES, N_CLASSES), dtype=np.intp), np.full((N_STATES, N_CLASSES), CHARACTER, dtype=np.int64)
    to[:, [PLAIN, CLOSE, NAME, MORE]] = INSIDE
    to[:, NEWLINE], to[:, OPEN], to[OPENED, NAME] = START, OPENED, NAMED
    to[:, LEAD2], to[:, LEAD3], to[:, LEAD4] = REST1, REST2, REST3
    to[REST2, MORE], to[REST3, MORE] = REST1, REST2
    count[:, MORE] = 0
    count[:, NEWLINE] += LINE
    count[NAMED, CLOSE] += SENTINEL
    to[:, PAD], count[:, PAD] = np.arange(N_STATES), 0
    return to.ravel(), count.ravel()


CLASS_OF = _classes()
NEXT, COUNT = _tables()


class Scan:
    """The counts of a list of texts (UTF-8), lane by lane of ``LANE`` bytes.

    Lanes are scanned side by side, each from every state that it may start in; then the lanes of a text are strung together, which tells
    the state that each did start in. A long text is many lanes, and no text is read twice but for the lanes of its cuts.
    """

    def __init__(self, data: list[bytes]):
        self.data = data
        lanes = np.array([-(-len(x) // LANE) for x in data], dtype=np.int64)
        self.first = np.append(0, np.cumsum(lanes))
        n = int(self.first[-1])
        self.start, self.counted = np.zeros(n, dtype=np.intp), np.zeros(n, dtype=np.int64)
        self.end = np.zeros(len(data), dtype=np.intp)
        text, state = 0, START
        for low in range(0, n, LANES):
            high = min(low + LANES, n)
            final, counted = self._lanes(low, high)
            for lane, to in enumerate(final.tolist(), low):
                while lane >= self.first[text + 1]:
                    self.end[text] = state if self.first[text + 1] > self.first[text] else START
                    text, state = text + 1, START
                self.start[lane] = state
                state = to[state]
            self.counted[low:high] = counted[np.arange(high - low), self.start[low:high]]
        if n:
            self.end[text] = state

    def _lanes(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        classes = np.full((high - low, LANE), PAD, dtype=np.uint8)
        flat = classes.ravel()
        texts_in = range(int(np.searchsorted(self.first, low, side="right")) - 1, int(np.searchsorted(self.first, high, side="left")))
        for i in texts_in:
            from_lane, to_lane = max(low, int(self.first[i])), min(high, int(self.first[i + 1]))
            if to_lane > from_lane:
                own = np.frombuffer(self.data[i], dtype=np.uint8)[(from_lane - self.first[i]) * LANE : (to_lane - self.first[i]) * LANE]
                flat[(from_lane - low) * LANE : (from_lane - low) * LANE + len(own)] = CLASS_OF[own]
        steps = np.ascontiguousarray(classes.T).astype(np.intp)
        state = np.tile(np.arange(N_STATES, dtype=np.intp)[:, None], (1, high - low))
        counted = np.zeros((N_STATES, high - low), dtype=np.int64)
        for c in steps:
            at = state * N_CLASSES + c
            counted += COUNT[at]
            state = NEXT[at]
        return state.T, counted.T

    def totals(self, i: int) -> tuple[int, int]:
        """(lines, sentinels) of a text; a last line without its end counts."""
        low, high = self.first[i], self.first[i + 1]
        lines = int((self.counted[low:high] >> 21 & FIELD).sum()) + (self.end[i] != START and high > low)
        return int(lines), int((self.counted[low:high] >> 42).sum())

    def cuts(self, i: int, after: list[int], n: int) -> list[tuple[int, int]]:
        """(bytes, characters) before the end of each of the given numbers of lines, of ``n`` in all."""
        low, high = self.first[i], self.first[i + 1]
        lines = np.cumsum(self.counted[low:high] >> 21 & FIELD)
        characters = np.append(0, np.cumsum(self.counted[low:high] & FIELD))
        out = []
        for k in after:
            if k == 0:
                out.append((0, 0))
            elif k == n:
                out.append((len(self.data[i]), int(characters[-1])))
            else:
                lane = int(np.searchsorted(lines, k))
                need, state, seen = (k - (int(lines[lane - 1]) if lane else 0)) * LINE, int(self.start[low + lane]), 0
                for at, c in enumerate(CLASS_OF[np.frombuffer(self.data[i], dtype=np.uint8)[lane * LANE : (lane + 1) * LANE]].tolist(), lane * LANE + 1):
                    seen += int(COUNT[state * N_CLASSES + c])
                    state = int(NEXT[state * N_CLASSES + c])
                    if seen & (FIELD << 21) == need:
                        break
                out.append((at, int(characters[lane]) + (seen & FIELD)))
        return out


def draws(key: Column, seed: int) -> list[Column]:
    """Four numbers below 2**32 from the sha256 of the seed and the key; a null key counts as empty."""
    told = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(told, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]


def transform(docs: DataFrame, *, rate: int = 100, suffix_first: int = 50, seed: int = 7, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n (lines), form (plain, psm, spm), prefix_chars, middle_chars, output.

    Cuts stand after whole lines (a line holds its newline): two of 0 ... n by draws from the key. Of a hundred texts ``rate`` are rearranged, of
    these ``suffix_first`` as spm. Null and empty texts, and texts that contain a sentinel, stay plain. Texts of any length are
    rearranged whole; repeated rows each keep their row, and rows of one key have the same draws; a null key draws as an
    empty one; other columns are ignored; an empty table gives an empty one.
    """
    h1, h2, h3, h4 = draws(F.col(key).cast("bigint"), seed)
    form = F.when(h3 % 100 >= rate, "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm")
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"), h1.alias("h1"), h2.alias("h2"), form.alias("form"))

    def make():
        def apply(batch):
            data = [x.encode("utf-8", "replace") for x in texts(batch)]
            scan = Scan(data)
            out = {"doc_id": batch.column("doc_id"), "n": [], "form": [], "prefix_chars": [], "middle_chars": [], "output": []}
            for i, (x, a, b, form) in enumerate(zip(data, *(batch.column(c).to_pylist() for c in ("h1", "h2", "form")))):
                n, sentinels = scan.totals(i)
                out["n"].append(n)
                if not x or sentinels or form == "plain":
                    for c, v in (("form", "plain"), ("prefix_chars", None), ("middle_chars", None), ("output", x)):
                        out[c].append(v)
                    continue
                (p, p_chars), (m, m_chars) = scan.cuts(i, sorted((a % (n + 1), b % (n + 1))), n)
                prefix, middle, suffix = x[:p], x[p:m], x[m:]
                out["form"].append(form)
                out["prefix_chars"].append(p_chars)
                out["middle_chars"].append(m_chars - p_chars)
                out["output"].append(b"<S>" + suffix + b"<P>" + prefix + b"<M>" + middle if form == "spm" else b"<P>" + prefix + b"<S>" + suffix + b"<M>" + middle)
            out["output"] = [x.decode("utf-8") for x in out["output"]]
            return out

        return apply

    return map_slices(rows, make, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from: a rearranged one holds each sentinel once."""
    p, s, m = (F.instr(output, x) for x in ("<P>", "<S>", "<M>"))
    middle = F.substr(output, m + 3)
    psm = F.concat(F.substr(output, F.lit(4), s - 4), middle, F.substr(output, s + 3, m - s - 3))
    spm = F.concat(F.substr(output, p + 3, m - p - 3), middle, F.substr(output, F.lit(4), p - 4))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
