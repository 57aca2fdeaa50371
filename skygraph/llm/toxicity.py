"""Toxicity: a linear-chain conditional random field tags toxic spans; its marginals give document scores and offsets.

Labels mark whole documents. Tokens are labelled from them: in a toxic document a token is toxic if one of
its features (the word or a prefix of it) stands in toxic documents far oftener than in others; all other tokens
are clean. The field is fitted to these labelled tokens, and scores texts by forward-backward alone.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from skygraph.llm.common import WordIds, bounded_batches, gram_ids, map_slices, sample_documents, texts, words_of

#: Tokens of a chain that the field is fitted on, and of a block that texts are scored in; the latter doesn't show in scores.
CHAIN = 64
PREFIXES = (3, 4, 5, 6)
#: The log odds that a padded place is toxic.
PAD = -20.0


@dataclass
class Field:
    """Weights by feature, the bias, log potentials of transitions (from, to), and the marginal a span takes."""

    weights: dict[int, float]
    bias: float
    transitions: np.ndarray
    at_least: float = 0.5


def features(word: bytes) -> list[int]:
    """Keys of a word: the word itself, and its prefixes in bytes."""
    return [zlib.crc32(word), *(n << 32 | zlib.crc32(word[:n]) for n in PREFIXES if len(word) > n)]


class Vocabulary:
    """Documents as arrays of word numbers, and by word its features' numbers (0: none; the last row pads).

    Documents are read one at a time and only their numbers kept; copies of earlier ones are left out, as they would
    pass for evidence. So are features of fewer than ``least_docs`` documents.
    """

    def __init__(self, groups: list[Iterable[list[bytes]]], least_docs: int = 3):
        number: dict[bytes, int] = {}
        self.rows: list[list[np.ndarray]] = []
        for docs in groups:
            copies = Copies()
            self.rows.append([np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int32, count=len(words)) for words in docs if not copies.seen(words)])
        self.size = len(number)
        keys = np.zeros((self.size + 1, len(PREFIXES) + 1), dtype=np.int64)
        for w, i in number.items():
            f = features(w)
            keys[i, : len(f)] = f
        del number
        self.keys, found = np.unique(keys, return_inverse=True)
        found = found.reshape(keys.shape).astype(np.int32)
        self.df = np.zeros((len(groups), len(self.keys)))
        for g, docs in enumerate(self.rows):
            for x in docs:
                self.df[g, np.unique(found[np.unique(x)])] += 1
        keep = (self.df.sum(axis=0) >= least_docs) & (self.keys != 0)
        self.features = np.where(keep, np.cumsum(keep), 0).astype(np.int32)[found]
        self.keys, self.df = np.concatenate([[0], self.keys[keep]]), np.hstack([np.zeros((len(groups), 1)), self.df[:, keep]])


class Copies:
    """Tells documents of which half of the k smallest 5-word hashes stand among those of earlier ones."""

    def __init__(self, k: int = 8):
        self.k, self.ids, self.held = k, WordIds(), set()

    def seen(self, words: list[bytes]) -> bool:
        sketch = np.unique(gram_ids(self.ids.array(words), min(5, max(1, len(words)))))[: self.k].tolist()
        copy = bool(sketch) and 2 * sum(x in self.held for x in sketch) >= len(sketch)
        self.held.update(sketch)
        return copy


def marks(df: np.ndarray, documents: list[int], least_log_odds: float = 3.0, least_evidence: float = 14.0) -> np.ndarray:
    """By feature: does it stand in toxic documents far oftener than in clean ones, beyond chance (log likelihood ratio)."""
    a, b = df
    q = documents[0] / max(1, sum(documents))
    with np.errstate(divide="ignore", invalid="ignore"):
        evidence = np.where(a > 0, a * np.log(a / ((a + b) * q)), 0) + np.where(b > 0, b * np.log(b / ((a + b) * (1 - q))), 0)
    return (evidence >= least_evidence) & ((a + 0.5) / (documents[0] + 1) >= np.exp(least_log_odds) * (b + 0.5) / (documents[1] + 1))


def ratios(margin: np.ndarray, transitions: np.ndarray, before: np.ndarray | float = 1e-9, after: np.ndarray | float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward odds of the toxic state; margin: [place, chain] log odds of each token by itself.

    ``before``: the odds of the state before each chain (the clean one where it begins a text); ``after``: the backward odds at its end.
    """
    t, e = np.exp(transitions), np.exp(np.clip(margin, -30, 30))
    ahead, behind = np.empty_like(e), np.empty_like(e)
    r = np.broadcast_to(np.asarray(before, dtype=float), e.shape[1:])
    for i in range(len(e)):
        r = e[i] * (t[0, 1] + r * t[1, 1]) / (t[0, 0] + r * t[1, 0])
        ahead[i] = r
    b = behind[-1] = np.broadcast_to(np.asarray(after, dtype=float), e.shape[1:])
    for i in range(len(e) - 1, 0, -1):
        x = e[i] * b
        b = (t[1, 0] + t[1, 1] * x) / (t[0, 0] + t[0, 1] * x)
        behind[i - 1] = b
    return ahead, behind


def marginals(margin: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Probability of the toxic state at each place."""
    ahead, behind = ratios(margin, transitions)
    odds = ahead * behind
    return odds / (1 + odds)


def _steps(margin: np.ndarray, real: np.ndarray, transitions: np.ndarray, backward: bool) -> np.ndarray:
    """[2, 2, block]: what all the tokens of a block do to the odds (numerator, denominator) that enter it; padding does nothing."""
    t, e = np.exp(transitions), np.exp(np.clip(margin, -30, 30))
    m = np.broadcast_to(np.eye(2)[:, :, None], (2, 2, margin.shape[1])).copy()
    for i in reversed(range(len(e))) if backward else range(len(e)):
        up, low = m
        if backward:
            x = e[i] * up
            new = np.stack([t[1, 0] * low + t[1, 1] * x, t[0, 0] * low + t[0, 1] * x])
        else:
            new = np.stack([e[i] * (t[0, 1] * low + t[1, 1] * up), t[0, 0] * low + t[1, 0] * up])
        m = np.where(real[i], new / new.sum(axis=(0, 1)), m)
    return m


def document_marginals(flat: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Probability of the toxic state at each token of texts of the given lengths, one chain a text, whatever its length.

    Chains are cut into blocks that are worked on side by side. A block's tokens act on the odds that enter it as one
    2 x 2 matrix, so the odds at the blocks' borders come from these; within the blocks the same recursion follows from there. The
    cut doesn't show in the result.
    """
    if not len(flat):
        return np.zeros(0)
    per = -(-lengths // CHAIN)
    first = np.cumsum(per) - per
    doc = np.repeat(np.arange(len(lengths)), lengths)
    within = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    row, block = within % CHAIN, first[doc] + within // CHAIN
    margin, real = np.zeros((CHAIN, int(per.sum()))), np.zeros((CHAIN, int(per.sum())), dtype=bool)
    margin[row, block], real[row, block] = flat, True
    before, after = np.full(margin.shape[1], 1e-9), np.ones(margin.shape[1])
    if per.max() > 1:
        ahead, back = _steps(margin, real, transitions, False), _steps(margin, real, transitions, True)
        order = np.argsort(-per, kind="stable")
        for j in range(int(per.max()) - 1):
            long = order[: np.count_nonzero(per > j + 1)]
            at = first[long] + j
            before[at + 1] = (ahead[0, 0, at] * before[at] + ahead[0, 1, at]) / (ahead[1, 0, at] * before[at] + ahead[1, 1, at])
            at = first[long] + per[long] - 1 - j
            after[at - 1] = (back[0, 0, at] * after[at] + back[0, 1, at]) / (back[1, 0, at] * after[at] + back[1, 1, at])
    # in a text's last block the backward odds start from its last token: the tokens of padding are passed over
    t, e = np.exp(transitions), np.exp(np.clip(margin, -30, 30))
    odds, r = np.empty_like(e), before
    for i in range(CHAIN):
        r = e[i] * (t[0, 1] + r * t[1, 1]) / (t[0, 0] + r * t[1, 0])
        odds[i] = r
    b = after
    for i in range(CHAIN - 1, -1, -1):
        odds[i] *= b
        x = e[i] * b
        b = np.where(real[i], (t[1, 0] + t[1, 1] * x) / (t[0, 0] + t[0, 1] * x), b)
    odds = odds[row, block]
    return odds / (1 + odds)


def fit(toxic: Iterable[list[bytes]], clean: Iterable[list[bytes]], *, epochs: int = 8, rate: float = 0.4, decay: float = 1e-5, most_chains: int = 24_000, seed: int = 7) -> Field:
    """Maximise the labelled chains' log likelihood by Adagrad over batches of chains."""
    words = Vocabulary([toxic, clean])
    buckets, pad, rows = words.features, words.size, words.rows
    marked = marks(words.df, [len(x) for x in rows])[buckets].any(axis=1)
    rng = np.random.default_rng(seed)
    numbers, gold = [], []
    for label, docs in ((1, rows[0]), (0, rows[1])):
        for x in docs:
            full = np.full(-(-len(x) // CHAIN) * CHAIN, pad, dtype=np.int32)
            full[: len(x)] = x
            numbers.append(full.reshape(-1, CHAIN))
            gold.append(marked[numbers[-1]] & bool(label))
    numbers, gold = (np.concatenate(x) if x else np.zeros((0, CHAIN), dtype=np.int32) for x in (numbers, gold))
    hit = gold.any(axis=1)
    keep = np.concatenate([rng.permutation(np.flatnonzero(x))[:n] for x, n in ((hit, most_chains // 4), (~hit, most_chains * 3 // 4))])
    n = len(words.keys)  # the bias has number 0
    w, t = np.zeros(n), np.zeros((2, 2))
    w[0] = -6.0
    gw, gt = np.full(n, 1e-6), np.full((2, 2), 1e-2)
    size = 256
    for _ in range(epochs):
        order = rng.permutation(keep)
        for at in range(0, len(order), size):
            part = order[at : at + size]
            ids, y = buckets[numbers[part].T], gold[part].T.astype(float)
            real = (numbers[part] != pad).T.astype(float)
            margin = np.where(real > 0, w[0] + (w[ids] * (ids != 0)).sum(axis=2), PAD)
            ahead, behind = ratios(margin, t)
            odds = ahead * behind
            p = odds / (1 + odds)
            slope = (p - y) * real / len(part)
            g = np.bincount(ids.ravel(), weights=np.repeat(slope.ravel(), ids.shape[2]), minlength=n) + decay * w
            g[0] = slope.sum()
            # expected and observed transitions between neighbours
            e, x = np.exp(t), np.exp(np.clip(margin[1:], -30, 30)) * behind[1:]
            pair = np.stack([np.full_like(x, e[0, 0]), e[0, 1] * x, ahead[:-1] * e[1, 0], ahead[:-1] * e[1, 1] * x])
            pair /= pair.sum(axis=0)
            seen = np.stack([(1 - y[:-1]) * (1 - y[1:]), (1 - y[:-1]) * y[1:], y[:-1] * (1 - y[1:]), y[:-1] * y[1:]])
            d = ((pair - seen) * real[1:]).sum(axis=(1, 2)).reshape(2, 2) / len(part)
            gw += g * g
            gt += d * d
            w -= rate * g / np.sqrt(gw)
            t -= 0.1 * d / np.sqrt(gt)
    return Field({int(k): float(x) for k, x in zip(words.keys[1:], w[1:]) if abs(x) > 1e-3}, float(w[0]), t)


def learn(docs: DataFrame, labels: DataFrame, usable: Column | None = None, *, most_toxic: int = 1500, most_clean: int = 5000, most_bytes: int = 32_768, most_chains: int = 24_000, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Field:
    """Fit on a bounded sample of labelled rows: at most ``most_toxic`` + ``most_clean`` whole texts of at most ``most_bytes``.

    Features are marked over all their words; weights are fitted on at most ``most_chains`` chains of 64 words, drawn at
    random: a quarter with marked words, three quarters without.

    ``usable`` (on the key) says which rows may be learned from. Null labels and texts are passed over, a key
    labelled twice counts as toxic if one of its labels is. Without toxic rows nothing is ever toxic.
    """
    bounded_batches(docs.sparkSession)
    told = labels.select(F.col(key).cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("toxic")).dropna()
    if usable is not None:
        told = told.where(usable)
    told = told.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.col("doc_id").cast("string"))
    # twice as many keys as rows wanted, as some have no text or one too long
    picked = [told.where(F.col("toxic") == x).orderBy(order, "doc_id").limit(2 * n) for x, n in ((1, most_toxic), (0, most_clean))]
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = rows.join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")  # at most 2 * (most_toxic + most_clean) keys
    held = [(words_of(r.text) for r in sample_documents(found.where(F.col("toxic") == x), n, F.col("doc_id"), most_bytes).select("text").toLocalIterator()) for x, n in ((1, most_toxic), (0, most_clean))]
    return fit(*held, most_chains=most_chains)


def tag(rows: DataFrame, field: Field, *, text: str = "text", score: str = "score", spans: str = "spans") -> DataFrame:
    """The rows as they are, with ``score`` (0 to 1) and ``spans`` added in the same pass: no key is needed and nothing is shuffled."""
    shared = rows.sparkSession.sparkContext.broadcast(field)
    names = rows.columns
    schema = StructType([*rows.schema.fields, StructField(score, DoubleType()), StructField(spans, ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("marginal", DoubleType())])))])

    def make():
        f = shared.value
        weight, t = f.weights, f.transitions

        class Margins(dict):
            def __missing__(self, word):
                if len(self) > 150_000:
                    self.clear()
                value = self[word] = f.bias + sum(weight.get(x, 0.0) for x in features(word))
                return value

        memo = Margins()

        def apply(batch):
            own = texts(batch, text)
            held = [words_of(x) for x in own]
            flat = np.fromiter((memo[x] for words in held for x in words), dtype=np.float64)
            n = np.array([len(x) for x in held], dtype=np.int64)
            p = document_marginals(flat, n, t)
            doc = np.repeat(np.arange(len(n)), n)
            total = np.zeros(len(n))
            np.maximum.at(total, doc, p)
            sure = p >= f.at_least
            total = np.maximum(total, 1 - np.exp(np.bincount(doc[sure], weights=np.log1p(-np.minimum(p[sure], 1 - 1e-9)), minlength=len(n))))
            found, starts = [[] for _ in own], np.cumsum(n) - n
            for i in np.unique(doc[sure]).tolist():
                found[i] = offsets(own[i], p[starts[i] : starts[i] + n[i]], f.at_least)
            return {c: batch.column(c) for c in names} | {score: total, spans: found}

        return apply

    return map_slices(rows, make, schema, text)


def score(docs: DataFrame, field: Field, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, score (0 to 1), spans (start and end character, marginal) of tokens whose marginal is at least ``field.at_least``.

    The score is the chance that one of the offending tokens is toxic, or else the largest marginal.
    Null and empty texts score 0 and have no spans; whole texts of any length are tagged, each as one chain;
    repeated rows and null keys each keep their row; other columns are ignored; an empty table gives an empty one.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return tag(rows, field).drop("text")


TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def offsets(text: str, p: np.ndarray, at_least: float) -> list[dict]:
    """Character offsets of the runs of toxic tokens, with their largest marginal."""
    # lower-casing may lengthen a text: tokens are found in the text with A-Z made lower, which keeps places
    tokens = [m.span() for m in TOKEN.finditer(re.sub("[A-Z]", "a", text))]
    out: list[dict] = []
    last = -2
    for i in np.flatnonzero(p[: len(tokens)] >= at_least).tolist():
        if i == last + 1:
            out[-1] |= {"end": tokens[i][1], "marginal": max(out[-1]["marginal"], float(p[i]))}
        else:
            out.append({"start": tokens[i][0], "end": tokens[i][1], "marginal": float(p[i])})
        last = i
    return out
