"""Language identification: blended-spectrum presence kernels, Nyström landmarks and one-versus-rest kernel ridge regression."""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skygraph.llm.common import map_slices, mix, sample_documents, texts

ORDERS = (1, 2, 3)
DIM = 1 << 13
UNKNOWN = "und"


@dataclass
class Classifier:
    """Unit landmark vectors [dim, m] and the regression's weights [m, languages]."""

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray


_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """By code point: is it a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1))
    return _LETTERS[0]


def pieces(text: str, most: int = 200_000) -> list[str]:
    """A lower-cased text in parts whose n-grams are together those of the whole: each part but the first begins with what comes before it, from the last letter but one on."""
    out = []
    for at in range(0, max(1, len(text)), most):
        before, i = "", at - 1
        while i >= 0 and (len(before) < 2 or before[0] == " "):
            if text[i].isalpha():
                before = text[i] + before
            elif before[:1] != " ":
                before = " " + before
            i -= 1
        out.append(before + text[at : at + most])
    return out


def _marks(held: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Which hashed n-grams each lower-cased text holds, as 0 and 1; and whether it has a letter."""
    code = np.frombuffer("\x00".join(held).encode("utf-32-le", "surrogatepass") + b"\x00" * 4, dtype=np.uint32)
    # a NUL of a text's own would look like the end of it
    ends = np.cumsum([len(x) + 1 for x in held]) - 1
    is_letter = letters()[code]
    doc = np.zeros(len(code), dtype=np.int64)
    doc[ends[:-1] + 1] = 1
    doc = np.cumsum(doc)
    code = np.where(is_letter, code, 32)
    keep = is_letter | np.concatenate([[False], is_letter[:-1]])
    keep[ends] = False
    code, doc = code[keep].astype(np.uint64), doc[keep]
    out = np.zeros((len(held), DIM), dtype=np.float32)
    for n in ORDERS:
        gram = code.copy() if n == 1 else code[: len(code) - n + 1].copy()
        for k in range(1, n):
            gram = gram * np.uint64(1_114_112) + code[k : len(code) - n + 1 + k]
        whole = doc[: len(gram)] == doc[n - 1 : n - 1 + len(gram)]
        out[doc[: len(gram)][whole], (mix(gram + np.uint64(n << 60))[whole] % np.uint64(DIM)).astype(np.int64)] = 1
    return out, np.bincount(doc, weights=letters()[code.astype(np.int64)], minlength=len(held)) > 0


def presence(held: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Which hashed n-grams of letters (n = 1, 2, 3) each text holds, as unit vectors; and whether it has a letter.

    Other characters become one space; n-grams don't cross texts. Long texts are worked on part by part.
    """
    out, known = np.zeros((len(held), DIM), dtype=np.float32), np.zeros(len(held), dtype=bool)
    parts = ((i, p) for i, x in enumerate(held) for p in pieces(x.lower()))
    todo: list[tuple[int, str]] = []

    def done():
        got, any_letter = _marks([p for _, p in todo])
        owner = np.array([i for i, _ in todo])
        for i, row in zip(owner.tolist(), got):
            np.maximum(out[i], row, out=out[i])
        known[owner[any_letter]] = True
        todo.clear()

    size = 0
    for i, p in parts:
        if todo and size + len(p) > 1_000_000:
            done()
            size = 0
        todo.append((i, p))
        size += len(p)
    if todo:
        done()
    out /= np.sqrt(np.maximum(out.sum(axis=1, keepdims=True), 1))
    return out, known


def fit(held: list[str], language: list[str], *, landmarks: int = 160, ridge: float = 1e-2) -> Classifier:
    """Landmarks are spread over the languages; rows keep the order in which they come."""
    names = sorted(set(language))
    each = max(1, landmarks // max(1, len(names)))
    chosen, taken = [], dict.fromkeys(names, 0)
    for i, x in enumerate(language):
        if taken[x] < each:
            taken[x] += 1
            chosen.append(i)
    if not chosen:
        return Classifier([], np.zeros((DIM, 0), np.float32), np.zeros((0, 0), np.float32))
    marks = presence([held[i] for i in chosen])[0]
    value, vector = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = value > 1e-6 * value[-1]
    root = vector[:, good] / np.sqrt(value[good])
    gram, target = np.zeros((good.sum() + 1,) * 2), np.zeros((good.sum() + 1, len(names)))
    for at in range(0, len(held), 256):
        phi = presence(held[at : at + 256])[0] @ marks.T @ root
        phi = np.hstack([phi, np.ones((len(phi), 1))])
        y = np.array([[1.0 if x == name else -1.0 for name in names] for x in language[at : at + 256]])
        gram += phi.T @ phi
        target += phi.T @ y
    beta = np.linalg.solve(gram + ridge * np.eye(len(gram)), target)
    return Classifier(names, np.ascontiguousarray(marks.T), np.vstack([root @ beta[:-1], beta[-1:]]).astype(np.float32))


def learn(docs: DataFrame, usable: Column | None = None, *, most: int = 2400, most_bytes: int = 32_768, most_languages: int = 500, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Classifier:
    """Fit on a bounded sample: about ``most`` labelled whole texts of at most ``most_bytes``, evenly over the languages.

    The ``most_languages`` languages with the most texts are learned. Null languages and texts are passed over. One scan
    counts the languages, one takes the sample.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).dropna()
    if usable is not None:
        rows = rows.where(usable)
    count = {r.lang: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()}
    if not count:
        return fit([], [])
    each = max(1, most // len(count))
    part = F.create_map(*[x for name, n in count.items() for x in (F.lit(name), F.lit(min(1.0, 1.3 * each / n + 30 / n)))])
    thin = rows.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(11)), F.lit(1_000_000)) < part[F.col("lang")] * 1_000_000)
    got = sample_documents(thin, 2 * most + 60 * len(count), F.col("doc_id"), most_bytes).collect()
    return fit([r.text for r in got], [r.lang for r in got])


def predict(docs: DataFrame, model: Classifier, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, lang_pred, score (0 to 1).

    Null texts and texts without a letter are ``und`` with score 0, as are all if nothing was learned. Whole texts
    of any length count; ties go to the first language by name; repeated rows and null keys each keep their row;
    other columns are ignored; an empty table gives an empty one.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def apply(batch):
            x, known = presence(texts(batch))
            if m.languages:
                f = (x @ m.landmarks) @ m.weights[:-1] + m.weights[-1]
                best = f.argmax(axis=1)
                top = np.clip((f[np.arange(len(f)), best] + 1) / 2, 0, 1).astype(float)
                names = [m.languages[i] if k else UNKNOWN for i, k in zip(best.tolist(), known.tolist())]
            else:
                names, top = [UNKNOWN] * len(x), np.zeros(len(x))
            return {"doc_id": batch.column("doc_id"), "lang_pred": names, "score": np.where(known, top, 0.0)}

        return apply

    return map_slices(rows, make, "doc_id bigint, lang_pred string, score double", most_rows=256, most_bytes=1_000_000)
