"""Token counts: lengths only, from batches balanced by bytes, with long texts cut where no token can cross."""

from __future__ import annotations

import re

import public_tokenizers
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygraph.llm.common import map_slices, texts

#: One space between two ASCII letters, digits or marks: the model has no piece with a space after another character.
BOUNDARY = re.compile(r"(?<=[A-Za-z0-9.,;:!?]) (?=[A-Za-z0-9])")


def safe_parts(text: str, most: int) -> list[str]:
    """Cut a text into parts of about ``most`` characters whose token counts add up to the whole text's.

    A cut replaces one space; the model puts a space before each text, which stands for the one cut out.
    A text without such places stays whole.
    """
    parts, start = [], 0
    while len(text) - start > most and (m := BOUNDARY.search(text, start + most)):
        parts.append(text[start : m.start()])
        start = m.end()
    parts.append(text[start:])
    return parts


def count_tokens(docs: DataFrame, model: str | None = None, *, limit: int = 4096, part_chars: int = 20_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    ``model``: path of a sentencepiece model; no begin, end or other special token is added.
    Null and empty texts have 0 bytes and 0 tokens; texts of any length count as a whole; repeated
    rows and null keys each keep their row; other columns are ignored; an empty table gives an empty one.
    """
    path = model or public_tokenizers.path("piece_bpe_32k.model")
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def make():
        import sentencepiece

        encode = sentencepiece.SentencePieceProcessor(model_file=path)

        def apply(batch):
            parts, owner = [], []
            for i, x in enumerate(texts(batch)):
                for part in safe_parts(x, part_chars) if len(x) > part_chars else (x,):
                    parts.append(part)
                    owner.append(i)
            n = [0] * batch.num_rows
            for i, ids in zip(owner, encode.encode(parts, num_threads=1)):
                n[i] += len(ids)
            return {"doc_id": batch.column("doc_id"), "n_bytes": pc.fill_null(pc.binary_length(batch.column("text")), 0).cast("int64"), "n_tokens": n, "over_limit": [x > limit for x in n]}

        return apply

    return map_slices(rows, make, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean", most_bytes=500_000)
