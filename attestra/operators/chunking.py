"""Documents into sentence-aligned chunks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X


@dataclass(frozen=True)
class Chunking:
    """Sizes in estimated tokens."""

    target: int = 220
    overlap: int = 40
    least: int = 25
    most: int = 400

    def __post_init__(self) -> None:
        if not (0 <= self.overlap < self.target <= self.most and 0 < self.least <= self.target):
            raise ValueError("sizes must satisfy 0 <= overlap < target <= most and 0 < least <= target")


def _size(text: str, rate: float) -> int:
    return max(1, round(len(text) * rate))


def pack(sentences: list[str], rate: float, sizes: Chunking) -> list[str]:
    """Chunks of whole sentences: filled to the target, each starting with the last sentences of the one before as far as the overlap allows; a chunk below the least size joins the next, the last one the one before."""
    weights = [_size(s, rate) for s in sentences]
    spans: list[tuple[int, int]] = []
    first = size = 0
    for i, w in enumerate(weights):
        if i > first and size + w > sizes.target:
            spans.append((first, i))
            back, size = i, 0
            while back > first and size + weights[back - 1] <= sizes.overlap:
                back -= 1
                size += weights[back]
            first = back
        size += w
    if sentences:
        spans.append((first, len(sentences)))
    done: list[str] = []
    waiting: str | None = None
    bodies = [" ".join(sentences[a:b]) for a, b in spans]
    for k, body in enumerate(bodies):
        body = body if waiting is None else f"{waiting} {body}"
        waiting = None
        if _size(body, rate) >= sizes.least:
            done.append(body)
        elif k + 1 < len(bodies):
            waiting = body
        elif done:
            done[-1] = f"{done[-1]} {body}"
        else:
            done.append(body)
    return done


def clauses(sentence: str, pieces: list[str], rate: float, most: int) -> list[str]:
    """An overlong sentence in runs of clauses of at most `most` tokens."""
    out: list[list[str]] = [[]]
    size = 0
    for p in pieces:
        w = _size(p, rate)
        if out[-1] and size + w > most:
            out.append([])
            size = 0
        out[-1].append(p)
        size += w
    return [" ".join(o) for o in out if o] or [sentence]


def chunk_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang", sizes: Chunking = Chunking()) -> DataFrame:
    """(key, chunk_id, chunk_index, n_chunks, est_tokens, text, language), sentences never cut unless overlong.

    Paragraphs and sentences are split by JVM expressions; the order-dependent packing of one document's sentences runs
    in an Arrow function. NULL and blank texts give no chunk; an unknown or NULL language takes the default rate. A very
    long text is one row and is packed whole.
    """
    rate = X.per_language(F.col(language), {k: F.lit(v) for k, v in L.TOKENS_PER_CHAR.items()}, F.lit(L.OTHER_TOKENS_PER_CHAR))

    @F.pandas_udf("array<string>")
    def packed(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sentences, rates in batches:
            out = []
            for parts, r in zip(sentences, rates):
                fine: list[str] = []
                for pieces in parts:
                    whole = " ".join(pieces)
                    fine += clauses(whole, list(pieces), r, sizes.most) if len(pieces) > 1 and _size(whole, r) > sizes.most else [whole]
                out.append(pack(fine, r, sizes))
            yield pd.Series(out)

    # composed once per text; the blank lines must survive until the paragraphs are split
    tidy = F.regexp_replace(X.nfc(F.col(text)), L.ZERO_WIDTH, "")
    paragraphs = F.filter(F.split(tidy, r"\n\s*\n"), lambda p: F.trim(p) != "")
    clean = F.transform(paragraphs, lambda p: F.trim(F.regexp_replace(p, L.BLANK + "+", " ")))
    sentences = F.filter(F.flatten(F.transform(clean, X.sentences)), lambda s: s != "")
    cut = F.transform(sentences, lambda s: F.split(s, r"(?<=[,;:।])\s+"))
    rows = docs.where(F.length(F.trim(F.col(text))) > 0).select(key, F.col(language).alias("language"), packed(cut, rate).alias("parts"))
    rows = rows.select(key, "language", F.size("parts").alias("n_chunks"), F.posexplode_outer("parts").alias("chunk_index", "text")).where("text IS NOT NULL")
    return rows.select(key, F.concat(F.col(key).cast("string"), F.lit("#c"), F.col("chunk_index").cast("string")).alias("chunk_id"), "chunk_index", "n_chunks", X.estimate_tokens(F.col("text"), F.col("language")).alias("est_tokens"), "text", "language")
