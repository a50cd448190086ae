"""Quality rule on repetition: which share of a text's characters stands in repeated n-grams and lines.

Words become numbers, windows of several lengths become rolling hashes in numpy, and equal hashes mark the words they
cover. A text is kept while no share exceeds the limit of its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest share of word characters inside repeated windows, by words in a window.
GRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest shares of lines that repeat an earlier line, and of word characters inside them.
LINE_LIMIT = 0.30
LINE_CHAR_LIMIT = 0.20
SYMBOLS = b"#*$%&|<>"
NOT_SYMBOLS = bytes(sorted(set(range(256)) - set(SYMBOLS)))
BASE = np.uint64(0x9E3779B97F4A7C15)

SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_share double, "
          "dup_line_chars double, worst_gram int, worst_gram_share double, over_limit boolean")


def _spread(ids: np.ndarray) -> np.ndarray:
    """Numbers to well mixed 64-bit values."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * BASE
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _covered(hashes: np.ndarray, n: int, words: int) -> np.ndarray:
    """Words inside windows whose hash occurs twice or more."""
    order = np.argsort(hashes)
    same = hashes[order[1:]] == hashes[order[:-1]]
    starts = np.zeros(words + 1, dtype=np.int64)
    hit = np.zeros(len(hashes), dtype=bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    at = np.flatnonzero(hit)
    starts[at] += 1
    starts[at + n] -= 1
    return np.cumsum(starts[:-1]) > 0


def measure(text: str | None) -> tuple:
    """The fields of SCHEMA for one text; null is measured as the empty text. Windows stay inside the text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = np.fromiter((len(w) for w in words), np.int64, n)
    if not raw.isascii():  # code points: bytes less continuation bytes
        chars = np.fromiter((len(w.decode("utf-8", "surrogatepass")) for w in words), np.int64, n)
    total = int(chars.sum())
    seen: set[bytes] = set()
    lines = dup_lines = dup_line_chars = 0
    for line in raw.split(b"\n"):
        if line.isspace() or not line:
            continue
        lines += 1
        if line in seen:
            dup_lines += 1
            dup_line_chars += sum(len(w.decode("utf-8", "surrogatepass")) for w in line.split())
        seen.add(line)
    number: dict[bytes, int] = {}
    x = _spread(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n))
    repeat, worst, worst_share, over = 0, 0, 0.0, False
    h = x
    for k in range(2, min(n, max(GRAM_LIMITS)) + 1):
        h = h[:-1] * BASE + x[k - 1:]
        if k != 3 and k not in GRAM_LIMITS:
            continue
        inside = _covered(h, k, n)
        if k == 3:
            repeat = int(inside.sum())
        if not inside.any():  # longer windows cannot repeat either
            break
        if k in GRAM_LIMITS:
            share = float(chars[inside].sum() / total)
            over |= share > GRAM_LIMITS[k]
            if share > worst_share:
                worst, worst_share = k, share
    line_share, line_chars = dup_lines / max(1, lines), dup_line_chars / max(1, total)
    over |= line_share > LINE_LIMIT or line_chars > LINE_CHAR_LIMIT
    return (n, total, len(raw.translate(None, NOT_SYMBOLS)), dup_lines, repeat, line_share, line_chars, worst, worst_share,
            bool(over))


def repetition(text: Column) -> Column:
    """Struct column of SCHEMA. Each row is measured by itself and whole; null and empty texts have no words."""

    @F.pandas_udf(SCHEMA)
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for texts in batches:
            yield pd.DataFrame([measure(x) for x in texts], columns=names)

    return measured(text)


def op7(docs: DataFrame) -> DataFrame:
    """The contract's columns and the method's shares, one row per row of ``docs``."""
    failed = (F.col("r.n_words") < 50) | (F.col("r.n_repeat_words") * 100 > F.col("r.n_words") * 50)
    return (docs.select("doc_id", repetition(F.col("text")).alias("r"))
            .select("doc_id", "r.n_words", "r.word_chars", "r.n_symbols", "r.n_dup_lines", "r.n_repeat_words",
                    failed.alias("base_failed"), (~failed & ~F.col("r.over_limit")).alias("kept"),
                    "r.dup_line_share", "r.dup_line_chars", "r.worst_gram", "r.worst_gram_share"))
