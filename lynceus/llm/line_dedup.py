"""Deletion of repeated runs of lines by winnowing over line hashes.

A window is a shortest run of lines with at least ``min_words`` words: the one that begins at a line and the one that
ends at it. The smallest line hash of a window is its fingerprint, so two equal runs of that many words always share
one. Windows whose fingerprint stands once fall out; of the others the hash of all their lines is grouped, and the lines
of a window that stands at an earlier place too are deleted. As every line begins and ends a window, the windows of a
longer match overlap and cover it: nothing is extended from the places of fingerprints.

The result is exact: a line goes if it is part of a run of lines, ``min_words`` words or more, that equals a run which
begins at an earlier place. Places are ordered by document id (null first), then text, then line; rows that repeat both
id and text are one document for this.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynceus.llm.common import free_names, stored
from lynceus.operators.values import quoted

LAST = np.uint64(2**64 - 1)


def line_hashes(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and number of words of each line."""
    hashes = b"".join(hashlib.blake2b(x, digest_size=8).digest() for x in lines)
    return np.frombuffer(hashes, dtype="<u8"), np.fromiter((len(x.split()) for x in lines), np.int64, len(lines))


def windows(words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last line of each window, by first line, without repeats."""
    n = len(words)
    upto = np.concatenate([[0], np.cumsum(words)])
    last = np.searchsorted(upto, upto[:-1] + min_words) - 1  # of the shortest run from each line on
    first = np.searchsorted(upto, upto[1:] - min_words, side="right") - 1  # of the shortest run up to each line
    here = np.arange(n)
    ahead, back = last < n, first >= 0
    pairs = np.unique(np.concatenate([here[ahead], first[back]]) * n + np.concatenate([last[ahead], here[back]]))
    return pairs // n, pairs % n


def fingerprints(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The smallest line hash of each window."""
    if not len(first):
        return np.zeros(0, dtype=np.uint64)
    return np.minimum.reduceat(np.append(hashes, LAST), np.stack([first, last + 1], 1).ravel())[::2]


def _all_windows(rows: DataFrame, min_words: int) -> DataFrame:
    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = {k: [] for k in ("doc_id", "text_hash", "first", "last", "fingerprint", "hash")}
            for doc_id, text_hash, text in zip(frame["doc_id"], frame["text_hash"], frame["text"]):
                hashes, words = line_hashes(text.encode("utf-8", "surrogatepass").split(b"\n"))
                a, b = windows(words, min_words)
                raw = hashes.tobytes()
                out["doc_id"] += [doc_id] * len(a)
                out["text_hash"] += [text_hash] * len(a)
                out["first"] += a.tolist()
                out["last"] += b.tolist()
                out["fingerprint"] += fingerprints(hashes, a, b).view(np.int64).tolist()
                out["hash"] += [hashlib.blake2b(raw[8 * i:8 * j + 8], digest_size=16).digest() for i, j in zip(a, b)]
            yield pd.DataFrame(out, dtype=object)

    kind = dict(rows.dtypes)["doc_id"]  # as text in pandas, where numbers with nulls would turn into floats
    return (rows.select(F.col("doc_id").cast("string").alias("doc_id"), "text_hash", "text").where("text <> ''")
            .mapInPandas(scan, "doc_id string, text_hash long, first int, last int, fingerprint long, hash binary")
            .withColumn("doc_id", F.col("doc_id").cast(kind)))


def repeated_runs(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """doc_id, text_hash and the runs (first and last line, from 0) that stand at an earlier place too."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    found = stored(_all_windows(rows, min_words), "line-windows")
    # Positions of a fingerprint: one that stands at a single place matches nothing. What is joined is written first, so
    # that both sides are shuffled for the join alone and Spark may split a hot fingerprint or window.
    place = F.struct("doc_id", "text_hash", "first")
    shared = stored(found.groupBy("fingerprint").agg(F.min(place).alias("low"), F.max(place).alias("high"))
                    .where(~F.col("low").eqNullSafe(F.col("high"))).select("fingerprint"), "line-fingerprints")
    met = found.join(shared, "fingerprint")
    # The same window from line to line: its earliest place keeps it, all others are repeats.
    earliest = stored(met.groupBy("hash").agg(F.min(place).alias("low"), F.max(place).alias("high"))
                      .where(~F.col("low").eqNullSafe(F.col("high"))).select("hash", "low"), "line-earliest")
    return (met.join(earliest, "hash").where(~place.eqNullSafe(F.col("low")))
            .groupBy("doc_id", "text_hash")
            .agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("runs")))


def _cut(text: str, runs) -> tuple[str, int, int]:
    lines = text.split("\n")
    gone = np.zeros(len(lines) + 1, dtype=np.int64)
    for run in runs:
        gone[run["first"]] += 1
        gone[run["last"] + 1] -= 1
    stays = np.cumsum(gone[:-1]) == 0
    return "\n".join(x for x, s in zip(lines, stays) if s), len(lines), int((~stays).sum())


def drop_repeated_lines(docs: DataFrame, min_words: int = 50, deleted: str = "lines_deleted") -> DataFrame:
    """``docs`` with later repeats of runs of ``min_words`` words deleted, and their number of lines as ``deleted``.

    A column of that name is replaced, all others are kept, whatever their names. An empty table gives an empty one.
    All rows and columns stay; a text of which every line goes is empty. Null and empty texts have no line and stay as
    they are, lines without words go only inside a run. Equal lines of fewer words than ``min_words`` in unequal
    surroundings stay. Rows that repeat an id with its text are one document: each keeps what the document keeps.
    """
    id_, hash_, runs_, cut_ = free_names(docs, "__id", "__hash", "__runs", "__cut")
    runs = repeated_runs(docs, min_words).select(
        F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), F.col("runs").alias(runs_))

    @F.pandas_udf("text string, deleted int")
    def cut(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        out = [(x, 0) if r is None else _cut(x, r)[::2] for x, r in zip(texts, found)]
        return pd.DataFrame(out, columns=["text", "deleted"])

    met = docs.join(runs, F.col(id_).eqNullSafe(F.col("doc_id")) & (F.col(hash_) == F.xxhash64("text")), "left")
    return (met.withColumn(cut_, cut(F.col("text"), F.col(runs_)))
            .withColumns({"text": F.col(cut_)["text"], deleted: F.col(cut_)["deleted"]})
            .select(*[quoted(c) for c in docs.columns if c != deleted], deleted))


def op3(docs: DataFrame) -> DataFrame:
    """One row per document: its text without repeated runs, their number of lines and the characters that are left."""
    kept = drop_repeated_lines(docs.select("doc_id", "text"))
    return kept.select("doc_id", "text", F.col("lines_deleted").cast("long").alias("lines_deleted"),
                       F.length("text").cast("long").alias("n_chars"))
