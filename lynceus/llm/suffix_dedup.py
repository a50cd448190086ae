"""Removal of long repeated byte strings, by sorted surroundings of shared anchors.

Two equal strings of ``length`` bytes hold the same anchors: places where the hash of a short string is the least of a
window that fits into ``length`` bytes. Anchors that occur once match nothing. For those that occur more often, the
distinct surroundings (all bytes that a string of ``length`` bytes around the anchor can reach) are sorted column by
column from the right, which is the order of their suffixes, and neighbours are compared by hashes of ``length`` bytes;
only ends of runs of equal preceding bytes need that. Anchors with very many surroundings are not gathered in one task:
strings that start at neighbouring places are tested together, by counts of what they share and of all that they reach,
and apart where that leaves them open. The result is exactly the repeated strings.

This is not the whole of the method it is named for: there is no run-length index of a transform of the corpus, whose one
global order a partitioned job would have to sort for the sake of matches that anchors already bring together, there are
no sampled run ends and no streamed matching statistics.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynceus.llm.common import spread_join, stored
from lynceus.llm.hashing import BASE, BYTE, mix

GRAM = 32
#: A range a to b of a text as one number: a * PLACES + b.
PLACES = 1 << 31


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at each place, by doubling."""
    h, n, power = BYTE[text], 1, BASE
    while n < GRAM:
        h = h[:-n] * power + h[n:]
        power = np.uint64(int(power) ** 2 % 2**64)
        n *= 2
    return mix(h)


def _sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of each run of ``width`` values, by doubling."""
    choose = np.minimum if least else np.maximum
    out, n = values, 1
    while 2 * n <= width:
        out = choose(out[:-n], out[n:])
        n *= 2
    rest = width - n
    return choose(out[:-rest], out[rest:]) if rest else out


def anchors(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes such that every ``length`` bytes hold the gram of at least one, chosen by content alone."""
    if len(text) < length:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    h = gram_hashes(np.frombuffer(text, dtype=np.uint8))
    width = length - GRAM + 1
    low = _sliding(h, width, True)
    # A place is chosen if it is the least of some window, which are those that the largest window minimum over it tells.
    padded = np.concatenate([np.zeros(width - 1, dtype=np.uint64), low, np.zeros(width - 1, dtype=np.uint64)])
    at = np.flatnonzero(_sliding(padded, width, False) == h)
    return at, h[at]


def repeated(rows: list[bytes], lefts: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """For each surrounding, ranges (from its anchor on) of strings of ``length`` bytes that another one has too.

    ``rows`` are distinct per anchor gram; ``lefts`` tells how many bytes stand before the anchor. Strings are compared
    at the same place from the anchor, which all equal strings with that anchor share.
    """
    before, after = length - GRAM, length
    n = len(rows)
    grid = np.zeros((n, before + after), dtype=np.uint8)
    ends = np.zeros(n, dtype=np.int64)
    for i, (row, left) in enumerate(zip(rows, lefts)):
        start = before - left
        grid[i, start:start + len(row)] = np.frombuffer(row, dtype=np.uint8)
        ends[i] = start + len(row)
    starts = before - np.asarray(lefts)
    plain = all(0 not in row for row in rows)  # then the padding is below every byte
    grid = np.ascontiguousarray(grid.T)  # a column of the sort is contiguous
    # Hash of the ``length`` bytes from a column on, moved along with the column.
    top = np.uint64(pow(int(BASE), length, 2**64))
    window = np.zeros(n, dtype=np.uint64)
    for c in range(before + length - 1, before - 1, -1):
        window = window * BASE + BYTE[grid[c]]
    right = np.ascontiguousarray(grid[before:].T)
    order = np.argsort(right.view(f"S{after}").ravel(), kind="stable")
    found: list[list[tuple[int, int]]] = [[] for _ in rows]
    for c in range(before, -1, -1):
        if c < before:
            window = window * BASE + BYTE[grid[c]] - top * BYTE[grid[c + length]]
            order = order[np.argsort(grid[c][order], kind="stable")]
        whole = order[(starts[order] <= c) & (ends[order] >= c + length)]
        here = window[whole]
        at = np.flatnonzero(here[1:] == here[:-1])
        if not len(at):
            continue
        a, b = whole[at], whole[at + 1]
        if c > 0 and plain:  # inside a run of equal preceding bytes the match goes on to the left and is taken there
            end = (grid[c - 1][a] != grid[c - 1][b]) | (starts[a] >= c) | (starts[b] >= c)
            a, b = a[end], b[end]
        for x, y in zip(a.tolist(), b.tolist()):
            last = int(min(ends[x], ends[y]))
            differs = grid[c:last, x] != grid[c:last, y]
            shared = int(differs.argmax()) if differs.any() else last - c
            if shared >= length:
                found[x].append((c - before, c - before + shared))
                found[y].append((c - before, c - before + shared))
    return [merged(x) for x in found]


def merged(ranges) -> list[tuple[int, int]]:
    """Maximal ranges that cover the given ones; ranges that touch are one."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _digest(x: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True)


ANCHORS = "node binary, anchor long, place long, around long"


def _anchor_rows(rows: DataFrame, length: int) -> DataFrame:
    """node, anchor hash, its place with the end of its reach as one number, and the digest of the bytes in reach and of
    the place in them."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: dict[str, list] = {k.split()[0]: [] for k in ANCHORS.split(", ")}
            for node, text in zip(frame["node"], frame["text"]):
                raw = text.encode("utf-8", "surrogatepass")
                at, hashes = anchors(raw, length)
                low, high = np.maximum(0, at + GRAM - length), np.minimum(len(raw), at + length)
                out["node"] += [node] * len(at)
                out["anchor"] += hashes.view(np.int64).tolist()
                out["place"] += (at * PLACES + high).tolist()
                out["around"] += [_digest(b"%d:" % (p - a) + raw[a:b]) for p, a, b in zip(at.tolist(), low.tolist(), high.tolist())]
                if len(out["anchor"]) > 100_000:
                    yield pd.DataFrame(out)
                    out = {k: [] for k in out}
            yield pd.DataFrame(out)

    return rows.mapInPandas(scan, ANCHORS)


def _slices(rows: DataFrame, length: int) -> DataFrame:
    """The bytes around the wanted anchors of each text."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[tuple] = []
            for text, wanted in zip(frame["text"], frame["wanted"]):
                raw = text.encode("utf-8", "surrogatepass")
                for w in wanted:
                    at, high = divmod(w["place"], PLACES)
                    low = max(0, at + GRAM - length)
                    out.append((w["anchor"], w["around"], at - low, raw[low:high]))
            yield pd.DataFrame(out, columns=["anchor", "around", "left", "bytes"])

    return rows.mapInPandas(cut, "anchor long, around long, left int, bytes binary")


MATCHES = "anchor long, around long, ranges array<struct<a:int,b:int>>"


def _indexed(slices: DataFrame, length: int, most: int = 8192) -> DataFrame:
    """Matches within each anchor, by one transform for about ``most`` surroundings at a time."""

    def match(group: pd.DataFrame) -> pd.DataFrame:
        found = repeated(group["bytes"].tolist(), group["left"].to_numpy(), length)
        keep = [i for i, x in enumerate(found) if x]
        return pd.DataFrame({"anchor": group["anchor"].iloc[keep], "around": group["around"].iloc[keep],
                             "ranges": [[{"a": a, "b": b} for a, b in found[i]] for i in keep]})

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in frames:
            rest = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            while len(rest) > most:  # whole anchors only: rows are sorted by anchor
                ids = rest["anchor"].to_numpy()
                border = int(np.searchsorted(ids, ids[most], side="left"))
                border = border or int(np.searchsorted(ids, ids[0], side="right"))
                if border == len(rest):
                    break
                yield match(rest.iloc[:border])
                rest = rest.iloc[border:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield match(rest)

    return slices.repartition("anchor").sortWithinPartitions("anchor", "around").mapInPandas(scan, MATCHES)


#: Lengths of the runs of places that ``_narrowed`` tests together; each divides the one before.
STEPS = (64, 8, 1)
RUN_STRINGS = "anchor long, around long, a int, whole boolean, string binary"


def _run_strings(runs: DataFrame, length: int, step: int) -> DataFrame:
    """What the strings that start in each run of ``step`` places share (its core) and all that they reach (its whole)."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: dict[str, list] = {k.split()[0]: [] for k in RUN_STRINGS.split(", ")}
            for anchor, around, left, raw, starts in zip(*(frame[c] for c in ("anchor", "around", "left", "bytes", "starts"))):
                for a in starts.tolist():
                    last = min(a + step, 1) - 1  # no string starts behind its anchor
                    for whole, low, high in ((False, last, a + length), (True, a, last + length)):
                        if (whole or a < last) and low + left >= 0 and high + left <= len(raw):
                            out["anchor"].append(anchor)
                            out["around"].append(around)
                            out["a"].append(a)
                            out["whole"].append(whole)
                            out["string"].append(hashlib.blake2b(raw[low + left:high + left], digest_size=16).digest())
                if len(out["a"]) > 100_000:
                    yield pd.DataFrame(out)
                    out = {k: [] for k in out}
            yield pd.DataFrame(out)

    return runs.mapInPandas(scan, RUN_STRINGS)


def _narrowed(slices: DataFrame, length: int) -> DataFrame:
    """The same matches for anchors with too many surroundings for one task, by counts over the cluster.

    Of a run of places, no string repeats if no other surrounding has its core there, and every string does if another
    one has its whole. Only runs between the two are split, down to single places, where core and whole are the string; of
    those with one whole, the first is split as well, as others may share a part with it.
    """
    key, same = ["anchor", "around"], ["anchor", "a", "whole", "string"]
    # Each row makes many, so tasks are dealt by rows; by bytes Spark would put them into a few.
    slices = slices.repartition(int(slices.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)
    runs = slices.withColumn("starts", F.sequence(F.lit(GRAM - length), F.lit(0), F.lit(STEPS[0])))
    found = []
    for step, finer in zip(STEPS, [*STEPS[1:], None]):
        last = lambda a: F.least(a + (step - 1), F.lit(0))
        strings = _run_strings(runs, length, step)
        more = strings.groupBy(*same).agg(F.min("around").alias("x"), F.max("around").alias("y")).where("x <> y")
        level = stored(spread_join(strings, more.select(*same, "x"), same).groupBy(*key).agg(
            F.collect_list(F.expr("if(whole, a, null)")).alias("whole"),
            F.collect_list(F.expr("if(whole and around <> x, a, null)")).alias("done"),
            F.collect_list(F.expr("if(whole, null, a)")).alias("core")), "suffix-runs")
        ranges = F.transform("whole", lambda a: F.struct(a.alias("a"), (last(a) + length).alias("b")))
        found.append(level.where(F.size("whole") > 0).select(*key, ranges.alias("ranges")))
        if finer:
            split = F.transform(F.array_except("core", "done"), lambda a: F.sequence(a, last(a), F.lit(finer)))
            runs = slices.join(level.select(*key, F.flatten(split).alias("starts")).where(F.size("starts") > 0), key)
    return reduce(DataFrame.unionByName, found)


def repeated_ranges(rows: DataFrame, length: int = 400, hot: int = 32_768, max_broadcast: int = 1_000_000) -> DataFrame:
    """node and ranges (bytes, as a * PLACES + b, may overlap) of the strings that start elsewhere too, in distinct texts.

    ``rows`` has node (128 bits of the text) and text; equal texts count as one here.
    """
    # An anchor that stands once in all texts matches nothing, so its row is not kept; the texts are scanned twice for it.
    every = _anchor_rows(rows, length)
    shared = every.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    found = stored(spread_join(every, shared, ["anchor"]), "suffix-anchors")
    key = ["anchor", "around"]
    place = F.struct("node", "place")
    groups = stored(found.groupBy(*key).agg(F.min(place).alias("first"), F.max(place).alias("last")), "suffix-groups")
    # Equal surroundings at two places: all of it repeats. Unequal ones with the same anchor: compare.
    several = groups.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    wanted = spread_join(groups, several, ["anchor"]).select(*key, "n", "first.*")
    by_node = wanted.groupBy("node").agg(F.collect_list(F.struct("anchor", "around", "place")).alias("wanted"))
    by_node = stored(by_node, "suffix-wanted")
    nodes = by_node.select("node")
    texts = rows.join(F.broadcast(nodes), "node", "left_semi") if by_node.count() <= max_broadcast else rows
    texts = texts.groupBy("node").agg(F.first("text").alias("text"))
    slices = stored(_slices(texts.join(by_node, "node").select("text", "wanted"), length), "suffix-slices")
    crowded = several.where(F.col("n") > hot).select("anchor")  # one in ``hot`` rows at most
    if crowded.isEmpty():
        matches = _indexed(slices, length)
    else:
        matches = (_indexed(slices.join(F.broadcast(crowded), "anchor", "left_anti"), length)
                   .unionByName(_narrowed(slices.join(F.broadcast(crowded), "anchor", "left_semi"), length)))
    full = groups.where(F.col("first") != F.col("last")).select(*key, F.lit(True).alias("full"))
    marks = (matches.withColumn("full", F.lit(False)).unionByName(
        full.withColumn("ranges", F.array().cast("array<struct<a:int,b:int>>")))
        .groupBy(*key).agg(F.max("full").alias("full"), F.flatten(F.collect_list("ranges")).alias("ranges")))
    number = lambda a, b: a.cast("long") * PLACES + b
    at, high = F.expr(f"place div {PLACES}"), F.expr(f"place % {PLACES}")
    low = F.greatest(F.lit(0), at + (GRAM - length))
    whole = F.array(number(low, high))
    shifted = F.transform("ranges", lambda r: number(r["a"] + at, r["b"] + at))
    return (spread_join(found, marks, key)
            .select("node", F.when(F.col("full") & (high - low >= length), whole).otherwise(shifted)
                    .alias("ranges")).where(F.size("ranges") > 0)
            .groupBy("node").agg(F.flatten(F.collect_list("ranges")).alias("ranges")))


def unpacked(ranges: np.ndarray) -> list[tuple[int, int]]:
    """Maximal ranges that cover the given ones, each one number; ranges that touch are one."""
    ranges = np.unique(ranges)
    a, b = ranges // PLACES, np.maximum.accumulate(ranges % PLACES)
    new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
    return list(zip(a[new].tolist(), b[np.append(new[1:], len(b)) - 1].tolist()))


RESULT = "n_bytes long, n_removed long, n_spans long, kept binary"


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and the ``kept`` bytes of every row.

    A byte goes if a string of ``length`` bytes that covers it starts anywhere else too: in another row, in a repeat of
    the same row, or elsewhere in the same text, overlaps included. Strings are judged on the input. Null and empty
    texts have no bytes. Strings never span rows. Only doc_id and text are read; whole texts, as UTF-8.
    """
    rows = docs.select("doc_id", F.unhex(F.md5("text")).alias("node"), F.coalesce("text", F.lit("")).alias("text"))
    long = rows.where(F.octet_length("text") >= length).select("node", "text")
    marks = repeated_ranges(long, length)
    copies = long.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node", F.lit(True).alias("copied"))
    marks = marks.join(copies, "node", "full")

    @F.pandas_udf(RESULT)
    def cut(texts: pd.Series, ranges: pd.Series, copied: pd.Series) -> pd.DataFrame:
        out = []
        for text, found, all_of_it in zip(texts, ranges, copied):
            raw = text.encode("utf-8", "surrogatepass")
            gone = [(0, len(raw))] if all_of_it is True else [] if found is None else unpacked(found)
            edges = [0, *[x for r in gone for x in r], len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
            out.append((len(raw), len(raw) - len(kept), len(gone), kept))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept"])

    return (spread_join(rows, marks, ["node"], "left").select("doc_id", cut("text", "ranges", "copied").alias("r"))
            .select("doc_id", "r.*"))


def op9(docs: DataFrame) -> DataFrame:
    """The contract's columns, one row per row of ``docs``, and the remaining text (characters cut in two are replaced)."""
    kept = F.col("kept")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(kept, 256).alias("kept_sha256"),
                                       F.make_valid_utf8(kept.cast("string")).alias("text"))
