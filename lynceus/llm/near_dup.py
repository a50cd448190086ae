"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

Shingles of five words weigh their count times their inverse document frequency. Frequencies of all documents are kept
in a count-min sketch of fixed size, so a frequency is exact for common shingles and at most a small share of the corpus
too high for rare ones. Each document draws consistent weighted samples, whose chance to agree is the weighted Jaccard
similarity; bands of samples propose pairs, and each pair counts only if its true weighted Jaccard is high enough.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lynceus.llm.common import free_names, stored
from lynceus.llm.components import components
from lynceus.llm.hashing import BASE, mix, pieces, signed, window_hashes, word_hashes

WIDTH_BITS, DEPTH = 17, 2
STEPS = 1 << 16
SHINGLES_AT_ONCE = 8192


def _gamma2() -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution at the middles of STEPS equal steps."""
    wanted = (np.arange(STEPS) + 0.5) / STEPS
    low, high = np.zeros(STEPS), np.full(STEPS, 64.0)
    for _ in range(60):
        x = (low + high) / 2
        below = 1 - np.exp(-x) * (1 + x) < wanted
        low, high = np.where(below, x, low), np.where(below, high, x)
    return (low + high) / 2


GAMMA = _gamma2()
LOG_GAMMA = np.log(GAMMA)


@dataclass(frozen=True)
class Frequencies:
    """Count-min sketch of document frequencies, DEPTH rows of 2**WIDTH_BITS, and the number of documents."""

    counts: np.ndarray
    documents: int
    #: Weights are idf to this power. Undamped, copies in a group that holds much of the corpus would fall apart: what
    #: they share is common and so weighs little, what tells them apart is rare.
    power: float = 0.25

    def idf(self, shingles: np.ndarray) -> np.ndarray:
        seen = np.minimum.reduce([self.counts[c] for c in cells(shingles)])
        return np.log1p(self.documents / np.maximum(seen, 1)) ** self.power


def cells(shingles: np.ndarray) -> list[np.ndarray]:
    """Cell of each shingle in each row of the sketch."""
    mask = np.uint64((1 << WIDTH_BITS) - 1)
    return [((shingles >> np.uint64(WIDTH_BITS * d + 3)) & mask).astype(np.int64) + (d << WIDTH_BITS) for d in range(DEPTH)]


def _encoded(texts) -> list[bytes]:
    return [(x or "").encode("utf-8", "surrogatepass") for x in texts]


def shingles(texts: list[bytes], n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct shingles and their counts, text by text; a shorter text is one shingle, a text without words has none."""
    for i, j in pieces(texts):
        words, begins = word_hashes(texts[i:j])
        for a, b in zip(begins[:-1], begins[1:]):
            yield np.unique(window_hashes(words[a:b], n), return_counts=True)


def frequencies(docs: DataFrame, n: int = 5) -> Frequencies:
    """The sketch over all documents; what reaches the driver is its DEPTH * 2**WIDTH_BITS counts."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(DEPTH << WIDTH_BITS, dtype=np.int64)
        for frame in frames:
            for found, _ in shingles(_encoded(frame["text"]), n):
                for c in cells(found):
                    np.add.at(total, c, 1)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"cell": at.astype(np.int32), "n": total[at]})

    rows = (docs.select("text").mapInPandas(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))).toPandas()
    counts = np.zeros(DEPTH << WIDTH_BITS, dtype=np.int64)
    counts[rows["cell"]] = rows["n"]
    return Frequencies(counts, docs.count())


def samples(found: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """``size`` consistent weighted samples of a weighted set, as 64-bit numbers.

    Sample k of item i with weight S: r, c ~ Gamma(2, 1) and b ~ U(0, 1) from the hash of (k, i), t = floor(ln S / r +
    b), ln a = ln c - r (t - b + 1); the item of the least a, with its t, is the sample.
    """
    seeds = mix(np.arange(1, size + 1, dtype=np.uint64) * BASE) | np.uint64(1)
    least, chosen = np.full(size, np.inf), np.zeros(size, dtype=np.uint64)
    rows = np.arange(size)
    for start in range(0, len(found), SHINGLES_AT_ONCE):
        items, logs = found[start:start + SHINGLES_AT_ONCE], np.log(weights[start:start + SHINGLES_AT_ONCE])
        x = items[None, :] * seeds[:, None]
        x ^= x >> np.uint64(29)
        x *= BASE
        x ^= x >> np.uint64(32)
        r = GAMMA[(x & np.uint64(0xFFFF)).astype(np.int32)]
        b = (x >> np.uint64(32)).astype(np.float64) * 2.0**-32
        t = np.floor(logs / r + b)
        a = LOG_GAMMA[((x >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int32)] - r * (t - b + 1)
        best = np.argmin(a, axis=1)
        value = a[rows, best]
        better = value < least
        sample = mix(items[best] + mix(t[rows, best].astype(np.int64).view(np.uint64) + BASE))
        least, chosen = np.where(better, value, least), np.where(better, sample, chosen)
    return chosen


def similar(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], known: Frequencies,
            threshold: float) -> bool:
    """Whether the weighted Jaccard of two texts' shingles reaches the threshold, by TF-IDF or with all weights one."""
    if not len(a[0]) or not len(b[0]):
        return False
    both, at, bt = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if len(both) >= threshold * (len(a[0]) + len(b[0]) - len(both)):
        return True
    common = float((np.minimum(a[1][at], b[1][bt]) * known.idf(both)).sum())
    total = float((a[1] * known.idf(a[0])).sum() + (b[1] * known.idf(b[0])).sum()) - common
    return common >= threshold * total


def _signatures(docs: DataFrame, known: Frequencies, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_hash, node (128 bits of the words; null without any) and the band keys of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = _encoded(frame["text"])
            nodes, keys = [], []
            for i, j in pieces(texts):
                words, begins = word_hashes(texts[i:j])
                for a, b in zip(begins[:-1], begins[1:]):
                    if a == b:
                        nodes.append(None)
                        keys.append(None)
                        continue
                    nodes.append(hashlib.blake2b(words[a:b].tobytes(), digest_size=16).digest())
                    found, counts = np.unique(window_hashes(words[a:b], n), return_counts=True)
                    drawn = samples(found, counts * shared.value.idf(found), bands * rows).reshape(bands, rows)
                    key = drawn[:, 0]
                    for k in range(1, rows):
                        key = mix(key * BASE + drawn[:, k])
                    keys.append(signed(key).tolist())
            yield pd.DataFrame({"doc_id": frame["doc_id"], "text_hash": frame["text_hash"], "node": nodes, "keys": keys},
                               dtype=object)

    kind = dict(docs.dtypes)["doc_id"]
    return (docs.withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas would turn numbers with nulls into floats
            .mapInPandas(sign, "doc_id string, text_hash long, node binary, keys array<long>")
            .withColumn("doc_id", F.col("doc_id").cast(kind)))


def _verified(pairs: DataFrame, texts: DataFrame, known: Frequencies, n: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough."""
    shared = pairs.sparkSession.sparkContext.broadcast(known)

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, left = None, None
        for frame in frames:
            good = []
            for a, text_a, text_b in zip(frame["a"], frame["text_a"], frame["text_b"]):
                if a != last:
                    last, left = a, next(shingles(_encoded([text_a]), n))
                good.append(similar(left, next(shingles(_encoded([text_b]), n)), shared.value, threshold))
            yield frame.loc[good, ["a", "b"]]

    first = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(second, "b").join(first, "a").mapInPandas(verify, "a binary, b binary")


def _beginnings(texts: DataFrame, known: Frequencies, n: int, threshold: float) -> DataFrame:
    """shingle, node, label, size, weight, left and heft: the shingles with which each text's order begins.

    The order, one for all texts, is by frequency in the sketch, then by hash. A beginning ends where what follows is
    less than ``threshold`` of the text, by number and by weight; two texts as similar as that share a shingle of their
    beginnings. ``left`` and ``heft`` are the number and weight of the shingle and all that follow it, of ``size`` and
    ``weight`` in the whole text.
    """
    shared = texts.sparkSession.sparkContext.broadcast(known)
    least = threshold * (1 - 1e-9)

    def begin(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for found, counts in shingles(_encoded(frame["text"]), n):
                seen = np.minimum.reduce([shared.value.counts[c] for c in cells(found)])
                order = np.lexsort((found, seen))
                weights = (counts * shared.value.idf(found))[order]
                heft = np.cumsum(weights[::-1])[::-1]  # of each shingle and those after it
                left = np.arange(len(found), 0, -1)
                k = max(np.count_nonzero(left >= least * len(found)), np.count_nonzero(heft >= least * heft[0]))
                out.append((signed(found[order[:k]]).tolist(), left[:k].tolist(), heft[:k].tolist()))
            yield pd.DataFrame({"node": frame["node"], "label": frame["label"], "shingle": [x[0] for x in out],
                                "left": [x[1] for x in out], "heft": [x[2] for x in out]}, dtype=object)

    schema = "node binary, label binary, shingle array<long>, left array<int>, heft array<double>"
    return (texts.select("node", "label", "text").mapInPandas(begin, schema)
            .select("node", "label", F.get("left", F.lit(0)).alias("size"), F.get("heft", F.lit(0)).alias("weight"),
                    F.explode(F.arrays_zip("shingle", "left", "heft")).alias("at"))
            .select("node", "label", "size", "weight", "at.*"))


def _across(texts: DataFrame, known: Frequencies, n: int, threshold: float) -> DataFrame:
    """All pairs (a, b) of texts (node, label, text) of different labels that can be as similar as ``threshold``.

    Of two texts nothing is common before the first shingle that both beginnings hold, so what is left from there on
    bounds what they share. A pair that these bounds leave open is met at that shingle.
    """
    begun = stored(_beginnings(texts, known, n, threshold), "near-beginnings")
    mixed = begun.groupBy("shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("shingle")
    begun = begun.join(mixed, "shingle", "left_semi")
    x, y = (begun.select("shingle", *[F.col(c).alias(c + side) for c in ("node", "label", "size", "weight", "left", "heft")])
            for side in "xy")
    least = threshold * (1 - 1e-9)
    number, heft = F.least("leftx", "lefty"), F.least("heftx", "hefty")
    open_ = ((F.col("labelx") < F.col("labely"))
             & ((number >= least * (F.col("sizex") + F.col("sizey") - number))
                | (heft >= least * (F.col("weightx") + F.col("weighty") - heft))))
    x, y = x.withColumnRenamed("shingle", "sx"), y.withColumnRenamed("shingle", "sy")
    return (x.join(y, (F.col("sx") == F.col("sy")) & open_)
            .select(F.least("nodex", "nodey").alias("a"), F.greatest("nodex", "nodey").alias("b")).distinct())


def near_duplicates(docs: DataFrame, threshold: float = 0.8, words: int = 5, bands: int = 12, rows: int = 3,
                    hot: int = 20_000, max_broadcast: int = 1_000_000, small: int = 8) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text), class and class_id of every row: the least doc_id of its class.

    ``class`` tells classes apart whose least doc_id is the same because rows of one doc_id hold different texts; it is
    null for texts without words.

    Texts with the same words (A-Z as a-z) are one node; a class is a connected component of the links between nodes of
    weighted Jaccard ``threshold`` or more. In a bucket of equal band keys each node is paired with the least one and,
    where these links leave nodes apart, with all others in buckets of up to ``small`` nodes. In larger ones it is paired
    with two that each band draws anew and with the one next to it in the order of the following bands, so similar
    signatures stand side by side; buckets of more than ``hot`` nodes are ordered in parts by the next band's key. Nodes
    of larger buckets that are still of different classes then meet wherever their rarest shingles allow the threshold,
    so every pair of equal band keys that reaches it shares a class. At 0.8 a pair shares one of 12 bands of 3 samples
    with 99.97 %.

    Null, empty and wordless texts have no shingles: such a row is a class of its own per doc_id. Repeated rows share
    their class. A class without any doc_id has a null class_id. Only doc_id and text are read.
    """
    known = frequencies(docs, words)
    base = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    rows_of = stored(_signatures(base, known, words, bands, rows), "near-rows")
    nodes = stored(rows_of.where("node is not null").groupBy("node").agg(
        F.first("keys").alias("keys"), F.min(F.struct("doc_id", "text_hash")).alias("at")), "near-nodes")

    key = ["band", "bucket"]
    spread = nodes.select("node", "keys", F.posexplode("keys").alias("band", "bucket"))
    draw = F.xxhash64("node", "band")
    buckets = (spread.groupBy(*key).agg(F.min("node").alias("leader"), F.min_by("node", draw).alias("second"),
                                        F.max_by("node", draw).alias("third"), F.count("*").alias("n")).where("n > 1"))
    order = F.slice(F.concat("keys", "keys"), F.col("band") + 2, 4)  # the keys of the bands that follow
    members = stored(spread.join(buckets, key).select(
        "node", *key, "leader", "second", "third", "n", order.alias("order")), "near-members")
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select(
        "node", F.col("at.doc_id").alias("__id"), F.col("at.text_hash").alias("__hash"))
    if wanted.count() <= max_broadcast:  # some 32 bytes each
        wanted = F.broadcast(wanted)
    texts = base.join(wanted, (F.col("__hash") == F.col("text_hash")) & F.col("__id").eqNullSafe(F.col("doc_id")))
    texts = stored(texts.groupBy("node").agg(F.first("text").alias("text")), "near-texts")

    by_leader = members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    links = stored(_verified(by_leader, texts, known, words, threshold), "near-links")
    labels = components(links)
    part = F.when(F.col("n") > hot, F.pmod(F.get("order", F.lit(0)), F.ceil(F.col("n") / hot))).otherwise(0)
    beside = Window.partitionBy(*key, "part").orderBy("order", "node")
    few, many = members.where(F.col("n") <= small), members.where(F.col("n") > small)
    pairs = few.where("node <> leader").select(*key, F.col("node").alias("a"))
    pairs = (pairs.join(pairs.withColumnRenamed("a", "b"), key).where("a < b").select("a", "b")
             .unionByName(many.withColumn("part", part).withColumn("beside", F.lag("node").over(beside))
                          .select("node", F.explode(F.array("second", "third", "beside")).alias("other"))
                          .where("other <> node")
                          .select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))).distinct())
    label = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    other = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    near = (pairs.join(label, "a", "left").join(other, "b", "left")
            .where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b"))
    links = stored(links.unionByName(_verified(near, texts, known, words, threshold)), "near-links")
    labels = components(links)
    apart = (many.select("node", *key).join(labels, "node", "left")
             .withColumn("label", F.coalesce("label", "node")))
    mixed = apart.groupBy(*key).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select(*key)
    apart = stored(apart.join(mixed, key, "left_semi").select("node", "label").distinct(), "near-apart")
    if not apart.isEmpty():
        rest = _across(texts.join(apart, "node"), known, words, threshold)
        links = links.unionByName(_verified(rest, texts, known, words, threshold))
        labels = components(links)
    labels = labels.withColumnRenamed("label", "class")
    placed = rows_of.drop("keys").join(labels, "node", "left").withColumn("class", F.coalesce("class", "node"))
    least = placed.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("class_id"))
    return (placed.join(least, "class", "left")
            .select("doc_id", "text_hash", "class", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(
                F.col("class_id")).alias("class_id")))


def keep_one(docs: DataFrame, **parameters) -> DataFrame:
    """``docs`` with one document of each class, the one whose doc_id is the class's least.

    Rows of that doc_id with another text, or that repeat the document, go as well if they are of the same class. Rows
    without a class_id (no doc_id in their class) all stay. The least text hash decides among texts of one doc_id.
    All columns are kept, whatever their names; an empty table gives an empty one.
    """
    id_, hash_, copy = free_names(docs, "__id", "__hash", "__copy")
    found = near_duplicates(docs, **parameters)
    chosen = (found.where("class_id is not null").groupBy("class", "class_id")
              .agg(F.min(F.struct("doc_id", "text_hash")).alias("first")).select("first.*")
              .unionByName(found.where("class_id is null").select("doc_id", "text_hash"))
              .select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).distinct())
    same = F.col(id_).eqNullSafe(F.col("doc_id")) & (F.col(hash_) == F.xxhash64("text"))
    copies = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(0))
    return (docs.join(chosen, same, "left_semi").withColumn(copy, F.row_number().over(copies))
            .where(F.col("doc_id").isNull() | (F.col(copy) == 1)).drop(copy))


def op4(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and class_id."""
    return near_duplicates(docs).select("doc_id", "class_id")
