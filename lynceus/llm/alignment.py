"""Alignment of two tokenizers' tokens over the same texts, by interval coalescing.

Each text is encoded by a byte-level vocabulary A (with a space before the text) and a piece vocabulary B (which adds
that space itself). All tokens of a chunk of texts are sorted by their first byte; a group ends where a token starts at
or after the running maximum of the ends so far, which is where tokens of A and B both end. Within a group every token
of A is linked to every token of B. How many documents hold an id pair linked is counted over the whole corpus, and each
document is described by its links.

Pairs travel as one number, ``a * size of B + b``, once per document with the number of their occurrences. Documents look
their counts up in two joins: pairs above a count are at most ``max_broadcast`` rows and broadcast, the rarer ones, of
which none can be hot, are joined by a shuffle.

Defined results: null and empty texts, and texts whose joined token bytes differ from a space and the text (characters
that B's vocabulary changes), have no tokens: zeros and an empty string. Rows that repeat an id or are equal
altogether are documents of their own; a null id is kept. Ties for the highest count of an A id are all best. An empty
table gives no rows, and other columns of the table are not read.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynceus.llm.common import stored
from lynceus.llm.hashing import pieces

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
#: What byte-level tokenizers split a text by before merging (fixed value).
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of texts that are aligned at once; a longer text is a chunk of its own.
CHUNK = 1 << 19
#: Groups with more pairs than this are expanded over their distinct ids.
EXPAND = 4096

Encode = Callable[[list[str]], list[np.ndarray]]


def _byte_of_letter() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def byte_level(path: str) -> tuple[Encode, list[bytes]]:
    """Encoder (special tokens are plain text) and the bytes of each id of a byte-level vocabulary file."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    vocabulary, merges = file["model"]["vocab"], file["model"]["merges"]
    letters = _byte_of_letter()
    special = {x["content"] for x in file["added_tokens"]}
    plain = {t: i for t, i in vocabulary.items() if t not in special}
    ranks = {bytes(letters[c] for c in t): i for t, i in plain.items()}
    size = max([*vocabulary.values(), *(x["id"] for x in file["added_tokens"])]) + 1
    table = [b""] * size
    for token, i in ranks.items():
        table[i] = token
    pairs = [x.split(" ") if isinstance(x, str) else x for x in merges]
    if all(vocabulary.get(a + b) == 256 + i for i, (a, b) in enumerate(pairs)) and _plain_byte_level(file):
        import tiktoken

        # merges in the order of their ids are a rank file, for which this encoder is the quicker
        encoding = tiktoken.Encoding(path, pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [_ids(encoding.encode_to_numpy(x, disallowed_special=())) for x in texts], table
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda texts: [_ids(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)], table


def _ids(ids) -> np.ndarray:
    return np.asarray(ids, dtype=np.int32)


def _plain_byte_level(file: dict) -> bool:
    before = file.get("pre_tokenizer") or {}
    return (file.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space")
            and before.get("use_regex", True))


@lru_cache(maxsize=4)
def piece_level(path: str) -> tuple[Encode, list[bytes]]:
    """Encoder and the bytes of each id of a piece vocabulary file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    table = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i)
             else model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size())]
    return lambda texts: [_ids(model.encode(x)) for x in texts], table


def coalesce(start: np.ndarray, end: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the tokens by start (side breaks ties), and the group of each in that order."""
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order])
    first = np.ones(len(order), dtype=bool)
    first[1:] = start[order][1:] >= reach[:-1]
    return order, np.cumsum(first) - 1


def _spans(ids: list[np.ndarray], lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """All ids, the place of each id's text among the texts, and its first and last byte (exclusive)."""
    flat = np.concatenate(ids)
    text = np.repeat(np.arange(len(ids), dtype=np.int32), [len(x) for x in ids])
    end = np.cumsum(lengths[flat], dtype=np.int64)
    return flat, text, end - lengths[flat], end


def align(a_ids: list[np.ndarray], b_ids: list[np.ndarray], a_bytes: list[bytes], b_bytes: list[bytes]) -> list[tuple]:
    """Of each text: n_a, n_b, n_groups, n_links, SHA-256 of the groups, its distinct pairs and their occurrences.

    Both ids of a text must stand for the same bytes.
    """
    n = len(a_ids)
    a, a_text, a_start, a_end = _spans(a_ids, _sizes(tuple(a_bytes)))
    b, b_text, b_start, b_end = _spans(b_ids, _sizes(tuple(b_bytes)))
    side = np.repeat(np.array([0, 1], dtype=np.int8), [len(a), len(b)])
    order, group = coalesce(np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end]), side)
    del a_start, a_end, b_start, b_end
    n_all = int(group[-1]) + 1 if len(group) else 0
    side = side[order]
    group_a, group_b = group[side == 0], group[side == 1]
    in_a, in_b = np.bincount(group_a, minlength=n_all), np.bincount(group_b, minlength=n_all)
    text_of_group = np.empty(n_all, dtype=np.int64)
    text_of_group[group_a] = a_text
    n_links = _sums(text_of_group, in_a * in_b, n)
    n_groups = np.bincount(text_of_group, minlength=n)
    all_pairs = len(a_bytes) * len(b_bytes)
    codes, times = _pairs(a, b, group_a, in_a, in_b, text_of_group, all_pairs, len(b_bytes))
    bounds = np.searchsorted(codes, np.arange(n + 1) * all_pairs).tolist()
    codes %= all_pairs
    written = _written_groups(np.concatenate([a, b])[order], group, side, max(len(a_bytes), len(b_bytes)))
    out, begin = [], 0
    for i in range(n):
        n_a, n_b, (lo, hi) = len(a_ids[i]), len(b_ids[i]), bounds[i:i + 2]
        end = begin + n_a + n_b
        out.append((n_a, n_b, int(n_groups[i]), int(n_links[i]), _digest(written, begin, end, max(len(a_bytes), len(b_bytes))),
                    codes[lo:hi], times[lo:hi]))
        begin = end
    return out


@lru_cache(maxsize=4)
def _sizes(table: tuple[bytes, ...]) -> np.ndarray:
    return np.array([len(x) for x in table], dtype=np.int32)


def _written_groups(ids: np.ndarray, group: np.ndarray, side: np.ndarray, size: int) -> np.ndarray:
    """The ids by group and side, each as its place in ``_with_ends``."""
    shown = np.argsort(2 * group + side, kind="stable")
    kind = (2 * group + side)[shown]
    last = np.ones(len(kind), dtype=bool)
    last[:-1] = kind[1:] != kind[:-1]
    return (ids[shown] + size * np.where(last, 1 + (kind & 1), 0)).astype(np.int32)


@lru_cache(maxsize=2)
def _with_ends(size: int) -> list[bytes]:
    """Each id followed by a comma, then each by a bar, then each by a semicolon."""
    return [b"%d%s" % (i, end) for end in (b",", b"|", b";") for i in range(size)]


def _digest(written: np.ndarray, begin: int, end: int, size: int) -> str:
    """SHA-256 of the groups written out, without the last semicolon; empty without any."""
    if begin == end:
        return ""
    sha, words = hashlib.sha256(), _with_ends(size)
    for at in range(begin, end, 1 << 16):
        some = b"".join(map(words.__getitem__, written[at:min(at + (1 << 16), end)].tolist()))
        sha.update(some if at + (1 << 16) < end else some[:-1])
    return sha.hexdigest()


def _sums(keys: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, dtype=np.int64)
    np.add.at(out, keys, values)
    return out


def _pairs(a, b, group_a, in_a, in_b, text_of_group, all_pairs: int, b_ids: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ``text * all_pairs + a * b_ids + b`` of all links without repeats, and how often each occurs."""
    first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    small = in_a * in_b <= EXPAND
    times_of_a = np.where(small, in_b, 0)[group_a]
    total = int(times_of_a.sum())
    of_a = np.repeat(np.arange(len(a)), times_of_a)
    within = np.arange(total) - np.repeat(np.cumsum(times_of_a) - times_of_a, times_of_a)
    of_b = np.repeat(first_b[group_a], times_of_a) + within
    codes = np.sort(text_of_group[group_a[of_a]] * all_pairs + a[of_a].astype(np.int64) * b_ids + b[of_b])
    first = np.ones(len(codes), dtype=bool)
    first[1:] = codes[1:] != codes[:-1]
    at = np.flatnonzero(first)
    codes, times = codes[at], np.diff(np.append(at, len(codes)))
    for g in np.flatnonzero(~small).tolist():
        x, n_x = np.unique(a[first_a[g]:first_a[g] + in_a[g]], return_counts=True)
        y, n_y = np.unique(b[first_b[g]:first_b[g] + in_b[g]], return_counts=True)
        more = (text_of_group[g] * all_pairs + x[:, None].astype(np.int64) * b_ids + y).ravel()
        codes, inverse = np.unique(np.concatenate([codes, more]), return_inverse=True)
        times = _sums(inverse, np.concatenate([times, np.outer(n_x, n_y).ravel()]), len(codes))
    return codes, times


def _joined(ids: np.ndarray, table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, ids.tolist()))


ENCODED = ("row long, doc_id {id}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "pairs array<long>, times array<long>")


def encoded(docs: DataFrame, a_path: str = BYTE_BPE, b_path: str = PIECE_BPE) -> DataFrame:
    """A row per document: its number, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and its distinct id pairs
    with how often each is linked."""
    source = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    schema = ENCODED.format(id=docs.schema["doc_id"].dataType.simpleString())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (a_encode, a_bytes), (b_encode, b_bytes) = byte_level(a_path), piece_level(b_path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for lo, hi in pieces(texts, CHUNK):
                some = texts[lo:hi]
                a_ids, b_ids = a_encode([" " + x for x in some]), b_encode(some)
                for i, x in enumerate(some):
                    wanted = (" " + x).encode("utf-8", "surrogatepass")
                    if not x or _joined(a_ids[i], a_bytes) != wanted or _joined(b_ids[i], b_bytes) != wanted:
                        a_ids[i] = b_ids[i] = _ids([])
                columns = list(zip(*align(a_ids, b_ids, a_bytes, b_bytes)))
                offsets = pa.array(np.cumsum([0, *map(len, columns[5])]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row")[lo:hi], batch.column("doc_id")[lo:hi],
                     *(pa.array(x, pa.int64()) for x in columns[:4]), pa.array(columns[4], pa.string()),
                     *(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).astype(np.int64))) for x in columns[5:])],
                    names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return source.mapInArrow(encode, schema)


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n: how many documents hold each id pair linked."""
    return rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))


def _level_of(counts: DataFrame, max_broadcast: int) -> int:
    """The least count such that no more than ``max_broadcast`` pairs have it or a higher one."""
    level = F.floor(F.log2("n") * 8)
    found = counts.groupBy(level.alias("level")).agg(F.count("*").alias("pairs"), F.min("n").alias("least")).collect()
    least, held = math.inf, 0
    for r in sorted(found, key=lambda r: -r["level"]):
        held += r["pairs"]
        if held > max_broadcast:
            break
        least = r["least"]
    return least if least < math.inf else 2**62


def aligned(docs: DataFrame, a_path: str = BYTE_BPE, b_path: str = PIECE_BPE, max_broadcast: int = 1 << 19) -> DataFrame:
    """A row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    rows = stored(encoded(docs, a_path, b_path), "alignment")
    counts = stored(pair_counts(rows), "alignment-counts")
    b_ids = len(piece_level(b_path)[1])
    # one row per id of A's vocabulary
    best = counts.groupBy((F.col("pair") / b_ids).cast("long").alias("a")).agg(F.max("n").alias("highest"))
    marked = (counts.withColumn("a", (F.col("pair") / b_ids).cast("long")).join(F.broadcast(best), "a")
              .select("pair", "n", (F.col("n") == F.col("highest")).alias("best")))
    level = _level_of(counts, max_broadcast)
    frequent = F.broadcast(marked.where(F.col("n") >= level))
    held = rows.select("row", F.inline(F.arrays_zip("pairs", "times")).alias("pair", "times"))
    found = held.join(frequent, "pair").unionByName(
        held.join(frequent.select("pair"), "pair", "left_anti").join(marked.where(F.col("n") < level), "pair"))
    sums = found.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
                                    F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return (rows.drop("pairs", "times").join(sums, "row", "left")
            .select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
                    F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256"))


op13 = aligned
