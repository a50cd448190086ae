"""Language-model scores by Katz backoff over words.

A token's probability, given the word before it, is

* for a bigram seen in training: the Good-Turing discounted count over the history's count plus one;
* else the history's backoff weight times the unigram; the weight is what the seen bigrams leave, over what their
  unigrams leave, so each history sums to one exactly;
* unigrams are discounted the same way, and what they leave is the probability of all unseen words together.

Documents are worked off in chunks of a few megabytes. Each task knows the ``vocabulary`` most frequent training words
with their counts. A chunk sends its distinct (bigram, document) pairs, packed, to a bucket, where the counts of all
chunks meet: pairs of frequent words to the bucket of the bigram, others to that of the rare word, so its own count is
known there as well. What depends on a rare history goes on to the history's bucket, where its total and backoff weight
are added up. What returns are sums per document. The size of the vocabulary changes where counts meet, not the scores.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lynceus.llm.common import crc_part, stored
from lynceus.llm.hashing import mix, pieces, word_hashes

#: Codes: all rare words (in counts only), the start of a text (a history only), its end. Frequent words follow.
RARE, START, END, FIRST = 0, 1, 2, 3
#: A rare word's code is its hash with this bit set.
HASHED = np.uint64(1 << 63)
#: Counts up to this one are discounted.
DISCOUNTED = 5
HELD = np.uint32(1 << 31)


def discounts(of_count: np.ndarray) -> np.ndarray:
    """Factor of each count from 0 to DISCOUNTED + 1 (the last: all above) from the numbers of items by count.

    Katz's: (r*/r - m) / (1 - m) with r* = (r + 1) n[r+1] / n[r] and m = (k + 1) n[k+1] / n[1]. Where that is no factor
    between 0 and 1, as in small or odd tables, half a count is taken off instead.
    """
    n = np.asarray(of_count, dtype=float)
    k = DISCOUNTED
    d = np.ones(k + 2)
    m = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    for r in range(1, k + 1):
        good = (r + 1) * n[r + 1] / (n[r] * r) if n[r] else 0.0
        katz = (good - m) / (1 - m) if m < 1 else 0.0
        d[r] = katz if 0 < katz < 1 else (r - 0.5) / r
    return d


def factor(d: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return d[np.minimum(counts, DISCOUNTED + 1).astype(np.int64)]


@dataclass(frozen=True)
class Unigrams:
    """The word level: what a chunk needs of it is bounded by the vocabulary's size."""

    tokens: int
    words: int
    texts: int
    vocabulary: np.ndarray  # hashes, sorted
    counts: np.ndarray  # of the classes
    discount: np.ndarray
    unseen: float  # probability of all unseen words together

    def chances(self) -> np.ndarray:
        """Probability of each class; the rare class holds unseen words too, the start is never predicted."""
        p = factor(self.discount, self.counts) * self.counts / max(1, self.tokens)
        p[RARE] = p[START] = 0.0
        p[RARE] = max(1e-300, 1.0 - p.sum())
        return p

    def history(self) -> np.ndarray:
        """How often each class stands before a token in training."""
        h = self.counts.astype(float)
        h[START], h[END] = self.texts, 0.0
        return h


def _texts(frame: pd.DataFrame) -> list[bytes]:
    return [(x or "").encode("utf-8", "surrogatepass") for x in frame["text"]]


def _chunks(frames: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Runs of documents with about ``most`` characters together."""
    held, size = [], 0
    for frame in frames:
        sizes = frame["text"].str.len().fillna(0).to_numpy()
        start = 0
        for i, n in enumerate(sizes):
            size += int(n)
            if size >= most:
                ready = [pd.concat([*held, frame.iloc[start:i + 1]], ignore_index=True)]
                held, size, start = [], 0, i + 1
                yield ready.pop()  # the texts are the caller's alone
        if start < len(frame):
            held.append(frame.iloc[start:])
    if held:
        yield pd.concat(held, ignore_index=True)


def word_counts(docs: DataFrame, chunk: int) -> DataFrame:
    """word (hash) and n: how often it stands in the training texts, whose ends are not words here."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _chunks(frames, chunk):
            words, n = np.unique(_all_hashes(_texts(frame))[0], return_counts=True)
            yield pd.DataFrame({"word": words.view(np.int64), "n": n})

    return (docs.where("not held_out").select("text").mapInPandas(count, "word long, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


def unigrams(docs: DataFrame, vocabulary: int, chunk: int) -> Unigrams:
    table = stored(word_counts(docs, chunk), "katz-words")
    texts = docs.where("not held_out").count()
    by_count = table.groupBy(F.least("n", F.lit(DISCOUNTED + 1)).alias("r")).agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    of_count, total, words = np.zeros(DISCOUNTED + 2), texts, 0
    for r, k, n in by_count.collect():
        of_count[r] += k
        total += n
        words += k
    exactly = table.where(F.col("n") == DISCOUNTED + 1).count()
    ends = 1 if texts else 0  # the end is one word more
    if ends:
        of_count[min(texts, DISCOUNTED + 1)] += 1
        exactly += texts == DISCOUNTED + 1
    of_count[DISCOUNTED + 1] = exactly
    discount = discounts(of_count)
    top = table.orderBy(F.desc("n"), "word").limit(vocabulary).toPandas()
    hashes = top["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    counts = np.concatenate([[0, 0, texts], top["n"].to_numpy(np.int64)[order]]).astype(np.int64)
    low = table.where(F.col("n") <= DISCOUNTED).groupBy("n").count().collect()
    gone = sum(k * r * (1 - discount[r]) for r, k in low) + (
        texts * (1 - factor(discount, np.array([texts]))[0]) if texts else 0)
    unseen = gone / total if total else 1.0
    if not 0 < unseen <= 1:
        unseen = 1e-9 if total else 1.0
    counts[RARE] = total - counts.sum()
    return Unigrams(int(total), int(words + ends), int(texts), hashes[order], counts, discount, unseen)


def _pack(*arrays: np.ndarray) -> bytes:
    return zlib.compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), 1)


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zlib.decompress(blob)
    n = len(raw) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        size = np.dtype(k).itemsize * n
        out.append(np.frombuffer(raw[at:at + size], dtype=k))
        at += size
    return out


SENT = "kind int, bucket int, chunk long, blob binary, ids array<string>, held array<boolean>"


def _all_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """word_hashes of many texts, some at a time."""
    parts = [word_hashes(texts[i:j]) for i, j in pieces(texts)]
    counts = np.concatenate([np.diff(b) for _, b in parts]) if parts else np.zeros(0, dtype=np.int64)
    words = np.concatenate([h for h, _ in parts]) if parts else np.zeros(0, dtype=np.uint64)
    return words, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _send(docs: DataFrame, known: Unigrams, buckets: int, chunk: int) -> DataFrame:
    """Per chunk: its documents (kind 0), bigrams with a rare word (kind 1) and others (kind 2) with their documents."""
    shared = docs.sparkSession.sparkContext.broadcast(known)
    names = ["kind", "bucket", "chunk", "blob", "ids", "held"]

    def parts(kind: int, number: int, bucket: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple]:
        order = np.argsort(bucket.astype(np.uint16) if 2 * buckets < 65536 else bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(2 * buckets + 1))
        for b in np.flatnonzero(np.diff(edges)):
            at = order[edges[b]:edges[b + 1]]
            yield kind, int(b), number, _pack(*[a[at] for a in arrays]), None, None

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one, nth = shared.value, 0
        for frame in _chunks(frames, chunk):
            number = (TaskContext.get().partitionId() << 32) + nth
            nth += 1
            hashes, begins = _all_hashes(_texts(frame))
            held = frame["held_out"].to_numpy(bool)
            n = np.diff(begins)
            at = np.minimum(np.searchsorted(one.vocabulary, hashes), max(0, len(one.vocabulary) - 1))
            in_vocabulary = one.vocabulary[at] == hashes if len(one.vocabulary) else np.zeros(len(hashes), bool)
            ids = np.where(in_vocabulary, (at + FIRST).astype(np.uint64), hashes | HASHED)
            del hashes, at, in_vocabulary
            names_of = frame["doc_id"].tolist()
            del frame  # the texts; what follows is numbers
            # Each document's tokens with its end after them, and the word before each.
            ends = begins[1:] + np.arange(len(n))
            every = np.full(len(ids) + len(n), END, dtype=np.uint64)
            is_word = np.ones(len(every), dtype=bool)
            is_word[ends] = False
            every[is_word] = ids
            del ids, is_word
            before = np.concatenate([np.array([START], dtype=np.uint64), every[:-1]])
            before[begins[:-1] + np.arange(len(n))] = START
            owner = np.repeat(np.arange(len(n), dtype=np.uint32), n + 1)
            frequent = every < HASHED
            both = frequent & (before < HASHED)
            cells = (before[both] << np.uint64(44)) | (every[both] << np.uint64(24)) | owner[both]
            cells.sort()
            first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])[:len(cells)])
            times = np.diff(np.append(first, len(cells))).astype(np.uint32)
            cells = cells[first]
            pair = cells >> np.uint64(24)
            owners = (cells & np.uint64(0xFFFFFF)).astype(np.uint32)
            del cells, first
            owners |= np.where(held[owners], HELD, np.uint32(0)) if len(owners) else owners
            rows = list(parts(2, number, (mix(pair) % np.uint64(buckets)).astype(np.int64),
                              pair, owners, times))
            del pair, owners, times
            h, w, owners = before[~both], every[~both], owner[~both]
            del before, both
            order = np.lexsort((owners, w, h))
            h, w, owners = h[order], w[order], owners[order]
            new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (w[1:] != w[:-1]) | (owners[1:] != owners[:-1])])
                                 [:len(h)])
            times = np.diff(np.append(new, len(h)))
            h, w, owners = h[new], w[new], owners[new]
            del order, new
            owners |= np.where(held[owners], HELD, np.uint32(0)) if len(owners) else owners
            meets = mix(np.where(w < HASHED, mix(h) + w, w)) % np.uint64(2 * buckets)  # these rows are wider
            rows += parts(1, number, meets.astype(np.int64), h, w, owners, times.astype(np.uint32))
            del h, w, owners, times, meets
            # Known here already: the base scores of frequent words and ends.
            scale = one.tokens + 0.5 * (one.words + 1)
            counts = one.counts[np.where(frequent, every, 0).astype(np.int64)]
            base = np.bincount(owner, np.where(frequent, np.log10((counts + 0.5) / scale), 0.0), len(n))
            seen = np.bincount(owner, frequent & (counts > 0), len(n)).astype(np.int64)
            rows.append((0, number % buckets, number, _pack((n + 1).astype(np.int64), seen, base),
                         names_of, held.tolist()))
            del every, owner, frequent, counts, base, seen
            yield pd.DataFrame(rows, columns=names, dtype=object)
            del rows

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "held_out").mapInPandas(send, SENT)


BACK = "kind int, bucket int, chunk long, blob binary, ids array<string>, held array<boolean>"


def _runs(key: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The arrays' parts of equal key."""
    order = np.argsort(key, kind="stable")
    at, starts = np.unique(key[order], return_index=True)
    for k, a, b in zip(at, starts, np.append(starts[1:], len(order))):
        yield int(k), [x[order[a:b]] for x in arrays]


def _met(sent: DataFrame, known: Unigrams, buckets: int) -> DataFrame:
    """In each bucket the counts of all chunks meet; what returns per chunk are sums per document.

    kind 0: tokens, known tokens and base score; 1: known tokens and base score of rare words; 2: the score of seen
    bigrams before discounts and how many tokens have a bigram of count 1 to DISCOUNTED; 3: unseen bigrams as
    (document, history, times) after the unigram's score; 4: of each frequent history the seen bigrams by count, 5:
    bigrams by count, 6 and 7: the bucket's bigrams and their counts, 8: as 4, of rare histories, 9: tokens after rare
    histories. 4 to 9 have no chunk; 8 and 9 have the bucket of the history.
    """
    shared = sent.sparkSession.sparkContext.broadcast(known)
    names = ["kind", "bucket", "chunk", "blob", "ids", "held"]

    def meet(key, group: pd.DataFrame) -> pd.DataFrame:
        one, kind = shared.value, int(key[0])
        if kind == 0:
            return group[names]
        fields = [_unpack(b, *["u8"] * (3 - kind), "u4", "u4") for b in group["blob"]]
        edges = np.concatenate([[0], np.cumsum([len(f[0]) for f in fields])])
        *codes, owners, times = (np.concatenate([f[i] for f in fields]) for i in range(5 - kind))
        del fields
        if kind == 2:
            found, inverse = np.unique(codes[0], return_inverse=True)
            inverse = inverse.astype(np.int32)
            history, word = found >> np.uint64(20), found & np.uint64(0xFFFFF)
        else:
            order = np.lexsort(codes[::-1])
            h, w = (x[order] for x in codes)
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])])
            history, word = h[new], w[new]
            inverse = np.empty(len(h), dtype=np.int32)
            inverse[order] = np.cumsum(new, dtype=np.int32) - 1
            del h, w, order, new
        del codes
        counts = np.bincount(inverse, times * ((owners & HELD) == 0), len(history)).astype(np.int64)
        docs = owners & ~HELD
        del owners
        rare_word, rare_history = word >= HASHED, history >= HASHED
        chance = one.chances()[np.where(rare_word, 0, word).astype(np.int64)]
        if rare_word.any():  # all tokens of the word are here
            _, of_word = np.unique(word[rare_word], return_inverse=True)
            n = np.bincount(of_word, counts[rare_word]).astype(np.int64)[of_word]
            chance[rare_word] = np.where(n > 0, factor(one.discount, n) * n / max(1, one.tokens), one.unseen)
            count_of_word = np.zeros(len(word), dtype=np.int64)
            count_of_word[rare_word] = n
        frequent_history = np.where(rare_history, 0, history).astype(np.int64)
        total = np.where(rare_history, 1.0, (one.history() + 1.0)[frequent_history])
        per_token = np.where(counts > 0, np.log10(np.maximum(counts, 1)) - np.log10(total), np.log10(chance))
        out: list[tuple] = []
        after = []
        for chunk, a, b in zip(group["chunk"], edges[:-1], edges[1:]):
            pair, doc, t = inverse[a:b], docs[a:b].astype(np.int64), times[a:b].astype(np.int64)
            c = counts[pair]
            at, d = np.unique(doc, return_inverse=True)
            low = [np.bincount(d, (c == r) * t).astype(np.int64) for r in range(1, DISCOUNTED + 1)]
            out.append((2, 0, chunk, _pack(at, np.bincount(d, per_token[pair] * t), *low)))
            new = (c == 0) & ~rare_history[pair]
            if new.any():
                out.append((3, 0, chunk, _pack(doc[new].astype(np.uint32), t[new].astype(np.uint32),
                                               frequent_history[pair[new]].astype(np.uint32))))
            rare = rare_word[pair]
            if rare.any():
                at, d = np.unique(doc[rare], return_inverse=True)
                n = count_of_word[pair[rare]]
                base = np.log10((n + 0.5) / (one.tokens + 0.5 * (one.words + 1))) * t[rare]
                out.append((1, 0, chunk, _pack(at, np.bincount(d, (n > 0) * t[rare]).astype(np.int64), np.bincount(d, base))))
            rare = rare_history[pair]
            if rare.any():
                after.append((history[pair[rare]], np.full(np.count_nonzero(rare), chunk, dtype=np.int64),
                              doc[rare].astype(np.uint32), np.where(c > 0, t, -t)[rare].astype(np.int32)))
        del inverse, docs, times
        own = counts > 0
        r = np.minimum(counts, DISCOUNTED + 1)

        def sums(rows: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
            items, d = np.unique(at[rows], return_inverse=True)
            by = [np.bincount(d, counts[rows] * (r[rows] == k), len(items)) for k in range(1, DISCOUNTED + 2)]
            return [items, np.bincount(d, chance[rows], len(items)), *by]

        items, *rest = sums(own & ~rare_history, frequent_history)
        out.append((4, 0, -1, _pack(items.astype(np.int64), *rest)))
        out.append((5, 0, -1, _pack(np.bincount(np.minimum(counts[own], DISCOUNTED + 2),
                                                minlength=DISCOUNTED + 3).astype(np.int64))))
        if kind == 2:
            out.append((6, 0, -1, _pack(found[own], counts[own])))
        else:
            out.append((7, 0, -1, _pack(history[own], word[own], counts[own])))
            bucket = lambda x: (mix(x) % np.uint64(buckets)).astype(np.int64)
            items, *rest = sums(own & rare_history, history)
            out += [(8, k, -1, _pack(*x)) for k, x in _runs(bucket(items), items, *rest)]
            if after:
                fields = [np.concatenate(x) for x in zip(*after)]
                out += [(9, k, -1, _pack(*x)) for k, x in _runs(bucket(fields[0]), *fields)]
        return pd.DataFrame([(*x, None, None) for x in out], columns=names, dtype=object)

    return sent.groupBy("kind", "bucket").applyInPandas(meet, BACK)


def backoff(back: DataFrame, known: Unigrams) -> tuple[np.ndarray, np.ndarray]:
    """Discount factors of bigrams and the log10 backoff weight of each history.

    Sums over histories are taken on the cluster; one number per class and count reaches the driver.
    """

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = len(known.counts)
        sums, used = np.zeros((DISCOUNTED + 2, size)), False
        for frame in frames:
            for blob in frame["blob"]:
                at, *rest = _unpack(blob, "i8", *["f8"] * (DISCOUNTED + 2))
                for k, x in enumerate(rest):
                    sums[k, at] += x
                used = True
        if used:
            at = np.flatnonzero(sums.any(axis=0))
            yield pd.DataFrame({"h": at, **{f"s{k}": sums[k, at] for k in range(DISCOUNTED + 2)}})

    names = [f"s{k}" for k in range(DISCOUNTED + 2)]
    rows = (back.where("kind = 4").select("blob").mapInPandas(add, "h long, " + ", ".join(f"{s} double" for s in names))
            .groupBy("h").agg(*[F.sum(s).alias(s) for s in names])).toPandas()
    of_count = np.zeros(DISCOUNTED + 3)
    for (blob,) in back.where("kind = 5").select("blob").toLocalIterator():
        of_count += _unpack(blob, "i8")[0]
    d = discounts(of_count[:DISCOUNTED + 2])
    total = known.history() + 1.0
    kept, common = np.zeros(len(total)), np.zeros(len(total))
    h = rows["h"].to_numpy(np.int64)
    common[h] = rows["s0"]
    kept[h] = sum(d[k] * rows[f"s{k}"].to_numpy() for k in range(1, DISCOUNTED + 2))
    return d, np.log10((1 - kept / total) / np.maximum(1e-300, 1 - common))


def _settled(back: DataFrame, d: np.ndarray) -> DataFrame:
    """kind 10: per chunk and document, the score that tokens have by their rare history's total or backoff weight."""

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        kinds = group["kind"].to_numpy()
        own = [_unpack(b, "u8", *["f8"] * (DISCOUNTED + 2)) for b in group["blob"][kinds == 8]]
        after = [_unpack(b, "u8", "i8", "u4", "i4") for b in group["blob"][kinds == 9]]
        names, out = ["kind", "bucket", "chunk", "blob", "ids", "held"], []
        if after:
            h, chunks, docs, signs = (np.concatenate([x[i] for x in after]) for i in range(4))
            items, inverse = np.unique(h, return_inverse=True)
            sums = np.zeros((DISCOUNTED + 2, len(items)))  # histories without any are unseen
            for x in own:
                at = np.searchsorted(items, x[0])  # each is there: tokens after it are
                for k in range(DISCOUNTED + 2):
                    sums[k, at] += x[k + 1]
            total = sums[1:].sum(axis=0) + 1.0
            kept = sum(d[k] * sums[k] for k in range(1, DISCOUNTED + 2))
            weight = np.log10((1 - kept / total) / np.maximum(1e-300, 1 - sums[0]))
            score = np.where(signs > 0, -np.log10(total)[inverse], weight[inverse]) * np.abs(signs.astype(np.int64))
            for chunk, (x, y) in _runs(chunks, docs, score):
                at, which = np.unique(x, return_inverse=True)
                out.append((10, 0, chunk, _pack(at.astype(np.int64), np.bincount(which, y)), None, None))
        return pd.DataFrame(out, columns=names, dtype=object)

    return back.where("kind in (8, 9)").groupBy("bucket").applyInPandas(settle, BACK)


def _gathered(back: DataFrame, d: np.ndarray, weights: np.ndarray) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score and score of every document, chunk by chunk."""
    shared = back.sparkSession.sparkContext.broadcast((d, weights))

    def gather(key, group: pd.DataFrame) -> pd.DataFrame:
        factors, alpha = shared.value
        first = group[group["kind"] == 0].iloc[0]
        tokens, seen, base = (x.copy() for x in _unpack(first["blob"], "i8", "i8", "f8"))
        score = np.zeros(len(tokens))
        for kind, blob in zip(group["kind"], group["blob"]):
            if kind == 1:
                at, k, b = _unpack(blob, "i8", "i8", "f8")
                seen[at] += k
                base[at] += b
            elif kind == 2:
                at, s, *low = _unpack(blob, "i8", "f8", *["i8"] * DISCOUNTED)
                score[at] += s + sum(n * np.log10(factors[r]) for r, n in enumerate(low, 1))
            elif kind == 3:
                at, n, h = _unpack(blob, "u4", "u4", "u4")
                np.add.at(score, at, alpha[h] * n)
            elif kind == 10:
                at, s = _unpack(blob, "i8", "f8")
                score[at] += s
        return pd.DataFrame({"doc_id": list(first["ids"]), "held_out": list(first["held"]), "n_tokens": tokens,
                             "n_known": seen, "base_score": base, "score": score})

    return back.where("chunk >= 0").unionByName(_settled(back, d)).groupBy("chunk").applyInPandas(
        gather, "doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def katz_scores(docs: DataFrame, vocabulary: int = 65_536, chunk: int = 8_000_000, bucket_tokens: int = 4_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    ``docs`` has doc_id, text and held_out; held-out rows teach nothing. A null or empty text is its end alone, a null
    doc_id stays null, repeated rows are rows of their own; without training rows every token is unseen. ``vocabulary``
    (at most 1,000,000) bounds what each task holds, not which words and bigrams are counted. ``docs`` is read
    twice and must hold the same rows both times, as a table does.
    """
    if vocabulary > 1_000_000:
        raise ValueError("a vocabulary has at most 1,000,000 words")
    docs = docs.select("doc_id", "text", "held_out")
    known = unigrams(docs, vocabulary, chunk)
    buckets = max(16, -(-known.tokens * 5 // (4 * bucket_tokens)))
    back = stored(_met(_send(docs, known, buckets, chunk), known, buckets), "katz-sums", ["kind"])
    return (_gathered(back, *backoff(back, known)).withColumn("doc_id", F.col("doc_id").cast(dict(docs.dtypes)["doc_id"]))
            .withColumn("train_tokens", F.lit(known.tokens).cast("long")))


def op1(docs: DataFrame) -> DataFrame:
    """The contract's columns, one row per row of ``docs``."""
    return katz_scores(docs.select("doc_id", "text", (crc_part(F.col("doc_id"), 5) == 1).alias("held_out")))
