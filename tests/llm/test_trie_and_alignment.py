"""Prefix trie and token alignment against brute force, on small, odd and empty tables."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lynceus.llm import alignment, prefix_trie
from lynceus.llm.oracles import ORACLES
from workload.check import connect, spark_rows, sql_rows

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def shared(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    return spark


# ---- prefix trie ----

def trie(rows):
    """Every prefix of every rebuilt conversation in a dictionary."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            order = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            turns[conv].append((turn is not None, turn or 0, order, (role, text)))
    turns = {c: [x[3] for x in sorted(v, key=lambda x: x[:3])] for c, v in turns.items()}
    whole = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(turns.get(c - int(math.fmod(c, 5)), [])[:h] + turns[c][h:])
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    children, leaves, saved = Counter(x[:-1] for x in members if x), Counter(), Counter()
    for x, convs in members.items():
        for d in range(len(x) + 1):
            leaves[x[:d]] += x not in children
            saved[x[:d]] += (len(convs) - 1) * len(x[-1][1].encode()) if x else 0
    return sorted((convs[0], len(x), members[x[:-1]][0] if x else None, len(convs), children[x], leaves[x], saved[x],
                   hashlib.sha256(",".join(str(c) for c in convs if whole[c] == x).encode()).hexdigest())
                  for x, convs in members.items())


def trie_of(spark, rows, **options):
    df = spark.createDataFrame(rows, TURNS).select("*", *(F.lit(1).alias(c) for c in ("conv", "part", "d", "n", "kind")))
    return sorted(tuple(r) for r in prefix_trie.prefix_trie(df, **options).collect())


def conversations(n=60, longest=6, seed=1, first=0):
    """Few different turns, so that prefixes are shared and branch."""
    r = random.Random(seed)
    return [(first + 3 * c, t, r.choice(["user", "assistant"]), r.choice(["a", "bb", "ccé", ""]))
            for c in range(n) for t in range(r.randint(1, longest))]


def test_trie_of_odd_rows(shared):
    rows = [(10, None, None, "x"), (10, 1, "user", None), (10, 1, "user", None), (10, 1, "user", "tie"), (10, 1, "user", "other"),
            (None, 1, "user", "lost"), (11, 5, "user", "x"), (-3, 1, "u", "x"), (-5, 1, "u", "x"), (-5, 0, "v", "x"),
            (15, 1, "u", "x" * 2_000_000), (16, 1, "u", "x" * 2_000_000), (2**62, 1, "u", "x"), (12, 1, "1:u", "x"), (13, 1, "1", ":ux")]
    assert trie_of(shared, rows) == trie(rows)
    assert trie_of(shared, [(None, 1, "u", "x")]) == [] == trie_of(shared, [])


def test_trie_by_brute_force(shared):
    rows = conversations()
    assert trie_of(shared, rows) == trie(rows)


def test_trie_with_hot_keys_over_many_blocks(shared):
    """A conversation with a third of the rows, many equal conversations, one first turn, and every head by random mates."""
    rows = conversations(150, first=20_000) + [(40, t, "user", f"{t % 3}") for t in range(700)]
    rows += [(c, t, "user", "same") for c in range(100, 400, 5) for t in range(4)]
    rows += [(c, 0, "user", "start") for c in range(1000, 1300)] + [(c, 1, "user", str(c)) for c in range(1000, 1300)]
    rows += [(c, 0, "u", "x") for c in range(5000, 5060)]  # with few turns of their own behind absent heads
    random.Random(2).shuffle(rows)
    before = {k: shared.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        shared.conf.set("spark.sql.shuffle.partitions", "13")
        shared.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert trie_of(shared, rows, most_heads=8) == trie(rows)
    finally:
        for k, v in before.items():
            shared.conf.set(k, v)


def test_lists_are_ranked(shared):
    """One list in random order, with weights, by rounds of random mates and by one task."""
    order = list(range(200))
    random.Random(4).shuffle(order)
    rows = [(a, b, 1, a % 3, a) for a, b in zip(order, [*order[1:], None])]
    df = shared.createDataFrame(rows, "id long, next long, rank long, leaves long, saved long")
    want, upto = {}, (0, 0, 0)
    for a in order:
        want[a] = upto
        upto = (upto[0] + 1, upto[1] + a % 3, upto[2] + a)
    for most in (5, 1000):
        assert {r["id"]: (r["rank"], r["leaves"], r["saved"]) for r in prefix_trie.list_ranks(df, most).collect()} == want


def test_trie_query_against_sql(shared):
    assert spark_rows(entry.queries()["op11_prefix_trie"](shared, SF)) == sql_rows(connect(SF), ORACLES["op11_prefix_trie"])


# ---- token alignment ----

@lru_cache
def reference_tokenizer():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(alignment.BYTE_BPE)
    tokenizer.encode_special_tokens = True
    return tokenizer


def tokens(text):
    """Ids of both vocabularies, by the vocabularies' own libraries, or nothing if the bytes differ."""
    a_tokenizer = reference_tokenizer()
    a_bytes, (b_encode, b_bytes) = alignment.byte_level(alignment.BYTE_BPE)[1], alignment.piece_level(alignment.PIECE_BPE)
    a, b = a_tokenizer.encode(" " + text, add_special_tokens=False).ids, b_encode([text])[0].tolist()
    whole = (" " + text).encode()
    if not text or b"".join(a_bytes[i] for i in a) != whole or b"".join(b_bytes[i] for i in b) != whole:
        return None
    return [(i, len(a_bytes[i])) for i in a], [(i, len(b_bytes[i])) for i in b]


def groups_of(a, b):
    def ends(ids):
        return np.cumsum([n for _, n in ids]).tolist()

    cuts = np.array(sorted(set(ends(a)) & set(ends(b))))
    out = [([], []) for _ in cuts]
    for side, ids in enumerate((a, b)):
        for (i, _), end in zip(ids, ends(ids)):
            out[np.searchsorted(cuts, end)][side].append(i)
    return out


def aligned(rows):
    found, counts = [], Counter()
    for _, text in rows:
        both = tokens(text or "")
        groups = groups_of(*both) if both else []
        links = [(a, b) for x, y in groups for a in x for b in y]
        counts.update(set(links))
        found.append((both, groups, links))
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    out = []
    for (doc_id, _), (both, groups, links) in zip(rows, found):
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, len(both[0]) if both else 0, len(both[1]) if both else 0, len(groups), len(links),
                    sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links),
                    hashlib.sha256(written.encode()).hexdigest() if both else ""))
    return sorted(out, key=str)


TEXTS = ["", None, "x", " leading", "two  blanks \n\n\t tabs\r\n", "<|endoftext|> <s> </s> <unk> <0x0A>", "▁ low line", "naïve café",
         "日本語のテキスト", "\U0001F600\U0001F468‍\U0001F469", "a\x00b\x01", "ﬁ ligature é", "1234567890" * 5, "the the the",
         "supercalifragilisticexpialidocious", "def f(x):\n    return x+1\n", "x" * 5000, " " * 3000, "\n" * 200,
         "http://example.com/a?b=c&d=%20", "the quick brown fox", "the quick brown fox", "ÀÉÎ õß ŒÆ Ω≈ç√"]


def test_alignment_of_odd_rows(shared):
    rows = [(i % 19 or None, t) for i, t in enumerate(TEXTS)] + [(3, "the quick brown fox")] * 2 + [(8, "word " * 20_000)]
    df = shared.createDataFrame(rows, DOCS).select("*", *(F.lit(1).alias(c) for c in ("row", "pair", "n", "a", "best")))
    got = sorted((tuple(r) for r in alignment.op13(df).collect()), key=str)
    assert got == aligned(rows)
    assert alignment.op13(shared.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("most", [0, 50])
def test_alignment_with_rare_pairs_joined(shared, most):
    r = random.Random(8)
    words = ["alpha", "beta", "Gamma", "δέλτα", "x1", "...", "running", "unhappiness", "\n"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 30)))) for i in range(60)]
    got = alignment.aligned(shared.createDataFrame(rows, DOCS), max_broadcast=most).collect()
    assert sorted((tuple(x) for x in got), key=str) == aligned(rows)


def test_large_groups_are_expanded_over_distinct_ids(monkeypatch):
    a_bytes, b_bytes = [b"ab", b"a", b"b"], [b"a", b"ba", b"b"]
    a, b = np.array([0] * 90, np.int32), np.array([0] + [1] * 89 + [2], np.int32)
    want = alignment.align([a, a], [b, b], a_bytes, b_bytes)
    assert want[0][:4] == (90, 91, 1, 90 * 91)
    assert dict(zip(want[0][5].tolist(), want[0][6].tolist())) == {0: 90, 1: 90 * 89, 2: 90}
    monkeypatch.setattr(alignment, "EXPAND", 10**9)
    for x, y in zip(want, alignment.align([a, a], [b, b], a_bytes, b_bytes)):
        assert x[:5] == y[:5] and x[5].tolist() == y[5].tolist() and x[6].tolist() == y[6].tolist()


def test_alignment_query_by_brute_force(shared):
    rows = [tuple(r) for r in shared.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = entry.queries()["op13_token_alignment"](shared, SF).collect()
    assert sorted((tuple(r) for r in got), key=str) == aligned(rows)
