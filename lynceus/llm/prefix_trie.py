"""Prefix trie of rebuilt conversations by the Euler-tour technique.

A node is a distinct sequence of first turns; it is named by its smallest member and its depth, which no other node
shares. Sequences meet by 128-bit sums of hashes of (place, turn), so prefixes are running sums.

Each node has an enter and an exit arc. The tour enters a node, tours its children in the order of their smallest
members and exits: a node's first child continues its smallest member, if that has a further turn, and a conversation
branches off as smallest member of its own nodes once only, so what a node needs to know of its children and siblings
is a row per conversation. List ranking is done in three steps. Arcs are dealt by (conversation, depth) into blocks, in
which chains of successors are ranked by pointer jumping in numpy and shrink to their heads. While more than
``most_heads`` heads are left, rounds of random mates splice out a quarter of them. The last ones are ranked in one task, and
the spliced-out ones get their places back round by round. What is summed along the tour is the rank, the leaves and
the savings; a subtree's sums are the difference between its exit and its enter arc.

Long conversations, frequent first turns and frequent whole conversations are spread: turns are dealt by range, and what
crosses partitions is one row per conversation and partition. No group holds a whole conversation or all its copies.

Defined results: rows without a conv_id belong to no conversation and are left out; turns are ordered by number (null
first), turns of equal number by the MD5 of role and text; repeated rows are turns of their own. Null role or text is empty.
``%`` has the sign of its left side. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lynceus.llm.common import spread_join, stored

#: Turns of the conversation in front that may be taken over, at most.
HEAD = 8
EMPTY = hashlib.sha256(b"").hexdigest()
SUMS = ["a_low", "a_high", "b_low", "b_high"]


# ---- rebuilt conversations ----

def _placed(conversations: DataFrame) -> DataFrame:
    """conv, part, at (place among its conversation's rows in its part), digest, bytes."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn",
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"), F.monotonically_increasing_id().alias("tie"))
    order = [F.col("turn").asc_nulls_first(), "digest", "tie"]
    dealt = turns.repartitionByRange("conv", *order).withColumn("part", F.spark_partition_id())
    at = F.row_number().over(Window.partitionBy("conv", "part").orderBy(*order)).cast("long")
    return stored(dealt.select("conv", "part", at.alias("at"), "digest", "bytes"), "trie-turns")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations (conv, part, d, digest, bytes) and the conversations (conv, length)."""
    turns = _placed(conversations)
    of_conv = Window.partitionBy("conv")
    before = of_conv.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (turns.groupBy("conv", "part").agg(F.count("*").alias("n"))
             .select("conv", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), "n"))
    heads = (turns.where(F.col("at") <= HEAD).join(parts, ["conv", "part"]).withColumn("pos", F.col("at") + F.col("offset"))
             .where(F.col("pos") <= HEAD).groupBy("conv")
             .agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "bytes"))).alias("head")))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % (HEAD + 1)
    convs = (parts.groupBy("conv").agg(F.sum("n").alias("n")).withColumn("h", h)
             .withColumn("source", F.col("conv") - F.col("conv") % 5)
             .join(heads.withColumnRenamed("conv", "source"), "source", "left")
             .withColumn("head", F.slice(F.coalesce("head", F.array()), F.lit(1), F.col("h").cast("int")))
             .withColumn("taken", F.size("head").cast("long"))
             .withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
             .select("conv", "h", "taken", "length", "head"))
    convs = stored(convs, "trie-conversations")
    where = parts.drop("n").join(convs.drop("head", "length"), "conv")
    pos = F.col("at") + F.col("offset")
    own = (turns.join(where, ["conv", "part"]).where(pos > F.col("h"))
           .select("conv", "part", (pos - F.col("h") + F.col("taken")).alias("d"), "digest", "bytes"))
    taken = (convs.select("conv", F.lit(-1).alias("part"), F.posexplode("head").alias("d", "x"))
             .select("conv", "part", (F.col("d") + 1).cast("long").alias("d"), "x.digest", "x.bytes"))
    return stored(own.unionByName(taken), "trie-rebuilt"), convs.select("conv", "length")


# ---- nodes ----

def _words(value: Column) -> list[Column]:
    return [value.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(value, 32)]


def _key(sums: list[Column]) -> list[Column]:
    """Two longs of four sums of 32-bit words, each sum modulo 2**32."""
    low = [s.bitwiseAND(0xFFFFFFFF) for s in sums]
    return [F.shiftleft(low[i + 1], 32).bitwiseOR(low[i]) for i in (0, 2)]


def _hashed(turns: DataFrame) -> DataFrame:
    """The turns with the four words of the hash of each, by place and content."""
    words = _words(F.xxhash64("d", "digest")) + _words(F.xxhash64(F.lit(1), "digest", "d"))
    return turns.select("conv", "part", "d", "bytes", *(w.alias(s) for w, s in zip(words, SUMS)))


def nodes(turns: DataFrame) -> DataFrame:
    """d, k1, k2 (the sequence), p1, p2 (the sequence without its last turn), conv (smallest member), n (members), bytes."""
    hashed = _hashed(turns)
    here = Window.partitionBy("conv", "part").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = (hashed.groupBy("conv", "part").agg(*(F.sum(s).alias(s) for s in SUMS))
               .select("conv", "part", *(F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"{s}_before") for s in SUMS)))
    upto = [F.col(f"{s}_here") + F.col(f"{s}_before") for s in SUMS]
    without = [u - F.col(s) for u, s in zip(upto, SUMS)]
    (k1, k2), (p1, p2) = _key(upto), _key(without)
    rows = (hashed.select("*", *(F.sum(s).over(here).alias(f"{s}_here") for s in SUMS)).join(carried, ["conv", "part"])
            .select("d", k1.alias("k1"), k2.alias("k2"), p1.alias("p1"), p2.alias("p2"), "conv", "bytes"))
    found = rows.groupBy("d", "k1", "k2").agg(
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("conv").alias("conv"), F.count("*").alias("n"),
        F.min("bytes").alias("bytes"))
    return stored(found, "trie-nodes")


def _ends(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """d, k1, k2, ends: the SHA-256 of the ids of the conversations that end at each sequence, in order."""
    k1, k2 = _key([F.coalesce(F.sum(s), F.lit(0)) for s in SUMS])
    whole = _hashed(turns).groupBy("conv").agg(k1.alias("k1"), k2.alias("k2"), F.max("d").alias("d"))
    turnless = convs.where("length = 0").select("conv", *(F.lit(0).cast("long").alias(c) for c in ("k1", "k2", "d")))
    key = ["d", "k1", "k2"]
    dealt = whole.unionByName(turnless).repartitionByRange(*key, "conv").withColumn("part", F.spark_partition_id())
    pieces = dealt.groupBy(*key, "part").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, sha = None, None
        for frame in frames:
            out = []
            for d, k1, k2, ids in zip(frame["d"], frame["k1"], frame["k2"], frame["ids"]):
                if now == (d, k1, k2):
                    sha.update(b",")
                else:
                    if now is not None:
                        out.append((*now, sha.hexdigest()))
                    now, sha = (d, k1, k2), hashlib.sha256()
                sha.update(ids.encode())
            yield pd.DataFrame(out, columns=[*key, "ends"])
        if now is not None:
            yield pd.DataFrame([(*now, sha.hexdigest())], columns=[*key, "ends"])

    return (pieces.repartition(*key).sortWithinPartitions(*key, "part").select(*key, "ids")
            .mapInPandas(digest, "d long, k1 long, k2 long, ends string"))


def _with_parents(found: DataFrame, ends: DataFrame, first: int) -> DataFrame:
    """kind 0: a node with its parent's conv, n, bytes; kind 5: the node (conv, d) at which conversations end, with ends."""
    none = F.lit(None)
    top = found.where("d = 1").select(F.lit(0).alias("kind"), "conv", "d", F.lit(first).cast("long").alias("parent"), "n",
                                      "bytes", none.cast("string").alias("ends"))
    children = found.where("d > 1").select(
        (F.col("d") - 1).alias("at"), F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.lit(0).alias("kind"), "conv", "d", "n",
        "bytes", none.cast("string").alias("ends"))
    ending = ends.where("d > 0").select(
        F.col("d").alias("at"), "k1", "k2", F.lit(5).alias("kind"), none.cast("long").alias("conv"), "d",
        none.cast("long").alias("n"), none.cast("long").alias("bytes"), "ends")
    named = found.select(F.col("d").alias("at"), "k1", "k2", F.col("conv").alias("parent"))
    met = spread_join(children.unionByName(ending), named, ["at", "k1", "k2"])
    return stored(met.select(top.columns).unionByName(top), "trie-parents")


def _siblings(branches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The next sibling of each branch (conv, d, next), and per parent (parent, d) the first branch and their number."""
    dealt = stored(branches.repartitionByRange("parent", "d", "conv").withColumn("part", F.spark_partition_id()), "trie-branches")
    group = ["parent", "d"]
    parts = dealt.groupBy(*group, "part").agg(F.min("conv").alias("first"), F.count("*").alias("n"))
    beyond = F.lead("first").over(Window.partitionBy(*group).orderBy("part"))
    inside = F.lead("conv").over(Window.partitionBy(*group, "part").orderBy("conv"))
    following = (dealt.withColumn("next", inside).join(parts.select(*group, "part", beyond.alias("beyond")), [*group, "part"])
                 .select("conv", "d", F.coalesce("next", "beyond").alias("next")).where("next is not null"))
    return following, parts.groupBy(*group).agg(F.min("first").alias("first"), F.sum("n").alias("n"))


# ---- the tour ----

def _chains(after: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each element of lists (``after``: the next one or -1): the first of its list and the weights up to before it."""
    n = len(after)
    before = np.arange(n)
    has = after >= 0
    before[after[has]] = np.flatnonzero(has)
    upto = np.where((before != np.arange(n))[:, None], weights[before], 0)
    while True:
        further = before[before]
        if np.array_equal(further, before):
            return before, upto
        upto = upto + upto[before]
        before = further


LOCAL = ("kind int, conv long, d long, side int, parent long, n long, n_children long, ends string, enter_head long, "
         "enter_leaves long, enter_saved long, exit_head long, exit_leaves long, exit_saved long, id long, "
         "next_conv long, next_d long, next_side int, rank long, leaves long, saved long")
LOCAL_NAMES = [x.split(" ")[0] for x in LOCAL.split(", ")]
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
LOCAL_SCHEMA = pa.schema([(x.split(" ")[0], _ARROW[x.split(" ")[1]]) for x in LOCAL.split(", ")])


def _block(table: pa.Table, block: int) -> Iterator[pa.RecordBatch]:
    """Nodes of a block (kind 0) with the chain heads of their arcs, and these heads (kind 1) with the chain after them.

    ``table`` is sorted by conv, d and kind: 0 a node, 1 a conversation ends here, 2 the first branch and the number of
    branches, 3 the first branch of the parent, 4 the next sibling, 5 the conversations that end here. Rows of kind 1 to
    5 whose conversation is not the node's smallest member have no node and fall out.
    """
    whole = {c: table.column(c).combine_chunks() for c in table.column_names}
    conv, d, kind = (whole[c].to_numpy(zero_copy_only=False) for c in ("conv", "d", "kind"))
    x, y, n, size = (whole[c].fill_null(0).to_numpy(zero_copy_only=False) for c in ("x", "y", "n", "bytes"))
    rows = len(conv)
    new = np.ones(rows, dtype=bool)
    new[1:] = (conv[1:] != conv[:-1]) | (d[1:] != d[:-1])
    key = np.cumsum(new) - 1
    at = np.flatnonzero(kind == 0)
    m = len(at)
    if not m:
        return
    of_key = np.full(key[-1] + 1, -1)
    of_key[key[at]] = np.arange(m)
    node = of_key[key]

    def told(k: int) -> tuple[np.ndarray, np.ndarray]:
        some = np.flatnonzero((kind == k) & (node >= 0))
        return node[some], some

    c, depth, parent = conv[at], d[at], x[at]
    root = np.flatnonzero(whole["x"].is_null().to_numpy(zero_copy_only=False)[at])
    ended = np.zeros(m, dtype=bool)
    ended[told(1)[0]] = True
    branch, branches, following = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64)
    has_next = np.zeros(m, dtype=bool)
    to, by = told(2)
    branch[to], branches[to] = x[by], y[by]
    for k in (3, 4):
        to, by = told(k)
        following[to], has_next[to] = x[by], True
    children = branches + ~ended
    leaf = children == 0

    # successors of the enter arcs, then of the exit arcs
    goes_on, branches_off = ~ended, ended & (branches > 0)
    next_conv = np.concatenate([np.where(goes_on | leaf, c, branch), np.where(has_next, following, parent)])
    next_d = np.concatenate([np.where(leaf, depth, depth + 1), np.where(has_next, depth, depth - 1)])
    next_side = np.concatenate([np.where(goes_on | branches_off, 0, 1), np.where(has_next, 0, 1)])
    names = np.unique(c)
    span = int(max(depth.max(), next_d.max())) + 2
    mine = np.searchsorted(names, c) * span + depth
    name = np.minimum(np.searchsorted(names, next_conv), len(names) - 1)
    wanted = name * span + next_d
    spot = np.minimum(np.searchsorted(mine, wanted), m - 1)
    here = (names[name] == next_conv) & (next_d >= 0) & (mine[spot] == wanted)
    after = np.where(here, spot + next_side * m, -1)
    after[root + m] = -1
    next_d[root + m] = -1

    weights = np.ones((2 * m, 3), dtype=np.int64)
    weights[:, 1:] = 0
    weights[:m, 1], weights[:m, 2] = leaf, (n[at] - 1) * size[at]
    head, upto = _chains(after, weights)
    base = block << 40
    ends = [None] * m
    to, by = told(5)
    texts = whole["ends"].take(pa.array(by)).to_pylist()
    for i, t in zip(to.tolist(), texts):
        ends[i] = t
    yield from _batches({
        "kind": np.zeros(m, np.int32), "conv": c, "d": depth, "n": n[at], "n_children": children, "ends": ends,
        "parent": pa.array(parent, mask=np.isin(np.arange(m), root)),
        "enter_head": base + head[:m], "enter_leaves": upto[:m, 1], "enter_saved": upto[:m, 2],
        "exit_head": base + head[m:], "exit_leaves": upto[m:, 1], "exit_saved": upto[m:, 2]}, m)
    tails = np.flatnonzero(after < 0)
    heads = head[tails]
    total = upto[tails] + weights[tails]
    last = next_d[tails] < 0
    yield from _batches({
        "kind": np.ones(len(tails), np.int32), "id": base + heads, "conv": np.concatenate([c, c])[heads],
        "d": np.concatenate([depth, depth])[heads], "side": (heads >= m).astype(np.int32),
        "next_conv": pa.array(next_conv[tails], mask=last), "next_d": pa.array(next_d[tails], mask=last),
        "next_side": pa.array(next_side[tails].astype(np.int32), mask=last),
        "rank": total[:, 0], "leaves": total[:, 1], "saved": total[:, 2]}, len(tails))


def _batches(columns: dict, rows: int) -> Iterator[pa.RecordBatch]:
    arrays = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in LOCAL_SCHEMA]
    yield from pa.Table.from_arrays(arrays, schema=LOCAL_SCHEMA).to_batches(max_chunksize=1 << 16)


def _toured(rows: DataFrame) -> DataFrame:
    """Ranks the arcs within blocks; see ``_block``."""
    def tour(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)
        if found:
            yield from _block(pa.Table.from_batches(found), TaskContext.get().partitionId())

    dealt = rows.repartitionByRange("conv", "d").sortWithinPartitions("conv", "d", "kind")
    return stored(dealt.mapInArrow(tour, LOCAL), "trie-tour", ["kind"])


WEIGHTS = ["rank", "leaves", "saved"]


def list_ranks(heads: DataFrame, most_heads: int) -> DataFrame:
    """id, rank, leaves, saved: the weights in front of each element of one list (id, next or null, weights)."""
    now, rounds = heads, []
    while now.count() > most_heads:
        def coin(c: str) -> Column:
            return F.xxhash64(F.col(c), F.lit(len(rounds))).bitwiseAND(1)

        # heads absorb the tails that follow them
        tails = now.select(F.col("id").alias("next"), F.col("next").alias("beyond"), *(F.col(w).alias(f"{w}_of") for w in WEIGHTS),
                           F.lit(True).alias("met")).where(coin("next") == 0)
        pairs = stored(now.withColumn("seek", F.when(coin("id") == 1, F.col("next")))
                       .join(tails.withColumnRenamed("next", "seek"), "seek", "left"), "trie-mates")
        gone = pairs.where("met").select(F.col("seek").alias("id"), F.col("id").alias("into"), *WEIGHTS)
        grown = [(F.col(w) + F.coalesce(f"{w}_of", F.lit(0))).alias(w) for w in WEIGHTS]
        rounds.append(gone)
        now = stored(pairs.select("id", F.when(F.col("met"), F.col("beyond")).otherwise(F.col("next")).alias("next"), *grown)
                     .join(gone.select("id"), "id", "left_anti"), "trie-list")

    def rank(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(frames, ignore_index=True)
        index = pd.Index(rows["id"])
        after = index.get_indexer(rows["next"].fillna(-1).astype("int64"))
        _, upto = _chains(after, rows[WEIGHTS].to_numpy(np.int64))
        yield pd.concat([rows["id"], pd.DataFrame(upto, columns=WEIGHTS)], axis=1)

    places = stored(now.repartition(1).mapInPandas(rank, "id long, rank long, leaves long, saved long"), "trie-places")
    for gone in reversed(rounds):
        known = places.select(F.col("id").alias("into"), *(F.col(w).alias(f"{w}_to") for w in WEIGHTS))
        back = gone.join(known, "into").select("id", *((F.col(w) + F.col(f"{w}_to")).alias(w) for w in WEIGHTS))
        places = stored(places.unionByName(back), "trie-places")
    return places


def prefix_trie(conversations: DataFrame, most_heads: int = 1 << 14) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    schema = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
              "saved_tokens long, ends_sha256 string")
    turns, convs = rebuilt(conversations)
    root = convs.agg(F.min("conv").alias("first"), F.count("*").alias("n")).first()
    if not root["n"]:
        return conversations.sparkSession.createDataFrame([], schema)
    ends = stored(_ends(turns, convs), "trie-ends")
    found = _with_parents(nodes(turns), ends, root["first"])
    following, first = _siblings(found.where("kind = 0 and parent <> conv").select("parent", "d", "conv"))
    none = F.lit(None)

    def told(rows: DataFrame, kind: int, **columns) -> DataFrame:
        given = {"x": none, "y": none, "n": none, "bytes": none, "ends": none} | columns
        return rows.select("conv", F.col("d").cast("long").alias("d"), F.lit(kind).alias("kind"),
                           *(given[c].cast("string" if c == "ends" else "long").alias(c) for c in ("x", "y", "n", "bytes", "ends")))

    top = convs.sparkSession.range(1).select(F.lit(root["first"]).cast("long").alias("conv"), F.lit(0).alias("d"))
    of_parent = first.withColumnRenamed("parent", "conv")
    node = found.where("kind = 0")
    rows = (told(node, 0, x=F.col("parent"), n=F.col("n"), bytes=F.col("bytes"))
            .unionByName(told(top, 0, n=F.lit(root["n"]), bytes=F.lit(0)))
            .unionByName(told(convs.withColumnRenamed("length", "d"), 1))
            .unionByName(told(of_parent.withColumn("d", F.col("d") - 1), 2, x=F.col("first"), y=F.col("n")))
            .unionByName(told(of_parent, 3, x=F.col("first")))
            .unionByName(told(following, 4, x=F.col("next")))
            .unionByName(told(found.where("kind = 5").drop("conv").withColumnRenamed("parent", "conv"), 5, ends=F.col("ends")))
            .unionByName(told(ends.where("d = 0").withColumn("conv", F.lit(root["first"]).cast("long")), 5, ends=F.col("ends"))))
    toured = _toured(rows)
    chains = toured.where("kind = 1")
    ids = chains.select(F.col("conv").alias("next_conv"), F.col("d").alias("next_d"), F.col("side").alias("next_side"),
                        F.col("id").alias("next"))
    heads = stored(chains.select("id", "next_conv", "next_d", "next_side", *WEIGHTS)
                   .join(ids, ["next_conv", "next_d", "next_side"], "left").select("id", "next", *WEIGHTS), "trie-list")
    places = list_ranks(heads, most_heads)
    at = {s: places.select(F.col("id").alias(f"{s}_head"), F.col("leaves").alias(f"{s}_l"), F.col("saved").alias(f"{s}_s"))
          for s in ("enter", "exit")}
    part = toured.where("kind = 0").join(at["enter"], "enter_head").join(at["exit"], "exit_head")
    inside = {w: F.col(f"exit_{w}") + F.col(f"exit_{w[0]}") - F.col(f"enter_{w}") - F.col(f"enter_{w[0]}") for w in WEIGHTS[1:]}
    return part.select(
        F.col("conv").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"), "n_children", inside["leaves"].alias("n_leaves"), inside["saved"].alias("saved_tokens"),
        F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"))


op11 = prefix_trie
