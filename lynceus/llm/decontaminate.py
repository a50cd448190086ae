"""Benchmark decontamination with DataFrame functions only.

The benchmark's windows of n normalised words form a hash set that is broadcast while its size is proven small (beyond
that it is shuffled). Every window of every document is hashed and looked up; a hit counts after the words themselves
compared equal. Documents or just the hit spans can be removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynceus.llm.common import free_names, lower_ascii, word_list
from lynceus.operators.values import quoted

#: What stands between two words; a word is made of digits, letters and all of Unicode beyond ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
INSIDE = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def normal_words(text: Column) -> Column:
    return word_list(lower_ascii(text), BETWEEN)


def _windows(words: Column, n: Column | int) -> Column:
    """All runs of ``n`` words."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(F.size(words) >= n, F.transform(
        F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.slice(words, i, n))).otherwise(F.array())


def benchmark_windows(bench: DataFrame, n: int = 13) -> DataFrame:
    """hash, words and items (ids as text) of each distinct window; an item shorter than ``n`` words is one window."""
    items = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                         normal_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    size = F.least(F.lit(n), F.size("words"))
    return (items.select("item", F.explode(_windows(F.col("words"), size)).alias("window"))
            .groupBy("window").agg(F.collect_set("item").alias("items"))
            .select(F.xxhash64("window").alias("hash"), "window", "items"))


def find_hits(docs: DataFrame, bench: DataFrame, n: int = 13, max_broadcast_windows: int = 1_000_000,
              max_broadcast_bytes: int = 128 << 20) -> DataFrame:
    """Per distinct (doc_id, text): copies (equal rows), n_words, items (ids as text, sorted) and spans.

    ``spans`` are the word ranges (start from 1, end exclusive) of the hits, by start. A null or empty text has no
    words and no hits; a null item id counts as the empty text; an empty benchmark hits nothing. Rows that repeat both
    doc_id and text are counted in ``copies``. Only doc_id and text are read, so other columns may have any name.
    """
    windows = benchmark_windows(bench, n)
    bound = windows.agg(F.count("*"), F.coalesce(F.sum(F.length(F.array_join("window", " "))
                                                       + F.length(F.array_join("items", " "))), F.lit(0)),
                        F.collect_set(F.size("window"))).first()
    if bound[0] <= max_broadcast_windows and bound[1] <= max_broadcast_bytes:
        windows = F.broadcast(windows)
    read = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), normal_words(F.col("text")).alias("words"))
    lengths = sorted(bound[2])  # n at most
    hashed = read.select("doc_id", "text_hash", "words", F.concat(
        F.array(F.lit(None).cast("long")),
        *[F.transform(_windows(F.col("words"), k), lambda w: F.xxhash64(w)) for k in lengths]).alias("hashes"))
    # The first element stands for the document itself; then follow its windows of each length.
    start, size, before = F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(0)
    for k in lengths:
        inside = F.col("at") > before
        start, size = F.when(inside, F.col("at") - before).otherwise(start), F.when(inside, k).otherwise(size)
        before = before + F.greatest(F.size("words") - (k - 1), F.lit(0))
    one = hashed.select("doc_id", "text_hash", "words", F.posexplode_outer("hashes").alias("at", "hash"))
    same = (F.col("one.hash") == F.col("bench.hash")) & (F.slice("one.words", F.col("one.start"), F.col("one.size"))
                                                         == F.col("bench.window"))
    met = (one.withColumns({"start": F.coalesce(start, F.lit(1)), "size": F.coalesce(size, F.lit(0))}).alias("one")
           .join(windows.alias("bench"), same, "left").where("one.at = 0 or bench.hash is not null"))
    hit = F.col("bench.hash").isNotNull()
    return (met.select("doc_id", "text_hash", F.when(F.col("at") == 0, F.size("words")).alias("n_words"),
                       F.when(hit, F.struct("start", (F.col("start") + F.col("size")).alias("end"))).alias("span"),
                       F.when(hit, F.col("items")).alias("items"))
            .groupBy("doc_id", "text_hash").agg(
                F.count("n_words").alias("copies"), F.max("n_words").alias("n_words"),
                F.array_sort(F.collect_set("span")).alias("spans"),
                F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")))


def covered(spans: Column) -> Column:
    """Words inside any of the spans, which are sorted by start."""
    return F.aggregate(spans, F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")), lambda seen, x: F.struct(
        F.greatest(seen["end"], x["end"]).alias("end"),
        (seen["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(seen["end"], x["start"]))).alias("n")))["n"]


def op8(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The contract's columns, one row per row of ``docs``."""
    found = find_hits(docs, bench).withColumn("n_hit", covered(F.col("spans")))
    return (found.select(F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"), "*")
            .select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_hit",
                    F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                    contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated")))


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def decontaminate(docs: DataFrame, bench: DataFrame, spans: bool = False) -> DataFrame:
    """``docs`` without its contaminated documents; with ``spans``, documents stay and lose the hit words instead.

    What stood between removed words goes with them, up to one separator. All columns are kept as they are, but for the
    text where spans go, whatever their names. Rows that repeat a document share its fate; null texts have no words and
    stay; an empty table gives an empty one.
    """
    id_, hash_, spans_, words_, gaps_ = free_names(docs, "__id", "__hash", "__spans", "__words", "__gaps")
    found = (find_hits(docs, bench).where(F.size("spans") > 0)
             .where(F.lit(True) if spans else contaminated(covered(F.col("spans")), F.col("n_words")))
             .select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), F.col("spans").alias(spans_)))
    same = F.col(id_).eqNullSafe(F.col("doc_id")) & (F.col(hash_) == F.xxhash64("text"))
    if not spans:
        return docs.join(found, same, "left_anti")
    words, gaps = F.col(words_), F.col(gaps_)
    gone = lambda i: F.exists(spans_, lambda s: (s["start"] <= i) & (i < s["end"]))
    # gaps[i] stands before words[i]; a text that ends in a word has an empty last gap.
    cut = F.concat(F.array_join(F.transform(F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: ~gone(i)),
                                            lambda i: F.concat(F.get(gaps, i - 1), F.get(words, i - 1))), ""),
                   F.get(gaps, F.size(words)))
    return (docs.join(found, same, "left").withColumns({
        words_: word_list(F.col("text"), BETWEEN.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")),  # A-Z as they are
        gaps_: F.split(F.col("text"), INSIDE)})
        .withColumn("text", F.when(F.col(spans_).isNull(), F.col("text")).otherwise(cut))
        .select(*[quoted(c) for c in docs.columns]))
