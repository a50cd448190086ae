"""Mixing sources to target weights by a low-discrepancy schedule.

Slot t of the mix belongs to the source whose share of the cumulative weights holds the t-th golden-ratio point, so each
prefix of the mix follows the weights closely. The r-th slot of a source takes the r-th block of its shuffled words,
beginning again at its end. Blocks hold equally many words; a document may lie in several blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lynceus.llm.common import stored, word_list

#: Fraction of the golden ratio in units of 2**-32: a whole number, so every slot's point is exact.
GOLDEN = 2654435769
UNIT = 1 << 32


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5,
                   most: float = 2.0) -> DataFrame:
    """source, source_size, weight, target per source; ``sizes`` has source and size.

    Sources in code point order, null last, take the weights in turn and share ``share`` times all words. No target is
    above ``most`` times its source; what is above goes to the others by weight until none is above. The level of words
    per unit of weight is raised until it no longer moves: each step is one aggregation of a row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    totals = stored(totals.repartitionByRange(F.col("source").asc_nulls_last())
                    .withColumn("part", F.spark_partition_id()), "mix-sources")
    order = F.col("source").asc_nulls_last()
    before = {r[0]: r[1] for r in totals.groupBy("part").count().collect()}
    offsets, seen = {}, 0
    for part in sorted(before):
        offsets[part], seen = seen, seen + before[part]
    if not offsets:
        offsets = {0: 0}
    offset = F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair])[F.col("part")]
    rank = offset + F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = totals.withColumn("weight", weight)
    cap = F.col("source_size") * F.lit(most)
    demand = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    while True:
        full = cap <= F.lit(level) * F.col("weight")
        taken, open_weight = ranked.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        if not open_weight:
            break
        raised = (demand - (taken or 0.0)) / open_weight
        if raised <= level:
            break
        level = raised
    return ranked.select("source", "source_size", "weight",
                         F.least(cap, F.lit(level) * F.col("weight")).cast("double").alias("target"))


def _key(source: Column) -> list[Column]:
    """A source as a join key: null is a source of its own."""
    return [source.isNull(), F.coalesce(source, F.lit(""))]


def shuffled_stream(docs: DataFrame, bucket_rows: int = 2_000) -> DataFrame:
    """Documents of a source one after the other in shuffled order: ``at`` is the first word's place in the source.

    The order is by md5 of the id, ties by id and size. Places are summed in buckets of the hash, about ``bucket_rows``
    rows each (2**20 buckets at most), then over buckets, so that no source is one task however large it is. The order
    does not depend on the buckets.
    """
    rows = docs.count()
    bits = max(0, min(20, (max(1, rows // bucket_rows)).bit_length()))
    shuffled = docs.withColumn("hash", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    shuffled = shuffled.withColumn("bucket", F.shiftright(F.conv(F.substring("hash", 1, 5), 16, 10).cast("int"), 20 - bits))
    key = ["no_source", "source_key"]
    shuffled = shuffled.withColumns(dict(zip(key, _key(F.col("source")))))
    inside = Window.partitionBy(*key, "bucket").orderBy("hash", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    buckets = shuffled.groupBy(*key, "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("base", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words")
    placed = shuffled.withColumns({"upto": F.sum("size").over(inside), "nth": F.count("*").over(inside)})
    return (placed.join(buckets, [*key, "bucket"])
            .withColumn("at", F.col("base") + F.col("upto") - F.col("size"))
            .withColumnRenamed("nth", "place").drop("hash", "base", "upto"))


def schedule(targets: DataFrame, block_words: int, chunk: int = 16_384) -> DataFrame:
    """slot, source, nth slot of its source (from 0) and words: the mix in order.

    Points are mapped through the cumulative weights by a join on equal cells of the unit interval. A source's slots
    are ranked in chunks of the schedule, then over chunks. Its last block is cut to end at its target, slots beyond
    that are left out, and blocks that the points did not reach follow at the end, so targets are met to the word.
    """
    spark = targets.sparkSession
    shares = stored(targets.where("target >= 1").select(
        *[c.alias(n) for c, n in zip(_key(F.col("source")), ["no_source", "source_key"])], "source_size",
        F.floor("target").cast("long").alias("words")), "mix-targets")
    total, count = shares.agg(F.coalesce(F.sum("words"), F.lit(0)), F.count("*")).first()
    slots = -(-total // block_words)
    cells = 1 << min(20, max(4, (4 * count).bit_length()))
    # Cumulative shares: a row per source, summed per hash bucket first so that many sources are no single task.
    spread = shares.withColumn("bucket", F.pmod(F.xxhash64("no_source", "source_key"), F.lit(256)))
    own = Window.partitionBy("bucket").orderBy("no_source", "source_key").rowsBetween(Window.unboundedPreceding, -1)
    base = (spread.groupBy("bucket").agg(F.sum("words").alias("sum"))
            .withColumn("base", F.coalesce(F.sum("sum").over(Window.orderBy("bucket").rowsBetween(
                Window.unboundedPreceding, -1)), F.lit(0))).drop("sum"))
    spread = (spread.withColumn("low", F.coalesce(F.sum("words").over(own), F.lit(0))).join(F.broadcast(base), "bucket")
              .withColumn("low", F.col("low") + F.col("base")).withColumn("high", F.col("low") + F.col("words"))
              .withColumns({c: (F.col(c) / F.lit(max(1, total)) * UNIT).cast("long") for c in ("low", "high")})
              .where("high > low"))
    width = UNIT // cells
    spans = spread.select("no_source", "source_key", "low", "high", F.explode(F.sequence(
        F.expr(f"low div {width}"), F.expr(f"(high - 1) div {width}"))).alias("cell"))
    points = (spark.range(slots).withColumnRenamed("id", "slot")
              # slot * GOLDEN modulo 2**32 without overflow: halves of 16 bits
              .withColumn("point", F.expr(f"(((slot & 65535) * {GOLDEN} & {UNIT - 1}) + ((((slot >> 16) & 65535) * {GOLDEN} & 65535) << 16)) & {UNIT - 1}"))
              .withColumn("cell", F.expr(f"point div {width}")))
    met = points.join(spans, "cell").where("point >= low and point < high").select(
        "slot", "no_source", "source_key", F.expr(f"slot div {chunk}").alias("chunk"))
    key = ["no_source", "source_key"]
    per_chunk = met.groupBy(*key, "chunk").agg(F.count("*").alias("n")).withColumn(
        "base", F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy("chunk").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = (met.withColumn("r", F.row_number().over(Window.partitionBy(*key, "chunk").orderBy("slot")) - 1)
              .join(per_chunk.drop("n"), [*key, "chunk"])
              .select("slot", *key, (F.col("r") + F.col("base")).alias("nth")))
    got = per_chunk.groupBy(*key).agg(F.sum("n").alias("got"))
    needed = F.ceil(F.col("words") / F.lit(block_words)).cast("long")
    late = (shares.join(got, key, "left").withColumn("got", F.coalesce("got", F.lit(0))).where(F.col("got") < needed)
            .select(F.lit(slots).cast("long").alias("slot"), *key,
                    F.explode(F.sequence(F.col("got"), needed - 1)).alias("nth")))
    return (ranked.unionByName(late).join(shares, key).where(F.col("nth") < needed)
            .select("slot", *key, "nth", "source_size", F.least(
                F.lit(block_words), F.col("words") - F.col("nth") * block_words).cast("long").alias("words")))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
        block_words: int = 4096) -> tuple[DataFrame, DataFrame]:
    """The mix: what each slot takes (slot, doc_id, first word, words), and a row per document with what is taken of it.

    ``docs`` has doc_id, source and text. Null texts have no words and null sources are one source, the last. Rows that
    repeat an id are documents of their own. An empty table gives an empty mix. A slot's block lies at ``nth *
    block_words`` in its source, counted around: documents are cut at block ends.
    """
    sized = stored(docs.select("doc_id", "source", F.size(word_list(F.col("text"))).cast("long").alias("size")), "mix-sizes")
    targets = stored(source_targets(sized, weights, share, most), "mix-shares")
    key = ["no_source", "source_key"]
    stream = stored(shuffled_stream(sized).drop("source"), "mix-stream")
    plan = schedule(targets, block_words)
    # A block that passes its source's end is two pieces; each piece meets the documents through the stretches of
    # block_words words that it touches.
    start = F.col("nth") * block_words % F.col("source_size")
    plan = plan.withColumn("start", start).withColumn("head", F.least("words", F.col("source_size") - F.col("start")))
    pieces = plan.select("slot", *key, "nth", "source_size", F.explode(F.array(
        F.struct(F.col("start").alias("low"), (F.col("start") + F.col("head")).alias("high")),
        F.struct(F.lit(0).cast("long").alias("low"), (F.col("words") - F.col("head")).alias("high")))).alias("p"))
    pieces = pieces.select("slot", *key, "nth", "p.*").where("high > low")
    again = F.expr("high - low")
    # A source shorter than a block can be gone through more than once in a single block; its target bounds that to two.
    stretch = lambda low, high: F.explode(F.sequence(
        F.expr(f"{low} div {block_words}"), F.expr(f"({high} - 1) div {block_words}")))
    cut = pieces.where(again > 0).withColumn("stretch", stretch("low", "high"))
    lying = stream.where("size > 0").withColumn("stretch", stretch("at", "at + size"))
    taken = (cut.join(lying, [*key, "stretch"])
             .withColumn("from", F.greatest("low", "at", F.col("stretch") * block_words))
             .withColumn("to", F.least("high", F.col("at") + F.col("size"), (F.col("stretch") + 1) * block_words))
             .where("to > from"))
    slots = taken.select("slot", "doc_id", (F.col("from") - F.col("at")).alias("first_word"),
                         (F.col("to") - F.col("from")).alias("words"), *key, "bucket", "place")
    per_doc = slots.groupBy(*key, "bucket", "place").agg(F.sum("words").alias("taken"))
    shares = targets.select(*[c.alias(n) for c, n in zip(_key(F.col("source")), key)], "source_size", "target")
    rows = (stream.join(per_doc, [*key, "bucket", "place"], "left").join(shares, key)
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"),
                    F.when(~F.col("no_source"), F.col("source_key")).alias("source")))
    return slots.drop(*key, "bucket", "place"), rows


def op6(docs: DataFrame) -> DataFrame:
    """The contract's columns, one row per row of ``docs``."""
    return mix(docs)[1].select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target",
                               F.col("taken").cast("long").alias("taken"))
