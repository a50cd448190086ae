"""How tables relate through shared values.

Names decide which columns can be related; they are schema metadata, matched by an equality join on name tokens.
Values decide whether they are. The distinct values of all columns involved are grouped once by value; each group is
the small set of columns holding that value, so no pair of rows is ever formed.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynceus.functions.cells import key_view
from lynceus.functions.names import KEY_PATTERNS, looks_like_key, match_type_of_rank, name_tokens
from lynceus.operators.values import SLOTS, grouping_key, native_counts, quoted, slot_of, spell_out, text_of
from lynceus.table import Table

MIN_CONFIDENCE = 30
KEY_SHARE = 0.5
PRIMARY_SHARE = 0.95

RELATIONSHIP_SCHEMA = (
    "source_table string, source_column string, target_table string, target_column string, relationship_type string, "
    "match_type string, confidence double, source_unique bigint, target_unique bigint, matched bigint, "
    "source_orphans bigint, target_orphans bigint, match_percent double")


def _as_tables(tables) -> dict[str, Table]:
    if isinstance(tables, dict):
        return {name: t if isinstance(t, Table) else Table(t, name=name) for name, t in tables.items()}
    return {t.name: t for t in tables}


def _key_names(tables: dict[str, Table], patterns) -> dict[str, bool]:
    spark = next(iter(tables.values())).spark
    names = spark.createDataFrame([(c,) for c in sorted({c for t in tables.values() for c in t.columns})], "column string")
    return {r["column"]: r["key"] for r in names.select("column", looks_like_key(F.col("column"), patterns).alias("key")).collect()}


def _worth_counting(tables: dict[str, Table], patterns, among: set[tuple[str, str]] | None = None) -> list[tuple[str, str, bool]]:
    """Columns (table, column, named like a key) that may be keys, in table and column order; only those ``among``, if given.

    Columns that are not named like a key are left out if a sketch of their values shows them to be far below one half
    distinct; it errs by a few percent. Missing cells are left out of it, as they are of the exact counts. Texts are not
    sketched when only a few columns are looked at: they are read once, to be counted.
    """
    named, sketched = _key_names(tables, patterns), []
    looked_at = {(n, c) for n, t in tables.items() for c in t.columns if among is None or (n, c) in among}
    texts = set() if among is None else {
        (n, c) for n, c in looked_at if slot_of(tables[n].df.schema[c].dataType) == "text"}
    for name, t in tables.items():
        rest = [c for c in t.columns if not named[c] and (name, c) in looked_at - texts]
        if rest:
            aggregates = [F.struct(
                F.lit(name).alias("table"), F.lit(c).alias("column"), F.approx_count_distinct(v, 0.05).alias("u"),
                F.count(v).alias("n")).alias(f"f{i}") for i, (c, v) in enumerate((c, key_view(t.df, c)) for c in rest)]
            sketched.append(t.df.agg(*aggregates).select(F.inline(F.array(*[f"f{i}" for i in range(len(rest))]))))
    rough = reduce(DataFrame.unionByName, sketched).collect() if sketched else []
    near = texts | {(r["table"], r["column"]) for r in rough if r["n"] and r["u"] > 0.25 * r["n"]}
    return [(n, c, named[c]) for n, t in tables.items() for c in t.columns
            if (n, c) in looked_at and (named[c] or (n, c) in near)]


def _key_facts(counts: DataFrame, columns: list[tuple[str, str, bool]]) -> DataFrame:
    """Rows (id, table, column, unique_count, total_count, named_key) of the candidate keys among counted columns."""
    # counted with a condition instead of filtered: a filter would move below the aggregation and run on every row
    filled = reduce(lambda a, b: a | b, [F.col(s).isNotNull() for s in SLOTS if s in counts.columns])
    facts = F.array(*[F.struct(F.lit(n).alias("table"), F.lit(c).alias("column"), F.lit(named).alias("named_key"))
                      for n, c, named in columns])
    return (
        counts.groupBy("id").agg(
            F.count_if(filled).alias("unique_count"),
            F.coalesce(F.sum(F.when(filled, F.col("cnt"))), F.lit(0)).alias("total_count"))
        .select("id", facts[F.col("id")].alias("facts"), "unique_count", "total_count")
        .select("id", "facts.table", "facts.column", "unique_count", "total_count", "facts.named_key")
        .where((F.col("total_count") > 0)
               & (F.col("named_key") | (F.col("unique_count") > KEY_SHARE * F.col("total_count"))))
    )


def candidate_keys(tables, key_patterns=KEY_PATTERNS) -> DataFrame:
    """Columns whose name looks like a key or whose distinct share exceeds one half.

    Rows (table, column, unique_count, total_count, named_key).
    """
    tables = _as_tables(tables)
    columns = _worth_counting(tables, key_patterns)
    if not columns:
        schema = "table string, column string, unique_count bigint, total_count bigint, named_key boolean"
        return next(iter(tables.values())).spark.createDataFrame([], schema)
    return _key_facts(native_counts([(tables[n].df, c) for n, c, _ in columns]), columns).drop("id")


def relationship_type(source_unique: Column, source_total: Column, target_unique: Column, target_total: Column) -> Column:
    first = source_unique / source_total > PRIMARY_SHARE
    second = target_unique / target_total > PRIMARY_SHARE
    return (
        F.when(first & second, "one_to_one").when(first, "one_to_many").when(second, "many_to_one")
        .otherwise("many_to_many"))


def relationship_confidence(match_type: Column, match_percent: Column, matched: Column) -> Column:
    base = F.when(match_type == "exact", 70).when(match_type == "fuzzy", 50).otherwise(30)
    overlap = F.when(match_percent > 80, 20).when(match_percent > 50, 10).when(match_percent < 20, -20).otherwise(0)
    amount = F.when(matched > 100, 10).when(matched < 10, -10).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), base + overlap + amount)).cast("double")


def _named_pairs(keys: DataFrame, strip_prefix: str | None) -> DataFrame:
    """Candidate columns of different tables whose names match, each pair once in table and column order."""
    name = F.regexp_replace("column", strip_prefix, "") if strip_prefix else F.col("column")
    tokens = keys.select("id", "table", "column", F.inline(name_tokens(name)))
    other = tokens.select(F.col("id").alias("id2"), F.col("table").alias("table2"), "token")
    return (
        tokens.join(other, "token").where((F.col("id") < F.col("id2")) & (F.col("table") != F.col("table2")))
        .groupBy("id", "id2").agg(F.min("rank").alias("rank"))
    )


def _shared_values(distinct: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """Rows (id, id2, matched): how many values the columns of each pair share.

    Values held by the same set of columns are counted together first, so pairs are formed per set, not per value.
    """
    partners: dict[int, list[int]] = {}
    for a, b in pairs:
        partners.setdefault(a, []).append(b)
    used = sorted({i for pair in pairs for i in pair})
    values = distinct.select(text_of(distinct).alias("v"), F.when(F.col("id").isin(*used), F.col("id")).alias("id"))
    # ids are columns, so a set is small whatever the value; missing values collect no id
    holders = values.groupBy("v").agg(F.array_sort(F.collect_set(F.when(F.col("v").isNotNull(), F.col("id")))).alias("ids"))
    sets = holders.groupBy("ids").agg(F.count(F.lit(1)).alias("matched")).where(F.size("ids") > 1)
    # each set asks a lookup from column to later partners, then keeps the partners that are in it too
    lookup = F.map_from_arrays(
        F.array(*[F.lit(a) for a in partners]), F.array(*[F.array(*[F.lit(b) for b in bs]) for bs in partners.values()]))
    return (
        sets.select("ids", "matched", F.explode("ids").alias("id"))
        .select("id", "matched", F.explode(F.array_intersect("ids", lookup[F.col("id")])).alias("id2"))
        .groupBy("id", "id2").agg(F.sum("matched").alias("matched"))
    )


def find_relationships(tables, key_patterns=KEY_PATTERNS, strip_prefix: str | None = None) -> DataFrame:
    """Column pairs of different tables with matching names, shared values and a confidence of 30 or more.

    ``key_patterns`` and ``strip_prefix`` adapt the name rules, e.g. ``strip_prefix="^[a-z]{1,2}_"``.
    """
    named = _as_tables(tables)
    spark = next(iter(named.values())).spark
    # names first: they are metadata, and a column without a partner by name is not read at all
    every = [(i, n, c) for i, (n, c) in enumerate((n, c) for n, t in named.items() for c in t.columns)]
    partners = _named_pairs(spark.createDataFrame(every, "id int, table string, column string"), strip_prefix).collect()
    paired = {every[i][1:] for r in partners for i in (r["id"], r["id2"])}
    columns = _worth_counting(named, key_patterns, paired) if paired else []
    if not columns:
        return spark.createDataFrame([], RELATIONSHIP_SCHEMA)
    # the columns are counted once, for their own numbers and for what they share
    distinct = native_counts([(named[n].df, c) for n, c, _ in columns]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # metadata from here on: one row per candidate column, then per pair of columns with matching names
        keys = spark.createDataFrame(
            _key_facts(distinct, columns).collect(),
            "id int, table string, column string, unique_count bigint, total_count bigint, named_key boolean")
        at = {(n, c): i for i, (n, c, _) in enumerate(columns)}
        found = {r["id"] for r in keys.collect()}
        pairs = [(at.get(every[a][1:]), at.get(every[b][1:]), rank) for a, b, rank in partners]
        pairs = [p for p in pairs if p[0] in found and p[1] in found]
        shared = _shared_values(distinct, [(a, b) for a, b, _ in pairs]).collect() if pairs else []
    finally:
        distinct.unpersist()
    if not shared:
        return spark.createDataFrame([], RELATIONSHIP_SCHEMA)
    matched = spark.createDataFrame(shared, "id int, id2 int, matched bigint")
    ranks = spark.createDataFrame(pairs, "id int, id2 int, rank int")
    first = keys.select("id", F.col("table").alias("source_table"), F.col("column").alias("source_column"),
                        F.col("unique_count").alias("source_unique"), F.col("total_count").alias("source_total"))
    second = keys.select(F.col("id").alias("id2"), F.col("table").alias("target_table"),
                         F.col("column").alias("target_column"), F.col("unique_count").alias("target_unique"),
                         F.col("total_count").alias("target_total"))
    joined = matched.join(ranks, ["id", "id2"]).join(first, "id").join(second, "id2")
    return (
        joined.withColumn("match_type", match_type_of_rank(F.col("rank")))
        .withColumn("relationship_type", relationship_type(
            F.col("source_unique"), F.col("source_total"), F.col("target_unique"), F.col("target_total")))
        .withColumn("match_percent", 100 * F.col("matched") / F.least("source_unique", "target_unique"))
        .withColumn("confidence", relationship_confidence(F.col("match_type"), F.col("match_percent"), F.col("matched")))
        .where(F.col("confidence") >= MIN_CONFIDENCE)
        .select(
            "source_table", "source_column", "target_table", "target_column", "relationship_type", "match_type",
            "confidence", "source_unique", "target_unique", "matched",
            (F.col("source_unique") - F.col("matched")).alias("source_orphans"),
            (F.col("target_unique") - F.col("matched")).alias("target_orphans"), "match_percent")
        .orderBy(F.col("confidence").desc(), "source_table", "source_column", "target_table", "target_column")
    )


def _sides(a, a_col: str, b, b_col: str) -> DataFrame:
    """One row per distinct value (long texts by digest) with the sides holding it. Copies of a value merge before the
    shuffle."""
    a, b = Table.of(a), Table.of(b)

    def side(t: Table, c: str, left: bool) -> DataFrame:
        return t.df.select(grouping_key(t.text(c)).alias("v"), F.lit(left).alias("l"), F.lit(not left).alias("r"))

    both = side(a, a_col, True).unionByName(side(b, b_col, False)).where(F.col("v").isNotNull())
    return both.groupBy("v").agg(F.max("l").alias("l"), F.max("r").alias("r"))


def value_overlap(a, a_col: str, b, b_col: str) -> DataFrame:
    """One row: distinct values per side, shared ones, orphans of each side, share of the smaller side."""
    counted = _sides(a, a_col, b, b_col).agg(
        F.count_if("l").alias("source_unique"), F.count_if("r").alias("target_unique"),
        F.count_if(F.col("l") & F.col("r")).alias("matched"))
    return counted.select(
        "source_unique", "target_unique", "matched",
        (F.col("source_unique") - F.col("matched")).alias("source_orphans"),
        (F.col("target_unique") - F.col("matched")).alias("target_orphans"),
        F.coalesce(F.try_divide(100.0 * F.col("matched"), F.least("source_unique", "target_unique")), F.lit(0.0))
        .alias("match_percent"))


#: What a share of orphans above so many percent usually means, as codes. The bounds are fixed values.
ORPHAN_REASONS = (
    (50, ("export_timing", "other_period_or_filter")),
    (10, ("deleted_in_partner", "entry_errors")),
    (-1, ("not_yet_synced", "test_rows")),
)


def orphan_reasons(share: Column) -> Column:
    above = F.lit(None).cast("array<string>")
    for bound, reasons in reversed(ORPHAN_REASONS):
        above = F.when(share > bound, F.array(*map(F.lit, reasons))).otherwise(above)
    return above


def orphans(a, a_col: str, b, b_col: str, sample: int = 10) -> DataFrame:
    """Values of ``a`` without a partner in ``b``: count, share, the first few values and likely reasons.

    The first values are those with the smallest ``grouping_key``.
    """
    t, sides = Table.of(a), _sides(a, a_col, b, b_col)
    counted = sides.agg(F.count_if("l").alias("values"), F.count_if(F.col("l") & ~F.col("r")).alias("orphan_count"))
    first = sides.where(F.col("l") & ~F.col("r")).orderBy("v").limit(sample)
    first = spell_out(t.df, first.select(F.lit(a_col).alias("column"), F.col("v").alias("value")),
                      [a_col] if slot_of(t.df.schema[a_col].dataType) == "text" else [])
    shown = first.agg(F.array_sort(F.collect_list("value")).alias("sample_orphans"))
    both = counted.unionByName(shown, allowMissingColumns=True)
    one = both.agg(*[F.first(c, ignorenulls=True).alias(c) for c in both.columns])
    share = F.coalesce(F.try_divide(100.0 * F.col("orphan_count"), F.col("values")), F.lit(0.0))
    return one.select(
        F.lit(a_col).alias("column"), F.col("values").alias("value_count"), "orphan_count",
        share.alias("orphan_percent"), "sample_orphans", orphan_reasons(share).alias("possible_reasons"))


def orphan_report(tables, relationships: DataFrame | None = None) -> DataFrame:
    """Both sides of every relationship that has orphans. Uses the counts the relationships already carry."""
    found = relationships if relationships is not None else find_relationships(tables)

    def side(which: str, other: str) -> DataFrame:
        share = 100.0 * F.col(f"{which}_orphans") / F.col(f"{which}_unique")
        return found.where(F.col(f"{which}_orphans") > 0).select(
            F.col(f"{which}_table").alias("table"), F.col(f"{which}_column").alias("column"),
            F.col(f"{other}_table").alias("partner_table"), F.col(f"{other}_column").alias("partner_column"),
            F.col(f"{which}_orphans").alias("orphan_count"), share.alias("orphan_percent"),
            orphan_reasons(share).alias("possible_reasons"))

    return side("source", "target").unionByName(side("target", "source"))


def _join_key(t: Table, col: str, other: Table, other_col: str) -> Column:
    """The column itself where both sides are whole numbers, dates or timestamps, so that filters on it reach the scan;
    else the canonical text."""
    dtype = t.df.schema[col].dataType
    plain = dtype == other.df.schema[other_col].dataType and slot_of(dtype) in ("whole", "day", "moment")
    return quoted(col) if plain else t.text(col)


def join_related(a, b, a_col: str, b_col: str, kind: str = "one_to_many") -> DataFrame:
    """Join two tables along a relationship: LEFT for one_to_many, else INNER.

    The left join is an inner join plus the left rows without partner: an inner join lets Spark split a hot key on
    either side, which an outer join cannot do on its right side.
    """
    a, b = Table.of(a), Table.of(b)
    left = a.df.withColumn("__key", _join_key(a, a_col, b, b_col))
    right = b.df.withColumn("__key", _join_key(b, b_col, a, a_col))
    taken = set(a.columns)
    right = right.select("__key", *[quoted(c).alias(c if c not in taken else f"{c}_right") for c in b.columns])
    inner = left.join(right, "__key").drop("__key")
    if kind != "one_to_many":
        return inner
    keys = right.select("__key").where(F.col("__key").isNotNull()).distinct()
    alone = left.join(keys, "__key", "left_anti").drop("__key")
    return inner.unionByName(alone, allowMissingColumns=True)
