"""What column names alone say about columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that name the same concept.
SYNONYM_GROUPS = (
    ("customer", "cust", "client", "buyer"),
    ("product", "prod", "item", "sku"),
    ("order", "ord", "purchase", "transaction"),
    ("employee", "emp", "staff", "worker"),
    ("department", "dept", "div", "division"),
    ("category", "cat", "type", "class"),
    ("user", "usr", "account", "member"),
)
KEY_SUFFIXES = ("_id", "_key", "_code", "_num")

# Spellings of the common entity keys.
KEY_SPELLINGS = (
    ("customerid", "custid", "customer_id", "cust_id", "clientid"),
    ("productid", "prodid", "product_id", "prod_id", "itemid"),
    ("orderid", "ordid", "order_id", "ord_id"),
    ("userid", "user_id", "uid", "accountid"),
)
CATALOG_KEY_WORDS = ("id", "_id", "key", "code")

# Measure names expected to move together.
RELATED_WORDS = (
    ("price", "cost"), ("revenue", "sales"), ("qty", "quantity"),
    ("date", "time"), ("start", "end"), ("min", "max"),
)

# Name hints for the direction of an effect.
CAUSE_WORDS = ("input", "spend", "investment", "effort", "time", "cost")
EFFECT_WORDS = ("output", "revenue", "result", "return", "outcome", "sales")
TIME_WORDS = ("date", "time", "year", "month", "day", "period")
CONFOUNDER_WORDS = ("time", "date", "size", "scale", "population", "region")

# Fixed patterns: names that suggest a key column.
KEY_PATTERNS = (
    r"(?i)^id$", r"(?i)^.*_id$", r"^.*Id$", r"(?i)^pk$", r"(?i)^fk_",
    r"(?i)^.*_key$", r"(?i)^.*_code$", r"(?i)^uuid$", r"(?i)^guid$",
)


def contains_any(text: Column, words) -> Column:
    """Does the text contain one of the words? Words are letters, digits and underscores only."""
    return text.rlike("|".join(words))


def looks_like_key(name: Column, patterns=KEY_PATTERNS) -> Column:
    return reduce(lambda a, b: a | b, [name.rlike(p) for p in patterns])


def normalize_column_name(name: Column) -> Column:
    squeezed = F.regexp_replace(F.lower(name), r"[_\-\s]+", "_")
    return F.regexp_replace(F.regexp_replace(squeezed, r"id$", "_id"), r"^(fk|pk)_", "")


def name_stem(normalized: Column) -> Column:
    """The normalized name without a key-like ending."""
    return F.regexp_replace(normalized, r"_?(id|key|code|num|number)$", "")


def name_tokens(name: Column) -> Column:
    """Array of (rank, token): two columns match by name when they share a token, best rank first.

    Rank 1 is the normalized name, rank 2 the stem or a synonym group, rank 3 a common key suffix. Joining on
    tokens finds all matching column pairs without comparing every column with every other.
    """
    normalized = normalize_column_name(name)
    stem, lowered = name_stem(normalized), F.lower(name)

    def token(rank: int, text: Column, when: Column | None = None) -> Column:
        made = F.struct(F.lit(rank).alias("rank"), text.alias("token"))
        return made if when is None else F.when(when, made)

    entries = [
        token(1, F.concat(F.lit("name:"), normalized)),
        token(2, F.concat(F.lit("stem:"), stem)),
    ]
    for group in SYNONYM_GROUPS:
        entries.append(token(2, F.lit("group:" + group[0]), contains_any(stem, group)))
    for suffix in KEY_SUFFIXES:
        entries.append(token(3, F.lit("suffix:" + suffix), lowered.endswith(suffix)))
    return F.array_compact(F.array(*entries))


def _once(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def match_type_of_rank(rank: Column) -> Column:
    return F.when(rank == 1, "exact").when(rank == 2, "fuzzy").when(rank == 3, "value_overlap")


def name_match_type(a: Column, b: Column) -> Column:
    """exact, fuzzy, value_overlap or null for two column names."""
    def facts(name: Column) -> Column:
        # what name_tokens tells, with groups and suffixes as flags: no text is built or compared more than once
        return _once(normalize_column_name(name), lambda n: _once(name_stem(n), lambda stem: F.struct(
            n.alias("name"), stem.alias("stem"), F.array(*[contains_any(stem, g) for g in SYNONYM_GROUPS]).alias("groups"),
            _once(F.lower(name), lambda low: F.array(*[low.endswith(k) for k in KEY_SUFFIXES])).alias("suffixes"))))

    def shared(x: Column, y: Column) -> Column:
        return F.exists(F.zip_with(x, y, lambda p, q: p & q), lambda both: both)

    return _once(F.struct(facts(a).alias("a"), facts(b).alias("b")), lambda f: (
        F.when(f["a"]["name"] == f["b"]["name"], "exact")
        .when((f["a"]["stem"] == f["b"]["stem"]) | shared(f["a"]["groups"], f["b"]["groups"]), "fuzzy")
        .when(shared(f["a"]["suffixes"], f["b"]["suffixes"]), "value_overlap")))


def names_related(a: Column, b: Column) -> Column:
    """Same first word (more than 3 letters) or one of the related word pairs."""
    x, y = F.lower(a), F.lower(b)
    first_x, first_y = F.split(x, r"[_\s]")[0], F.split(y, r"[_\s]")[0]
    pairs = [
        (x.contains(p) & y.contains(q)) | (x.contains(q) & y.contains(p)) for p, q in RELATED_WORDS
    ]
    return ((F.length(first_x) > 3) & (first_x == first_y)) | reduce(lambda s, t: s | t, pairs)


def squeeze_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"[_\-\s]", "")


def similar_key_names(a: Column, b: Column) -> Column:
    """Equal without separators, one inside the other, or two spellings of one entity key."""
    x, y = squeeze_name(a), squeeze_name(b)
    spelled = [x.isin(*forms) & y.isin(*forms) for forms in KEY_SPELLINGS]
    return (x == y) | x.contains(y) | y.contains(x) | reduce(lambda s, t: s | t, spelled)


def causal_direction(a: Column, b: Column) -> Column:
    x, y = F.lower(a), F.lower(b)
    return (
        F.when(contains_any(x, CAUSE_WORDS) & contains_any(y, EFFECT_WORDS), "causal")
        .when(contains_any(y, CAUSE_WORDS) & contains_any(x, EFFECT_WORDS), "reverse_causal")
        .when(contains_any(x, TIME_WORDS), "causal")
        .when(contains_any(y, TIME_WORDS), "reverse_causal")
        .otherwise("correlational")
    )
