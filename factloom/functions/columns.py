"""Column expressions with the null and rounding behaviour rules rely on, where Spark's own differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def n_unique(value: Column | str) -> Column:
    """Distinct values as an aggregate; null counts as one of them."""
    value = F.col(value) if isinstance(value, str) else value
    return F.count_distinct(value) + F.coalesce(F.max(value.isNull().cast("long")), F.lit(0))


def total(value: Column | str) -> Column:
    """A sum that is 0 over no rows."""
    return F.coalesce(F.sum(value), F.lit(0))


def any_true(value: Column) -> Column:
    """Whether a condition holds in some row; nulls are passed over, no rows give false."""
    return F.coalesce(F.bool_or(value), F.lit(False))


def all_true(value: Column) -> Column:
    """Whether a condition holds in every row; nulls are passed over, no rows give true."""
    return F.coalesce(F.bool_and(value), F.lit(True))


def quantile_nearest(value: Column | str, q: float) -> Column:
    """The value at the nearest rank of a quantile, not interpolated (null over no rows)."""
    value = F.col(value) if isinstance(value, str) else value
    at = F.sort_array(F.collect_list(value))
    return F.try_element_at(at, (F.rint((F.size(at) - 1) * F.lit(q)) + 1).cast("int"))


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """A pattern's group, null where it does not match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def ratio(part: Column, whole: Column, empty: float | None = 0.0) -> Column:
    """part / whole as a double, or `empty` where the whole is 0."""
    return F.when(whole == 0, F.lit(empty).cast("double")).otherwise(part.cast("double") / whole)


def word_bounded(text: Column, word: Column) -> Column:
    """Whether a text holds a word between signs that are no letters, digits or underscores."""
    return F.concat(F.lit(" "), F.regexp_replace(text, r"[^\p{L}\p{N}_]+", " "), F.lit(" ")).contains(F.concat(F.lit(" "), word, F.lit(" ")))


def stem(path: Column) -> Column:
    """The name a file is imported by: its base name, or its directory's for a package's main file."""
    base = F.substring_index(F.substring_index(path, "/", -1), ".", 1)
    parent = extract(path, r"(?:^|/)([^/]+)/[^/]+$")
    # File names that stand for their directory.
    return F.when(base.isin("__init__", "mod", "lib", "index", "main") & path.contains("/"), parent).otherwise(base)


def plain_language(name: Column) -> Column:
    """One spelling for a language: lower case, without region, script or white space; null where nothing is left."""
    return F.nullif(F.lower(F.substring_index(F.regexp_replace(F.trim(name), "_", "-"), "-", 1)), F.lit(""))


def strip_start(text: Column, signs: str) -> Column:
    """The text without any of these signs at its start."""
    return F.ltrim(text, F.lit(signs))


def strip_end(text: Column, signs: str) -> Column:
    return F.rtrim(text, F.lit(signs))


def without_prefix(text: Column, prefix: str) -> Column:
    """The text without one prefix, if it has it."""
    return F.when(text.startswith(prefix), F.substr(text, F.lit(len(prefix) + 1))).otherwise(text)


def without_suffix(text: Column, suffix: str) -> Column:
    return F.when(text.endswith(suffix), F.left(text, F.length(text) - len(suffix))).otherwise(text)


def unsigned(value: Column) -> Column:
    """An unsigned 32-bit integer, held in a long; null outside its range."""
    return F.when(value.between(0, (1 << 32) - 1), value.cast("long"))


def sum_across(*values: Column) -> Column:
    """The sum of a row's values; nulls count as 0."""
    return sum((F.coalesce(v, F.lit(0)) for v in values), F.lit(0))


def join_many_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join that fails where the right side has several rows for a key. The check is part of the right side's only pass, one aggregate per key."""
    others = [c for c in right.columns if c not in keys]
    checked = right.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(*others)).alias("_row"))
    only = F.when(F.assert_true(F.col("_n") == 1, "the right side of a many-to-one join repeats a key").isNull(), F.col("_row"))
    return left.join(checked.select(*keys, only.alias("_row")).select(*keys, "_row.*"), keys, how)


#: Rows each side of a cross join may have.
SMALL = 10_000


def small_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs of two small tables; larger ones are refused, a cross join of them being no plan for a cluster."""
    for side in (left, right):
        if side.limit(SMALL + 1).count() > SMALL:
            raise ValueError(f"a side of a cross join has more than {SMALL} rows")
    return left.crossJoin(F.broadcast(right))
