"""Projection, filter, lookup, aggregation, ordering and set operators as DataFrame functions.

Where an operator depends on row order, the order is an argument: a DataFrame has none of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# -- projection and filter -----------------------------------------------------------------------------------------


def get_key(m: str, key: str, default: Column) -> Column:
    """A map's value; the default only where the key is absent (a present null stays null)."""
    return F.when(F.map_contains_key(m, key), F.element_at(m, F.lit(key))).otherwise(default)


def get_columns(df: DataFrame, keys: Sequence[str], default: Column | None = None) -> DataFrame:
    """Columns by name; names that are absent become the default."""
    return df.select(*[F.col(k) if k in df.columns else (default if default is not None else F.lit(None)).alias(k) for k in keys])


def map_leaves(df: DataFrame, fn, kinds: tuple = (T.NumericType,)) -> DataFrame:
    """``fn`` on every leaf of the given types, through structs and arrays; the tree keeps its shape."""

    def walk(c: Column, t: T.DataType) -> Column:
        if isinstance(t, T.StructType):
            made = F.struct(*[walk(c[f.name], f.dataType).alias(f.name) for f in t.fields])
            return F.when(c.isNotNull(), made)
        if isinstance(t, T.ArrayType):
            return F.transform(c, lambda x: walk(x, t.elementType))
        return fn(c) if isinstance(t, kinds) else c

    return df.select(*[walk(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def matches(columns: dict[str, str | None]) -> Column:
    """All given patterns found (regular expressions); null patterns ask nothing."""
    out = F.lit(True)
    for name, pattern in columns.items():
        if pattern:
            out = out & F.col(name).rlike(pattern)
    return out


def members(df: DataFrame, column: str, values: Sequence, single: str | None = None) -> DataFrame:
    """Rows whose column is in ``values``; with ``single``, it is an error if that column has several values."""
    out = df.filter(F.col(column).isin(list(values)))
    if single:
        n = out.agg(F.min(single).alias("_lo"), F.max(single).alias("_hi"))  # one row
        one = F.when(F.col("_lo").eqNullSafe(F.col("_hi")), F.col(single)).otherwise(F.raise_error(F.lit(f"several values of {single}")))
        out = out.crossJoin(F.broadcast(n)).withColumn(single, one).drop("_lo", "_hi")
    return out


def healthy(state: Column, bad: Sequence[str] = ("drain", "fail", "drng", "down")) -> Column:
    """None of the bad tokens occurs."""
    return ~state.rlike("|".join(bad))


def active(cpu: Column, memory: Column, least: float = 100) -> Column:
    """P09."""
    return (cpu > least) | (F.coalesce(memory, F.lit(0)) > 0)


def any_keyword(name: Column, keywords: Sequence[str]) -> Column:
    """Any keyword is a substring."""
    return F.exists(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(name, k))


def by_prefix(df: DataFrame, column: str, prefix: str, remove: bool = False) -> DataFrame:
    """Rows whose name starts with the prefix; ``remove`` strips it and any dots at the ends."""
    out = df.filter(F.col(column).startswith(prefix))
    if remove:
        out = out.withColumn(column, F.btrim(F.expr(f"substring(`{column}`, {len(prefix) + 1})"), F.lit(".")))
    return out


def flag_prefixes(df: DataFrame, column: str, prefixes: Sequence[str], flag: str, value: bool) -> DataFrame:
    """The flag set on rows whose name starts with any prefix, others unchanged."""
    hit = F.exists(F.array(*[F.lit(p) for p in prefixes]), lambda p: F.startswith(F.col(column), p))
    return df.withColumn(flag, F.when(hit, F.lit(value)).otherwise(F.col(flag)))


def size_classes(df: DataFrame, size: str, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """A row per band that holds the size (bands may overlap); bounds are exclusive."""
    options = [F.when((F.col(size) > lo) & (F.col(size) < hi), F.lit(name)) for name, (lo, hi) in bands.items()]
    return df.withColumn("band", F.explode(F.filter(F.array(*options), lambda x: x.isNotNull())))


def first_match(items: Column, *predicates) -> Column:
    """The first element that satisfies the first predicate that any element satisfies."""
    return F.coalesce(*[F.try_element_at(F.filter(items, p), F.lit(1)) for p in predicates])


def add_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """P19."""
    return df.toDF(*[prefix + c for c in df.columns])


def subset(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is listed."""
    return df.join(keys.select(on).distinct(), on, "left_semi")


# -- joins and lookups ---------------------------------------------------------------------------------------------


def lookup(facts: DataFrame, dim: DataFrame, on: str, order: str, required: bool = False) -> DataFrame:
    """Each fact with its key's dimension row; of repeated keys the last by ``order`` wins.

    ``required`` makes a missing key an error when its row is read.
    """
    rest = [c for c in dim.columns if c != on]
    latest = dim.groupBy(on).agg(F.max_by(F.struct(*rest), order).alias("_d"))
    if not required:
        return facts.join(latest, on).select(*facts.columns, *[F.col(f"_d.{c}").alias(c) for c in rest if c not in facts.columns])
    out = facts.join(latest, on, "left")
    found = F.when(F.col("_d").isNotNull(), F.col("_d")).otherwise(F.raise_error(F.concat(F.lit("no such key: "), F.col(on).cast("string"))))
    out = out.withColumn("_d", found)
    return out.select(*facts.columns, *[F.col(f"_d.{c}").alias(c) for c in rest if c not in facts.columns])


def missing_keys(facts: DataFrame, dim: DataFrame, on: str) -> DataFrame:
    """Rows whose key the other table lacks."""
    return facts.join(dim.select(on).distinct(), on, "left_anti")


def paired(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Keys that both sides have."""
    return left.select(on).intersect(right.select(on))


def interval_lookup(points: DataFrame, at: str, spans: DataFrame, lo: str, hi: str, width: int) -> DataFrame:
    """Points joined with the half-open spans that hold them.

    Spans are cut at multiples of ``width``; points and spans meet by an equi-join on the multiple, so neither side has
    to be small.
    """
    cells = F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width))
    s = spans.filter(F.col(hi) > F.col(lo)).withColumn("_cell", F.explode(cells))
    p = points.withColumn("_cell", F.floor(F.col(at) / width))
    return p.join(s, "_cell").filter((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi))).drop("_cell")


def left_default(left: DataFrame, right: DataFrame, on: str, defaults: dict[str, object]) -> DataFrame:
    """Left join with defaults for what is missing."""
    out = left.join(right, on, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def skewed_lookup(left: DataFrame, right: DataFrame, on: str, count: str, spread: Sequence[str], n: int) -> DataFrame:
    """Left join with a row per key, where a key may hold any share of the rows of ``left``.

    ``right`` has a row per key, with ``count``, the rows of ``left`` that have it; it is read three times, so it should
    be a written table. Keys above an n-th of all those rows are n at most, and they alone are broadcast; their rows
    then go, by a hash of the columns ``spread``, to all tasks. Every other key is less than one task's share.
    """
    rest = [c for c in right.columns if c not in (on, count)]
    total = right.agg(F.sum(count)).first()[0] or 0
    hot = right.filter(F.col(count) * n > total).select(F.col(on).alias("_on"), F.struct(*rest).alias("_hot"))
    rows = left.join(F.broadcast(hot), F.col(on) == F.col("_on"), "left").drop("_on")
    rows = rows.withColumn("_salt", F.when(F.col("_hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*spread), F.lit(n))))
    # always 0, but no constant: a constant would be folded away and the join dealt by the key alone
    cool = right.select(on, F.struct(*rest).alias("_cool"), F.pmod(F.xxhash64(on), F.lit(1)).cast("long").alias("_salt"))
    out = rows.withColumn("_salt", F.col("_salt").cast("long")).join(cool, [on, "_salt"], "left")
    found = F.coalesce("_hot", "_cool")
    return out.select(*left.columns, *[found[c].alias(c) for c in rest])


def encode_tokens(df: DataFrame, key: str, tokens: str, vocab: DataFrame, unknown: int) -> DataFrame:
    """Token arrays to id arrays; tokens outside the vocabulary get ``unknown``. ``vocab``: word, id."""
    rows = df.select(key, F.posexplode(tokens).alias("_p", "word"))
    found = rows.join(vocab.groupBy("word").agg(F.max("id").alias("id")), "word", "left")
    made = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_p", F.coalesce("id", F.lit(unknown)).alias("id")))).alias("_l"))
    out = df.select(key).join(made, key, "left")
    return out.select(key, F.coalesce(F.transform("_l", lambda x: x["id"]), F.array().cast("array<bigint>")).alias("ids"))


def restrict_vocabulary(words: DataFrame, pretrained: DataFrame, specials: Sequence[str] = ("<pad>", "<unk>")) -> DataFrame:
    """Wanted words (word, ord) with pretrained vectors (word, vector), the ``<unk>`` vector where there is none;
    specials come first with zero vectors."""
    dim = pretrained.agg(F.max(F.size("vector"))).first()[0] or 0  # one number
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    known = words.join(pretrained, "word", "left").select(
        "word", (F.col("ord") + len(specials)).alias("id"), F.coalesce("vector", zero).alias("vector")
    )
    spark = words.sparkSession
    first = spark.createDataFrame([(w, k) for k, w in enumerate(specials)], "word string, id long")
    return first.withColumn("vector", zero).unionByName(known)


def pairs(left: DataFrame, right: DataFrame, right_prefix: str, block: str | None = None) -> DataFrame:
    """All pairs, the matrix operator: the result itself has left x right rows. ``block`` limits pairs to equal
    values of a column, which makes it an equi-join."""
    r = right.toDF(*[right_prefix + c for c in right.columns])
    return left.join(r, F.col(block) == F.col(right_prefix + block)) if block else left.crossJoin(r)


def zip_by_position(left: str, right: str) -> Column:
    """I-th with i-th."""
    return F.arrays_zip(left, right)


def resolve(left: DataFrame, right: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """(resolved rows with what was found, unresolved rows)."""
    return left.join(right, on), left.join(right, on, "left_anti")


# -- aggregation ---------------------------------------------------------------------------------------------------


def last_by_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key, the last by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def rows_by_key(df: DataFrame, keys: Sequence[str], order: str, name: str = "rows") -> DataFrame:
    """The rows of each key as an array in order. A key's rows meet in one array, so keys must be of array size."""
    rest = [c for c in df.columns if c not in keys and c != order]
    made = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*rest).alias("_r"))))
    return df.groupBy(*keys).agg(F.transform(made, lambda x: x["_r"]).alias(name))


def usage(df: DataFrame, user: str, item: str, process: str, amount: str) -> DataFrame:
    """Distinct items, rows and total amount per user, the busiest first; null users are no users."""
    out = df.filter(F.col(user).isNotNull()).groupBy(user).agg(
        F.countDistinct(item).alias("n_items"), F.count(process).alias("n_rows"), F.sum(amount).alias("total")
    )
    return out.orderBy(F.desc_nulls_last("n_items"), F.desc_nulls_last("n_rows"), user)


def joined_distinct(column: str, sep: str = ", ") -> Column:
    """Distinct values as sorted text."""
    return F.array_join(F.sort_array(F.collect_set(column)), sep)


def columns_to_lists(df: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """A row per column with the list of its non-null values in order."""
    long = df.unpivot([order], list(columns), "name", "value").filter(F.col("value").isNotNull())
    made = F.array_sort(F.collect_list(F.struct(order, "value")))
    return long.groupBy("name").agg(F.transform(made, lambda x: x["value"]).alias("values"))


def merge_text(df: DataFrame, keys: Sequence[str], text: str, order: str, sep: str = "\n") -> DataFrame:
    """Texts of a key joined in order; null where there are none."""
    made = F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(order, text))))
    made = F.transform(made, lambda x: x[text])
    return df.groupBy(*keys).agg(F.when(F.size(made) > 0, F.array_join(made, sep)).alias(text))


def summary(df: DataFrame) -> DataFrame:
    """One row of type-dependent summaries: norm of floats, least and greatest of integers, counts of booleans."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.FractionalType):
            out.append(F.sqrt(F.sum(c * c)).alias(f"{f.name}_norm"))
        elif isinstance(f.dataType, T.IntegralType):
            out += [F.min(c).alias(f"{f.name}_min"), F.max(c).alias(f"{f.name}_max")]
        elif isinstance(f.dataType, T.BooleanType):
            out += [F.count_if(c).alias(f"{f.name}_true"), F.count_if(~c).alias(f"{f.name}_false")]
    return df.agg(*out)


def group_shares(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of each group and their share of all rows (the total is one number, joined)."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("_total")).drop("_total")


def safe_mask(df: DataFrame, key: str, item: str, mask: str, seed: int = 0) -> DataFrame:
    """Where a key's mask is constant, the item with the smallest hash is flipped."""
    sums = df.groupBy(key).agg(
        F.sum(F.col(mask).cast("int")).alias("_s"),
        F.count("*").alias("_n"),
        F.min_by(item, F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(item)))).alias("_i"),
    )
    flip = F.col("_s").isin(0) | (F.col("_s") == F.col("_n"))
    out = df.join(sums, key)
    return out.withColumn(mask, F.when(flip & (F.col(item) == F.col("_i")), ~F.col(mask)).otherwise(F.col(mask))).select(*df.columns)


# -- order and set -------------------------------------------------------------------------------------------------


def rank_available(df: DataFrame, weight: Column, tie: str) -> DataFrame:
    """By weight, largest first; the weight itself is not returned."""
    return df.orderBy(F.desc_nulls_last(weight), tie)


def top_n(df: DataFrame, *order, n: int = 30) -> DataFrame:
    """A sort with a limit, so partitions keep n rows each."""
    return df.orderBy(*order).limit(n)


def top_k_per_group(df: DataFrame, keys: Sequence[str], score: str, k: int, ties: Sequence[str]) -> DataFrame:
    """The k best of each group with their rank; Spark keeps k rows a group before the exchange (group limit)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), *ties)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def page(df: DataFrame, order: str, number: int, size: int) -> DataFrame:
    """The rows of one page (from 0)."""
    return df.orderBy(order).offset(number * size).limit(size)


def appeared(old: DataFrame, new: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """(keys new only, keys old only)."""
    return new.join(old, on, "left_anti"), old.join(new, on, "left_anti")


def symmetric_difference(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """Keys in exactly one of two tables, with the side."""
    left, right = a.select(on).distinct().withColumn("_a", F.lit(1)), b.select(on).distinct().withColumn("_b", F.lit(1))
    both = left.join(right, on, "full_outer").filter(F.col("_a").isNull() | F.col("_b").isNull())
    return both.select(on, F.when(F.col("_a").isNotNull(), "left").otherwise("right").alias("side"))


def ordered_distinct(df: DataFrame, key: str, pos: str) -> DataFrame:
    """Distinct keys with the position of their first occurrence."""
    return df.groupBy(key).agg(F.min(pos).alias("first"))


def union_all(*frames: DataFrame) -> DataFrame:
    """All rows; columns that a frame lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
