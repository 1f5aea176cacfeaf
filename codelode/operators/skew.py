"""Grouping and joining when a few keys hold most of the rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Bounds of the number of parts into which all rows would be cut, and so of the heavy keys,
#: of which there are at most as many. Between them it is the session's number of shuffle
#: partitions: a part then holds no more rows than a task does on average.
LEAST_PARTS, MOST_PARTS = 500, 50_000


def parts(spark: SparkSession) -> int:
    return min(max(LEAST_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions"))), MOST_PARTS)


def heavy_keys(df: DataFrame, keys: list[str], share: float | None = None) -> DataFrame | None:
    """(keys..., _salts): the keys with at least ``share`` of df's rows, and into how many parts to cut each; None if there are none.

    The counts are exact and combined before their shuffle. At most 1/share keys can be
    heavy, whatever the data, so no more than so many rows reach the driver, and the
    result may be broadcast. By default the share is that of one of ``parts`` parts.
    """
    spark = df.sparkSession
    share = share or 1 / parts(spark)
    rows = df.select(*keys)
    least = max(2.0, rows.count() * share)
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    found = [(*[r[k] for k in keys], math.ceil(r["_n"] / least)) for r in counted.collect()]
    schema = StructType([*[counted.schema[k] for k in keys], StructField("_salts", IntegerType())])
    return spark.createDataFrame(found, schema) if found else None


def heavy_counted(counted: DataFrame, keys: list[str], n: str, share: float | None = None) -> DataFrame | None:
    """The same from a written table of the number ``n`` of rows per key."""
    share = share or 1 / parts(counted.sparkSession)
    total, most = counted.agg(F.sum(n), F.max(n)).first()
    least = max(2.0, (total or 0) * share)
    if (most or 0) < least:
        return None
    return counted.where(F.col(n) >= least).select(*keys, F.ceil(F.col(n) / least).cast("int").alias("_salts"))


def with_salt(df: DataFrame, keys: list[str], heavy: DataFrame | None, spread: list[str]) -> DataFrame:
    """df plus ``_salt``: 0 for light keys, for heavy ones a number drawn from the hash of ``spread``.

    The draw is a hash rather than rand(), so that a task that runs again draws alike.
    """
    if heavy is None:
        return df.withColumn("_salt", F.lit(0))
    h = F.broadcast(heavy.select(*[F.col(k).alias(f"_h_{k}") for k in keys], "_salts"))
    on = F.lit(True)
    for k in keys:
        on = on & df[k].eqNullSafe(h[f"_h_{k}"])
    salt = F.pmod(F.xxhash64(*spread), F.coalesce(F.col("_salts"), F.lit(1)).cast("long")).cast("int")
    return df.join(h, on, "left").withColumn("_salt", salt).drop("_salts", *[f"_h_{k}" for k in keys])


def keyed_counts(
    df: DataFrame,
    keys: list[str],
    row_id: str,
    members: str | None = None,
    spans: list[str] = (),
    share: float | None = None,
) -> DataFrame:
    """Per key: ``n_rows`` distinct row ids, ``n_members`` distinct members, min/max of ``spans``.

    Two stages: rows of heavy keys are salted by the hash of their id and summarised per
    (key, salt), which also drops rows that were delivered twice; the parts are then merged
    per key. Distinct members are found per (key, member) between the stages, so that no
    task ever holds a key's whole member set.

    Null keys form a group of their own, as in SQL. Rows without an id are not counted, as
    their number of deliveries is unknown. An empty table gives no rows. Other columns,
    whatever their names, are not read. Column names must not start with an underscore.
    """
    cols = list(dict.fromkeys([*keys, row_id, *([members] if members else []), *spans]))
    rows = df.select(*cols).where(F.col(row_id).isNotNull())
    salted = with_salt(rows, keys, heavy_keys(rows, keys, share), [row_id])
    part = [*keys, "_salt"]
    extremes = [f(c).alias(f"{n}_{c}") for c in spans for n, f in (("min", F.min), ("max", F.max))]
    # One shuffle by (key, salt); the grouping by row id below it needs none of its own.
    unique = salted.repartition(*part).groupBy(*part, row_id).agg(*[F.first(c).alias(c) for c in cols if c not in (*keys, row_id)], F.lit(1).alias("_one"))
    again = [f(f"{n}_{c}").alias(f"{n}_{c}") for c in spans for n, f in (("min", F.min), ("max", F.max))]
    if members is None:
        partial = unique.groupBy(*part).agg(F.sum("_one").alias("_n"), *extremes)
        return partial.groupBy(*keys).agg(F.sum("_n").alias("n_rows"), *again)
    partial = unique.groupBy(*part, members).agg(F.sum("_one").alias("_n"), *extremes)
    per_member = partial.groupBy(*keys, members).agg(F.sum("_n").alias("_n"), *again)
    return per_member.groupBy(*keys).agg(F.sum("_n").alias("n_rows"), F.count(members).alias("n_members"), *again)


def spread_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str,
    spread: list[str],
    share: float | None = None,
    known: tuple[DataFrame | None] | None = None,
) -> DataFrame:
    """Join left with right, which holds each key at most once or a few times, when left has heavy keys.

    Heavy keys' rows on the left are salted by the hash of ``spread`` and only those keys'
    rows on the right are repeated, once per salt. Null keys match nothing. ``how`` is
    inner, left, left_semi or left_anti. The left side is counted, grouped by key and
    joined, the right side runs once; where its heavy keys are handed in, as a tuple
    of that one table, both run once. So a left side that is costly to make should be cut,
    or its heavy keys be known.
    """
    heavy = known[0] if known else heavy_keys(left.select(*on).dropna(), on, share)
    if heavy is None:
        return left.join(right, on, how)
    a = with_salt(left, on, heavy, spread)
    h = F.broadcast(heavy.select(*[F.col(k).alias(f"_h_{k}") for k in on], "_salts"))
    cond = F.lit(True)
    for k in on:
        cond = cond & (right[k] == h[f"_h_{k}"])
    b = (
        right.join(h, cond, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
        .drop("_salts", *[f"_h_{k}" for k in on])
    )
    return a.join(b, [*on, "_salt"], how).drop("_salt")
