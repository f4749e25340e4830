"""Sinks: keyed replacement, frozen sets with digests, plain files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def replace_partitions(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """The partitions that df has are replaced, others stay: the delete and insert of a dossier's rows as one write."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def canonical_json(row: Column) -> Column:
    """JSON of a struct with null fields kept; fields in the struct's order, map keys sorted by the caller."""
    return F.to_json(row, {"ignoreNullFields": "false"})


def sorted_map(m: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(m)))


def freeze(df: DataFrame, path: str, key: str, content: Sequence[str]) -> DataFrame:
    """Writes df and, beside it, a manifest of SHA-256 digests without texts, sorted by key. Returns the manifest."""
    df.write.mode("errorifexists").parquet(f"{path}/data")
    digest = F.sha2(canonical_json(F.struct(*sorted(content))).cast("binary"), 256)
    manifest = df.select(key, digest.alias("sha256")).orderBy(key)
    manifest.write.mode("errorifexists").parquet(f"{path}/manifest")
    return df.sparkSession.read.parquet(f"{path}/manifest")


def changed(frozen: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """(key, change): ADDED, REMOVED or CHANGED against a manifest."""
    a, b = frozen.select(key, F.col("sha256").alias("a")), now.select(key, F.col("sha256").alias("b"))
    state = F.when(F.col("a").isNull(), "ADDED").when(F.col("b").isNull(), "REMOVED").otherwise("CHANGED")
    return a.join(b, key, "full").where(~F.col("a").eqNullSafe(F.col("b"))).select(key, state.alias("change"))


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
