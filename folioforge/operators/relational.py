"""Relational shapes of the review backend: latest rows, counts, feeds, pages, anti joins, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _desc(order: Sequence[str]) -> list[Column]:
    return [F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in order]


def latest_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each group in the given order ("-c" is descending). Spark ranks within partitions before the shuffle, so a group sends one row from each."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*_desc(order)))).where("_rn = 1").drop("_rn")


def latest_value(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """(keys, value) of the greatest order columns: an aggregate that combines before the shuffle."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def latest_with_count(df: DataFrame, keys: Sequence[str], order: Sequence[str], count: str = "n") -> DataFrame:
    """The latest row of each group and how many rows it has: one aggregate, not a window over all rows."""
    rest = [c for c in df.columns if c not in keys]
    ranked = [F.col(c[1:]) if c.startswith("-") else -F.col(c) for c in order]
    got = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*ranked)).alias("_row"), F.count("*").alias(count))
    return got.select(*keys, "_row.*", count)


def conditional_counts(df: DataFrame, keys: Sequence[str], conditions: dict[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def union_feed(sources: Sequence[DataFrame], columns: Sequence[str] = ("id", "occurred_at", "actor", "title", "detail")) -> DataFrame:
    """Sources of different shapes, each already projected to the feed's columns, as one."""
    out = sources[0].select(*columns)
    for s in sources[1:]:
        out = out.unionByName(s.select(*columns))
    return out


def page(df: DataFrame, order: Sequence[str], limit: int, offset: int = 0) -> DataFrame:
    """One page of a total order. limit and offset make a top-k of each partition, not a full sort."""
    return df.orderBy(*_desc(order)).offset(offset).limit(limit)


def keyset_page(df: DataFrame, key: str, after, limit: int) -> DataFrame:
    """The next rows after a cursor; the filter reaches the scan."""
    return (df if after is None else df.where(F.col(key) > F.lit(after))).orderBy(key).limit(limit)


def without(df: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows without a tombstone; null keys have none."""
    return df.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def page_then_enrich(df: DataFrame, order: Sequence[str], limit: int, offset: int, more: DataFrame, key: str) -> DataFrame:
    """A page first, then the wide join for its rows alone."""
    return page(df, order, limit, offset).join(more, key, "left")


def keep_latest_upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Old and new rows, the greatest version of each key; a new row wins a tie."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest_per_group(both, keys, [f"-{version}", "-_new"]).drop("_new")


def replace_groups(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What a table holds after the rows of the keys in `new` were deleted and `new` inserted."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def idempotent_insert(table: DataFrame, rows: DataFrame, keys: Sequence[str], digest: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(to insert, known, conflicts): rows with a new key, the first of each; rows that the table has; rows whose key it has with another digest."""
    first = latest_per_group(rows, keys, [digest])
    known = table.select(*keys, F.col(digest).alias("_held"))
    met = rows.join(known, list(keys))
    fresh = first.join(known, list(keys), "left_anti")
    inner = rows.join(fresh.select(*keys, F.col(digest).alias("_held")), list(keys))
    conflict = lambda d: d.where(~F.col(digest).eqNullSafe(F.col("_held"))).drop("_held")
    return fresh, met.where(F.col(digest).eqNullSafe(F.col("_held"))).drop("_held"), conflict(met).unionByName(conflict(inner))


def effective_values(facts: DataFrame, actions: DataFrame, key: str = "fact_id", value: str = "value", corrected: str = "corrected_value", order: Sequence[str] = ("created_at", "action_id")) -> DataFrame:
    """Facts with the value that the latest review action gave them, and the number of actions as version, 0 if unreviewed."""
    last = actions.groupBy(key).agg(F.max_by(corrected, F.struct(*order)).alias("_corrected"), F.count("*").alias("version"))
    return facts.join(last, key, "left").withColumn("effective_value", F.coalesce("_corrected", value)).withColumn("version", F.coalesce("version", F.lit(0)).cast("long")).drop("_corrected")


def versioned_append(current: DataFrame, actions: DataFrame, key: str, version: str, base: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, conflicts): an action is accepted if its base version is the current one, 0 for unknown keys."""
    met = actions.join(current.select(key, F.col(version).alias("_now")), key, "left").withColumn("_now", F.coalesce("_now", F.lit(0)))
    return met.where(F.col(base) == F.col("_now")).drop("_now"), met.where(~F.col(base).eqNullSafe(F.col("_now"))).drop("_now")


def split_or_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], row: str) -> DataFrame:
    """Left rows with right rows that agree on any of several key pairs: one equi-join each, a pair once. row names a unique column of the right."""
    parts = [left.join(right, F.col(a) == F.col(b)) for a, b in keys]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates([*left.columns, row])


def any_drop_withholds(answers: DataFrame, citations: DataFrame, allowed: DataFrame, answer: str = "answer_id", document: str = "document_id") -> DataFrame:
    """Answers with `withheld`: whether a citation names a document that isn't allowed; their text is null then."""
    dropped = citations.join(allowed.select(document).distinct(), document, "left_anti").select(answer).distinct().withColumn("withheld", F.lit(True))
    got = answers.join(dropped, answer, "left").withColumn("withheld", F.coalesce("withheld", F.lit(False)))
    return got.withColumn("text", F.when(~F.col("withheld"), F.col("text")))


def overdue(runs: DataFrame, pages: DataFrame, now: Column, base_s: int, page_s: int, run: str = "run_id") -> DataFrame:
    """Processing runs that wait strictly longer than a deadline that grows with their pages."""
    counted = pages.groupBy(run).agg(F.sum("pages").alias("_pages"))
    waited = now.cast("timestamp").cast("double") - F.col("started_at").cast("timestamp").cast("double")
    return runs.where("status = 'PROCESSING'").join(counted, run, "left").where(waited > base_s + page_s * F.coalesce("_pages", F.lit(0))).drop("_pages")


def page_progress(documents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pages done of all if every document knows its count, else documents done of all; a document's done pages lie between 0 and its count."""
    done = F.sum(F.least(F.greatest(F.coalesce("done", F.lit(0)), F.lit(0)), F.col("pages")))
    known = F.bool_and(F.col("pages").isNotNull())
    finished = F.count_if(F.col("status") == "DONE")
    return documents.groupBy(*keys).agg(F.when(known, done).otherwise(finished).alias("done"), F.when(known, F.sum("pages")).otherwise(F.count("*")).alias("total"), F.when(known, "pages").otherwise("documents").alias("unit"))


def legacy_continuity(tables: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs of tables over a page break: the last anchored one of page p and the first anchored one of p + 1, of equal width, numbered on."""
    anchored = tables.where("first_anchor IS NOT NULL AND last_anchor IS NOT NULL")
    row = F.struct("table_id", "width", "first_anchor", "last_anchor")
    edge = anchored.groupBy(*keys, "page").agg(F.max_by(row, "table_id").alias("last"), F.min_by(row, "table_id").alias("first"))
    a = edge.select(*keys, (F.col("page") + 1).alias("page"), "last")
    met = a.join(edge.select(*keys, "page", "first"), [*keys, "page"])
    return met.where("last.width = first.width AND first.first_anchor = last.last_anchor + 1").select(*keys, F.col("last.table_id").alias("table_id"), F.col("first.table_id").alias("next_table_id"))


def trailing_count(df: DataFrame, keys: Sequence[str], ts: str, seconds: int, out: str = "n_recent") -> DataFrame:
    """Rows of the group in the trailing span before and with each row."""
    at = F.col(ts).cast("timestamp").cast("long")
    return df.withColumn(out, F.count("*").over(W.partitionBy(*keys).orderBy(at).rangeBetween(-seconds, 0)))


def purge(df: DataFrame, tombstones: DataFrame, keys: Sequence[str]) -> DataFrame:
    return without(df, tombstones, keys)
