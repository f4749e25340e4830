"""Event logs in batch: de-duplication, gaps, replay, audit chains, traces."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def once(events: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first event of each key."""
    return events.withColumn("_rn", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_rn = 1").drop("_rn")


def unprocessed(events: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    return events.join(ledger.select(key).distinct(), key, "left_anti")


def dead_letters(records: DataFrame, bad: Column, value: str, longest: int = 65536) -> DataFrame:
    """Records that can't be handled, with the value's digest; a long value becomes a pointer."""
    long_ = F.octet_length(F.col(value)) > longest
    return records.where(bad).withColumn("value_sha256", F.sha2(F.col(value).cast("binary"), 256)).withColumn("value_pointer", F.when(long_, F.concat(F.lit("sha256:"), F.col("value_sha256")))).withColumn(value, F.when(~long_, F.col(value)))


def folded(df: DataFrame, keys: Sequence[str], order: Sequence[str], reads: Sequence[str], out: str, kind: T.DataType, begin: Callable[[], Callable]) -> DataFrame:
    """df with a column folded over each key's rows in order: begin() gives a key's step, a function from the columns read to the new value.

    Rows are dealt and sorted by Spark and streamed, so a task keeps one key's state and no group. Ties of the order go
    by all other columns. Other columns stay the Arrow columns that they are.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    placed = df.repartition(*keys).sortWithinPartitions(*keys, *order, *rest)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step = None, None
        for b in batches:
            get = lambda cs, b=b: list(zip(*(b.column(names.index(c)).to_pylist() for c in cs), strict=True))
            made = []
            for key, row in zip(get(keys), get(reads), strict=True):
                if step is None or key != now:
                    now, step = key, begin()
                made.append(step(*row))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, to_arrow_type(kind))], names=[*names, out])

    return placed.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, kind)]))


def classify_deliveries(events: DataFrame, keys: Sequence[str], arrival: str, sequence: str) -> DataFrame:
    """events with delivery: ACCEPTED for the next number, DUPLICATE for the last accepted, GAP beyond the next, OUT_OF_ORDER below or for no number. The last accepted number moves on ACCEPTED alone."""

    def begin() -> Callable:
        last = 0

        def step(n: int | None) -> str:
            nonlocal last
            if n is None or n <= 0:
                return "OUT_OF_ORDER"
            if n == last + 1:
                last = n
                return "ACCEPTED"
            return "DUPLICATE" if n == last else "GAP" if n > last else "OUT_OF_ORDER"

        return step

    return folded(events, keys, [arrival], [sequence], "delivery", T.StringType(), begin)


def sequence_gaps(events: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    """Places where a number doesn't follow the one before: (keys, after, before, missing)."""
    prev = F.lag(sequence).over(W.partitionBy(*keys).orderBy(sequence))
    return events.withColumn("after", prev).where(F.col(sequence) > F.col("after") + 1).select(*keys, "after", F.col(sequence).alias("before"), (F.col(sequence) - F.col("after") - 1).alias("missing"))


def replay(events: DataFrame, snapshots: DataFrame, run: str, sequence: str, after: Column) -> DataFrame:
    """Events behind the snapshot or the cursor, whichever is later, with `contiguous`: false from a gap on."""
    base = snapshots.select(run, F.col(sequence).alias("_snap"))
    rest = events.join(base, run, "left").withColumn("_from", F.greatest(F.coalesce("_snap", F.lit(0)), F.coalesce(after, F.lit(0)))).where(F.col(sequence) > F.col("_from"))
    w = W.partitionBy(run).orderBy(sequence)
    step = F.col(sequence) - F.coalesce(F.lag(sequence).over(w), F.col("_from"))
    whole = F.max(step).over(w.rowsBetween(W.unboundedPreceding, 0)) == 1
    return rest.withColumn("contiguous", whole).drop("_snap", "_from")


def fold_events(events: DataFrame, run: str, order: str, kind: str, value: str, rules: dict[str, Callable[[Column, Column], Column]], start: Column) -> DataFrame:
    """(run, state): the events folded in order over a start value; rules give the new state for each kind, others leave it."""
    got = events.groupBy(run).agg(F.array_sort(F.collect_list(F.struct(order, kind, value))).alias("_e"))

    def step(acc: Column, e: Column) -> Column:
        out = F
        for name, rule in rules.items():
            out = out.when(e[kind] == name, rule(acc, e[value]))
        return out.otherwise(acc)

    return got.select(run, F.aggregate("_e", start, step).alias("state"))


def verify_chain(rows: DataFrame, keys: Sequence[str], order: Sequence[str], digest: str, previous: str) -> DataFrame:
    """Rows of a hash chain that don't name the digest before them; the first names none."""
    before = F.lag(digest).over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_before", before).where(~F.col(previous).eqNullSafe(F.col("_before"))).drop("_before")


def write_chain(rows: DataFrame, keys: Sequence[str], order: Sequence[str], payload: str) -> DataFrame:
    """rows with previous and digest: SHA-256 of the digest before and the payload, folded in order."""
    names = [c for c in rows.columns if c not in keys]
    got = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in names if c not in order]))).alias("_r"))
    digests = F.aggregate("_r", F.array().cast("array<string>"), lambda acc, r: F.concat(acc, F.array(F.sha2(F.concat(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")), F.coalesce(r[payload].cast("string"), F.lit(""))).cast("binary"), 256))))
    z = got.select(*keys, F.explode(F.arrays_zip("_r", digests.alias("d"), F.concat(F.array(F.lit(None).cast("string")), digests).alias("p"))).alias("z")).where("z._r IS NOT NULL")
    return z.select(*keys, *[F.col(f"z._r.{c}").alias(c) for c in names], F.col("z.p").alias("previous"), F.col("z.d").alias("digest"))


def open_stages(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stages that were started and have no terminal event. Columns execution_id, stage, status."""
    k = [*keys, "execution_id", "stage"]
    ended = events.where("status IN ('SUCCEEDED', 'FAILED', 'SKIPPED')").select(*k).distinct()
    return events.where("status = 'STARTED'").select(*k).distinct().join(ended, k, "left_anti")


def processing_trace(events: DataFrame, keys: Sequence[str], sequence: str, terminal: DataFrame) -> DataFrame:
    """(keys, stage, status): the last event of each stage of the first event's execution; what runs in a job that has ended is INCOMPLETE_UNKNOWN."""
    first = events.groupBy(*keys).agg(F.min_by("execution_id", sequence).alias("execution_id"))
    last = events.join(first, [*keys, "execution_id"]).groupBy(*keys, "stage").agg(F.max_by("status", sequence).alias("status"))
    done = terminal.select(*keys, F.lit(True).alias("_done")).distinct()
    return last.join(done, list(keys), "left").withColumn("status", F.when(F.col("_done") & F.col("status").isin("STARTED", "RUNNING"), "INCOMPLETE_UNKNOWN").otherwise(F.col("status"))).drop("_done")


def submit_once(known: DataFrame, records: DataFrame, key: str, digest: str) -> tuple[DataFrame, DataFrame]:
    """(new, conflicts): one record for each new key; a known key with another digest is a conflict."""
    from folioforge.operators.relational import idempotent_insert

    fresh, _, conflicts = idempotent_insert(known, records, [key], digest)
    return fresh, conflicts


def sliding_limit(hits: DataFrame, key: str, ts: str, limit: int, seconds: int, tie: Sequence[str] = ()) -> DataFrame:
    """hits with allowed: fewer than `limit` allowed hits of the key in the span before; a refused hit leaves no trace. Equal times go by `tie`, then by all other columns; a hit without a time gets null."""

    def begin() -> Callable:
        kept: deque = deque()

        def step(t) -> bool | None:
            if t is None:
                return None
            at = t.timestamp() if hasattr(t, "timestamp") else t
            while kept and kept[0] <= at - seconds:
                kept.popleft()
            ok = len(kept) < limit
            if ok:
                kept.append(at)
            return ok

        return step

    return folded(hits, [key], [ts, *tie], [ts], "allowed", T.BooleanType(), begin)


def progress_events(events: DataFrame, keys: Sequence[str], ts: str, done: str, total: str, seconds: float = 1.0) -> DataFrame:
    """Progress that is told: done has grown since the last told, and it is the last page or so many seconds have passed."""
    schema = events.schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([ts, done])
        told, at, keep = -1, None, []
        for t, d, n in zip(pd.to_datetime(pdf[ts]), pdf[done], pdf[total], strict=True):
            ok = d > told and (d >= n or at is None or (t - at).total_seconds() >= seconds)
            if ok:
                told, at = d, t
            keep.append(ok)
        return pdf[keep]

    return events.groupBy(*keys).applyInPandas(run, schema)


def recorded_results(results: DataFrame, recorded: DataFrame, keys: Sequence[str], digest: str) -> DataFrame:
    """Results whose document is recorded already, with no digest or the same one."""
    held = recorded.select(*keys, F.col(digest).alias("_d"))
    met = results.join(held, list(keys)).where(F.col(digest).isNull() | (F.col(digest) == F.col("_d")))
    return met.select(*results.columns).distinct()


def late_results(results: DataFrame, runs: DataFrame, run: str) -> tuple[DataFrame, DataFrame]:
    """(to apply, to audit): results of failed runs are audited and never applied."""
    failed = runs.where("status = 'FAILED'").select(run).distinct()
    return results.join(failed, run, "left_anti"), results.join(failed, run, "left_semi")


def scoped(events: DataFrame, tenant: str, run: str | None = None, resource: str | None = None) -> DataFrame:
    out = events.where(F.col("tenant_id") == tenant)
    if run is not None:
        out = out.where(F.col("run_id") == run)
    return out if resource is None else out.where(F.col("resource_id") == resource)


def public_events(events: DataFrame, allowed: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Events of allowed types, and their public columns alone."""
    return events.where(F.col("event_type").isin(*allowed)).select(*columns)

