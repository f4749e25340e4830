"""Event streams: at-least-once sources, exact and bounded de-duplication, sequence acceptance, limits, idempotent sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.access import event_key

EVENT_SCHEMA = "event_id string, tenant_id string, run_id string, event_type string, sequence long, ts timestamp, payload string"


def file_events(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA, kind: str = "json", files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(kind).load(path)


def kafka_events(spark: SparkSession, servers: str, topic: str, schema: str = EVENT_SCHEMA) -> DataFrame:
    """Events of a topic, with the key that tells repeats apart. Needs the Kafka connector on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("failOnDataLoss", "true").load()
    got = raw.select(F.from_json(F.col("value").cast("string"), schema).alias("e"), "topic", "partition", "offset")
    return got.select("e.*", event_key(F.col("e.event_id"), F.col("topic"), F.col("partition"), F.col("offset")).alias("event_key"))


def deduplicated(events: DataFrame, key: str = "event_id", ts: str = "ts", within: str = "1 hour") -> DataFrame:
    """Each key once within the watermark: the state is bounded by time."""
    return events.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, ts: str = "ts", late: str = "10 minutes", width: str = "5 minutes", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def accepted_sequences(events: DataFrame, run: str = "run_id", sequence: str = "sequence", order: str = "ts") -> DataFrame:
    """(run, sequence, delivery) against the highest accepted number of the run, which the state keeps between batches."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0
        pdf = pd.concat(list(batches)).sort_values([order, sequence], kind="stable")
        out = []
        for n in pdf[sequence]:
            if pd.isna(n) or n <= 0:
                kind = "OUT_OF_ORDER"
            elif n == last + 1:
                kind, last = "ACCEPTED", int(n)
            else:
                kind = "DUPLICATE" if n == last else "GAP" if n > last else "OUT_OF_ORDER"
            out.append((key[0], None if pd.isna(n) else int(n), kind))
        state.update((last,))
        yield pd.DataFrame(out, columns=["run_id", "sequence", "delivery"]).astype({"sequence": "Int64"})

    return events.groupBy(run).applyInPandasWithState(step, "run_id string, sequence long, delivery string", "last long", "append", "NoTimeout")


def limited(events: DataFrame, key: str = "tenant_id", ts: str = "ts", limit: int = 10, seconds: int = 60) -> DataFrame:
    """(key, ts, allowed): a sliding limit whose refused hits leave no trace; the state holds the allowed times of the span."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values(ts, kind="stable")
        out = []
        for t in pdf[ts]:
            now = t.timestamp()
            kept = [x for x in kept if x > now - seconds]
            if len(kept) < limit:
                kept.append(now)
                out.append((k[0], t, True))
            else:
                out.append((k[0], t, False))
        state.update((kept,))
        yield pd.DataFrame(out, columns=["key", "ts", "allowed"])

    return events.groupBy(key).applyInPandasWithState(step, "key string, ts timestamp, allowed boolean", "kept array<double>", "append", "NoTimeout")


def idempotent_sink(target: str, ledger: str, key: str = "event_id", bad: Callable | None = None, dead: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: new keys are appended once, even if a batch comes again; rows that `bad` marks go to the dead letters.

    Each batch writes folders that its number names, over any earlier try, so a repeated batch changes nothing; keys of
    other batches are left out by an anti join with the ledger.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if bad is not None and dead is not None:
            from folioforge.operators.events import dead_letters

            dead_letters(batch, bad(batch), "payload").write.mode("overwrite").parquet(f"{dead}/batch={number}")
            batch = batch.where(~F.coalesce(bad(batch), F.lit(False)))
        fresh = batch.dropDuplicates([key])
        try:
            known = spark.read.option("basePath", ledger).parquet(ledger).where(F.col("batch") != number).select(key)
            fresh = fresh.join(known, key, "left_anti")
        except Exception as e:  # the first batch finds no ledger
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        fresh.write.mode("overwrite").parquet(f"{target}/batch={number}")
        fresh.select(key).write.mode("overwrite").parquet(f"{ledger}/batch={number}")

    return write
