"""The campaign over files of landed offers, and deduplication that tolerates late rows."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from offerlake import storage
from offerlake.config import Config, Profile
from offerlake.functions.text import cross_key
from offerlake.operators.filters import judged
from offerlake.operators.score import score_offers
from offerlake.operators.store import upsert_offers
from offerlake.plans.campaign import facts


def passing(offers: DataFrame, cfg: Config, profile: Profile, as_of: datetime) -> DataFrame:
    """Scored offers of a stream that pass all filters; rows go one by one, so batch and stream agree. Which of equal
    offers stays is settled by the merge."""
    good = judged(facts(offers), cfg, as_of).where("reject_reason is null").drop("reject_reason")
    return score_offers(good, profile, cfg, as_of)


def merge_stream(scored: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch under its own number in `target`, so that a batch that is run again replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return scored.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


EMPTY = {"status": "string", "first_seen_at": "timestamp", "notes": "string", "starred": "boolean", "discarded": "boolean"}


def merge_into_store(scored: DataFrame, root: str, checkpoint: str, seen_at: Column) -> StreamingQuery:
    """Merges each micro-batch into the offers store in `root` and switches to the new version. Annotations stay, and a
    batch that is run again changes nothing, as its offers are known by then."""

    def put(batch: DataFrame, number: int) -> None:
        known = storage.current(batch.sparkSession, root)
        if known is None:
            known = batch.where("false").withColumns({c: F.lit(None).cast(kind) for c, kind in EMPTY.items()})
        storage.put_version(upsert_offers(known, batch.dropDuplicates(["id"]), seen_at).drop("change"), root)

    return scored.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_firsts(scored: DataFrame, root: str, checkpoint: str, key: str = "cross_key", order: str = "seq", buckets: int = 64) -> StreamingQuery:
    """Keeps the first row by `order` of each key in a table of buckets by key, whichever batch brings it. A batch reads and
    writes only the buckets of its keys; one that is run again changes nothing."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = storage.written(batch.withColumn(storage.BUCKET, storage.bucket_of(key, buckets)), "batch")
        touched = [r[0] for r in rows.select(storage.BUCKET).distinct().collect()]  # as many as buckets at most
        if not touched:
            return
        if storage.exists(spark, root):
            rows = rows.unionByName(spark.read.parquet(root).where(F.col(storage.BUCKET).isin(touched)))
        first = rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("x")).select(key, "x.*")
        storage.put_partitions(storage.written(first, "firsts"), root, storage.BUCKET)

    return scored.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def without_late_repeats(offers: DataFrame, landed: str, order: str = "seq", margin_days: int = 2) -> DataFrame:
    """Of each cross key the first offer by `order` of a batch, unless one was let through less than the margin ago:
    `order` and cross_key, appended.

    Undated offers take their landing time. Offers older than the newest one of the batches before, less the margin, are
    late and go. A key's state is the time until which its repeats go, kept from batch to batch and dropped when the stream
    has passed it. A key's rows of a batch are read in chunks, of which one row is held.
    """
    micros = 86_400_000_000 * margin_days
    timed = offers.withColumn("event_at", F.coalesce("published_at", F.col(landed).cast("timestamp"))).withColumn("cross_key", cross_key(F.col("title"), F.col("company")))
    timed = timed.select(order, "cross_key", "event_at").withWatermark("event_at", f"{margin_days} days").withColumn("at", F.unix_micros("event_at"))

    def first(key: tuple[str], chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        passed = state.getCurrentWatermarkMs() * 1000
        best = None
        for chunk in chunks:
            own = chunk.loc[chunk[order].idxmin(), [order, "at"]]
            best = own if best is None or own[order] < best[order] else best
        until = state.get[0] if state.exists else None
        if until is None or until < passed:
            until = int(best["at"]) + micros
            yield pd.DataFrame({order: [best[order]], "cross_key": [key[0]]})
        state.update((until,))
        state.setTimeoutTimestamp(max(until, passed + 1000) // 1000)

    kind = dict(timed.dtypes)[order]
    return timed.groupBy("cross_key").applyInPandasWithState(first, f"{order} {kind}, cross_key string", "until long", "append", GroupStateTimeout.EventTimeTimeout)
