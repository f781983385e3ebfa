"""A whole run: what was landed since the last run, through the campaign, into the store, with a record in the run log."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake import storage
from offerlake.config import Config, Profile
from offerlake.operators.filters import decided, judged, rejection_report
from offerlake.operators.score import score_offers
from offerlake.operators.store import merge_offers
from offerlake.plans.campaign import facts

RUN = "started_at timestamp, sources string, fetched long, kept long, new_offers long, updated_offers long, detail string, run string"


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """The records of all runs, none before the first."""
    return spark.read.schema(RUN).parquet(path) if storage.exists(spark, path) else spark.createDataFrame([], RUN)


def last_started(runs: DataFrame, before: str) -> DataFrame:
    """One row, `cutoff`: when the last run but `before` started."""
    return runs.where(F.col("run") != before).agg(F.max("started_at").alias("cutoff"))


def run_campaign(spark: SparkSession, landed: str, store: str, runs: str, run_id: str, cfg: Config, profile: Profile, started_at: datetime, order: str = "seq", everything: bool = False, buckets: int = 64) -> DataFrame:
    """Runs a campaign over the folder `landed` (`storage.land`) and returns its record.

    Offers published before the last run, less the margin, aren't read at all, unless `everything` is asked for. Kept
    offers are merged into `store`; each carries in `first_run` the run that brought it, so a run that was ended anywhere
    and is run again under its id finds the same new offers, leaves the same store and one record.
    """
    margin = timedelta(days=cfg.refresh_margin_days)
    cutoffs = None if everything else last_started(run_log(spark, runs), run_id).select((F.col("cutoff") - F.lit(margin)).alias("cutoff"))
    cutoff = cutoffs.first()[0] if cutoffs is not None else None  # one value
    offers = storage.landed_since(spark, landed, cutoffs)
    fetched = storage.written(judged(facts(offers), cfg, started_at, cutoff), "fetched")
    decisions = storage.written(decided(fetched.select(order, "id", "source", "cross_key", "reject_reason"), order), "decisions")
    kept = fetched.drop("id", "source", "cross_key", "reject_reason").join(decisions.where("decision = 'kept'").select(order, "id", "source", "cross_key"), order)
    scored = score_offers(kept, profile, cfg, started_at).withColumn("first_run", F.lit(run_id)).drop("day", "landing")
    scored = scored.groupBy("id").agg(F.min_by(F.struct(*[c for c in scored.columns if c != "id"]), order).alias("o")).select("id", "o.*")
    merged = merge_offers(scored, store, F.lit(started_at), buckets)
    report = rejection_report(decisions)
    detail = report.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "reason"))), lambda r: F.concat(r["reason"], F.lit("="), (-r["n"]).cast("string"))), ", ").alias("detail"))
    counts = decisions.agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count("*").alias("fetched"))
    merged = merged.agg(F.count("*").alias("kept"), F.count_if(F.col("first_run") == run_id).alias("new_offers"), F.count_if(F.col("first_run") != run_id).alias("updated_offers"))
    record = counts.join(merged).join(detail).select(F.lit(started_at).alias("started_at"), "sources", "fetched", "kept", "new_offers", "updated_offers", "detail")
    storage.append_run(storage.written(record, "record"), runs, run_id)
    return run_log(spark, runs).where(F.col("run") == run_id)
