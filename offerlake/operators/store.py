"""The offers store: merge of a campaign, annotations from events, applications, runs and the queries on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlake.storage import BUCKET, bucket_of, exists, put_partitions, written

KEPT = {"status": "new", "first_seen_at": None, "notes": "", "starred": False, "discarded": False}
FIRST_RUN = "first_run"
FUNNEL = ["interview", "replied", "sent", "drafted"]


def upsert_offers(existing: DataFrame, incoming: DataFrame, seen_at: Column) -> DataFrame:
    """The next snapshot of the store, and what happened to each row in `change` (new, updated, unchanged).

    A known offer takes all columns of the incoming row but keeps its status, first_seen_at, notes, starred and
    discarded, and the run that brought it (first_run), if there is such a column. Incoming rows with one id: the last by `ord` counts, if there is such a column. Both sides may hold very
    many rows; the merge is one join on the id.
    """
    columns = [c for c in existing.columns]
    data = [c for c in columns if c not in KEPT and c != "id"]
    if "ord" in incoming.columns:
        incoming = incoming.groupBy("id").agg(*[F.max_by(c, "ord").alias(c) for c in data])
    old = existing.select("id", *[F.col(c).alias(f"old_{c}") for c in columns if c != "id"], F.lit(True).alias("__old"))
    new = incoming.select("id", *data, F.lit(True).alias("__new"))
    both = old.join(new, "id", "full_outer")
    was, comes = F.col("__old").isNotNull(), F.col("__new").isNotNull()
    fresh = {"status": F.lit("new"), "first_seen_at": seen_at, "notes": F.lit(""), "starred": F.lit(False), "discarded": F.lit(False)}
    out = [F.col("id")]
    for c in columns[0:]:
        if c == "id":
            continue
        if c == FIRST_RUN:
            out.append(F.when(was, F.col(f"old_{c}")).otherwise(F.col(c)).alias(c))
        elif c in KEPT:
            keep = F.col(f"old_{c}") if c in ("status", "first_seen_at") else F.coalesce(F.col(f"old_{c}"), F.lit(KEPT[c]))
            out.append(F.when(was, keep).otherwise(fresh[c]).alias(c))
        else:
            out.append(F.when(comes, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c))
    return both.select(*out, F.when(was & comes, "updated").when(comes, "new").otherwise("unchanged").alias("change"))


def merge_offers(incoming: DataFrame, root: str, seen_at: Column, buckets: int = 64) -> DataFrame:
    """Merges offers into a store that is partitioned by a hash of the id: `upsert_offers` over the buckets that the
    incoming ids touch, which alone are read and written again. Returns id and change (new, updated) of the incoming ids, and
    their first_run, if they have one.

    The store's columns are the first merge's. Merging the same rows again changes nothing but `change`. The merged
    buckets are written beside the store first, so the only step that touches it is a copy of a finished table.
    """
    spark = incoming.sparkSession
    incoming = written(incoming.withColumn(BUCKET, bucket_of("id", buckets)), "incoming")
    touched = [r[0] for r in incoming.select(BUCKET).distinct().collect()]  # as many as buckets at most
    if exists(spark, root):
        existing = spark.read.parquet(root).where(F.col(BUCKET).isin(touched))
    else:
        kinds = {"status": "string", "first_seen_at": "timestamp", "notes": "string", "starred": "boolean", "discarded": "boolean"}
        existing = incoming.where("false").withColumns({c: F.lit(None).cast(kind) for c, kind in kinds.items()}).drop("ord")
    merged = written(upsert_offers(existing, incoming, seen_at), "merged")
    if touched:
        put_partitions(merged.drop("change"), root, BUCKET)
    return merged.where("change <> 'unchanged'").select("id", "change", *[c for c in merged.columns if c == FIRST_RUN])


def fold_events(events: DataFrame) -> DataFrame:
    """Annotations of each offer from its events (offer_id, kind, value, ts, event_id): the last status, note and
    discard, stars by the parity of toggles, and when it was first sent."""
    at = F.struct("ts", "event_id")
    last = lambda kind: F.max_by(F.when(F.col("kind") == kind, F.col("value")), F.when(F.col("kind") == kind, at))
    return events.groupBy("offer_id").agg(
        F.coalesce(last("status"), F.lit("new")).alias("status"),
        F.coalesce(last("note"), F.lit("")).alias("notes"),
        (F.count_if(F.col("kind") == "star") % 2 == 1).alias("starred"),
        F.coalesce(last("discard") == "1", F.lit(False)).alias("discarded"),
        F.min(F.when((F.col("kind") == "status") & (F.col("value") == "sent"), F.col("ts"))).alias("sent_at"),
    )


def save_applications(applications: DataFrame, offers: DataFrame) -> DataFrame:
    """Offers with the status of their last application (offer_id, status, created_at, ord), if they were new."""
    last = applications.groupBy("offer_id").agg(F.max_by("status", "ord").alias("__status"))
    joined = offers.join(last, offers["id"] == last["offer_id"], "left")
    return joined.withColumn("status", F.when((F.col("status") == "new") & F.col("__status").isNotNull(), F.col("__status")).otherwise(F.col("status"))).drop("__status", "offer_id")


def get_application(applications: DataFrame, wanted: Column) -> DataFrame:
    """The applications of the wanted offers, texts empty and lists empty where null."""
    texts = {c: F.coalesce(c, F.lit("")) for c in ("subject", "notes") if c in applications.columns}
    lists = {c: F.coalesce(c, F.array().cast("array<string>")) for c in ("highlights", "gaps") if c in applications.columns}
    return applications.where(wanted).withColumns(texts | lists)


def list_offers(offers: DataFrame, min_score: float = 0, status: str | None = None, source: str | None = None, new_only: bool = False, starred_only: bool = False, include_discarded: bool = False, limit: int | None = 50) -> DataFrame:
    """Offers by falling score, then latest publication, then id."""
    out = offers.where(F.col("score") >= min_score)
    if not include_discarded:
        out = out.where(~F.coalesce("discarded", F.lit(False)))
    if starred_only:
        out = out.where(F.coalesce("starred", F.lit(False)))
    for value in filter(None, (status, "new" if new_only else None)):
        out = out.where(F.col("status") == value)
    if source:
        out = out.where(F.col("source") == source)
    out = out.orderBy(F.desc("score"), F.desc_nulls_last("published_at"), "id")
    return out.limit(limit) if limit else out


def get_offer(offers: DataFrame, wanted: str) -> DataFrame:
    """The offer with this id, else the first one whose id starts so."""
    return offers.where(F.col("id").startswith(wanted)).orderBy(F.desc(F.col("id") == wanted), "id").limit(1)


def application_pipeline(offers: DataFrame, applications: DataFrame) -> DataFrame:
    """Offers with an application and its fields, with their rank in the funnel, in its order, then by falling score; one join."""
    stage = F.coalesce(F.array_position(F.array(*map(F.lit, FUNNEL)), F.col("status")), F.lit(0))
    rank = F.when(stage > 0, stage - 1).otherwise(F.lit(len(FUNNEL)))
    order = [F.asc("funnel"), *([F.desc("score")] if "score" in offers.columns else []), F.asc("id")]
    return offers.join(applications.withColumnRenamed("offer_id", "id"), "id").withColumn("funnel", rank.cast("int")).orderBy(*order)


def counts_by(offers: DataFrame, column: str) -> DataFrame:
    """Offers that aren't discarded by a column's values, the most frequent first."""
    return offers.where(~F.coalesce("discarded", F.lit(False))).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def report_stats(offers: DataFrame, listed: Column) -> DataFrame:
    """Total, new, drafted and sent offers that aren't discarded, and the mean score of the listed ones (0 if none)."""
    shown = offers.where(~F.coalesce("discarded", F.lit(False)))
    mean = F.coalesce(F.round(F.avg(F.when(listed, F.col("score")))).cast("long"), F.lit(0)).alias("avg_score")
    return shown.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("new", "drafted", "sent")], mean)


def last_run_at(runs: DataFrame) -> DataFrame:
    return runs.agg(F.max_by("started_at", "id").alias("last_run_at"))


def with_defaults(offers: DataFrame, defaults: dict[str, tuple[str, object]]) -> DataFrame:
    """Columns (name -> type, default) that older snapshots lack, or hold as null, with their default."""
    return offers.withColumns({c: F.coalesce(F.col(c) if c in offers.columns else F.lit(None).cast(kind), F.lit(value).cast(kind)) for c, (kind, value) in defaults.items()})
