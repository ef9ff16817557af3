"""The subject and job registry: upserts as joins that make the next snapshot, lookups, states, lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert_twins(twins: DataFrame, requests: DataFrame) -> DataFrame:
    """Next snapshot of twins(twin_id, status, consent, updated_at): unknown ids enter as `ingesting`, known ones
    change only status and updated_at. requests(twin_id, consent, at) may repeat an id; the latest counts."""
    last = requests.groupBy("twin_id").agg(F.max(F.struct("at", "consent")).alias("r"))
    j = twins.join(last, "twin_id", "full_outer")
    known, asked = F.col("status").isNotNull(), F.col("r").isNotNull()
    return j.select(
        "twin_id",
        F.when(asked, F.lit("ingesting")).otherwise(F.col("status")).alias("status"),
        F.when(known, F.col("consent")).otherwise(F.col("r.consent")).alias("consent"),
        F.when(asked, F.col("r.at")).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def register_jobs(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """jobs(job_id, twin_id, status, size, sha256) and a pending row for each request."""
    return jobs.unionByName(requests.select("job_id", "twin_id", F.lit("pending").alias("status"), "size", "sha256"))


def audit_events(operations: DataFrame, actor: Column, action: Column, subject: Column, at: Column) -> DataFrame:
    """Append-only rows (day, at, actor, action, subject), one an operation; written partitioned by day."""
    return operations.select(F.to_date(at).alias("day"), at.alias("at"), actor.alias("actor"), action.alias("action"), subject.alias("subject"))


def upsert_status(jobs: DataFrame, changes: DataFrame, key: str = "job_id") -> DataFrame:
    """jobs(key, status, completed_at, ..) after changes(key, status, completed_at): known keys change these two, new ones enter.
    changes may repeat a key: the one completed last counts, then the greatest status; null keys are left out."""
    rest = [c for c in jobs.columns if c not in (key, "status", "completed_at")]
    last = changes.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct("completed_at", "status")).alias("r"))
    new = last.select(key, F.col("r.status").alias("__s"), F.col("r.completed_at").alias("__c"), F.lit(True).alias("__new"))
    j = jobs.join(new, key, "full_outer")
    pick = lambda a, b: F.when(F.col("__new"), F.col(a)).otherwise(F.col(b))
    return j.select(key, pick("__s", "status").alias("status"), pick("__c", "completed_at").alias("completed_at"), *rest)


def insert_if_absent(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """rows and those of new whose key is not among them, of repeated keys the least row; nothing else changes."""
    rest = [c for c in rows.columns if c != key]
    one = new.groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select(key, "r.*") if rest else new.select(key).distinct()
    return rows.unionByName(one.join(rows.select(key), key, "left_anti").select(*rows.columns))


def lookup(ids: DataFrame, rows: DataFrame, key: str, valid: Column | None = None) -> DataFrame:
    """ids with the row of that key and found: `ok`, `not_found` or, where `valid` is false, `bad_format`. Of repeated
    keys in rows the greatest row counts, so that ids never multiply."""
    rest = [c for c in rows.columns if c != key]
    one = rows.groupBy(key).agg(F.max(F.struct(*rest)).alias("r")).select(key, "r.*", F.lit(True).alias("__hit")) if rest else rows.select(key).distinct().withColumn("__hit", F.lit(True))
    j = ids.join(one, key, "left")
    ok = F.when(F.col("__hit"), "ok").otherwise("not_found")
    return j.withColumn("found", ok if valid is None else F.when(~valid, "bad_format").otherwise(ok)).drop("__hit")


STATES = ("created", "simulating", "completed", "failed")
# Which state may follow which.
FOLLOWS = [("created", "simulating"), ("simulating", "completed"), ("simulating", "failed"), ("completed", "simulating"), ("failed", "simulating")]


def twin_state(events: DataFrame, key: str, state: Column, order: list[str]) -> DataFrame:
    """Per key the last state, how many events it had and how many of its transitions were illegal."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = events.withColumn("__s", state).withColumn("__p", F.lag("__s").over(w))
    legal = F.concat_ws(">", "__p", "__s").isin([f"{a}>{b}" for a, b in FOLLOWS]) | F.col("__p").isNull() | (F.col("__p") == F.col("__s"))
    return rows.groupBy(key).agg(F.max_by("__s", F.struct(*order)).alias("state"), F.count("*").alias("n_events"), F.count_if(~legal).alias("n_illegal"))


def attribute_lineage(base: DataFrame, parts: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """One record a key: base left-joined with each part, whose columns take the part's name as prefix, and complete."""
    out = base
    for name, part in parts.items():
        out = out.join(part.select(*keys, F.lit(True).alias(f"has_{name}"), *[F.col(c).alias(f"{name}_{c}") for c in part.columns if c not in keys]), keys, "left")
    have = [F.coalesce(f"has_{n}", F.lit(False)) for n in parts]
    done = have[0]
    for h in have[1:]:
        done = done & h
    return out.withColumn("complete", done).drop(*[f"has_{n}" for n in parts])
