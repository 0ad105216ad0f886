"""Dataset versions: building -> ready -> active -> archived, as functions from tables to tables.

versions(id, version_name, status, started_at, completed_at, activated_at) is small and broadcast where
Spark finds it so; chunks(chunk_id, version_id, is_active, ...) are rewritten in one pass without a shuffle of their text.
`publish` makes the new state visible by one commit, written last.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.snapshots import Snapshots

STATUSES = ("building", "ready", "active", "failed", "archived")


def check_statuses(versions: DataFrame) -> DataFrame:
    """versions; reading a row of another status raises an error."""
    ok = F.col("status").isin(*STATUSES)
    return versions.withColumn("status", F.when(ok, F.col("status")).otherwise(F.raise_error(F.concat(F.lit("unknown status "), F.coalesce("status", F.lit("null"))))))


def _plan(versions: DataFrame, target: Column, leaves: Column) -> DataFrame:
    plan = F.when(target & (F.col("status") == "active"), "already").when(target & (F.col("status") == "ready"), "activate").when(~target & leaves & (F.col("status") == "active"), "demote").otherwise("keep")
    return versions.withColumn("plan", F.coalesce(plan, F.lit("keep")))


def plan_one(versions: DataFrame, name: str, exclusive: bool = True, prefix: str | None = None) -> DataFrame:
    """versions with `plan` for making one active: all others leave (exclusive), or those of its prefix (L1, L2)."""
    others = F.lit(True) if exclusive else F.col("version_name").startswith(prefix or name)
    return _plan(versions, F.col("version_name") == name, others)


def plan_set(versions: DataFrame, prefixes: list[str]) -> DataFrame:
    """versions with `plan` for having just the newest usable version of each prefix active (L3).

    Of versions with several fitting prefixes the longest counts; ties in start fall to the larger id.
    """
    own = F.lit(None).cast("string")
    for p in sorted(prefixes, key=len):
        own = F.when(F.col("version_name").startswith(p), p).otherwise(own)
    rows = versions.withColumn("_prefix", own)
    usable = rows.where("_prefix is not null and status in ('ready', 'active')")
    newest = usable.groupBy("_prefix").agg(F.max_by("id", F.struct(F.coalesce("started_at", F.lit("1900-01-01").cast("timestamp")), "id")).alias("id"))
    chosen = newest.select("id", F.lit(True).alias("_chosen"))
    return _plan(rows.join(chosen, "id", "left"), F.coalesce("_chosen", F.lit(False)), F.lit(True)).drop("_prefix", "_chosen")


def apply_plan(planned: DataFrame, chunks: DataFrame, now: Column | None = None, only_embedded: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(versions, chunks, counts) after a plan: (plan, n_versions, n_chunks) counts what changes (L1, L4)."""
    now = F.current_timestamp() if now is None else now
    status = F.when(F.col("plan") == "activate", "active").when(F.col("plan") == "demote", "archived").otherwise(F.col("status"))
    versions = planned.withColumn("status", status).withColumn("activated_at", F.when(F.col("plan") == "activate", now).otherwise(F.col("activated_at"))).drop("plan")
    rows = chunks.join(planned.select(F.col("id").alias("version_id"), "plan"), "version_id", "left")
    fit = F.col("embedding").isNotNull() if only_embedded else F.lit(True)
    active = F.when(F.col("plan").isin("activate", "already"), fit).when(F.col("plan") == "demote", False).otherwise(F.col("is_active"))
    changed = rows.where(F.coalesce(F.col("is_active"), F.lit(False)) != F.coalesce(active, F.lit(False))).groupBy("plan").agg(F.count("*").alias("n_chunks"))
    counts = planned.groupBy("plan").agg(F.count("*").alias("n_versions")).join(changed, "plan", "left").na.fill(0, ["n_chunks"])
    return versions, rows.withColumn("is_active", active).drop("plan"), counts


def retire(versions: DataFrame, prefixes: list[str]) -> DataFrame:
    """versions with `plan` that demotes the active ones of the prefixes."""
    fits = F.lit(False)
    for p in prefixes:
        fits = fits | F.col("version_name").startswith(p)
    return _plan(versions, F.lit(False), fits)


def visible(chunks: DataFrame, versions: DataFrame) -> DataFrame:
    """Active chunks of active versions: what searches see (S1). A null version is never visible."""
    active = versions.where("status = 'active'").select(F.col("id").alias("version_id"), "version_name")
    return chunks.where("is_active").join(active, "version_id")


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Both tables' rows, the latest by `order` of each key; new wins ties (S17). Columns of only one side are null in the other."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    columns = [c for c in both.columns if c != "_side"]
    best = both.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(F.col(order), F.col("_side"))).alias("row"))
    return best.select("row.*")


def insert_new(stored: DataFrame, arriving: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to append, counts): arriving rows whose keys aren't stored, one of each."""
    one = arriving.groupBy(*keys).agg(F.min(F.struct(*[c for c in arriving.columns if c not in keys])).alias("rest")).select(*keys, "rest.*")
    fresh = one.join(stored.select(*keys).distinct(), keys, "left_anti")
    counts = one.agg(F.count("*").alias("n_arriving")).crossJoin(fresh.agg(F.count("*").alias("n_new")))  # one row each
    return fresh.select(*arriving.columns), counts.withColumn("n_reused", F.col("n_arriving") - F.col("n_new"))


def job_rows(jobs: DataFrame, name: str, status: str, added: int = 0, updated: int = 0, now: Column | None = None) -> DataFrame:
    """jobs with one more row: the log is only appended to."""
    if status not in ("queued", "running", "success", "failed"):
        raise ValueError(f"unknown status {status}")
    row = jobs.sparkSession.range(1).select(F.lit(name).alias("job"), F.lit(status).alias("status"), F.lit(added).cast("long").alias("records_added"), F.lit(updated).cast("long").alias("records_updated"), (F.current_timestamp() if now is None else now).alias("at"))
    return jobs.unionByName(row)


#: Which status may follow which; a job begins queued or running.
FOLLOWS = {"queued": ("running", "failed"), "running": ("success", "failed"), "success": (), "failed": ("queued", "running")}


def job_log(log: DataFrame) -> DataFrame:
    """log(job, status, at, seq) with before, the job's status before, and legal: whether the one may follow the other (L6). seq settles equal times."""
    before = F.lag("status").over(Window.partitionBy("job").orderBy("at", "seq"))
    rows = log.withColumn("before", before)
    legal = F.when(F.col("before").isNull(), F.col("status").isin("queued", "running"))
    for status, after in FOLLOWS.items():
        legal = legal.when(F.col("before") == status, F.col("status").isin(*after) if after else F.lit(False))
    return rows.withColumn("legal", F.coalesce(legal, F.lit(False)))


def job_states(log: DataFrame, now: Column, patience: str = "1 day") -> DataFrame:
    """(job, n_rows, n_illegal, status, at, hung): each job's last status; it hangs if that is queued or running and older than `patience`."""
    rows = job_log(log).groupBy("job").agg(F.count("*").alias("n_rows"), F.count_if(~F.col("legal")).alias("n_illegal"), F.max(F.struct("at", "seq", "status")).alias("last"))
    open_ = F.col("last.status").isin("queued", "running")
    return rows.select("job", "n_rows", "n_illegal", F.col("last.status").alias("status"), F.col("last.at").alias("at"), (open_ & (F.col("last.at") < now - F.expr(f"INTERVAL {patience}"))).alias("hung"))


def first_seen(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """(keys, number): of each key the least number, by which later rows refer to it."""
    return rows.groupBy(*keys).agg(F.min(number).alias(number))


def ingest(stored: dict[str, DataFrame], arriving: list[tuple[str, DataFrame, list[str]]]) -> tuple[dict[str, DataFrame], DataFrame]:
    """What to append to each table, and (step, table_name, n_arriving, n_new, n_reused): tables from parent to child, each with its keys."""
    new, reports = {}, []
    for step, (name, rows, keys) in enumerate(arriving, 1):
        new[name], counts = insert_new(stored[name], rows, keys)
        reports.append(counts.select(F.lit(step).alias("step"), F.lit(name).alias("table_name"), "n_arriving", "n_new", "n_reused"))
    return new, reduce(DataFrame.unionByName, reports)


def cleared(rows: DataFrame, name: str, execute: bool = False) -> tuple[DataFrame, DataFrame]:
    """The rows that stay, none once executed, and (table_name, n_rows, n_cleared, n_left); without `execute` nothing is cleared."""
    left = rows.limit(0) if execute else rows
    gone = F.col("n_rows") if execute else F.lit(0).cast("long")
    report = rows.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows", gone.alias("n_cleared"), (F.col("n_rows") - gone).alias("n_left"))
    return left, report


def insert_plan(arriving: DataFrame, stored: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row of what an insert would do: rows that are new, that are there, that can't be inserted for want of a text."""
    empty = F.coalesce(F.trim(text), F.lit("")) == ""
    seen = arriving.join(stored.select(*keys, F.lit(True).alias("_there")).distinct(), keys, "left")
    return seen.agg(F.count_if(~empty & F.col("_there").isNull()).alias("n_insert"), F.count_if(~empty & F.col("_there").isNotNull()).alias("n_there"), F.count_if(empty).alias("n_empty"))


def embed_plan(chunks: DataFrame, vectors: DataFrame, batch: int) -> DataFrame:
    """(batch_no, first_id, last_id, n) of chunks without a vector, in order of chunk_id: a run resumes at the first of them.

    Places come from counts of ranges of `batch` ids, so no task sorts all ids.
    """
    missing = chunks.join(vectors.select("chunk_id").distinct(), "chunk_id", "left_anti")
    return missing.groupBy(F.floor(F.col("chunk_id") / batch).alias("batch_no")).agg(F.min("chunk_id").alias("first_id"), F.max("chunk_id").alias("last_id"), F.count("*").alias("n"))


def publish(tables: dict[str, DataFrame], folder: str, began_from: int | None = None) -> int:
    """Writes several tables and publishes them by one commit; Conflict if another was made since the one this writer began from.

    Without began_from, the state is the one found now.
    """
    if not tables:
        raise ValueError("no table to publish")
    spark = next(iter(tables.values())).sparkSession
    snapshots = Snapshots(spark, folder)
    began = snapshots.current()[0] if began_from is None else began_from
    places = {name: snapshots.place(name) for name in tables}
    for name, df in tables.items():
        df.write.parquet(places[name])
    return snapshots.commit(began, {"tables": places})


def current(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the last commit, all of one state; none before the first."""
    return {name: spark.read.parquet(path) for name, path in Snapshots(spark, folder).current()[1].get("tables", {}).items()}
