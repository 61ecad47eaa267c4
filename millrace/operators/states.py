"""Keyed state over time: lifecycles, change detection, queues, health, budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Phases of a catalog entry and the edges between them.
EDGES = {
    "announced": ("registration_open", "cancelled"),
    "registration_open": ("registration_closed", "cancelled"),
    "registration_closed": ("exam_scheduled", "exam_done", "cancelled"),
    "exam_scheduled": ("exam_done", "cancelled"),
    "exam_done": ("past_due",),
    "past_due": ("archived",),
    "cancelled": ("archived",),
    "archived": (),
}


def may_move(start: Column, to: Column) -> Column:
    """Whether an edge leads from start to ``to``; staying is always allowed, unknown phases never."""
    legal = F.lit(False)
    for a, ends in EDGES.items():
        legal = legal | ((start == a) & to.isin(a, *ends))
    return legal


def next_phase(phase: Column, status: Column, registration_end: Column, exam_date: Column, purge_at: Column, as_of: Column) -> Column:
    """struct(phase, reason) of the next phase; an illegal edge gives null."""
    to = lambda name, reason: F.struct(F.lit(name).alias("phase"), F.lit(reason).alias("reason"))
    stay = F.struct(phase.alias("phase"), F.lit("idempotent_noop").alias("reason"))
    proposed = (
        F.when(phase.isin("archived", "cancelled"), stay)
        .when((status == "open") & (phase == "announced"), to("registration_open", "registration_signal"))
        .when((registration_end < as_of) & phase.isin("registration_open", "announced"), to("registration_closed", "registration_end_passed"))
        .when((status == "closed") & (phase == "registration_open"), to("registration_closed", "registration_signal"))
        .when((exam_date < as_of) & phase.isin("exam_scheduled", "registration_closed"), to("exam_done", "exam_date_passed"))
        .when((exam_date < as_of) & (phase == "exam_done"), to("past_due", "exam_date_passed"))
        .when((phase == "past_due") & (purge_at <= as_of), to("archived", "archive_grace_elapsed"))
        .otherwise(stay)
    )
    return F.when(may_move(phase, proposed.phase), proposed)


def purge_action(phase: Column, archived_at: Column, purge_at: Column, exam_date: Column, as_of: Column, soft_days: int = 30, hard_days: int = 90) -> Column:
    """struct(action, reason) of the purge rules."""
    act = lambda a, r: F.struct(F.lit(a).alias("action"), F.lit(r).alias("reason"))
    days = lambda n: F.expr(f"INTERVAL {n} DAY")
    due = F.coalesce(purge_at, exam_date + days(soft_days))
    return (
        F.when((phase == "archived") & archived_at.isNull(), act("none", "archived_missing_date"))
        .when((phase == "archived") & (as_of < archived_at + days(hard_days)), act("none", "hard_delete_grace_pending"))
        .when(phase == "archived", act("hard_delete", "hard_delete_grace_elapsed"))
        .when((phase == "past_due") & (due.isNull() | (as_of < due)), act("none", "soft_archive_grace_pending"))
        .when(phase == "past_due", act("soft_archive", "soft_archive_grace_elapsed"))
        .when((exam_date < as_of) & phase.isin("exam_done", "exam_scheduled", "registration_closed"), act("mark_past_due", "exam_date_passed"))
        .otherwise(act("none", "no_action"))
    )


def changes(df: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """Marks rows whose value differs from the key's last one and is not blank: ``changed``, ``changes`` so far."""
    w = W.partitionBy(key).orderBy(*order)
    before = F.lag(value).over(w)
    changed = before.isNotNull() & (before != F.col(value)) & (F.col(value) != "")
    return df.withColumn("changed", changed).withColumn("changes", F.sum(F.col("changed").cast("int")).over(w))


def failure_runs(df: DataFrame, key: str, order: Sequence[str], failed: Column) -> DataFrame:
    """``failures``: how many failures in a row up to each row; a success resets it."""
    w = W.partitionBy(key).orderBy(*order)
    run = F.sum(F.when(failed, 0).otherwise(1)).over(w)
    marked = df.withColumns({"__failed": failed.cast("int"), "__run": run})
    return marked.withColumn("failures", F.sum("__failed").over(W.partitionBy(key, "__run").orderBy(*order))).drop("__failed", "__run")


def alerts(df: DataFrame, key: str, order: Sequence[str], failed: Column, threshold: int) -> DataFrame:
    """Rows that alert: the state changed (it starts healthy), or a multiple of the threshold above it was reached."""
    counted = failure_runs(df, key, order, failed).withColumn("__ok", ~failed)
    before = F.coalesce(F.lag("__ok").over(W.partitionBy(key).orderBy(*order)), F.lit(True))
    counted = counted.withColumn("__before", before)
    reminder = ~F.col("__ok") & (F.col("failures") > threshold) & (F.col("failures") % threshold == 0)
    kind = F.when(F.col("__ok") & ~F.col("__before"), "recovered").when(~F.col("__ok") & F.col("__before"), "failing").when(reminder, "still unhealthy")
    return counted.withColumn("alert", kind).where("alert IS NOT NULL").drop("__ok", "__before")


def claimable(jobs: DataFrame, as_of: Column, limit: int, kinds: Sequence[str] | None = None) -> DataFrame:
    """The jobs to claim next: due, or leased and past the lease; by priority, then by age."""
    due = (F.col("status") == "queued") & (F.col("available_at") <= as_of)
    stale = (F.col("status") == "running") & (F.col("lease_until") < as_of)
    chosen = jobs.where(due | stale)
    if kinds:
        chosen = chosen.where(F.col("kind").isin(*kinds))
    return chosen.orderBy(F.desc("priority"), "available_at", "job_id").limit(limit)


def backoff_seconds(attempt: Column, first: int = 30, most: int = 3600) -> Column:
    return F.least(F.lit(float(most)), first * F.pow(F.lit(2.0), attempt - 1))


def failed_job(attempts: Column, most: Column, at: Column, jitter: Column, first: int = 30, longest: int = 3600) -> Column:
    """struct(status, available_at, finished_at) of a job after a failed attempt: dead after its last one, else queued again within a time that doubles with each, at the share of it that ``jitter`` (0 to 1) draws."""
    cap = F.least(F.lit(float(longest)), first * F.pow(F.lit(2.0), F.greatest(attempts - 1, F.lit(0))))
    wait = F.floor(jitter * cap * 1000) / 1000
    dead = attempts >= most
    ready = at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), wait.cast("decimal(18,6)"))
    return F.struct(F.when(dead, "dead").otherwise("queued").alias("status"), F.when(~dead, ready).alias("available_at"), F.when(dead, at).alias("finished_at"))


def dead_jobs(jobs: DataFrame, limit: int = 50) -> DataFrame:
    """(kind, place, job, finished_at) of the dead jobs of each kind that ended last."""
    order = W.partitionBy("kind").orderBy(F.desc("finished_at"), F.desc("job"))
    return jobs.where("status = 'dead'").withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < min(limit, 200)).select("kind", "place", "job", "finished_at")


def deferral_seconds(failures: Column) -> Column:
    """How long an item is put off after so many failures in a row: a minute doubled with each (six at most), half an hour at most."""
    return F.least(F.lit(1800.0), 60 * F.pow(F.lit(2.0), F.least(F.lit(6), failures)))


def admitted(requests: Column, cap: int) -> Column:
    """For a list of struct(n) in order: which requests fit under the cap; a rejected one uses nothing up."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("ok"))

    def step(acc: Column, r: Column) -> Column:
        fits = acc.used + r.n <= cap
        return F.struct(F.when(fits, acc.used + r.n).otherwise(acc.used).alias("used"), F.array_append(acc.ok, fits).alias("ok"))

    return F.aggregate(requests, start, step, lambda acc: acc.ok)
