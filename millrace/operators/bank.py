"""The item bank and the documents behind it: verdicts and overrides in their order, registrations, relabelling, units with resolved evidence, patches, imports, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.text import trim
from millrace.operators.roles import KIND_ROLES, ROLES

DECISIONS = ("published", "failed", "needs_review")
LEGACY, CHANGED = "legacy_pre_redesign", "evidence_missing_or_changed"
#: Suspects flagged at once.
MOST_FLAGGED = 50
_STATE = "struct<status:string,score:double,reasons:array<string>,reviews:int,published_at:bigint>"


def _step(origin: Column):
    none = F.array().cast("array<string>")

    def step(s: Column, e: Column) -> Column:
        def made(status=s.status, score=s.score, reasons=s.reasons, reviews=s.reviews, at=s.published_at) -> Column:
            return F.struct(F.lit(status).alias("status") if isinstance(status, str) else status.alias("status"), score.cast("double").alias("score"), reasons.alias("reasons"), reviews.cast("int").alias("reviews"), at.cast("long").alias("published_at")).cast(_STATE)

        never = F.lit(None).cast("long")
        shown = F.when(e.decision == "published", e["at"])
        return (
            F.when((e.action == "verdict") & e.decision.isin(*DECISIONS), made(e.decision, F.when(~F.isnan(e.score), e.score), F.coalesce(e.reasons, none), s.reviews + 1, shown))
            .when((e.action == "demote") & (s.status == "published") & (origin == "generation"), made("needs_review", reasons=F.array(F.lit(LEGACY)), at=never))
            .when(e.action == "quarantine", made("needs_review", reasons=F.array(F.coalesce(F.get(e.reasons, F.lit(0)), F.lit(CHANGED))), at=never))
            .when((e.action == "override") & e.decision.isin("published", "failed"), made(e.decision, at=shown))
            .when(e.action == "requeue", made("draft", F.lit(None), none, at=never))
            .otherwise(s)
        )

    return step


def item_states(items: DataFrame, events: DataFrame) -> DataFrame:
    """(item, status, score, reasons, reviews, published_at) after an item's events (item, place, at, action, decision, score, reasons) in the order of place; an item's events are a bounded list.

    A verdict sets everything; a demotion takes published items of generation back; a quarantine takes an item out; an override sets the status alone; a requeue makes it a draft again.
    """
    fields = F.struct("place", F.col("at").cast("long").alias("at"), "action", "decision", F.col("score").cast("double").alias("score"), "reasons")
    listed = events.groupBy("item").agg(F.array_sort(F.collect_list(fields)).alias("events"))
    start = F.from_json(F.lit('{"status":"draft","reasons":[],"reviews":0}'), _STATE)
    rows = items.join(listed, "item", "left").withColumn("events", F.coalesce("events", F.array().cast("array<struct<place:bigint,at:bigint,action:string,decision:string,score:double,reasons:array<string>>>")))
    return rows.select("item", F.aggregate("events", start, _step(F.col("origin"))).alias("s")).select("item", "s.*")


def audit_rows(events: DataFrame) -> DataFrame:
    """(item, place, stage, decision, score, reasons) of the events that are put on record."""
    sound = ((F.col("action") == "verdict") & F.col("decision").isin(*DECISIONS)) | ((F.col("action") == "override") & F.col("decision").isin("published", "failed")) | (F.col("action") == "quarantine")
    score = F.when(F.col("action") == "verdict", F.coalesce(F.when(~F.isnan("score"), F.col("score")), F.lit(0.0))).when((F.col("action") == "override") & (F.col("decision") == "published"), 1.0).otherwise(0.0)
    stage = F.when(F.col("action") == "verdict", "eval").when(F.col("action") == "override", "hitl").otherwise("revalidation")
    none = F.array().cast("array<string>")
    reasons = F.when(F.col("action") == "quarantine", F.array(F.coalesce(F.get("reasons", F.lit(0)), F.lit(CHANGED)))).when(F.col("action") == "verdict", F.coalesce("reasons", none)).otherwise(none)
    return events.where(sound).select("item", "place", stage.alias("stage"), F.when(F.col("action") == "quarantine", "quarantined").otherwise(F.col("decision")).alias("decision"), score.alias("score"), reasons.alias("reasons"))


def verdict_metrics(events: DataFrame) -> DataFrame:
    """(decision, reason, n) of verdicts by their first reason."""
    rows = audit_rows(events).where("stage = 'eval'")
    return rows.groupBy("decision", F.coalesce(F.get("reasons", F.lit(0)), F.lit("")).alias("reason")).agg(F.count("*").alias("n"))


def registrations(requests: DataFrame) -> DataFrame:
    """(request, document, created) of requests (request, artifact, exam) in order: the first of an artifact makes its document, later ones return it; one without an exam is refused, one without an artifact always makes a document."""
    sound = requests.where(trim(F.coalesce("exam", F.lit(""))) != "")
    first = F.min("request").over(W.partitionBy("artifact"))
    document = F.when(F.col("artifact").isNull(), F.col("request")).otherwise(first)
    return sound.select("request", document.alias("document"), (document == F.col("request")).alias("created"))


def relabelled(documents: DataFrame, changes: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Documents (doc, role, confidence, method, kind, status, attempts, twin_of) after changes (doc, new_role, new_kind, reprocess) by hand, with the fault of refused ones: a role or kind that does not exist, or nothing to change.

    A role set by hand is certain; reprocessing (unless declined) clears state, attempts and the link to a twin.
    """
    rows = documents.join(changes.withColumn("asked", F.lit(True)), "doc", "left")
    role, kind = F.col("new_role"), F.col("new_kind")
    asked = F.coalesce("asked", F.lit(False))
    nothing = role.isNull() & kind.isNull() & ~F.coalesce("reprocess", F.lit(False))
    fault = F.when(~asked, None).when(role.isNotNull() & ~role.isin(*ROLES, "mixed", "unknown"), "invalid role").when(kind.isNotNull() & ~kind.isin(*kinds), "invalid kind").when(nothing, "nothing to change")
    rows = rows.withColumn("fault", fault)
    done = asked & F.col("fault").isNull()
    again = done & F.coalesce("reprocess", F.lit(True))
    by_hand = done & role.isNotNull()
    return rows.select(
        "doc", F.when(by_hand, role).otherwise(F.col("role")).alias("role"), F.when(by_hand, 1.0).otherwise(F.col("confidence")).alias("confidence"), F.when(by_hand, "admin_override").otherwise(F.col("method")).alias("method"),
        F.when(done & kind.isNotNull(), kind).otherwise(F.col("kind")).alias("kind"), F.when(again, "pending").otherwise(F.col("status")).alias("status"), F.when(again, 0).otherwise(F.col("attempts")).alias("attempts"),
        F.when(~again, F.col("twin_of")).alias("twin_of"), "fault",
    )


def resolved_units(units: DataFrame, chunks: DataFrame) -> DataFrame:
    """Units (unit, doc, leaf, statement, evidence of struct(chunk, ordinal)) that say something of a leaf, each piece of evidence with its chunk: the one named, else the one of that ordinal in the document (doc, ordinal, chunk, section)."""
    sound = units.where((trim(F.coalesce("statement", F.lit(""))) != "") & (trim(F.coalesce("leaf", F.lit(""))) != ""))
    pieces = sound.select("unit", "doc", F.posexplode_outer("evidence").alias("place", "e"))
    known = chunks.groupBy("doc", "ordinal").agg(F.min(F.struct("chunk", "section")).alias("known"))
    found = pieces.join(known, (pieces["doc"] == known["doc"]) & (F.col("e.ordinal") == known["ordinal"]) & F.col("e.chunk").isNull(), "left").drop(known["doc"])
    one = F.struct("place", F.coalesce("e.chunk", "known.chunk").alias("chunk"), F.col("known.section").alias("section"))
    listed = found.groupBy("unit").agg(F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), one))).alias("evidence"))
    return sound.drop("evidence").join(listed, "unit")


def flagged(units: DataFrame, wanted: DataFrame) -> DataFrame:
    """Units (unit, status) after a request (place, unit) to flag some: the first fifty named, if active, are suspect."""
    first = wanted.where("unit IS NOT NULL").orderBy("place").limit(MOST_FLAGGED).select("unit", F.lit(True).alias("named")).distinct()
    rows = units.join(first, "unit", "left")
    return rows.select("unit", F.when((F.col("status") == "active") & F.col("named"), "ku_suspect").otherwise(F.col("status")).alias("status"))


def patched(rows: DataFrame, patches: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows with those fields of their patch that are given; a null or empty one leaves the field as it is."""
    given = patches.select(key, *[F.col(f).alias(f"new_{f}") for f in fields])
    told = lambda f: F.coalesce(F.nullif(F.col(f"new_{f}"), F.lit("")) if dict(patches.dtypes)[f] == "string" else F.col(f"new_{f}"), f).alias(f)
    return rows.join(given, key, "left").select(key, *map(told, fields))


def imported(artifacts: DataFrame, known: DataFrame) -> DataFrame:
    """(artifact, role, imported, completed) of claimed artifacts (artifact, exam, role_hint, kind_hint): the role is the hint's, else that of the kind's hint; those without an exam are completed without a document, and an artifact has one document."""
    hinted = lambda c: F.nullif(F.coalesce(c, F.lit("unknown")), F.lit("unknown"))
    kinds = F.create_map(*[F.lit(x) for pair in KIND_ROLES.items() for x in pair])
    role = F.coalesce(hinted(F.col("role_hint")), F.element_at(kinds, hinted(F.col("kind_hint"))), F.lit("unknown"))
    rows = artifacts.dropDuplicates(["artifact"]).join(known.select("artifact", F.lit(True).alias("held")).distinct(), "artifact", "left")
    has_exam = trim(F.coalesce("exam", F.lit(""))) != ""
    return rows.select("artifact", F.when(has_exam, role).alias("role"), (has_exam & F.col("held").isNull()).alias("imported"), F.lit(True).alias("completed"))


def shown_results(attempts: DataFrame, answers: DataFrame) -> DataFrame:
    """(attempt, question, status, score, grade): scores and grades are hidden until the attempt is corrected."""
    done = F.col("status") == "CORRECTED"
    rows = attempts.join(answers, "attempt")
    return rows.select("attempt", "question", "status", F.when(done, F.col("score")).alias("score"), F.when(done, F.col("grade")).alias("grade"))


def released(attempts: DataFrame, asked: DataFrame) -> DataFrame:
    """(attempt, status, fault) after a request to put attempts back: those in correction wait again, others stay as they are."""
    rows = attempts.join(asked.select("attempt", F.lit(True).alias("asked")).distinct(), "attempt", "left")
    own, open_ = F.coalesce("asked", F.lit(False)), F.col("status") == "IN_CORRECTION"
    return rows.select("attempt", F.when(own & open_, "PENDING").otherwise(F.col("status")).alias("status"), F.when(own & ~open_, "not_in_correction").alias("fault"))
