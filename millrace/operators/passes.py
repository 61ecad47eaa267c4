"""Passes over evidence, generation and attempts, and the calendar rules that archive what they leave: states that follow from rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import trim

# Least score of a mapping, new and sound questions that a profile needs, letters of a prompt that name it.
LEAST_MAP, LEAST_NEW, LEAST_SOUND, NAMING = 0.5, 5, 5, 120


def evidence_items(questions: DataFrame, maps: DataFrame) -> DataFrame:
    """Questions (exam, doc, number, prompt, status, ...) with their fingerprint and the leaf they are mapped to, if any scores 0.5. ``maps`` has exam, doc, number, leaf, canonical and score."""
    best = maps.groupBy("exam", "doc", "number").agg(F.max_by(F.struct("leaf", "canonical", "score"), F.struct("score", (-F.col("leaf")).alias("l"))).alias("best"))
    name = F.concat_ws("|", "exam", "doc", F.col("number").cast("string"), F.substring("prompt", 1, NAMING))
    rows = questions.join(best, ["exam", "doc", "number"], "left")
    mapped = F.when(F.col("best.score") >= LEAST_MAP, F.col("best"))
    return rows.withColumn("mapped", mapped).withColumn("fingerprint", F.substring(F.sha2(name, 256), 1, 32)).select(*questions.columns, "fingerprint", "mapped.leaf", "mapped.canonical", "mapped.score")


def evidence_pass(items: DataFrame, known: DataFrame) -> DataFrame:
    """(exam, doc, questions, created, sound, profiles, subject) of each document: how many questions are new, and whether they make a profile: five new and five sound ones."""
    firsts = items.join(known.select("fingerprint").distinct(), "fingerprint", "left_anti").groupBy("fingerprint").agg(F.min(F.struct("doc", "number")).alias("f")).select(F.col("f.doc").alias("doc"), F.lit(1).alias("new"))
    new = firsts.groupBy("doc").agg(F.count("*").alias("created"))
    first_key = F.min(F.when(F.col("canonical").isNotNull(), F.struct("number", "canonical")))
    told = items.groupBy("exam", "doc").agg(F.count("*").alias("questions"), F.count_if(F.col("status") == "ok").alias("sound"), first_key.alias("key"))
    rows = told.join(new, "doc", "left").withColumn("created", F.coalesce("created", F.lit(0)))
    makes = (F.col("created") >= LEAST_NEW) & (F.col("sound") >= LEAST_SOUND)
    return rows.select("exam", "doc", "questions", "created", "sound", makes.cast("int").alias("profiles"), F.when(makes, F.coalesce(F.substring_index("key.canonical", ":", 1), F.lit("geral"))).alias("subject"))


def generation_runs(queue: DataFrame, each: int) -> DataFrame:
    """(place, leaf, requested, tier, drafted, suspects, status) of the runs of a pass.

    ``queue`` has place, leaf, subject, deficit, units, first and second (usable questions of the first reply and of the retry on the next tier), created, failed
    (null, "error", or "deferred" when the budget is used up). A leaf without deficit or subject gets no run; a run without units is partial; a reply without
    a usable question is retried once, and if that has none either, the units are suspect. A deferred run ends the pass.
    """
    subject = F.lower(trim(F.coalesce("subject", F.lit(""))))
    runs = queue.withColumn("requested", F.least(F.lit(each), "deficit")).where((F.col("requested") > 0) & F.col("leaf").isNotNull() & ~subject.isin("", "geral"))
    ends = runs.where("failed = 'deferred' AND units > 0").agg(F.min("place").alias("ends"))  # one row
    runs = runs.crossJoin(F.broadcast(ends)).where(F.col("ends").isNull() | (F.col("place") <= F.col("ends")))
    asked, failed = F.col("units") > 0, F.col("failed").isNotNull()
    got = F.when(F.col("first") > 0, "mid").when(F.col("second") > 0, "strong")
    tier = F.when(asked & ~failed, got)
    none = asked & ~failed & got.isNull()
    drafted = F.when(tier.isNotNull(), F.col("created")).otherwise(0)
    status = F.when(asked & failed, "failed").when(drafted > 0, "ok").otherwise("partial")
    return runs.select("place", "leaf", "requested", tier.alias("tier"), drafted.alias("drafted"), F.when(none, F.col("units")).otherwise(0).alias("suspects"), status.alias("status"))


# --- attempts ----------------------------------------------------------------------------------------


def submission_faults(attempts: DataFrame, questions: DataFrame, answers: DataFrame) -> DataFrame:
    """(attempt, fault): the first thing wrong with a submission, or null.

    ``attempts`` has attempt and status; ``questions`` attempt, question, kind and options (how many); ``answers`` attempt, place, question, selected and text.
    """
    asked = questions.groupBy("attempt").agg(F.count_distinct("question").alias("asked"))
    given = answers.groupBy("attempt").agg(F.count("*").alias("given"))
    known = questions.select("attempt", "question", "kind", F.greatest(F.coalesce("options", F.lit(4)), F.lit(1)).alias("most"))
    judged = answers.join(known, ["attempt", "question"], "left")
    index = F.col("selected").isNull() | (F.col("selected") < 0) | (F.col("selected") >= F.col("most"))
    fault = (
        F.when(F.col("kind").isNull(), "invalid_question")
        .when((F.col("kind") == "MULTIPLE_CHOICE") & index, "invalid_index")
        .when((F.col("kind") != "MULTIPLE_CHOICE") & (trim(F.coalesce("text", F.lit(""))) == ""), "missing_text")
    )
    wrong = judged.withColumn("fault", fault).groupBy("attempt").agg(F.min(F.when(F.col("fault").isNotNull(), F.struct("place", "fault"))).alias("wrong"))
    rows = attempts.join(asked, "attempt", "left").join(given, "attempt", "left").join(wrong, "attempt", "left")
    zero = F.lit(0)
    early = F.when(F.col("status") != "IN_PROGRESS", "already_submitted").when(F.coalesce("given", zero) != F.coalesce("asked", zero), "unanswered_questions")
    return rows.select("attempt", F.coalesce(early, F.col("wrong.fault")).alias("fault"))


def corrected_attempts(attempts: DataFrame, answers: DataFrame, corrections: DataFrame) -> DataFrame:
    """(attempt, status, score, fault) of attempts that are being corrected: multiple choice is graded by its key, open answers by the corrector (all or nothing); without a correction for each answer nothing changes.

    ``answers`` has attempt, question, kind, correct and selected; ``corrections`` attempt, question and grade.
    """
    proposed = F.coalesce(F.col("grade") >= 1, F.lit(False))
    rows = answers.join(corrections.withColumn("given", F.lit(True)), ["attempt", "question"], "left")
    grade = F.when(F.col("kind") == "MULTIPLE_CHOICE", F.col("selected").eqNullSafe(F.col("correct"))).otherwise(proposed).cast("int")
    told = rows.groupBy("attempt").agg(F.sum(grade).alias("total"), F.bool_and(F.col("given").isNotNull()).alias("whole"))
    rows = attempts.join(told, "attempt", "left")
    fault = F.when(F.col("status") != "IN_CORRECTION", "not_in_correction").when(~F.coalesce("whole", F.lit(True)), "missing_correction")
    done = fault.isNull()
    return rows.select("attempt", F.when(done, "CORRECTED").otherwise(F.col("status")).alias("status"), F.when(done, F.coalesce("total", F.lit(0))).cast("long").alias("score"), fault.alias("fault"))


def question_update_fault(kind: Column, options: Column, sets_index: Column, index: Column) -> Column:
    """Why an update of a multiple-choice question is refused: not four options, or an index that is none of theirs. Fields that are not set (null options) stay."""
    own = kind == "MULTIPLE_CHOICE"
    return F.when(own & options.isNotNull() & (F.size(options) != 4), "four_options").when(own & sets_index & (index.isNull() | ~index.between(0, 3)), "index_range")


def prepared_topics(requests: DataFrame, topics: DataFrame, marker: str) -> DataFrame:
    """(user, exam, topic, created): the newest topic of the user whose guidelines hold the exam's marker, else a new one (null)."""
    held = topics.where("preset = 'open_exam'").withColumn("slug", F.regexp_extract_all("guidelines", F.lit(rf"{marker} (\S+)"), F.lit(1)))
    # a marker is contained if a marked slug begins with the exam's
    joined = requests.join(held.select(F.col("user"), "topic", "updated", F.explode("slug").alias("slug")), "user", "left").where(F.col("slug").isNull() | F.col("slug").startswith(F.col("exam")))
    newest = joined.where("topic IS NOT NULL").groupBy("user", "exam").agg(F.max(F.struct("updated", "topic")).alias("t"))
    return requests.join(newest, ["user", "exam"], "left").select("user", "exam", F.col("t.topic").alias("topic"), F.col("t").isNull().alias("created"))


# --- calendar ----------------------------------------------------------------------------------------

# Years that count, and what makes an artifact worth its bytes.
YEARS = (2000, 2100)
USEFUL_ROLES, USEFUL_KINDS = ("specification", "evidence", "knowledge"), ("edital", "prova", "gabarito", "programa")
USEFUL_HINTS = ("edital", "retificacao", "programa", "prova", "gabarito", "padrao_resposta", "apostila", "lei", "artigo", "manual")
_YEAR = r"(?<![A-Za-z0-9_])(20\d{2})(?![A-Za-z0-9_])"


def exam_years(signals: dict[str, Column]) -> Column:
    """struct(year, years, sources): the one year that an exam's signals (names and years, null for none) agree on; conflicting ones give none."""
    each = F.filter(F.array(*[F.struct(y.cast("int").alias("year"), F.lit(name).alias("source")) for name, y in signals.items()]), lambda s: s.year.between(*YEARS))
    years = F.array_sort(F.array_distinct(F.transform(each, lambda s: s.year)))
    sources = F.flatten(F.transform(years, lambda y: F.transform(F.filter(each, lambda s: s.year == y), lambda s: s.source)))
    return F.struct(F.when(F.size(years) == 1, F.get(years, F.lit(0))).alias("year"), years.alias("years"), sources.alias("sources"))


def year_of_text(c: Column) -> Column:
    return F.regexp_extract(c, _YEAR, 1).try_cast("int")


def year_of_edition(c: Column) -> Column:
    """The year that an edition's key begins with, else any in it."""
    return F.coalesce(F.regexp_extract(trim(c), r"^(20\d{2})(?:[.\-_].*)?$", 1).try_cast("int"), year_of_text(c))


def awaits_extraction(role: Column, kind: Column, hint: Column, published: Column, purged: Column, stored: Column) -> Column:
    """Whether an artifact's bytes are still needed: of use, not published, not purged, and stored."""
    useful = F.coalesce(role.isin(*USEFUL_ROLES), F.lit(False)) | F.coalesce(kind.isin(*USEFUL_KINDS), F.lit(False)) | F.coalesce(hint.isin(*USEFUL_HINTS), F.lit(False))
    return useful & ~F.coalesce(published, F.lit(False)) & purged.isNull() & (F.coalesce(stored, F.lit("")) != "")


def calendar_action(years: Column, phase: Column, pending: Column, this_year: Column, dry_run: bool = False) -> Column:
    """struct(action, reason): nothing for exams of this year or later, of no year or several, or with artifacts that are still needed; else archived, and deleted once archived."""
    act = lambda a, r: F.struct(F.lit(a).alias("action"), F.lit(r).alias("reason"))
    return (
        F.when(F.size(years.years) == 0, act("none", "gc_year_missing"))
        .when(years.year.isNull(), act("none", "gc_year_conflict"))
        .when(years.year >= this_year, act("none", "gc_retain_product_year"))
        .when(pending > 0, act("none", "gc_hold_pending_knowledge"))
        .when(phase != "archived", act("soft_archive", "gc_past_year_soft_archive"))
        .otherwise(act("hard_delete_discovery", "gc_past_year_hard_delete_dry_run" if dry_run else "gc_past_year_hard_delete"))
    )
