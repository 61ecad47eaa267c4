"""Quality rules: base statistics and robust multivariate outliers (DataFrame functions only).

Every document gets its base statistics and a vector of transformed ones. For each language and source, each language and
the whole, the minimum covariance determinant is estimated by concentration steps: the ``KEPT_SHARE`` of rows
with the least distance gives the next mean and covariance, and so on until no determinant falls by ``TOLERANCE`` any more. Steps begin from two
starts (medians with quartile ranges, and plain moments); the one that ends with the least determinant counts. Its covariance
is scaled so that its distances have the median of a chi-squared law.
A document is rejected if a base rule fails, or if its squared Mahalanobis distance exceeds ``CUT``.

The estimate of a language and source is drawn towards that of its language as by ``PRIOR_ROWS`` further rows, and the latter's towards
that of the whole, so that few rows decide little; the same rule holds at every size. Ratios are shrunk by pseudo-counts, and each variance is
raised by a floor, so that short texts and constant statistics do not reject clean documents. Quantiles are approximate (to 1 in ``ACCURACY``), as an exact one
would gather a group in one task.

Defined results: a null text has no words and fails the base rule; null lang or source form groups like
values; repeated rows are judged each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import materialize, table, words

WINDOW = 8
LEAST_WORDS = 20
KEPT_SHARE = 0.75
TOLERANCE, MOST_STEPS = 0.01, 30
PRIOR_ROWS = 50
ACCURACY = 5000
#: Squared distance: far out in the tail of a chi-squared law with five degrees (about 1e-7).
CUT = 42.0
CHI2_MEDIAN = 4.3515
FEATURES = ("x_word", "x_symbol", "x_line", "x_repeat", "x_shout")
#: Least standard deviation of each feature.
FLOORS = (0.35, 0.5, 0.06, 0.05, 0.04)


def bind(value: Column, use) -> Column:
    """``use(value)`` with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(w: Column) -> Column:
    """How many words lie in windows of WINDOW words that occur twice or more in the text."""

    def covered(hashes: Column) -> Column:
        # sorting brings equal windows together
        keys = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))

        def found(ks: Column) -> Column:
            twice = F.filter(ks, lambda k, i: ((i > 0) & (F.get(ks, i - 1).h == k.h)) | ((i < F.size(ks) - 1) & (F.get(ks, i + 1).h == k.h)))
            places = F.sort_array(F.transform(twice, lambda k: k.i))
            return F.aggregate(
                places,
                F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
                lambda acc, p: F.struct((p + WINDOW).alias("end"), (acc.n + WINDOW - F.greatest(F.lit(0).cast("long"), acc.end - p)).alias("n")),
                lambda acc: acc.n,
            )

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(bind(keys, found))

    hashes = F.transform(F.sequence(F.lit(1), F.size(w) - WINDOW + 1), lambda i: F.xxhash64(F.slice(w, i, F.lit(WINDOW))))
    return F.when(F.size(w) <= WINDOW, F.lit(0).cast("long")).otherwise(bind(hashes, covered))


def base_statistics(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_words = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeated_words(w).alias("n_repeat_words"),
        F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))).cast("long").alias("n_stutter"),
    )
    by_lines = lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("twice"))
    stats = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source"), F.lit("")).alias("source"),
        bind(words(F.col("text")), by_words).alias("w"),
        bind(lines, by_lines).alias("l"),
        F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.char_length(F.regexp_replace(text, r"[^A-Z!?]+", "")).cast("long").alias("n_shout"),
    )
    return stats.select(
        "doc_id", "lang", "source", "w.n_words", "w.word_chars", "n_symbols", F.col("l.twice").alias("n_dup_lines"), "w.n_repeat_words", "w.n_stutter", "n_shout", F.col("l.n").alias("n_lines")
    )


def transformed(stats: DataFrame) -> DataFrame:
    n, chars = F.col("n_words"), F.col("word_chars")
    return stats.withColumns(
        {
            "base_failed": (n < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 30 * n),
            "x_word": F.log((chars + 250.0) / (n + 50.0)) * 2.0,
            "x_symbol": F.log1p(1000.0 * F.col("n_symbols") / (chars + 200.0)),
            "x_line": F.col("n_dup_lines") / (F.col("n_lines") + 5.0),
            "x_repeat": (F.col("n_repeat_words") + F.col("n_stutter")) / (n + 50.0),
            "x_shout": F.sqrt(F.col("n_shout") / (chars + 200.0)),
        }
    )


D = len(FEATURES)
UPPER = [(i, j) for i in range(D) for j in range(i, D)]
MEANS, COVARIANCES = [f"m_{i}" for i in range(D)], [f"c_{i}_{j}" for i, j in UPPER]


def factored(estimate: DataFrame) -> DataFrame:
    """The Cholesky factor (columns l_i_j) of each covariance (columns c_i_j), and the logarithm of its determinant."""
    for j in range(D):
        rest = sum((F.col(f"l_{j}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))
        estimate = estimate.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(F.col(f"c_{j}_{j}") - rest, F.lit(FLOORS[j] ** 2 * 0.25))))
        below = {}
        for i in range(j + 1, D):
            dot = sum((F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))
            below[f"l_{i}_{j}"] = (F.col(f"c_{j}_{i}") - dot) / F.col(f"l_{j}_{j}")
        if below:
            estimate = estimate.withColumns(below)
    names = [f"l_{i}_{j}" for i in range(D) for j in range(i + 1)]
    return estimate.select("grp", *MEANS, *COVARIANCES, *names, (2.0 * sum((F.log(f"l_{i}_{i}") for i in range(1, D)), F.log("l_0_0"))).alias("log_det"))


def distances(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance by the factored estimate of the row's group."""
    out = rows.join(estimate.select("grp", *MEANS, *(f"l_{i}_{j}" for i in range(D) for j in range(i + 1))), "grp")
    for i in range(D):
        known = sum((F.col(f"l_{i}_{j}") * F.col(f"y_{j}") for j in range(i)), F.lit(0.0))
        out = out.withColumn(f"y_{i}", (F.col(FEATURES[i]) - F.col(f"m_{i}") - known) / F.col(f"l_{i}_{i}"))
    out = out.withColumn("d2", sum((F.col(f"y_{i}") * F.col(f"y_{i}") for i in range(1, D)), F.col("y_0") * F.col("y_0")))
    return out.select(*rows.columns, "d2")


def _moments(rows: DataFrame) -> DataFrame:
    spread = [(F.covar_pop(FEATURES[i], FEATURES[j]) + (FLOORS[i] ** 2 if i == j else 0.0)).alias(f"c_{i}_{j}") for i, j in UPPER]
    return rows.groupBy("grp").agg(*(F.avg(x).alias(m) for x, m in zip(FEATURES, MEANS)), *spread)


def _quartiles(rows: DataFrame) -> DataFrame:
    found = rows.groupBy("grp").agg(*(F.percentile_approx(x, [0.25, 0.5, 0.75], ACCURACY).alias(f"q_{i}") for i, x in enumerate(FEATURES)))
    spread = {(i, i): F.pow((F.col(f"q_{i}")[2] - F.col(f"q_{i}")[0]) / 1.349, 2) + FLOORS[i] ** 2 for i in range(D)}
    return found.select("grp", *(F.col(f"q_{i}")[1].alias(m) for i, m in enumerate(MEANS)), *(spread.get(k, F.lit(0.0)).alias(c) for k, c in zip(UPPER, COVARIANCES)))


def _concentrated(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """The moments of the rows nearest to the estimate."""
    near = distances(rows, estimate)
    cut = near.groupBy("grp").agg(F.percentile_approx("d2", KEPT_SHARE, ACCURACY).alias("cut"))
    return _moments(near.join(materialize(cut, "cut"), "grp").where("d2 <= cut"))


def robust_estimates(rows: DataFrame) -> DataFrame:
    """The minimum-covariance-determinant mean and covariance of each group (grp), factored."""
    starts = {"m": _moments, "q": _quartiles}
    began = [found(rows).withColumn("grp", F.concat(F.lit(s), "grp")) for s, found in starts.items()]
    estimate = materialize(factored(began[0].unionByName(began[1])), "estimate")
    doubled = rows.select(F.explode(F.array(*(F.concat(F.lit(s), "grp") for s in starts))).alias("grp"), *FEATURES)
    for step in range(MOST_STEPS):
        new = factored(_concentrated(doubled, estimate))
        if step == 0:
            better = new.withColumn("fell", F.lit(True))  # a start is no estimate of a part of the rows
        else:
            old, fell = estimate.alias("old"), F.col("new.log_det") < F.col("old.log_det") - TOLERANCE
            better = new.alias("new").join(old, "grp").select("grp", *(F.when(fell, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in new.columns[1:]), fell.alias("fell"))
        estimate = materialize(better, "estimate")
        if estimate.where("fell").limit(1).count() == 0:
            break
    columns = [c for c in estimate.columns if c not in ("grp", "fell")]
    least = estimate.groupBy(F.expr("substring(grp, 2)").alias("grp")).agg(F.min_by(F.struct(*columns), F.struct("log_det", "grp")).alias("e")).select("grp", "e.*")
    least = materialize(least, "estimate")
    # consistency: widen a covariance whose distances have too large a median
    median = distances(rows, least).groupBy("grp").agg(F.percentile_approx("d2", 0.5, ACCURACY).alias("median"), F.count("*").alias("n"))
    wide = F.greatest(F.col("median") / CHI2_MEDIAN, F.lit(1.0))
    return materialize(least.join(median, "grp").select("grp", "n", "log_det", *MEANS, *((F.col(c) * wide).alias(c) for c in COVARIANCES)), "estimate")


def _drawn(own: DataFrame, above: DataFrame, key) -> DataFrame:
    """Estimates drawn towards those of the group above, as by PRIOR_ROWS rows with its moments."""
    pair = own.alias("own").join(above.select(*(F.col(c).alias(f"above_{c}") for c in ("grp", *MEANS, *COVARIANCES))), key == F.col("above_grp"))
    mixed = lambda c: ((F.col("n") * F.col(c) + PRIOR_ROWS * F.col(f"above_{c}")) / (F.col("n") + PRIOR_ROWS)).alias(c)
    return pair.select("grp", "n", *map(mixed, (*MEANS, *COVARIANCES)))


def _names(lang: Column, source: Column) -> list[Column]:
    """The groups of a row, from the whole to its language and source; lengths in front keep names apart."""
    of_lang = F.concat(F.lit("l"), F.char_length(lang), F.lit(":"), lang)
    return [F.lit("all"), of_lang, F.concat(of_lang, F.lit("/"), source)]


def group_estimates(rows: DataFrame) -> DataFrame:
    """The factored estimate that judges each language and source."""
    found = robust_estimates(rows.select(F.explode(F.array(*_names(F.col("lang"), F.col("source")))).alias("grp"), *FEATURES))
    pairs = rows.select("lang", "source").distinct().select(*(n.alias(f"name_{i}") for i, n in enumerate(_names(F.col("lang"), F.col("source")))))
    pairs = materialize(pairs, "pairs")
    langs = _drawn(found.join(pairs.select(F.col("name_1").alias("grp")).distinct(), "grp"), found.where("grp = 'all'"), F.lit("all"))
    own = found.join(pairs.select(F.col("name_2").alias("grp"), "name_1"), "grp")
    return materialize(factored(_drawn(own, materialize(langs, "langs"), F.col("name_1"))), "estimate")


def judge(docs: DataFrame) -> DataFrame:
    """Base statistics, base_failed, squared distance d2 and kept of every document."""
    rows = materialize(transformed(base_statistics(docs)), "statistics").withColumn("grp", _names(F.col("lang"), F.col("source"))[2])
    usable = rows.where(~F.col("base_failed"))
    # a group in which every row fails the base rules has no estimate, and its rows are rejected by them
    scored = distances(usable, group_estimates(usable)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "d2")
    failed = rows.where("base_failed").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.lit(None).cast("double").alias("d2"))
    return scored.unionByName(failed).withColumn("kept", ~F.col("base_failed") & (F.col("d2") <= CUT))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")


QUERIES = {"op6_quality_rules": op6_quality_rules}
ORACLES: dict[str, str] = {}
