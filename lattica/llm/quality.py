"""Quality rules whose cutoffs keep false rejections under control."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import WORD, let, materialize

WINDOW_WORDS = 8
#: Steps of a signal's cutoffs, and the value of each signal at the last of them. Values above it count as it.
STEPS = 64
SIGNALS = {"symbols": 1.0, "bangs": 2.0, "capitals": 1.0, "pipes": 1.0, "duplicate_lines": 1.0, "repeated_words": 1.0, "word_length": 2.0}


def _covered(windows: Column) -> Column:
    """Words under windows whose hash occurs twice or more, from the hashes of all windows in order."""
    tagged = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    again = lambda t: F.filter(t, lambda x, i: (x.h == F.get(t, i - 1).h) | (x.h == F.get(t, i + 1).h))
    places = F.sort_array(F.transform(let(tagged, again), lambda x: x.i))
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW_WORDS).alias("last"))
    step = lambda a, p: F.struct((a.n + F.least(F.lit(WINDOW_WORDS), p - a.last)).alias("n"), p.alias("last"))
    return F.aggregate(places, start, step, lambda a: a.n)


def base_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the signals, one row per row.

    All in columns. Repeated windows are found by sorting their 64-bit hashes, in n log n steps.
    """
    count = lambda kind: F.length(F.regexp_replace("text", f"[^{kind}]+", ""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    rows = rows.select(
        "doc_id", "stratum", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"), count("#*$%&|<>").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"), F.size(F.split("text", "\n")).alias("n_lines"),
        count("!").alias("n_bangs"), count("A-Z").alias("n_capitals"), count("|").alias("n_pipes"),
    )
    n = F.size("words")
    window = lambda i: F.xxhash64(*[F.get("words", i + j) for j in range(WINDOW_WORDS)])
    rows = rows.select(
        "*", n.alias("n_words"), F.length(F.array_join("words", "")).alias("word_chars"),
        F.when(n >= WINDOW_WORDS, F.transform(F.sequence(F.lit(0), n - WINDOW_WORDS), window)).alias("windows"),
    )
    repeated = F.when(F.size("windows") > F.size(F.array_distinct("windows")), _covered(F.col("windows"))).otherwise(0)
    rows = rows.drop("words").withColumn("n_repeat_words", repeated).drop("windows")
    rows = rows.withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))
    chars, words = F.greatest("word_chars", F.lit(1)), F.greatest("n_words", F.lit(1))
    signals = {
        "symbols": F.col("n_symbols") / chars, "bangs": F.col("n_bangs") / words, "capitals": F.col("n_capitals") / chars, "pipes": F.col("n_pipes") / words,
        "duplicate_lines": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)), "repeated_words": F.col("n_repeat_words") / words,
        "word_length": F.abs(F.log(F.greatest(chars / words, F.lit(1e-9)) / 5)),
    }
    longs = [F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    step = lambda c, top: F.least(F.lit(STEPS), F.ceil(c * STEPS / top)).cast("int")
    return rows.select("doc_id", "stratum", *longs, "base_failed", *[step(signals[k], top).alias(f"at_{k}") for k, top in SIGNALS.items()])


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X from Bin(n, p), summed in logarithms; 1 where k is above the mean, which is all a test at a small level asks."""
    first = F.struct((n * math.log1p(-p)).cast("double").alias("term"), (n * math.log1p(-p)).cast("double").alias("total"))

    def step(a: Column, i: Column) -> Column:
        term = a.term + F.log((n - i + 1) / i) + math.log(p / (1 - p))
        total = F.greatest(a.total, term) + F.log1p(F.exp(-F.abs(a.total - term)))
        return F.struct(term.cast("double").alias("term"), total.cast("double").alias("total"))

    summed = F.aggregate(F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>")), first, step, lambda a: F.exp(a.total))
    return F.when(k > n * p, F.lit(1.0)).otherwise(summed)


def risk_controlled_cutoffs(features: DataFrame, labels: DataFrame, limit: float = 0.01, error: float = 0.05, cost: float = 20.0) -> DataFrame:
    """(stratum, signal, cutoff): documents with a signal above its stratum's cutoff may be rejected.

    With probability 1 - ``error``, in every stratum all signals together reject a share of at most
    ``limit`` of good documents. Labelled rows are dealt by the hash of their doc_id into a tuning
    half and a holdout. The tuning half proposes for each stratum and signal the cutoff with the most
    bad rejections, less ``cost`` times the good ones, and the order of the signals: most gained first.
    Rules are then tested on the holdout from the laxest on: the first signal's cutoff comes down to the
    proposal step by step, then the next one's is added. Each test is on all rejections of the rule, by the exact
    binomial probability of as few false ones at a true share of ``limit``; the first that isn't
    significant ends the walk (a fixed sequence, which needs no correction among rules or signals).
    Bonferroni corrects for the strata that have a proposal and enough good holdout rows to be
    significant at all, which false rejections have no part in. Where nothing is significant, as with
    few labels, there is no row: nothing is rejected.
    """
    good = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).alias("good"))
    held = (F.xxhash64("doc_id", F.lit("holdout")) % 2 == 0).alias("held")
    marked = features.join(good, "doc_id").where("not base_failed")
    marked = materialize(marked.select("stratum", held, "good", F.create_map(*[c for k in SIGNALS for c in (F.lit(k), F.col(f"at_{k}"))]).alias("ats")), "marked")
    counts = marked.where("not held").select("stratum", "good", F.explode("ats").alias("signal", "at")).groupBy("stratum", "signal", "at").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"))
    counts = materialize(counts, "counts")
    every = counts.select("stratum", "signal").distinct().select("stratum", "signal", F.explode(F.sequence(F.lit(0), F.lit(STEPS))).alias("at"))
    counts = every.join(counts.withColumnRenamed("stratum", "s").withColumnRenamed("signal", "k").withColumnRenamed("at", "a"), F.expr("stratum <=> s and signal = k and at = a"), "left").na.fill(0, ["g", "b"])
    above = Window.partitionBy("stratum", "signal").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    over = lambda c: F.coalesce(F.sum(c).over(above), F.lit(0))
    counts = counts.select("stratum", "signal", "at", (over("b") - cost * over("g")).alias("gain"))
    proposed = counts.groupBy("stratum", "signal").agg(F.max(F.struct("gain", "at")).alias("best")).where("best.gain > 0")
    order = Window.partitionBy("stratum").orderBy(F.desc("best.gain"), "signal")  # a row for each signal
    proposed = proposed.select(F.col("stratum").alias("s"), "signal", F.col("best.at").alias("best"), (F.row_number().over(order) - 1).alias("turn"))
    plans = materialize(proposed.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("turn", "signal", "best"))).alias("plan")), "plans")  # one entry a signal
    # place: the first rule of the walk that rejects the row
    place = lambda x: F.when(F.col("ats")[x.signal] > x.best, x.turn * STEPS + STEPS - F.col("ats")[x.signal])
    judged = marked.where("held and good").join(plans, F.col("stratum").eqNullSafe(F.col("s")))
    false = materialize(judged.groupBy("s", F.array_min(F.transform("plan", place)).alias("place")).agg(F.count("*").alias("k")), "false")
    enough = false.groupBy(F.col("s").alias("t")).agg(F.sum("k").alias("n")).where(F.col("n") * math.log1p(-limit) <= math.log(error))
    tests = max(1, enough.count())
    walk = plans.join(enough, F.col("s").eqNullSafe(F.col("t"))).select("s", "n", F.explode("plan").alias("x"))
    walk = walk.select("s", "n", "x.*", F.explode(F.sequence(F.lit(1), STEPS - F.col("x.best"))).alias("down"))
    walk = walk.select(F.col("s").alias("stratum"), "n", "signal", (STEPS - F.col("down")).alias("cutoff"), (F.col("turn") * STEPS + F.col("down") - 1).alias("at"))
    walk = walk.join(false.where("place is not null"), F.expr("stratum <=> s and at = place"), "left")
    so_far = Window.partitionBy("stratum").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)  # STEPS rows a signal at most
    walk = walk.withColumn("k", F.sum(F.coalesce("k", F.lit(0))).over(so_far))
    significant = binomial_tail(F.col("k"), F.col("n"), limit) <= error / tests
    walk = walk.withColumn("failed", F.sum(F.when(significant, 0).otherwise(1)).over(so_far))
    return walk.where("failed = 0").groupBy("stratum", "signal").agg(F.min("cutoff").alias("cutoff"))


def apply_quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", **options) -> DataFrame:
    """The base features of every row of ``docs``, kept, and rejected_by (signals over their cutoffs, comma-joined).

    kept is false where base_failed, else where some signal is above its stratum's cutoff. Null
    texts have no words and fail; a null stratum is a stratum of its own; rows with several labels
    count once, by majority; labels without a document or a value count for nothing. Repeated rows
    give repeated rows. Empty documents give no rows; empty labels reject nothing beyond the base.
    """
    features = materialize(base_features(docs, id_col, text_col, stratum_col), "features")
    cutoffs = risk_controlled_cutoffs(features, labels, **options)
    rules = cutoffs.groupBy(F.col("stratum").alias("s")).agg(F.map_from_entries(F.collect_list(F.struct("signal", "cutoff"))).alias("rules"))  # one entry a signal
    judged = features.join(rules, F.col("stratum").eqNullSafe(F.col("s")), "left")
    over = F.array_compact(F.array(*[F.when(F.col(f"at_{k}") > F.col("rules")[k], F.lit(k)) for k in SIGNALS]))
    rejected = F.when(F.col("base_failed") | F.col("rules").isNull(), F.array().cast("array<string>")).otherwise(over)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return judged.select(*columns, (~F.col("base_failed") & (F.size(rejected) == 0)).alias("kept"), F.array_join(rejected, ",").alias("rejected_by"))
