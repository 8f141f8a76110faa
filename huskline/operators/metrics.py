"""How well detectors do.  Each is one aggregation with partial sums, over columns of the same row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import summed_before


def confusion(truth: Column, said: Column) -> list[Column]:
    return [F.count_if(truth & said).alias("tp"), F.count_if(~truth & said).alias("fp"), F.count_if(truth & ~said).alias("fn"), F.count_if(~truth & ~said).alias("tn")]


def rates(counted: DataFrame, digits: int = 6) -> DataFrame:
    """accuracy, precision, recall, f1 beside the four counts; null where a denominator is zero."""
    d = lambda a, b: F.round(F.try_divide(a, b), digits)
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return counted.withColumns({"accuracy": d(tp + tn, tp + fp + fn + tn), "precision": d(tp, tp + fp), "recall": d(tp, tp + fn), "f1": d(2 * tp, 2 * tp + fp + fn)})


def binary(rows: DataFrame, truth: Column, said: Column, by: list[str] | None = None) -> DataFrame:
    return rates(rows.groupBy(*(by or [])).agg(*confusion(truth, said)))


def by_group(rows: DataFrame, truth: Column, said: Column, group: str) -> DataFrame:
    """Per group and, where the group is null, overall."""
    return rates(rows.rollup(group).agg(*confusion(truth, said)))


def auc_rounded(rows: DataFrame, truth: Column, said: Column) -> DataFrame:
    """Area under the curve of decisions: mean of both classes' recall."""
    c = rows.agg(*confusion(truth, said))
    return c.select(F.round((F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")) + F.try_divide(F.col("tn"), F.col("tn") + F.col("fp"))) / 2, 6).alias("auc"))


def roc(rows: DataFrame, truth: Column, score: Column, digits: int = 4) -> DataFrame:
    """threshold, tpr, fpr from the highest score on.  Scores are cut to `digits` and counted first; only distinct ones, at most 10^digits, are sorted."""
    bins = rows.groupBy((F.floor(score * 10**digits) / 10**digits).alias("threshold")).agg(F.count_if(truth).alias("p"), F.count_if(~truth).alias("n"))
    down = Window.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return bins.select("threshold", F.try_divide(F.sum("p").over(down), F.sum("p").over(every)).alias("tpr"), F.try_divide(F.sum("n").over(down), F.sum("n").over(every)).alias("fpr"))


def auc(curve: DataFrame) -> DataFrame:
    """Area under a ROC curve, by trapezoids."""
    w = Window.orderBy(F.desc("threshold"))
    steps = curve.select("tpr", "fpr", F.lag("tpr", 1, 0.0).over(w).alias("t0"), F.lag("fpr", 1, 0.0).over(w).alias("f0"))
    return steps.agg(F.round(F.sum((F.col("fpr") - F.col("f0")) * (F.col("tpr") + F.col("t0")) / 2), 6).alias("auc"))


def exact_curve(rows: DataFrame, truth: Column, score: Column) -> DataFrame:
    """score, p and n (true and false rows of that score), before_p and before_n (those of higher scores), all_p, all_n: a ROC curve of all distinct scores, none cut.

    Sums over ranges of scores, so no task holds the curve.  Rows whose score or truth is null, and scores that are not numbers, are left out."""
    told = rows.select(score.cast("double").alias("score"), truth.alias("truth")).where("score IS NOT NULL AND NOT isnan(score) AND truth IS NOT NULL")
    counts = told.groupBy("score").agg(F.count_if("truth").alias("p"), F.count_if(~F.col("truth")).alias("n"))
    return summed_before(counts, {"_down": -F.col("score")}, "p", "n")


def exact_auc(rows: DataFrame, truth: Column, score: Column) -> DataFrame:
    """auc: the share of pairs of a true and a false row that the score orders rightly; ties count half."""
    curve = exact_curve(rows, truth, score)
    return curve.agg(F.round(F.try_divide(F.sum(F.col("n") * (F.col("before_p") + F.col("p") / 2)), F.max("all_p").cast("double") * F.max("all_n")), 6).alias("auc"))


THRESHOLDS = (0.2, 0.4, 0.5, 0.6, 0.8)


def sweep(rows: DataFrame, truth: Column, score: Column, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Rates at each threshold, from one pass: a row's score counts once for each, and nothing is joined."""
    counted = rows.agg(*(c.alias(f"{n}_{i}") for i, t in enumerate(thresholds) for n, c in zip(("tp", "fp", "fn", "tn"), confusion(truth, score > t))))
    unpivoted = counted.select(F.inline(F.array(*(F.struct(F.lit(t).cast("double").alias("threshold"), *(F.col(f"{n}_{i}").alias(n) for n in ("tp", "fp", "fn", "tn"))) for i, t in enumerate(thresholds)))))
    return rates(unpivoted)


def shares(rows: DataFrame, *by: str, within: str | None = None) -> DataFrame:
    """by, n, percent of all rows, or of the rows of `within`."""
    whole = Window.partitionBy(within) if within else Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counted = rows.groupBy(*by).agg(F.count("*").alias("n"))
    return counted.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(whole), 2))


def paired(rows: DataFrame, truth: Column, **said: Column) -> DataFrame:
    """Two detectors against the truth, from one pass: detector, its counts and rates, n_only_right (rows that it alone has right), n_both_right, and chi_squared of their disagreement (with continuity correction; null where they never disagree)."""
    (one, first), (two, second) = said.items()
    counted = rows.groupBy(truth.alias("t"), first.alias("a"), second.alias("b")).agg(F.count("*").alias("k"))
    add = lambda c: F.coalesce(F.sum(F.when(c, F.col("k"))), F.lit(0))
    t, a, b = F.col("t"), F.col("a"), F.col("b")
    alone = {"a": add((a == t) & (b != t)), "b": add((b == t) & (a != t))}
    counts = [c.alias(f"{n}_{name}") for name, x in (("a", a), ("b", b)) for n, c in (("tp", add(t & x)), ("fp", add(~t & x)), ("fn", add(t & ~x)), ("tn", add(~t & ~x)), ("n_only_right", alone[name]))]
    whole = counted.agg(*counts, add((a == t) & (b == t)).alias("n_both_right"))
    gap = F.greatest(F.abs(F.col("n_only_right_a") - F.col("n_only_right_b")) - 1, F.lit(0))
    told = whole.withColumn("chi_squared", F.round(F.try_divide(gap * gap, F.col("n_only_right_a") + F.col("n_only_right_b")), 6))
    each = F.array(*[F.struct(F.lit(name).alias("detector"), *[F.col(f"{n}_{x}").alias(n) for n in ("tp", "fp", "fn", "tn", "n_only_right")]) for x, name in (("a", one), ("b", two))])
    return rates(told.select(F.inline(each), "n_both_right", "chi_squared"))


def percentiles(histogram: DataFrame, by: str, value: str, count: str, shares: tuple[float, ...]) -> DataFrame:
    """by, share, value: the least value up to which that share of the rows lies, out of a histogram."""
    upto = Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    told = histogram.withColumn("_upto", F.sum(count).over(upto)).withColumn("_all", F.sum(count).over(Window.partitionBy(by)))
    least = [F.min(F.when(F.col("_upto") >= F.ceil(F.col("_all") * s), F.col(value))).alias(f"_{i}") for i, s in enumerate(shares)]
    return told.groupBy(by).agg(*least).select(by, F.inline(F.array(*[F.struct(F.lit(float(s)).alias("share"), F.col(f"_{i}").alias(value)) for i, s in enumerate(shares)])))
