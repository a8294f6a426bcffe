"""Scores of classifiers and of the bets they imply.

Scored rows: logit, y (0/1 or null), price, and optionally edge, outcome_index and
log_usdc_size. All metrics of a group come from one aggregate of conditional sums;
the exact AUC needs a second job, with prefix sums in two levels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S


def known(scored: DataFrame, logit: str = "logit", y: str = "y") -> DataFrame:
    """Rows with a finite logit and a label that is not one half."""
    z = F.col(logit)
    return scored.where(z.isNotNull() & ~F.isnan(z) & (F.abs(z) != float("inf")) & F.col(y).isNotNull() & (F.col(y) != 0.5))


def with_edges(scored: DataFrame, price: str = "price") -> DataFrame:
    have = set(scored.columns)
    given = F.nanvl(F.col("edge").cast("double"), F.lit(None).cast("double")) if "edge" in have else F.lit(None).cast("double")
    return scored.withColumns({"prob": S.sigmoid("logit")}).withColumns({"pred_edge": F.col("prob") - F.col(price), "true_edge": S.true_edge(given, F.col("y"), F.col(price), F.col("outcome_index") if "outcome_index" in have else None)})


def _mean(x: Column, where: Column | None = None) -> Column:
    return F.avg(F.when(where, x) if where is not None else x)


def core_metrics(scored: DataFrame, by: Sequence[str] = (), price: str = "price") -> DataFrame:
    """Error rates, loss, edge error and the take-all-positive-edges bet (threshold 0)."""
    rows = with_edges(scored, price)
    ok = F.col("y").isNotNull() & ~F.isnan(F.col("y").cast("double")) & ~F.isnan("logit")
    loss = S.log_loss("logit", F.col("y").cast("double"))
    gap, take, true = F.abs(F.col("pred_edge") - F.col("true_edge")), F.col("pred_edge") > 0, F.col("true_edge")
    real = true.isNotNull() & ~F.isnan(gap)
    n = F.count(F.lit(1))
    taken = F.count_if(take & real)
    return rows.groupBy(*by).agg(
        F.coalesce(_mean(((F.col("prob") > 0.5) != (F.col("y") > 0.5)).cast("double"), ok), F.lit(0.0)).alias("misclass"),
        n.alias("n_samples"),
        _mean(loss, ok).alias("bce"),
        F.count_if(ok).alias("bce_n_samples"),
        (F.count_if(ok) / n).alias("bce_coverage"),
        _mean(gap, real).alias("mae_edge"),
        (F.count_if(real) / n).alias("mae_edge_coverage"),
        _mean(((F.col(price) > 0.5) != (F.col("y") > 0.5)).cast("double"), ok).alias("baseline_misclass"),
        F.coalesce(F.sum(F.when(take & real, true)), F.lit(0.0)).alias("pnl"),
        F.coalesce(F.sum(F.when(take & real, true)) / F.when(taken > 0, taken), F.lit(0.0)).alias("pnl_norm"),
        (taken / n).alias("take_rate"),
        F.coalesce(_mean((true > 0).cast("double"), take & real), F.lit(0.0)).alias("hit_rate"),
        taken.alias("n_take"),
    )


def auc(scored: DataFrame, by: Sequence[str] = (), score: str = "logit", y: str = "y", ranges: int = 4096) -> DataFrame:
    """Exact area under the ROC curve with ties averaged; null for one class only.

    Counts by distinct score; then, per group, positives and negatives below a score:
    sums of coarse ranges of the score first, then within a range.
    """
    rows = known(scored, score, y).withColumn("_s", F.col(score).cast("double"))
    keys = list(by)
    cells = rows.groupBy(*keys, "_s").agg(F.count_if(F.col(y) > 0.5).alias("pos"), F.count_if(F.col(y) <= 0.5).alias("neg"))
    cells = cells.withColumn("_r", F.floor(S.sigmoid("_s") * ranges))
    coarse = cells.groupBy(*keys, "_r").agg(F.sum("neg").alias("_neg"))
    w = Window.partitionBy(*keys).orderBy("_r")
    coarse = coarse.select(*keys, "_r", (F.sum("_neg").over(w) - F.col("_neg")).alias("_base"))
    within = Window.partitionBy(*keys, "_r").orderBy("_s")
    met = cells.withColumn("_below", F.sum("neg").over(within) - F.col("neg")).join(coarse, [*keys, "_r"])
    sums = met.groupBy(*keys).agg(F.sum(F.col("pos") * (F.col("_base") + F.col("_below") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    whole = F.col("n_pos") * F.col("n_neg")
    return sums.select(*keys, F.when(whole > 0, F.col("u") / whole).alias("auc"), "n_pos", "n_neg")


def profit(scored: DataFrame, taus: Sequence[float], use_size: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Bets on YES wherever the predicted edge exceeds tau, for each tau: pnl, cost,
    return, hit rate, take rate. The taus are a short list; each row is read once."""
    size = S.usdc_from_log("log_usdc_size") if use_size else F.lit(1.0)
    rows = scored.select(*by, "price", F.col("y").cast("double").alias("y"), (S.sigmoid("logit") - F.col("price")).alias("e"), size.alias("size"))
    rows = rows.withColumn("tau", F.explode(F.array(*[F.lit(float(t)) for t in taus])))
    take = F.col("e") > F.col("tau")
    pnl = F.coalesce(F.sum(F.when(take, (F.col("y") - F.col("price")) * F.col("size"))), F.lit(0.0))
    cost = F.coalesce(F.sum(F.when(take, F.col("price") * F.col("size"))), F.lit(0.0))
    taken = F.count_if(take)
    return rows.groupBy(*by, "tau").agg(
        pnl.alias("pnl"),
        cost.alias("cost"),
        S.share(pnl, cost).alias("roi"),
        F.coalesce(F.avg(F.when(take, (F.col("y") > 0.5).cast("double"))), F.lit(0.0)).alias("hit_rate"),
        (taken / F.count(F.lit(1))).alias("take_rate"),
        F.coalesce(pnl / F.when(taken > 0, taken), F.lit(0.0)).alias("avg_pnl"),
        taken.alias("n_take"),
    )


def confidence(scored: DataFrame, taus: Sequence[float]) -> DataFrame:
    """YES or NO bets wherever the probability is over tau away from one half."""
    p = S.sigmoid("logit")
    rows = scored.select("price", F.col("y").cast("double").alias("y"), p.alias("p")).withColumn("tau", F.explode(F.array(*[F.lit(float(t)) for t in taus])))
    yes, no = F.col("p") > 0.5 + F.col("tau"), F.col("p") < 0.5 - F.col("tau")
    hit = F.when(yes, F.col("y")).when(no, 1 - F.col("y"))
    gain = F.when(yes, F.col("y") - F.col("price")).when(no, F.col("price") - F.col("y"))
    return rows.groupBy("tau").agg((F.count_if(yes | no) / F.count(F.lit(1))).alias("take_rate"), F.coalesce(F.avg(hit), F.lit(0.0)).alias("hit_rate"), F.coalesce(F.sum(gain), F.lit(0.0)).alias("pnl"), F.count_if(yes).alias("n_yes"), F.count_if(no).alias("n_no"))


def report(scored: DataFrame, model: str, by: Sequence[str] = ("split",), price: str = "price") -> DataFrame:
    """Core metrics and AUC by group, under the model's name."""
    rows = known(scored)
    keys = list(by)
    return core_metrics(rows, keys, price).join(auc(rows, keys), keys, "left").withColumn("model", F.lit(model))
