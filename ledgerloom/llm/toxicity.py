"""Toxicity by a classifier chain of linear models.

The categories are predicted one after another: each model sees the text's terms
and the probabilities of the categories before it. In training those come from
models that have not seen the row (FOLDS folds), in scoring from the final ones.
Terms are the distinct words of a text and their first PREFIXES letters (so that
an ending that no labelled row has still counts by its root). Each fit takes the
TERMS terms that tell its classes apart best, by the z score of the log odds over
its own training rows, and an L1 penalty, so that length adds nothing to a verdict.
The fits of one category are tasks side by side, each over the bounded sample; what
comes to the driver is their weights.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import drop_table, fresh, text_of, written

#: SAMPLE bounds the labelled rows that models are fitted on (chosen by a hash of
#: the id; expected count). Everything is scored.
SAMPLE, TERMS, PREFIXES, FOLDS, PENALTY, ROUNDS, SUPPORT = 20_000, 2048, (4, 5), 3, 1e-4, 200, 3
CHAIN = ("quality", "toxic")
_WORD = re.compile(r"[^\W\d_]+")


def word_terms(piece: str) -> tuple[str, ...]:
    """The terms that a piece between blanks gives."""
    out = []
    for w in _WORD.findall(piece):
        out += [w, *[f"{w[:n]}-" for n in PREFIXES if len(w) > n]]
    return tuple(out)


class _Terms(dict):
    """Pieces to the terms that `wanted` has (None: all); forgets all when full."""

    def __init__(self, wanted: dict[str, int] | None = None, keep: int = 200_000):
        self.wanted, self.keep = wanted, keep

    def __missing__(self, piece: str):
        found = word_terms(piece)
        if self.wanted is not None:
            found = tuple(self.wanted[x] for x in found if x in self.wanted)
        if len(self) >= self.keep:
            self.clear()
        self[piece] = found
        return found

    def of(self, text: str) -> set:
        return {x for piece in set(text.lower().split()) for x in self[piece]}


def _sigmoid(x):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """A linear model on terms and on earlier probabilities (as log odds)."""

    def __init__(self, bias: float, terms: dict[str, float], earlier: Sequence[float]):
        self.bias, self.terms, self.earlier = bias, terms, list(earlier)


def fit_linear(flat, counts, y, dense, width: int, penalty: float = PENALTY, rounds: int = ROUNDS):
    """L1-penalised logistic regression by accelerated proximal gradient steps.
    flat: the rows' term columns that are 1, one row after another; counts: how many
    each row has; dense: further columns. Returns (bias, term weights, dense weights)."""
    import numpy as np

    row, n, k = np.repeat(np.arange(len(counts)), counts), len(counts), dense.shape[1]
    scale = np.maximum(np.bincount(flat, minlength=width) / n, 1e-9)
    # Steps by column: curvature is at most a quarter of a column's mean square,
    # times the row's number of active columns; the mean row serves as that number.
    active = max(1.0, counts.mean()) + k + 1
    step = 4 / (np.concatenate([[1.0], scale, np.maximum((dense**2).mean(0), 1e-9)]) * active)
    bound = penalty * np.concatenate([[0.0], np.ones(width), np.full(k, 0.1)])
    w = np.concatenate([[np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6))], np.zeros(width + k)])
    z, t = w.copy(), 1.0
    for _ in range(rounds):
        score = z[0] + np.bincount(row, z[1 + flat], minlength=n) + dense @ z[1 + width :]
        gap = (_sigmoid(score) - y) / n
        slope = np.concatenate([[gap.sum()], np.bincount(flat, gap[row], minlength=width), dense.T @ gap])
        new = z - step * slope
        new = np.sign(new) * np.maximum(np.abs(new) - step * bound, 0)
        if (slope * (new - w)).sum() > 0:  # a step too far: begin anew from here
            t = 1.0
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, w, t = new + (t - 1) / s * (new - w), new, s
    return float(w[0]), w[1 : 1 + width], w[1 + width :]


def _telling(counts: DataFrame, category: str, without: int | None, totals: dict) -> list[str]:
    """The TERMS terms of the largest absolute z score among rows outside a fold."""
    folds = [k for k in range(FOLDS) if k != without]
    on = sum((F.col(f"{category}_1_{k}") for k in folds), F.lit(0))
    off = sum((F.col(f"{category}_0_{k}") for k in folds), F.lit(0))
    n1, n0 = (sum(totals[category, v, k] for k in folds) for v in (1, 0))
    odds = F.log((on + 0.5) / (F.lit(n1 + 1.0) - on)) - F.log((off + 0.5) / (F.lit(n0 + 1.0) - off))
    z = F.abs(odds) / F.sqrt(1 / (on + 0.5) + 1 / (off + 0.5))
    top = counts.where(on + off >= SUPPORT).select("term", z.alias("z")).orderBy(F.desc("z"), "term").limit(TERMS)
    return [r["term"] for r in top.collect()]


def fit(docs: DataFrame, labels: DataFrame, categories: Sequence[str] = CHAIN, sample: int = SAMPLE, text: str = "text", key: str = "doc_id") -> list[Model]:
    """Fits the chain on labelled documents. labels: the key and a column of numbers
    for each category (over 0: it applies; null: not known). A key that is labelled
    more than once counts with its largest labels; rows without a key take no part,
    null texts are empty. Where the labels have fewer than two classes, the
    category's probability is that class's (0 without labels).

    Term counts are summed by Spark. At most `sample` rows (expected), as the few
    terms chosen that they hold, meet in one task for each fit. Extra columns are not
    read.
    """
    marks = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(*[F.max(c).alias(f"_{c}") for c in categories])
    share = min(1.0, sample / max(1, marks.count()))
    chosen = marks.where(F.pmod(F.xxhash64("_key"), F.lit(1 << 30)) < int(share * (1 << 30)))
    label = [F.when(F.col(f"_{c}").isNotNull(), (F.col(f"_{c}") > 0).cast("int")).alias(f"_{c}") for c in categories]
    fold = F.pmod(F.xxhash64(F.lit("fold"), "_key"), F.lit(FOLDS)).cast("int").alias("_fold")
    rows = docs.select(F.col(key).alias("_key"), text_of(text).alias("_text")).join(chosen, "_key").select("_key", "_text", fold, *label)
    rows = written(rows, "toxicity-sample")
    cells = [(c, v, k) for c in categories for v in (0, 1) for k in range(FOLDS)]
    at = {x: i for i, x in enumerate(cells)}

    def tally(batches: Iterator) -> Iterator:
        import pyarrow as pa

        terms, sums = _Terms(), {}
        for batch in batches:
            for r in batch.to_pylist():
                own = [at[c, r[f"_{c}"], r["_fold"]] for c in categories if r[f"_{c}"] is not None]
                for x in terms.of(r["_text"]):
                    cell = sums.setdefault(x, [0] * len(cells))
                    for i in own:
                        cell[i] += 1
        names = list(sums)
        for i in range(0, len(names), 50_000):
            part = names[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), *[pa.array(x, pa.int64()) for x in zip(*map(sums.__getitem__, part), strict=True)]], ["term", *columns])

    columns = ["_".join(map(str, x)) for x in cells]
    counts = rows.mapInArrow(tally, "term string, " + ", ".join(f"`{c}` long" for c in columns))
    counts = written(counts.groupBy("term").agg(*[F.sum(c).alias(c) for c in columns]), "toxicity-terms")
    sums = rows.agg(*[F.count_if((F.col(f"_{c}") == v) & (F.col("_fold") == k)).alias(n) for (c, v, k), n in zip(cells, columns, strict=True)]).first()
    totals = {x: sums[n] for x, n in zip(cells, columns, strict=True)}

    def classes(c: str, without: int | None) -> list[int]:
        return [sum(totals[c, v, k] for k in range(FOLDS) if k != without) for v in (0, 1)]

    fits = [(c, w) for c in categories for w in ([None] if c == categories[-1] else [*range(FOLDS), None])]
    chosen_terms = {f: _telling(counts, *f, totals) if all(classes(*f)) else [] for f in fits}
    union = {x: i for i, x in enumerate(sorted({x for xs in chosen_terms.values() for x in xs}))}

    def held(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        terms = _Terms(union)
        for batch in batches:
            ids = [np.array(sorted(terms.of(t)), "<i4").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(ids, pa.binary()), pa.array([[]] * len(ids), pa.list_(pa.float64()))], [*batch.schema.names[2:], "ids", "odds"])

    schema = ", ".join(["_fold int", *[f"`_{c}` int" for c in categories], "ids binary", "odds array<double>"])
    data = written(rows.mapInArrow(held, schema), "toxicity-terms-held")
    drop_table(counts)
    drop_table(rows)
    models = []
    for i, c in enumerate(categories):
        own = [w for f, w in fits if f == c]
        learned = _fitted(data, c, {w: [union[x] for x in chosen_terms[c, w]] for w in own if all(classes(c, w))}, len(union))
        found = {}
        for w in own:
            if w in learned:
                bias, weights, earlier = learned[w]
                found[w] = Model(bias, {x: float(v) for x, v in zip(chosen_terms[c, w], weights, strict=True) if v}, earlier)
            else:
                found[w] = Model(30.0 if classes(c, w)[1] else -30.0, {}, [0.0] * i)
        models.append(found[None])
        if i + 1 < len(categories):
            new = written(_out_of_fold(data, {w: m for w, m in found.items() if w is not None}, union), "toxicity-odds")
            drop_table(data)
            data = new
    drop_table(data)
    return models


def _fitted(data: DataFrame, category: str, columns: dict[int | None, list[int]], size: int) -> dict:
    """For each fit (the fold that is left out, or None) its bias, term weights and
    weights of earlier odds. columns: the numbers of its terms. One task for each fit."""
    import numpy as np
    import pandas as pd

    if not columns:
        return {}
    all_rows, label = -1, f"_{category}"

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        fit = int(pdf["fit"].iloc[0])
        own = columns[None if fit == all_rows else fit]
        column = np.full(size, -1, np.int32)
        column[own] = np.arange(len(own))
        counts = pdf["ids"].str.len().to_numpy(np.int64) // 4
        flat = column[np.frombuffer(b"".join(pdf["ids"]), "<i4")]
        counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[flat >= 0], minlength=len(counts))
        dense = np.array(pdf["odds"].tolist(), float).reshape(len(pdf), -1)
        bias, weights, earlier = fit_linear(flat[flat >= 0], counts, pdf[label].to_numpy(float), dense, len(own))
        return pd.DataFrame({"fit": [fit], "bias": [bias], "weights": [weights.tolist()], "earlier": [earlier.tolist()]})

    every = F.explode(F.array(*[F.lit(all_rows if w is None else w) for w in columns])).alias("fit")
    rows = data.where(F.col(label).isNotNull()).select("_fold", label, "ids", "odds", every).where("fit <> _fold")
    found = rows.groupBy("fit").applyInPandas(train, "fit int, bias double, weights array<double>, earlier array<double>").collect()
    return {None if r["fit"] == all_rows else r["fit"]: (r["bias"], r["weights"], r["earlier"]) for r in found}


def _out_of_fold(data: DataFrame, models: dict[int, Model], union: dict[str, int]) -> DataFrame:
    """data with one more of the odds: those of the model that left out the row's fold."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        weights = {k: np.zeros(len(union)) for k in models}
        for k, m in models.items():
            for x, v in m.terms.items():
                weights[k][union[x]] = v
        for batch in batches:
            out = []
            for fold, ids, odds in zip(*[batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("_fold", "ids", "odds")], strict=True):
                m = models[fold]
                score = m.bias + sum(a * b for a, b in zip(odds, m.earlier, strict=True)) + weights[fold][np.frombuffer(ids, "<i4")].sum()
                out.append([*odds, float(np.clip(score, -30, 30))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.list_(pa.float64()))], batch.schema.names)

    return data.mapInArrow(run, data.schema)


def _with_probabilities(docs: DataFrame, models: list[Model], names: Sequence[str], text: str) -> DataFrame:
    """docs with a column for each model's probability, in the tasks that read them."""
    from pyspark.sql import types as T

    wanted = {x: i for i, x in enumerate(sorted({x for m in models for x in m.terms}))}
    weights = [{wanted[x]: v for x, v in m.terms.items()} for m in models]
    bias, chain = [m.bias for m in models], [m.earlier for m in models]

    def run(batches: Iterator) -> Iterator:
        import math

        import pyarrow as pa

        terms = _Terms(wanted)
        for batch in batches:
            rows = []
            for t in batch.column(batch.schema.get_field_index(text)).to_pylist():
                ids, odds = terms.of(t or ""), []
                for b, w, d in zip(bias, weights, chain, strict=True):
                    x = b + sum(w.get(i, 0.0) for i in sorted(ids)) + sum(p * q for p, q in zip(odds, d, strict=True))
                    odds.append(max(-30.0, min(30.0, x)))
                rows.append([1 / (1 + math.exp(-x)) for x in odds])
            more = [pa.array([r[i] for r in rows], pa.float64()) for i in range(len(bias))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *names])

    schema = T.StructType([*docs.schema.fields, *[T.StructField(x, T.DoubleType()) for x in names]])
    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, labels: DataFrame, categories: Sequence[str] = CHAIN, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, p_<category>...): one row for each row of docs. Null and empty texts
    are scored as texts without words; repeated rows give repeated rows, null keys
    stay null; an empty table gives none. Other columns are not read."""
    models = fit(docs, labels, categories, text=text, key=key)
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = _with_probabilities(own, models, [f"p_{i}" for i in range(len(models))], "text")
    return out.select(F.col("key").alias(key), *[F.col(f"p_{i}").alias(f"p_{c}") for i, c in enumerate(categories)])


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, categories: Sequence[str] = CHAIN, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs without those whose last category is at least as likely as threshold;
    the columns stay as they were, whatever their names. Rows are judged one by one
    by their text (null: empty), so repeated rows go or stay together and a null key
    makes no difference; an empty table gives an empty table."""
    models = fit(docs, labels, categories, text=text, key=key)
    names = fresh(docs, *[f"p_{c}" for c in categories])
    return _with_probabilities(docs, models, names, text).where(F.col(names[-1]) < threshold).drop(*names)
