"""Toxicity categories by a classifier chain.

Categories are predicted one after the other. Each has a linear model (logistic regression with an L1
penalty) over words and word beginnings, and over the probabilities of the categories before it. In
training those come from out-of-fold predictions: every row is scored by models that have not seen
it, so a later model learns how far the earlier ones can be trusted.

The last category decides: its model is fed by the probabilities of all the others, and its limit is the
one that does best for its own out-of-fold predictions.

Models are fitted on a sample of labelled rows, chosen by hash, of at most about ``MOST_ROWS`` rows and
``MOST_ENTRIES`` features. Tokens are counted by category and fold in Spark, which also chooses the
strongest of each model; only these, as small numbers, come to the driver: a fit takes a few hundred steps
over them, each of which would be a job of its own on the cluster. Every document is scored, in the tasks
that read it.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.llm.common import free_unused, ship, whole_text
from labelloom.staging import stage

#: Order of the chain, the last of which decides. All come from the two flags of the label table.
CATEGORIES = ("toxic_prose", "toxic_junk", "toxic")
#: Bounds: labelled rows used, rows a feature must be in, features of one model, and features of all rows together.
MOST_ROWS, LEAST_ROWS, MOST_FEATURES, MOST_ENTRIES = 20_000, 4, 400, 4_000_000
#: Letters of a word's beginning that is a feature of its own, for words at least one longer.
BEGINNINGS = (4, 5)
FOLDS, PENALTY, STEPS = 3, 0.0001, 400
#: Bounds of the probability from which a text is toxic, and its value where there are no out-of-fold predictions.
LIMITS, LIMIT = (0.1, 0.5), 0.5

_find_words = re.compile(r"[^\W_]+").findall


def tokens(text: str) -> set[str]:
    """Distinct lower-cased words and beginnings of words, marked as such."""
    words = set(_find_words(text.lower()))
    return words.union(*({w[:n] + "-" for w in words if len(w) > n} for n in BEGINNINGS))


def labelled(labels: DataFrame) -> DataFrame:
    """``_id`` and one 0/1 column per category. Rows with a null id or flag are left out."""
    toxic, good = F.col("toxic") == 1, F.col("quality") == 1
    flags = {"toxic": toxic, "toxic_prose": toxic & good, "toxic_junk": toxic & ~good}
    rows = labels.select(F.col("doc_id").alias("_id"), *[flags[c].cast("double").alias(c) for c in CATEGORIES])
    return rows.dropna()


class Rows:
    """Which features each of some rows has: feature numbers one row after the other, and where rows begin."""

    def __init__(self, features: np.ndarray, sizes: np.ndarray, n: int) -> None:
        self.features, self.sizes, self.n = features, sizes, n
        self.row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)

    def take(self, keep: np.ndarray) -> Rows:
        inside = keep[self.row]
        return Rows(self.features[inside], self.sizes[keep], self.n)

    def only(self, wanted: np.ndarray) -> Rows:
        """The rows with these features alone, numbered anew."""
        number = np.full(self.n, -1, np.int32)
        number[wanted] = np.arange(len(wanted))
        inside = number[self.features] >= 0
        return Rows(number[self.features[inside]], np.bincount(self.row[inside], minlength=len(self.sizes)), len(wanted))

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.features], len(self.sizes))

    def summed(self, values: np.ndarray) -> np.ndarray:
        """By feature: the sum of the values of rows that have it."""
        return np.bincount(self.features, values[self.row], self.n)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


class Model:
    """Weights of features and of the categories before, and an intercept."""

    def __init__(self, rows: Rows, before: np.ndarray, target: np.ndarray, chosen: np.ndarray) -> None:
        """Fit by accelerated proximal gradient steps on the chosen features."""
        n, self.chosen = len(target), chosen
        inner = rows.only(self.chosen)
        k = before.shape[1]
        weights = np.zeros(len(self.chosen) + k + 1)
        ahead, pace = weights.copy(), 1.0
        width = 4 / (inner.sizes.max(initial=0) + k + 1)  # a step that cannot overshoot
        for _ in range(STEPS):
            off = _sigmoid(inner.times(ahead[: len(self.chosen)]) + before @ ahead[len(self.chosen) : -1] + ahead[-1]) - target
            slope = np.concatenate([inner.summed(off), before.T @ off, [off.sum()]]) / n
            new = ahead - width * slope
            cut = width * PENALTY
            new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - cut, 0)
            faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
            ahead, weights, pace = new + (pace - 1) / faster * (new - weights), new, faster
        self.weights, self.before, self.intercept = weights[: len(self.chosen)], weights[len(self.chosen) : -1], weights[-1]

    def probability(self, rows: Rows, before: np.ndarray) -> np.ndarray:
        whole = np.zeros(rows.n)
        whole[self.chosen] = self.weights
        return _sigmoid(rows.times(whole) + before @ self.before + self.intercept)


def best_limit(scores: np.ndarray, target: np.ndarray) -> float:
    """The probability with the best F1 for calling rows positive, midway to the next score below, within ``LIMITS``."""
    order = np.argsort(-scores, kind="stable")
    ranked, right = scores[order], np.cumsum(target[order])
    f1 = 2 * right / (np.arange(1, len(target) + 1) + target.sum())
    f1[:-1][ranked[:-1] == ranked[1:]] = 0  # equal scores are not told apart
    at = int(np.argmax(f1))
    below = ranked[at + 1] if at + 1 < len(ranked) else 0.0
    return float(np.clip((ranked[at] + below) / 2, *LIMITS))


#: Features of the model of each category, by number, and of the models that leave one fold out.
Chosen = dict[tuple[int, int | None], np.ndarray]


def fit_chain(rows: Rows, targets: np.ndarray, fold: np.ndarray, chosen: Chosen) -> tuple[list[Model], float]:
    """A model per column of ``targets``, and the limit for the last. Rows of each fold are scored by a model of the others,
    for the columns after and for the limit.

    Where all rows are in one fold, there is nothing outside it and the full model scores them.
    """
    models, before = [], np.zeros((len(targets), 0))
    folds = np.unique(fold)
    for i in range(targets.shape[1]):
        models.append(Model(rows, before, targets[:, i], chosen[i, None]))
        scores = models[-1].probability(rows, before)
        for k in folds if len(folds) > 1 else ():
            inside = fold == k
            part = Model(rows.take(~inside), before[~inside], targets[~inside, i], chosen[i, int(k)])
            scores[inside] = part.probability(rows.take(inside), before[inside])
        before = np.column_stack([before, scores])
    return models, best_limit(before[:, -1], targets[:, -1]) if len(folds) > 1 else LIMIT


class Chain:
    """Fitted models by category: weights by token, weights of earlier categories, intercepts."""

    def __init__(self, models: Sequence[Model], vocabulary: Sequence[str], limit: float = LIMIT) -> None:
        self.limit = limit
        self.before = [m.before for m in models]
        self.intercepts = [m.intercept for m in models]
        self.weights: dict[str, np.ndarray] = {}
        for i, model in enumerate(models):
            for feature, weight in zip(model.chosen.tolist(), model.weights.tolist()):
                if weight:
                    self.weights.setdefault(vocabulary[feature], np.zeros(len(models)))[i] = weight

    def probabilities(self, text: str) -> list[float]:
        known = self.weights
        total = sum((known[t] for t in sorted(tokens(text).intersection(known))), np.zeros(len(self.before)))
        out: list[float] = []
        for i, before in enumerate(self.before):
            out.append(float(_sigmoid(total[i] + before @ np.array(out) + self.intercepts[i])))
        return out


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, id_col: str = "doc_id", text: str = "text") -> Chain | None:
    """Fit a chain on about ``most_rows`` labelled documents at most; None if there are none, or only of one kind."""
    flags = labelled(labels)
    share = min(1.0, most_rows / max(flags.count(), 1))
    # as many rows as the bound allows, so small enough to send to every task that reads documents
    chosen = flags.filter(F.pmod(F.xxhash64("_id"), F.lit(10**12)) < int(share * 10**12))
    texts = docs.select(docs[id_col].alias("_doc"), whole_text(docs, text).alias("_text"))
    rows = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))

    def listed(texts: pa.Array) -> pa.Array:
        out = pa.array([sorted(tokens(t.as_py())) for t in texts], pa.list_(pa.string()))
        free_unused()
        return out

    split = F.arrow_udf(listed, T.ArrayType(T.StringType()))
    fold = F.pmod(F.xxhash64("_id", F.lit("fold")), F.lit(FOLDS))
    rows = rows.select("_id", *CATEGORIES, fold.cast("int").alias("fold"), split("_text").alias("tokens"))
    rows = stage(rows.withColumn("_row", F.monotonically_increasing_id()), "training")
    kinds = rows.agg(F.min(CATEGORIES[-1]), F.max(CATEGORIES[-1])).first()
    if kinds[0] != 0 or kinds[1] != 1:
        return None
    return _fitted(rows)


def _strongest(rows: DataFrame) -> DataFrame:
    """``model, fold, t``: the tokens that tell most about the category of each model, that is how far the number of rows
    with token and category is from what their shares let expect. ``fold`` is the one left out, null for none."""
    totals = rows.groupBy("fold").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in CATEGORIES]).collect()  # FOLDS rows
    folds = sorted(r["fold"] for r in totals)
    each = [F.count_if(F.col("fold") == k).alias(f"n{k}") for k in folds]
    each += [F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}") for k in folds for c in CATEGORIES]
    tokens = rows.select("fold", *CATEGORIES, F.explode("tokens").alias("t")).groupBy("t").agg(*each)
    tokens = stage(tokens.filter(sum((F.col(f"n{k}") for k in folds), F.lit(0)) >= LEAST_ROWS), "token-counts")
    parts = []
    for i, category in enumerate(CATEGORIES):
        for out in [None, *(folds if len(folds) > 1 else [])]:
            used = [k for k in folds if k != out]
            n, positive = (sum(r[x] for r in totals if r["fold"] in used) for x in ("n", category))
            there, both = (sum((F.col(f"{x}{k}") for k in used), F.lit(0.0)) for x in ("n", category))
            expected = there * (positive / n)
            strength = F.pow(both - expected, F.lit(2)) / (expected * (1 - positive / n) + 1)
            best = tokens.orderBy(F.desc(strength), "t").limit(MOST_FEATURES)
            parts.append(best.select(F.lit(i).alias("model"), F.lit(out).cast("int").alias("fold"), "t"))
    return reduce(DataFrame.unionAll, parts)


def _numbers(tokens: str, vocabulary: Sequence[str]) -> Column:
    """The numbers of those tokens of each row that the vocabulary has, a list as the tokens are: a row stays one row."""

    def found(lists: pa.Array) -> pa.Array:
        flat = pc.list_flatten(lists)
        at = pc.index_in(flat, pa.array(vocabulary, flat.type))
        sizes = np.bincount(pc.list_parent_indices(lists).filter(at.is_valid()).to_numpy(), minlength=len(lists))
        out = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), at.drop_null())
        free_unused()
        return out

    return F.arrow_udf(found, T.ArrayType(T.IntegerType()))(tokens)


def _fitted(rows: DataFrame) -> Chain:
    """A chain fitted in the driver on the chosen features of the staged rows."""
    strongest = _strongest(rows).collect()  # MOST_FEATURES rows for each of a few models
    vocabulary = sorted({r["t"] for r in strongest})
    number = {t: i for i, t in enumerate(vocabulary)}
    chosen: dict[tuple[int, int | None], list[int]] = {}
    for r in strongest:
        chosen.setdefault((r["model"], r["fold"]), []).append(number[r["t"]])
    found = stage(rows.withColumn("f", _numbers("tokens", vocabulary)).drop("tokens"), "features")
    share = min(1.0, MOST_ENTRIES / max(found.agg(F.sum(F.size("f"))).first()[0] or 0, 1))
    if share < 1:
        found = found.filter(F.pmod(F.xxhash64("_id", F.lit("entries")), F.lit(10**12)) < int(share * 10**12))
    table = found.toArrow().combine_chunks().sort_by([("_id", "ascending"), ("_row", "ascending")])
    lists = table.column("f").combine_chunks()
    sizes = np.asarray(lists.value_lengths())
    coded = Rows(lists.flatten().to_numpy().astype(np.int32), sizes, len(vocabulary))
    targets, fold = np.column_stack([table.column(c).to_numpy() for c in CATEGORIES]), table.column("fold").to_numpy()
    del table, lists
    models, limit = fit_chain(coded, targets, fold, {k: np.sort(np.array(v, np.int32)) for k, v in chosen.items()})
    return Chain(models, vocabulary, limit)


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``_toxicity``: a probability per category and ``toxic``, whether that of the
    last category reaches the limit that does best for the out-of-fold predictions.

    Null and empty texts are scored as texts without words. Repeated rows get equal scores; repeated label rows count
    as often as they occur, and labels of unknown documents are ignored. Without labelled documents of both kinds there
    is nothing to learn: probabilities are null and nothing is toxic. An existing ``_toxicity`` is replaced, other columns
    are kept whatever their names. An empty table stays empty.
    """
    ship(docs.sparkSession)
    chain = train(docs, labels, id_col=id_col, text=text)
    own = [F.col(c) for c in docs.columns if c != "_toxicity"]
    names = [f"p_{c}" for c in CATEGORIES]
    if chain is None:
        p = F.struct(*[F.lit(None).cast("double").alias(n) for n in names])
    else:

        def run(texts: pa.Array) -> pa.Array:
            out = np.array([chain.probabilities(t.as_py()) for t in texts]).reshape(len(texts), len(names))
            free_unused()
            return pa.StructArray.from_arrays([pa.array(column) for column in out.T], names=names)

        p = F.arrow_udf(run, T.StructType([T.StructField(n, T.DoubleType()) for n in names]))(whole_text(docs, text))
    rows = docs.select(*own, p.alias("_toxicity"))
    toxic = F.coalesce(F.col("_toxicity")[names[-1]] >= (chain.limit if chain else LIMIT), F.lit(False))
    return rows.withColumn("_toxicity", F.struct(*[F.col("_toxicity")[n].alias(n) for n in names], toxic.alias("toxic")))
