"""Consensus from several annotators' labels by a community confusion model.

Annotators belong to types; each type has one confusion matrix, and each annotator has its own around that of
its type. Item labels, type memberships, confusion matrices and class shares are inferred together by
variational updates. An annotator with few labels stays close to its type, one with many goes its own way.

Each round reads the votes once: a partition holds whole items, computes their label posteriors and returns
expected confusion counts of the annotators it met, which Spark sums up. Only those sums (annotators x classes x
classes) reach the driver. Beyond `max_annotators` the same rounds run with the annotators' parameters in a table
(module function fit_table): then only the types' matrices reach the driver, whatever the number of annotators.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.session import cut, ship


#: Rounds after which a fit that still moves is given up as not converged, and the movement that ends one.
MAX_ROUNDS = 200
TOLERANCE = 1e-4
#: Updates of the types in each round.
INNER_UPDATES = 3


def _digamma(x: np.ndarray) -> np.ndarray:
    """The digamma function for positive arguments: recurrence up to 6, then its asymptotic series."""
    x = np.array(x, dtype=float)
    shift = np.zeros_like(x)
    while (low := x < 6).any():
        shift[low] -= 1 / x[low]
        x[low] += 1
    inverse = 1 / x**2
    return shift + np.log(x) - 0.5 / x - inverse * (1 / 12 - inverse * (1 / 120 - inverse / 252))


def _expected_log(alpha: np.ndarray) -> np.ndarray:
    """E[log p] of Dirichlet distributions along the last axis."""
    return _digamma(alpha) - _digamma(alpha.sum(axis=-1, keepdims=True))


@dataclass
class CommunityModel:
    """What the rounds leave: per annotator the posterior of its type and of its confusion matrix."""

    shares: np.ndarray  # classes
    confusion: np.ndarray  # annotators x classes x classes, expected
    log_confusion: np.ndarray
    log_shares: np.ndarray
    types: np.ndarray  # annotators x types
    rounds: int
    converged: bool


def _update(counts: np.ndarray, types: np.ndarray, *, own_weight: float, strength: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One variational update of type matrices, memberships and annotators' Dirichlet parameters.

    `counts`: expected confusion counts of each annotator. A type's matrix is Dirichlet with a diagonal prior; an
    annotator's prior is its expected type matrix times `strength`.
    """
    classes = counts.shape[1]
    prior = np.full((classes, classes), own_weight) + np.eye(classes) * own_weight * 2
    of_type = prior + np.einsum("mt,mij->tij", types, counts)
    log_type = _expected_log(of_type)
    share = _expected_log(1.0 + types.sum(axis=0))
    score = share + np.einsum("mij,tij->mt", counts, log_type)
    score -= score.max(axis=1, keepdims=True)
    types = np.exp(score)
    types /= types.sum(axis=1, keepdims=True)
    mean_type = of_type / of_type.sum(axis=-1, keepdims=True)
    alpha = counts + strength * np.einsum("mt,tij->mij", types, mean_type)
    return types, alpha, of_type


def _posteriors(votes_m: np.ndarray, votes_v: np.ndarray, item: np.ndarray, items: int, log_confusion: np.ndarray, log_shares: np.ndarray) -> np.ndarray:
    score = np.tile(log_shares, (items, 1))
    np.add.at(score, item, log_confusion[votes_m, :, votes_v])
    score -= score.max(axis=1, keepdims=True)
    score = np.exp(score)
    return score / score.sum(axis=1, keepdims=True)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Annotators, labels and item positions of a batch whose `votes` are lists of annotator * 256 + label."""
    votes = batch.column(batch.schema.get_field_index("votes"))
    values = votes.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(votes.offsets.to_numpy(zero_copy_only=False))
    return values >> 8, values & 255, np.repeat(np.arange(batch.num_rows), lengths)


def fit(votes: DataFrame, annotators: int, classes: int, *, types: int = 4, max_rounds: int = MAX_ROUNDS, tolerance: float = TOLERANCE, own_weight: float = 1.0, strength: float = 10.0) -> CommunityModel:
    """The model of all `votes` (item, votes: annotator * 256 + label).

    Starts from shares of votes in each item. Ends when no expected share of a confusion matrix moves by more than
    `tolerance`; the model says whether that came about within `max_rounds`.
    """

    def counted(log_confusion: np.ndarray | None, log_shares: np.ndarray | None) -> np.ndarray:
        size = annotators * classes * classes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, shares = np.zeros(size), np.zeros(classes)
            for batch in batches:
                m, v, item = _flat(batch)
                if log_confusion is None:
                    q = np.full((batch.num_rows, classes), 1e-3)
                    np.add.at(q, (item, v), 1.0)
                    q /= q.sum(axis=1, keepdims=True)
                else:
                    q = _posteriors(m, v, item, batch.num_rows, log_confusion, log_shares)
                for c in range(classes):
                    total += np.bincount((m * classes + c) * classes + v, weights=q[item, c], minlength=size)
                shares += q.sum(axis=0)
            whole = np.concatenate([total, shares])
            met = np.flatnonzero(whole)  # of annotators that this partition has
            yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(whole[met])], names=["k", "x"])

        out = np.zeros(size + classes)
        for row in votes.select("votes").mapInArrow(run, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).collect():
            out[row["k"]] = row["x"]
        return out

    size = annotators * classes * classes
    whole = counted(None, None)
    counts, shares = whole[:size].reshape(annotators, classes, classes), whole[size:]
    # annotators begin in types by their agreement with the first consensus, in equal parts
    agreement = np.einsum("mii->m", counts) / np.maximum(counts.sum(axis=(1, 2)), 1e-9)
    rank = np.argsort(np.argsort(agreement, kind="stable"), kind="stable") * types // max(1, annotators)
    member = np.full((annotators, types), 0.1)
    member[np.arange(annotators), np.minimum(rank, types - 1)] = 1.0
    member /= member.sum(axis=1, keepdims=True)
    last, rounds = None, 0
    while True:
        rounds += 1
        for _ in range(INNER_UPDATES):
            member, alpha, _ = _update(counts, member, own_weight=own_weight, strength=strength)
        confusion = alpha / alpha.sum(axis=-1, keepdims=True)
        converged = last is not None and np.abs(confusion - last).max() < tolerance
        if converged or rounds == max_rounds:
            return CommunityModel((shares + 1) / (shares + 1).sum(), confusion, _expected_log(alpha), _expected_log(shares + 1), member, rounds, converged)
        last = confusion
        whole = counted(_expected_log(alpha), _expected_log(shares + 1))
        counts, shares = whole[:size].reshape(annotators, classes, classes), whole[size:]


@dataclass
class TableModel:
    """The same where annotators are too many for the driver: `annotators` has annotator, confusion, log_confusion (rows after one another) and member (shares of types)."""

    annotators: DataFrame
    shares: np.ndarray
    log_shares: np.ndarray
    rounds: int
    converged: bool


def _item_posteriors(votes: DataFrame, parameters: DataFrame | None, log_shares: np.ndarray | None, classes: int) -> DataFrame:
    """item and q0, q1, ... its posterior, from votes (item, annotator, code) and the annotators' log_confusion; from shares of votes without them."""
    if parameters is None:
        scores = votes.groupBy("item").agg(*[(F.sum(F.when(F.col("code") == c, 1.0).otherwise(0.0)) + 1e-3).alias(f"q{c}") for c in range(classes)])
    else:
        own = parameters.select(F.col("annotator").alias("_a"), "log_confusion")
        said = votes.join(own, F.col("annotator") == F.col("_a"))
        sums = said.groupBy("item").agg(*[F.sum(F.expr(f"log_confusion[{c * classes} + code]")).alias(f"q{c}") for c in range(classes)])
        scores = sums.select("item", *[(F.col(f"q{c}") + float(log_shares[c])).alias(f"q{c}") for c in range(classes)])
        top = F.greatest(*[F.col(f"q{c}") for c in range(classes)])
        scores = scores.withColumn("_top", top).select("item", *[F.exp(F.col(f"q{c}") - F.col("_top")).alias(f"q{c}") for c in range(classes)])
    total = sum((F.col(f"q{c}") for c in range(1, classes)), F.col("q0"))
    return scores.withColumn("_sum", total).select("item", *[(F.col(f"q{c}") / F.col("_sum")).alias(f"q{c}") for c in range(classes)])


def _cells(classes: int, value: str) -> Column:
    return F.array(*[F.sum(F.when(F.col("code") == v, F.col(f"{value}{c}")).otherwise(0.0)) for c in range(classes) for v in range(classes)])


def fit_table(votes: DataFrame, classes: int, *, types: int = 4, max_rounds: int = MAX_ROUNDS, tolerance: float = TOLERANCE, own_weight: float = 1.0, strength: float = 10.0) -> TableModel:
    """The model of all `votes` (item, annotator, code) with one row of parameters an annotator; two exchanges of the votes a round.

    The same updates as in `fit`, with the first types cut at quantiles of the agreement instead of at ranks.
    """
    prior = np.full((classes, classes), own_weight) + np.eye(classes) * own_weight * 2

    def expected_counts(parameters: DataFrame | None, log_shares: np.ndarray | None) -> tuple[DataFrame, np.ndarray]:
        posterior = cut(_item_posteriors(votes, parameters, log_shares, classes))
        shares = np.array(posterior.agg(*[F.sum(f"q{c}") for c in range(classes)]).first(), dtype=float)
        own = posterior.withColumnRenamed("item", "_i")
        return votes.join(own, F.col("item") == F.col("_i")).groupBy("annotator").agg(_cells(classes, "q").alias("counts")), shares

    def types_of(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Expected counts and weight of each type: types x classes x classes, types."""
        sums = [F.sum(F.expr(f"member[{t}] * counts[{k}]")) for t in range(types) for k in range(classes * classes)] + [F.sum(F.expr(f"member[{t}]")) for t in range(types)]
        whole = np.array(rows.agg(*sums).first(), dtype=float)
        return whole[: types * classes * classes].reshape(types, classes, classes), whole[types * classes * classes :]

    counts, shares = expected_counts(None, None)
    right = sum((F.expr(f"counts[{c * classes + c}]") for c in range(1, classes)), F.expr("counts[0]"))
    whole = sum((F.expr(f"counts[{k}]") for k in range(1, classes * classes)), F.expr("counts[0]"))
    state = cut(counts.withColumn("agreement", right / F.greatest(whole, F.lit(1e-9))))
    bounds = state.agg(F.percentile_approx("agreement", F.lit([k / types for k in range(1, types)]), F.lit(100_000))).first()[0] or []
    first = sum(((F.col("agreement") > float(b)).cast("int") for b in bounds), F.lit(0))
    share = lambda t: F.when(first == t, 1.0).otherwise(0.1) / (1.0 + 0.1 * (types - 1))
    state = state.select("annotator", "counts", F.array(*[share(t) for t in range(types)]).alias("member"), F.lit(None).cast("array<double>").alias("before"))
    rounds = 0
    while True:
        rounds += 1
        for step in range(INNER_UPDATES):
            sums, weights = types_of(state)
            of_type = prior + sums
            log_type, log_weight, mean_type = _expected_log(of_type), _expected_log(1.0 + weights), of_type / of_type.sum(axis=-1, keepdims=True)
            last_step = step == INNER_UPDATES - 1

            def update(batches: Iterator[pa.RecordBatch], log_type=log_type, log_weight=log_weight, mean_type=mean_type, last_step=last_step) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    own = np.array(batch.column("counts").to_pylist(), dtype=float).reshape(-1, classes, classes)
                    score = log_weight + np.einsum("mij,tij->mt", own, log_type)
                    score = np.exp(score - score.max(axis=1, keepdims=True))
                    member = score / score.sum(axis=1, keepdims=True)
                    alpha = own + strength * np.einsum("mt,tij->mij", member, mean_type)
                    confusion = alpha / alpha.sum(axis=-1, keepdims=True)
                    lists = lambda x: pa.array(x.reshape(len(x), -1).tolist(), pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("annotator"), batch.column("counts"), lists(member), batch.column("before"), lists(confusion), lists(_expected_log(alpha))],
                        names=["annotator", "counts", "member", "before", "confusion", "log_confusion"],
                    )

            state = state.select("annotator", "counts", "member", "before").mapInArrow(update, "annotator string, counts array<double>, member array<double>, before array<double>, confusion array<double>, log_confusion array<double>")
        state = cut(state)
        moved = state.agg(F.max(F.expr("array_max(zip_with(confusion, before, (a, b) -> abs(a - b)))"))).first()[0]
        converged = rounds > 1 and moved is not None and moved < tolerance
        log_shares = _expected_log(shares + 1)
        if converged or rounds == max_rounds:
            return TableModel(state.select("annotator", "confusion", "log_confusion", "member"), (shares + 1) / (shares + 1).sum(), log_shares, rounds, converged)
        counts, shares = expected_counts(state, log_shares)
        known = state.select(F.col("annotator").alias("_a"), "member", F.col("confusion").alias("before"))
        state = cut(counts.join(known, F.col("annotator") == F.col("_a")).select("annotator", "counts", "member", "before"))


@dataclass
class Consensus:
    """items: item, label, support, agreement, voters. annotators: annotator, reliability, kind, labels. Whether the model came to rest, and in how many rounds."""

    items: DataFrame
    annotators: DataFrame
    converged: bool = True
    rounds: int = 0


def consensus(opinions: DataFrame, labels: list[str], *, max_annotators: int = 10_000, **options) -> Consensus:
    """Consensus of `opinions` (item, annotator, label, at, tie), for every item with a readable opinion.

    An opinion counts if item, annotator and label are not null and the label is one of `labels`; of an annotator's
    opinions on an item only that with the greatest (at, tie) does. All such opinions shape the model. support is
    the posterior of the label; equal posteriors give the label that comes first in `labels`. agreement is the
    share of pairs of voters with the same label, null for one voter. reliability is the chance that the
    annotator's label is right, averaged over the class shares. No readable opinion gives two empty tables. More than
    `max_annotators` are kept in a table instead of on the driver. A model that does not come to rest is an error.
    """
    spark = opinions.sparkSession
    ship(spark)
    readable = opinions.where(F.col("item").isNotNull() & F.col("annotator").isNotNull() & F.col("label").isin(labels))
    newest = readable.groupBy("item", "annotator").agg(F.max(F.struct("at", "tie", "label"))["label"].alias("label"))
    per_annotator = newest.groupBy("annotator").agg(F.count(F.lit(1)).alias("labels"))
    listed = per_annotator.limit(max_annotators + 1).collect()
    if len(listed) > max_annotators:
        return _consensus_by_table(newest, per_annotator, labels, **options)
    names = sorted(r["annotator"] for r in listed)
    given = {r["annotator"]: r["labels"] for r in listed}
    item_schema = "item string, label string, support double, agreement double, voters int"
    if not names:
        return Consensus(spark.createDataFrame([], item_schema), spark.createDataFrame([], "annotator string, reliability double, kind int, labels long"))
    number = spark.createDataFrame([(name, i) for i, name in enumerate(names)], "a_name string, a_no int")
    code = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label")).cast("int") - 1
    votes = newest.join(F.broadcast(number), F.col("annotator") == F.col("a_name")).groupBy("item").agg(F.array_sort(F.collect_list(F.col("a_no") * 256 + code)).alias("votes"))
    votes = cut(votes)
    model = fit(votes, len(names), len(labels), **options)
    _settled(model)
    log_confusion, log_shares = model.log_confusion, model.log_shares

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, v, item = _flat(batch)
            q = _posteriors(m, v, item, batch.num_rows, log_confusion, log_shares)
            best = (q > q.max(axis=1, keepdims=True) - 1e-12).argmax(axis=1)
            votes_of = np.zeros((batch.num_rows, len(labels)))
            np.add.at(votes_of, (item, v), 1)
            n = votes_of.sum(axis=1)
            agree = np.divide((votes_of * (votes_of - 1)).sum(axis=1), n * (n - 1), out=np.full(len(n), np.nan), where=n > 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([labels[i] for i in best]), pa.array(q[np.arange(len(best)), best]), pa.array(agree, mask=n < 2), pa.array(n.astype("int32"))],
                names=["item", "label", "support", "agreement", "voters"],
            )

    items = votes.select("item", "votes").mapInArrow(decide, item_schema)
    reliability = np.einsum("c,mcc->m", model.shares, model.confusion)
    rows = [(name, float(reliability[i]), int(model.types[i].argmax()), int(given[name])) for i, name in enumerate(names)]
    return Consensus(items, spark.createDataFrame(rows, "annotator string, reliability double, kind int, labels long"), model.converged, model.rounds)


def _settled(model: CommunityModel | TableModel) -> None:
    if not model.converged:
        raise RuntimeError(f"the consensus model still moves after {model.rounds} rounds; raise max_rounds or tolerance")


def _consensus_by_table(newest: DataFrame, per_annotator: DataFrame, labels: list[str], **options) -> Consensus:
    """`consensus` of `newest` (item, annotator, label) for any number of annotators."""
    classes = len(labels)
    code = (F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label")) - 1).cast("int")
    votes = cut(newest.select("item", "annotator", code.alias("code")))
    model = fit_table(votes, classes, **options)
    _settled(model)
    posterior = _item_posteriors(votes, model.annotators, model.log_shares, classes)
    top = F.greatest(*[F.col(f"q{c}") for c in range(classes)])
    label = F.coalesce(*[F.when(F.col(f"q{c}") > F.col("_top") - 1e-12, F.lit(labels[c])) for c in range(classes)])
    of_item = votes.groupBy(F.col("item").alias("_i")).agg(F.count(F.lit(1)).cast("int").alias("voters"), *[F.sum((F.col("code") == c).cast("long")).alias(f"n{c}") for c in range(classes)])
    pairs = sum((F.col(f"n{c}") * (F.col(f"n{c}") - 1) for c in range(1, classes)), F.col("n0") * (F.col("n0") - 1))
    items = (
        posterior.withColumn("_top", top)
        .join(of_item, F.col("item") == F.col("_i"))
        .select("item", label.alias("label"), F.col("_top").alias("support"), F.when(F.col("voters") > 1, pairs / (F.col("voters").cast("long") * (F.col("voters") - 1))).alias("agreement"), "voters")
    )
    right = sum((F.expr(f"confusion[{c * classes + c}]") * float(model.shares[c]) for c in range(1, classes)), F.expr("confusion[0]") * float(model.shares[0]))
    given = per_annotator.withColumnRenamed("annotator", "_g")
    annotators = model.annotators.join(given, F.col("annotator") == F.col("_g")).select("annotator", right.alias("reliability"), F.expr("cast(array_position(member, array_max(member)) - 1 as int)").alias("kind"), "labels")
    return Consensus(items, annotators, model.converged, model.rounds)
