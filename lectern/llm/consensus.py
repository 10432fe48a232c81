"""Consensus of several annotators (problem 6).

Method: competence-and-spamming mixture. A label is either truthful or drawn
from the annotator's personal guess distribution; expectation-maximisation
yields the posterior of every true label, each annotator's competence and
guesses. Competence of a dimension leans on the annotator's whole record.

Annotators that share their errors are not independent voices. The model keeps,
for every pair, how often they agree where both are wrong, beyond chance; on an
item each annotator's vote is divided by one plus the dependence on the others
present, so that a family of near copies counts about once.

The labels of an item sit in one row (as many as it has annotators); a round of
expectation-maximisation is one pass over these rows and moves only sums by
annotator, pair, dimension and label.

The state holds a number a pair of annotators: it is made for study teams and
panels of models, up to some two thousand of them (the sums of 2 000 are 100 MB),
whatever the number of items.

Defined results: codings that failed, have no item, annotator or labels are left
out; of several codings by the same annotator and seed the latest counts, of
those with the same time one. Missing single values are 0. An item with a
single annotator gets that one's posterior; its agreement is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage

THEMES = ("T1_integration", "T2_multimodal", "T3_privacy", "T4_integrity", "T5_disclosure", "T6_equity", "T7_vendor_governance", "T8_pedagogical_redesign")
USES = ("assessment", "research", "teaching", "administration")
DIMENSIONS = THEMES + USES
N_THEMES = len(THEMES)
#: Labels are -2..2, as places 0..4; themes use places 2 and 3.
PLACES = 5
#: The most rounds; they end when no competence moves by more than SETTLED.
ROUNDS, SETTLED = 40, 1e-2
CONSENSUS = "chunk_id string, dimension string, label int, p double, n_annotators int, agreement double"
RELIABILITY = "model_name string, dimension string, competence double, dependence double"


def latest_codings(coded: DataFrame) -> DataFrame:
    """The valid, latest coding of each item, annotator and seed: ``chunk_id``, ``model_name``, ``labels``.

    An annotator may have coded an item with two seeds; both count, each half.
    """
    value = lambda group, name: F.coalesce(F.col(f"{group}.{name}"), F.lit(0)).cast("tinyint")
    labels = F.array(*[value("themes", t) for t in THEMES], *[value("sentiment", u) for u in USES])
    rows = coded.where("ok and themes is not null and chunk_id is not null and model_name is not null").select("chunk_id", "model_name", F.coalesce("seed", F.lit(-1)).alias("seed"), F.struct(F.coalesce("timestamp_utc", F.lit("")).alias("at"), labels.alias("labels")).alias("coding"))
    return rows.groupBy("chunk_id", "model_name", "seed").agg(F.max("coding").alias("coding")).select("chunk_id", "model_name", F.col("coding.labels").alias("labels"))


def items(codings: DataFrame, names: list[str]) -> DataFrame:
    """One row an item: the places of its annotators and their labels, one after the other."""
    place = codings.sparkSession.createDataFrame(list(enumerate(names)), "who int, model_name string")
    rows = codings.join(place, "model_name")
    return rows.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("who", "labels"))).alias("codings")).select("chunk_id", F.col("codings.who").alias("who"), F.flatten("codings.labels").alias("labels"))


class Annotators:
    """The state of the mixture."""

    def __init__(self, n: int):
        self.n = n
        d = len(DIMENSIONS)
        self.competence = np.full((n, d), 0.7)
        self.guess = np.full((n, d, PLACES), 1 / PLACES)
        self.guess[:, :N_THEMES] = (0, 0, 0.5, 0.5, 0)
        self.prior = np.full((d, PLACES), 1 / PLACES)
        self.prior[:N_THEMES] = (0, 0, 0.5, 0.5, 0)
        self.dependence = np.zeros((n, n))

    def posterior(self, item: np.ndarray, who: np.ndarray, labels: np.ndarray, n_items: int) -> np.ndarray:
        """Of each item, dimension and label; item, who by coding, labels by coding and dimension."""
        d = labels.shape[1]
        dims = np.arange(d)
        c = self.competence[who]
        g = self.guess[who[:, None], dims, labels + 2]
        log = np.repeat(np.log((1 - c) * g + 1e-9)[:, :, None], PLACES, axis=2)
        k, j = np.meshgrid(np.arange(len(who)), dims, indexing="ij")
        log[k, j, labels + 2] = np.log(c + (1 - c) * g + 1e-9)
        log *= self.weights(item, who)[:, None, None]
        total = np.zeros((n_items, d, PLACES))
        np.add.at(total, item, log)
        total += np.log(self.prior + 1e-12)
        total -= total.max(axis=2, keepdims=True)
        p = np.exp(total)
        return p / p.sum(axis=2, keepdims=True)

    def weights(self, item: np.ndarray, who: np.ndarray) -> np.ndarray:
        """One over one plus the dependence on the item's other annotators; codings of an item are adjacent."""
        share = np.zeros(len(who))
        for shift in count(1):
            same = item[shift:] == item[:-shift]
            if not same.any():
                break
            dep = np.where(same, self.dependence[who[shift:], who[:-shift]], 0.0)
            share[shift:] += dep
            share[:-shift] += dep
        return 1 / (1 + share)

    def expect(self, item, who, labels, n_items) -> dict[str, np.ndarray]:
        """The sums one round needs."""
        p = self.posterior(item, who, labels, n_items)
        d = labels.shape[1]
        dims = np.arange(d)
        at = labels + 2
        right = p[item[:, None], dims, at]
        c = self.competence[who]
        g = self.guess[who[:, None], dims, at]
        truthful = right * c / (c + (1 - c) * g + 1e-12)
        out = {"truthful": np.zeros((self.n, d)), "of": np.zeros((self.n, d)), "guess": np.zeros((self.n, d, PLACES)), "prior": p.sum(axis=0), "both": np.zeros((self.n, self.n)), "agree": np.zeros((self.n, self.n)), "chance": np.zeros((self.n, self.n))}
        np.add.at(out["truthful"], who, truthful)
        np.add.at(out["of"], who, np.ones_like(truthful))
        for j in range(d):
            np.add.at(out["guess"][:, j], (who, at[:, j]), 1 - truthful[:, j])
        wrong = 1 - right
        for shift in count(1):
            k = np.flatnonzero(item[shift:] == item[:-shift])
            if not len(k):
                break
            a, b = who[k + shift], who[k]
            # sentiment only: two wrong labels of a theme always agree, which tells nothing of a common source
            both = wrong[k + shift] * wrong[k]
            same = (labels[k + shift] == labels[k]).astype(float)
            ga, gb = self.guess[a], self.guess[b]
            chance = (ga * gb).sum(axis=2)
            use = slice(N_THEMES, d)
            for x, y in ((a, b), (b, a)):
                np.add.at(out["both"], (x, y), both[:, use].sum(axis=1))
                np.add.at(out["agree"], (x, y), (both * same)[:, use].sum(axis=1))
                np.add.at(out["chance"], (x, y), (both * chance)[:, use].sum(axis=1))
        return out

    def update(self, s: dict[str, np.ndarray]) -> None:
        whole = (s["truthful"].sum(axis=1) + 1.0) / (s["of"].sum(axis=1) + 2.0)
        self.competence = np.clip((s["truthful"] + 10 * whole[:, None]) / (s["of"] + 10), 0.01, 0.995)
        smooth = np.full((len(DIMENSIONS), PLACES), 1.0)
        smooth[:N_THEMES] = (0, 0, 1.0, 1.0, 0)
        guess = s["guess"] + smooth
        self.guess = guess / guess.sum(axis=2, keepdims=True)
        prior = s["prior"] + smooth
        self.prior = prior / prior.sum(axis=1, keepdims=True)
        chance = s["chance"] / np.maximum(s["both"], 1e-9)
        agree = s["agree"] / np.maximum(s["both"], 1e-9)
        dep = np.clip((agree - chance) / np.maximum(1 - chance, 1e-3), 0, 1) * s["both"] / (s["both"] + 30.0)
        dep[dep < 0.15] = 0.0
        np.fill_diagonal(dep, 1.0)
        self.dependence = dep


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    who, labels = batch.column(1), batch.column(2)
    n = batch.num_rows
    counts = np.diff(who.offsets.to_numpy())
    w = who.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    x = labels.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, len(DIMENSIONS))
    x[:, :N_THEMES] = np.clip(x[:, :N_THEMES], 0, 1)
    return np.repeat(np.arange(n), counts), w, np.clip(x, -2, 2), n


def fit(rows: DataFrame, n: int, rounds: int = ROUNDS) -> Annotators:
    """The mixture fitted on the rows of ``items``; what reaches the driver is bounded by annotators and pairs."""
    state, sc = Annotators(n), rows.sparkSession.sparkContext
    for _ in range(rounds):
        sent = sc.broadcast(state)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[str, np.ndarray] = {}
            for batch in batches:
                for name, x in sent.value.expect(*_rows(batch)).items():
                    total[name] = total[name] + x if name in total else x
            for name, x in total.items():
                k = np.flatnonzero(x)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(k), pa.string()), pa.array(k, pa.int64()), pa.array(x.ravel()[k])], names=["name", "k", "v"])

        sums = {"truthful": np.zeros((n, 12)), "of": np.zeros((n, 12)), "guess": np.zeros((n, 12, PLACES)), "prior": np.zeros((12, PLACES)), "both": np.zeros((n, n)), "agree": np.zeros((n, n)), "chance": np.zeros((n, n))}
        for r in rows.mapInArrow(run, "name string, k bigint, v double").groupBy("name", "k").agg(F.sum("v").alias("v")).collect():
            sums[r["name"]].ravel()[r.k] = round(r.v, 9)
        before, voices = state.competence, state.dependence
        state.update(sums)
        if max(np.abs(state.competence - before).max(), np.abs(state.dependence - voices).max()) <= SETTLED:
            break
    return state


def infer(coded: DataFrame, least: int = 1, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Consensus and reliability.

    The first result has a row an item and dimension: ``chunk_id``,
    ``dimension``, ``label``, ``p``, ``n_annotators`` and ``agreement`` (the
    share of agreeing pairs of annotators), for items with at least ``least``
    annotators. The second has a row an annotator and dimension:
    ``model_name``, ``dimension``, ``competence``, ``dependence`` (the most on
    any other annotator).
    """
    spark = coded.sparkSession
    codings = latest_codings(coded)
    names = sorted(r.model_name for r in codings.select("model_name").distinct().collect())
    if not names:
        return spark.createDataFrame([], CONSENSUS), spark.createDataFrame([], RELIABILITY)
    rows = stage(items(codings, names), "consensus-items")
    state = fit(rows, len(names), rounds)
    sent = spark.sparkContext.broadcast(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item, who, labels, n = _rows(batch)
            if not n:
                continue
            p = sent.value.posterior(item, who, labels, n)
            voices = np.array([len(set(x)) for x in batch.column(1).to_pylist()])
            keep = np.flatnonzero(voices >= least)
            best = p.argmax(axis=2)
            counts = np.zeros((n, len(DIMENSIONS), PLACES))
            for j in range(len(DIMENSIONS)):
                np.add.at(counts[:, j], (item, labels[:, j] + 2), 1)
            m = counts.sum(axis=2)
            with np.errstate(divide="ignore", invalid="ignore"):
                agree = (counts * (counts - 1)).sum(axis=2) / (m * (m - 1))
            d = len(DIMENSIONS)
            agreement = agree[keep].ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(keep, d))), pa.array(list(DIMENSIONS) * len(keep), pa.string()), pa.array((best[keep] - 2).ravel().astype("int32")),
                    pa.array(np.take_along_axis(p, best[:, :, None], 2)[keep].ravel()), pa.array(np.repeat(voices[keep], d).astype("int32")), pa.array(agreement, mask=np.isnan(agreement)),
                ],
                names=["chunk_id", "dimension", "label", "p", "n_annotators", "agreement"],
            )

    consensus = rows.mapInArrow(run, CONSENSUS)
    off = state.dependence - np.eye(len(names))
    reliability = spark.createDataFrame(
        [(n, dim, float(state.competence[k, j]), float(off[k].max()) if len(names) > 1 else 0.0) for k, n in enumerate(names) for j, dim in enumerate(DIMENSIONS)],
        RELIABILITY,
    )
    return consensus, reliability
