"""Toxic passages by maximum-scoring segment search over token log-odds.

Weights: for each word, and for its prefixes of 3, 4 and 5 letters, the documents of each class
that hold it are counted. The share of the toxic class among them has a two-way Dirichlet prior
centred on the share of the next shorter prefix, and that of the shortest on the share of toxic
documents, so a rare or unseen word takes the weight of its stem. The weight is the log-odds of
the share against that of all documents. A constant is taken off each token; then ordinary text
drifts downwards and a passage has to earn its length.

Passages: one linear scan finds all maximal segments of positive sum, repeats of a word
included. Within a segment a word speaks once: its repeats are no new evidence there, and the
segments of positive sum that are left in it tell whether it is a passage.

Calibration: for text without passages the largest segment sum of n distinct tokens follows an
extreme value law, P(sum >= x) = 1 - exp(-K n exp(-lambda x)). lambda solves
sum p(s) exp(lambda s) = 1 over the token scores of clean documents, K follows from the number of
their segments. A passage's evidence is the sum, over the segments left in it, of
lambda x - ln(K n) where that is positive. A document's evidence is that of its passages,
strongest first, each by the share of its words' weight that those before it don't hold, so a
repeated text is worth as much as one copy; a logistic curve fitted on documents that the counts
have not seen maps it to 0..1.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlode.llm.common import durable, forget, free_name, small

#: Labelled rows that the model is fitted on, at most; every fifth of them calibrates.
FIT_ROWS = 20_000
PREFIXES = (3, 4, 5)
PRIOR_WEIGHT = 2.0
TOKEN_COST = 1.0
#: Features found in fewer fitted documents keep the weight of their stem.
LEAST_DOCS = 3
HISTOGRAM_STEP = 0.1
CACHE_WORDS = 150_000
#: Holds the logistic curve's parameters where the classes are separable.
RIDGE = 0.02
WORD = re.compile(r"\w+")


@dataclass
class Model:
    """counts: feature to (clean documents, toxic documents); share: of the toxic ones in all."""

    counts: dict[str, tuple[int, int]]
    share: float = 0.5
    rate: float = 1.0
    scale: float = 1.0
    slope: float = 1.0
    offset: float = -3.0


def features(word: str) -> list[str]:
    """Prefixes, shortest first, each marked by a trailing star, then the word."""
    return [f"{word[:size]}*" for size in PREFIXES if len(word) > size] + [word]


def word_score(word: str, model: Model) -> float:
    share = model.share
    for feature in features(word):
        clean, toxic = model.counts.get(feature, (0, 0))
        share = (toxic + PRIOR_WEIGHT * share) / (clean + toxic + PRIOR_WEIGHT)
    return _logit(share) - _logit(model.share) - TOKEN_COST


def _logit(share: float) -> float:
    return math.log(share / (1 - share))


class TokenScores(dict):
    """Score of each blank-separated token, that of its highest word; filled on demand."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, token):
        words = WORD.findall(token.lower())
        score = max((word_score(word, self.model) for word in words), default=-TOKEN_COST)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[token] = score
        return score

    def of(self, text: str | None) -> tuple[list[str], np.ndarray]:
        """A text's tokens and their scores."""
        tokens = (text or "").split()
        return tokens, np.array([self[token] for token in tokens], dtype=np.float64)


def once(tokens: list[str], scores: np.ndarray) -> np.ndarray:
    """Scores in which repeats of a word of positive score cost as much as any token."""
    scores, seen = scores.copy(), set()
    for at in np.flatnonzero(scores > 0).tolist():
        if tokens[at] in seen:
            scores[at] = -TOKEN_COST
        seen.add(tokens[at])
    return scores


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal segments (start, end, sum), in one scan.

    A segment waits on a stack with the sums before (low) and at its end (high) and a link to
    the nearest earlier one that starts lower. Each step either pushes or merges, so the work
    is linear.
    """
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    high = np.cumsum(scores)
    low = high - scores
    stack: list[tuple[int, int, float, float, int]] = []
    for at in up.tolist():
        start, bottom, top = at, float(low[at]), float(high[at])
        link = len(stack) - 1
        while True:
            while link >= 0 and stack[link][2] >= bottom:
                link = stack[link][4]
            if link < 0 or stack[link][3] >= top:
                break
            start, bottom = stack[link][0], stack[link][2]
            before = stack[link][4]
            del stack[link:]
            link = before
        stack.append((start, at + 1, bottom, top, link))
    return [(start, end, top - bottom) for start, end, bottom, top, _ in stack]


def passages(tokens: list[str], scores: np.ndarray, model: Model) -> list[tuple[int, int, float]]:
    """Significant segments: (first token, token after the last, evidence)."""
    if not len(scores):
        return []
    noise = math.log(model.scale * len(set(tokens)))
    found = []
    for a, b, total in segments(scores):
        if model.rate * total > noise:
            held = segments(once(tokens[a:b], scores[a:b]))
            found.append((a, b, sum(max(0.0, model.rate * x - noise) for _, _, x in held)))
    return [passage for passage in found if passage[2] > 0]


def document_evidence(tokens: list[str], scores: np.ndarray, found: list[tuple[int, int, float]]) -> float:
    """The passages' evidence, each by the share of its words' weight that is new."""
    total, seen = 0.0, set()
    for a, b, evidence in sorted(found, key=lambda passage: (-passage[2], passage[0])):
        weight = {tokens[at]: float(scores[at]) for at in range(a, b) if scores[at] > 0}
        new = [weight[token] for token in weight if token not in seen]
        total += evidence if len(new) == len(weight) else evidence * sum(new) / sum(weight.values())
        seen |= weight.keys()
    return total


def probability(evidence: float, model: Model) -> float:
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, model.slope * math.log1p(evidence) + model.offset))))


def fit_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic, part) of at most FIT_ROWS labelled documents, chosen by a hash of doc_id.

    Held-out documents are never among them. part 0 calibrates, the others are counted. A
    document labelled twice counts as toxic if one of its labels says so. The ids are broadcast;
    their number is bounded, so no text is shuffled.
    """
    doc_key = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = (
        labels.where("toxic is not null and doc_id is not null").where(doc_key % 5 != 0)
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
        .withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(5)).cast("int"))
    )
    return docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id").select(
        "text", "toxic", "part"
    )


def _count_features(rows: DataFrame) -> DataFrame:
    def run(batches):
        seen = (Counter(), Counter())
        for batch in small(batches):
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(WORD.findall((text or "").lower()))
                seen[toxic > 0].update({f for word in words for f in features(word)})
        for toxic in (0, 1):
            yield pa.RecordBatch.from_pydict({
                "feature": pa.array(list(seen[toxic].keys()), pa.string()),
                "clean": pa.array([0 if toxic else n for n in seen[toxic].values()], pa.int64()),
                "toxic": pa.array([n if toxic else 0 for n in seen[toxic].values()], pa.int64()),
            })

    parts = rows.where("part != 0").select("text", "toxic").mapInArrow(
        run, "feature string, clean long, toxic long"
    )
    return parts.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(
        F.col("clean") + F.col("toxic") >= LEAST_DOCS
    )


def _rate(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive lambda at which the mean of exp(lambda score) is 1, by bisection."""
    share = weights / weights.sum()
    if not (scores[weights > 0] > 0).any() or share @ scores >= 0:
        return 1.0
    least, most = 1e-6, 1.0
    while share @ np.exp(np.minimum(most * scores, 500.0)) < 1 and most < 64:
        most *= 2
    for _ in range(60):
        middle = (least + most) / 2
        if share @ np.exp(np.minimum(middle * scores, 500.0)) < 1:
            least = middle
        else:
            most = middle
    return least


def _logistic(evidence: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton steps; a small ridge keeps separable data finite."""
    if toxic.min() == toxic.max():
        return 1.0, -3.0
    x = np.stack([np.log1p(evidence), np.ones_like(evidence)], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        slope = x.T @ (toxic - p) - RIDGE * beta
        bend = (x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(2)
        step = np.linalg.solve(bend, slope)
        beta += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of labelled documents. Without labels every score is low.

    The sample, its features and its segments are bounded by FIT_ROWS, whatever the input.
    """
    rows = durable(fit_rows(docs, labels), "toxicity-fit")
    sizes = {toxic > 0: n for toxic, n in rows.where("part != 0").groupBy("toxic").count().collect()}
    share = (sizes.get(True, 0) + 0.5) / (sum(sizes.values()) + 1)
    model = Model({f: (clean, toxic) for f, clean, toxic in _count_features(rows).collect()}, share)
    if not sizes.get(True):
        forget(rows)
        return model
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        tokens = TokenScores(shared.value)
        for batch in small(batches):
            out = {"toxic": [], "n": [], "sums": [], "bins": [], "times": []}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, scores = tokens.of(text)
                bins, times = np.unique(
                    np.round(once(words, scores) / HISTOGRAM_STEP).astype(int), return_counts=True
                )
                out["toxic"].append(toxic)
                out["n"].append(len(set(words)))
                out["sums"].append([
                    x for a, b, _ in segments(scores) for _, _, x in segments(once(words[a:b], scores[a:b]))
                ])
                out["bins"].append(bins.tolist())
                out["times"].append(times.tolist())
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
                ("toxic", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.float64())),
                ("bins", pa.list_(pa.int32())), ("times", pa.list_(pa.int64())),
            ]))

    scanned = durable(rows.where("part = 0").select("text", "toxic").mapInArrow(
        run, "toxic int, n long, sums array<double>, bins array<int>, times array<long>"
    ), "toxicity-scan")
    histogram = scanned.where("toxic = 0").select(
        F.explode(F.arrays_zip("bins", "times")).alias("x")
    ).groupBy("x.bins").agg(F.sum("x.times").alias("times")).collect()
    documents = scanned.select("toxic", "n", "sums").collect()
    if histogram:
        scores = np.array([bin_ * HISTOGRAM_STEP for bin_, _ in histogram])
        model.rate = _rate(scores, np.array([float(times) for _, times in histogram]))
        clean = [(n, sums) for toxic, n, sums in documents if toxic == 0]
        total = max(sum(n for n, _ in clean), 1)
        sums = np.array([s for _, found in clean for s in found])
        floor = float(np.median(sums)) if len(sums) else 0.0
        model.scale = max((sums >= floor).sum(), 1) / total * math.exp(model.rate * floor)
    if documents:
        calibrated = rows.sparkSession.sparkContext.broadcast(model)

        def weigh(batches):
            tokens = TokenScores(calibrated.value)
            for batch in small(batches):
                read = [tokens.of(text) for text in batch.column(0).to_pylist()]
                evidence = [document_evidence(*one, passages(*one, calibrated.value)) for one in read]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1), pa.array(evidence, pa.float64())], ["toxic", "evidence"]
                )

        weighed = rows.where("part = 0").select("text", "toxic").mapInArrow(
            weigh, "toxic int, evidence double"
        ).collect()
        toxic, evidence = (np.array([float(row[at]) for row in weighed]) for at in (0, 1))
        model.slope, model.offset = _logistic(evidence, toxic)
    for used in (rows, scanned):
        forget(used)
    return model


def score(docs: DataFrame, model: Model, keep: list[str], only_clean: bool = False) -> DataFrame:
    """The columns named in keep, with score, predicted and passages (start, end, evidence).

    start and end count blank-separated tokens. A null or empty text has no passage and the
    lowest score. New columns whose names are taken get leading underscores. only_clean
    leaves out documents predicted toxic, and the new columns with them.
    """
    kept = docs.select(*keep)
    names = [free_name(kept, name) for name in ("score", "predicted", "passages")]
    passage = T.StructType([
        T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
        T.StructField("evidence", T.DoubleType()),
    ])
    added = [T.DoubleType(), T.IntegerType(), T.ArrayType(passage)]
    schema = T.StructType(kept.schema.fields + (
        [] if only_clean else [T.StructField(n, t) for n, t in zip(names, added)]
    ))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("evidence", pa.float64())]))

    def run(batches):
        fitted = shared.value
        tokens = TokenScores(fitted)
        for batch in small(batches):
            found, chance = [], []
            for text in batch.column(0).to_pylist():
                words, scores = tokens.of(text)
                found.append(passages(words, scores, fitted))
                chance.append(probability(document_evidence(words, scores, found[-1]), fitted))
            batch = batch.select(range(1, batch.num_columns))
            if only_clean:
                yield batch.filter(pa.array([p < 0.5 for p in chance]))
                continue
            spans = [[{"start": a, "end": b, "evidence": e} for a, b, e in s] for s in found]
            columns = [
                pa.array(chance, pa.float64()), pa.array([int(p >= 0.5) for p in chance], pa.int32()),
                pa.array(spans, span),
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *columns], [*batch.schema.names, *names]
            )

    text = free_name(kept, "scored_text")
    return docs.select(F.col("text").cast("string").alias(text), *keep).mapInArrow(run, schema)
