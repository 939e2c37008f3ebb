"""Quality classifier: a linear support vector machine on n-grams scaled by naive Bayes ratios.

Features are indicators of a text's byte n-grams (three and four bytes, hashed). Over all labelled training rows each feature is counted in each class; the log-ratio of its
smoothed shares scales the indicator. A hinge-loss model over these, texts at unit length, is fitted by dual
coordinate descent on a bounded sample of labelled rows (`sample` of each class, by least hash of the id), of
which every fifth is kept back to turn decision values into probabilities.

Defined cases: null text counts as empty, and empty texts get a score; rows without a label or
with a null one train nothing; with one class only, or none, every score is that class's share
(0.5 without any); several labels of an id count as the least; texts of any length are read whole, in pieces; equal hashes in the
sample go by id, then text; a score of just 0.3 is predicted 1; repeated rows and null
ids are kept; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import split_no

BUCKETS = 1 << 16
#: The hashed n-grams, and a bias.
WIDTH = BUCKETS + 1
#: Labelled rows of each class, at most, that the hinge-loss model is fitted on.
SAMPLE = 3_000
CHUNK = 1 << 18


def features(text: str | None) -> np.ndarray:
    """Numbers of the features that a text has, ascending."""
    text = text or ""
    raw = (" " + text + " ").encode("utf-8", "surrogatepass")
    seen = np.zeros(WIDTH, dtype=bool)
    for at in range(0, max(1, len(raw) - 3), CHUNK):
        x = np.frombuffer(raw, dtype=np.uint8, count=min(CHUNK + 3, len(raw) - at), offset=at).astype(np.uint32)
        three = (x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]) if len(x) > 2 else np.zeros(0, np.uint32)
        seen[(three * np.uint32(2654435761)) >> np.uint32(16)] = True
        if len(x) > 3:
            seen[((three[:-1] << np.uint32(8) | x[3:]) * np.uint32(0x9E3779B1) ^ np.uint32(0x55555555)) >> np.uint32(16)] = True
    seen[BUCKETS] = True
    return np.flatnonzero(seen)


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: np.ndarray, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Weights of the model max(0, 1 - y w.x) with x the rows' ratios at unit length; cost: of each row."""
    w, alpha, rng = np.zeros(len(ratio)), np.zeros(len(rows)), np.random.default_rng(seed)
    values = []
    for idx in rows:
        v = ratio[idx]
        values.append(v / max(float(np.sqrt(v @ v)), 1e-9))
    norm = np.array([float(v @ v) for v in values])
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(rows)):
            if not norm[i]:
                continue
            idx, v = rows[i], values[i]
            slope = y[i] * float(w[idx] @ v) - 1.0
            new = min(max(alpha[i] - slope / norm[i], 0.0), cost[i])
            if step := new - alpha[i]:
                w[idx] += step * y[i] * v
                alpha[i] = new
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w


def calibrated(values: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """(slope, shift) of the logistic curve through decision values, by Newton steps with soft targets."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    goal = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * values + b, -30, 30)))
        g, s = p - goal, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(s * values * values).sum() + 1e-6, (s * values).sum()], [(s * values).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, np.array([(g * values).sum(), g.sum()]))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


@dataclass
class QualityModel:
    ratio: np.ndarray
    weights: np.ndarray
    slope: float
    shift: float

    def decision(self, idx: np.ndarray) -> float:
        v = self.ratio[idx]
        return float(self.weights[idx] @ v) / max(float(np.sqrt(v @ v)), 1e-9)

    def score(self, text: str | None) -> float:
        z = self.slope * self.decision(features(text)) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def feature_counts(rows: DataFrame) -> DataFrame:
    """rows (label, text): (label, feature, n); each task sends one row per label and feature at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, WIDTH), dtype=np.int64)
        for b in batches:
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts[label, features(text)] += 1
        for label in (0, 1):
            at = np.flatnonzero(counts[label])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.int32()), pa.array(at.astype(np.int32)), pa.array(counts[label, at])], ["label", "feature", "n"])

    return rows.mapInArrow(run, "label int, feature int, n long").groupBy("label", "feature").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> QualityModel:
    """Learns from all rows of docs that labels has; both must be training rows already."""
    marks = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # labels grow with the documents, so this is a shuffle at every size
    found = feature_counts(texts.join(marks.hint("merge"), "id").select("label", "text")).toPandas()
    n = np.zeros((2, WIDTH))
    n[found["label"], found["feature"]] = found["n"]
    have = n[:, BUCKETS]  # every row has the bias
    if not have.all():
        share = float(have[1] / have.sum()) if have.any() else 0.5
        return QualityModel(np.zeros(WIDTH), np.zeros(WIDTH), 0.0, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    smooth = n + 1.0
    ratio = np.log(smooth[1] / smooth[1].sum()) - np.log(smooth[0] / smooth[0].sum())
    ratio[BUCKETS] = 1.0

    turn = F.xxhash64("id", F.lit(4))
    picked = [marks.where(F.col("label") == k).orderBy(turn, "id").limit(2 * sample) for k in (0, 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([features(t).astype(np.int32) for t in b.column(2).to_pylist()], pa.list_(pa.int32()))], ["id", "label", "idx"])

    # at most 4 * sample labels are sent to all tasks; ids without a document drop out, so `sample` of each class remain at most
    rows = texts.join(F.broadcast(picked[0].unionByName(picked[1])), "id").withColumn("turn", turn)
    rows = [rows.where(F.col("label") == k).orderBy("turn", "id", "text").limit(sample).select("id", "label", "text") for k in (0, 1)]
    got = rows[0].unionByName(rows[1]).mapInArrow(run, "id string, label int, idx array<int>" if docs.schema[id_col].dataType.simpleString() == "string" else f"id {docs.schema[id_col].dataType.simpleString()}, label int, idx array<int>").toArrow()
    idx = [np.asarray(v.values) for v in got.column("idx")]
    y = np.where(got.column("label").to_numpy() == 1, 1.0, -1.0)
    order = np.random.default_rng(1).permutation(len(idx))
    back, used = order[::5], np.setdiff1d(order, order[::5])
    if len(set(y[used])) < 2 or len(set(y[back])) < 2:
        back = used = order
    cost = np.where(y[used] > 0, len(used) / (2 * max(1, (y[used] > 0).sum())), len(used) / (2 * max(1, (y[used] < 0).sum())))
    w = dual_coordinate_descent([idx[i] for i in used], y[used], ratio, cost)
    model = QualityModel(ratio, w, 1.0, 0.0)
    values = np.array([model.decision(idx[i]) for i in back])
    model.slope, model.shift = calibrated(values, y[back])
    # the sample's classes are as many as each other; the shift goes back to the shares of all labelled rows
    model.shift += float(np.log(have[1] / have[0]) - np.log(max(1, (y[back] > 0).sum()) / max(1, (y[back] < 0).sum())))
    return model


def scores(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.3) -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [model.score(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s, pa.float64()), pa.array([int(x >= cut) for x in s], pa.int32())], [id_col, "held_out", "score", "predicted"])

    return docs.select(id_col, text_col, (split_no(F.col(id_col), 5) == 0).alias("held_out")).mapInArrow(run, f"{id_col} {id_type}, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    keep = split_no(F.col(id_col), 5) != 0
    return scores(docs, fit(docs.where(keep), labels.where(keep), id_col=id_col, text_col=text_col), id_col, text_col)
