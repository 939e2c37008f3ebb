"""Language identification by error-correcting output codes.

Each language has a codeword of bits. Each bit has a binary classifier: the
mean log-odds, over a text's byte trigrams, of the languages whose bit is set against the others,
from trigram counts of all training rows. A text's outputs are compared with every codeword by a
loss in which a bit weighs as much as its classifier was right on that language's
training rows (a bounded sample); the nearest codeword is chosen. The text is
flagged as ambiguous where the two nearest are closer than `gap`.

Up to seven languages the code is exhaustive; beyond, it is the best of seeded random
codes.

Defined cases: a text that is null or has no letter is `und` with score 0, as is every text where
nothing was learned; rows with a null language train nothing; texts of any length are read whole, in pieces; of languages as near as each other the first in
alphabetical order is chosen; repeated rows and
null ids are kept; an empty table gives no rows; other columns are ignored (predictions) or kept (filtering), whatever their names.
The driver holds 32,768 counts for each language.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import give_back, split_no

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
#: Training rows, at most, on which the weights of bits are measured.
WEIGHT_ROWS = 3_000
UNKNOWN = "und"
CHUNK = 1 << 18
_KEPT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the byte trigrams of a text, lower-cased, signs as blanks, in bounded arrays."""
    raw = (" " + text + " ").encode("utf-8", "surrogatepass").translate(_KEPT)
    for at in range(0, len(raw) - 2, CHUNK):
        x = np.frombuffer(raw, dtype=np.uint8, count=min(CHUNK + 2, len(raw) - at), offset=at).astype(np.uint32)
        h = (x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]) * np.uint32(2654435761)
        yield h >> np.uint32(32 - BUCKET_BITS)


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """n rows of +1 and -1, all different. Two languages have a code of one bit, which corrects nothing; more bits are drawn where no draw will do."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        columns = [[1] + [1 if c >> i & 1 else -1 for i in range(n - 1)] for c in range((1 << (n - 1)) - 1)]
        return np.array(columns, dtype=float).T
    rng, bits, best, most = np.random.default_rng(seed), math.ceil(10 * math.log2(n)), None, 0
    while best is None:
        for _ in range(100):
            code = rng.choice([-1.0, 1.0], size=(n, bits))
            if (np.abs(code.sum(axis=0)) == n).any():
                continue
            apart = int(min((code[i] != code[i + 1 :]).sum(axis=1).min() for i in range(n - 1)))
            if apart > most:
                best, most = code, apart
        bits += bits // 2
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits: log-odds
    scale: np.ndarray  # of each bit: outputs are divided by it
    trust: np.ndarray  # languages x bits, rows sum to 1

    def outputs(self, text: str) -> np.ndarray:
        total, n = np.zeros(self.code.shape[1]), 0
        for idx in trigrams(text):
            total += self.weights[idx].sum(axis=0, dtype=np.float64)
            n += len(idx)
        return total / max(n, 1) / self.scale

    def distances(self, outputs: np.ndarray) -> np.ndarray:
        """Of each language: the weighted hinge loss of the outputs against its codeword."""
        return (self.trust * np.maximum(0.0, 1.0 - self.code * outputs)).sum(axis=1)

    def predict(self, text: str | None, gap: float = 0.1) -> tuple[str, float, bool]:
        """(language, score, ambiguous)."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, True
        d = self.distances(self.outputs(text))
        e = np.exp(-6.0 * (d - d.min()))
        order = np.argsort(d, kind="stable")
        close = len(d) > 1 and d[order[1]] - d[order[0]] < gap
        return self.languages[order[0]], float(e[order[0]] / e.sum()), bool(close)


def class_counts(train: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """Rows (lang, bucket, n) over all training rows; each task sends one row per language and bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                mine = counts.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                for idx in trigrams(text or ""):
                    mine += np.bincount(idx, minlength=BUCKETS)
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], ["lang", "bucket", "n"])

    return train.select(F.col(lang_col).cast("string"), text_col).mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(train: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> LanguageModel:
    train = train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    found = class_counts(train, lang_col, text_col).toPandas()
    languages = sorted(found["lang"].unique())
    if not languages:
        return LanguageModel([], np.ones((0, 1)), np.zeros((BUCKETS, 1), np.float32), np.ones(1), np.ones((0, 1)))
    share = np.full((len(languages), BUCKETS), 0.5)
    for i, lang in enumerate(languages):
        mine = found[found["lang"] == lang]
        share[i, mine["bucket"].to_numpy()] += mine["n"].to_numpy()
    share /= share.sum(axis=1, keepdims=True)
    code = codewords(len(languages))
    odds = np.zeros((BUCKETS, code.shape[1]))
    for j in range(code.shape[1]):
        on, off = code[:, j] > 0, code[:, j] < 0
        odds[:, j] = np.log(share[on].mean(axis=0)) - (np.log(share[off].mean(axis=0)) if off.any() else np.log(1 / BUCKETS))
    model = LanguageModel(languages, code, odds.astype(np.float32), np.ones(code.shape[1]), np.full(code.shape, 1 / code.shape[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [model.outputs(t).tolist() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float64()))], ["lang", "outputs"])

    # the rows of least hash, found by hash alone, so that no task gathers more texts than these
    keyed = train.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col), F.lit(9)).alias("turn"))
    least = keyed.select("turn").distinct().orderBy("turn").limit(WEIGHT_ROWS)
    some = keyed.join(F.broadcast(least), "turn").dropDuplicates(["turn"]).select("lang", "text").mapInArrow(run, "lang string, outputs array<double>").collect()
    outputs, langs = np.array([r["outputs"] for r in some]), np.array([r["lang"] for r in some])
    model.scale = np.maximum(np.median(np.abs(outputs), axis=0), 1e-6)
    for i, lang in enumerate(languages):
        mine = outputs[langs == lang]
        right = ((mine * code[i]) > 0).mean(axis=0) if len(mine) else np.ones(code.shape[1])
        model.trust[i] = np.maximum(right, 0.01) / np.maximum(right, 0.01).sum()
    return model


def train_rows(docs: DataFrame, id_col: str = "doc_id", parts: int = 3, held: int = 1) -> DataFrame:
    return docs.where(split_no(F.col(id_col), parts) != held)


def predictions(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score, ambiguous."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(zip(*map(model.predict, b.column(1).to_pylist()), strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.float64(), pa.bool_()), strict=True))], [id_col, "held_out", "lang_pred", "score", "ambiguous"])

    return docs.select(id_col, text_col, (split_no(F.col(id_col), 3) == 1).alias("held_out")).mapInArrow(run, f"{id_col} {id_type}, held_out boolean, lang_pred string, score double, ambiguous boolean")


def identify(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return predictions(docs, fit(train_rows(docs, id_col), lang_col, text_col, id_col), id_col, text_col)


def recognised(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", least: float = 0.0) -> DataFrame:
    """docs without those rejected: unknown language (no text, no letter), or a score below `least`. Columns stay."""
    model = fit(train_rows(docs, id_col), lang_col, text_col, id_col)
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = [model.predict(t) for t in b.column(at).to_pylist()]
            yield b.filter(pa.array([lang != UNKNOWN and score >= least for lang, score, _ in said], pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)
