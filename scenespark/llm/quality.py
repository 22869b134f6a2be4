"""Quality classifier (9): cumulative-link (proportional odds) regression on graded ratings.

P(grade <= j) = logistic(threshold_j - score); one score of shared weights over hashed text features, and
ordered thresholds. That gives an expected grade and the probability of each grade or better, by which
documents are kept.

Features are the hashed words of a text, their first STEM bytes, its runs of symbols and a few shape
classes, each present or not.
The model is fitted on a bounded sample of labelled rows (`sample_rows`, those whose ids hash lowest): hashed
features whose frequency differs between grades beyond chance (`z_least` deviations) get a weight, by gradient
steps on the penalised likelihood. Every document is scored over its whole text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenespark.llm.common import free_name, lean, table, written

BINS = 1 << 20
STEM = 5
MEMO = 200_000
#: Bytes that part words (ASCII but digits and letters) become blanks; A-Z are folded before.
TO_WORDS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))
SYMBOLS = re.compile(rb"[!-/:-@\[-`{-~]{2,8}")


def _bin(feature: bytes) -> int:
    return xxhash.xxh64_intdigest(feature) % BINS


def _of_word(w: bytes) -> set[int]:
    return {_bin(b"w " + w), _bin(b"s " + w[:STEM])}


def parts(text: str | None) -> tuple[set[bytes], set[bytes]]:
    """Distinct words, and the other features: runs of symbols and classes of size and shape."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.lower().translate(TO_WORDS).split()
    distinct, lines = set(words), raw.split(b"\n")
    n, size = len(words), max(1, len(raw))
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = max(1, int(count[65:91].sum() + count[97:123].sum() + count[128:].sum()))
    marks = int(count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum())
    scale = n.bit_length()
    shape = {
        b"size %d" % scale,
        b"marks %d" % min(10, 25 * marks // size),
        b"upper %d" % (10 * int(count[65:91].sum()) // letters),
        b"digits %d" % (20 * int(count[48:58].sum()) // size),
        b"distinct %d %d" % (min(scale, 12), 10 * len(distinct) // max(1, n)),
        b"length %d" % min(20, letters // max(1, n)),
        b"lines %d" % (10 * len(set(lines)) // len(lines)),
        b"again %d" % (20 * sum(map(eq, words, words[1:])) // max(1, n)),
    }
    return distinct, shape | {b"mark " + m for m in set(SYMBOLS.findall(raw))}


def bins_of(text: str | None) -> list[int]:
    words, other = parts(text)
    return sorted({_bin(x) for x in other}.union(*map(_of_word, words)))


@dataclass(frozen=True)
class OrdinalModel:
    """weights of hashed features, and a threshold below each grade but the first."""

    weights: dict[int, float]
    thresholds: tuple[float, ...]

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """(rows, grades - 1): the probability of grade 1 or better, of 2 or better …"""
        return 1 / (1 + np.exp(np.clip(np.asarray(self.thresholds)[None, :] - score[:, None], -500, 500)))


class Scorer:
    """Scores texts; remembers the weights of words."""

    def __init__(self, model: OrdinalModel):
        self.model = model
        self.memo: dict[bytes, tuple[int, ...]] = {}

    def _word(self, w: bytes) -> tuple[int, ...]:
        if len(self.memo) > MEMO:
            self.memo.clear()
        got = self.memo[w] = tuple(b for b in _of_word(w) if b in self.model.weights)
        return got

    def score(self, text: str | None) -> float:
        words, other = parts(text)
        memo, weights = self.memo, self.model.weights
        hits = {b for w in words for b in (memo[w] if w in memo else self._word(w))}
        hits.update(b for b in map(_bin, other) if b in weights)
        return math.fsum(weights[b] for b in hits)


def telling(df: np.ndarray, below: list[np.ndarray], n: int, n_below: list[int], least_rows: int = 5) -> np.ndarray:
    """How far, in deviations, each feature's rows are from an even share of the grades below some grade. df: its
    rows; below: of them those below grade 1, 2 …; n and n_below: of all rows. 0 in under least_rows rows."""
    best = np.zeros(len(df))
    for k, low in zip(below, n_below):
        p = low / n
        with np.errstate(divide="ignore", invalid="ignore"):
            z = (np.abs(k - df * p) - 0.5) / np.sqrt(df * p * (1 - p) * (1 - df / n) + 1e-9)
        best = np.maximum(best, np.where((df >= least_rows) & (df < n), np.nan_to_num(z), 0))
    return best


def fit(grades: np.ndarray, bins: list[np.ndarray], n_grades: int, z_least: float = 5.0, penalty: float = 1e-4, steps: int = 400) -> OrdinalModel:
    """Maximum penalised likelihood. grades: 0 … n_grades - 1; bins: the distinct features of each row, of which
    those get a weight that `telling` puts at z_least or more."""
    n, sizes = len(grades), np.asarray([len(b) for b in bins])
    seen, flat = np.unique(np.concatenate([*bins, np.zeros(0, np.int64)]), return_inverse=True)
    row = np.repeat(np.arange(n, dtype=np.int32), sizes)
    df = np.bincount(flat, minlength=len(seen))
    below = [np.bincount(flat[(grades < j)[row]], minlength=len(seen)) for j in range(1, n_grades)]
    best = telling(df, below, n, [int((grades < j).sum()) for j in range(1, n_grades)])
    place = np.where(best >= z_least, np.cumsum(best >= z_least) - 1, -1)
    chosen, on = seen[best >= z_least], place[flat] >= 0
    row, col = row[on], place[flat[on]].astype(np.int32)
    share = (np.asarray([(grades < j).sum() for j in range(1, n_grades)]) + 0.5) / (n + 1)
    start = np.log(share / (1 - share))
    theta = np.concatenate([[start[0]], np.log(np.maximum(np.diff(start), 1e-3)), np.zeros(len(chosen))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    k = n_grades - 1
    for t in range(1, steps + 1):  # Adam on the whole sample, with falling steps
        cuts = np.concatenate([[theta[0]], theta[0] + np.cumsum(np.exp(theta[1:k]))])
        score = np.bincount(row, theta[k:][col], n)
        s = 1 / (1 + np.exp(np.clip(score[:, None] - cuts[None, :], -50, 50)))  # P(grade <= j)
        cum = np.column_stack([np.zeros(n), s, np.ones(n)])
        slope = cum * (1 - cum)
        hi, lo = np.arange(n), grades
        p = np.maximum(cum[hi, lo + 1] - cum[hi, lo], 1e-12)
        up, down = slope[hi, lo + 1] / p, slope[hi, lo] / p
        g_cut = np.zeros(k)
        for j in range(k):
            g_cut[j] = (down[grades == j + 1].sum() - up[grades == j].sum()) / n
        g_score = (up - down) / n
        g = np.concatenate([[g_cut.sum()], [np.exp(theta[i]) * g_cut[i:].sum() for i in range(1, k)], np.bincount(col, g_score[row], len(chosen)) + penalty * theta[k:]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= 0.1 * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    cuts = np.concatenate([[theta[0]], theta[0] + np.cumsum(np.exp(theta[1:k]))])
    return OrdinalModel({int(b): float(w) for b, w in zip(chosen, theta[k:])}, tuple(float(c) for c in cuts))


def graded(quality: Column, toxic: Column) -> Column:
    """Grade 0: toxic; 1: poor; 2: good; null: not rated."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when(quality == 1, 2)


def train(docs: DataFrame, ratings: DataFrame, n_grades: int = 3, sample_rows: int = 20_000, z_least: float = 5.0, doc_id: str = "doc_id", text: str = "text", **how) -> OrdinalModel | None:
    """Fits on documents of `ratings` (doc_id, grade). Rows without id or grade don't count; of several
    ratings of one document the lowest does. Null and empty texts have the features of their shape. None if fewer
    than two grades occur. Features are counted and chosen on the executors; the driver gets the counts (at most
    BINS) and, of each sampled row, the chosen features that it has."""
    rated = ratings.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade")).dropna().groupBy("doc_id").agg(F.min("grade").alias("grade"))
    sample = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.asarray(bins_of(t.as_py()), np.int32) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["grade", "bins"])

    # the sample is bounded by sample_rows, and so is what is broadcast
    got = written(texts.join(F.broadcast(sample), "doc_id").select("grade", "text").mapInArrow(lean(hash_texts), "grade int, bins array<int>"), "rated")
    of_grade = {r[0]: r[1] for r in got.groupBy("grade").count().collect()}
    if len(of_grade) < 2:
        return None
    n, cuts = sum(of_grade.values()), range(1, n_grades)
    counts = got.select("grade", F.explode("bins").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"), *(F.count_if(F.col("grade") < j).alias(f"below_{j}") for j in cuts))
    counts = counts.where("n >= 5").toArrow()  # see telling()
    column = lambda c: counts.column(c).to_numpy()
    best = telling(column("n"), [column(f"below_{j}") for j in cuts], n, [sum(c for g, c in of_grade.items() if g < j) for j in cuts])
    chosen = np.sort(column("bin")[best >= z_least])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [x.values.to_numpy() for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[np.isin(r, chosen, assume_unique=True)] for r in rows], pa.list_(pa.int32()))], names=["grade", "bins"])

    small = got.mapInArrow(pick, got.schema).toArrow()
    grades, bins = small.column("grade").to_numpy(), [x.values.to_numpy() for x in small.column("bins")]
    order = np.lexsort(([xxhash.xxh64_intdigest(b.tobytes()) for b in bins], grades))
    return fit(grades[order], [bins[i] for i in order], n_grades, z_least, **how)


def classify(df: DataFrame, model: OrdinalModel | None, least: float = 0.5, text: str = "text") -> DataFrame:
    """df with expected_grade, p_grade_1 … (the probability of that grade or better) and keep (that of the
    best grade is at least `least`).

    Null and empty texts are scored by their shape alone. Without a model (no ratings) grades are null and
    every row is kept. Repeated rows are scored alike; other columns stay, and a clashing one makes the new
    name end in an underscore.
    """
    k = len(model.thresholds) if model else 2
    new = [free_name(df, c) for c in ("expected_grade", *(f"p_grade_{j + 1}" for j in range(k)), "keep")]
    if model is None:
        return df.select("*", *(F.lit(None).cast("double").alias(c) for c in new[:-1]), F.lit(True).alias(new[-1]))
    at = df.columns.index(text)
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.DoubleType()) for c in new[:-1]), T.StructField(new[-1], T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            p = model.at_least(np.asarray([scorer.score(t.as_py()) for t in b.column(at)], float))
            cols = [p.sum(axis=1), *p.T, p[:, -1] >= least]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c) for c in cols)], names=schema.names)

    return df.mapInArrow(lean(run), schema)


def ratings(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", graded(F.col("quality"), F.col("toxic")).alias("grade"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, ratings(table(spark, sf_dir, "labels")))
    return classify(docs, model).drop("text")
