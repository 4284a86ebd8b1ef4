"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A document has one score, the sum of hashed-text weights over its distinct features, shared by all grades. Ordered
thresholds cut the score: P(grade <= k) = logistic(threshold[k] - score). The expected grade and the tail probability
P(grade >= k) follow and drive selection. Grades from the labels: 0 toxic, 1 not toxic but of low quality, 2 good.

The model is fitted on at most SAMPLE labelled rows, chosen by a hash of their id within each grade and weighted back to
the grades' true shares; it has 2**BUCKET_BITS weights whatever the corpus, so it is small enough to send to every task.
Scoring is one narrow pass over whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, strings

GRADES = 3
#: Bound of the labelled sample that the model is fitted on.
SAMPLE = 7500
BUCKET_BITS = 18
STEPS = 300
LEARNING_RATE = 0.15
#: Weight below which the penalty holds a feature at zero.
PENALTY = 2e-4
#: A document is kept if the probability of the top grade is at least this.
KEEP_TAIL = 0.5
MEMO_ENTRIES = 150_000
_EDGE = "\"'.,;:!?()[]{}<>*&%$#@|~^=+-_/\\`“”‘’«»…"


def _share(part: float, whole: float) -> int:
    """Level from 0 to 10 of a share."""
    return round(10 * part / whole) if whole else 0


class Features:
    """Distinct hashed features of a text: words without their edges, runs of symbols, and a few shares in levels."""

    def __init__(self, bits: int = BUCKET_BITS):
        self.mask = (1 << bits) - 1
        self.known: dict[str, tuple[int, ...]] = {}

    def bucket(self, name: str) -> int:
        return xxhash.xxh32_intdigest(name) & self.mask

    def _word(self, word: str) -> tuple[int, ...]:
        low = word.lower()
        core = low.strip(_EDGE)
        found = [self.bucket("w:" + core)] if core else []
        tail = low[len(low.rstrip(_EDGE)) :] if core else low
        if len(tail) > 1 or not core:
            found.append(self.bucket("s:" + tail[:4]))
        return tuple(found)

    def __call__(self, text: str) -> np.ndarray:
        words = text.split()
        known, n = self.known, len(words)
        distinct = set(words)
        if len(known) + len(distinct) > MEMO_ENTRIES:
            known.clear()
        found: set[int] = set()
        for w in distinct:
            ids = known.get(w)
            if ids is None:
                ids = self._word(w)
                if len(w) < 60:
                    known[w] = ids
            found.update(ids)
        again = sum(map(str.__eq__, words, words[1:]))
        symbols = n - sum(map(str.isalpha, words))
        shares = {
            "repeat": _share(again, n), "pipe": _share(words.count("|"), n), "symbol": _share(symbols, n),
            "distinct": _share(len(distinct), n), "size": len(text).bit_length(), "word": min(len(text) // n, 40) if n else 0,
            "upper": _share(sum(map(str.isupper, words)), n), "digit": _share(sum(map(str.isdigit, words)), n),
        }
        found.update(self.bucket(f"{k}={v}") for k, v in shares.items())
        return np.fromiter(found, np.int32, len(found))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray  # rising

    def below(self, scores: np.ndarray) -> np.ndarray:
        """P(grade <= k) for each k but the last."""
        return 1 / (1 + np.exp(np.clip(scores[:, None] - self.thresholds[None, :], -500, 500)))

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1."""
        return 1 - self.below(scores)


def fit(rows: np.ndarray, cols: np.ndarray, grades: np.ndarray, weight: np.ndarray, size: int, steps: int = STEPS) -> OrdinalModel:
    """Proximal Adagrad on the weighted cumulative-link likelihood. rows, cols: the non-zero features."""
    n, total = len(grades), weight.sum()
    share = np.cumsum([weight[grades == g].sum() for g in range(GRADES)])[:-1] / max(total, 1e-9)
    share = np.clip(share, 1e-3, 1 - 1e-3)
    theta = np.log(share / (1 - share))
    theta = np.maximum.accumulate(theta + 1e-3 * np.arange(GRADES - 1))
    w, seen = np.zeros(size), np.full(size, 1e-8)
    gaps, gap_seen = theta.copy(), np.full(GRADES - 1, 1e-8)
    for _ in range(steps):
        s = np.bincount(rows, w[cols], n)
        upper = np.c_[OrdinalModel(w, gaps).below(s), np.ones(n)]
        lower = np.c_[np.zeros(n), upper[:, :-1]]
        at = np.arange(n)
        hi, lo = upper[at, grades], lower[at, grades]
        p = np.maximum(hi - lo, 1e-9)
        # derivatives of the negative log-likelihood
        by_score = weight * (1 - hi - lo) / total
        g = np.bincount(cols, by_score[rows], size)
        seen += g * g
        rate = LEARNING_RATE / np.sqrt(seen)
        w -= rate * g
        w = np.sign(w) * np.maximum(np.abs(w) - rate * PENALTY, 0)
        of_cut = np.zeros(GRADES - 1)
        for k in range(GRADES - 1):
            f = upper[:, k] * (1 - upper[:, k]) * weight / p / total
            of_cut[k] = f[grades == k + 1].sum() - f[grades == k].sum()
        gap_seen += of_cut * of_cut
        gaps -= 0.2 * LEARNING_RATE * of_cut / np.sqrt(gap_seen)
        gaps = np.maximum.accumulate(gaps + 1e-6 * np.arange(GRADES - 1))
    return OrdinalModel(w, gaps)


def _grades(labels: DataFrame, id_col: str) -> DataFrame:
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    rated = labels.select(F.col(id_col).cast("long").alias("label_id"), grade.alias("grade"))
    return rated.dropna().groupBy("label_id").agg(F.min("grade").alias("grade"))


def trained(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> OrdinalModel:
    """Fit on a bounded sample of the labelled rows of `docs`. Labels with nulls are left out; a doc_id that is rated more
    than once has its worst grade. Without any labelled row the model keeps everything."""
    rated = _grades(labels, id_col)
    counts = {r["grade"]: r["n"] for r in rated.groupBy("grade").agg(F.count("*").alias("n")).collect()}  # three rows
    parts = [
        rated.where(F.col("grade") == g).orderBy(F.xxhash64("label_id"), "label_id").limit(sample // GRADES) for g in sorted(counts)
    ]
    if not parts:
        return OrdinalModel(np.zeros(1 << BUCKET_BITS), np.linspace(-9, -8, GRADES - 1))
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.unionByName(p)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("grade", "text")  # `sample` rows at most

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        make = Features()
        found = [make(t) for t in strings(batch.column(1))]
        return pa.record_batch([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["grade", "cols"])

    got = arrow_map(rows, per_batch, "grade int, cols array<int>").toArrow()
    grades = got["grade"].to_numpy()
    if not len(grades):
        return OrdinalModel(np.zeros(1 << BUCKET_BITS), np.linspace(-9, -8, GRADES - 1))
    lists = got["cols"].combine_chunks()
    cols = lists.flatten().to_numpy()
    sizes = lists.value_lengths().to_numpy()
    drawn = np.bincount(grades, minlength=GRADES)
    weight = np.array([counts.get(g, 0) for g in range(GRADES)]) / np.maximum(drawn, 1)
    return fit(np.repeat(np.arange(len(grades)), sizes), cols, grades, weight[grades], 1 << BUCKET_BITS)


def scored(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, score, expected_grade, p_at_least_1, p_at_least_2, keep.

    A null or empty text has the features of an empty one. Null ids, repeated ids and repeated rows are scored like any
    others; other columns are ignored; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))  # fixed size
    make_here: dict = {}

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        weights, thresholds = sent.value
        make = make_here.setdefault("make", Features())
        texts = strings(batch.column(1))
        scores = np.array([weights[make(t)].sum(dtype=np.float64) for t in texts])
        tails = OrdinalModel(weights, thresholds).tails(scores)
        words = np.array([len(t.split()) for t in texts], np.int64)
        columns = [batch.column(0), pa.array(words), pa.array(scores), pa.array(tails.sum(1)), *map(pa.array, tails.T), pa.array(tails[:, -1] >= KEEP_TAIL)]
        return pa.record_batch(columns, ["doc_id", "n_words", "score", "expected_grade", "p_at_least_1", "p_at_least_2", "keep"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(chosen, per_batch, "doc_id long, n_words long, score double, expected_grade double, p_at_least_1 double, p_at_least_2 double, keep boolean")


def selected(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that the model keeps, with all their columns, in one narrow pass."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))
    at = docs.columns.index(text_col)
    make_here: dict = {}

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        weights, thresholds = sent.value
        make = make_here.setdefault("make", Features())
        scores = np.array([weights[make(t)].sum(dtype=np.float64) for t in strings(batch.column(at))])
        return batch.filter(pa.array(OrdinalModel(weights, thresholds).tails(scores)[:, -1] >= KEEP_TAIL))

    return arrow_map(docs, per_batch, docs.schema)
