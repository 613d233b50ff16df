"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text has one score, the sum of shared weights over its hashed features;
ordered thresholds turn it into grades: P(grade <= k) = sigmoid(theta_k - score).
The fitted model gives the expected grade and the tail probability
P(grade >= select), by which texts are selected.

Features: the set of lower-cased words and of their beginnings (``PREFIXES``
letters), and shape features (symbols, exclamations, capitals, repeated runs of
three words) for every bound that their share exceeds.  They are hashed into 2 ** BITS weights.

The model is fitted on the driver from a bounded sample: at most ``max_labels``
rated rows, the ones with the smallest hash of their id, as hashed feature
lists.  Scoring is one pass over all texts; the weights (4 bytes each, 4 MB)
go with the tasks.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text

BITS = 20
PREFIXES = (4, 5, 6, 7)
MAX_LABELS = 10_000
CACHE_PIECES = 300_000
LANGUAGES = 64                           # numbers of languages, by hash
PER_EPOCH = 300                          # features that training takes in at a time
_EDGES = (0.01, 0.03, 0.1, 0.3)          # a shape feature is set for each of these shares that it exceeds
_STRIP = b"".join(bytes([b]) for b in range(128) if not chr(b).isalnum())


def hashed(name: bytes) -> int:
    return zlib.crc32(name) & ((1 << BITS) - 1)


def _piece(piece: bytes) -> tuple[tuple[int, ...], int]:
    """A white-space piece as (its hashed word and prefixes, shape bits:
    symbol, exclamation, capitals)."""
    text = piece.decode("utf-8")
    core = piece.strip(_STRIP).decode("utf-8")
    shape = any(c in "#*$%&|<>" for c in text) | ("!!" in text) << 1 | (len(core) > 1 and core.isupper()) << 2
    low = core.lower()
    names = [b"w" + low.encode()] if low else []
    names += [b"p" + low[:n].encode() for n in PREFIXES if len(low) > n]
    return tuple(map(hashed, names)), int(shape)


class Features:
    """Feature numbers of a text, sorted, with a bounded cache of pieces.
    With ``use`` (a mask) only the features in it are given."""

    def __init__(self, use: np.ndarray | None = None, limit: int = CACHE_PIECES):
        self.cache: dict[bytes, tuple[tuple[int, ...], int]] = {}
        self.limit, self.use = limit, use

    def _known(self, piece: bytes) -> tuple[tuple[int, ...], int]:
        if len(self.cache) >= self.limit:
            self.cache.clear()
        names, shape = _piece(piece)
        if self.use is not None:
            names = tuple(n for n in names if self.use[n])
        self.cache[piece] = names, shape
        return names, shape

    def __call__(self, data: bytes) -> np.ndarray:
        pieces = data.split()
        counts = Counter(pieces)
        cache, found, shapes = self.cache, set(), [0, 0, 0]
        for p, n in counts.items():
            names, shape = cache.get(p) or self._known(p)
            if names:
                found.update(names)
            if shape:
                for k in range(3):
                    shapes[k] += n * (shape >> k & 1)
        total = max(1, len(pieces))
        runs = len(pieces) - 2
        shares = [x / total for x in shapes] + [1 - len(set(zip(pieces, pieces[1:], pieces[2:]))) / runs if runs > 0 else 0.0]
        own = [b"s%d:%d" % (k, j) for k, share in enumerate(shares) for j, edge in enumerate(_EDGES) if share > edge]
        found.update(f for f in map(hashed, own) if self.use is None or self.use[f])
        return np.fromiter(sorted(found), np.int32, len(found))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray          # float32, 2 ** BITS
    thresholds: np.ndarray       # ascending; one less than there are grades

    def score(self, features: np.ndarray) -> float:
        return float(self.weights[features[features < len(self.weights)]].sum(dtype=np.float64))

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. K-1, one row per score."""
        return _sigmoid(scores[:, None] - self.thresholds[None, :])


def language(name: str | None) -> int:
    """The number of a language, above those of the features."""
    return (1 << BITS) + zlib.crc32((name or "").encode()) % LANGUAGES


def _ends(scores: np.ndarray, grade: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(grade <= own) and P(grade < own) of each row."""
    last = len(theta)
    upper = np.where(grade < last, _sigmoid(theta[np.minimum(grade, last - 1)] - scores), 1.0)
    return upper, np.where(grade > 0, _sigmoid(theta[np.maximum(grade, 1) - 1] - scores), 0.0)


def _fit_thresholds(scores: np.ndarray, grade: np.ndarray, theta: np.ndarray) -> None:
    """Each threshold by bisection between its neighbours (the loss is convex)."""
    for k in range(len(theta)):
        low, high = theta[k - 1] + 1e-2 if k else -20.0, theta[k + 1] - 1e-2 if k + 1 < len(theta) else 20.0
        for _ in range(30):
            theta[k] = (low + high) / 2
            upper, lower = _ends(scores, grade, theta)
            p = np.maximum(upper - lower, 1e-12)
            slope = (lower * (1 - lower) / p)[grade == k + 1].sum() - (upper * (1 - upper) / p)[grade == k].sum()
            low, high = (theta[k], high) if slope < 0 else (low, theta[k])


def train(rows: Iterable[tuple[np.ndarray, int]], grades: int, epochs: int = 15, l1: float = 2.0, l2: float = 0.1,
          relax: float = 0.1) -> OrdinalModel:
    """Penalised maximum likelihood over all hashed features, with weights of
    either sign.  A feature's L1 penalty is ``l1`` standard errors of its
    gradient without any weights, so common and rare ones are held alike: a
    word's evidence counts beside that of the others, and no share of rows
    rules it out.  Each epoch takes in the features whose gradient exceeds
    their penalty and solves for the chosen ones by coordinate descent; those
    that stay are solved once more with ``relax`` of the penalty.

    The numbers of languages have weights of their own without L1, left out
    of the model: words are compared within a language.  Rows with equal
    features and grade count once; equal input gives an equal model.  Without
    rows the weights are 0 and the thresholds evenly spaced."""
    rows = list({(f.tobytes(), g): (f, g) for f, g in rows}.values())
    theta = np.linspace(-1.0, 1.0, grades - 1) if grades > 2 else np.zeros(grades - 1)
    weights = np.zeros(1 << BITS, np.float32)
    if not rows:
        return OrdinalModel(weights, theta)
    grade = np.array([g for _, g in rows])
    names = np.concatenate([f for f, _ in rows])
    if not len(names):
        _fit_thresholds(np.zeros(len(rows)), grade, theta)
        return OrdinalModel(weights, theta)
    order = np.argsort(names, kind="stable")
    at = np.repeat(np.arange(len(rows), dtype=np.int32), [len(f) for f, _ in rows])[order]     # rows by feature
    names, start = np.unique(names[order], return_index=True)
    end = np.append(start[1:], len(at))
    del order
    scores, w = np.zeros(len(rows)), np.zeros(len(names))
    _fit_thresholds(scores, grade, theta)

    def slopes():
        upper, lower = _ends(scores, grade, theta)
        return 1.0 - upper - lower, np.maximum(upper * (1 - upper) + lower * (1 - lower), 0.1)

    def solve(chosen: np.ndarray, penalty: np.ndarray, steps: int) -> None:
        for _ in range(steps):
            slope, curve = slopes()
            left, moved = slope / curve, 0.0
            own = [(j, at[start[j]:end[j]]) for j in chosen]
            own = [(j, i, curve[i], curve[i].sum() + l2) for j, i in own]
            for _ in range(3):
                for j, i, c, a in own:
                    v = w[j] * (a - l2) - c @ left[i]
                    new = np.sign(v) * max(0.0, abs(v) - penalty[j]) / a
                    if change := new - w[j]:
                        left[i] += change
                        scores[i] += change
                        w[j] = new
                        moved = max(moved, abs(change))
            _fit_thresholds(scores, grade, theta)
            if moved < 1e-2:
                return

    nuisance = names >= 1 << BITS
    solve(np.flatnonzero(nuisance), np.zeros(len(names)), 6)
    penalty = l1 * max(slopes()[0].std(), 1e-9) * np.sqrt(end - start)
    penalty[nuisance] = 0
    active = nuisance.copy()
    for _ in range(epochs):
        excess = np.abs(np.add.reduceat(slopes()[0].astype(np.float32)[at], start)) / np.maximum(penalty, 1e-9)
        excess[active] = 0
        new = np.flatnonzero(excess > 1)
        if not len(new):
            break
        active[new[np.argsort(-excess[new], kind="stable")[:PER_EPOCH]]] = True
        solve(np.flatnonzero(active), penalty, 6)
        active = nuisance | (w != 0)
    solve(np.flatnonzero(active), relax * penalty, 10)
    weights[names[~nuisance]] = w[~nuisance]
    for j in np.flatnonzero(nuisance):          # the thresholds fit the scores that texts will get
        scores[at[start[j]:end[j]]] -= w[j]
    _fit_thresholds(scores, grade, theta)
    return OrdinalModel(weights, theta)


def rated_features(docs: DataFrame, ratings: DataFrame, grade: Column, max_labels: int = MAX_LABELS, id_col: str = "doc_id",
                   text_col: str = "text", lang_col: str = "lang") -> list[tuple[int, np.ndarray, int]]:
    """``(id, features, grade)`` of at most ``max_labels`` rated documents, by
    id.  Rated rows without a grade or id are left out; of several ratings of
    a document the lowest counts.  Where ``docs`` has ``lang_col``, the number
    of the language stands last among the features."""
    sample = (ratings.select(F.col(id_col).cast("long").alias("doc_id"), grade.cast("int").alias("grade"))
              .filter("doc_id is not null and grade is not null")
              .groupBy("doc_id").agg(F.min("grade").alias("grade"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels))

    def run(batches):
        features = Features()
        for batch in batches:
            rows = [features(t.as_py()) for t in batch.column(2)]
            if batch.num_columns > 3:
                rows = [np.append(f, np.int32(language(n))) for f, n in zip(rows, batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.int32()))],
                                             ["doc_id", "grade", "features"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).cast("binary").alias("data"),
                        *([F.col(lang_col).cast("string").alias("lang")] if lang_col in docs.columns else []))
    found = (texts.join(F.broadcast(sample), "doc_id")          # at most max_labels rows of two numbers
             .select("doc_id", "grade", *texts.columns[1:]).mapInArrow(run, "doc_id long, grade int, features array<int>"))
    rows = found.orderBy("doc_id").toArrow().combine_chunks()
    lists = rows["features"].chunk(0) if rows.num_rows else pa.array([], pa.list_(pa.int32()))
    cuts, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    return [(d, values[a:b], g) for d, g, a, b in zip(rows["doc_id"].to_pylist(), rows["grade"].to_pylist(), cuts, cuts[1:])]


def held_out(doc_id: int) -> bool:
    """A fifth of the rated rows, by id: a hold-out for ``fit``."""
    return zlib.crc32(b"%d" % doc_id) % 5 == 0


def fit(docs: DataFrame, ratings: DataFrame, grade: Column, grades: int, max_labels: int = MAX_LABELS, id_col: str = "doc_id",
        text_col: str = "text", lang_col: str = "lang", hold_out: Callable[[int], bool] | None = None) -> OrdinalModel:
    """The model of the rated documents (at most ``max_labels``); rows for
    whose id ``hold_out`` says so are left for a test, none by default."""
    rows = rated_features(docs, ratings, grade, max_labels, id_col, text_col, lang_col)
    return train([(f, g) for d, f, g in rows if hold_out is None or not hold_out(d)], grades)


def graded(docs: DataFrame, model: OrdinalModel, select: int, threshold: float = 0.5, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``(doc_id, score, expected_grade, tail_probability, kept)``, one row
    per row of ``docs``: ``tail_probability`` is P(grade >= ``select``) and
    ``kept`` says that it reaches ``threshold``.

    Defined results: a null text counts as empty and is scored by its shape
    alone; repeated rows are scored each; null ids stay null; an empty table
    gives no rows; other columns are not read.
    """

    def run(batches):
        features = Features(model.weights != 0)
        for batch in batches:
            scores = np.array([model.score(features(t.as_py())) for t in batch.column(1)])
            tails = model.tails(scores)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(tails.sum(axis=1)), pa.array(tails[:, select - 1]),
                 pa.array(tails[:, select - 1] >= threshold)],
                ["doc_id", "score", "expected_grade", "tail_probability", "kept"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).cast("binary").alias("data"))
    return rows.mapInArrow(run, "doc_id long, score double, expected_grade double, tail_probability double, kept boolean")
