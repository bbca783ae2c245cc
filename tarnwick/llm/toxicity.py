"""Toxicity: a logistic classifier that is regularised by counterfactuals.

Texts are sets of hashed words and word beginnings. The classifier is fitted on a bounded sample
of labelled rows (at most `most` of each label, in the order of a hash of doc_id); every other
step sees all rows. For each training text a counterfactual is made in which identity terms are
swapped for others of their group (a text without any gets a neutral mention), and the squared
change of the logit is penalised, so that naming a group does not move the score.

Defined cases: a null or empty text has no features and scores as the intercept says; labels
that are null are not used, a doc_id labelled twice counts as toxic if one label says so, and
of several texts with one doc_id the least is learnt from; repeated rows are scored each; very
long texts are scored whole; without labels of both kinds every score is 0; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 18
BEGINNINGS = (3, 4, 5, 6)
#: Rows of each label that the fit uses at most.
MOST = 2500
#: Groups of terms that may stand for one another (fixed values).
IDENTITY: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("gay", "straight", "lesbian", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("frauen", "männer"),
    ("christen", "muslime", "juden"),
    ("femmes", "hommes"),
    ("chrétiens", "musulmans", "juifs"),
    ("mujeres", "hombres"),
    ("cristianos", "musulmanes", "judíos"),
)
WORD = re.compile(r"[^\W\d_]+")
_of_word: dict[str, tuple[int, ...]] = {}


def _hashed(word: str) -> tuple[int, ...]:
    if word not in _of_word:
        if len(_of_word) > 50_000:
            _of_word.clear()
        parts = [word, *(f"{word[:n]}\x00" for n in BEGINNINGS if len(word) >= n)]
        _of_word[word] = tuple(zlib.crc32(p.encode()) >> 32 - BITS for p in parts)
    return _of_word[word]


def features(words: set[str]) -> np.ndarray:
    out: set[int] = set()
    for w in words:
        out.update(_hashed(w))
    return np.fromiter(out, np.int32, len(out))


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def counterfactual(words: set[str], groups: Sequence[Sequence[str]] = IDENTITY) -> set[str]:
    """The same words with identity terms swapped, or with one mentioned if there is none."""
    swap = {w: g[(i + 1) % len(g)] for g in groups for i, w in enumerate(g)}
    if not swap.keys() & words:
        terms = sorted(swap)
        return words | {terms[zlib.crc32(" ".join(sorted(words)).encode()) % len(terms)]}
    return {swap.get(w, w) for w in words}


def fit(rows: Sequence[tuple[int, np.ndarray, np.ndarray, np.ndarray]], penalty: float = 1.0, ridge: float = 1e-3, steps: int = 80) -> tuple[np.ndarray, float]:
    """Weights and intercept from (label, features, those a counterfactual adds, those it takes away).

    Each feature is scaled by the size of its log ratio between the labels, so that words which
    are as common in either hardly count, however many of them a text has.
    """
    y = np.array([r[0] for r in rows], np.float64)
    if not 0 < y.sum() < len(y):
        return np.zeros(1 << BITS, np.float32), -np.inf
    seen = np.bincount(np.concatenate([r[1] for r in rows]), minlength=1 << BITS)
    seen += np.bincount(np.concatenate([r[2] for r in rows]), minlength=1 << BITS)
    own = np.flatnonzero(seen >= 4)  # what is rarer says nothing
    at = np.full(1 << BITS, -1, np.int32)
    at[own] = np.arange(len(own))

    def matrix(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        col = at[np.concatenate(parts)]
        row = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
        return row[col >= 0], col[col >= 0]

    row, col = matrix([r[1] for r in rows])
    plus_row, plus_col = matrix([r[2] for r in rows])
    less_row, less_col = matrix([r[3] for r in rows])
    n, d = len(rows), len(own)
    toxic = np.bincount(col, (y > 0)[row].astype(float), d)
    clean = np.bincount(col, (y <= 0)[row].astype(float), d)
    ratio = np.log((toxic + 0.5) / (y.sum() + 1)) - np.log((clean + 0.5) / (n - y.sum() + 1))
    # What the labels' chance alone brings about is taken off.
    chance = 2 * np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
    scale = np.clip(np.abs(ratio) - chance, 0, None)
    each = np.where(y > 0, 0.5 / y.sum(), 0.5 / (n - y.sum()))  # both labels weigh the same
    u, b = np.zeros(d), 0.0
    m1, m2 = np.zeros(d + 1), np.zeros(d + 1)
    for t in range(1, steps + 1):
        w = u * scale
        z = np.bincount(row, w[col], n) + b
        e = each * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        shift = np.bincount(plus_row, w[plus_col], n) - np.bincount(less_row, w[less_col], n)
        c = 2 * penalty / n * shift
        g = np.bincount(col, e[row], d) + np.bincount(plus_col, c[plus_row], d) - np.bincount(less_col, c[less_row], d)
        g = np.append(scale * g + ridge * u, e.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        step = 0.1 * m1 / (1 - 0.9**t) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-9)
        u, b = u - step[:-1], b - step[-1]
    out = np.zeros(1 << BITS, np.float32)
    out[own] = u * scale
    return out, float(b)


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MOST, groups: Sequence[Sequence[str]] = IDENTITY) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """At most `most` rows of each label among labels (doc_id, toxic), with their features."""
    one = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = lambda y: one.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    chosen = pick(1).unionByName(pick(0))
    # 2 * most rows of two numbers: a size that is bounded, so broadcast. Of rows with one doc_id the least text is used.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    texts = texts.select("toxic", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(t) for t in batch.column(1).to_pylist()]
            own = [features(w) for w in words]
            other = [features(counterfactual(w, groups)) for w in words]
            plus = [np.setdiff1d(y, x).tobytes() for x, y in zip(own, other, strict=True)]
            less = [np.setdiff1d(x, y).tobytes() for x, y in zip(own, other, strict=True)]
            parts = [[np.sort(x).tobytes() for x in own], plus, less]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), *(pa.array(x, pa.binary()) for x in parts)], ["y", "own", "plus", "less"])

    found = texts.mapInArrow(run, "y int, own binary, plus binary, less binary").collect()
    found.sort(key=lambda r: (r.y, bytes(r.own)))  # the fit does not depend on how rows were dealt
    return [(r.y, *(np.frombuffer(x, np.int32) for x in (r.own, r.plus, r.less))) for r in found]


def score(docs: DataFrame, weights: np.ndarray, intercept: float) -> DataFrame:
    """The rows of docs with a column `score`, 0 to 1, which replaces one of that name."""
    docs = docs.drop("score")
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # 2**BITS floats, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            z = np.array([float(np.sort(w[features(words_of(t))].astype(np.float64)).sum()) for t in batch.column("text").to_pylist()]) + intercept
            s = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.where(np.isneginf(z), 0.0, s), pa.float64())], [*batch.schema.names, "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, score double")


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; held out rows are not learnt from."""
    w, b = fit(training_rows(docs, labels.where(~held_out()), most))
    return score(docs.select("doc_id", "text"), w, b).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
