"""Toxicity by a chain of linear classifiers.

The categories are predicted one after the other; each link is a logistic regression that sees, besides
its own features, the probabilities of all earlier categories. So that a link learns from
probabilities as good as those it will meet, the earlier links' training values are predicted out of
fold: by models that never saw the document.

Features are words (lower-case runs of letters and digits) and their first 4, 5 and 6 bytes, present
or not in the whole text. A category keeps the features whose log-odds in the sample are surely large
(at least ``clear`` beyond two deviations), at most ``max_features`` of them; rare chance words and
the traces of wrong labels stay below that. Fitting uses at most ``max_rows`` labelled documents, chosen by a hash of the id;
scoring covers every document's whole text.

Null and empty texts have no features and get the models' base rates. Labels that are null count as
0, labels of unknown documents are ignored, repeated labels count once (the greatest). Without
labelled rows all probabilities are 0. Repeated rows get equal scores; an empty table gives an empty
result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.linear import logistic, sample, sigmoid
from causeway.llm.tokens import ALNUM, U64, _tables, chunks, mix, words
from causeway.session import write_layer

PREFIXES = (4, 5, 6)
MAX_ROWS = 8000
MAX_FEATURES = 400
FOLDS = 5
CLEAR = 2.0


def present(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(lo, hi, row, feature, words per row) for the chunks of a column; features may repeat."""
    for c in chunks(column):
        w = words(c, ALNUM, lower=True)
        row, size = w.row, w.end - w.start
        rows, out = [row], [w.hashes()]
        if len(row):
            power, inverse = _tables(len(w.data) + 1)
            total = np.zeros(len(w.data) + 1, U64)
            np.cumsum((w.data.astype(U64) + U64(1)) * power[:len(w.data)], out=total[1:])
            for n in PREFIXES:
                long = np.flatnonzero(size >= n)
                at = w.start[long]
                rows.append(row[long])
                out.append(mix((total[at + n] - total[at]) * inverse[at] + U64(n)))
        yield c.lo, c.hi, np.concatenate(rows), np.concatenate(out), np.diff(w.first)


@dataclass
class Link:
    """One category: its features (sorted), their weights, those of earlier probabilities, and the bias.

    ``threshold``: the probability from which on the category is assigned, the best by F1 out of fold.
    """

    name: str
    features: np.ndarray
    weights: np.ndarray
    threshold: float = 0.5

    def predict(self, x: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        return sigmoid(np.hstack([x, earlier]) @ self.weights[:-1] + self.weights[-1])


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The threshold of best F1, in the middle of the range that gives it; one half without positives."""
    grid = np.linspace(0.05, 0.95, 91)
    hits = np.array([(y[p >= t] > 0).sum() for t in grid], float)
    f1 = 2 * hits / np.maximum(1, np.array([(p >= t).sum() for t in grid]) + (y > 0).sum())
    if not (y > 0).any() or f1.max() == 0:
        return 0.5
    return float(np.median(grid[f1 >= f1.max() - 1e-12]))


def matrix(row: np.ndarray, feature: np.ndarray, n: int, wanted: np.ndarray, sieve: np.ndarray) -> np.ndarray:
    """Which of the wanted (sorted) features each of n rows has."""
    maybe = np.flatnonzero(sieve[(feature >> U64(44)).astype(np.int64)])
    row, feature = row[maybe], feature[maybe]
    at = np.minimum(np.searchsorted(wanted, feature), max(0, len(wanted) - 1))
    hit = wanted[at] == feature if len(wanted) else np.zeros(0, bool)
    x = np.zeros((n, len(wanted)))
    x[row[hit], at[hit]] = 1
    return x


def sieve_of(wanted: np.ndarray) -> np.ndarray:
    sieve = np.zeros(1 << 20, bool)
    sieve[(wanted >> U64(44)).astype(np.int64)] = True
    return sieve


def choose(rows: DataFrame, categories: list[str], totals: dict[str, tuple[int, int]], max_features: int, clear: float) -> dict[str, np.ndarray]:
    """The features of each category, from counts of documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = np.stack([b.column(2 + k).to_numpy() for k in range(len(categories))], 1)
            for lo, hi, row, feature, _ in present(b.column(1)):
                order = np.lexsort((row, feature))
                row, feature = row[order], feature[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (feature[1:] != feature[:-1])
                names, code = np.unique(feature[new], return_inverse=True)
                counts = [np.bincount(code, minlength=len(names))] + [np.bincount(code, weights=y[lo:hi][row[new], k], minlength=len(names)) for k in range(len(categories))]
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), *[pa.array(c.astype(np.int64)) for c in counts]],
                                                 names=["feature", "n", *categories])
    counted = rows.select("doc_id", "text", *categories).mapInArrow(run, "feature bigint, n bigint, " + ", ".join(f"{c} bigint" for c in categories))
    counted = counted.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("n", *categories)]).where("n > 2")
    counted = write_layer(counted, "toxicity-features")
    out = {}
    for c in categories:
        pos, neg = totals[c]
        a, b = F.col(c) + 0.5, F.col("n") - F.col(c) + 0.5
        odds = F.log(a / (pos - F.col(c) + 0.5)) - F.log(b / (neg - F.col("n") + F.col(c) + 0.5))
        surely = F.abs(odds) - 2 * F.sqrt(1 / a + 1 / b)
        best = counted.select("feature", surely.alias("surely")).where(F.col("surely") >= clear).orderBy(F.desc("surely"), "feature").limit(max_features).collect()
        out[c] = np.sort(np.array([r["feature"] for r in best], np.int64).view(U64))
    return out


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text",
        max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES, clear: float = CLEAR) -> list[Link]:
    """The chain, in the order of ``categories``: name -> 0/1 expression over ``labels``."""
    names = list(categories)
    marks = labels.select(F.col(id_col).alias("doc_id"), *[F.coalesce(c.cast("int"), F.lit(0)).alias(n) for n, c in categories.items()])
    marks = sample(marks.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.max(n).alias(n) for n in names]), "doc_id", max_rows)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = write_layer(texts.join(F.broadcast(marks), "doc_id"), "toxicity-sample")  # at most max_rows labels
    totals = rows.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]).first()
    if not totals["n"]:
        return []
    chosen = choose(rows, names, {n: (totals[n], totals["n"] - totals[n]) for n in names}, max_features, clear)
    wanted = np.unique(np.concatenate(list(chosen.values())))
    sieve = sieve_of(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, row, feature, _ in present(b.column(1)):
                x = matrix(row, feature, hi - lo, wanted, sieve).astype(bool)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([np.packbits(v).tobytes() for v in x], pa.binary()),
                                                  *[b.column(2 + k).slice(lo, hi - lo) for k in range(len(names))]], names=["doc_id", "x", *names])
    kind = docs.schema[id_col].dataType.simpleString()
    got = (rows.select("doc_id", "text", *names).mapInArrow(run, f"doc_id {kind}, x binary, " + ", ".join(f"{n} int" for n in names))
           .orderBy("doc_id").limit(max_rows).toArrow())
    x = np.stack([np.unpackbits(np.frombuffer(v.as_py(), np.uint8), count=len(wanted)) for v in got.column("x")]).astype(np.float64)
    fold = np.arange(len(x)) % FOLDS
    chain, earlier = [], np.zeros((len(x), 0))
    for n in names:
        mine = x[:, np.searchsorted(wanted, chosen[n])]
        y = got.column(n).to_numpy().astype(float)
        both = np.hstack([mine, earlier])
        out_of_fold = np.zeros(len(x))
        for f in range(FOLDS):
            w = logistic(both[fold != f], y[fold != f])
            out_of_fold[fold == f] = sigmoid(both[fold == f] @ w[:-1] + w[-1])
        chain.append(Link(n, chosen[n], logistic(both, y), best_threshold(out_of_fold, y)))
        earlier = np.hstack([earlier, out_of_fold[:, None]])
    return chain


def score(docs: DataFrame, chain: list[Link], names: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, p_<category>...) for every document."""
    kind = docs.schema[id_col].dataType.simpleString()
    wanted = np.unique(np.concatenate([link.features for link in chain])) if chain else np.zeros(0, U64)
    places = [np.searchsorted(wanted, link.features) for link in chain]
    sieve = sieve_of(wanted)
    shared = docs.sparkSession.sparkContext.broadcast((chain, wanted, places, sieve))  # bounded by max_features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, wanted, places, sieve = shared.value
        for b in batches:
            for lo, hi, row, feature, _ in present(b.column(1)):
                x = matrix(row, feature, hi - lo, wanted, sieve)
                p = np.zeros((hi - lo, 0))
                for link, place in zip(chain, places):
                    p = np.hstack([p, link.predict(x[:, place], p)[:, None]])
                cols = [pa.array(p[:, k]) if chain else pa.array(np.zeros(hi - lo)) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *cols], names=["doc_id", *[f"p_{n}" for n in names]])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, " + ", ".join(f"p_{n} double" for n in names))
