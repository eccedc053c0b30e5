"""Language identification in two steps: the family, then the language within it.

Features are hashed byte pairs and triples of the whole text (A-Z lowered), as roots of their
shares. One linear support vector machine for each family tells the families apart; within a family
one machine for each pair of languages votes, and the margins decide ties. The models are fitted on
the driver to at most ``max_rows`` labelled documents, chosen by a hash of their id; every
document is predicted from its whole text.

A null text, or one without a letter, is ``und`` with score 0. Languages outside the family table
are a family of their own. Repeated rows get equal predictions; without labelled rows all documents
are ``und``; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.linear import sample, sigmoid, svm
from causeway.llm.tokens import LOWER, chunks
from causeway.session import write_layer

BINS = 2048
MAX_ROWS = 6000
#: Families of ISO 639-1 codes.
FAMILIES = {
    "germanic": "af da de en is nl no sv yi".split(),
    "romance": "ca es fr gl it oc pt ro".split(),
    "slavic": "be bg cs hr mk pl ru sk sl sr uk".split(),
    "uralic": "et fi hu".split(),
    "turkic": "az kk tr uz".split(),
    "indic": "bn gu hi mr ne pa ur".split(),
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, features, has a letter) of the chunks of a column; all of a text counts."""
    for c in chunks(column):
        n = c.hi - c.lo
        data = LOWER[c.data].astype(np.uint32)
        row = np.repeat(np.arange(n), np.diff(c.offsets))
        counts = np.zeros(n * BINS)
        for size in (2, 3):
            if len(data) >= size:
                code = data[:len(data) - size + 1].copy()
                for k in range(1, size):
                    code = (code << np.uint32(8)) | data[k:len(data) - size + 1 + k]
                code *= np.uint32(2654435761)
                code >>= np.uint32(32 - BINS.bit_length() + 1)
                same = row[:len(code)] == row[size - 1:]
                counts += np.bincount(row[:len(code)][same] * BINS + code[same], minlength=n * BINS)
        counts = counts.reshape(n, BINS)
        x = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1)).astype(np.float32)
        ascii_letter = np.zeros(n, bool)
        letter = (data >= 0x61) & (data <= 0x7A)
        ascii_letter[row[letter]] = True
        for k in np.flatnonzero(~ascii_letter):
            text = c.data[c.offsets[k]:c.offsets[k + 1]].tobytes().decode("utf-8", "replace")
            ascii_letter[k] = any(ch.isalpha() for ch in text)
        yield c.lo, c.hi, x, ascii_letter


@dataclass
class Model:
    """Families, their machines, the languages of each and the machines of each pair."""

    families: list[str]
    family_weights: np.ndarray
    languages: dict[str, list[str]]
    pair_weights: dict[str, list[tuple[int, int, np.ndarray]]] = field(default_factory=dict)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not self.families:
            return np.full(len(x), "und", object), np.zeros(len(x))
        margin = x @ self.family_weights[:-1] + self.family_weights[-1]
        best = margin.argmax(1)
        score = sigmoid(4 * margin.max(1)) if len(self.families) > 1 else np.ones(len(x))
        out = np.empty(len(x), object)
        for f, family in enumerate(self.families):
            mine = np.flatnonzero(best == f)
            names = self.languages[family]
            votes = np.zeros((len(mine), len(names)))
            weakest = np.full((len(mine), len(names)), np.inf)
            for a, b, w in self.pair_weights[family]:
                m = x[mine] @ w[:-1] + w[-1]
                for side, value in ((a, m), (b, -m)):
                    votes[:, side] += (value > 0) + np.clip(value, -1, 1) * 1e-3
                    weakest[:, side] = np.minimum(weakest[:, side], value)
            chosen = votes.argmax(1) if len(mine) else np.zeros(0, int)
            out[mine] = np.array(names, object)[chosen]
            if len(names) > 1:
                score[mine] *= sigmoid(4 * weakest[np.arange(len(mine)), chosen])
        return out, score


def fit(x: np.ndarray, lang: list[str]) -> Model:
    lang = np.array(lang, object)
    names = sorted(set(lang))
    if not names:
        return Model([], np.zeros((BINS + 1, 0)), {})
    family = np.array([FAMILY_OF.get(v, v) for v in lang], object)
    families = sorted(set(family))
    x = x.astype(np.float64)
    weights = np.stack([svm(x, np.where(family == f, 1.0, -1.0)) if len(families) > 1 else np.zeros(BINS + 1) for f in families], 1)
    model = Model(families, weights, {f: [v for v in names if FAMILY_OF.get(v, v) == f] for f in families})
    for f in families:
        pairs = []
        for a, b in combinations(range(len(model.languages[f])), 2):
            mine = np.flatnonzero((lang == model.languages[f][a]) | (lang == model.languages[f][b]))
            pairs.append((a, b, svm(x[mine], np.where(lang[mine] == model.languages[f][a], 1.0, -1.0))))
        model.pair_weights[f] = pairs
    return model


def train(docs: DataFrame, labelled: Column, lang_col: str, id_col: str, text_col: str, max_rows: int) -> Model:
    """Fit to a bounded sample of the rows where ``labelled`` holds."""
    chosen = sample(docs.where(labelled & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id")), "doc_id", max_rows)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    rows = write_layer(rows.join(F.broadcast(chosen.distinct()), "doc_id"), "language-sample")  # at most max_rows ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, x, letters in features(b.column(1)):
                for k in np.flatnonzero(letters):
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(lo + k, 1), pa.array([x[k].tobytes()], pa.binary())], names=["lang", "x"])
    got = rows.select("lang", "text").mapInArrow(run, "lang string, x binary").limit(max_rows).toArrow()
    x = np.stack([np.frombuffer(v.as_py(), np.float32) for v in got.column("x")]) if got.num_rows else np.zeros((0, BINS), np.float32)
    order = np.lexsort((x[:, 0], np.array(got.column("lang").to_pylist(), str))) if got.num_rows else []
    return fit(x[order], [got.column("lang")[int(k)].as_py() for k in order])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every document, from its text alone."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few weight vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, x, letters in features(b.column(1)):
                lang, score = shared.value.predict(x)
                lang[~letters] = "und"
                score[~letters] = 0
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(lang.tolist(), pa.string()), pa.array(score.astype(float))],
                                                 names=["doc_id", "lang_pred", "score"])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Whether a document's fold (crc32 of its id as text) is the one kept from training."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def languages(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the documents outside the held-out fold."""
    model = train(docs, ~held_out(id_col), lang_col, id_col, text_col, max_rows)
    return identify(docs, model, id_col, text_col).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
