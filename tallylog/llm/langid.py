"""Language identification with string kernels.

Texts are compared by the character n-grams that occur in them (orders 1 to 3, present or
not, hashed): the kernel adds up, order by order, the number of shared n-grams over the
geometric mean of both counts.  A Nystroem map of landmark texts and one-versus-rest kernel
ridge regression on it are fit on the driver from a bounded sample of labelled rows; texts
are scored by products of batch matrices.

Bounds of the fit: PER_LANG different rows of each label (the smallest hashes of their ids
and texts) and LANDMARKS landmarks, or one a label where there are more labels.  All labels
can be predicted.  Whole texts are used, to fit and to score.

Defined results: a null text or one without a letter is ``und`` with score 0; a null id is
held out; with no labelled row to learn from every text is ``und``; equal texts get equal
predictions; other columns, whatever their names, pass through ``keep_identified`` unread.
Labels, sources and ids are never inputs of a prediction.  Every text with a letter gets a
label, so ``keep_identified`` rejects the others only: a margin that is low against all
languages isn't told apart from a short or mixed text of one of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallylog.llm.common import fresh_names, let_go

UNKNOWN = "und"
PER_LANG, LANDMARKS = 250, 96
RIDGE = 1e-3
#: hashed places of the n-grams of each order
PLACES = (1 << 10, 1 << 12, 1 << 13)
ROWS = 256
_LETTER = regex.compile(r"\p{L}")
_EDGES = np.concatenate([[0], np.cumsum(PLACES)])
_MIX = np.uint32(0x9E3779B1)


def ngrams(text: str) -> np.ndarray:
    """Presence of each hashed n-gram, order after order."""
    found = np.zeros(_EDGES[-1], np.uint8)
    chars = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    for k in range(0, max(1, len(chars)), 1 << 18):
        run = chars[k : k + (1 << 18) + len(PLACES) - 1]
        code = np.zeros(len(run), np.uint32)
        for order, places in enumerate(PLACES):
            if len(run) <= order:
                break
            code = (code[: len(run) - order] * np.uint32(0x01000193)) ^ run[order:]
            found[_EDGES[order] + ((code * _MIX) >> np.uint32(33 - places.bit_length()))] = 1
    return found


@dataclass
class Model:
    langs: list[str]
    #: presence rows of the landmarks, packed, and the regression's weights (landmark, language)
    landmarks: np.ndarray
    weights: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_wide"):
            self._wide = normalised(np.unpackbits(self.landmarks, axis=1)[:, : _EDGES[-1]])
        return normalised(rows) @ self._wide.T @ self.weights


def normalised(rows: np.ndarray) -> np.ndarray:
    """Rows whose inner products are the blended kernel, 1 for a text with itself."""
    out = rows.astype(np.float32)
    for a, b in zip(_EDGES[:-1], _EDGES[1:], strict=True):
        part = out[:, a:b]
        part /= np.sqrt(np.maximum(part.sum(1, keepdims=True), 1) * len(PLACES))
    return out


def fit(langs: list[str], labels: np.ndarray, rows: np.ndarray, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """``labels``: index into ``langs`` of each packed row; landmarks are spread evenly over the labels."""
    turn = np.zeros(len(labels), np.int64)
    for k in range(len(langs)):
        turn[labels == k] = np.arange((labels == k).sum())
    chosen = np.lexsort((labels, turn))[: max(landmarks, len(langs))]
    wide = normalised(np.unpackbits(rows, axis=1)[:, : _EDGES[-1]])
    cross = (wide @ wide[chosen].T).astype(np.float64)
    target = np.where(labels[:, None] == np.arange(len(langs)), 1.0, -1.0)
    inner = cross[chosen]
    left = cross.T @ cross + ridge * len(labels) * inner + 1e-8 * np.eye(len(chosen))
    return Model(langs, rows[chosen], np.linalg.solve(left, cross.T @ target).astype(np.float32))


def held_out(df: DataFrame, id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(df[id_col].cast("string").cast("binary")) % 3 == 1, F.lit(True))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, **options: float) -> Model | None:
    """Fit on a bounded sample of the labelled rows that are not held out."""
    known = df.where(~held_out(df, id_col) & df[lang_col].isNotNull() & df[text_col].isNotNull())
    known = known.select(F.xxhash64(df[id_col].cast("string"), df[text_col]).alias("rank"), df[lang_col].alias("lang"), df[text_col].cast("binary").alias("text"))
    counts = known.groupBy("lang").count().orderBy("lang").collect()
    if not counts:
        return None
    # ranks are uniform; twice the share that is wanted, then the smallest ranks of each label
    cuts = [(r["lang"], min(2**63 - 1, int(-(2**63) + min(1.0, 2 * per_lang / r["count"]) * 2**64))) for r in counts]
    cuts = df.sparkSession.createDataFrame(cuts, "lang string, cut long")
    some = known.join(cuts, "lang").where("rank <= cut").select("rank", "lang", "text").dropDuplicates(["lang", "rank"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.packbits(ngrams(x.decode("utf-8", "replace"))).tobytes() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["rank", "lang", "row"])

    found: dict[str, list[tuple[int, bytes]]] = {}
    for row in some.mapInArrow(each, "rank long, lang string, row binary").collect():
        found.setdefault(row["lang"], []).append((row["rank"], bytes(row["row"])))
    if not found:
        return None
    langs = sorted(found)
    sample = [(k, row) for k, lang in enumerate(langs) for _, row in sorted(found[lang])[:per_lang]]
    model = fit(langs, np.array([k for k, _ in sample]), np.stack([np.frombuffer(row, np.uint8) for _, row in sample]), **options)
    del found, sample
    let_go()  # the driver has held the sample's wide rows
    return model


def predict_texts(texts: list[bytes | None], model: Model | None) -> tuple[list[str], np.ndarray]:
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    decoded = [x.decode("utf-8", "replace") if x is not None else "" for x in texts]
    todo = [k for k, x in enumerate(decoded) if model is not None and _LETTER.search(x)]
    for first in range(0, len(todo), ROWS):
        part = todo[first : first + ROWS]
        margins = model.scores(np.stack([ngrams(decoded[k]) for k in part]))
        best = margins.argmax(1)
        for k, b, m in zip(part, best, margins[np.arange(len(part)), best], strict=True):
            names[k], scores[k] = model.langs[b], float(np.clip((m + 1) / 2, 0, 1))
    return names, scores


def predict(df: DataFrame, model: Model | None, text_col: str = "text") -> tuple[DataFrame, str]:
    """``df`` with a struct (lang_pred, score), and the struct's name; all other columns pass through unread."""
    text, told = fresh_names(df, "text", "lang")
    whole = df.withColumn(text, df[text_col].cast("binary"))
    names_out = [*df.columns, told]
    out = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            names, scores = predict_texts(texts, model)
            found = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], fields=list(out))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], names=names_out)

    schema = df.select("*", F.struct(F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).alias(told)).schema
    return whole.mapInArrow(each, schema), told


def languages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options: float) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of ``df``."""
    model = train(df, id_col, text_col, lang_col, **options)
    slim = df.select(df[id_col].cast("long").alias("doc_id"), held_out(df, id_col).alias("held_out"), df[text_col].alias("text"))
    found, told = predict(slim, model)
    return found.select("doc_id", "held_out", f"{told}.lang_pred", f"{told}.score")


def keep_identified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options: float) -> DataFrame:
    """Rows of ``df`` whose language the model tells (not ``und``)."""
    found, told = predict(df, train(df, id_col, text_col, lang_col, **options), text_col)
    return found.where(F.col(f"{told}.lang_pred") != UNKNOWN).select(df.columns)
