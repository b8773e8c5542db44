"""Language identification by a byte convolutional network, trained here in NumPy.

One-hot bytes under filters of several widths are sums of table rows, so a width is a table
per offset. Each filter keeps its largest response in a window of fixed length; a softmax
layer reads those. A text's windows are averaged by their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tablewright.llm.arrays import BLOCK_BYTES

WIDTHS = (2, 3, 4)
FILTERS = 16
WINDOW = 256
# Most labelled rows per language that training reads, about, and the pieces drawn from the whole of each text.
SAMPLE_ROWS = 400
SAMPLE_PIECES = 8
MOST_LANGUAGES = 1000
STEPS = 700
BATCH = 64
UNKNOWN = "und"
# Windows that pass the filters at once.
TOGETHER = 32


@dataclass
class Model:
    languages: list[str]
    tables: list[np.ndarray]  # per width: (width, 256, FILTERS)
    bias: np.ndarray  # (widths x FILTERS)
    weights: np.ndarray  # (widths x FILTERS, languages)
    offsets: np.ndarray  # (languages)


def windows(raw: bytes, length: int = WINDOW) -> np.ndarray:
    """A text's bytes as rows of ``length``, the last one filled with zeros."""
    rows = max(1, -(-len(raw) // length))
    out = np.zeros(rows * length, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(rows, length)


def train(texts: list[str], labels: list[str], steps: int = STEPS, seed: int = 3) -> Model:
    """Fit tables and weights by Adam on windows of the texts, some of them shortened."""
    languages = sorted(set(labels))
    code = {name: i for i, name in enumerate(languages)}
    parts = [(w, code[label]) for text, label in zip(texts, labels) for w in windows(text.encode("utf-8", "replace")) if w.any()]
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    for table in params:
        table[:, 0] = 0  # the filling
    params += [np.zeros(len(WIDTHS) * FILTERS, np.float32), rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32),
               np.zeros(len(languages), np.float32)]
    if len(languages) > 1:
        rows, wanted = np.stack([p[0] for p in parts]), np.array([p[1] for p in parts])
        by_class = [np.flatnonzero(wanted == i) for i in range(len(languages))]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, steps + 1):
            picked = np.array([rng.choice(by_class[c]) for c in rng.integers(0, len(languages), BATCH)])
            x, y = rows[picked].copy(), wanted[picked]
            for i in np.flatnonzero(rng.random(BATCH) < 0.4):
                x[i, rng.integers(4, 80):] = 0
            grads = _gradients(params, x, y)
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(languages, params[: len(WIDTHS)], *params[len(WIDTHS):])


def _gradients(params: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    tables, (bias, weights, offsets) = params[: len(WIDTHS)], params[len(WIDTHS):]
    peaks, best = [], []
    for table in tables:
        n = x.shape[1] - len(table) + 1
        response = sum(table[j][x[:, j: j + n]] for j in range(len(table)))
        peaks.append(response.argmax(axis=1))
        best.append(np.take_along_axis(response, peaks[-1][:, None], axis=1)[:, 0])
    before = np.concatenate(best, axis=1) + bias
    hidden = np.maximum(before, 0)
    p = softmax(hidden @ weights + offsets)
    p[np.arange(len(y)), y] -= 1
    p /= len(y)
    back = (p @ weights.T) * (before > 0)
    out = []
    for i, (table, peak) in enumerate(zip(tables, peaks)):
        grad, own = np.zeros_like(table), back[:, i * FILTERS: (i + 1) * FILTERS]
        filters = np.broadcast_to(np.arange(FILTERS), peak.shape)
        for j in range(len(table)):
            np.add.at(grad[j], (np.take_along_axis(x, peak + j, axis=1), filters), own)
        grad[:, 0] = 0
        out.append(grad)
    return [*out, back.sum(0), hidden.T @ p, p.sum(0)]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Scorer:
    """A model applied to many windows: neighbouring bytes share one row of a joint table."""

    def __init__(self, model: Model):
        self.model = model
        two, three, four = model.tables
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        self.pairs = np.concatenate([pair(two[0], two[1]), pair(three[0], three[1]), pair(four[0], four[1]), pair(four[2], four[3])], axis=1)
        self.third = three[2]

    def logits(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty((len(rows), len(self.model.languages)), np.float32)
        f = FILTERS
        for low in range(0, len(rows), TOGETHER):
            x = rows[low: low + TOGETHER]
            index = x[:, :-1].astype(np.int32) << 8 | x[:, 1:]
            g = self.pairs[index]
            best = np.concatenate([g[:, :, :f].max(axis=1), (g[:, :-1, f: 2 * f] + self.third[x[:, 2:]]).max(axis=1),
                                   (g[:, :-2, 2 * f: 3 * f] + g[:, 2:, 3 * f:]).max(axis=1)], axis=1)
            out[low: low + TOGETHER] = np.maximum(best + self.model.bias, 0) @ self.model.weights + self.model.offsets
        return out

    def predict(self, texts: list) -> pd.DataFrame:
        """lang_pred and score per text; ``UNKNOWN`` and 0 without a letter."""
        names = [UNKNOWN] * len(texts)
        scores = np.zeros(len(texts))
        waiting, size = [], 0

        def flush() -> None:
            rows = [windows(raw) for _, raw in waiting]
            logits = self.logits(np.concatenate(rows))
            low = 0
            for (i, raw), own in zip(waiting, rows):
                weight = np.full(len(own), float(WINDOW))
                weight[-1] = len(raw) - WINDOW * (len(own) - 1)
                mean = (logits[low: low + len(own)] * (weight / weight.sum())[:, None]).sum(axis=0)
                low += len(own)
                p = softmax(mean[None].astype(float))[0]
                names[i], scores[i] = self.model.languages[int(p.argmax())], float(p.max())

        for i, text in enumerate(texts):
            if not isinstance(text, str) or not self.model.languages or not any(map(str.isalpha, text)):
                continue
            raw = text.encode("utf-8", "replace")
            waiting.append((i, raw))
            size += len(raw)
            if size > 1 << 20:
                flush()
                waiting, size = [], 0
        if waiting:
            flush()
        return pd.DataFrame({"lang_pred": names, "score": scores})


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _pieces() -> Column:
    """Pieces of ``WINDOW`` characters from places anywhere in the text, drawn by hash."""
    places = F.sequence(F.lit(0), F.floor((F.greatest(F.char_length("text"), F.lit(1)) - 1) / WINDOW).cast("int"))
    drawn = F.slice(F.array_sort(F.transform(places, lambda i: F.struct(F.xxhash64("doc_id", i).alias("h"), i.alias("i")))), 1, SAMPLE_PIECES)
    return F.transform(drawn, lambda d: F.substring("text", d["i"] * WINDOW + 1, F.lit(WINDOW)))


def fit(docs: DataFrame, rows_per_language: int = SAMPLE_ROWS) -> Model:
    """Train on a bounded sample of labelled documents that are not held out.

    Counts per language give the share of rows to keep by hash, so about
    ``rows_per_language`` texts of each are sampled. Of ``SAMPLE_PIECES`` places of such a
    text, drawn by hash from all of it, ``WINDOW`` characters reach the driver. At most
    ``MOST_LANGUAGES`` languages are told apart; more are an error.
    """
    usable = docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = usable.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not counts:
        return train([], [], steps=0)
    share = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(1.0, rows_per_language / r["count"]))])
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    sample = (usable.where(place < share[F.col("lang")]).orderBy(place, "doc_id").limit(2 * rows_per_language * len(counts))
              .select(_pieces().alias("pieces"), "lang").collect())
    kept = [(piece, r["lang"]) for r in sample for piece in r["pieces"] if any(map(str.isalpha, piece))]
    return train([t for t, _ in kept], [label for _, label in kept])


def prediction(model: Model):
    """A column function: text -> struct(lang_pred, score), in Arrow batches."""
    @F.pandas_udf("lang_pred string, score double")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for texts in batches:
            yield scorer.predict(texts.tolist())

    return apply.asNondeterministic()  # evaluated once


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row of ``docs``; without ``model`` one is fitted first.

    * A null text, or one without a letter, is ``und`` with score 0; so is every text if
      there is no labelled row to learn from.
    * Whole texts are read in windows; a text of any length needs the memory of its own bytes.
    * A null doc_id is not held out. Repeated rows get equal predictions.
    * lang, source and doc_id are no input of a prediction; further columns are not read.
    * More than ``MOST_LANGUAGES`` labelled languages are an error.
    """
    model = model or fit(docs)
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), prediction(model)("text").alias("_p")).select(
        "doc_id", "held_out", "_p.lang_pred", "_p.score")


def keep_identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` with a language: texts that are null or have no letter go.

    Rows pass through as Arrow batches and are filtered there, so no column is held twice.
    Where nothing can be learnt, for want of labelled rows, every text with a letter stays.
    Repeated rows stay or go together; all columns are kept, whatever their names. No rows:
    no result.
    """
    model = model or fit(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for part in _parts(batch, at):
                named = scorer.predict(part.column(at).to_pylist())["lang_pred"]
                yield part.filter(pa.array((named != UNKNOWN).to_numpy(bool)))

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def _parts(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``BLOCK_BYTES`` of text each."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(at)), 0), np.int64))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + BLOCK_BYTES, "right")))
        yield batch.slice(low, high - low)
        low = high
