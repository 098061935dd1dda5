"""Language identification by a convolutional network over bytes.

The network embeds bytes, slides filters of several widths over a window of fixed length, keeps each filter's
greatest response, and maps those to languages by a softmax layer. It is trained in numpy with Adam on
windows from a bounded sample of labelled texts (PER_LANGUAGE texts, WINDOWS_PER_TEXT windows of each). Letters
A-Z are lowered and digits are one byte, in training and in use.

A text is cut into windows, the last one filled up with spaces; its languages' probabilities are the means
over its windows, weighted by the bytes that the window has of the text. Because a filter is linear before
pooling, its responses come from tables over pairs of neighbouring bytes, which each worker builds once.

Cases: null texts and texts without a letter are `und` with score 0, as are all texts if nothing is labelled.
Every byte of a text counts, however long it is. Repeated rows are rows of their own. An empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import bounded, crc_mod, frugal, slices, uniform
from gleaner.session import ship

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS, EMBEDDING = 16, 12
#: The bound of the training sample: texts of each language, of all languages, and windows of a text.
PER_LANGUAGE, TEXTS, WINDOWS_PER_TEXT = 400, 40_000, 3
EPOCHS, BATCH, RATE, SEED = 6, 64, 0.01, 11

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_FOLD[0x30:0x3A] = 0x30
_FOLD[[9, 10, 11, 12, 13]] = 0x20


def windows_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of all texts, a row each; where each text's begin; the text's bytes in each window."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    _, offsets, data = texts.buffers()
    first = np.frombuffer(offsets, np.int32)[texts.offset] if len(texts) else 0
    letters = _FOLD[np.frombuffer(data or b"", np.uint8)[first : first + sizes.sum()]]
    counts = -(-sizes // WINDOW)
    begins = np.concatenate(([0], np.cumsum(counts)))
    grid = np.full(begins[-1] * WINDOW, 0x20, np.uint8)
    grid[np.arange(len(letters)) + np.repeat(begins[:-1] * WINDOW - (np.cumsum(sizes) - sizes), sizes)] = letters
    filled = np.full(begins[-1], WINDOW)
    some = counts > 0
    filled[begins[1:][some] - 1] = sizes[some] - (counts[some] - 1) * WINDOW
    return grid.reshape(-1, WINDOW), begins, filled


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Network:
    """Weights: bytes' embedding, a (width, embedding, filters) array for each width, biases, output layer."""

    def __init__(self, languages: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        self.languages = languages
        n = FILTERS * len(WIDTHS)
        self.weights = {"embedding": draw(256, EMBEDDING), "bias": np.zeros(n, np.float32), "out": draw(n, len(languages)), "out_bias": np.zeros(len(languages), np.float32)}
        self.weights |= {f"filter{w}": draw(w, EMBEDDING, FILTERS) for w in WIDTHS}
        self._tables: dict | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tables": None}

    def _by_byte(self, width: int) -> np.ndarray:
        """What each byte adds to each filter at each of its places."""
        return self.weights["embedding"] @ self.weights[f"filter{width}"]

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        pooled, places = [], []
        for w in WIDTHS:
            table = self._by_byte(w)
            responses = sum(table[j][x[:, j : WINDOW - w + 1 + j]] for j in range(w))
            at = responses.argmax(axis=1)
            places.append(at)
            pooled.append(np.take_along_axis(responses, at[:, None], 1)[:, 0])
        return np.concatenate(pooled, axis=1) + self.weights["bias"], places

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy. Only the place of a filter's greatest response gets a share."""
        pooled, places = self._forward(x)
        active = np.maximum(pooled, 0)
        error = _softmax(active @ self.weights["out"] + self.weights["out_bias"])
        error[np.arange(len(y)), y] -= 1
        error /= len(y)
        grads = {"out": active.T @ error, "out_bias": error.sum(axis=0)}
        back = (error @ self.weights["out"].T) * (pooled > 0)
        grads["bias"] = back.sum(axis=0)
        embedding = np.zeros_like(self.weights["embedding"])
        row = np.arange(len(x))[:, None]
        for i, w in enumerate(WIDTHS):
            part, filters = back[:, i * FILTERS : (i + 1) * FILTERS], self.weights[f"filter{w}"]
            grad = np.zeros_like(filters)
            for j in range(w):
                seen = x[row, places[i] + j]
                grad[j] = np.einsum("bfe,bf->ef", self.weights["embedding"][seen], part)
                np.add.at(embedding, seen, part[:, :, None] * filters[j].T[None])
            grads[f"filter{w}"] = grad
        return grads | {"embedding": embedding}

    def fit(self, x: np.ndarray, y: np.ndarray, *, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Network:
        rng, step = np.random.default_rng(seed), 0
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                step += 1
                for k, g in self.gradients(x[order[at : at + BATCH]], y[order[at : at + BATCH]]).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.weights[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        self._tables = None
        return self

    def tables(self) -> dict:
        """Responses by pairs of bytes: a filter of width w is cut into pairs and, if w is odd, a last byte."""
        if self._tables is None:
            self._tables = {}
            for w in WIDTHS:
                table = self._by_byte(w)
                pairs = [(table[j][:, None, :] + table[j + 1][None, :, :]).reshape(-1, FILTERS) for j in range(0, w - 1, 2)]
                self._tables[w] = pairs, (table[w - 1] if w % 2 else None)
        return self._tables

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of each language, for each window."""
        out = np.empty((len(x), len(self.languages)), np.float32)
        for at in range(0, len(x), 128):
            part = x[at : at + 128]
            pair = part[:, :-1].astype(np.int32) << 8 | part[:, 1:]
            pooled = []
            for w, (pairs, last) in self.tables().items():
                n = WINDOW - w + 1
                responses = pairs[0][pair[:, :n]]
                for j, table in enumerate(pairs[1:], 1):
                    responses += table[pair[:, 2 * j : 2 * j + n]]
                if last is not None:
                    responses += last[part[:, w - 1 : w - 1 + n]]
                pooled.append(responses.max(axis=1))
            active = np.maximum(np.concatenate(pooled, axis=1) + self.weights["bias"], 0)
            out[at : at + 128] = _softmax(active @ self.weights["out"] + self.weights["out_bias"])
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str | None], np.ndarray]:
        """The language of each text and its mean probability; None for an empty text."""
        x, begins, filled = windows_of(texts)
        n = len(begins) - 1
        best, score = [None] * n, np.zeros(n)
        some = np.flatnonzero(np.diff(begins))
        if len(some):
            weighted = self.probabilities(x).astype(np.float64) * filled[:, None]
            mean = np.add.reduceat(weighted, begins[:-1][some]) / np.add.reduceat(filled, begins[:-1][some])[:, None]
            score[some] = np.clip(mean.max(axis=1), 0, 1)
            for i, k in zip(some.tolist(), mean.argmax(axis=1).tolist(), strict=True):
                best[i] = self.languages[k]
        return best, score


def train(docs: DataFrame, *, per_language: int = PER_LANGUAGE, seed: int = SEED) -> Network | None:
    """Learn from docs (doc_id, text, lang); None if no text has a letter and a language."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    n_languages = counts.count()
    if not n_languages:
        return None
    wanted = max(8, min(per_language, TEXTS // n_languages))
    sample = labelled.join(bounded(counts), "lang").filter(uniform(seed, F.col("doc_id")) < F.lit(float(wanted)) / F.col("n"))
    # about as many as wanted by their ids; no more, however often an id is repeated
    first = Window.partitionBy("lang").orderBy(F.xxhash64("text"), "doc_id")
    sample = sample.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= wanted)
    piece = F.explode(F.array(*[F.lit(k) for k in range(WINDOWS_PER_TEXT)]))
    place = lambda: (uniform(seed + 1, F.col("doc_id"), F.col("piece")) * F.greatest(F.length("text") - WINDOW + 1, F.lit(1))).cast("int") + 1
    rows = sample.withColumn("piece", piece).select("lang", "doc_id", "piece", F.col("text").substr(place(), F.lit(WINDOW)).alias("text"))
    rows = rows.toArrow().to_pandas().sort_values(["lang", "doc_id", "piece", "text"])  # bounded: per_language * WINDOWS_PER_TEXT windows of each language
    languages = sorted(rows["lang"].unique())
    x, begins, _ = windows_of(pa.array(rows["text"], pa.string()))
    there = np.flatnonzero(np.diff(begins))
    if not len(there):
        return None
    y = np.searchsorted(np.array(languages, object), rows["lang"].to_numpy(object))
    return Network(languages).fit(x[begins[:-1][there]], y[there])


def identify(docs: DataFrame, network: Network | None, *keep) -> DataFrame:
    """lang_pred and score of every text of docs, with the columns to keep."""
    spark = docs.sparkSession
    ship(spark)
    if network is None:
        return docs.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    rows = docs.select(*keep, F.when(F.col("text").rlike(r"\p{L}"), F.col("text").cast("string")).alias("text"))
    names = rows.columns[:-1]
    sent = spark.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2000, 2 << 20):
                best, score = sent.value.predict(part.column("text"))
                yield pa.record_batch([*[part.column(n) for n in names], pa.array([b or "und" for b in best], pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]]
    return rows.mapInArrow(frugal(run), ", ".join([*fields, "lang_pred string", "score double"]))


def train_and_identify(docs: DataFrame, *, mod: int = 4, held: int = 2) -> DataFrame:
    """Learn from the documents whose crc32(doc_id) mod some number isn't held, and identify all of them."""
    rest = crc_mod(F.col("doc_id"), mod)
    return identify(docs, train(docs.filter(rest != held)), F.col("doc_id").alias("doc_id"), (rest == held).alias("held_out"))
