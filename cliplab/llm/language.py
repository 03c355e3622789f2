"""Language ID by a bidirectional gated recurrent network over UTF-8 bytes.

The network reads windows of `WINDOW` bytes in both directions and labels every byte; a document's
probabilities are the mean over all bytes of its whole text.  It is trained here, in numpy, by
backpropagation through time, on a bounded sample of labelled rows: `per_language` rows of each
language (chosen by hash) and a stretch of `STRETCH` characters of each at a hashed place.

Prediction is one narrow pass: no shuffle, windows of many texts run side by side as matrices, and
memory is bounded by blocks of windows, whatever the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from cliplab.llm.stored import private, quoted
from cliplab.llm.words import chunks, text_buffers

WINDOW = 64
STRETCH = 256
BLOCK = 2048  # windows side by side
UNKNOWN = "und"
ROWS_AT_ONCE = 1024  # rows predicted and sent back together
LANGUAGES = 1000  # most values of lang that are learnt


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + np.float32(0.5)


class Recurrent:
    """One direction: gates update, reset and candidate over byte inputs, h hidden units."""

    def __init__(self, rng: np.random.Generator, hidden: int):
        self.hidden = hidden
        self.inputs = (rng.standard_normal((256, 3 * hidden)) * 0.3).astype(np.float32)
        self.hidden_weights = (rng.standard_normal((hidden, 3 * hidden)) / np.sqrt(hidden)).astype(np.float32)

    @property
    def parameters(self) -> list[np.ndarray]:
        return [self.inputs, self.hidden_weights]

    def step(self, codes: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        n = self.hidden
        x, u = self.inputs[codes], h @ self.hidden_weights
        gates = _sigmoid(x[:, : 2 * n] + u[:, : 2 * n])
        update, reset = gates[:, :n], gates[:, n:]
        candidate = np.tanh(x[:, 2 * n :] + reset * u[:, 2 * n :])
        return candidate + update * (h - candidate), gates, candidate, u[:, 2 * n :]

    def run(self, codes: np.ndarray) -> np.ndarray:
        """Hidden states after every step; codes and states are time first."""
        out = np.empty((*codes.shape, self.hidden), dtype=np.float32)
        h = np.zeros((codes.shape[1], self.hidden), dtype=np.float32)
        for t in range(len(codes)):
            h = out[t] = self.step(codes[t], h)[0]
        return out

    def backward(self, codes: np.ndarray, states: np.ndarray, above: np.ndarray) -> list[np.ndarray]:
        """Gradients by backpropagation through time; `above` is the gradient at every state."""
        n = self.hidden
        d_inputs, d_hidden = np.zeros_like(self.inputs), np.zeros_like(self.hidden_weights)
        dh = np.zeros_like(states[0])
        for t in range(len(codes) - 1, -1, -1):
            h = states[t - 1] if t else np.zeros_like(dh)
            _, gates, candidate, u = self.step(codes[t], h)
            update, reset = gates[:, :n], gates[:, n:]
            dh = dh + above[t]
            d_candidate = dh * (1 - update) * (1 - candidate**2)
            d_update = dh * (h - candidate) * update * (1 - update)
            d_reset = d_candidate * u * reset * (1 - reset)
            d_x = np.concatenate([d_update, d_reset, d_candidate], axis=1)
            d_u = np.concatenate([d_update, d_reset, d_candidate * reset], axis=1)
            np.add.at(d_inputs, codes[t], d_x)
            d_hidden += h.T @ d_u
            dh = dh * update + d_u @ self.hidden_weights.T
        return [d_inputs, d_hidden]


class LanguageNetwork:
    def __init__(self, languages: list[str], hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.forward, self.reverse = Recurrent(rng, hidden), Recurrent(rng, hidden)
        self.output = (rng.standard_normal((2 * hidden, len(languages))) * 0.3).astype(np.float32)
        self.bias = np.zeros(len(languages), dtype=np.float32)

    @property
    def parameters(self) -> list[np.ndarray]:
        return [*self.forward.parameters, *self.reverse.parameters, self.output, self.bias]

    def labels(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of the languages at every byte, and the joined states; time first."""
        states = np.concatenate([self.forward.run(codes), self.reverse.run(codes[::-1])[::-1]], axis=2)
        logits = states @ self.output + self.bias
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits, states

    def fit(self, codes: np.ndarray, real: np.ndarray, target: np.ndarray, epochs: int, batch: int, rate: float, seed: int) -> None:
        """Adam on the mean cross-entropy of all real bytes; codes and real are (windows, time)."""
        rng = np.random.default_rng(seed)
        first = [np.zeros_like(p) for p in self.parameters]
        second = [np.zeros_like(p) for p in self.parameters]
        n, turn = self.forward.hidden, 0
        for _ in range(epochs):
            order = rng.permutation(len(codes))
            for i in range(0, len(order), batch):
                pick = order[i : i + batch]
                x, mask = np.ascontiguousarray(codes[pick].T), real[pick].T[:, :, None]
                p, states = self.labels(x)
                p[:, np.arange(len(pick)), target[pick]] -= 1
                d = (p * mask / mask.sum()).astype(np.float32)
                above = d @ self.output.T
                flat = states.reshape(-1, 2 * n)
                grads = [
                    *self.forward.backward(x, states[:, :, :n], above[:, :, :n]),
                    *self.reverse.backward(x[::-1], states[::-1, :, n:], above[::-1, :, n:]),
                    flat.T @ d.reshape(len(flat), -1), d.sum(axis=(0, 1)),
                ]
                turn += 1
                for w, g, m, v in zip(self.parameters, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean probabilities over all bytes of every text; an empty text has zeros."""
        sums = np.zeros((len(offsets) - 1, len(self.languages)))
        for i, j in chunks(offsets, BLOCK * WINDOW):
            codes, real, owner = windows(data, offsets[i : j + 1])
            for a in range(0, len(codes), BLOCK):
                p, _ = self.labels(np.ascontiguousarray(codes[a : a + BLOCK].T))
                p *= real[a : a + BLOCK].T[:, :, None]
                np.add.at(sums, owner[a : a + BLOCK] + i, p.sum(axis=0))
        return sums / np.maximum(np.diff(offsets), 1)[:, None]


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts cut into WINDOW bytes: codes, which bytes are real (the last window is filled up), owner of each window."""
    sizes = np.diff(offsets)
    per = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), per)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    at = offsets[:-1][owner] + within * WINDOW
    places = at[:, None] + np.arange(WINDOW)
    real = places < offsets[1:][owner][:, None]
    codes = np.where(real, data[np.minimum(places, max(len(data) - 1, 0))], 0) if len(owner) else np.zeros((0, WINDOW), np.uint8)
    return codes, real, owner


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, per_language: int, seed: int, languages: int = LANGUAGES) -> list[tuple[str, str]]:
    """(lang, stretch) of at most `per_language` labelled rows of each of the most frequent `languages`, chosen by hash.

    Languages are counted first, so that a frequent one sends about twice its quota to the ranking,
    not all its rows.
    """
    known = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id", F.length("text")), F.lit(1 << 30))
    known = known.select("doc_id", "lang", "text", draw.alias("draw"))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    near = known.join(F.broadcast(counts.orderBy(F.desc("n"), "lang").limit(languages)), "lang")
    near = near.filter(F.col("draw") * F.col("n") < F.lit(float((2 * per_language + 20) << 30)))
    begin = (F.col("draw") % F.greatest(F.length("text") - STRETCH, F.lit(1)) + 1).cast("int")
    near = near.select("lang", "draw", "doc_id", F.substring("text", begin, F.lit(STRETCH)).alias("stretch"))
    order = Window.partitionBy("lang").orderBy("draw", "doc_id", "stretch")
    picked = near.withColumn("i", F.row_number().over(order)).filter(F.col("i") <= per_language)
    return [(r["lang"], r["stretch"]) for r in picked.orderBy("lang", "i").collect()]


def train(sample: list[tuple[str, str]], hidden: int = 8, epochs: int = 10, seed: int = 5) -> LanguageNetwork | None:
    languages = sorted({lang for lang, _ in sample})
    if not languages:
        return None
    network = LanguageNetwork(languages, hidden, seed)
    data, offsets = text_buffers(pa.array([s for _, s in sample], pa.string()))
    codes, real, owner = windows(data, offsets)
    target = np.array([languages.index(lang) for lang, _ in sample])[owner]
    # small samples take more rounds, so that the number of steps stays alike
    rounds = epochs * max(1, min(8, 3000 // max(len(codes), 1)))
    network.fit(codes, real.astype(np.float32), target, rounds, batch=64 if len(codes) < 3000 else 128, rate=0.02, seed=seed)
    return network


def _predict(network: LanguageNetwork | None, names: list[str], lettered_col: str, added: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, ROWS_AT_ONCE) for whole in batches for i in range(0, whole.num_rows, ROWS_AT_ONCE)):
            lettered = batch.column(lettered_col).to_numpy(zero_copy_only=False)
            languages, scores = np.full(len(lettered), UNKNOWN, dtype=object), np.zeros(len(lettered))
            if network is not None and len(lettered):
                p = network.pooled(*text_buffers(batch.column("text")))
                best = p.argmax(axis=1)
                languages = np.where(lettered, np.array(network.languages, dtype=object)[best], UNKNOWN)
                scores = np.where(lettered, np.clip(p.max(axis=1), 0, 1), 0.0)
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(languages, pa.string()), pa.array(scores, pa.float64())], [*names, *added]
            )

    return run


def with_language(
    docs: DataFrame, per_language: int = 400, hidden: int = 8, epochs: int = 10, seed: int = 5, added: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """`docs` (doc_id, text, lang and any others) with the two `added` columns: prediction and its pooled probability.

    Columns that have these names already are replaced.

    Learns from rows outside the held-out third that have text and lang; predicts from text alone.
    The sample holds at most `per_language` rows of each of the LANGUAGES most frequent values of lang; this is what the driver
    trains on.  Texts that are null or have no letter, and all texts if there is nothing to learn from, get
    `und` with score 0.  Ties go to the language that sorts first.
    """
    network = train(training_sample(docs, per_language, seed), hidden, epochs, seed)
    docs = docs.drop(*added)
    names = docs.columns
    kind = StructType([*docs.schema.fields]).add(added[0], StringType()).add(added[1], DoubleType())
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    (column,) = private(docs, "lettered")
    return docs.withColumn(column, lettered).mapInArrow(_predict(network, names, column, added), kind)


def in_known_language(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """Rows of `docs` whose language is recognised with at least the given pooled probability.

    Columns are those of `docs`, whatever their names.  Null and letterless texts go; repeated rows are judged each.
    """
    lang, score = private(docs, "lang_pred", "lang_score")
    judged = with_language(docs, added=(lang, score))
    judged = judged.filter((F.col(lang) != UNKNOWN) & (F.col(score) >= least))
    return judged.select(*[F.col(quoted(c)) for c in docs.columns])
