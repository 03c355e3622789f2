"""LM scoring by masked pseudo-likelihood.

Every word of a text is predicted from the `RADIUS` words on both of its sides; a document's score is
the sum of these conditional log-probabilities.  Words fall into `CLASSES` classes by their frequency in
the corpus: the most frequent have classes of their own, the others share classes of about equal mass.

    log P(word | both sides) = log P(class | classes on both sides) + log P(word | class, neighbours' classes)

The first factor is a bidirectional window network (embeddings per place, a tanh layer, softmax),
trained in numpy on all windows of all documents, counted by class pattern.  The second one is counted:
how often the word stands between a left and a right neighbour of these classes, drawn towards its share
of its class by `PRIOR`.  The word that is being judged is left out of all these counts.

`word_scores` counts true words, each known by 64 bits, in tables that grow with the corpus:

* The `HEAD_WORDS` most frequent are sent to every task with their classes; all others are of the last
  class as context.  Their own counts stay exact.
* Counts of the `HOT_WORDS` most frequent between neighbours are sent along; all other words meet their
  occurrences in buckets of words, so a bucket holds no word of more than one in `HOT_WORDS` of all.

`score` is the coarse model with bounded tables: tokens are `ADDRESSES` addresses of word hashes, and
log P(token | class) knows no neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliplab.llm.words import Words, signed, word_chunks
from cliplab.session import cut_lineage

RADIUS = 2
CLASSES = 16
OWN_CLASSES = 8  # most frequent tokens with a class of their own; class 0 stands for "beyond the text"
ADDRESSES = 1 << 16
PLACES = 2 * RADIUS
SIDES = CLASSES**2  # classes of the left and the right neighbour
PATTERNS = CLASSES ** (PLACES + 1)
HEAD_WORDS = 200_000
HOT_WORDS = 4096
BUCKET_WORDS = 1 << 21
LEAST_BUCKETS = 32
PRIOR = 32.0


def tokens(words: Words) -> np.ndarray:
    return (words.hashes >> np.uint64(48)).astype(np.int64)


def class_of_tokens(counts: np.ndarray) -> np.ndarray:
    """Class from 1 to CLASSES - 1 of every token, by its count; ties by address."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    classes = np.empty(len(counts), dtype=np.int64)
    classes[order[:OWN_CLASSES]] = np.arange(1, OWN_CLASSES + 1)
    rest = order[OWN_CLASSES:]
    mass = np.cumsum(counts[rest] + 1e-9)
    shared = CLASSES - 1 - OWN_CLASSES
    classes[rest] = OWN_CLASSES + 1 + np.minimum((mass * shared / mass[-1]).astype(np.int64), shared - 1)
    return classes


def token_log_probability(counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """log P(token | class), add-one smoothed."""
    smooth = counts + 1.0
    return np.log(smooth / np.bincount(classes, smooth, CLASSES)[classes])


def patterns(classes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every word the number of its context (classes left to right, the word itself left out) and its own class."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    context = np.zeros(len(classes), dtype=np.int64)
    for shift in [*range(-RADIUS, 0), *range(1, RADIUS + 1)]:
        side = np.zeros(len(classes), dtype=np.int64)
        a, b = (slice(-shift, None), slice(None, shift)) if shift < 0 else (slice(None, -shift), slice(shift, None))
        side[a] = np.where(text[a] == text[b], classes[b], 0)
        context = context * CLASSES + side
    return context, classes


class WindowNetwork:
    """P(class | classes at the places of a window) from summed embeddings, tanh and softmax."""

    def __init__(self, hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        self.embeddings = rng.standard_normal((PLACES, CLASSES, hidden)) * 0.3
        self.bias = np.zeros(hidden)
        self.output = rng.standard_normal((hidden, CLASSES)) * 0.3
        self.output_bias = np.zeros(CLASSES)

    @property
    def parameters(self) -> list[np.ndarray]:
        return [self.embeddings, self.bias, self.output, self.output_bias]

    @staticmethod
    def places(context: np.ndarray) -> np.ndarray:
        return np.stack([context // CLASSES ** (PLACES - 1 - p) % CLASSES for p in range(PLACES)])

    def log_probabilities(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.places(context)
        hidden = np.tanh(sum(self.embeddings[p, at[p]] for p in range(PLACES)) + self.bias)
        logits = hidden @ self.output + self.output_bias
        logits[:, 0] = -np.inf  # no word is of class 0
        top = logits.max(axis=1, keepdims=True)
        return logits - top - np.log(np.exp(logits - top).sum(axis=1, keepdims=True)), hidden

    def fit(self, context: np.ndarray, target: np.ndarray, count: np.ndarray, epochs: int, rate: float = 0.02, batch: int = 4096) -> None:
        """Adam on the cross-entropy of counted examples, in an order fixed by the seed of their shuffle."""
        seen, index = np.unique(context, return_inverse=True)
        order = np.random.default_rng(1).permutation(len(seen))
        goals = np.zeros((len(seen), CLASSES))
        np.add.at(goals, (index, target), count.astype(np.float64))
        first, second, turn = [np.zeros_like(p) for p in self.parameters], [np.zeros_like(p) for p in self.parameters], 0
        for _ in range(epochs):
            for i in range(0, len(order), batch):
                pick = order[i : i + batch]
                goal = goals[pick]
                mass = goal.sum(axis=1, keepdims=True)
                log_p, hidden = self.log_probabilities(seen[pick])
                d = (np.exp(log_p) * mass - goal) / mass.sum()
                dh = (d @ self.output.T) * (1 - hidden**2)
                de = np.zeros_like(self.embeddings)
                for p, at in enumerate(self.places(seen[pick])):
                    np.add.at(de[p], at, dh)
                turn += 1
                for w, g, m, v in zip(self.parameters, [de, dh.sum(axis=0), hidden.T @ d, d.sum(axis=0)], first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    w -= rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(ADDRESSES, dtype=np.int64)
    for batch in batches:
        for _, _, words in word_chunks(batch.column("text")):
            counts += np.bincount(tokens(words), minlength=ADDRESSES)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["token", "n"])


def _pattern_counts(classes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.int64)]
            for _, _, words in word_chunks(batch.column("text")):
                context, own = patterns(classes[tokens(words)], words.first)
                found.append(context * CLASSES + own)
            pattern, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pattern), pa.array(n)], ["pattern", "n"])

    return run


def _scores(classes: np.ndarray, of_class: np.ndarray, of_token: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_tokens, total = np.zeros(len(batch), dtype=np.int64), np.zeros(len(batch))
            for i, j, words in word_chunks(batch.column("text")):
                token = tokens(words)
                context, own = patterns(classes[token], words.first)
                gain = of_class[context, own] + of_token[token]
                n_tokens[i:j] = np.diff(words.first)
                sums = np.concatenate(([0.0], np.cumsum(gain, dtype=np.float64)))
                total[i:j] = sums[words.first[1:]] - sums[words.first[:-1]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_tokens), pa.array(total)], ["doc_id", "n_tokens", "log_probability"]
            )

    return run


def train(docs: DataFrame, hidden: int = 24, epochs: int = 20, seed: int = 9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of tokens, log P(class | context) for every context, log P(token | class)."""
    texts = docs.select("text")
    counted = texts.mapInArrow(_token_counts, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(ADDRESSES)
    counts[counted["token"]] = counted["n"]
    classes = class_of_tokens(counts)
    seen = texts.mapInArrow(_pattern_counts(classes), "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    table = seen.toPandas().sort_values("pattern")
    network = WindowNetwork(hidden, seed)
    pattern = table["pattern"].to_numpy(dtype=np.int64)
    if len(pattern):
        network.fit(pattern // CLASSES, pattern % CLASSES, table["n"].to_numpy(), epochs)
    # the inputs are few enough to ask the network for all of them once
    of_class = np.concatenate([network.log_probabilities(c)[0] for c in np.array_split(np.arange(CLASSES**PLACES), 16)])
    return classes, of_class.astype(np.float32), token_log_probability(counts, classes).astype(np.float32)


def score(docs: DataFrame, hidden: int = 24, epochs: int = 20, seed: int = 9) -> DataFrame:
    """doc_id, n_tokens, log_probability, mean_log_probability per row of `docs`.

    Tokens are words between ASCII white space of the whole text; a null or word-less text has 0
    tokens, log_probability 0 and a null mean.  Ids may be null or repeat; other columns are dropped.
    """
    model = train(docs, hidden, epochs, seed)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded: CLASSES ** (PLACES + 1) and ADDRESSES numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _scores(*shared.value)(batches)

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, log_probability double")
    mean = F.when(F.col("n_tokens") > 0, F.col("log_probability") / F.col("n_tokens"))
    return scored.withColumn("mean_log_probability", mean)


def _hash_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.zeros(0, np.uint64)] + [words.hashes for _, _, words in word_chunks(batch.column("text"))]
        word, n = np.unique(np.concatenate(found), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(signed(word)), pa.array(n)], ["word", "n"])


class Vocabulary:
    """Classes of true words: the head's one by one, the last class for all others."""

    def __init__(self, word: np.ndarray, n: np.ndarray, n_words: int, n_kinds: int):
        order = np.lexsort((word, -n))
        mass = np.cumsum(n[order][OWN_CLASSES:])
        rest = max(n_words - int(n[order][:OWN_CLASSES].sum()), 1)
        shared = CLASSES - 1 - OWN_CLASSES
        classes = np.arange(1, len(word) + 1)
        classes[OWN_CLASSES:] = OWN_CLASSES + 1 + np.minimum(mass * shared // rest, shared - 1)
        hot = np.arange(len(word))
        hot[HOT_WORDS:] = -1
        by_word = np.argsort(word[order], kind="stable")
        self.word, self.classes, self.hot = word[order][by_word], classes[by_word], hot[by_word]
        self.n_hot = n[order][:HOT_WORDS].astype(np.float64)
        self.class_hot = classes[:HOT_WORDS]
        #: words, and different words, of every class
        self.mass = np.bincount(classes, n[order], CLASSES)
        self.kinds = np.bincount(classes, minlength=CLASSES).astype(np.float64)
        self.mass[-1] += n_words - n.sum()
        self.kinds[-1] += n_kinds - len(n)

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class, and number among the hot words or -1, of every word."""
        if not len(self.word):
            return np.full(len(hashes), CLASSES - 1), np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.word, hashes), len(self.word) - 1)
        known = self.word[at] == hashes
        return np.where(known, self.classes[at], CLASSES - 1), np.where(known, self.hot[at], -1)


def sides(context: np.ndarray) -> np.ndarray:
    """The classes of both neighbours of a word as one number."""
    return context // CLASSES % SIDES


def word_log_probability(n: np.ndarray, between: np.ndarray, own: np.ndarray, side: np.ndarray, vocabulary: Vocabulary, by_side: np.ndarray) -> np.ndarray:
    """log P(word | class, neighbours' classes) of words found `n` times, `between` times there; one occurrence is left out."""
    share = n / (vocabulary.mass[own] - 1 + vocabulary.kinds[own])
    return np.log((between - 1 + PRIOR * share) / (by_side[side, own] - 1 + PRIOR))


def _window_counts(vocabulary: Vocabulary):
    """Class patterns, and from PATTERNS on the hot words between their neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.int64)]
            for _, _, words in word_chunks(batch.column("text")):
                own, hot = vocabulary.of(words.hashes)
                context, _ = patterns(own, words.first)
                found += [context * CLASSES + own, (PATTERNS + hot * SIDES + sides(context))[hot >= 0]]
            key, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

    return run


def word_model(docs: DataFrame, hidden: int = 24, epochs: int = 20, seed: int = 9) -> tuple[Vocabulary, np.ndarray, np.ndarray, np.ndarray]:
    """Vocabulary, log P(class | context), counts by (neighbours, class), log P(hot word | class, neighbours)."""
    texts = docs.select("text")
    counted = cut_lineage(texts.mapInArrow(_hash_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    # different counts are few: at most about the square root of twice the words
    kinds = counted.groupBy("n").agg(F.count(F.lit(1)).alias("kinds")).toPandas().sort_values("n", ascending=False)
    n_words = int((kinds["n"] * kinds["kinds"]).sum())
    fits = kinds["n"][kinds["kinds"].cumsum() <= HEAD_WORDS]
    head = counted.filter(F.col("n") >= int(fits.min())).toPandas() if len(fits) else counted.limit(0).toPandas()
    word, n = head["word"].to_numpy(dtype=np.int64).view(np.uint64), head["n"].to_numpy(dtype=np.int64)
    vocabulary = Vocabulary(word, n, n_words, int(kinds["kinds"].sum()))

    windows = texts.mapInArrow(_window_counts(vocabulary), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    key, n = windows["key"].to_numpy(dtype=np.int64), windows["n"].to_numpy(dtype=np.float64)
    order = np.argsort(key)
    key, n = key[order], n[order]
    pattern, times = key[key < PATTERNS], n[key < PATTERNS]
    network = WindowNetwork(hidden, seed)
    if len(pattern):
        network.fit(pattern // CLASSES, pattern % CLASSES, times, epochs)
    of_class = np.concatenate([network.log_probabilities(c)[0] for c in np.array_split(np.arange(CLASSES**PLACES), 16)])
    by_side = np.bincount(sides(pattern // CLASSES) * CLASSES + pattern % CLASSES, times, SIDES * CLASSES).reshape(SIDES, CLASSES)
    of_hot = np.zeros((len(vocabulary.n_hot), SIDES), dtype=np.float32)
    hot, side = np.divmod(key[key >= PATTERNS] - PATTERNS, SIDES)
    of_hot[hot, side] = word_log_probability(vocabulary.n_hot[hot], n[key >= PATTERNS], vocabulary.class_hot[hot], side, vocabulary, by_side)
    return vocabulary, of_class.astype(np.float32), by_side, of_hot


_PARTS = "bucket long, key long, doc_id long, n_tokens long, total double, words binary, counts binary, docs binary, sides binary"


def _parts(vocabulary: Vocabulary, of_class: np.ndarray, of_hot: np.ndarray, buckets: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document with what is known here, and rows of other words with their places, packed by bucket."""
    key = TaskContext.get().partitionId() << 33
    for batch in batches:
        n_tokens, total = np.zeros(len(batch), dtype=np.int64), np.zeros(len(batch))
        word, doc, side = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j, words in word_chunks(batch.column("text")):
            own, hot = vocabulary.of(words.hashes)
            context, _ = patterns(own, words.first)
            at, here = sides(context), np.repeat(np.arange(i, j), np.diff(words.first))
            gain, known = of_class[context, own].astype(np.float64), hot >= 0
            gain[known] += of_hot[hot[known], at[known]]
            n_tokens[i:j] = np.diff(words.first)
            total[i:j] = np.bincount(here - i, gain, j - i)
            word.append(words.hashes[~known])
            doc.append(here[~known])
            side.append(at[~known])
        words, docs, at = np.concatenate(word), np.concatenate(doc), np.concatenate(side)
        bucket = (words % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((words, bucket))
        rows: list[tuple] = [
            ((key + d) % buckets, key + d, i.as_py(), int(n), float(t), None, None, None, None)
            for d, (i, n, t) in enumerate(zip(batch.column("doc_id"), n_tokens, total, strict=True))
        ]
        edges = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        for own in np.split(order, edges[1:]) if len(order) else ():
            kinds, counts = np.unique(words[own], return_counts=True)
            packed = kinds.astype("<u8").tobytes(), counts.astype("<u4").tobytes(), docs[own].astype("<u4").tobytes(), at[own].astype("u1").tobytes()
            rows.append((int(bucket[own[0]]), key, None, 0, 0.0, *packed))
        kinds = [*[pa.int64()] * 4, pa.float64(), *[pa.binary()] * 4]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 9
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [f.split()[0] for f in _PARTS.split(", ")])
        key += len(batch)


def _bucket_sums(vocabulary: Vocabulary, by_side: np.ndarray, group: pd.DataFrame) -> pd.DataFrame:
    """The rows of documents as they are, and per document the sum over its words of this bucket."""
    whole = group["words"].isna()
    packed, out = group[~whole], group.loc[whole, ["key", "doc_id", "n_tokens", "total"]].astype({"doc_id": "Int64"})
    if not len(packed):
        return out
    read = lambda name, kind: np.frombuffer(b"".join(packed[name]), kind).astype(np.int64)
    words = np.repeat(np.frombuffer(b"".join(packed["words"]), "<u8"), read("counts", "<u4"))
    at = read("sides", "u1")
    keys = np.repeat(packed["key"].to_numpy(dtype=np.int64), packed["sides"].map(len)) + read("docs", "<u4")
    kinds, which, n = np.unique(words, return_inverse=True, return_counts=True)
    _, pair, between = np.unique(which * SIDES + at, return_inverse=True, return_counts=True)
    own, _ = vocabulary.of(kinds)
    gain = word_log_probability(n[which], between[pair], own[which], at, vocabulary, by_side)
    docs, place = np.unique(keys, return_inverse=True)
    sums = pd.DataFrame({"key": docs, "doc_id": pd.array([None] * len(docs), dtype="Int64"), "n_tokens": 0, "total": np.bincount(place, gain)})
    return pd.concat([out, sums]) if len(out) else sums


def word_scores(docs: DataFrame, hidden: int = 24, epochs: int = 20, seed: int = 9) -> DataFrame:
    """As `score`, with true words, each predicted from both sides by counts that grow with the corpus."""
    model = word_model(docs, hidden, epochs, seed)
    buckets = max(LEAST_BUCKETS, int(model[0].mass.sum()) // BUCKET_WORDS)
    # bounded: HEAD_WORDS, HOT_WORDS * SIDES and CLASSES ** (PLACES + 1) numbers
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, of_class, _, of_hot = shared.value
        yield from _parts(vocabulary, of_class, of_hot, buckets, batches)

    def sums(group: pd.DataFrame) -> pd.DataFrame:
        vocabulary, _, by_side, _ = shared.value
        return _bucket_sums(vocabulary, by_side, group)

    found = docs.select("doc_id", "text").mapInArrow(parts, _PARTS).groupBy("bucket")
    added = found.applyInPandas(sums, "key long, doc_id long, n_tokens long, total double").groupBy("key").agg(
        F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.round(F.sum("total"), 9).alias("log_probability")
    )
    mean = F.when(F.col("n_tokens") > 0, F.col("log_probability") / F.col("n_tokens"))
    return added.select("doc_id", "n_tokens", "log_probability", mean.alias("mean_log_probability"))
