"""Substring dedup: every word covered by a window of words that also starts earlier goes.

A window is `width` consecutive words of one text.  Rabin-Karp hashes, rolled over word hashes, stand
for windows; Spark brings equal ones together.  Of equal windows the one with the least (doc_id,
start) stays, the others are removed, and overlapping ones merge into maximal intervals.

Most windows of a corpus occur once.  So that these need no shuffle, windows are first told apart
by an anchor: the least hash among the half-width windows inside.  Equal windows have equal
anchors, neighbouring windows mostly share one, and about every sixth word is an anchor.  Only
windows whose anchor occurs twice are counted; this loses none.  They travel by their anchor, so
that neighbours stay together; anchor and window hash make 64 bits and the bucket's to tell them apart.

Hot passages: a batch of texts sends an anchor or a window once; its other occurrences in the
batch are known to be repeated (for windows: to start later) and travel under keys of their own.
So a passage that a third of all texts share meets as one row per batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cliplab.llm.words import Words, mix, signed, text_buffers, word_chunks

NO_ID = 2**62  # rows without doc_id come after all others, by a hash of their text; ids stay below
_ANCHOR_BASE = np.uint64(0xB5026F5AA96619E9)
BUCKET_BYTES = 1 << 20  # bytes of text whose repeated windows should meet in a task


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum over x[i : i + width], by doubling."""
    pick = np.minimum if least else np.maximum
    span = 1
    while span * 2 <= width:
        x = pick(x[:-span], x[span:])
        span *= 2
    return pick(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def _anchors(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash of the window from every word on, where it is complete; True at anchor positions; their hashes."""
    inner = (width + 1) // 2
    reach = width - inner + 1
    x = words.windows(inner, _ANCHOR_BASE)
    valid = words.complete(width)
    least = np.zeros(len(x), dtype=np.uint64)
    mark = np.zeros(len(x), dtype=bool)
    if len(x) >= width and valid.any():
        least[: len(x) - reach + 1] = _sliding(x, reach, True)
        least[~valid] = 0
        padded = np.concatenate((np.zeros(reach - 1, np.uint64), least))
        mark = (_sliding(padded, reach, False) == x) & (x != 0)
    return least, mark, x


def _owner(words: Words) -> np.ndarray:
    return np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))


def _send_anchors(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            values, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for i, _, words in word_chunks(batch.column(1)):
                _, mark, x = _anchors(words, width)
                values.append(x[mark])
                docs.append(_owner(words)[mark] + i)
            value, doc = np.concatenate(values), np.concatenate(docs)
            order = np.lexsort((doc, value))
            value, doc = value[order], doc[order]
            head = np.ones(len(value), dtype=bool)
            head[1:] = value[1:] != value[:-1]
            size = np.diff(np.append(np.flatnonzero(head), len(value)))
            known = np.repeat(size > 1, size)
            again = np.zeros(len(value), dtype=bool)  # the same anchor of the same text
            again[1:] = ~head[1:] & (doc[1:] == doc[:-1])
            value, doc, head, known = value[~again], doc[~again], head[~again], known[~again]
            ids = keys[doc].astype(np.int64) if len(doc) else np.zeros(0, np.int64)
            own = mix(value ^ mix(doc.astype(np.uint64) ^ mix(ids.view(np.uint64))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(np.where(head, value, own))), pa.array(signed(value)), pa.array(ids), pa.array(known)],
                ["key", "value", "__doc_key", "known"],
            )

    return run


def _consecutive(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """True where a window doesn't directly follow the one before it."""
    head = np.ones(len(doc), dtype=bool)
    head[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
    return head


def _send_windows(width: int, buckets: int):
    """Windows whose anchor is shared, packed by bucket of the anchor; and those known to start later (bucket -1).

    Equal windows have equal anchors and so meet in one bucket; neighbouring windows stay together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("__doc_key").to_numpy(zero_copy_only=False).astype(np.int64)
            lists = batch.column("__shared")
            at = np.asarray(lists.offsets)
            shared = np.asarray(lists.values).view(np.uint64)
            tags = np.zeros(len(ids), dtype=np.int64)
            parts: list[tuple[np.ndarray, ...]] = []
            for i, j, words in word_chunks(batch.column("text")):
                least, _, _ = _anchors(words, width)
                hashes = words.windows(width)
                for d in range(i, j):
                    a, b = words.first[d - i], words.first[d - i + 1]
                    own = least[a:b]
                    hit = np.flatnonzero((own != 0) & np.isin(own, shared[at[d] : at[d + 1]]))
                    tags[d] = _tag(words.hashes[a:b])
                    parts.append((mix(own[hit]) % np.uint64(buckets), hashes[a:b][hit], np.full(len(hit), d), hit))
            if not parts:
                continue
            bucket, hashes, doc, start = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((start, ids[doc], hashes))
            head = np.ones(len(order), dtype=bool)
            head[1:] = hashes[order][1:] != hashes[order][:-1]
            first = order[np.flatnonzero(head)[np.cumsum(head) - 1]] if len(order) else order
            later = np.zeros(len(order), dtype=bool)
            later[order] = (ids[doc[order]] != ids[doc[first]]) | (start[order] != start[first])
            bucket = np.where(later, -1, bucket.astype(np.int64))
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[order], prepend=-2))
            rows: list[tuple[int, bytes, bytes, bytes, bytes]] = []
            for own in np.split(order, edges[1:]) if len(order) else ():
                docs, index = np.unique(doc[own], return_inverse=True)
                named = np.stack([ids[docs], tags[docs]], axis=1)
                kept = hashes[own].tobytes() if bucket[own[0]] >= 0 else b""
                rows.append((int(bucket[own[0]]), named.tobytes(), index.astype(np.int32).tobytes(), start[own].astype(np.int32).tobytes(), kept))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])],
                ["bucket", "docs", "at", "start", "hash"],
            )

    return run


def _later_runs(width: int):
    """Runs of windows of one bucket that start later than an equal window, as intervals of words."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        named = [np.frombuffer(d, np.int64).reshape(-1, 2) for d in group["docs"]]
        at = [np.frombuffer(x, np.int32) for x in group["at"]]
        doc, tag = np.concatenate([n[i] for n, i in zip(named, at, strict=True)]).T
        start = np.concatenate([np.frombuffer(x, np.int32) for x in group["start"]]).astype(np.int64)
        if group["bucket"].iloc[0] >= 0:
            hashes = np.concatenate([np.frombuffer(x, np.uint64) for x in group["hash"]])
            order = np.lexsort((start, doc, hashes))
            hashes, doc, tag, start = hashes[order], doc[order], tag[order], start[order]
            head = np.ones(len(hashes), dtype=bool)
            head[1:] = hashes[1:] != hashes[:-1]
            first = np.flatnonzero(head)[np.cumsum(head) - 1]
            later = (doc != doc[first]) | (start != start[first])
            doc, tag, start = doc[later], tag[later], start[later]
        order = np.lexsort((start, tag, doc))
        doc, tag, start = doc[order], tag[order], start[order]
        apart = np.ones(len(doc), dtype=bool)
        apart[1:] = tag[1:] != tag[:-1]
        head = np.flatnonzero(apart | _consecutive(doc, start))
        last = np.append(head[1:], len(start))[: len(head)] - 1
        return pd.DataFrame({"__doc_key": doc[head], "tag": tag[head], "begin": start[head], "end": start[last] + width})

    return run


def _tag(hashes: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(mix(hashes + np.arange(len(hashes), dtype=np.uint64)))) & 0xFFFF


def _removals(keyed: DataFrame, width: int) -> DataFrame:
    """Per doc_key the intervals (tag, begin, end) of words to remove; `tag` tells texts under one id apart."""
    anchors = keyed.select("__doc_key", "text").mapInArrow(
        _send_anchors(width), "key long, value long, __doc_key long, known boolean"
    )
    met = F.count(F.lit(1)).over(Window.partitionBy("key"))
    shared = anchors.withColumn("met", met).filter("known OR met > 1").groupBy("__doc_key").agg(
        F.collect_list("value").alias("__shared")
    )
    volume = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    windows = keyed.join(shared, "__doc_key").mapInArrow(
        _send_windows(width, 1 + volume // BUCKET_BYTES), "bucket long, docs binary, at binary, start binary, hash binary"
    )
    # what a batch knows by itself is dealt out anew, row by row
    part = F.when(F.col("bucket") >= 0, F.lit(0).cast("long")).otherwise(F.xxhash64("docs", "start"))
    runs = windows.withColumn("part", part).groupBy("bucket", "part").applyInPandas(
        _later_runs(width), "__doc_key long, tag long, begin long, end long"
    )
    along = Window.partitionBy("__doc_key").orderBy("tag", "begin", "end")
    reached = F.max(F.struct("tag", "end")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    apart = (reached.getField("tag") != F.col("tag")) | (reached.getField("end") < F.col("begin"))
    runs = runs.withColumn("gap", F.coalesce(apart, F.lit(False)).cast("int"))
    runs = runs.withColumn("run", F.sum("gap").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("__doc_key", "run", "tag").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    return spans.groupBy("__doc_key").agg(F.collect_list(F.struct("tag", "begin", "end")).alias("__spans"))


def _kept_words(column: pa.Array, spans: pa.Array) -> Iterator[tuple[list[bytes], int]]:
    """For every text the words that stay, and how many there were."""
    data, offsets = text_buffers(column)
    for d, own in enumerate(spans.to_pylist()):
        words = data[offsets[d] : offsets[d + 1]].tobytes().split()
        n = len(words)
        if own:
            tag = _tag(Words(data, offsets[d : d + 2]).hashes)
            for s in sorted((s for s in own if s["tag"] == tag), key=lambda s: -s["begin"]):
                del words[s["begin"] : s["end"]]
        yield words, n


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(n, n - len(w), hashlib.sha256(b" ".join(w)).hexdigest()) for w, n in _kept_words(batch.column("text"), batch.column("__spans"))]
        n_words, n_removed, digest = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256"],
        )


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        old = batch.column("text")
        texts = [
            t if len(w) == n else pa.scalar(b" ".join(w).decode(), old.type)
            for t, (w, n) in zip(old, _kept_words(old, batch.column("__spans")), strict=True)
        ]
        at = batch.schema.get_field_index("text")
        out = batch.set_column(at, batch.schema.field(at), pa.array([t.as_py() for t in texts], old.type))
        yield out.drop_columns(["__spans"])


def _with_spans(docs: DataFrame, width: int) -> DataFrame:
    keyed = docs.withColumn("__doc_key", F.coalesce("doc_id", F.xxhash64("text").bitwiseAND(F.lit(NO_ID - 1)) + F.lit(NO_ID)))
    spans = _removals(keyed, width)
    return keyed.join(spans, "__doc_key", "left").drop("__doc_key")


def repeated_word_report(docs: DataFrame, width: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) per row.

    Words are cut at ASCII white space and compared unchanged.  Null texts have no words; texts of
    fewer words than `width` lose none.  Rows without doc_id come after all others, in the order of a hash of
    their text; ids are below 2**62.  Rows under one doc_id and start are equally early, so repeated rows (and rows
    without doc_id that are equal) keep what one of them would keep.
    """
    rows = docs.select("doc_id", "text")
    return _with_spans(rows, width).select("doc_id", "text", "__spans").mapInArrow(
        _report, "doc_id long, n_words long, n_removed long, kept_sha256 string"
    )


def without_repeated_words(docs: DataFrame, width: int = 20) -> DataFrame:
    """`docs` with the kept words in `text`, joined by one space; a text that loses nothing stays as it is.

    All rows and columns stay; a text may become empty, a null text stays null.
    """
    joined = _with_spans(docs, width).select(*docs.columns, "__spans")
    return joined.mapInArrow(_rewrite, docs.schema)
