"""SentencePiece encoding and decoding by a streaming Viterbi search.

The lattice of a text has an edge for every vocabulary piece (and, where a character is in no piece,
its byte pieces).  The search walks the text once and keeps one surviving path per boundary for the
last `longest piece` boundaries only.  Whenever all paths that can still go on agree on a boundary,
the ids up to it are final: they are given out and forgotten.  Memory is that window, whatever the
length of the text.

Two kinds of models are read:

* unigram: a path's score is the sum of its pieces' scores; the best path survives.
* BPE: a path is admissible if merging the text of every two neighbouring pieces gives just these
  two; merges being ranked, every prefix then has exactly one admissible path, the one that
  merging yields, and it survives.  So ids equal those of the library for such a model.

A cut where no piece can span is a boundary of every path.  Texts are therefore searched in
stretches between such cuts, and the ids of stretches, mostly words, are remembered in a table of
bounded size per task.

Texts are taken as they are, apart from the leading space and the space mark of the model: the
models used here have no other normalisation (`load` refuses those that have).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructType

SPACE_MARK = "▁"
REMEMBERED = 600_000  # stretches that a Python worker keeps: some 140 MB
LONGEST_REMEMBERED = 64
ROWS = 256  # texts encoded before their ids are sent on
# Field numbers and model types of the model file
TRAINER, MODEL_TYPE, UNIGRAM, BPE = 2, 3, 1, 2
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: list[float]
    byte_ids: list[int]  # ids of the 256 byte pieces, empty without byte fallback
    plain: dict[str, int]  # pieces that text can match
    unigram: bool
    unknown: int
    longest: int = 1
    spans: frozenset[str] = frozenset()

    def __post_init__(self):
        self.longest = max([1, *map(len, self.plain)])
        self.spans = frozenset(p[i : i + 2] for p in self.plain for i in range(len(p) - 1))
        self.worst = min([0.0, *(self.scores[i] for i in self.plain.values())]) - 10.0


def load(path: str) -> Vocabulary:
    """Read a model file; the file is only needed where this is called (on the driver)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(n)]
    byte_ids = sorted((i for i in range(n) if model.is_byte(i)), key=lambda i: int(pieces[i][3:5], 16))
    plain = {p: i for i, p in enumerate(pieces) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
    probe = "a  b Åﬁ "
    if model.decode(model.encode(probe)) != probe:
        raise ValueError(f"{path} normalises its text; only models that keep it are supported")
    scores = [model.get_score(i) for i in range(n)]
    kind = _model_kind(model.serialized_model_proto())
    if kind not in (UNIGRAM, BPE):
        raise ValueError(f"{path} is neither a unigram nor a BPE model")
    return Vocabulary(pieces, scores, byte_ids, plain, kind == UNIGRAM, model.unk_id())


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Top-level fields of a protocol buffer: varints as numbers, the rest as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


def _model_kind(proto: bytes) -> int:
    trainer = next((value for number, value in _fields(proto) if number == TRAINER), b"")
    return next((value for number, value in _fields(trainer) if number == MODEL_TYPE), UNIGRAM)


class Encoder:
    """Streaming search over one vocabulary; `ids(text)` or, piecewise, `stream(characters)`."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.known: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        #: how ids read: bytes from 0x80 on stand as lone surrogates until a text is complete
        self.spelling = ["" for _ in vocabulary.pieces]
        for piece, i in vocabulary.plain.items():
            self.spelling[i] = piece.replace(SPACE_MARK, " ")
        for byte, i in enumerate(vocabulary.byte_ids):
            self.spelling[i] = chr(byte) if byte < 0x80 else chr(0xDC00 + byte)
        if not vocabulary.byte_ids:
            self.spelling[vocabulary.unknown] = " ⁇ "
        self.cut = re.compile(f"{SPACE_MARK}*[^{SPACE_MARK}]+|{SPACE_MARK}+")
        v = vocabulary
        #: words end where a space mark begins, if no piece has a mark after another character
        self.by_words = not any(s[1] == SPACE_MARK and s[0] != SPACE_MARK for s in v.spans)
        self.whole = {p: i for p, i in v.plain.items() if v.unigram or self._merged(p) == [i]}
        #: ends of pieces: their id where they are pieces themselves, else -1
        self.codes = {p[i:]: self.whole.get(p[i:], -1) for p in self.whole for i in range(len(p))}

    def _merged(self, text: str) -> list[int]:
        """Pieces that ranked merging makes of a short text: best score first, then leftmost."""
        v, parts = self.v, list(text)
        while len(parts) > 1:
            best = None
            for i in range(len(parts) - 1):
                piece = v.plain.get(parts[i] + parts[i + 1])
                if piece is not None and (best is None or v.scores[piece] > best[0]):
                    best = (v.scores[piece], i)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [v.plain.get(p, -1) for p in parts]

    def _follows(self, left: int, right: int) -> bool:
        """Whether merging the text of two pieces gives just these two; -1 is a character in no piece."""
        if left < 0 or right < 0:
            return True
        key = left << 32 | right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            found = self.pairs[key] = self._merged(self.v.pieces[left] + self.v.pieces[right]) == [left, right]
        return found

    def _spell(self, character: str) -> list[int]:
        return [self.v.byte_ids[b] for b in character.encode()] if self.v.byte_ids else [self.v.unknown]

    def _short(self, text: str) -> list[int]:
        """The search of `stream` for a BPE model over a stretch that fits into the window as a whole."""
        code_of, fits_of = self.codes.get, self.pairs.get
        lasts, sizes = [-1], [0]  # of the one path to every boundary; -2: no path
        for end in range(1, len(text) + 1):
            start = end - 1
            code = code_of(text[start])
            last = -1 if code is None else -2
            while code is not None:
                if code >= 0:
                    left = lasts[start]
                    if left >= 0:
                        fits = fits_of(left << 32 | code)
                        if fits or fits is None and self._follows(left, code):
                            last = code
                            break
                    elif left == -1:
                        last = code
                        break
                if start == 0:
                    break
                start -= 1
                code = code_of(text[start:end])
            lasts.append(last)
            sizes.append(end - start if last >= 0 else 1)
        out: list[int] = []
        end = len(text)
        while end > 0:
            out.extend((lasts[end],) if lasts[end] >= 0 else reversed(self._spell(text[end - 1])))
            end -= sizes[end]
        return out[::-1]

    def stream(self, characters: Iterable[str]) -> Iterator[int]:
        """Ids of a text given character by character, as soon as they are final."""
        v, whole, longest = self.v, self.whole, self.v.longest
        recent, end = "", 0  # the characters of the window; everything before is committed
        # per boundary of the window: (score, length of the last piece, its id), None if no path gets
        # there; id -1 stands for the beginning and for a character in no piece
        states: list[tuple[float, int, int] | None] = [(0.0, 0, -1)]
        for character in characters:
            recent += character
            end += 1
            best = None
            for size in range(1, min(longest, end) + 1):
                tail = recent[end - size :]
                if tail not in self.codes and size > 1:
                    break  # no piece ends like this, nor like anything longer
                piece, before = whole.get(tail), states[end - size]
                if before is None:
                    continue
                if piece is None:
                    if size > 1 or character in v.plain:
                        continue
                    piece, score = -1, before[0] + v.worst
                elif v.unigram:
                    score = before[0] + v.scores[piece]
                elif self._follows(before[2], piece):
                    score = before[0]
                else:
                    continue
                if best is None or score > best[0]:
                    best = (score, size, piece)
            states.append(best)
            # paths go on from one of the last `longest` boundaries, or from the last but one at a cut
            cut = end > 1 and recent[-2:] not in v.spans
            if cut or end % longest == 0 and end > longest:
                agreed = self._agreed(states, end - 1 if cut else end - longest + 1, end)
                if agreed > 0:
                    yield from self._path(states, agreed, recent)
                    states = [(states[agreed][0], 0, states[agreed][2]), *states[agreed + 1 :]]
                    recent, end = recent[agreed:], end - agreed
        yield from self._path(states, end, recent)

    @staticmethod
    def _agreed(states: list, first: int, end: int) -> int:
        """The last boundary on which the surviving paths to the boundaries first..end agree."""
        heads = {b for b in range(first, end + 1) if states[b] is not None}
        while len(heads) > 1:
            far = max(heads)
            heads.remove(far)
            heads.add(far - states[far][1])
        return heads.pop() if heads else 0

    def _path(self, states: list, at: int, recent: str) -> list[int]:
        out: list[list[int]] = []
        while at > 0:
            _, size, piece = states[at]
            out.append([piece] if piece >= 0 else self._spell(recent[at - size : at]))
            at -= size
        return [i for ids in reversed(out) for i in ids]

    def ids(self, text: str) -> list[int]:
        if not text:
            return []
        marked = SPACE_MARK + text.replace(" ", SPACE_MARK)
        if not self.by_words:
            return list(self.stream(marked))
        stretches = self.cut.findall(marked)
        found = list(map(self.known.get, stretches))
        for i, ids in enumerate(found):
            if ids is None:
                found[i] = self._learn(stretches[i])
        return np.frombuffer(b"".join(found), np.int32).tolist()

    def _learn(self, stretch: str) -> bytes:
        short = len(stretch) <= LONGEST_REMEMBERED
        # a piece that merging makes of its own text is the one path
        if stretch in self.whole and not self.v.unigram:
            found = [self.whole[stretch]]
        else:
            found = self._short(stretch) if short and not self.v.unigram else self.stream(stretch)
        ids = np.fromiter(found, np.int32).tobytes()  # a few bytes, where whole numbers would take hundreds
        if short:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[stretch] = ids
        return ids

    def text(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, control pieces nothing."""
        joined = "".join(map(self.spelling.__getitem__, ids))
        text = joined.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


#: a Python worker serves many tasks and keeps what it has learned of words; one vocabulary at a time
_kept: dict[str, Encoder] = {}


def _encoder(vocabulary: Vocabulary) -> Encoder:
    name = f"{len(vocabulary.pieces)} {vocabulary.unigram} {hash(tuple(vocabulary.pieces))} {sum(vocabulary.scores)}"
    if name not in _kept:
        _kept.clear()
        _kept[name] = Encoder(vocabulary)
    return _kept[name]


def _lists(found: list[list[int]]) -> pa.ListArray:
    at = np.cumsum([0, *map(len, found)])
    values = np.fromiter(chain.from_iterable(found), np.int32, int(at[-1]))
    return pa.LargeListArray.from_arrays(pa.array(at), pa.array(values)).cast(pa.list_(pa.int32()))


def _encode(vocabulary: Vocabulary, names: list[str], check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for whole in batches:
            for i in range(0, len(whole), ROWS):
                batch = whole.slice(i, ROWS)
                texts = [t or "" for t in batch.column("text").to_pylist()]
                found = [encoder.ids(t) for t in texts]
                columns = [*(batch.column(c) for c in names), _lists(found)]
                if check:
                    columns.append(pa.array([encoder.text(ids) == t for t, ids in zip(texts, found, strict=True)]))
                yield pa.RecordBatch.from_arrays(columns, [*names, "ids", *["round_trip"] * check])

    return run


def _decode(vocabulary: Vocabulary, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            texts = [None if ids is None else encoder.text(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string())], [*names, "decoded"])

    return run


def encode(docs: DataFrame, model: str = MODEL, check: bool = False) -> DataFrame:
    """`docs` (text and any others) with `ids`, in place of a column of this name; null and empty texts have none.

    Characters outside the vocabulary become byte pieces, or the unknown piece without byte fallback.
    With `check`, `round_trip` tells whether the decoded ids are the text again (null: empty).
    """
    docs = docs.drop("ids", *["round_trip"] * check)
    kind = StructType([*docs.schema.fields]).add("ids", ArrayType(IntegerType()))
    kind = kind.add("round_trip", BooleanType()) if check else kind
    return docs.mapInArrow(_encode(load(model), docs.columns, check), kind)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """`encoded` (ids and any others) with `decoded`, the text of the ids, in place of a column of this name; null ids give null.

    decode(encode(text)) is the text, unless it holds the space mark U+2581 itself, which reads as a
    space, or the model has no byte pieces for its characters.
    """
    encoded = encoded.drop("decoded")
    kind = StructType([*encoded.schema.fields]).add("decoded", StringType())
    return encoded.mapInArrow(_decode(load(model), encoded.columns), kind)
