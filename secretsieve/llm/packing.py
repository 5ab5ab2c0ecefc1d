"""Order-preserving packing of documents into fixed-length token sequences.

Documents are tokenized and laid end to end in the order of the input's
splits.  Every split is one stream that is cut into windows of at most
``length`` tokens.  A dynamic program over the allowed cuts (ends of documents,
ends of sentences, and in stretches without either one position in every
64th of a window) minimises padding plus a penalty per cut.  The transition
takes the least ``cost + position`` among the cuts of the last ``length``
tokens, which a monotone queue holds, so a block takes linear time.  A window
whose length is a power of two needs no padding; such transitions are looked up.

Nothing is shuffled: a task reads its split once, keeps at most one block of
tokens, and a retried task reads the same split and gives the same rows.  The
input has to be a table (or another input whose splits do not change on retry).

Defined results: a null or empty text is its end token alone; a text longer
than a window takes several; repeated rows and repeated or null ids are
documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import os
from array import array
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import byte_texts, map_batches

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, `offset` long"
ARROW = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
])
# Shares of a window that a cut, or one window more, may cost in padding.
DOCUMENT_CUT, SENTENCE_CUT, WORD_CUT, WINDOW_COST = 0.0, 1 / 256, 1 / 64, 1 / 128
CACHED_WORDS, LONGEST_CACHED = 400_000, 64  # in each of two generations
# Neither letters nor digits, and in no added token; an apostrophe may begin a piece.
CLOSING = b".,!?;:$%&#*()[]{}+=/@^~-"
LATIN_END = "\u0250"


class Recent(dict):
    """Ids of parts, in two generations: what the young one lacks comes from the old one or is coded.  When
    the young one is full it becomes the old one, so frequent parts stay, whatever comes between."""

    def __init__(self, code: Callable[[bytes, Recent], bytes], old: dict):
        self.code, self.old = code, old

    def __missing__(self, part: bytes) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            ids = self.code(part, self)
        if len(part) <= LONGEST_CACHED:
            self[part] = ids
        return ids

    def aged(self) -> Recent:
        self.old = {}
        return Recent(self.code, self)


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space, ignores case and works word by word, so the ids of a
    text are those of its blank-separated parts, and those of a part are the ids of the
    part without its closing punctuation and of that punctuation.  Parts met before come
    out of a bounded cache.  A word of Latin letters goes to the tokenizer's model directly; all
    else goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        # How the model spells the bytes of Latin letters.
        self.spelling = {}
        for letter in map(chr, range(0x80, ord(LATIN_END))):
            self.spelling.update(zip(letter.encode(), spell(letter)[0][0]))
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.parts = Recent(self.code, {})
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.removesuffix("</w>")[-1:] in (".", "!", "?")
        self.added = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def code(self, part: bytes, known: Recent) -> bytes:
        """Ids of a new part."""
        if part.isalpha():  # bytes: plain letters only
            return array("I", [t.id for t in self.model.tokenize(part.decode().lower())]).tobytes()
        bare = part.rstrip(CLOSING)
        # Punctuation is a piece of its own only behind a letter.
        if len(bare) < len(part) and (bare[-1:].isalpha() or bare.decode("utf-8", "replace").lower()[-1:].isalpha()):
            return known[bare] + known[part[len(bare) :]]
        text = part.decode("utf-8", "replace")
        word = text.lower()
        # Latin letters only: one word, which normalising only turns into small letters.
        if word.isalpha() and max(word) < LATIN_END and len(word) == len(text):
            return array("I", [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.spelling))]).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, texts: list[bytes]) -> Iterator[bytes]:
        for text in texts:
            if len(self.parts) > CACHED_WORDS:
                self.parts = self.parts.aged()
            small = text.lower()  # bytes: plain letters only
            # Only the exact spelling of an added token is one.
            parts = (text if any(x in small for x in self.added) else small).split()
            yield b"".join(map(self.parts.__getitem__, parts))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cuts(places: np.ndarray, penalties: np.ndarray, length: int) -> tuple[list[float], list[int]]:
    """Least cost of a cut at every place, and the cut before it.

    ``places`` ascend from 0 and lie at most ``length`` apart.
    """
    n, window = len(places), WINDOW_COST * length
    where, fee = places.tolist(), penalties.tolist()
    exact: dict[int, list[int]] = {}
    size = 1
    while size < length:
        at = np.searchsorted(places, places - size)
        for j in np.flatnonzero((places >= size) & (places[at] == places - size)).tolist():
            exact.setdefault(j, []).append(int(at[j]))
        size *= 2
    cost, before = [0.0] * n, [0] * n
    queue: deque[tuple[int, float]] = deque([(0, 0.0)])
    for j in range(1, n):
        here = where[j]
        while where[queue[0][0]] < here - length:
            queue.popleft()
        i, least = queue[0]
        best = least + length - here
        for k in exact.get(j, ()):
            if cost[k] < best:
                i, best = k, cost[k]
        cost[j] = best = best + fee[j] + window
        before[j] = i
        key = best + here
        while queue and queue[-1][1] > key:
            queue.pop()
        queue.append((j, key))
    return cost, before


def allowed(ids: np.ndarray, ends: np.ndarray, sentence_end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a block may be cut, with penalties in tokens.  ``ends``: ends of documents."""
    fee, stride = np.full(len(ids) + 1, -1.0), max(1, length // 64)
    fee[np.flatnonzero(sentence_end[ids]) + 1] = SENTENCE_CUT * length
    fee[ends] = DOCUMENT_CUT * length
    fee[0] = 0
    soft = np.flatnonzero(fee >= 0)
    gaps = np.diff(soft)
    for a, gap in zip(soft[:-1][gaps > stride].tolist(), gaps[gaps > stride].tolist()):
        fee[np.arange(a + stride, a + gap, stride)] = WORD_CUT * length
    places = np.flatnonzero(fee >= 0)
    return places, fee[places]


class Stream:
    """Windows over the documents of one split."""

    def __init__(self, length: int, block: int, sentence_end: np.ndarray, first: int):
        self.length, self.block, self.sentence_end, self.sequence = length, block, sentence_end, first
        self.waiting: list[tuple] = []  # (id, start, bytes, tokens of the whole document)
        self.tokens = 0

    def add(self, doc, coded: bytes) -> Iterator[tuple]:
        self.waiting.append((doc, 0, coded, len(coded) // 4))
        self.tokens += len(coded) // 4
        if self.tokens >= self.block:
            yield from self.flush(False)

    def flush(self, last: bool) -> Iterator[tuple]:
        if not self.waiting:
            return
        data = b"".join(x[2] for x in self.waiting)
        ids = np.frombuffer(data, dtype="<u4")
        ends = np.cumsum([len(x[2]) // 4 for x in self.waiting])
        places, fees = allowed(ids, ends, self.sentence_end, self.length)
        cost, before = cuts(places, fees, self.length)
        j = len(places) - 1
        if not last:  # the next block goes on from the best cut near the end
            near = int(np.searchsorted(places, len(ids) - self.length, side="right"))
            if near <= j and near > 0:
                j = min(range(near, j + 1), key=lambda k: (cost[k], -k))
        bounds = [int(places[j])]
        while j:
            j = before[j]
            bounds.append(int(places[j]))
        bounds.reverse()
        if last:
            a, b = bounds[-2:] if len(bounds) > 1 else (0, 0)
            left, bounds = b - a, bounds[:-1]
            if left != self.length and left & (left - 1):  # the tail is cut into powers of two, which take no padding
                for k in range(left.bit_length() - 1, -1, -1):
                    if left >> k & 1:
                        a += 1 << k
                        bounds.append(a)
            else:
                bounds.append(b)
        starts = np.concatenate(([0], ends))
        for a, b in zip(bounds, bounds[1:]):
            d, offset = int(np.searchsorted(ends, a, side="right")), 0
            while a < b:
                doc, start, coded, n = self.waiting[d]
                lo = a - int(starts[d])
                hi = min(b, int(ends[d])) - int(starts[d])
                yield doc, start + lo, hi - lo, coded[4 * lo : 4 * hi], n, self.sequence, offset
                offset, a, d = offset + hi - lo, a + hi - lo, d + 1
            self.sequence += 1
        done = bounds[-1]
        d = int(np.searchsorted(ends, done, side="right"))
        rest = self.waiting[d:]
        if rest and done > starts[d]:
            doc, start, coded, n = rest[0]
            cut = done - int(starts[d])
            rest[0] = (doc, start + cut, coded[4 * cut :], n)
        self.waiting, self.tokens = rest, sum(len(x[2]) // 4 for x in rest)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows), ARROW)], schema=ARROW)


def pack(
    df: DataFrame, tokenizer: str, *, length: int = 4096, end_id: int = 2, id_col: str = "doc_id",
    text_col: str = "text", windows_per_block: int = 64,
) -> DataFrame:
    """Pieces of documents in sequences of at most ``length`` tokens.

    ``tokenizer`` is the path of a tokenizer file that drops white space and
    codes word by word.  Columns: doc_id; start, the tokens of the document
    ahead of the piece; length; ids, little-endian unsigned 32-bit; doc_tokens,
    with the end token; sequence_id, unique in the result; offset in it.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        stream = Stream(length, windows_per_block * length, code.ends, TaskContext.get().partitionId() << 40)
        stop = np.array([end_id], dtype="<u4").tobytes()
        rows: list[tuple] = []
        for b in batches:
            for doc, coded in zip(b.column(0).to_pylist(), code(byte_texts(b.column(1)))):
                rows.extend(stream.add(doc, coded + stop))
                if len(rows) >= 500:
                    yield batch(rows)
                    rows = []
        while stream.waiting:
            rows.extend(stream.flush(True))
        if rows:
            yield batch(rows)

    return map_batches(df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")), run, PIECES)
