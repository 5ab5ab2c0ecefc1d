"""Removal of repeated byte strings with two-stage suffix sorting.

A byte goes if a string of ``length`` bytes that covers it also starts earlier, in a
smaller document or further up in the same one.

Parting the work.  Suffixes that share ``length`` bytes have to meet, others need not.  Every
string of ``length`` bytes has a least hash among its 32-byte grams; equal strings agree in
it.  Neighbouring strings with the same least hash form a segment; its text, from the first
string's start to the last string's end, is a passage.  Documents are dealt to blocks, texts once.

1. A block sends the distinct least hashes of its segments to shards, with the number of their distinct passages. These answer
   which occur more than once (a hash from several places of one segment does), and whether more than ``shard_bytes``
   would come to them.  If so, their hashes are dealt to several parts, and a hash with half that much alone is heavy: its
   passages are cut into single strings, which are dealt by hashes of their own, so that only equal strings have to meet.
2. The block sends the passages of those segments, equal ones once, to the shards of their hashes.  A shard
   sorts the suffixes of its distinct passages in two stages: suffixes that are smaller than
   their successors are sorted directly, all others are induced from them by scanning the buckets of
   first bytes in order.  Adjacent common prefixes then give the groups of equal strings, and all but the first
   occurrence of each are reported, as bits per passage.
3. The block marks the reported strings and takes their bytes out.

A passage in a third of all documents is sent once per block and sorted once.  Depth of sorting is bounded by
``length``, a block by ``block_bytes`` (or one document), and a part of a shard by about ``shard_bytes``, as far as hashes deal
evenly and but for one string's copies, one from each block.

Blocks hash id and text, so rows with the same id, or none, are spread as all others.

Defined results: a null text is empty; texts shorter than ``length`` stay; rows with the same id are documents
of their own, in the order of a hash of their text; equal rows stand behind each other; null ids come last; cuts may
part a code point, so the bytes that are left are binary; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, small_batches, total
from .lm_scoring import expand, squeeze, steps

GRAM = 32
CHUNK = 1 << 20
PLACE = np.uint64((1 << 21) - 1)
BLOCK_BYTES, SHARD_BYTES = 8 << 20, 8 << 20
LAST = (1 << 63) - 1


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 32 bytes from every position, built by doubling."""
    h, factor, size = data.astype(np.uint64), 0x9E3779B97F4A7C15, 1
    while size < GRAM:
        h = h[:-size] * np.uint64(factor) + h[size:]
        h ^= h >> np.uint64(29)
        factor, size = factor * factor % (1 << 64), size * 2
    return mixed(h)


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` neighbours from every position."""
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def segments(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Least hash, first start, number of starts, and whether the least hash comes from several places, for the segments of one text."""
    hashes, starts, several, held = [np.array([], np.uint64)], [np.array([], np.int64)], [np.array([], bool)], 0
    for lo in range(0, len(data) - length + 1, CHUNK):
        h = gram_hashes(data[lo : lo + CHUNK + length - 1])
        # The leading bits decide, then the place: the first of equal hashes.
        tagged = h & ~PLACE | np.arange(len(h), dtype=np.uint64)
        place = (sliding_least(tagged, length - GRAM + 1) & PLACE).astype(np.int64)
        least = h[place]
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        moved = np.concatenate(([0], np.cumsum(place[1:] != place[:-1])))
        last = np.append(first[1:], len(least)) - 1
        hashes.append(least[first])
        starts.append(first + lo)
        several.append(moved[last] > moved[first])
        held = lo + len(least)
    start = np.concatenate(starts)
    return np.concatenate(hashes), start, np.diff(start, append=held), np.concatenate(several)


def rank_of(text: bytes) -> int:
    """Orders the rows of an id."""
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


class Texts:
    """The rows of a block in order, with their segments."""

    def __init__(self, table: pa.Table, length: int):
        rows = [(LAST if i is None else i, rank_of(x or b""), x or b"", i) for i, x in zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist())]
        rows.sort(key=lambda r: (r[3] is None, *r[:3]))
        self.ids = [r[3] for r in rows]
        self.texts = [r[2] for r in rows]
        found = [segments(np.frombuffer(x, dtype=np.uint8), length) for x in self.texts]
        self.hash = np.concatenate([f[0] for f in found])
        self.start = np.concatenate([f[1] for f in found])
        self.n = np.concatenate([f[2] for f in found])
        self.several = np.concatenate([f[3] for f in found])
        self.row = np.repeat(np.arange(len(rows)), [len(f[0]) for f in found])
        self.doc = np.array([r[0] for r in rows], dtype=np.int64)
        self.rank = np.array([r[1] for r in rows], dtype=np.int64)


def shard_of(hashes: np.ndarray, n_shards: int) -> np.ndarray:
    return (hashes >> np.uint64(40)).astype(np.int64) % n_shards


ASKED = "shard long, block int, hashes binary, again binary, passages binary"


def ask(table: pa.Table, length: int, n_shards: int) -> pa.Table:
    """Distinct least hashes of a block per shard, which of them it holds more than once, and the numbers of their distinct passages."""
    block = table.column("block")[0].as_py()
    texts = Texts(table, length)
    hashes, at = np.unique(texts.hash, return_inverse=True)
    times, n_passages = np.bincount(at, weights=1 + texts.several), np.ones(len(hashes), dtype="<i4")
    twice = np.flatnonzero(np.bincount(at)[at] > 1)
    ends = texts.start + texts.n + length - 1
    places = zip(at[twice].tolist(), texts.row[twice].tolist(), texts.start[twice].tolist(), ends[twice].tolist())
    several = {(i, texts.texts[row][a:z]) for i, row, a, z in places}
    n_passages += np.bincount([i for i, _ in several], minlength=len(hashes)).astype("<i4")
    n_passages[at[twice]] -= 1
    home, out = shard_of(hashes, n_shards), []
    for s in np.unique(home).tolist():
        at = home == s
        out.append((s, block, squeeze(steps(hashes[at])), np.packbits(times[at] > 1).tobytes(), squeeze(n_passages[at])))
    types = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=[c.split()[0] for c in ASKED.split(", ")])


def repeated(table: pa.Table, length: int, shard_bytes: int) -> pa.Table:
    """For every block that asked, which of its hashes occur more than once anywhere, apart for those that are heavy, and the
    number of parts that the shard is dealt to."""
    rows = table.to_pylist()
    hashes = [np.cumsum(expand(r["hashes"], "<u8"), dtype=np.uint64) for r in rows]
    again = [np.unpackbits(np.frombuffer(r["again"], dtype=np.uint8), count=len(h)) for r, h in zip(rows, hashes)]
    distinct, at = np.unique(np.concatenate(hashes), return_inverse=True)
    times = np.bincount(at, weights=1 + np.concatenate(again)) > 1
    passages = np.bincount(at, weights=np.concatenate([expand(r["passages"], "<i4") for r in rows])).astype(np.int64) * times
    sent = passages * (2 * length - GRAM)  # at most
    n_parts, heavy = 1, np.zeros(len(distinct), dtype=bool)
    if sent.sum() > shard_bytes:
        heavy = 2 * sent > shard_bytes
        strings = int(passages[heavy].sum()) * (length - GRAM + 1) * length
        n_parts = max(1, -(-2 * int(sent[~heavy].sum()) // shard_bytes) + -(-strings // shard_bytes))
    out = []
    for kind, told in ((0, times & ~heavy), (2, times & heavy)):
        parts = np.split(told[at], np.cumsum([len(h) for h in hashes])[:-1])
        out += [(r["block"], kind, r["shard"], squeeze(steps(h[p])), n_parts) for r, h, p in zip(rows, hashes, parts) if p.any()]
    return replies(out)


REPLY = "block int, kind int, shard long, data binary, parts long"


def replies(rows: list[tuple]) -> pa.Table:
    types = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64())
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[c.split()[0] for c in REPLY.split(", ")])


class Passages:
    """The repeated segments of a block, heavy ones as single strings, and its distinct passages, in an order that a second look finds again."""

    def __init__(self, docs: pa.Table, answers: pa.Table, length: int, n_shards: int):
        self.texts = t = Texts(docs, length)
        known = [(r, np.cumsum(expand(r["data"], "<u8"), dtype=np.uint64)) for r in answers.to_pylist() if r["kind"] != 1]
        hashes = np.concatenate([np.array([], np.uint64), *[h for _, h in known]])
        parts = np.repeat(np.array([r["parts"] for r, _ in known], dtype=np.int64), [len(h) for _, h in known])
        heavy = np.repeat(np.array([r["kind"] == 2 for r, _ in known], dtype=bool), [len(h) for _, h in known])
        order = np.argsort(hashes)
        hashes, parts, heavy = hashes[order], parts[order], heavy[order]
        at = np.minimum(np.searchsorted(hashes, t.hash), max(0, len(hashes) - 1))
        segment = np.flatnonzero(hashes[at] == t.hash) if len(hashes) else np.array([], np.int64)
        parts, heavy, least = parts[at[segment]], heavy[at[segment]], t.hash[segment]
        # A heavy segment becomes a piece per string, any other is one piece.
        pieces = np.where(heavy, t.n[segment], 1)
        of, ahead = np.repeat(np.arange(len(segment)), pieces), np.cumsum(pieces) - pieces
        self.row = t.row[segment][of]
        self.start = t.start[segment][of] + np.arange(len(of)) - ahead[of]
        self.n = np.where(heavy, 1, t.n[segment])[of]
        self.passage: dict[bytes, int] = {}
        self.first: list[int] = []  # piece of the passage's first occurrence
        self.of = np.empty(len(of), dtype=np.int64)
        for k, (row, a, z) in enumerate(zip(self.row.tolist(), self.start.tolist(), (self.start + self.n + length - 1).tolist())):
            x = t.texts[row][a:z]
            i = self.passage.setdefault(x, len(self.first))
            if i == len(self.first):
                self.first.append(k)
            self.of[k] = i
        first = of[np.array(self.first, dtype=np.int64)]
        dealt = mixed(least[first])
        for i, (x, single) in enumerate(zip(self.passage, heavy[first].tolist())):
            if single:
                dealt[i] = xxhash.xxh3_64_intdigest(x)
        self.home = shard_of(least[first], n_shards) + n_shards * (dealt % parts[first].astype(np.uint64)).astype(np.int64)


SENT = "shard long, block int, texts binary, sizes binary, docs binary, ranks binary, starts binary"


def send(docs: pa.Table, answers: pa.Table, length: int, n_shards: int) -> pa.Table:
    """The distinct passages of a block per shard, with the place of their first occurrence."""
    p = Passages(docs, answers, length, n_shards)
    t, first = p.texts, np.array(p.first, dtype=np.int64)
    home, passages, out = p.home, list(p.passage), []
    doc, rank, start = t.doc[p.row[first]], t.rank[p.row[first]], p.start[first]
    order = np.argsort(home, kind="stable")
    cuts = np.flatnonzero(np.diff(home[order], prepend=-1))
    for at in np.split(order, cuts[1:]) if len(order) else []:
        texts = [passages[i] for i in at.tolist()]
        out.append((
            int(home[at[0]]), docs.column("block")[0].as_py(), zstandard.ZstdCompressor(level=1).compress(b"".join(texts)),
            squeeze(np.array([len(x) for x in texts], dtype="<i8")), *[squeeze(x[at].astype("<i8")) for x in (doc, rank, start)],
        ))
    types = (pa.int64(), pa.int32(), *[pa.binary()] * 5)
    return pa.table([pa.array([r[i] for r in out], x) for i, x in enumerate(types)], names=[c.split()[0] for c in SENT.split(", ")])


def words_at(text: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Eight bytes from every position as a number that sorts like them; bytes from ``end`` on count as 0."""
    raw = np.lib.stride_tricks.sliding_window_view(text, 8)[at]
    value = np.ascontiguousarray(raw).view(">u8").ravel().astype(np.uint64)
    left = np.clip(end - at, 0, 8)
    cut = (8 * (8 - left)).astype(np.uint64)
    return np.where(left > 0, value >> np.minimum(cut, np.uint64(63)) << np.minimum(cut, np.uint64(63)), np.uint64(0))


def sort_directly(text: np.ndarray, at: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
    """Positions in the order of their first ``length`` bytes (up to ``end``), word by word where ties are left."""
    order = np.arange(len(at))
    group = np.zeros(len(at), dtype=np.int64)
    tied = np.arange(len(at))  # places in ``order`` that share their group
    for depth in range(0, length, 8):
        who = order[tied]
        word = words_at(text, np.minimum(at[who] + depth, len(text) - 8), end[who])
        by = np.lexsort((word, group[tied]))
        order[tied], word = who[by], word[by]
        # Within a group rows keep the group's places, so places stay ascending by group.
        edge = np.concatenate(([True], (group[tied][1:] != group[tied][:-1]) | (word[1:] != word[:-1])))
        ids = tied[np.flatnonzero(edge)]
        sizes = np.diff(np.flatnonzero(edge), append=len(tied))
        group[tied] = np.repeat(ids, sizes)
        tied = tied[np.repeat(sizes > 1, sizes)]
        if not len(tied):
            break
    return at[order]


def suffix_order(text: np.ndarray, start: np.ndarray, n: np.ndarray, stop: np.ndarray, length: int) -> np.ndarray:
    """Suffixes from ``start`` on, ``n`` of each passage, in the order of their first ``length`` bytes.

    ``text`` holds the passages, each followed by a zero at ``stop``.  Stage one sorts the suffixes that are
    smaller than their successors (in the passage, up to the first one behind the wanted ones).  Stage two scans
    the buckets of first bytes in ascending order: every suffix puts its predecessor, if that is larger, behind those
    already in the bucket of the predecessor's first byte.
    """
    size, stop = len(text), stop.astype(np.int32)  # a shard's text is far below 2 GB
    differs = text[1:] != text[:-1]
    change = np.flatnonzero(differs).astype(np.int32)  # last positions of runs of a byte
    ahead = np.zeros(size, dtype=np.int32)
    np.cumsum(differs, out=ahead[1:], dtype=np.int32)
    run_end = change[np.minimum(ahead, len(change) - 1)]
    at_stop = np.zeros(size, dtype=bool)
    at_stop[stop] = True
    # Equal bytes that run into a passage's end are larger than their successors.
    np.cumsum(at_stop[:-1], out=ahead[1:], dtype=np.int32)
    passage_stop = stop[np.minimum(ahead, len(stop) - 1)]
    del ahead, differs
    smaller = (run_end < size - 1) & (run_end + 1 < passage_stop)
    smaller &= text[run_end] < text[np.minimum(run_end + 1, size - 1)]
    smaller[stop] = True
    del run_end
    smalls = np.flatnonzero(smaller).astype(np.int32)
    bound = smalls[np.searchsorted(smalls, start + n)]  # the first directly sorted suffix behind the wanted ones
    covered = np.zeros(size + 1, dtype=np.int8)
    np.add.at(covered, start, 1)
    np.add.at(covered, bound + 1, -1)
    needed = np.cumsum(covered[:-1], dtype=np.int8) > 0
    direct = np.flatnonzero(needed & smaller).astype(np.int32)
    induced = needed & ~smaller
    del needed, smaller
    ordered = sort_directly(text, direct, passage_stop[direct], length)
    del passage_stop
    heads = np.searchsorted(text[ordered], np.arange(257))
    buckets: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        scanned, now = [], np.concatenate(buckets[c]) if buckets[c] else np.array([], dtype=np.int32)
        own, buckets[c] = ordered[heads[c] : heads[c + 1]], []
        if c == 0:  # ends of passages come ahead of all else, and zeros may be induced from them
            now, own = own[at_stop[own]], own[~at_stop[own]]
        while len(now):
            scanned.append(now)
            before = now[now > 0] - 1
            now = before[induced[before] & (text[before] == c)]
        here = np.concatenate([*scanned, own])
        out.append(here)
        before = here[here > 0] - 1
        before = before[induced[before]]
        first = text[before]
        before, first = before[first > c], first[first > c]
        by = np.argsort(first, kind="stable")
        before, first = before[by], first[by]
        cuts = np.flatnonzero(np.diff(first)) + 1
        for part in np.split(before, cuts) if len(before) else []:
            buckets[text[part[0]]].append(part)
    merged = np.concatenate(out)
    wanted = np.zeros(size + 1, dtype=np.int8)
    np.add.at(wanted, start, 1)
    np.add.at(wanted, start + n, -1)
    return merged[np.cumsum(wanted[:-1], dtype=np.int8)[merged] > 0]


def common_prefixes(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Bytes, up to ``length``, that each suffix shares with the one ahead of it; all wanted suffixes are that long."""
    out = np.zeros(len(order), dtype=np.int64)
    going = np.arange(1, len(order))
    far = np.full(1, len(text), dtype=np.int64)
    for depth in range(0, length, 8):
        a = words_at(text, order[going] + depth, far)
        b = words_at(text, order[going - 1] + depth, far)
        differ = np.ascontiguousarray((a ^ b).astype(">u8")).view(np.uint8).reshape(-1, 8) != 0
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), 8)
        out[going] += same
        going = going[same == 8]
        if not len(going):
            break
    return np.minimum(out, length)


def later_starts(passages: list[bytes], places: np.ndarray, length: int) -> list[np.ndarray]:
    """For every passage, which of its strings of ``length`` bytes also start earlier.  ``places``: its first one, a row of
    document, rank and start."""
    sizes = np.array([len(x) for x in passages], dtype=np.int64)
    text = np.frombuffer(b"\0".join(passages) + b"\0" * (length + 16), dtype=np.uint8)
    begin = np.cumsum(sizes + 1) - sizes - 1
    n = sizes - length + 1
    order = suffix_order(text, begin, n, begin + sizes, length)
    fresh = common_prefixes(text, order, length) < length
    fresh[0] = True
    owner = np.searchsorted(begin, order, side="right") - 1
    heads = np.flatnonzero(fresh)
    group = np.cumsum(fresh) - 1
    first = np.ones(len(order), dtype=bool)
    for value in (places[owner, 0], places[owner, 1], places[owner, 2] + order - begin[owner]):
        least = np.minimum.reduceat(np.where(first, value, LAST), heads)
        first &= value == least[group]
    late = ~first
    marks = np.zeros(len(text), dtype=bool)
    marks[order[late]] = True
    return [marks[b : b + k] for b, k in zip(begin.tolist(), n.tolist())]


def settle(table: pa.Table, length: int) -> pa.Table:
    """A shard: sorts the suffixes of its passages and tells every block which strings of its passages start earlier."""
    rows, number, sent = table.to_pylist(), {}, []
    firsts: list[tuple[int, int, int]] = []
    for r in rows:
        data, at = zstandard.ZstdDecompressor().decompress(r["texts"]), 0
        own = []
        sizes, *places = [expand(r[c], "<i8").tolist() for c in ("sizes", "docs", "ranks", "starts")]
        for size, place in zip(sizes, zip(*places)):
            i = number.setdefault(data[at : at + size], len(firsts))
            at += size
            if i == len(firsts):
                firsts.append(place)
            elif place < firsts[i]:
                firsts[i] = place
            own.append((i, place, size - length + 1))
        sent.append(own)
    late = later_starts(list(number), np.array(firsts, dtype=np.int64), length)
    out = []
    for r, own in zip(rows, sent):
        marks = [late[i] if place == firsts[i] else np.ones(n, dtype=bool) for i, place, n in own]
        out.append((r["block"], 1, r["shard"], zstandard.ZstdCompressor(level=1).compress(np.packbits(np.concatenate(marks)).tobytes()), None))
    return replies(out)


LEFT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def remove(docs: pa.Table, answers: pa.Table, length: int, n_shards: int) -> pa.Table:
    """The rows of a block without the bytes of the reported strings."""
    p = Passages(docs, answers, length, n_shards)
    t, first, home = p.texts, np.array(p.first, dtype=np.int64), p.home
    late: list[np.ndarray | None] = [None] * len(first)
    for r in answers.to_pylist():
        if r["kind"] == 1:
            at = np.flatnonzero(home == r["shard"])
            n = p.n[first[at]]
            bits = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(r["data"]), dtype=np.uint8), count=int(n.sum()))
            for i, x in zip(at.tolist(), np.split(bits, np.cumsum(n)[:-1])):
                late[i] = x
    by_row = np.split(np.arange(len(p.row)), np.searchsorted(p.row, np.arange(1, len(t.texts))))
    starts, counts, of = p.start.tolist(), p.n.tolist(), p.of.tolist()
    out = []
    for row, own in enumerate(by_row):
        data = np.frombuffer(t.texts[row], dtype=np.uint8)
        change = np.zeros(len(data) + 1, dtype=np.int64)
        for k in own.tolist():
            a, n, i = starts[k], counts[k], of[k]
            if p.first[i] != k:  # a later occurrence of a passage within the block
                change[a] += 1
                change[min(a + n - 1 + length, len(data))] -= 1
            elif late[i].any():
                hits = a + np.flatnonzero(late[i])
                np.add.at(change, hits, 1)
                np.add.at(change, hits + length, -1)
        gone = np.cumsum(change[:-1]) > 0
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((t.ids[row], len(data), int(gone.sum()), spans, data[~gone].tobytes() if spans else t.texts[row]))
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.table([pa.array([r[i] for r in out], x) for i, x in enumerate(types)], names=[c.split()[0] for c in LEFT.split(", ")])


def dedup_substrings(
    df: DataFrame, *, length: int = 100, id_col: str = "doc_id", text_col: str = "text",
    block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (removed runs) and kept (the bytes that are left) of every row."""
    if length < GRAM:
        raise ValueError(f"strings have at least {GRAM} bytes")
    small_batches(df)
    size = total(df, F.octet_length(text_col))
    n_blocks, n_shards = max(1, -(-size // block_bytes)), max(1, -(-size // shard_bytes))
    docs = df.select(
        F.pmod(F.xxhash64(df[id_col].cast("long"), df[text_col]), F.lit(n_blocks)).cast("int").alias("block"), df[id_col].cast("long").alias("doc_id"),
        F.coalesce(df[text_col], F.lit("")).cast("binary").alias("text"),
    )
    # One plan: the three looks at the documents share one exchange of the texts.
    empty = lambda schema: pa.table([pa.array([], x) for x in (pa.int64(), pa.int32()) + (pa.binary(),) * 5], names=[c.split()[0] for c in schema.split(", ")])
    asked = docs.groupBy("block").applyInArrow(lambda t: ask(t, length, n_shards), ASKED)
    known = asked.groupBy("shard").applyInArrow(lambda t: repeated(t, length, shard_bytes), REPLY)
    sent = docs.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(
        lambda d, a: send(d, a, length, n_shards) if d.num_rows and a.num_rows else empty(SENT), SENT
    )
    found = sent.groupBy("shard").applyInArrow(lambda t: settle(t, length), REPLY)
    return docs.groupBy("block").cogroup(known.unionByName(found).groupBy("block")).applyInArrow(lambda d, a: remove(d, a, length, n_shards), LEFT)
