"""Token sequences by bounded-space online packing.

Each Spark partition keeps ``open_windows`` open windows of ``capacity`` tokens.
A document's tokens are its ids and a closing id 0; whole windows are cut off
from its front, and the rest goes into the open window with the least room that
holds it (best-fit). Where none has room and no other may be opened, the fullest
is emitted: the piece's head tops it up first (unless the room is below
``least_cut``), and its tail is placed like any piece. What is open at the end
of a partition is staged with its ids, and the leftovers of ``merge_partitions``
partitions at a time are merged in the same way, windows first, then cut into
whole windows and one last one. So a task holds a bounded number of tokens
besides the document at hand, and there is one short window for each such group.

Ids come from the tokenizer's file. Words and other pre-tokens repeat, so each
worker keeps the ids of a bounded number of them; texts with characters
whose class is not the same in all versions of Unicode, and texts that hold a
special token's string, are given to the tokenizer whole.

Defined cases: null and empty text are the closing id alone; repeated rows and
rows without id are packed each; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm._shared import stage
from attesta.llm._text import slices

#: Characters of one class in every version of Unicode: ASCII, Latin letters, general punctuation.
SAFE = re.compile("[\t\n\r\x20-\x7e\xa0-\xac\xae-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧]*")
#: The public pre-token rule of byte-level BPE, its classes written out for SAFE characters.
PRE_TOKEN = re.compile(r" ?[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Where a pre-token always ends: a letter before a blank and a letter.
SEAM = re.compile(r"(?<=[^\W\d_])(?= [^\W\d_])")
CHUNK = 1 << 20


class Ids:
    """Ids of texts as little-endian 32-bit bytes, with a bounded memory of pre-tokens."""

    def __init__(self, path: str, remembered: int = 1 << 20):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.remembered = remembered

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, tokens: set[str]) -> None:
        """Know these pre-tokens; the others are forgotten if there are too many."""
        new = [t for t in tokens if t not in self.known]
        if len(self.known) + len(new) > self.remembered:
            self.known, new = {}, list(tokens)
        self.known.update(zip(new, self._encoded(new), strict=True))

    def _chunks(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > CHUNK:
            seam = SEAM.search(text, start + CHUNK)
            end = seam.start() if seam else len(text)
            yield text[start:end]
            start = end
        yield text[start:]

    def of(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        plain = [SAFE.fullmatch(t) is not None and not any(s in t for s in self.special) for t in texts]
        tokens = [[t for c in self._chunks(text) for t in PRE_TOKEN.findall(c)] if p else [] for text, p in zip(texts, plain, strict=True)]
        self._learn({t for own in tokens for t in own})
        return [b"".join(map(self.known.__getitem__, own)) if p else self._encoded([text])[0] for text, p, own in zip(texts, plain, tokens, strict=True)]


_loaded: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    """One memory for each worker and tokenizer."""
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = Ids(path)
    return _loaded[path]


class Piece:
    """Tokens of one document from ``start`` on: ``ids`` are their bytes."""

    __slots__ = ("doc_id", "start", "ids", "doc_tokens")

    def __init__(self, doc_id: int | None, start: int, ids: bytes, doc_tokens: int):
        self.doc_id, self.start, self.ids, self.doc_tokens = doc_id, start, ids, doc_tokens

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.ids[: 4 * n], self.doc_tokens), Piece(self.doc_id, self.start + n, self.ids[4 * n :], self.doc_tokens)


class Windows:
    """At most ``most`` open windows; ``emit`` gets each closed one as a list of pieces."""

    def __init__(self, capacity: int, most: int, least_cut: int, emit: Callable[[list[Piece]], None]):
        self.capacity, self.most, self.least_cut, self.emit = capacity, most, least_cut, emit
        self.held: dict[int, list[Piece]] = {}
        self.room: list[tuple[int, int]] = []  # (room, window), ascending
        self.opened = 0

    def _put(self, window: int, room: int, pieces: list[Piece]) -> None:
        self.held[window] += pieces
        room -= sum(map(len, pieces))
        if room:
            insort(self.room, (room, window))
        else:
            self.emit(self.held.pop(window))

    def place(self, pieces: list[Piece]) -> None:
        """Pieces that shall stay together if they fit: at most ``capacity`` tokens."""
        while pieces:
            size = sum(map(len, pieces))
            at = bisect_left(self.room, (size, -1))
            if at < len(self.room):
                room, window = self.room.pop(at)
                return self._put(window, room, pieces)
            if len(self.held) < self.most:
                self.held[self.opened] = []
                self.opened += 1
                return self._put(self.opened - 1, self.capacity, pieces)
            room, window = self.room.pop(0)
            head, pieces = _split(pieces, room) if room >= self.least_cut else ([], pieces)
            self.emit(self.held.pop(window) + head)

    def rest(self) -> list[list[Piece]]:
        """The open windows, fullest first."""
        return [self.held[w] for _, w in self.room]


def _split(pieces: list[Piece], n: int) -> tuple[list[Piece], list[Piece]]:
    """The first n tokens, and what follows."""
    head: list[Piece] = []
    for i, p in enumerate(pieces):
        if len(p) > n:
            a, b = p.cut(n)
            return head + [a] * (n > 0), [b, *pieces[i + 1 :]]
        head.append(p)
        n -= len(p)
    return head, []


RESULT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
STAGED = RESULT + ", run long, window int, place int, ids binary"
_FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "run", "window", "place", "ids")
_TYPES = (pa.int64(),) * 8 + (pa.int32(), pa.int32(), pa.binary())


class _Rows:
    """Rows of STAGED; closed windows are numbered from ``first`` on."""

    def __init__(self, first: int):
        self.next, self.rows = first, []

    def closed(self, pieces: list[Piece]) -> None:
        offset = 0
        for p in pieces:
            self.rows.append((p.doc_id, p.start, len(p), zlib.crc32(p.ids), p.doc_tokens, self.next, offset, None, None, None, None))
            offset += len(p)
        self.next += 1

    def left(self, run: int, windows: list[list[Piece]]) -> None:
        self.rows += [(p.doc_id, p.start, len(p), None, p.doc_tokens, None, None, run, w, i, p.ids) for w, pieces in enumerate(windows) for i, p in enumerate(pieces)]

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * len(_FIELDS)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], list(_FIELDS))


def _packed(path: str, capacity: int, open_windows: int, least_cut: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, number = ids_of(path), TaskContext.get().partitionId()
        rows = _Rows(number << 32)
        windows = Windows(capacity, open_windows, least_cut, rows.closed)
        for batch in batches:
            for b in slices(batch, "text", 1 << 20):
                texts = b.column("text").fill_null("").to_pylist()
                for doc_id, own in zip(b.column("doc_id").to_pylist(), ids.of(texts), strict=True):
                    own += b"\0\0\0\0"
                    n = len(own) // 4
                    whole = n - n % capacity
                    for s in range(0, whole, capacity):
                        rows.closed([Piece(doc_id, s, own[4 * s : 4 * (s + capacity)], n)])
                    if whole < n:
                        windows.place([Piece(doc_id, whole, own[4 * whole :], n)])
                yield rows.take()
        rows.left(number, windows.rest())
        yield rows.take()

    return run


def _merged(capacity: int, open_windows: int, least_cut: int) -> Callable[[pa.Table], pa.Table]:
    def run(left: pa.Table) -> pa.Table:
        rows = _Rows((1 << 62) + (left["part"][0].as_py() << 32))
        windows = Windows(capacity, open_windows, least_cut, rows.closed)
        found: dict[tuple[int, int], list[Piece]] = {}
        columns = ("run", "window", "place", "doc_id", "start", "ids", "doc_tokens")
        for run, window, _, *own in sorted(zip(*(left[c].to_pylist() for c in columns), strict=True), key=lambda r: r[:3]):
            found.setdefault((run, window), []).append(Piece(*own))
        for pieces in sorted(found.values(), key=lambda x: -sum(map(len, x))):
            windows.place(pieces)
        rest = [p for pieces in windows.rest() for p in pieces]
        while rest:
            head, rest = _split(rest, capacity)
            rows.closed(head)
        return pa.Table.from_batches([rows.take()]).select(_FIELDS[:7])

    return run


def pack_tokens(documents: DataFrame, path: str, capacity: int = 1024, open_windows: int = 64, least_cut: int = 8, merge_partitions: int = 16) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece of every document."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    staged = stage(rows.mapInArrow(_packed(path, capacity, open_windows, least_cut), STAGED), "packed")
    names = [x.split(" ")[0] for x in RESULT.split(", ")]
    left = staged.filter("run is not null").withColumn("part", F.floor(F.col("run") / merge_partitions).cast("long"))
    merged = left.groupBy("part").applyInArrow(_merged(capacity, open_windows, least_cut), RESULT)
    return staged.filter("run is null").select(*names).unionByName(merged)
