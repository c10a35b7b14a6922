"""Order-preserving packing of tokenised documents into fixed windows.

Every partition packs its own documents in stored order, so nothing is shuffled and a lost
task is simply run again. In a partition the concatenated ids form one line; windows are cut
at document or sentence ends by dynamic programming. With ``cost[j]`` the least cost of
packing everything before cut ``j``

    cost[j] = penalty[j] + window - pos[j] + min(cost[i] + pos[i])   over pos[j] - pos[i] <= window

the inner minimum slides to the right with ``j`` and is kept in a monotone queue, so the
search is linear in the number of cuts. Buffers are solved in blocks of ``BLOCK_WINDOWS``
windows; what follows the last chosen cut is carried into the next block.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 4096
END_ID = 2
#: Cost, in padded tokens, of cutting a document at a sentence end, and anywhere else.
SENTENCE_CUT = 2
HARD_CUT = 16
BLOCK_WINDOWS = 256
#: Chunks that an encoder gathers before it forgets those not met since.
REMEMBERED = 400_000

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
)
_ARROW = pa.schema([(f.name, pa.int64()) for f in PIECES.fields])


class ChunkEncoder(dict):
    """Ids of texts as little-endian bytes; those of white-space-free chunks are remembered.

    The tokenizer drops white space and never joins characters across it, so a text's ids are
    those of its chunks in order. Of a chunk of ASCII signs and Latin-1 letters the
    pre-tokenizer's pieces are known too, and the model alone is asked for each. Texts for
    which that could fail (separators that Python and the tokenizer disagree on, special token
    strings) are encoded whole.
    """

    _SIMPLE = re.compile("[!-~À-ÖØ-öø-ÿ]+")
    # fixed values: the pieces of the vocabulary file's own pre-tokenizer, for such chunks in lower case
    _PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\\[-`{-~]+")
    _WHOLE = ("\x1c", "\x1d", "\x1e", "\x1f", "<|startoftext|>", "<|endoftext|>")

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        self._model = self._tok.model
        self._before: dict[str, bytes] = {}  # what was remembered until there was too much of it
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        self._letters = dict(zip(shown, shown, strict=True)) | {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in set(shown))}
        self._piece = lru_cache(maxsize=REMEMBERED // 2)(self._ask_model)
        self._marks = {m: self._ask(m) for m in ".,"}
        self.sentence_ends = np.unique(
            [np.frombuffer(self._ask(m), dtype="<u4")[-1] for m in (".", "!", "?", "...", '."', ".)", "。")]
        )

    def _ask(self, text: str) -> bytes:
        return np.asarray(self._tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _ask_model(self, piece: str) -> bytes:
        shape = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self._letters)
        return array("I", [t.id for t in self._model.tokenize(shape)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        stem, mark = (chunk[:-1], self._marks[chunk[-1]]) if chunk[-1] in ".," else (chunk, b"")
        if stem.isalpha() and stem.isascii():  # nearly all chunks
            return self._piece(stem.lower()) + mark
        if self._SIMPLE.fullmatch(chunk):
            return b"".join(map(self._piece, self._PIECES.findall(chunk.lower())))
        return self._ask(chunk)

    def __missing__(self, chunk: str) -> bytes:
        ids = self._before.get(chunk) or self._chunk(chunk)
        if len(chunk) <= 40:
            self[chunk] = ids
        return ids

    def rest(self) -> None:
        """Forget what may be long unused, between tasks."""
        self._before = {}

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(x in text for x in self._WHOLE):
            return self._ask(text)
        if len(self) > REMEMBERED:
            self._before = self.copy()
            self.clear()
        return b"".join(map(self.__getitem__, text.split()))


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """One encoder for a worker process, so that what it remembers serves the next task too."""
    return ChunkEncoder(path)


def best_cuts(pos: np.ndarray, penalty: np.ndarray, window: int) -> tuple[list[float], list[int]]:
    """Least cost of ending a window at each cut, and the cut before it.

    ``pos`` rises strictly from 0 by steps of at most ``window``.
    """
    where, fee = pos.tolist(), penalty.tolist()
    cost, back = [0.0] * len(where), [0] * len(where)
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])
    for j in range(1, len(where)):
        here = where[j]
        while here - queue[0][1] > window:
            queue.popleft()
        key, _, i = queue[0]
        cost[j], back[j] = key + window - here + fee[j], i
        own = cost[j] + here
        while queue and queue[-1][0] >= own:
            queue.pop()
        queue.append((own, here, j))
    return cost, back


def _cut_points(ids: np.ndarray, doc_ends: np.ndarray, sentence_ends: np.ndarray, window: int):
    """Positions where a window may end, and what each costs."""
    sentences = np.flatnonzero(np.isin(ids, sentence_ends)) + 1
    pos = np.unique(np.concatenate([[0], sentences, doc_ends]))
    full = pos + window  # a window that is exactly full ends here
    pos = np.unique(np.concatenate([pos, full[full < len(ids)]]))
    gaps = np.diff(pos)
    if (gaps > window).any():
        more = [np.arange(pos[k] + window, pos[k + 1], window) for k in np.flatnonzero(gaps > window)]
        pos = np.unique(np.concatenate([pos, *more]))
    penalty = np.full(len(pos), HARD_CUT, dtype=np.int64)
    penalty[np.isin(pos, sentences)] = SENTENCE_CUT
    penalty[np.isin(pos, doc_ends)] = 0
    return pos, penalty


class _Packer:
    def __init__(self, partition: int, sentence_ends: np.ndarray, window: int):
        self.window, self.ends, self.next_id = window, sentence_ends, partition << 32
        self.ids: list[np.ndarray] = []
        self.docs: list[list[int | None]] = []  # id, tokens, ids already packed
        self.waiting = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.ids.append(ids)
        self.docs.append([doc_id, len(ids), 0])
        self.waiting += len(ids)

    def flush(self, last: bool) -> list[tuple]:
        if not self.waiting:
            return []
        line, window = np.concatenate(self.ids), self.window
        lengths = np.array([n - done for _, n, done in self.docs])
        doc_ends = np.cumsum(lengths)
        pos, penalty = _cut_points(line, doc_ends, self.ends, window)
        cost, back = best_cuts(pos, penalty, window)
        total, first = len(line), int(np.searchsorted(pos, len(line) - window, "right"))
        j = min(range(max(first, 1), len(pos)), key=lambda k: (cost[k], -pos[k]))
        cuts = []
        while j:
            cuts.append(int(pos[j]))
            j = back[j]
        cuts = cuts[::-1]
        if last:
            at = cuts[-1]
            while at < total:  # the rest goes into windows of powers of two, which need no padding
                at += 1 << (min(total - at, window).bit_length() - 1)
                cuts.append(at)
        rows, at = [], 0
        doc_starts = doc_ends - lengths
        for end in cuts:
            a, b = np.searchsorted(doc_ends, at, "right"), np.searchsorted(doc_starts, end, "left")
            for d in range(a, b):
                s, e = max(at, int(doc_starts[d])), min(end, int(doc_ends[d]))
                name, n, done = self.docs[d]
                rows.append((name, done + s - int(doc_starts[d]), e - s, zlib.crc32(line[s:e].tobytes()), n, self.next_id, s - at))
            self.next_id += 1
            at = end
        kept = int(np.searchsorted(doc_ends, at, "right"))
        rest = self.docs[kept:]
        if rest:
            rest[0][2] += at - int(doc_starts[kept])
        self.docs, self.ids, self.waiting = rest, [line[at:].copy()] if at < total else [], total - at
        return rows


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """One row per piece of a document, placed in a window of at most ``window`` ids.

    A document's ids are those of its text followed by ``END_ID``; a null or empty text has
    that one id. Repeated rows are packed as often as they occur, a null id is carried as
    null, other columns are ignored, and an empty table gives no rows. Order inside a
    partition is that of the table. Only a partition's last, short stretch is cut into
    windows of powers of two.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer_path)
        packer = _Packer(TaskContext.get().partitionId(), words.sentence_ends, window)
        tail = np.array([END_ID], dtype="<u4").tobytes()

        def out(rows):
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_ARROW)

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(name, np.frombuffer(words.encode(text.as_py()) + tail, dtype="<u4"))
                if packer.waiting >= BLOCK_WINDOWS * window and (rows := packer.flush(False)):
                    yield out(rows)
        if rows := packer.flush(True):
            yield out(rows)
        words.rest()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(pack, PIECES)
