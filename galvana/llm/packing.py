"""Packing into fixed windows by order-preserving dynamic programming.

The documents of an input split form one stream of tokens in the order of their rows. The stream is cut into windows of
at most WINDOW tokens. Cuts may fall at ends of documents (free), at ends of sentences (SENTENCE_PENALTY, for the
truncated document) or, inside very long sentences, at any of a grid of places (HARD_PENALTY). With S the position of a
cut and f its least cost, f[k] = penalty[k] + WINDOW - S[k] + min(f[i] + S[i]) over cuts i within one window before k:
padding plus truncation penalties. The minimum over the sliding range comes from a monotone queue, so a block costs
linear time. Blocks of about BLOCK tokens bound a task's memory; a window ends with its block.
"""

from __future__ import annotations

import base64
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import pieces
from .common import tidy

WINDOW = 2048
END_ID = 1
BLOCK = 1 << 20
SENTENCE_PENALTY = 24
HARD_PENALTY = 256
#: Inside a sentence longer than this many tokens, cuts are allowed at its multiples.
HARD_STEP = 512
SPECIAL = "<|endoftext|>"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Tokens:
    """Ids of texts by the tokenizer file, as little-endian unsigned 16-bit numbers, with the ends of sentences.

    Texts are encoded by the rank file of the same vocabulary, which gives the same ids several times faster; a text in
    which the file's special token occurs goes to the tokenizer file itself. Sentences are looked for at the spaces that
    begin a pretoken, where tokens end too, by places of bytes.
    """

    def __init__(self, path: str, ranks: str):
        self.path = path
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.rank_encode = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
        ).encode_ordinary
        self.sizes = np.zeros(max(table.values()) + 1, np.int64)
        self.sizes[list(table.values())] = list(map(len, table))
        self.whole = None

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """Ids, and the positions after which a sentence has ended."""
        if SPECIAL in text:
            return self._by_file(text)
        ids = np.array(self.rank_encode(text), "<u2")
        data = np.frombuffer(text.encode(), np.uint8)
        if text.isascii():
            cuts = np.flatnonzero((data[:-1] == ord(" ")) & ~_WHITE[data[1:]])
        else:
            cuts = np.cumsum([len(x.encode()) + 1 for x in pieces(text)[:-1]], dtype=np.int64) - 1
        ends = np.append(cuts, len(data))
        stops = (ends > 0) & _ENDS[data[ends - 1]] if len(data) else ends > 0
        stops[np.searchsorted(ends, np.flatnonzero(data == ord("\n")), "right")] = True  # a line ends in the piece
        return ids.tobytes(), np.searchsorted(np.cumsum(self.sizes[ids]), ends[stops]) + 1

    def _by_file(self, text: str) -> tuple[bytes, np.ndarray]:
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        made = self.whole.encode(text, add_special_tokens=False)
        stops = [k + 1 for k, (a, b) in enumerate(made.offsets) if text[a:b].rstrip()[-1:] in _STOPS]
        return np.array(made.ids, "<u2").tobytes(), np.array(stops, np.int64)


_STOPS = frozenset((".", "!", "?", "\n"))
_ENDS = np.array([chr(k) in _STOPS for k in range(256)])
_WHITE = np.array([chr(k).isspace() for k in range(256)])
_tokens: dict[tuple[str, str], Tokens] = {}


def _tokenizer(path: str, ranks: str) -> Tokens:
    if (path, ranks) not in _tokens:
        _tokens[path, ranks] = Tokens(path, ranks)
    return _tokens[path, ranks]


def choose_cuts(places: np.ndarray, penalties: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Indexes of the chosen places: least padding plus penalties.

    `places` rise from 0 to the end of the stream, with gaps of at most `window`; the first and last are always chosen.
    """
    s, pen = places.tolist(), penalties.tolist()
    cost, back = [0] * len(s), [0] * len(s)
    queue: deque[int] = deque([0])  # of rising key f + S; the head is the least within reach
    key = [0] * len(s)
    for k in range(1, len(s)):
        while s[k] - s[queue[0]] > window:
            queue.popleft()
        back[k] = queue[0]
        cost[k] = pen[k] + window - s[k] + key[queue[0]]
        key[k] = cost[k] + s[k]
        while queue and key[queue[-1]] >= key[k]:
            queue.pop()
        queue.append(k)
    chosen, k = [len(s) - 1], len(s) - 1
    while k:
        k = back[k]
        chosen.append(k)
    return np.array(chosen[::-1])


def _block_places(doc_ends: np.ndarray, sentence_ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate cuts of a block and their penalties."""
    soft = np.unique(np.concatenate(([0], doc_ends, sentence_ends)))
    gaps = np.diff(soft)
    step = min(HARD_STEP, window)
    long = np.flatnonzero(gaps > step)
    hard = [np.arange(a + step, b, step) for a, b in zip(soft[long].tolist(), soft[long + 1].tolist(), strict=True)]
    places = np.unique(np.concatenate([soft, *hard]))
    penalties = np.full(len(places), HARD_PENALTY, np.int64)
    penalties[np.isin(places, sentence_ends)] = SENTENCE_PENALTY
    penalties[np.isin(places, doc_ends)] = 0
    penalties[0] = 0
    return places, penalties


def _pack_block(docs: list, window: int, sequence: int) -> tuple[list[np.ndarray], list[int], int]:
    """Columns of the pieces of one block; docs: (row, first position here, ids, ends of sentences, tokens of the doc)."""
    lengths = np.array([len(d[2]) for d in docs], np.int64)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    stops = np.concatenate([b + d[3] for b, d in zip(begins.tolist(), docs, strict=True)])
    places, penalties = _block_places(ends, stops, window)
    cuts = places[choose_cuts(places, penalties, window)]
    bounds = np.unique(np.concatenate((cuts, ends)))
    left, size = bounds[:-1], np.diff(bounds)
    doc = np.searchsorted(ends, left, "right")
    win = np.searchsorted(cuts, left, "right") - 1
    stream = np.concatenate([d[2] for d in docs]).astype("<u4")
    view = memoryview(stream).cast("B")
    crc = np.fromiter((zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(left.tolist(), bounds[1:].tolist(), strict=True)), np.int64, len(left))
    first = np.array([d[1] for d in docs], np.int64)
    total = np.array([d[4] for d in docs], np.int64)
    columns = [first[doc] + left - begins[doc], size, crc, total[doc], sequence + win, left - cuts[win]]
    return columns, [docs[i][0] for i in doc.tolist()], sequence + len(cuts) - 1


def packed(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    block: int = BLOCK,
    path: str | None = None,
    ranks: str | None = None,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every document, with its end id, lies in exactly one piece; the pieces of a sequence lie at gapless
    offsets from 0 and take at most `window` tokens. Rows are packed in the order in which their split holds them, in one
    narrow pass without a shuffle; sequence_id has the split's number in its upper bits. A null or empty text is its end
    id alone. A document longer than a block is packed over several blocks. Repeated rows and null ids are packed as they
    come; other columns are ignored; an empty table gives an empty one.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokenizer(path, ranks)
        sequence = TaskContext.get().partitionId() << 40
        held: list = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            columns, rows, sequence = _pack_block(held, window, sequence)
            return pa.record_batch([pa.array(rows, pa.int64()), *map(pa.array, columns)], names)

        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data, stops = tokens(text.as_py() or "")
                ids = np.append(np.frombuffer(data, "<u2"), np.uint16(END_ID))
                for at in range(0, len(ids), block):
                    part = ids[at : at + block]
                    here = stops[(stops > at) & (stops < at + len(part))] - at
                    held.append((row, at, part, here, len(ids)))
                    size += len(part)
                    if size >= block:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(tidy(run), SCHEMA)
