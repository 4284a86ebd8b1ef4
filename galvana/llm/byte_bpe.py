"""Byte-level BPE encoding and decoding with an Aho-Corasick automaton.

Every byte is one Latin-1 character, so the vocabulary is a set of strings for pyahocorasick. A pretoken is encoded from
left to right: at each place the longest vocabulary match that is compatible with the token before it is taken, and
where none is, the last token is withdrawn and its next shorter match tried. Two adjacent tokens are compatible if
merging their joined bytes by rank gives the two back; that answer depends on the pair alone and is memoised. The first
complete sequence is the one that the merges by rank give. Places that failed are marked, so each is tried once.
"""

from __future__ import annotations

import base64
import hashlib
import re
from itertools import chain

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, strings

#: Entries that a worker's memos hold before they are emptied.
MEMO_ENTRIES = 400_000
#: A space before something that isn't white space always begins a pretoken, so texts may be cut there.
_SPLIT = re.compile(r" (?=\S)")
_UNEVEN = re.compile(r" (?=\s|\Z)")


def pieces(text: str) -> list[str]:
    """Cut a text at spaces where a pretoken begins; the space is left out, and every piece but the first had one."""
    return _SPLIT.split(text) if _UNEVEN.search(text) else text.split(" ")


class ByteBPE:
    """A vocabulary of byte strings with ranks, as a tiktoken file holds it. The rank is the id."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), i))
        self.automaton.make_automaton()
        #: The two tokens that each longer one is merged from, and back.
        self.halves = {i: tuple(two) for t, i in self.ranks.items() if len(t) > 1 and len(two := self.merged(t, i)) == 2}
        self.joined = {two: i for i, two in self.halves.items()}
        self.pretokens = regex.compile(pattern).findall
        self.pair_ok: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    def merged(self, word: bytes, below: int = 1 << 62) -> list[int]:
        """Ids by merging the adjacent pair of lowest rank, `below` excluded, until none is left: the definition."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        """Whether no merge across the border of two tokens comes before the merges that made them.

        Both are taken apart along the border, the later-made one first; a pair that would have merged earlier than the
        part just undone was made tells that the two can't stand side by side.
        """
        ok = self.pair_ok.get((left, right))
        if ok is None:
            if len(self.pair_ok) >= MEMO_ENTRIES:
                self.pair_ok.clear()
            ok = self.pair_ok[left, right] = self._stand_apart(left, right)
        return ok

    def _stand_apart(self, a: int, b: int) -> bool:
        joined, halves = self.joined, self.halves
        limit = 1 << 62
        while joined.get((a, b), limit) >= limit:
            whole_a, whole_b = a not in halves, b not in halves
            if whole_a and whole_b:
                return True
            if not whole_a and (whole_b or a > b):
                limit, a = a, halves[a][1]  # the right half of a now faces b
            else:
                limit, b = b + 1, halves[b][0]
        return False

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """Ids of one pretoken."""
        ranks = self.ranks
        whole = ranks.get(word)
        if whole is not None:
            return (whole,)
        longest: list = [None] * len(word)
        for end, match in self.automaton.iter(word.decode("latin-1")):
            longest[end - match[0] + 1] = match  # a later end is a longer match
        known, tokens, dead = self.pair_ok, [], None
        at, size, last = 0, len(word), -1
        match = longest[0] if word else None
        while at < size:
            # the longest of the untried matches here that leads on and suits the token before
            while match is not None:
                length, i = match
                if (dead is None or at + length not in dead) and (
                    last < 0 or ((ok := known.get((last, i))) is None and self.compatible(last, i)) or ok
                ):
                    break
                match = self._shorter(word, at, length)
            if match is not None:
                tokens.append(match[1])
                last = match[1]
                at += match[0]
                match = longest[at] if at < size else None
            else:
                dead = dead or set()
                dead.add(at)
                length = len(self.bytes_of[tokens.pop()])
                at -= length
                last = tokens[-1] if tokens else -1
                match = self._shorter(word, at, length)
        return tuple(tokens)

    def _shorter(self, word: bytes, at: int, length: int) -> tuple[int, int] | None:
        """The next shorter match at a place."""
        for n in range(length - 1, 0, -1):
            i = self.ranks.get(word[at : at + n])
            if i is not None:
                return n, i
        return None

    def encode_piece(self, piece: str) -> tuple[int, ...] | list[int]:
        """Ids of a piece of `pieces`, with its space. Linear in the piece, which is a whole text where that has no spaces."""
        if piece.lstrip(" ").isalpha() and piece.count(" ") <= 1:  # one pretoken, as most pieces are
            return self.encode_word(piece.encode())
        words = self.words
        out: list[int] = []
        for x in self.pretokens(piece):
            ids = words.get(x)
            if ids is None:
                ids = self.encode_word(x.encode())
                if len(x) < 40:
                    if len(words) >= MEMO_ENTRIES:
                        words.clear()
                    words[x] = ids
            out += ids
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a text, each match of the pattern encoded by itself."""
        known, long = self.known, {}
        cut = pieces(text)
        cut[1:] = [" " + x for x in cut[1:]]
        if len(known) + len(cut) > MEMO_ENTRIES:
            known.clear()
        for x in set(cut).difference(known):
            (known if len(x) < 200 else long)[x] = self.encode_piece(x)
        return list(chain.from_iterable(map((known | long if long else known).__getitem__, cut)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_coders: dict[tuple[str, str], ByteBPE] = {}


def coder(path: str, pattern: str = public_tokenizers.PATTERN) -> ByteBPE:
    """The process's coder for a vocabulary file; Python workers are kept between tasks, and so is this."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = ByteBPE(path, pattern)
    return _coders[path, pattern]


def default_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids: array<int>) for each row. A null or empty text has no ids. Other columns are ignored; rows that
    repeat, null ids and an empty table are passed through. One narrow pass; memory is bounded by a batch of texts."""
    path = path or default_path()

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = coder(path)
        ids = [bpe.encode(t) for t in strings(batch.column(1))]
        return pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(chosen, per_batch, "doc_id long, ids array<int>")


def decoded(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(doc_id, data: binary) for each row of ids; null ids give empty data. An id outside the vocabulary is an error."""
    path = path or default_path()

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = coder(path)
        data = [bpe.decode(x or []) for x in batch.column(1).to_pylist()]
        return pa.record_batch([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "data"])

    return arrow_map(tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")), per_batch, "doc_id long, data binary")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens, SHA-256 of the decimal ids joined by one space, SHA-256 of the bytes decoded from them.

    Encoding, decoding and both digests are made in one pass, so the ids never leave the task. Edge cases as `encoded`.
    """
    path = path or default_path()

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe, n, ids_sha, data_sha = coder(path), [], [], []
        for text in strings(batch.column(1)):
            ids = bpe.encode(text)
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
            data_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
        columns = [batch.column(0), pa.array(np.array(n, np.int64)), pa.array(ids_sha), pa.array(data_sha)]
        return pa.record_batch(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(chosen, per_batch, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
