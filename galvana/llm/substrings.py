"""Substring deduplication with a compressed FM-index per shard.

A window is WINDOW consecutive words. Each window has an anchor, the least hash among its K-word grams, so equal windows
have equal anchors. Anchors that only one document has can't lie in a shared window. Around each run of windows with the
same shared anchor the document gives a segment; equal segments are collapsed to one with the smallest and the largest
doc_id of theirs; and the segments of an anchor go to one shard. A shard's text is its segments, every one closed by a
separator of its own. Over its Burrows-Wheeler transform, held in a wavelet matrix of packed bits, backward search
computes for each streamed segment the matching statistics against text of smaller documents: an interval of the suffix
order is followed only while the least document in it is smaller than the segment's. Windows whose match is long enough
are reported, once for the segment's smallest document and once for the others that have it.

A mismatch rules out all windows around it, so the search skips like backward DAWG matching, and lengths tried double
after each success. All segments of a shard advance in lockstep, a step of the wavelet matrix at a time.

An anchor with many distinct segments, as a line that is common everywhere has, is cut finer: its segments are anchored
again by longer grams, in the end by whole windows, and the pieces are dealt by their new anchors to shards of the same
kind. So no anchor weighs more than a share of a shard, and work grows with the text. What is found in the pieces of a
segment is put together for the segment, once for all documents that have it, before it meets the documents' places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, fresh, small_or_shuffled, tidy, utf8, written

WINDOW = 50
#: Longest run of windows in a segment.
MAX_RUN = 43
SHARD_WORDS = 400_000
#: An anchor whose distinct segments have more than this share of a shard's words is cut finer.
SHARE = 8
#: Part of SHARD_WORDS that a shard holds on average.
FILL = 0.75
MEMO_ENTRIES = 150_000
FLUSH_BYTES = 48 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """64-bit hashes of words, memoised."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known, digest = self.known, xxhash.xxh64_intdigest
        if len(known) + len(words) > MEMO_ENTRIES:
            return np.fromiter(map(digest, words), np.uint64, len(words))
        for w in set(words).difference(known):
            known[w] = digest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def gram_sizes(window: int) -> list[int]:
    """Words of the grams that give the anchors, level by level; those of the last level are whole windows."""
    return sorted({max(1, window * 4 // 25), max(1, window * 2 // 5), max(1, window * 7 // 10), window})


def anchors(hashes: np.ndarray, window: int, k: int) -> np.ndarray:
    """Signed anchor of each window, from the hashes of the words; empty for texts shorter than a window."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    grams = len(hashes) - k + 1
    g = np.zeros(grams, np.uint64)
    for j in range(k):
        g = g * _MULTIPLIER + hashes[j : j + grams]
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(32)
    width, least = 1, g
    span = window - k + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    return np.minimum(least[:n], least[span - width : span - width + n]).view(np.int64)


def _runs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of each run of equal anchors, cut at MAX_RUN."""
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    size = np.diff(np.r_[first, len(a)])
    if (size > MAX_RUN).any():
        first = np.concatenate([np.arange(f, f + s, MAX_RUN) for f, s in zip(first.tolist(), size.tolist(), strict=True)])
        size = np.diff(np.r_[first, len(a)])
    return first, size


# --- the index of a shard --------------------------------------------------------------------------------------------


def suffix_order(text: np.ndarray, longest: int) -> np.ndarray:
    """Suffix array by prefix doubling; no two suffixes may share more than `longest` symbols."""
    rank = text.astype(np.int64)
    n, h = len(text), 1
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[: n - h] = rank[h:] + 1
        key = rank * np.int64(n + 2) + nxt if h > 1 else rank * np.int64(int(rank.max()) + 2) + nxt
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]])
        h *= 2
        if h > longest or rank[order[-1]] == n - 1:
            return order


class WaveletMatrix:
    """Packed bits of each level of the symbols, with counts of ones before every 64."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        n = len(symbols)
        blocks = n // 64 + 1
        self.bits = np.zeros((self.levels, blocks), np.uint64)
        self.ones = np.zeros((self.levels, blocks), np.int32)
        self.zeros = np.zeros(self.levels, np.int64)
        now = symbols
        for level in range(self.levels):
            bit = (now >> (self.levels - 1 - level)) & 1
            packed = np.packbits(np.r_[bit, np.zeros(blocks * 64 - n, bit.dtype)].astype(np.uint8), bitorder="little")
            self.bits[level] = packed.view(np.uint64)
            per_block = np.bitwise_count(self.bits[level]).astype(np.int32)
            self.ones[level, 1:] = np.cumsum(per_block)[:-1]
            self.zeros[level] = n - int(bit.sum())
            now = np.concatenate((now[bit == 0], now[bit == 1]))

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place, counted from where the last level puts the symbol."""
        at = places
        for level in range(self.levels):
            block, inside = at >> 6, (at & 63).astype(np.uint64)
            mask = (np.uint64(1) << inside) - np.uint64(1)
            ones = self.ones[level][block] + np.bitwise_count(self.bits[level][block] & mask)
            one = (symbols >> (self.levels - 1 - level)) & 1
            at = np.where(one == 1, self.zeros[level] + ones, at - ones)
        return at


class FMIndex:
    """Index over segments: `words` are their symbols from 0, `starts` and `sizes` delimit them, `docs` are their ids."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, docs: np.ndarray):
        count, total = len(sizes), int(sizes.sum())
        self.sizes = sizes
        self.starts = np.cumsum(sizes + 1) - (sizes + 1)
        text = np.empty(total + count, np.int64)
        closing = self.starts + sizes
        is_word = np.ones(total + count, bool)
        is_word[closing] = False
        text[is_word] = words + count  # separators 0..count-1 are smaller than words and all different
        text[closing] = np.arange(count)
        self.text = text
        size = int(text.max()) + 1
        order = suffix_order(text, int(sizes.max()) + 2)
        bwt = text[order - 1]
        self.first = np.cumsum(np.r_[0, np.bincount(text, minlength=size)])
        self.wavelet = WaveletMatrix(bwt, size)
        self.base = self.wavelet.rank(np.arange(size), np.zeros(size, np.int64))
        owner = np.repeat(np.arange(count), sizes + 1)
        # documents by rank, in suffix order, with the least of every power-of-two range
        self.docs, rank = np.unique(docs, return_inverse=True)
        self.doc_rank = rank.astype(np.int32)
        level = self.doc_rank[owner][order]
        self.least = [level]
        while 2 ** len(self.least) <= len(level):
            half = 1 << len(self.least) - 1
            self.least.append(np.minimum(self.least[-1][:-half], self.least[-1][half:]))

    def back(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the intervals of the suffixes with the symbol put before."""
        n = len(symbols)
        both = self.wavelet.rank(np.r_[symbols, symbols], np.r_[lo, hi]) + np.tile(self.first[symbols] - self.base[symbols], 2)
        return both[:n], both[n:]

    def has_smaller(self, lo: np.ndarray, hi: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Whether an interval holds a suffix of a document smaller than `own`."""
        out = np.zeros(len(lo), bool)
        some = np.flatnonzero(lo < hi)
        level = np.frexp((hi - lo)[some].astype(np.float64))[1] - 1
        for k in np.unique(level):
            i = some[level == k]
            table = self.least[k]
            out[i] = np.minimum(table[lo[i]], table[hi[i] - (1 << int(k))]) < own[i]
        return out


def matched_windows(index: FMIndex, lane: np.ndarray, own: np.ndarray, window: int, first_reach: int = 1) -> list[np.ndarray]:
    """For the segments numbered `lane`, which windows also occur in a segment of a document of smaller rank than `own`.
    `first_reach` windows are tried at once to begin with."""
    asked, windows = lane, np.maximum(index.sizes - window + 1, 0)
    change = np.zeros(len(index.text) + 1, np.int32)
    keep = windows[lane] > 0
    lane, own = lane[keep], own[keep]
    i = np.zeros(len(lane), np.int64)  # first window that isn't decided
    reach = np.full(len(lane), first_reach)  # windows tried at once
    j = np.minimum(i + reach, windows[lane]) - 1
    at = j + window - 1
    lo, hi = np.zeros(len(lane), np.int64), np.full(len(lane), len(index.text), np.int64)
    while len(lane):
        start = index.starts[lane]
        lo, hi = index.back(index.text[start + at], lo, hi)
        ok = index.has_smaller(lo, hi, own)
        done = ok & (at == i)
        missed = ~ok
        # a match down to i: the windows i..j are shared; a mismatch at `at`: those after it, up to j, are
        left = np.where(done, i, at + 1)
        mark = done | (missed & (left <= j))
        np.add.at(change, (start + left)[mark], 1)
        np.add.at(change, (start + j + 1)[mark], -1)
        alone = missed & (reach == 1)  # [at, at + rest] is nowhere, and every window from i to at holds it
        i = np.where(done, j + 1, np.where(alone, at + 1, i))
        reach = np.where(done, np.minimum(2 * reach, 64), np.where(missed, 1, reach))
        fresh_start = done | missed
        j = np.where(fresh_start, np.minimum(i + reach, windows[lane]) - 1, j)
        at = np.where(fresh_start, j + window - 1, at - 1)
        lo, hi = np.where(fresh_start, 0, lo), np.where(fresh_start, len(index.text), hi)
        stay = i < windows[lane]
        if not stay.all():
            lane, own, i, j, reach, at, lo, hi = (x[stay] for x in (lane, own, i, j, reach, at, lo, hi))
    flags = np.cumsum(change) > 0
    return [flags[s : s + n] for s, n in zip(index.starts[asked].tolist(), windows[asked].tolist(), strict=True)]


def shared_windows(words: np.ndarray, sizes: np.ndarray, docs: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """For each segment, which of its windows also occur in a segment of a smaller document."""
    index = FMIndex(words, sizes, docs)
    return matched_windows(index, np.arange(len(sizes)), index.doc_rank.astype(np.int64), window)


def _intervals(flags: np.ndarray) -> list[int]:
    """Begin and end of each run of true flags, in turn."""
    edges = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return edges.tolist()


# --- the job ---------------------------------------------------------------------------------------------------------


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, text): key, the hash of the text, tells rows with the same doc_id apart."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("key"), "text")


def _summaries(rows: DataFrame, window: int) -> DataFrame:
    """(doc_id, key, n_words, sha256 of the words joined by one space, anchors) of each row."""
    hashes, k = Words(), gram_sizes(window)[0]

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, sha, found = [], [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(2)), strict=True):
            words = text.split()
            n.append(len(words))
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            found.append(np.unique(anchors(hashes(words), window, k)) if doc_id is not None and len(words) >= window else np.zeros(0, np.int64))
        ends = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
        lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found)))
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sha), lists], ["doc_id", "key", "n_words", "sha", "anchors"])

    return arrow_map(rows.select("doc_id", "key", "text"), per_batch, "doc_id long, key long, n_words long, sha string, anchors array<long>")


class _Held:
    """Distinct segments of a task with their smallest and largest doc_id; a passage of many documents is collapsed here
    before it is shuffled. At most FLUSH_BYTES of words are held."""

    def __init__(self):
        self.rows: dict[bytes, list] = {}
        self.size = 0

    def add(self, seg: bytes, least: int, most: int, anchor: int, n_words: int, words: bytes) -> None:
        known = self.rows.get(seg)
        if known is None:
            self.rows[seg] = [least, most, anchor, n_words, words]
            self.size += len(words)
        else:
            known[0], known[1] = min(known[0], least), max(known[1], most)

    def out(self) -> list[tuple]:
        rows = [(lo, hi, None, None, None, anchor, seg, n, words) for seg, (lo, hi, anchor, n, words) in self.rows.items()]
        self.rows, self.size = {}, 0
        return rows


_PLACED = "doc_id long, most long, key long, parent binary, first int, anchor long, seg binary, n_words int, words binary"
_PLACED_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]


def _placed_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in _PLACED.split(", ")]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _PLACED_TYPES, strict=True)], names)


def _segments(flagged: DataFrame, window: int) -> DataFrame:
    """Segments of documents (doc_id, key, text, anchors: the shared ones).

    Each run of windows gives a narrow row that places it in its document; the words of equal segments are handed on once
    by each task, with the smallest and the largest doc_id.
    """
    hashes, k = Words(), gram_sizes(window)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for batch in batches:
            rows = []
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc, key, text, shared in zip(ids, keys, utf8(batch.column(2)), batch.column(3), strict=True):
                words = text.split()
                a = anchors(hashes(words), window, k)
                first, count = _runs(a)
                pick = np.isin(a[first], np.asarray(shared.values.to_numpy()))
                for f, n in zip(first[pick].tolist(), count[pick].tolist(), strict=True):
                    part = b" ".join(words[f : f + n + window - 1])
                    seg = xxhash.xxh3_128_digest(part)
                    rows.append((doc, None, key, None, f, int(a[f]), seg, n + window - 1, None))
                    held.add(seg, doc, doc, int(a[f]), n + window - 1, part)
                if held.size >= FLUSH_BYTES:
                    rows += held.out()
            if rows:
                yield _placed_batch(rows)
        if held.rows:
            yield _placed_batch(held.out())

    return flagged.select("doc_id", "key", "text", "anchors").mapInArrow(tidy(run), _PLACED)


def _recut(texts: DataFrame, window: int, k: int) -> DataFrame:
    """The segments `texts` (seg, least, most, words) cut finer, by anchors of k-word grams: rows that place a piece in its
    parent (with the parent's smallest doc_id), and the distinct pieces with their words, as `_segments` gives them."""
    hashes = Words()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for batch in batches:
            rows = []
            for parent, least, most, text in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                words = text.split()
                a = anchors(hashes(words), window, k)
                for f, n in zip(*(x.tolist() for x in _runs(a)), strict=True):
                    part = b" ".join(words[f : f + n + window - 1])
                    seg = xxhash.xxh3_128_digest(part)
                    rows.append((least, None, None, parent, f, int(a[f]), seg, n + window - 1, None))
                    held.add(seg, least, most, int(a[f]), n + window - 1, part)
                if held.size >= FLUSH_BYTES:
                    rows += held.out()
            if rows:
                yield _placed_batch(rows)
        if held.rows:
            yield _placed_batch(held.out())

    return texts.select("seg", "least", "most", "words").mapInArrow(tidy(run), _PLACED)


def _search_shard(window: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, list] = {}  # distinct segments; copies from several tasks end here as they stream in
        for batch in batches:
            for seg, lo, hi, words in zip(*(batch.column(c).to_pylist() for c in ("seg", "least", "most", "words")), strict=True):
                have = known.setdefault(seg, [lo, hi, words])
                have[0], have[1] = min(have[0], lo), max(have[1], hi)
        segments = [w.split() for _, _, w in known.values()]
        docs, last = (np.array([x[k] for x in known.values()], np.int64) for k in (0, 1))
        sizes = np.array([len(x) for x in segments], np.int64)
        flat = [w for x in segments for w in x]
        number = {w: i for i, w in enumerate(dict.fromkeys(flat))}
        symbols = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
        index = FMIndex(symbols, sizes, docs)
        first = matched_windows(index, np.arange(len(sizes)), index.doc_rank.astype(np.int64), window)
        several = np.flatnonzero(last > docs)
        others = dict(zip(several.tolist(), matched_windows(index, several, np.searchsorted(index.docs, last[several]), window, MAX_RUN), strict=True))
        rows, shared, rest = [], [], []
        for k, flags in enumerate(first):
            a, b = _intervals(flags), _intervals(others[k]) if k in others else []
            if a or b:
                rows.append(k)
                shared.append(a)
                rest.append(b)
        lists = pa.list_(pa.int32())
        columns = [pa.array(list(known), pa.binary()).take(pa.array(rows, pa.int64())), pa.array(docs[rows]), pa.array(shared, lists), pa.array(rest, lists)]
        yield pa.record_batch(columns, ["seg", "least", "shared", "rest"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from tidy(found)(batches)

    return search


def _ranges(least: str, most: str) -> list:
    return [F.min(least).alias("least"), F.max(most).alias("most")]


def _put_together(inside: DataFrame, verdict: DataFrame) -> DataFrame:
    """(seg, least, shared, rest) of segments from those of their pieces; `inside` (parent, least, more, seg) places a piece in
    its parent. A piece that a smaller document than the parent's smallest has is one of `rest` for all documents."""
    of_piece = verdict.select("seg", F.col("least").alias("least_piece"), "shared", "rest")
    met = inside.join(of_piece, "seg").groupBy("parent").agg(F.min("least").alias("least"), F.collect_list(F.struct("more", "least_piece", "shared", "rest")).alias("found"))
    moved = lambda ends, by: F.transform(ends, lambda e: e + by)
    shared = F.transform("found", lambda x: moved(F.when(F.col("least") > x["least_piece"], x["rest"]).otherwise(x["shared"]), x["more"]))
    rest = F.transform("found", lambda x: moved(x["rest"], x["more"]))
    return met.select(F.col("parent").alias("seg"), "least", F.flatten(shared).alias("shared"), F.flatten(rest).alias("rest"))  # bounded by MAX_RUN windows


def removed_windows(flagged: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, key, spans: array<struct<b, e>>) for documents of `flagged` (doc_id, key, text, anchors) with windows that
    also start in a document with a smaller doc_id; b and e are first and one past the last such window of a run."""
    placed = written(_segments(flagged, window), "segments")
    places = placed.where("words IS NULL").select("doc_id", "key", "first", "seg")
    texts = placed.where("words IS NOT NULL").select(F.col("doc_id").alias("least"), "most", "anchor", "seg", "n_words", "words")
    limit, calm, levels, total = shard_words // SHARE, [], [], 0
    for k in [*gram_sizes(window)[1:], None]:
        segs = texts.groupBy("anchor", "seg").agg(F.max("n_words").alias("n_words"))
        weights = written(segs.groupBy("anchor").agg(F.sum("n_words").alias("weight")), "anchor-weights")  # a number for each anchor
        crowded = weights.where(F.col("weight") > limit).select("anchor") if k else weights.where("false")
        many = crowded.count()
        total += weights.where(F.col("weight") <= limit if k else F.lit(True)).agg(F.sum("weight")).first()[0] or 0
        if not many:
            calm.append(texts)
            break
        crowded = small_or_shuffled(crowded, many)
        calm.append(texts.join(crowded, "anchor", "left_anti"))
        finer = written(_recut(texts.join(crowded, "anchor", "left_semi"), window, k), "finer-segments")
        pieces = finer.where("words IS NOT NULL").select(F.col("doc_id").alias("least"), "most", "anchor", "seg", "n_words", "words")
        shared = written(pieces.groupBy("anchor").agg(*_ranges("least", "most")).where("least < most").select("anchor"), "finer-anchors")
        texts = pieces.join(small_or_shuffled(shared), "anchor", "left_semi")
        inside = finer.where("words IS NULL").groupBy("parent", F.col("first").alias("more"), "seg").agg(F.min("doc_id").alias("least"))
        levels.append(inside)
    shards = max(1, round(total / (FILL * shard_words)))  # no anchor has more than a share of one
    dealt = None
    for part in calm:
        part = part.select(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"), "seg", "least", "most", "words")
        dealt = part if dealt is None else dealt.unionByName(part)
    verdict = dealt.groupBy("shard").applyInArrow(_search_shard(window), "seg binary, least long, shared array<int>, rest array<int>")
    verdict = written(verdict, "verdicts")
    for inside in reversed(levels):
        verdict = verdict.unionByName(written(_put_together(inside, verdict), "verdicts-above"))
    found = places.join(verdict, "seg").select("doc_id", "key", "first", F.when(F.col("doc_id") > F.col("least"), F.col("rest")).otherwise(F.col("shared")).alias("found"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.floor(F.size("found") / 2).cast("int") - 1),
        lambda i: F.struct((F.col("first") + F.element_at("found", 2 * i + 1)).alias("b"), (F.col("first") + F.element_at("found", 2 * i + 2)).alias("e")),
    )
    each = found.where(F.size("found") > 0).select("doc_id", "key", F.explode(pairs).alias("s"))
    return each.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("s")).alias("spans"))  # bounded by one document's windows


def _kept(words: list[bytes], spans, window: int) -> list[bytes]:
    cover = np.zeros(len(words) + 1, np.int32)
    for s in spans:
        cover[s["b"]] += 1
        cover[min(s["e"] + window - 1, len(words))] -= 1
    keep = np.cumsum(cover[:-1]) == 0
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def _changed(rows: DataFrame, summaries: DataFrame, window: int, shard_words: int) -> DataFrame:
    """(doc_id, key, n_removed, text: the kept words joined by one space) of the documents that lose words.

    Only documents with shared anchors take their texts along, and those twice.
    """
    anchored = summaries.select("doc_id", "key", F.explode("anchors").alias("anchor"))
    shared = written(anchored.groupBy("anchor").agg(*_ranges("doc_id", "doc_id")).where("least < most").select("anchor"), "shared-anchors")
    lists = written(anchored.join(shared, "anchor").groupBy("doc_id", "key").agg(F.collect_set("anchor").alias("anchors")), "anchor-lists")
    flagged = written(rows.join(lists.hint("merge"), ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]), "flagged")
    spans = written(removed_windows(flagged, window, shard_words), "removed-windows")
    hit = flagged.select("doc_id", "key", "text").join(spans.hint("merge"), ["doc_id", "key"])

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        gone, texts = [], []
        for text, found in zip(utf8(batch.column(2)), batch.column(3).to_pylist(), strict=True):
            words = text.split()
            kept = _kept(words, found, window)
            gone.append(len(words) - len(kept))
            texts.append(b" ".join(kept))
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(gone, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "key", "n_removed", "text"])

    return arrow_map(hit, per_batch, "doc_id long, key long, n_removed long, text string")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 of the kept words joined by one space.

    A word is removed if a window over it also starts in a document with a smaller doc_id. A null or empty text has no
    words. A row with a null id neither removes nor loses words; rows that repeat an id count as one document; other
    columns are ignored; an empty table gives an empty one. Words are split at ASCII white space and compared unchanged.
    """
    rows = _keyed(docs, id_col, text_col)
    summaries = written(_summaries(rows, window), "word-summaries")
    changed = _changed(rows, summaries, window, shard_words).select("doc_id", "key", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept"))
    joined = summaries.select("doc_id", "key", "n_words", "sha").join(written(changed, "changed"), ["doc_id", "key"], "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept", "sha").alias("kept_sha256"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """`docs` with the repeated words removed from its texts, the kept ones joined by one space; texts that lose nothing
    stay as they are. n_chars, if there, follows the text; other columns, of whatever names, and all rows stay. Edge cases
    as in `report`; an empty table gives an empty one. Changed texts grow with the table, so their join always shuffles."""
    rows = _keyed(docs, id_col, text_col)
    summaries = written(_summaries(rows, window), "word-summaries")
    changed = written(_changed(rows, summaries, window, shard_words).drop("n_removed"), "changed-texts")
    own_id, own_key, new = fresh(docs, "own_id", "own_key", "new_text")
    changed = changed.select(F.col("doc_id").alias(own_id), F.col("key").alias(own_key), F.col("text").alias(new))
    marked = docs.withColumns({own_id: F.col(id_col).cast("long"), own_key: F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    out = marked.join(changed.hint("merge"), [own_id, own_key], "left")
    fresh_text = {text_col: F.coalesce(F.col(new), F.col(text_col))}
    if "n_chars" in docs.columns:
        fresh_text["n_chars"] = F.coalesce(F.length(new), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumns(fresh_text).select(*[F.col(f"`{c}`") for c in docs.columns])
