"""SimHash near-duplicates through an index on positional bytes with count filtering.

A 64-bit fingerprint is eight positional bytes. Two fingerprints at four or fewer differing bits agree in at least
four of the eight positions, so a pair must be seen at four positions of the inverted index. Posting lists of single
bytes are long; they are therefore intersected three at a time. Twenty triples of positions are enough for any four
positions to contain one of them (the Turan system of 8 points), so each distinct fingerprint has twenty postings, each
keyed by a triple and its three byte values. For the pairs that meet in a posting list the shared positional bytes are
tallied, pairs with at least four are retained, and their Hamming distance is verified.

Equal fingerprints are collapsed first, so copies never meet as pairs. A posting list of up to SMALL_RUN members gives
its verified pairs; a longer one gives only the edges of a spanning forest; one over CHUNK is cut into chunks which are
compared two by two in separate groups, so no task holds more than two chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, small_or_shuffled, utf8, written
from .graph import components

MAX_DIFFERING_BITS = 4
POSITIONS = 8
#: At most `MAX_DIFFERING_BITS` positions can differ, so this many are equal.
MIN_SHARED = POSITIONS - MAX_DIFFERING_BITS
SMALL_RUN = 8
CHUNK = 4096
SHINGLE = 4
SEED = 42
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def covering_triples() -> list[tuple[int, int, int]]:
    """Triples of positions such that any four of the eight positions contain one.

    Positions fall in classes of 3, 3 and 2 in a ring; a triple lies in one class, or has two positions of a class and
    one of the next.
    """
    kind = [0, 0, 0, 1, 1, 1, 2, 2]
    return [
        t
        for t in combinations(range(POSITIONS), 3)
        for k in [sorted(kind[p] for p in t)]
        if k[0] == k[2] or any(k.count(c) == 2 and k.count((c + 1) % 3) == 1 for c in range(3))
    ]


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of a UTF-8 text: lower-cased A-Z, words between ASCII white space, word shingles.

    A text with fewer words than `shingle` has its whole sequence as its only shingle; one without words gives 0.
    """
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(view[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), "<u8", len(starts)
    )
    counts = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 1 << 16):  # keeps the bit matrix small for very long texts
        bits = np.unpackbits(hashes[part : part + (1 << 16)].view(np.uint8), bitorder="little")
        counts += bits.reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp: signed long) for every row; a null or empty text has fingerprint zero. One narrow pass."""

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = np.fromiter((fingerprint(t) for t in utf8(batch.column(1))), np.uint64, batch.num_rows)
        return pa.record_batch([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(chosen, per_batch, "doc_id long, fp long")


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs reach the guaranteed number of shared positional bytes and are verified by their distance."""
    x = np.bitwise_xor(a, b)
    retained = (x.view(np.uint8).reshape(-1, POSITIONS) == 0).sum(1) >= MIN_SHARED
    retained[retained] = np.bitwise_count(x[retained].view(np.uint64)) <= MAX_DIFFERING_BITS
    return retained


def _forest(prints: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest over near fingerprints, found breadth first."""
    left, out_a, out_b = np.arange(len(prints)), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            hit = _near(np.full(len(left), prints[at]), prints[left])
            new = left[hit]
            out_a += [prints[at]] * len(new)
            out_b += prints[new].tolist()
            queue += new.tolist()
            left = left[~hit]
    return out_a, out_b


def _cross(one: np.ndarray, two: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges that join near fingerprints of two chunks: one for each print of `two` and class of `one` that meet, where
    classes of `one` that a print has met are one class from then on. At most len(one) + len(two) edges."""
    out_a, out_b, label = [], [], np.arange(len(one))
    for b in two:
        near = np.flatnonzero(_near(np.full(len(one), b), one))
        if len(near):
            met, first = np.unique(label[near], return_index=True)
            out_a += [b] * len(met)
            out_b += one[near[first]].tolist()
            if len(met) > 1:
                label[np.isin(label, met)] = met[0]
    return out_a, out_b


def _postings(prints: DataFrame) -> DataFrame:
    byte = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))
    keys = [
        F.lit(k).cast("long") * F.lit(1 << 24) + byte(a) * F.lit(1 << 16) + byte(b) * F.lit(1 << 8) + byte(c)
        for k, (a, b, c) in enumerate(covering_triples())
    ]
    return prints.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _runs(chunk: int):
    """Over rows sorted by key: edges of each posting list; members of the lists longer than `chunk`."""

    def out(kind: int, a, b, c) -> pa.RecordBatch:
        n = len(b)
        cols = [np.full(n, kind, np.int32), np.asarray(a, np.int64), np.asarray(b, np.int64), np.asarray(c, np.int64)]
        return pa.record_batch([pa.array(x) for x in cols], ["kind", "key", "a", "b"])

    def edges(keys: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole runs only."""
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        left = np.repeat(sizes, sizes) - (np.arange(len(keys)) - np.repeat(starts, sizes))
        left[np.repeat(sizes > SMALL_RUN, sizes)] = 0
        for d in range(1, SMALL_RUN):
            i = np.flatnonzero(left > d)
            if not len(i):
                break
            i = i[_near(prints[i], prints[i + d])]
            if len(i):
                yield out(0, np.zeros(len(i)), prints[i], prints[i + d])
        for k in np.flatnonzero(sizes > SMALL_RUN):
            a, b = _forest(prints[starts[k] : starts[k] + sizes[k]])
            if a:
                yield out(0, np.zeros(len(a)), a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_p = np.zeros(0, np.int64), np.zeros(0, np.int64)
        hot: tuple[int, int] | None = None  # key and number of the next chunk of a long run
        for batch in batches:
            keys = np.r_[held_k, batch.column(0).to_numpy(zero_copy_only=False)]
            prints = np.r_[held_p, batch.column(1).to_numpy(zero_copy_only=False)]
            last = np.searchsorted(keys, keys[-1]) if len(keys) else 0
            whole, tail = slice(0, last), slice(last, None)
            if hot and last:  # the rest of a long run ends here
                end = np.searchsorted(keys, hot[0], "right")
                if end:
                    part = prints[:end]
                    yield out(1, np.full(end, hot[0]), np.full(end, hot[1]), part)
                    yield from edges(keys[:end], part)
                hot, whole = None, slice(end, last)
            if whole.stop > whole.start:
                yield from edges(keys[whole], prints[whole])
            held_k, held_p = keys[tail], prints[tail]
            while len(held_k) > chunk:
                number = hot[1] if hot else 0
                part = held_p[:chunk]
                yield out(1, np.full(chunk, held_k[0]), np.full(chunk, number), part)
                yield from edges(held_k[:chunk], part)
                hot = (int(held_k[0]), number + 1)
                held_k, held_p = held_k[chunk:], held_p[chunk:]
        if len(held_k):
            if hot:
                yield out(1, held_k, np.full(len(held_k), hot[1]), held_p)
            yield from edges(held_k, held_p)

    return run


def near_edges(prints: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints `fp` that connect exactly those at few enough differing bits."""
    dealt = _postings(prints).repartition("key").sortWithinPartitions("key")
    found = written(dealt.mapInArrow(_runs(chunk), "kind int, key long, a long, b long"), "postings")
    edges = found.where("kind = 0").select("a", "b")
    hot = found.where("kind = 1").select("key", F.col("a").alias("chunk"), F.col("b").alias("fp"))
    if hot.limit(1).count() == 0:
        return edges.distinct()
    chunks = hot.groupBy("key").agg(F.max("chunk").alias("last"))
    met = (
        hot.join(chunks, "key")
        .select("key", "chunk", "fp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("other"))
        .where("chunk != other")
        .select("key", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "fp")
    )

    def pair(group: pa.Table) -> pa.Table:
        chunk_of, fps = group["chunk"].to_numpy(), group["fp"].to_numpy()
        first = chunk_of == chunk_of.min()
        a, b = _cross(fps[first], fps[~first])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return edges.unionByName(met.groupBy("key", "lo", "hi").applyInArrow(pair, "a long, b long")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id, cluster.

    component_id is the smallest doc_id among the rows reachable through links of four or fewer differing bits; cluster
    is a long that is equal exactly within a component. Null and empty texts share fingerprint zero and are linked to one
    another. Rows that repeat a doc_id each count; a null doc_id is kept but is never the smallest (component_id is null
    only where a component has no other id). Other columns of `docs`, whatever their names, are ignored. An empty table
    gives an empty one.
    """
    rows = written(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    roots = components(near_edges(distinct.select("fp"), chunk))
    named = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select(
        "fp", "rep", F.coalesce("root", "fp").alias("cluster")
    )
    named = written(named, "named")
    # written, so that neither side of the join is an aggregate and a large cluster can be split
    least = written(named.groupBy("cluster").agg(F.min("rep").alias("component_id")), "least")
    by_print = written(named.join(small_or_shuffled(least), "cluster").select("fp", "cluster", "component_id"), "classes")
    return rows.join(by_print, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "cluster"
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` without the near duplicates: of each component the document with the smallest id stays.

    Rows are dropped by id, so rows that repeat the id of a document that stays remain, and so do rows with a null id.
    """
    found = near_duplicates(docs, id_col, text_col)
    gone = found.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays")).where("not stays")
    gone = small_or_shuffled(written(gone.select(F.col("doc_id").alias("__gone_id")), "gone"))
    return docs.join(gone, docs[id_col] == gone["__gone_id"], "left_anti")
