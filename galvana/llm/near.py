"""Near duplicates by the similarity of word shingles, for the pipeline: five words, Jaccard similarity 0.8 or more.

This is the first operator's work, on shingles of five words, at a similarity that the bits of its fingerprints can't
guarantee (figures in the README). Candidates are the links that its index on positional bytes finds between fingerprints,
whatever their similarity. Those further apart come from MinHash: BANDS keys of ROWS minima each. A pair of similarity s
shares no key with probability (1 - s^ROWS)^BANDS, 3e-6 at 0.8 and less above. Documents that are joined by links or keys,
directly or through others, form a block, so every candidate pair lies in one block and the shingles of a document travel
once. In a block the similarity
is computed exactly and gives a spanning forest of the documents that are similar enough. Blocks with many shingles are
cut into parts which are compared two by two, so no task holds more than two parts.

Equal sets of shingles are one node from the start, told from others by a 128-bit hash of the set, so copies never meet as
pairs. Nodes are numbered in the table that lists them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, small_or_shuffled, tidy, utf8, written
from .graph import components
from .simhash import fingerprint, near_edges

SHINGLE = 5
#: Similarity of at least LEAST[0] / LEAST[1].
LEAST = (4, 5)
BANDS, ROWS = 32, 5
#: Shingles of a part of a block; a part exceeds it by less than one document.
PART = 1 << 18
#: Nodes of a key between two heads.
HUB = 256
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_RNG = np.random.default_rng(5)
_ODD = lambda n: _RNG.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE, _TIMES, _FLIP, _ROW = _ODD(SHINGLE), _ODD(BANDS * ROWS)[:, None], _ODD(BANDS * ROWS)[:, None], _ODD(ROWS)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles: lower-cased A-Z, words between ASCII white space.

    A text with fewer words than a shingle has its whole sequence as its only one; one without words has none.
    """
    words = text.translate(_LOWER).split()
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)] if words else [], np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    return np.unique(_mixed(sum(hashes[k : k + n] * _PLACE[k] for k in range(SHINGLE))))


def band_keys(found: np.ndarray) -> np.ndarray:
    """One key for each band; none for an empty set."""
    if not len(found):
        return found
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        np.minimum(least, ((found[at : at + 4096] ^ _FLIP) * _TIMES).min(1), out=least)
    return _mixed((_mixed(least.reshape(BANDS, ROWS)) * _ROW).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def _names(sets: list[np.ndarray]) -> list[pa.Array]:
    """Two columns of 64 bits that name each set."""
    halves = np.frombuffer(b"".join(xxhash.xxh128_digest(s.tobytes(), 7) for s in sets), np.int64).reshape(-1, 2)
    return [pa.array(halves[:, k].copy()) for k in (0, 1)]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _prints(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = utf8(batch.column(1))
    sets = [shingles(t) for t in texts]
    sizes = pa.array([len(s) for s in sets], pa.int64())
    prints = np.fromiter((fingerprint(t, SHINGLE) for t in texts), np.uint64, len(texts)).view(np.int64)
    columns = [batch.column(0), *_names(sets), sizes, _lists([band_keys(s) for s in sets]), pa.array(prints)]
    return pa.record_batch(columns, ["doc_id", "k1", "k2", "n", "bands", "fp"])


def _sets(batch: pa.RecordBatch) -> pa.RecordBatch:
    sets = [shingles(t) for t in utf8(batch.column(0))]
    return pa.record_batch([*_names(sets), _lists(sets)], ["k1", "k2", "shingles"])


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by key: edges that join the nodes of each key. Every HUB-th node of a key is a head; the others are
    linked to the head before them and heads to one another, so paths stay short and no node has many edges."""
    last, count, held = None, 0, np.int64(0)  # key and length so far of the run that goes on, and its latest head
    for batch in batches:
        key, node = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        n = len(key)
        if not n:
            continue
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        place = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))
        if key[0] == last:
            place[: first[1] if len(first) > 1 else n] += count
        back = place % HUB
        is_head = back == 0
        at = np.arange(n) - np.where(is_head, HUB, back)  # where the node to link to lies; before this batch if negative
        other = np.where(at >= 0, node[np.maximum(at, 0)], held)
        linked = (place > 0) & (other != node)
        last, count, held = key[-1], place[-1] + 1, node[-1] if is_head[-1] else other[-1]
        if linked.any():
            yield pa.record_batch([pa.array(other[linked]), pa.array(node[linked])], ["a", "b"])


def forest(sizes: np.ndarray, flat: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest over the similar ones of sets of `sizes`, which follow one another in `flat`.

    Sets whose shingles many others have come first: the text that copies were made from links them all, and what is
    linked needn't be compared again."""
    up, down = LEAST
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    token = np.unique(flat, return_inverse=True)[1]
    order = np.argsort(token, kind="stable")
    posted, by_token = owner[order], token[order]
    left, out_a, out_b = np.ones(len(sizes), bool), [], []
    central = np.bincount(owner, np.bincount(token)[token], len(sizes)) / np.maximum(sizes, 1)

    def index() -> np.ndarray:
        return np.searchsorted(by_token, np.arange(token.max(initial=-1) + 2))

    starts = index()
    while left.any():
        queue = [int(np.argmax(np.where(left, central, -1.0)))]
        left[queue] = False
        while queue and left.any():
            at = queue.pop()
            own = token[ends[at] - sizes[at] : ends[at]]
            begin, many = starts[own], starts[own + 1] - starts[own]
            places = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(many.sum())
            shared = np.bincount(posted[places], minlength=len(sizes))
            new = np.flatnonzero(left & ((up + down) * shared >= up * (sizes + sizes[at])))
            left[new] = False
            out_a += np.minimum(at, new).tolist()
            out_b += np.maximum(at, new).tolist()
            queue += new[np.argsort(central[new])].tolist()
            still = left[posted]
            if 2 * np.count_nonzero(still) < len(still):  # those that are linked needn't be met again
                posted, by_token = posted[still], by_token[still]
                starts = index()
    return out_a, out_b


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def found(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(list(parts))
        nodes, lists = group["node"].to_numpy(), group["shingles"].combine_chunks()
        a, b = forest(lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy())
        yield pa.record_batch([pa.array(nodes[a], pa.int64()), pa.array(nodes[b], pa.int64())], ["a", "b"])

    yield from tidy(found)(batches)


def printed(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, n, bands, fp) of each row of (doc_id, text)."""
    return written(arrow_map(docs, _prints, "doc_id long, k1 long, k2 long, n long, bands array<long>, fp long"), "shingle-prints")


def distinct_sets(rows: DataFrame) -> DataFrame:
    """The nodes: one row for each set among the `printed` rows, with its smallest doc_id."""
    distinct = rows.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    return written(distinct.withColumn("node", F.monotonically_increasing_id()), "shingle-nodes")


def links(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, node): nodes whose fingerprints the first operator links, directly or through others, have the same key."""
    prints = written(rows.select("k1", "k2", "fp").distinct().join(nodes.select("k1", "k2", "node"), ["k1", "k2"]).select("fp", "node"), "node-prints")
    roots = components(near_edges(prints.select("fp").distinct())).select(F.col("node").alias("fp"), "root")
    return prints.join(roots, "fp", "left").select(F.coalesce("root", "fp").alias("key"), "node")


def similar_edges(docs: DataFrame, nodes: DataFrame, linked: DataFrame, part: int = PART) -> DataFrame:
    """Edges (a, b) between nodes that connect exactly the candidates at sufficient similarity: those that share a key of
    `linked` (key, node) or of their bands."""
    postings = nodes.select(F.explode("bands").alias("key"), "node").unionByName(linked)
    chains = postings.repartition("key").sortWithinPartitions("key").mapInArrow(_chains, "a long, b long").distinct()
    blocks = components(chains).select("node", F.col("root").alias("block"))
    inside = Window.partitionBy("block")
    before = F.sum("n").over(inside.orderBy("node").rowsBetween(Window.unboundedPreceding, -1))
    placed = nodes.join(blocks, "node").withColumn("part", F.floor(F.coalesce(before, F.lit(0)) / part)).select(
        "node", "k1", "k2", "rep", "block", "part", F.max("part").over(inside).alias("last")
    )
    placed = written(placed, "blocks")
    wanted = placed.select(F.col("rep").alias("__rep")).distinct()
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("__rep")), "left_semi").select("text")
    sets = arrow_map(texts, _sets, "k1 long, k2 long, shingles array<long>").join(placed, ["k1", "k2"]).dropDuplicates(["node"])
    met = sets.select("node", "shingles", "block", "part", "last", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("other"))
    met = met.where("part != other or last = 0").select("block", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "node", "shingles")
    return written(met.groupBy("block", "lo", "hi").applyInArrow(_similar, "a long, b long"), "similar")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: int = PART) -> DataFrame:
    """One row per input row: doc_id, component_id, the smallest doc_id among the rows reachable through similar ones.

    Null and empty texts are equal. Rows that repeat a doc_id each count; a null doc_id is kept but is never the smallest.
    """
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = printed(chosen)
    nodes = distinct_sets(rows)
    roots = components(similar_edges(chosen, nodes, links(rows, nodes), part)).select("node", "root")
    reps = nodes.select("node", "k1", "k2", "rep")
    least = written(roots.join(reps.select("node", "rep"), "node").groupBy("root").agg(F.min("rep").alias("least")), "least")
    joined = written(roots.join(small_or_shuffled(least), "root").select("node", "least"), "classes")
    named = reps.join(joined, "node", "left").select("k1", "k2", F.coalesce("least", "rep").alias("component_id"))
    return rows.select("doc_id", "k1", "k2").join(named, ["k1", "k2"]).select("doc_id", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` without the near duplicates: of each component the document with the smallest id stays.

    Rows are dropped by id, so rows that repeat the id of a document that stays remain, and so do rows with a null id.
    """
    found = near_duplicates(docs, id_col, text_col)
    gone = found.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays")).where("not stays")
    gone = small_or_shuffled(written(gone.select(F.col("doc_id").alias("__gone_id")), "gone"))
    return docs.join(gone, docs[id_col] == gone["__gone_id"], "left_anti")
