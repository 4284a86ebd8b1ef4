"""Filter interaction audit: what each order of applying filters keeps, and what each filter alone is worth.

A document's filter failures depend on the whole table only through "identical to a smaller doc_id's text", so one narrow
pass reads the texts and leaves a mask of failures and a digest. Rows are then held as packed bitmaps: in every batch the
rows of a part stand together, begin on a byte border, and have one bitset for each filter and each label. AND-NOT over a
subset of the filters and a popcount give what the subset keeps; partial counts are summed per part. Every figure of every
order follows from the counts of the 32 subsets.

Null texts are empty, a null source is the part ''. A null doc_id has no label and is neither smaller nor larger than any
other. Rows that repeat count each time; a label holds for a doc_id if any of its rows says so. An empty table has no
parts, and so no rows. Other columns are ignored. A text is read whole; memory is bounded by a batch of texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidy, utf8, written

#: Filters in the order of their bits; the last one is the comparison with other documents.
FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Words of a text, below which A fails; shares in percent for B (distinct words) and C (capitals).
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
#: Bits of the labels beside those of the filters.
GOOD, TOXIC = 1 << 5, 1 << 6

_capital = np.zeros(256, np.int64)
_capital[ord("A") : ord("Z") + 1] = 1
_symbol = np.zeros(256, bool)
_symbol[list(b"#$%&*|")] = True
_begins = (np.arange(256) & 0xC0) != 0x80  # first byte of a code point


def failures(data: bytes) -> int:
    """Mask of the filters A to D that a text fails; 0 is the lowest bit, A."""
    words = data.split()  # at space and \x09-\x0D, as for bytes
    raw = np.frombuffer(data, np.uint8)
    capitals, chars = int(_capital[raw].sum()), int(_begins[raw].sum())
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < LEAST_DISTINCT * len(words)) << 1
        | (100 * capitals > MOST_CAPITALS * chars) << 2
        | bool(_symbol[raw].any()) << 3
    )


def _judged(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(doc_id, part, mask of A to D, digest) for every row, in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(2))
            masks = pa.array([failures(t) for t in texts], pa.int32())
            digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            yield pa.record_batch([batch.column(0), batch.column(1), masks, digests], ["doc_id", "part", "mask", "digest"])

    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), part.alias("part"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(tidy(run), "doc_id long, part string, mask int, digest binary")


def _labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, label): one row for each labelled doc_id."""
    bit = lambda c, b: F.max(F.when(F.col(c) == 1, F.lit(b)).otherwise(F.lit(0)))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    return known.agg((bit("quality", GOOD) + bit("toxic", TOXIC)).alias("label"))


def marked(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n): n rows of a part that fail the filters of the mask and hold its labels.

    Rows that agree in all that matters are counted before they are shuffled. The first of equal texts is found by joining
    the least doc_id of every digest back on digest and doc_id together, so a text with many copies is no hot key.
    """
    rows = _judged(docs, id_col, text_col, part_col).groupBy("doc_id", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n"))
    rows = written(rows, "audit-rows")
    named = rows.where(F.col("doc_id").isNotNull())
    first = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    later = F.when(F.col("is_first").isNull(), F.lit(1 << FILTERS.index("E"))).otherwise(F.lit(0))
    named = named.join(first, ["digest", "doc_id"], "left").withColumn("mask", F.col("mask") + later)
    named = named.join(_labelled(labels), "doc_id", "left").withColumn("mask", F.col("mask") + F.coalesce("label", F.lit(0)))
    nameless = rows.where(F.col("doc_id").isNull())
    return named.select("part", "mask", "n").unionByName(nameless.select("part", "mask", "n"))


def _bitset(flags: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Flags of rows as a packed bitmap in which row i has bit at[i]."""
    bits = np.zeros(size, bool)
    bits[at] = flags
    return np.packbits(bits)


def subset_counts(part: np.ndarray, mask: np.ndarray, n: np.ndarray, parts: int) -> np.ndarray:
    """counts[p, k, s]: weight of the rows of part p that pass all filters of subset s; k = 0 all of them, 1 the good, 2 the toxic.

    `n` weighs a row; its binary digits are bitmaps too, so a sum of weights is a sum of popcounts."""
    order = np.argsort(part, kind="stable")
    part, mask, n = part[order], mask[order], n[order]
    sizes = np.bincount(part, minlength=parts)
    begin = np.cumsum(np.r_[0, -(-sizes // 8)])  # in bytes
    rank = np.arange(len(part)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at, width = begin[part] * 8 + rank, int(begin[-1]) * 8
    fails = [_bitset(mask >> i & 1 == 1, at, width) for i in range(len(FILTERS))]
    every = _bitset(np.ones(len(part), bool), at, width)
    kinds = [every, _bitset(mask & GOOD > 0, at, width), _bitset(mask & TOXIC > 0, at, width)]
    digits = [(1 << j, _bitset(n >> j & 1 == 1, at, width)) for j in range(int(n.max()).bit_length())]
    counts = np.zeros((parts, len(kinds), SUBSETS), np.int64)
    for s in range(SUBSETS):
        left = every
        for i, failed in enumerate(fails):
            if s >> i & 1:
                left = left & ~failed
        for k, kind in enumerate(kinds):
            chosen = left & kind
            for weight, digit in digits:
                counts[:, k, s] += weight * np.add.reduceat(np.bitwise_count(chosen & digit).astype(np.int64), begin[:-1])
    return counts


def prefix_counts(rows: DataFrame) -> DataFrame:
    """(part, kept, good, toxic): arrays over the subsets of filters, summed over partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                coded = batch.column(0).dictionary_encode()
                found = subset_counts(
                    coded.indices.to_numpy(zero_copy_only=False), batch.column(1).to_numpy(), batch.column(2).to_numpy(), len(coded.dictionary)
                )
                columns = [pa.array(found[:, k, s]) for k in range(3) for s in range(SUBSETS)]
                yield pa.record_batch([coded.dictionary, *columns], ["part", *names])

    names = [f"{kind}{s}" for kind in ("kept", "good", "toxic") for s in range(SUBSETS)]
    partial = rows.mapInArrow(tidy(run), ", ".join(["part string", *(f"{c} long" for c in names)]))
    total = partial.groupBy("part").agg(*[F.sum(c).alias(c) for c in names])
    return total.select("part", *[F.array(*[f"{kind}{s}" for s in range(SUBSETS)]).alias(kind) for kind in ("kept", "good", "toxic")])


def _shapley(kept: str, bit: int) -> Column:
    """Removals of a filter summed over all orders: a subset of size k stands before it in k!(4-k)! of them."""
    times = [24, 6, 4, 6, 24]
    sets = [s for s in range(SUBSETS) if not s >> bit & 1]
    return sum((F.lit(times[s.bit_count()]) * (F.col(kept)[s] - F.col(kept)[s | 1 << bit]) for s in sets), F.lit(0))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row for each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost
    and shapley, as long; see the module for edge cases."""
    counts = prefix_counts(marked(docs, labels, id_col, text_col, part_col))
    whole = F.lit(SUBSETS - 1)
    shapley = F.array(*[_shapley("kept", i) for i in range(len(FILTERS))])
    steps = counts.withColumn("shapley", shapley).withColumn("filter_order", F.explode(F.lit(ORDERS)))
    steps = steps.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    place = lambda i: F.instr(F.lit(FILTERS), F.substring("filter_order", i, 1)) - 1
    bit = F.array(*[F.pow(F.lit(2), place(i)).cast("int") for i in range(1, len(FILTERS) + 1)])
    through = lambda k: F.aggregate(F.slice(bit, 1, k), F.lit(0), lambda total, x: total + x)
    steps = steps.withColumns({"before": through(F.col("step") - 1), "after": through(F.col("step"))})
    own = F.col("after") - F.col("before")
    lost = lambda c: F.col(c)[F.col("before")] - F.col(c)[F.col("after")]
    kept, fails = F.col("kept"), F.col("kept")[0] - F.col("kept")[own]
    return steps.select(
        "part", "filter_order", "step", kept[F.col("after")].alias("kept"), lost("kept").alias("removed"), (fails - lost("kept")).alias("redundant"),
        (kept[whole - own] - kept[whole]).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"),
        F.col("shapley")[F.round(F.log2(own.cast("double"))).cast("int")].alias("shapley"),
    )


ORACLE_SQL = """
WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
firsts AS (SELECT text, min(doc_id) AS least FROM t GROUP BY text),
words AS (SELECT doc_id, part, text, least, [x FOR x IN string_split_regex(text, '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w FROM t JOIN firsts USING (text)),
judged AS (SELECT doc_id, part,
    (CASE WHEN len(w) < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN least < doc_id THEN 16 ELSE 0 END) AS mask FROM words),
rows AS (SELECT part, mask, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = j.doc_id AND l.quality = 1) AS good,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = j.doc_id AND l.toxic = 1) AS toxic FROM judged j),
masks AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM rows GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT f AS filter_order, 1 AS step, 0 AS before, bit FROM letters
  UNION ALL SELECT o.filter_order || l.f, o.step + 1, o.before + o.bit, l.bit FROM orders o JOIN letters l ON instr(o.filter_order, l.f) = 0 WHERE o.step < 5),
steps AS (SELECT w.filter_order, p.step, p.before, p.bit FROM orders w JOIN orders p ON w.step = 5 AND starts_with(w.filter_order, p.filter_order)),
counted AS (SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN g ELSE 0 END) AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN x ELSE 0 END) AS toxic_lost
  FROM masks, steps GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM counted
"""
