"""Phrase collocation mining: frequent phrases of two to five words, each scored by its weakest cut.

1. One pass over the texts cuts them into chunks of one language. A chunk holds its distinct words with their counts, and
   its pieces as 32-bit codes of those words, with a break between pieces; arrays travel compressed by byte planes.
2. Words are counted over all chunks; those that are frequent get dense ids, and each goes back to the chunks that hold it.
   Other words become breaks, since no frequent phrase holds them.
3. Phrases of k words are counted for k = 2 to 5: a phrase is tried only where both of its parts of k - 1 words are frequent.
   A chunk counts its own phrases first; each is a key of k big-endian 32-bit ids, so of fixed width. Keys are dealt by range
   and sorted, and equal neighbours are counted as runs; a frequent run tells its chunks which of their phrases go on.
4. Parts of a frequent phrase are frequent, so the counts of both sides of every cut are joined by key. Products are decimals.

Nothing is kept per word or phrase on the driver or in one task: a run is streamed, and a chunk is bounded by `CHUNK_BYTES`
or one text. Null texts are empty and have no words; a null language is `und`; texts that repeat count each time; scores that
tie are ordered by count and phrase; an empty table has no phrases. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, tidy, utf8, written

LEAST_COUNT, LONGEST, FIRST = 100, 5, 2000
#: Bytes of text in a chunk, unless one text is longer.
CHUNK_BYTES = 4 << 20
#: Salts of a language when the first rows of it are chosen.
SALTS = 64

_LETTERS = bytes(range(65, 91)), bytes(range(97, 123))
_CLASSES = bytes.maketrans(_LETTERS[0] + b".,;:!?\x0a\x0b\x0c\x0d\t", _LETTERS[1] + b"\n" * 10 + b" ")


# --- chunks ----------------------------------------------------------------------------------------------------------


_ZSTD = pa.Codec("zstd", 3)


def _packed(a: np.ndarray) -> bytes:
    """An array of 32-bit numbers, its four byte planes one after another, compressed; its length stands before."""
    planes = np.ascontiguousarray(a.astype(np.uint32).view(np.uint8).reshape(-1, 4).T)
    return len(a).to_bytes(8, "little") + (_ZSTD.compress(planes, asbytes=True) if len(a) else b"")


def _numbers(data: bytes, kind=np.uint32) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(_ZSTD.decompress(data[8:], 4 * n, asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view(np.uint32).ravel().astype(kind)


def coded(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of some texts, their counts, and the texts as codes: word number plus 1, and 0 for a break."""
    raw = np.frombuffer(b"\n".join(texts).translate(_CLASSES), np.uint8)
    inside = (raw != 32) & (raw != 10)
    edge = np.diff(np.r_[False, inside, False].astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.uint32)
    sizes = np.r_[0, np.cumsum(ends - starts)]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(sizes.astype(np.int64)), pa.py_buffer(raw[inside])])
    found = words.cast(pa.large_string()).dictionary_encode()
    codes = found.indices.to_numpy().astype(np.uint32) + 1
    breaks = np.searchsorted(starts, np.flatnonzero(raw == 10))
    breaks = np.unique(breaks[(breaks > 0) & (breaks < len(starts))])
    return found.dictionary.cast(pa.string()), np.bincount(codes)[1:], np.insert(codes, breaks, np.uint32(0))


def chunks(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(chunk, lang, words, counts, seq) of all texts, written."""
    schema = "chunk long, lang string, words array<string>, counts array<long>, seq binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        waiting: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}

        def close(lang: str) -> pa.RecordBatch:
            nonlocal chunk
            words, counts, seq = coded(waiting.pop(lang))
            del size[lang]
            chunk += 1
            row = [[chunk], [lang], pa.array([words.to_pylist()], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64())), [_packed(seq)]]
            return pa.record_batch([x if isinstance(x, pa.Array) else pa.array(x) for x in row], ["chunk", "lang", "words", "counts", "seq"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                waiting.setdefault(lang, []).append(text)
                size[lang] = size.get(lang, 0) + len(text) + 1
                if size[lang] >= CHUNK_BYTES:
                    yield close(lang)
            if sum(size.values()) >= 4 * CHUNK_BYTES:  # many languages
                for lang in list(size):
                    yield close(lang)
        for lang in list(size):
            yield close(lang)

    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    return written(docs.select(lang.alias("lang"), F.col(text_col).alias("text")).mapInArrow(tidy(run), schema), "phrases-chunks", wide=True)


# --- runs ------------------------------------------------------------------------------------------------------------


RUNS = "{key} {kind}, run long, n long, chunk long, ats binary, runs binary"
#: Rows of frequent keys that a task holds before it passes them on, sorted by chunk.
HELD_ROWS = 1 << 22


class _Members:
    """Rows of frequent keys, as one row for each chunk with the numbers `at` (and the runs) packed."""

    def __init__(self, schema: pa.Schema, numbered: bool):
        self.schema, self.numbered, self.parts, self.size = schema, numbered, [], 0

    def add(self, rows: pa.RecordBatch, runs: np.ndarray) -> None:
        self.parts.append((rows.column("chunk").to_numpy(), rows.column("at").to_numpy(), runs if self.numbered else None))
        self.size += rows.num_rows

    def passed_on(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            chunk, at = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1))
            order = np.argsort(chunk, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(chunk[order]) != 0])
            ats = np.split(at[order].astype(np.int32), first[1:])
            runs = np.split(np.concatenate([p[2] for p in self.parts])[order], first[1:]) if self.numbered else [None] * len(first)
            none = pa.nulls(len(first))
            arrays = [none.cast(self.schema.field(0).type), none.cast(pa.int64()), none.cast(pa.int64()), pa.array(chunk[order][first]), pa.array([_packed(x) for x in ats], pa.binary()), pa.array([None if x is None else x.tobytes() for x in runs], pa.binary())]
            yield pa.record_batch(arrays, schema=self.schema)
        self.parts, self.size = [], 0


def frequent_runs(rows: DataFrame, key: str, least: int, label: str, numbered: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows (key, chunk, at, n): (key, run, n) for each key whose n sum to `least` or more; (chunk, ats, runs), with the
    numbers `at` of a chunk's rows of such keys, packed, and their runs if `numbered`; and the written table of both. `run`
    numbers keys: the task in the upper bits, a count in the lower 33.

    Rows are dealt by ranges of the key and sorted, so equal keys are neighbours in one task; a run is counted while it
    streams by, and only the rows before it reached `least` are held, which are fewer than `least`, or one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 33  # of the next frequent key
        held: list[pa.RecordBatch] = []  # rows of the last run, as long as it isn't known to be frequent
        last, total, number = None, 0, None
        members = _Members(schema, numbered)

        def totals(keys, numbers, sums) -> pa.RecordBatch:
            none = pa.nulls(len(sums))
            return pa.record_batch([keys, pa.array(numbers, pa.int64()), pa.array(sums, pa.int64()), none.cast(pa.int64()), none.cast(pa.binary()), none.cast(pa.binary())], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key)
            first = np.flatnonzero(np.r_[True, pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)])
            length = np.diff(np.r_[first, len(keys)])
            sums = np.add.reduceat(batch.column("n").to_numpy(), first)
            goes_on = last is not None and keys[0].as_py() == last
            if goes_on:
                sums[0] += total
            elif number is not None:
                yield totals(pa.array([last], schema.field(0).type), [number], [total])
            good = sums >= least
            numbers = serial + np.cumsum(good) - 1
            if goes_on and number is not None:
                numbers -= 1  # the first run has its number already
                numbers[0] = number
            serial = max(serial, int(numbers[good].max(initial=-1)) + 1)
            if goes_on and good[0]:
                for part in held:
                    members.add(part, np.full(part.num_rows, numbers[0]))
            if not goes_on or good[0]:
                held = []
            if good.any():
                members.add(batch.filter(pa.array(np.repeat(good, length))), np.repeat(numbers[good], length[good]))
            ended = np.flatnonzero(good[:-1])
            if len(ended):
                yield totals(keys.take(pa.array(first[ended])), numbers[ended], sums[ended])
            if not good[-1]:
                held.append(batch.slice(int(first[-1])))
            elif len(first) > 1:
                held = []
            last, total, number = keys[int(first[-1])].as_py(), int(sums[-1]), int(numbers[-1]) if good[-1] else None
            if members.size >= HELD_ROWS:
                yield from members.passed_on()
        yield from members.passed_on()
        if number is not None:
            yield totals(pa.array([last], schema.field(0).type), [number], [total])

    ddl = RUNS.format(key=key, kind=dict(rows.dtypes)[key])
    schema = rows.sparkSession.createDataFrame([], ddl).toArrow().schema
    ordered = rows.select(key, "chunk", "at", "n").repartitionByRange(key).sortWithinPartitions(key)
    out = written(ordered.mapInArrow(tidy(run), ddl), label)
    return out.where(F.col("chunk").isNull()).select(key, "run", "n"), out.where(F.col("chunk").isNotNull()).select("chunk", "ats", "runs"), out


def per_chunk(members: DataFrame) -> DataFrame:
    """(chunk, ats, runs): what was found frequent in each chunk, as lists of packed parts; a chunk bounds them."""
    return members.groupBy("chunk").agg(F.collect_list("ats").alias("ats"), F.collect_list("runs").alias("runs"))


def _ats(parts: pa.ListScalar) -> np.ndarray:
    return np.concatenate([_numbers(x, np.int64) for x in parts.as_py()])


# --- levels ----------------------------------------------------------------------------------------------------------


def dense_ids(totals: DataFrame) -> dict[int, int]:
    """By task: the first of its ids, so that ids run from 1 without gaps. One row for each task reaches the driver."""
    task, count = F.shiftright("run", 33), F.col("run").bitwiseAND((1 << 33) - 1)
    offsets, total = {}, 1
    for t, size in sorted((r[0], r[1]) for r in totals.groupBy(task.alias("t")).agg(F.max(count) + 1).collect()):
        offsets[t], total = total, total + size
    if total > 1 << 32:
        raise ValueError("more frequent words than 32-bit ids")
    return offsets


def _id(offsets: dict[int, int]) -> Column:
    if not offsets:
        return F.lit(0).cast("long")
    first = F.create_map(*[F.lit(x) for t in offsets for x in (t, offsets[t])])
    return (F.element_at(first, F.shiftright("run", 33)) + F.col("run").bitwiseAND((1 << 33) - 1)).cast("long")


#: Keys of two words are one 64-bit number, longer ones are bytes.
LEVEL = "chunk long, lang string, seq binary, pos binary, code binary, keys array<{key}>, counts array<long>"


def _compact(seq: np.ndarray, pos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A chunk without what no phrase of k words at `pos` covers, but for one break after each stretch, and the new places."""
    cover = np.zeros(len(seq) + 1, np.int32)
    np.add.at(cover, pos, 1)
    np.add.at(cover, pos + k, -1)
    inside = np.cumsum(cover)[:-1] > 0
    keep = inside | np.r_[False, inside[:-1]]
    return np.where(inside, seq, np.uint32(0))[keep], (np.cumsum(keep) - 1)[pos]


def _level(chunk: int, lang: str, seq: np.ndarray, pos: np.ndarray, pairs: np.ndarray, k: int) -> pa.RecordBatch:
    """A chunk with its phrases of k words at `pos`; two of them are equal if their `pairs` are."""
    found, first, code, counts = np.unique(pairs, return_index=True, return_inverse=True, return_counts=True)
    if k == 2:
        keys, kind, raw = found.view(np.int64), pa.int64(), (None, None)  # places and codes follow from the sequence
    else:
        data = seq.astype(">u4")[pos[first][:, None] + np.arange(k)].tobytes() if len(found) else b""
        keys, kind, raw = [data[i : i + 4 * k] for i in range(0, len(data), 4 * k)], pa.binary(), (_packed(pos), _packed(code))
    arrays = [
        pa.array([chunk]), pa.array([lang]), pa.array([_packed(seq)]), *[pa.array([x], pa.binary()) for x in raw],
        pa.array([keys], pa.list_(kind)), pa.array([counts], pa.list_(pa.int64())),
    ]
    return pa.record_batch(arrays, ["chunk", "lang", "seq", "pos", "code", "keys", "counts"])


def _two_words(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of two words in a row, and the two as one number."""
    pos = np.flatnonzero((seq[:-1] > 0) & (seq[1:] > 0))
    return pos, seq[pos].astype(np.uint64) << np.uint64(32) | seq[pos + 1]


def first_level(texts: DataFrame, frequent: DataFrame, offsets: dict[int, int]) -> DataFrame:
    """Chunks with ids in place of the codes of frequent words, and their phrases of two words."""
    first = np.zeros(max(offsets, default=-1) + 1, np.int64)
    first[list(offsets)] = list(offsets.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                seq = _numbers(batch.column(2)[i].as_py())
                at, runs = _ats(batch.column(3)[i]), np.concatenate([np.frombuffer(x, np.int64) for x in batch.column(4)[i].as_py()])
                table = np.zeros(int(seq.max(initial=0)) + 1, np.uint32)
                table[at + 1] = first[runs >> 33] + (runs & ((1 << 33) - 1))
                seq = table[seq]
                seq, _ = _compact(seq, _two_words(seq)[0], 2)
                yield _level(batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), seq, *_two_words(seq), 2)

    return texts.select("chunk", "lang", "seq").join(frequent, "chunk").mapInArrow(tidy(run), LEVEL.format(key="long"))


def next_level(level: DataFrame, frequent: DataFrame, k: int) -> DataFrame:
    """The phrases of k words of each chunk, from those of k - 1 words and which of them are frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                seq = _numbers(batch.column(2)[i].as_py())
                if k == 3:
                    pos, pairs = _two_words(seq)
                    code = np.unique(pairs, return_inverse=True)[1]
                else:
                    pos, code = (_numbers(batch.column(c)[i].as_py(), np.int64) for c in (3, 4))
                good = np.zeros(int(code.max(initial=-1)) + 1, bool)
                good[_ats(batch.column(5)[i])] = True
                keep = good[code]
                pos, code = pos[keep], code[keep]
                both = np.flatnonzero(np.diff(pos) == 1)  # the phrase that begins a word later is frequent too
                pairs = code[both].astype(np.uint64) << np.uint64(32) | seq[pos[both] + k - 1]
                seq, pos = _compact(seq, pos[both], k)
                yield _level(batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), seq, pos, pairs, k)

    return level.select("chunk", "lang", "seq", "pos", "code").join(frequent, "chunk").mapInArrow(tidy(run), LEVEL.format(key="binary"))


def exploded(level: DataFrame) -> DataFrame:
    """(key, chunk, at, n) of a level."""
    rows = level.select("chunk", F.posexplode(F.arrays_zip("keys", "counts")).alias("at", "x"))
    return rows.select(F.col("x.keys").alias("key"), "chunk", "at", F.col("x.counts").alias("n"))


def counted(docs: DataFrame, least: int = LEAST_COUNT, longest: int = LONGEST, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, n): words of each language; (lang, word, id, n): frequent words; (key, n, size): frequent phrases and words.

    Tables of one level are deleted when the next one is written."""
    texts = chunks(docs, lang_col, text_col)
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    every = written(texts.select("lang", total.alias("n")).groupBy("lang").agg(F.sum("n").alias("n")), "phrases-totals")
    words = texts.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "x"))
    words = words.select(F.concat("lang", F.lit("\n"), "x.words").alias("key"), "chunk", "at", F.col("x.counts").alias("n"))  # a word holds no line feed
    totals, members, table = frequent_runs(words, "key", least, "phrases-words", numbered=True)
    offsets = dense_ids(totals)
    lexicon = written(totals.select("key", "n", _id(offsets).alias("id")), "phrases-lexicon")
    level = written(first_level(texts, per_chunk(members), offsets), "phrases-level", wide=True)
    forget(texts)
    forget(table)
    bytes_of = lambda c, width: F.unhex(F.lpad(F.hex(c), 2 * width, "0"))  # noqa: E731  big-endian
    found = [lexicon.select(bytes_of("id", 4).alias("key"), "n", F.lit(1).alias("size"))]
    for k in range(2, longest + 1):
        totals, members, table = frequent_runs(exploded(level), "key", least, "phrases-runs")
        found.append(written(totals.select((bytes_of("key", 8) if k == 2 else F.col("key")).alias("key"), "n", F.lit(k).alias("size")), "phrases-frequent"))
        if k < longest:
            further = written(next_level(level, per_chunk(members), k + 1), "phrases-level", wide=True)
        forget(level)
        forget(table)
        level = further
    phrases = found[0]
    for more in found[1:]:
        phrases = phrases.unionByName(more)
    cut = F.length(F.col("key")) - F.locate("\n", F.reverse("key")) + 1
    named = lexicon.select(F.substring(F.col("key"), F.lit(1), cut - 1).alias("lang"), F.substring(F.col("key"), cut + 1, F.length("key")).alias("word"), "id", "n")
    return every, named, phrases


# --- scores ----------------------------------------------------------------------------------------------------------


def _bytes(key: str, begin, size) -> Column:
    return F.substring(F.col(key), begin, size)


def candidates(phrases: DataFrame) -> DataFrame:
    """(key, size, a): phrases of two words or more without those inside a longer one that is as frequent.

    A longer phrase is never more frequent, so it is enough to look one word further on either side."""
    several = phrases.where(F.col("size") > 1)
    width = 4 * (F.col("size") - 1)
    inner = F.explode(F.array(_bytes("key", F.lit(1), width), _bytes("key", F.lit(5), width)))
    inside = several.where(F.col("size") > 2).select(inner.alias("key"), "n").distinct()
    return several.join(inside, ["key", "n"], "left_anti").select("key", "size", F.col("n").alias("a"))


def scored(kept: DataFrame, phrases: DataFrame, lexicon: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, key, a, l, r, n, score) of each candidate at its lowest-scoring cut, the first of them among equals."""
    cuts = kept.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumns({"left": _bytes("key", F.lit(1), 4 * F.col("cut")), "right": _bytes("key", 4 * F.col("cut") + 1, 4 * (F.col("size") - F.col("cut")))})
    side = lambda name, count: phrases.select(F.col("key").alias(name), F.col("n").alias(count))
    cuts = cuts.join(side("left", "l"), "left").join(side("right", "r"), "right")
    first = F.conv(F.hex(_bytes("key", F.lit(1), F.lit(4))), 16, 10).cast("long")
    cuts = cuts.withColumn("id", first).join(lexicon.select("id", "lang"), "id").join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumns({"up": exact("a") * exact("n"), "down": exact("l") * exact("r")})
    cuts = cuts.withColumn("score", F.expr("cast(up as decimal(35,0)) * cast(1000 as decimal(4,0)) div down"))
    best = cuts.groupBy("key").agg(F.min(F.struct("score", "cut", "l", "r", "lang", "a", "n")).alias("b"))
    return best.select("key", *[F.col(f"b.{c}") for c in ("lang", "a", "l", "r", "n", "score")])


def mined(
    docs: DataFrame, least: int = LEAST_COUNT, longest: int = LONGEST, first: int = FIRST, lang_col: str = "lang", text_col: str = "text"
) -> DataFrame:
    """Each language's first phrases by score, then count, then phrase: lang, rank, phrase, a, l, r, n, score."""
    totals, lexicon, phrases = counted(docs, least, longest, lang_col, text_col)
    every = written(scored(candidates(phrases), phrases, lexicon, totals), "phrases-scored")
    # only what can be among the first gets its words; ties stay, so the words can order them
    order = (F.desc("score"), F.desc("a"))
    near = every.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
    near = near.withColumn("place", F.rank().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= first)
    near = near.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= first)
    near = near.withColumn("nth", F.explode(F.sequence(F.lit(0), (F.length("key") / 4).cast("int") - 1)))
    near = near.withColumn("id", F.conv(F.hex(_bytes("key", 4 * F.col("nth") + 1, F.lit(4))), 16, 10).cast("long"))
    spelt = near.join(lexicon.select("id", "word"), "id").groupBy("lang", "key", "a", "l", "r", "n", "score").agg(F.array_sort(F.collect_list(F.struct("nth", "word"))).alias("w"))
    spelt = spelt.withColumn("phrase", F.array_join(F.transform("w", lambda x: x["word"]), " "))
    ranked = spelt.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))).where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = """
WITH t AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, [x FOR x IN string_split_regex(p, '[\\x20\\x09]+') IF x <> ''] AS w FROM (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS p FROM t)),
words AS (SELECT lang, unnest(w) AS word FROM pieces),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
spots AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM pieces WHERE len(w) > 0),
grams AS (SELECT lang, w[i:i + k - 1] AS g, k FROM spots, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(w)),
freq AS (SELECT lang, g, len(g) AS k, count(*) AS f FROM grams GROUP BY lang, g HAVING count(*) >= 100),
inner_parts AS (SELECT DISTINCT lang, unnest([g[1:k - 1], g[2:k]]) AS g, f FROM freq WHERE k > 2),
cand AS (SELECT * FROM freq WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM inner_parts i WHERE i.lang = freq.lang AND i.g = freq.g AND i.f >= freq.f)),
cuts AS (SELECT *, unnest(generate_series(1, k - 1)) AS c FROM cand),
priced AS (SELECT u.lang, u.g, u.f AS a, u.c, x.f AS l, y.f AS r, n, CAST(1000 * CAST(u.f AS HUGEINT) * n // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts u JOIN totals USING (lang) JOIN freq x ON x.lang = u.lang AND x.g = u.g[1:u.c] JOIN freq y ON y.lang = u.lang AND y.g = u.g[u.c + 1:u.k]),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, c) AS nth FROM priced) WHERE nth = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM (SELECT *, array_to_string(g, ' ') AS phrase FROM best)) WHERE rank <= 2000
"""
