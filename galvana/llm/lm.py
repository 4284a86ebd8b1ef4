"""Language-model scores from a log-bilinear model trained with noise-contrastive estimation.

Word counts are gathered from all training documents, which are those whose id isn't held out. The entries of the model
(`bilinear`) are the most frequent words, their number following the cube root of the corpus, an end mark, and CLASSES
classes of all other words by their last letters; within a class a word has its share of add-one counts, and one share is
kept for all words never seen. So every word has a normalised probability given the words before it in its document.

The model is fitted to all training documents, one part of them in each of ROUNDS rounds: the part's documents are dealt to
trainers of TOKENS_A_TRAINER tokens, every trainer passes over its own, and the trainers' parameters are averaged after
the round. The model is mixed with the unigram distribution, at the weight that suits all training documents best, each
judged by a trainer before it learns from it. Texts are coded once, for training and for scoring.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bilinear
from .common import tidy, written

#: Frequent words whose counts are sent to every task; the rest is joined.
HEAD_WORDS = 1 << 17
#: Words with entries of their own: this many times the cube root of the training tokens.
ENTRY_SCALE = 24
CLASSES = 512
ENDING = 3
MODULUS, HELD_REMAINDER = 7, 2
#: Rounds of training; each training document takes part in the one that its id gives.
ROUNDS = 2
TOKENS_A_TRAINER = 2_000_000
#: Batches in a round, all trainers together, at least; small corpora are passed over several times.
LEAST_STEPS = 240
MIXTURES = tuple(k / 20 for k in range(20)) + (0.98, 0.995)
#: Values of a part of the parameters, and trainers whose parts are summed at once.
PART, FAN = 1 << 16, 32
_FIT = "fit"
_SUMS = "name string, at long, trainer long, weight double, part binary"
#: Bytes of text that are split into words at once, but a whole text at least.
SLICE = 1 << 24
#: Tokens that are scored at once.
CHUNK = 1 << 15
LOOK_BACK = bilinear.NEAR + bilinear.WIDE_SPAN


def _crc(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def is_held_out(doc_id: int | None) -> bool:
    return _crc(doc_id) % MODULUS == HELD_REMAINDER


def round_of(doc_id: int | None) -> int:
    """The round in which a document is learnt; -1 for those that are held out."""
    return -1 if is_held_out(doc_id) else _crc(doc_id) // MODULUS % ROUNDS


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list, pa.Array]]:
    """(column of ids, list of ids, texts) of some rows of (doc_id, text) at a time, SLICE bytes of text or one row; a null text is empty."""
    for batch in batches:
        texts = pc.fill_null(batch.column(1).cast(pa.string()), "")
        sums = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            until = int(np.searchsorted(sums, (sums[at - 1] if at else 0) + SLICE, "right"))
            ids = batch.column(0).slice(at, max(until, at + 1) - at)
            yield ids, ids.to_pylist(), texts.slice(at, len(ids))
            at += len(ids)


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in order, and where those of each text begin and end among them. What is before a leading or
    after a trailing space comes as an empty word, which is none."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    return lists.flatten().cast(pa.binary()), lists.offsets.to_numpy().astype(np.int64)


def class_of(word: bytes) -> int:
    return zlib.crc32(word[-ENDING:]) % CLASSES


def classes_of(words: pa.Array) -> np.ndarray:
    endings = pc.binary_slice(words, -ENDING).dictionary_encode()
    return np.fromiter(map(class_of, endings.dictionary.to_pylist()), np.int64, len(endings.dictionary))[endings.indices.to_numpy()]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word: binary, c) over the training documents of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, texts in slices(batches):
            learnt = texts.filter(pa.array([not is_held_out(i) for i in ids], pa.bool_()))
            words, counts = pc.value_counts(split(learnt)[0]).flatten()
            real = pc.greater(pc.binary_length(words), 0)
            yield pa.record_batch([words.filter(real), counts.filter(real)], ["word", "c"])

    return docs.mapInArrow(tidy(run), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """The most frequent words with their counts (HEAD_WORDS at most), the entries of the model, the totals of the corpus.

    A word's code is its rank among the head words, or else len(head) + its class.
    """

    head: list[bytes]
    counts: np.ndarray  # of the head words
    entries: int  # so many head words have entries of their own
    class_total: np.ndarray  # add-one counts of the words of each class, and one for the unseen
    train_docs: int
    word_total: int
    distinct: int
    end: int = field(init=False)
    entry_of: np.ndarray = field(init=False)  # by code
    share_of: np.ndarray = field(init=False)  # by code: log10 of the share in the class; for words outside the head, of one count
    mass: np.ndarray = field(init=False)  # unigram distribution over the places of entries

    def __post_init__(self):
        h, m = len(self.head), self.entries
        self.groups, size = bilinear.layout(m + 1 + CLASSES)
        at = bilinear.place(np.arange(m + 1 + CLASSES), self.groups, size)
        classes = np.fromiter(map(class_of, self.head), np.int64, h)
        self.end = int(at[m])
        self.entry_of = np.r_[at[:m], at[m + 1 + classes[m:]], at[m + 1 :]]
        log_class = np.log10(self.class_total)
        log_counts = np.log10(self.counts + 1.0)
        self.share_of = np.r_[np.zeros(m), log_counts[m:] - log_class[classes[m:]], -log_class]
        mass = np.zeros(self.groups * size)
        mass[at[:m]] = self.counts[:m] + 1.0
        mass[self.end] = self.train_docs + 1.0
        mass[at[m + 1 :]] = self.class_total
        self.mass = mass / mass.sum()
        self.base_of = np.r_[log_counts, np.zeros(CLASSES)]

    @property
    def tokens(self) -> int:
        return self.word_total + self.train_docs

    @property
    def types(self) -> int:
        return self.distinct + (self.train_docs > 0)


def lexicon_of(counts: DataFrame, train_docs: int, head_words: int = HEAD_WORDS, entry_scale: float = ENTRY_SCALE) -> Lexicon:
    """Head words and totals per class reach the driver; both are bounded."""
    total = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    top = counts.orderBy(F.desc("c"), "word").limit(head_words).toArrow()
    words, n = top["word"].to_pylist(), top["c"].to_numpy()
    entries = min(len(words), round(entry_scale * (total["n"] + train_docs) ** (1 / 3)))
    ending = F.pmod(F.crc32(F.substring("word", -ENDING, ENDING)), F.lit(CLASSES)).cast("int")
    by_class = counts.groupBy(ending.alias("k")).agg(F.sum(F.col("c") + 1).alias("n")).collect()
    class_total = np.ones(CLASSES)
    for r in by_class:
        class_total[r["k"]] += r["n"]
    for w, c in zip(words[:entries], n[:entries].tolist(), strict=True):
        class_total[class_of(w)] -= c + 1
    return Lexicon(words, n, entries, class_total, train_docs, total["n"], total["v"])


# --- coding ----------------------------------------------------------------------------------------------------------

_CODED = (
    "doc_id long, held_out boolean, n_tokens long, n_head long, base double, share double, rare array<binary>, rare_n array<int>, "
    "round int, h long, ids binary"
)


def _entry_type(lexicon: Lexicon) -> str:
    return "<u2" if len(lexicon.mass) <= 1 << 16 else "<i4"


def coded(rows: DataFrame, sent) -> DataFrame:
    """Each row of (doc_id, text) by the broadcast lexicon: the sums that don't depend on the model, the words outside the
    head with their numbers, the round of training, a hash, and the entries with the end mark.

    Words are looked up once for each distinct word of a slice."""
    here: dict = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = sent.value
        head, kind = here.setdefault("head", pa.array(lex.head, pa.binary())), _entry_type(lex)
        end = np.log10(lex.train_docs + 1.0)
        for ids, docs, texts in slices(batches):
            words, at = split(texts)
            words = words.dictionary_encode()
            which, words = words.indices.to_numpy(), words.dictionary
            sizes, doc = np.diff(at), np.repeat(np.arange(len(at) - 1), np.diff(at))
            real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
            if not real.all():
                keep = real[which]
                which, doc = which[keep], doc[keep]
                sizes = np.bincount(doc, minlength=len(sizes))
            code = pc.fill_null(pc.index_in(words, value_set=head), -1).to_numpy().astype(np.int64)
            outside = np.flatnonzero(code < 0)
            code[outside] = len(head) + classes_of(words.take(pa.array(outside)))
            # the words outside the head, in each text in the order of the slice's distinct words
            rare = np.flatnonzero((code >= len(head))[which])
            rare, rare_n = np.unique(doc[rare] * len(words) + which[rare], return_counts=True)
            rare_doc = rare // max(len(words), 1)
            where = pa.array(np.searchsorted(rare_doc, np.arange(len(sizes) + 1)), pa.int32())
            n_rare = np.bincount(rare_doc, rare_n, len(sizes)).astype(np.int64)
            # an end mark after the words of each text
            begin = np.cumsum(sizes + 1) - sizes - 1
            ends = begin + sizes
            inside = np.ones(len(which) + len(sizes), bool)
            inside[ends] = False

            def sequence(of_word: np.ndarray, of_end: float) -> np.ndarray:
                out = np.full(len(inside), of_end, of_word.dtype)
                out[inside] = of_word[which]
                return out

            entries = sequence(lex.entry_of[code].astype(kind), lex.end)
            cuts = np.append(begin, len(entries)) * entries.itemsize
            held = pa.py_buffer(entries)
            coded_ids = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(cuts.astype(np.int32)), held])
            view = memoryview(held)
            hashes = [zlib.crc32(view[a:z]) for a, z in pairwise(cuts.tolist())]
            base, share = (np.add.reduceat(sequence(of[code], last), begin) for of, last in ((lex.base_of, end), (lex.share_of, 0.0)))
            n_head = sizes - n_rare + (lex.train_docs > 0)
            columns = [
                ids, pa.array([is_held_out(i) for i in docs], pa.bool_()), *map(pa.array, (sizes + 1, n_head, base, share)),
                pa.ListArray.from_arrays(where, words.take(pa.array(rare % max(len(words), 1)))), pa.ListArray.from_arrays(where, pa.array(rare_n, pa.int32())),
                pa.array(map(round_of, docs), pa.int32()), pa.array(hashes, pa.int64()), coded_ids,
            ]
            yield pa.record_batch(columns, [x.split()[0] for x in _CODED.split(", ")])

    return rows.mapInArrow(tidy(run), _CODED)


# --- training --------------------------------------------------------------------------------------------------------


def training_rows(documents: DataFrame) -> DataFrame:
    """(doc_id, round, h, tokens, ids) of all training documents among the `coded` ones."""
    return documents.where("not held_out").select("doc_id", "round", "h", F.col("n_tokens").alias("tokens"), "ids")


def _parameters(model: bilinear.Model, trainer: int, weight: float) -> Iterator[pa.RecordBatch]:
    """Parts of a trainer's parameters, times its weight."""
    for name, value in model.p.items():
        flat = value.ravel()
        for k in range(0, len(flat), PART):
            part = weight * flat[k : k + PART].astype(np.float64)
            yield _sums_row(name, k, trainer, weight, part)


def _sums_row(name: str, at: int, trainer: int, weight: float, part: np.ndarray) -> pa.RecordBatch:
    values = [pa.array([name]), pa.array([at], pa.int64()), pa.array([trainer], pa.int64()), pa.array([weight]), pa.array([part.tobytes()], pa.binary())]
    return pa.record_batch(values, ["name", "at", "trainer", "weight", "part"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the weighted values of one branch of trainers for one part of the parameters, in the order of the trainers."""
    columns = ("trainer", "weight", "part", "name", "at", "branch")
    held = sorted((row for b in batches for row in zip(*(b.column(c).to_pylist() for c in columns), strict=True)), key=lambda r: r[0])
    if held:
        total = sum((np.frombuffer(r[2]) for r in held[1:]), np.frombuffer(held[0][2]))
        yield _sums_row(held[0][3], held[0][4], held[0][5], sum(r[1] for r in held), total)


def _round(
    spark: SparkSession, documents: DataFrame, model: bilinear.Model, kind: str, seed: int, tokens_a_trainer: int, least_steps: int
) -> np.ndarray:
    """One round of training: `model` gets the mean of what the trainers make of it. Only parameters and sums reach the driver.
    Gives the fit of each of MIXTURES to the documents, judged before they were learnt. `kind` is the type of their ids.

    Documents are dealt by a hash of id and tokens and are sorted, and the trainers' values are summed by a tree in the order
    of the trainers, so neither the model nor its rounding depends on how the table was partitioned."""
    tokens = documents.agg(F.sum("tokens")).first()[0] or 0
    if not tokens:
        return np.zeros(len(MIXTURES))
    trainers = max(1, -(-tokens // tokens_a_trainer))
    steps = -(-least_steps // trainers)
    sent = spark.sparkContext.broadcast((model, steps))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Trains on the documents of one trainer after another; rows come sorted by trainer."""
        start, steps = sent.value
        rows = ((t, np.frombuffer(x.as_buffer(), kind)) for b in batches for t, x in zip(b.column(0).to_pylist(), b.column(1), strict=True))
        for trainer, mine in groupby(rows, key=lambda r: r[0]):
            parts = [ids for _, ids in mine]
            own = start.copy()
            entries = np.concatenate(parts).astype(np.int32)
            fit = own.train(entries, np.fromiter(map(len, parts), np.int64, len(parts)), steps, seed, MIXTURES)
            yield from _parameters(own, trainer, float(len(entries)))
            yield _sums_row(_FIT, 0, trainer, float(len(entries)), fit)

    trainer = F.pmod(F.xxhash64("doc_id", "h"), F.lit(trainers)).alias("trainer")
    dealt = documents.select(trainer, "h", "doc_id", "ids").repartition(trainers, "trainer")
    sums = dealt.sortWithinPartitions("trainer", "h", "doc_id").select("trainer", "ids").mapInArrow(tidy(run), _SUMS)
    while True:
        branches = sums.withColumn("branch", F.floor(F.col("trainer") / FAN))
        sums = branches.groupBy("name", "at", "branch").applyInArrow(_summed, _SUMS)
        if trainers <= FAN:
            break
        trainers = -(-trainers // FAN)
    got, fit = sums.toArrow(), np.zeros(len(MIXTURES))
    for name, at, weight, part in zip(*(got[c].to_pylist() for c in ("name", "at", "weight", "part")), strict=True):
        values = np.frombuffer(part)
        if name == _FIT:
            fit = values
        else:
            model.p[name].reshape(-1)[at : at + len(values)] = values / weight
    return fit


def _log_probs(model: bilinear.Model, documents: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(entries, natural logs) of the tokens of the documents in order, some CHUNK tokens at a time. A long document is
    scored in pieces, each with what its first tokens look back on."""
    parts: list[tuple[np.ndarray, int]] = []
    held = 0

    def scored() -> tuple[np.ndarray, np.ndarray]:
        entries, sizes = np.concatenate([p for p, _ in parts]), np.array([len(p) for p, _ in parts])
        skip = np.array([s for _, s in parts])
        keep = np.arange(len(entries)) - np.repeat(np.cumsum(sizes) - sizes, sizes) >= np.repeat(skip, sizes)
        logs = model.log_probs(bilinear.Contexts(entries, sizes, len(model.mass)))
        return entries[keep], logs[keep]

    for d in documents:
        for a in range(0, len(d), CHUNK):
            begin = max(0, a - LOOK_BACK)
            parts.append((d[begin : a + CHUNK], a - begin))
            held += len(parts[-1][0])
            if held >= CHUNK:
                yield scored()
                parts, held = [], 0
    if parts:
        yield scored()


@dataclass
class Scorer:
    lexicon: Lexicon
    model: bilinear.Model
    weight: float

    def tokens(self, documents: list[np.ndarray]) -> np.ndarray:
        """log10 of the mixed probability of each token's entry."""
        logs = [np.log10(self.weight * np.exp(p) + (1 - self.weight) * self.model.mass[e]) for e, p in _log_probs(self.model, documents)]
        return np.concatenate(logs) if logs else np.zeros(0)


def fitted(documents: DataFrame, lexicon: Lexicon, tokens_a_trainer: int = TOKENS_A_TRAINER, least_steps: int = LEAST_STEPS) -> Scorer:
    """The model fitted on all training documents of the `coded` ones, and its weight against unigrams."""
    model, fit = bilinear.Model(lexicon.mass, lexicon.groups), np.zeros(len(MIXTURES))
    documents = training_rows(documents)
    for k in range(ROUNDS):
        fit = fit + _round(documents.sparkSession, documents.where(F.col("round") == k), model, _entry_type(lexicon), 11 + k, tokens_a_trainer, least_steps)
    return Scorer(lexicon, model, MIXTURES[int(np.argmax(fit))])


def trained(rows: DataFrame, lexicon: Lexicon, tokens_a_trainer: int = TOKENS_A_TRAINER, least_steps: int = LEAST_STEPS) -> Scorer:
    """The model fitted on the training documents of `rows` (doc_id, text)."""
    documents = written(coded(rows, rows.sparkSession.sparkContext.broadcast(lexicon)), "lm-coded")
    return fitted(documents, lexicon, tokens_a_trainer, least_steps)


# --- scoring ---------------------------------------------------------------------------------------------------------


def scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head_words: int = HEAD_WORDS, entry_scale: float = ENTRY_SCALE,
    tokens_a_trainer: int = TOKENS_A_TRAINER, least_steps: int = LEAST_STEPS,
) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Scores are log10 probabilities of the whole text with its end mark: base_score by add-one unigram counts, score by
    the model. A null or empty text is its end mark alone. A null id counts as training, like the empty string. Repeated
    rows are scored, and counted, each; other columns are ignored. Without training documents every count is zero; an
    empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counts = written(word_counts(rows), "word-counts")
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    train_docs = rows.where(crc % MODULUS != HELD_REMAINDER).count()
    lexicon = lexicon_of(counts, train_docs, head_words, entry_scale)
    spark = docs.sparkSession
    documents = coded(rows, spark.sparkContext.broadcast(lexicon)).withColumn("row", F.monotonically_increasing_id())
    documents = written(documents, "lm-coded")
    scorer = fitted(documents, lexicon, tokens_a_trainer, least_steps)
    n, v = lexicon.tokens, lexicon.types
    log_all = float(np.log10(n + v + 1))
    sent, kind = spark.sparkContext.broadcast(scorer), _entry_type(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            if batch.num_rows:
                ids = [np.frombuffer(x.as_buffer(), kind).astype(np.int32) for x in batch.column("ids")]
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                model = np.add.reduceat(own.tokens(ids), np.cumsum(sizes) - sizes)  # every document has its end mark
                yield pa.record_batch([*batch.columns[:-1], pa.array(model + batch.column("share").to_numpy())], [*batch.schema.names[:-1], "model"])

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_head long, base double, share double, model double"
    parts = documents.select("row", "doc_id", "held_out", "n_tokens", "n_head", "base", "share", "ids").mapInArrow(tidy(run), schema)
    parts = written(parts, "lm-rows")
    rare = documents.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.rare_n").alias("times"))
    found = rare.join(counts, "word").groupBy("row").agg(
        F.sum("times").alias("n_rare"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("log_rare")
    )
    joined = parts.join(found, "row", "left")
    log_rare = F.coalesce("log_rare", F.lit(0.0))
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + log_rare - F.col("n_tokens") * F.lit(log_all)).alias("base_score"),
        (F.col("model") + log_rare).alias("score"),
    )
