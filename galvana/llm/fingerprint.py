"""Canonical exact fingerprints of documents.

A text is normalised to NFKC, case-folded, normalised again, and its runs of white space are folded to one space. The
fingerprint is a 128-bit xxhash of that canonical text. Texts whose wide hash is equal form a bucket, and within a bucket
the canonical bytes are compared: a bucket with more than one text gets a suffix for each, so equal fingerprints always
mean equal canonical texts. Only DataFrame functions run; Unicode comes from the ICU library on Spark's class path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, small_or_shuffled, written

#: Rows of a run of ids, within which neighbours are found; a run is sorted in one task.
ROWS_A_RUN = 1 << 14
_NFKC = ("com.ibm.icu.text.Normalizer", "compose")
_FOLD = ("com.ibm.icu.lang.UCharacter", "foldCase")


def _icu(names: tuple[str, str], column: Column) -> Column:
    return F.reflect(F.lit(names[0]), F.lit(names[1]), column, F.lit(True))


def canonical(column: Column) -> Column:
    """Canonical form of a string column; null counts as empty."""
    text = F.coalesce(column, F.lit(""))
    plain = ~F.rlike(text, F.lit(r"[^\x00-\x7F]"))
    full = _icu(_NFKC, _icu(_FOLD, _icu(_NFKC, text)))
    folded = F.when(plain, F.lower(text)).otherwise(full)  # for ASCII, folding is lower-casing and nothing composes
    return F.btrim(F.regexp_replace(folded, r"(?U)\s+", " "))


def wide_hash(column: Column, bits: int = 64) -> tuple[Column, Column]:
    """Two independent xxhash64 values; `bits` narrows both, for tests of colliding buckets."""
    mask = F.lit((1 << bits) - 1 if bits < 64 else -1).cast("long")
    return F.xxhash64(column).bitwiseAND(mask), F.xxhash64(F.lit("second"), column).bitwiseAND(mask)


def _hex(h1: str, h2: str) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(h1), 16, "0"), F.lpad(F.hex(h2), 16, "0")))


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, t1, t2): t1 and t2 are the 128-bit hash of the raw text and name it in narrow tables."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    t1, t2 = wide_hash(F.col("text"))
    return rows.select("doc_id", "text", t1.alias("t1"), t2.alias("t2"))


def _canonical_rows(texts: DataFrame, bits: int) -> DataFrame:
    """`texts` with h1, h2 and canon in place of text; the canonical form is worked out once."""
    with_canon = texts.withColumn("canon", canonical(F.col("text"))).drop("text")
    h1, h2 = wide_hash(F.col("canon"), bits)
    return with_canon.withColumns({"h1": h1, "h2": h2})


def _suffixes(texts: DataFrame) -> DataFrame | None:
    """`texts` (names of a text, h1, h2, canon) of all buckets with several rows, compared byte by byte: None if every
    bucket has one canonical text; otherwise (names, h1, h2, suffix) for the buckets that have more."""
    bytes_differ = F.min("canon") != F.max("canon")
    mixed = written(texts.groupBy("h1", "h2").agg(bytes_differ.alias("mixed")).where("mixed").select("h1", "h2"), "mixed-buckets")
    if mixed.limit(1).count() == 0:
        return None
    inside = written(texts.join(small_or_shuffled(mixed), ["h1", "h2"], "left_semi"), "mixed-texts")
    order = Window.partitionBy("h1", "h2").orderBy("canon")  # distinct texts with the same 128 bits
    numbered = inside.select("h1", "h2", "canon").distinct().withColumn("suffix", F.concat(F.lit("-"), F.row_number().over(order).cast("string")))
    return written(inside.join(numbered, ["h1", "h2", "canon"]).drop("canon").distinct(), "suffixes")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64, bound: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, fingerprint) for each row; equal exactly where the canonical texts are byte for byte equal.

    Null and empty texts, and texts of white space alone, share one fingerprint. Null ids, repeated ids and repeated rows
    are passed through; other columns are ignored; an empty table gives an empty one.
    """
    source = _source(docs, id_col, text_col)
    rows = written(_canonical_rows(source, bits).drop("canon"), "wide-hashes")
    several = written(rows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"), "buckets")
    need = written(rows.join(small_or_shuffled(several, bound=bound), ["h1", "h2"], "left_semi").select("t1", "t2").distinct(), "needed-texts")
    texts = source.drop("doc_id").join(small_or_shuffled(need, bound=bound), ["t1", "t2"], "left_semi")
    suffixes = _suffixes(_canonical_rows(texts, bits))
    if suffixes is None:
        return rows.select("doc_id", _hex("h1", "h2").alias("fingerprint"))
    named = rows.join(small_or_shuffled(suffixes.select("t1", "t2", "suffix"), bound=bound), ["t1", "t2"], "left")
    return named.select("doc_id", F.concat(_hex("h1", "h2"), F.coalesce("suffix", F.lit(""))).alias("fingerprint"))


def _bounds(source: DataFrame, rows_a_run: int) -> tuple[Column, int]:
    """Largest key (doc_id, t1) of each run of ids in rising order, as a scalar subquery, and their number.

    Runs come from a range partitioning of the narrow keys, so their number follows the rows: one entry of some 30 bytes
    for ROWS_A_RUN rows."""
    keys = source.select("doc_id", "t1")
    runs = max(1, -(-keys.count() // rows_a_run))
    tops = keys.repartitionByRange(runs, "doc_id", "t1").groupBy(F.spark_partition_id().alias("run")).agg(F.max(F.struct("doc_id", "t1")).alias("key"))
    listed = written(tops.select("key").distinct().agg(F.sort_array(F.collect_list("key")).alias("bounds"), F.count("*").alias("n")), "run-bounds")
    return listed.select("bounds").scalar(), listed.first()["n"]


def with_next(source: DataFrame, extra: list[str], rows_a_run: int = ROWS_A_RUN) -> DataFrame:
    """`source` (doc_id, text, t1, t2 and `extra`) with a column `after`: those columns of the next row, in descending
    order of doc_id (nulls last), then of t1 and text; after the last row comes the first.

    The keys are cut into runs that end at keys of actual rows. Such an end row also goes, as a guest, to the run above,
    whose last row it follows; so a window within each run sees every neighbour and texts are shuffled once. Rows that
    repeat both id and text lie in one run.
    """
    bounds, runs = _bounds(source, rows_a_run)
    if not runs:
        return source.withColumn("after", F.struct("doc_id", "text", "t1", "t2", *extra))
    key = F.struct("doc_id", "t1")
    powers = F.array(*[F.lit(1 << k) for k in reversed(range(runs.bit_length()))])

    def step(at: Column, power: Column) -> Column:  # how many bounds are below the key, bit by bit
        below = F.element_at(F.col("__bounds"), F.least(at + power, F.lit(runs))) < F.col("__key")
        return F.when((at + power <= runs) & below, at + power).otherwise(at)

    run = F.aggregate(powers, F.lit(0), step)
    placed = source.withColumns({"__bounds": bounds, "__key": key}).withColumn("__run", run)
    is_end = F.element_at(F.col("__bounds"), F.col("__run") + 1) == F.col("__key")
    own = F.struct(F.col("__run").alias("run"), F.lit(False).alias("guest"))
    guest = F.struct(((F.col("__run") + 1) % runs).alias("run"), F.lit(True).alias("guest"))
    dealt = placed.withColumn("__at", F.explode(F.when(is_end, F.array(own, guest)).otherwise(F.array(own)))).drop("__bounds", "__key", "__run")
    order = [F.col("__at.guest"), F.desc_nulls_last("doc_id"), F.desc("t1"), F.desc("text")]
    window = Window.partitionBy("__at.run").orderBy(*order)
    after = F.lead(F.struct("doc_id", "text", "t1", "t2", *extra)).over(window)
    return dealt.withColumn("after", after).where("not __at.guest").drop("__at")


def _edited(text: Column, following: Column) -> Column:
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def edit_report(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64, rows_a_run: int = ROWS_A_RUN, bound: int = BROADCAST_ROWS
) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last floor(n/2) code points replaced by the first as many of the next row's text, in the order
    of `with_next`; a table of one row has itself as next. A canonical digest is equal or not, so likeness is 1.0 for equal
    fingerprints and 0.0 otherwise. Own and edited texts share the buckets. Edge cases as in `fingerprints`.
    """
    source = _source(docs, id_col, text_col)
    own = source.withColumn("canon", canonical(F.col("text")))
    a1, a2 = wide_hash(F.col("canon"), bits)
    own = own.withColumns({"a1": a1, "a2": a2}).drop("canon")
    pairs = with_next(own, ["a1", "a2"], rows_a_run)
    pairs = pairs.select(
        "doc_id", "t1", "t2", "a1", "a2", F.length("text").cast("long").alias("n_chars"), _edited(F.col("text"), F.col("after.text")).alias("edited"),
        *[F.col(f"after.{c}").alias(f"n_{c}") for c in ("t1", "t2", "a1", "a2")],
    )
    pairs = pairs.withColumn("canon", canonical(F.col("edited")))
    b1, b2 = wide_hash(F.col("canon"), bits)
    sha = F.sha2(F.col("edited").cast("binary"), 256)
    rows = written(pairs.withColumns({"b1": b1, "b2": b2, "edited_sha256": sha}).drop("edited", "canon"), "edit-hashes")

    bucket = lambda p: F.struct(F.col(f"{p}1").alias("h1"), F.col(f"{p}2").alias("h2"))
    both = rows.select(F.explode(F.array(bucket("a"), bucket("b"))).alias("h")).select("h.*")
    several = written(both.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"), "edit-buckets")
    pick = lambda p: small_or_shuffled(several.select(F.col("h1").alias(f"{p}1"), F.col("h2").alias(f"{p}2")), bound=bound)
    # own texts of shared buckets; edited ones are built from the two texts they come from
    need_own = rows.join(pick("a"), ["a1", "a2"], "left_semi").select("t1", "t2")
    edits = written(rows.join(pick("b"), ["b1", "b2"], "left_semi").select("t1", "t2", "n_t1", "n_t2").distinct(), "shared-edits")
    need_edits = edits.select(F.explode(F.array(F.struct("t1", "t2"), F.struct(F.col("n_t1").alias("t1"), F.col("n_t2").alias("t2")))).alias("t")).select("t.*")
    marked = need_own.withColumn("own", F.lit(True)).unionByName(need_edits.withColumn("own", F.lit(False)))
    need = written(marked.groupBy("t1", "t2").agg(F.bool_or("own").alias("own"), F.bool_or(~F.col("own")).alias("part")), "needed-texts")
    found = source.drop("doc_id").join(small_or_shuffled(need, bound=bound), ["t1", "t2"])
    parts = written(found.where("part").groupBy("t1", "t2").agg(F.min("text").alias("text")), "edit-parts")
    ahead = parts.select(F.col("t1").alias("n_t1"), F.col("t2").alias("n_t2"), F.col("text").alias("following"))
    built = edits.join(parts, ["t1", "t2"]).join(ahead, ["n_t1", "n_t2"]).select("t1", "t2", "n_t1", "n_t2", _edited(F.col("text"), F.col("following")).alias("text"))
    none = F.lit(None).cast("long")
    whole = found.where("own").select("t1", "t2", none.alias("n_t1"), none.alias("n_t2"), "text")
    suffixes = _suffixes(_canonical_rows(whole.unionByName(built), bits))

    fingerprint, edited_print = _hex("a1", "a2"), _hex("b1", "b2")
    same_next = (F.col("a1") == F.col("n_a1")) & (F.col("a2") == F.col("n_a2"))
    if suffixes is not None:
        of_own = suffixes.where("n_t1 IS NULL").select("t1", "t2", "suffix")
        of_next = of_own.select(F.col("t1").alias("n_t1"), F.col("t2").alias("n_t2"), F.col("suffix").alias("next_suffix"))
        of_edit = suffixes.where("n_t1 IS NOT NULL").select("t1", "t2", "n_t1", "n_t2", F.col("suffix").alias("edited_suffix"))
        rows = (
            rows.join(small_or_shuffled(of_own, bound=bound), ["t1", "t2"], "left").join(small_or_shuffled(of_next, bound=bound), ["n_t1", "n_t2"], "left")
            .join(small_or_shuffled(of_edit, bound=bound), ["t1", "t2", "n_t1", "n_t2"], "left").fillna("", ["suffix", "next_suffix", "edited_suffix"])
        )
        fingerprint, edited_print = F.concat(fingerprint, "suffix"), F.concat(edited_print, "edited_suffix")
        same_next &= F.col("suffix") == F.col("next_suffix")
    named = rows.withColumns({"fingerprint": fingerprint, "edited_fingerprint": edited_print, "same_next": same_next})
    return named.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        (F.col("fingerprint") == F.col("edited_fingerprint")).cast("double").alias("near_edited"), F.col("same_next").cast("double").alias("near_next"),
    )
