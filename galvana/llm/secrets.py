"""Secret scans over a trigram inverted index.

For each rule a Boolean trigram query is derived from its regular expression: a disjunction of conjunctions of trigrams
(lower-cased A-Z) that every match contains. The index holds, for the trigrams that some query names, the documents that
contain them; a conjunction's posting lists are intersected by counting, per document, how many of its trigrams list it.
Candidates are verified by running the rule's expression on their texts. A rule without mandatory trigrams, such as a run
of hexadecimal digits, scans every text. Only DataFrame functions run on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _parser as sre

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, fresh, small_or_shuffled, written

#: Alternatives that the derivation follows before it treats a part as unknown.
MAX_ALTERNATIVES = 64
#: Classes of up to this many characters are followed character by character.
MAX_CLASS = 6


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # for Java's and Python's engine alike
    group: int = 0  # the group whose length counts
    least: int = 0  # shorter ones are dropped after matching


#: Fixed patterns of the scan: the three base kinds, then the kinds that the index adds.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # a run of 24 or more is found by this expression just where the base expression has it as a whole
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
ADDED_RULES = (
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[baprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pay_key", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    # the header, what may be a key's body, and the end line where there is one
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=:,\x20\x09-\x0D]*(?:-----END [A-Z ]{0,20}PRIVATE KEY-----)?"),
)
RULES = BASE_RULES + ADDED_RULES


def _literals(node) -> list[tuple[str | None, ...]]:
    """The alternatives of a parsed expression as runs of literal text; None stands for anything in between."""
    alternatives: list[tuple[str | None, ...]] = [()]
    for op, value in node:
        name = str(op)
        if name == "LITERAL":
            part = [(chr(value),)]
        elif name == "IN" and len(value) <= MAX_CLASS and all(str(o) == "LITERAL" for o, _ in value):
            part = [(chr(v),) for _, v in value]
        elif name == "SUBPATTERN":
            part = _literals(value[-1])
        elif name == "BRANCH":
            part = [x for branch in value[1] for x in _literals(branch)]
        elif name == "MAX_REPEAT" and value[:2] == (0, 1):
            part = [(), *_literals(value[2])]
        elif name == "MAX_REPEAT" and value[0] >= 1:
            part = [(*x, None) for x in _literals(value[2])]
            if value[0] == value[1] == 1:
                part = _literals(value[2])
        else:
            part = [(None,)]
        if len(alternatives) * len(part) > MAX_ALTERNATIVES:
            part = [(None,)]
        alternatives = [a + p for a in alternatives for p in part]
    return list(dict.fromkeys(alternatives))


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Conjunctions of which each match of the pattern meets at least one; empty if some match needs no trigram."""
    found = []
    for alternative in _literals(sre.parse(pattern)):
        runs, run = [], ""
        for x in (*alternative, None):
            if x is None:
                runs.append(run)
                run = ""
            else:
                run += x.lower() if x.isascii() else x
        grams = frozenset(r[i : i + 3] for r in runs for i in range(len(r) - 2))
        if not grams:
            return []
        found.append(grams)
    return [g for g in dict.fromkeys(found) if not any(other < g for other in found)]


def _index(rows: DataFrame, grams: list[str]) -> DataFrame:
    """Posting entries (gram: number of the trigram, k1, k2): one for each listed trigram that a row's text contains."""
    folded = F.lower("text")  # a superset of folding A-Z; candidates are verified
    present = F.filter(F.array(*[F.when(F.contains("folded", F.lit(g)), F.lit(i)) for i, g in enumerate(grams)]), lambda x: x.isNotNull())
    return rows.select("k1", "k2", folded.alias("folded")).select("k1", "k2", F.explode(present).alias("gram"))


def _key(id_col, text_col) -> tuple[Column, Column]:
    """128 bits that name a row."""
    return F.xxhash64(id_col, text_col), F.xxhash64(text_col, id_col)


def _spans(rule: Rule, at: int) -> Column:
    """Spans (begin, end, kind number) of one rule: the gaps between matches and the matches, summed up."""
    matches = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
    counted = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group)) if rule.group else matches
    gaps = F.transform(F.split("text", rule.pattern, -1), lambda x: F.length(x))
    lengths = F.transform(matches, lambda x: F.length(x))
    zipped = F.arrays_zip(gaps.alias("gap"), lengths.alias("size"), F.transform(counted, lambda x: F.length(x)).alias("counts"))
    start = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<b:int,e:int,k:int>>").alias("out")
    )

    def step(acc: Column, x: Column) -> Column:
        b = acc["at"] + x["gap"]
        e = b + F.coalesce(x["size"], F.lit(0))
        span = F.struct(b.alias("b"), e.alias("e"), F.lit(at).alias("k"))
        keep = x["size"].isNotNull() & (x["counts"] >= rule.least)
        return F.struct(e.alias("at"), F.when(keep, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    none = F.array().cast("array<struct<b:int,e:int,k:int>>")
    return F.when(F.rlike("text", F.lit(rule.pattern)), F.aggregate(zipped, start, step, lambda acc: acc["out"])).otherwise(none)


def found_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, bound: int = BROADCAST_ROWS
) -> DataFrame:
    """One row per input row: doc_id, text (null as empty), spans: array<struct<b, e, k>> in code points, end exclusive,
    sorted by begin and then rule number.

    Rows are told apart by 128 bits of hashes of id and text, so null ids and repeated ids or rows are scanned like any
    others. Texts without a match have an empty array; an empty table gives an empty one; other columns are ignored. The
    candidates are joined back by broadcast while a count shows at most `bound` of them, and by a shuffle otherwise.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumns(dict(zip(("k1", "k2"), _key("doc_id", "text"), strict=True)))
    queries = {i: trigram_query(r.pattern) for i, r in enumerate(rules)}
    grams = sorted({g for q in queries.values() for c in q for g in c})
    number = {g: i for i, g in enumerate(grams)}
    # trigram, conjunction, bit of the rule, trigrams of the conjunction
    clauses = [(number[g], c_no, 1 << i, len(c)) for i, q in queries.items() for c_no, c in enumerate(q) for g in c]
    spark = docs.sparkSession
    scanned = F.concat(*[_spans(r, i) for i, r in enumerate(rules) if not queries[i]] or [F.array().cast("array<struct<b:int,e:int,k:int>>")])
    if not clauses:
        return rows.select("doc_id", "text", _ordered(scanned).alias("spans"))
    # as many rows as the rules have trigrams
    asked = F.broadcast(spark.createDataFrame(clauses, "gram int, clause int, rule int, need int"))
    hits = (
        _index(rows, grams).join(asked, "gram")
        .groupBy("k1", "k2", "rule", "clause", "need").agg(F.count_distinct("gram").alias("have"))
        .where("have = need")
        .groupBy("k1", "k2").agg(F.bit_or("rule").alias("rules"))
    )
    joined = rows.join(small_or_shuffled(written(hits, "candidates"), bound=bound), ["k1", "k2"], "left")
    none = F.array().cast("array<struct<b:int,e:int,k:int>>")
    verified = [
        F.when(F.col("rules").bitwiseAND(F.lit(1 << i)) != 0, _spans(r, i)).otherwise(none) for i, r in enumerate(rules) if queries[i]
    ]
    return joined.select("doc_id", "text", _ordered(F.concat(scanned, *verified)).alias("spans"))


def _ordered(spans: Column) -> Column:
    by_start = F.transform(spans, lambda s: F.struct(s["b"].alias("b"), s["k"].alias("k"), s["e"].alias("e")))
    return F.transform(F.array_sort(by_start), lambda s: F.struct(s["b"].alias("b"), s["e"].alias("e"), s["k"].alias("k")))


def _joined(spans: Column, rules: tuple[Rule, ...]) -> Column:
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["b"], s["e"])), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = BROADCAST_ROWS) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256 of the base spans as text, and all spans as text."""
    spans = found_spans(docs, id_col, text_col, RULES, bound)
    base = F.filter("spans", lambda s: s["k"] < len(BASE_RULES))
    count = lambda k: F.size(F.filter("spans", lambda s: s["k"] == k)).cast("long")
    return spans.select(
        "doc_id",
        *[count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE_RULES)],
        F.sha2(_joined(base, RULES).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("spans"), RULES).alias("spans"),
    )


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """`docs` with every found span replaced by `mark`; overlapping spans give one mark. Texts without spans, null texts
    and all other columns, of whatever names, stay as they are; n_chars, if there, follows the text. Null ids, repeated ids
    and repeated rows are masked like others; an empty table gives an empty one. Masked texts grow with the table, so the
    join that puts them back always shuffles."""
    found = found_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).where(F.size("spans") > 0)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"] + 1, F.greatest(s["b"] - acc["at"], F.lit(0)))
        fresh_span = s["b"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["e"]).alias("at"),
            F.when(fresh_span, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"),
        )

    rest = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text")))
    k1, k2, new = fresh(docs, "k1", "k2", "new_text")
    names = dict(zip((k1, k2), _key("doc_id", "text"), strict=True))
    changed = found.select(*[c.alias(n) for n, c in names.items()], F.aggregate("spans", start, step, rest).alias(new)).dropDuplicates([k1, k2])
    changed = written(changed, "redacted")
    own = dict(zip((k1, k2), _key(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))), strict=True))
    out = docs.withColumns(own).join(changed.hint("merge"), [k1, k2], "left")
    columns = {text_col: F.coalesce(F.col(new), F.col(text_col))}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.coalesce(F.length(new), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumns(columns).select(*[F.col(f"`{c}`") for c in docs.columns])
