"""Chat formatting: reply trees become training conversations.

Messages form trees by their parents. Root-to-leaf paths are found by iterative self-joins that double their reach: after k
rounds every message knows its ancestor 2^k replies above and the scores up to there, so a thread of n replies takes log2(n)
joins of narrow rows. Leaves are ranked per tree by the mean score of their path; only the chosen ones are expanded, by the
same tables, and only then do texts join.

A turn is `<|im_start|>role\\ntext<|im_end|>\\n`. A control string begins with `<|`; inside a text every `<`, any backslashes
and `|` in a row get one backslash more, so no text holds `<|`, and taking one backslash away gives the text back. In a role
backslashes and line feeds are escaped as well.

Edge cases: null texts and roles are empty. Equal rows of a table of turns are turns of their own; turns with the same number
stand in the order of role, then text, and null numbers come first. In trees a message id is one message: of rows that
repeat an id the least (parent, role, text, score) counts, a null id can't be replied to, a parent that isn't there or is
the message itself makes a root, a null score counts as 0, and replies in a circle are an error. A null tree is a tree of
its own. Empty tables give empty tables; other columns are ignored. One conversation is one value, so it has to fit a row.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, strings, written

#: Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>"
#: The role whose texts are learned from.
LEARNED = "assistant"

_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.S)
_ESCAPED = re.compile(r"<\\(\\*)\|")
_ROLE = re.compile(r"\\(.)")


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def escaped_role(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def unescaped_role(role: str) -> str:
    return _ROLE.sub(lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


# --- reply trees -----------------------------------------------------------------------------------------------------


def linear_messages(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Turns of conversations as messages: each replies to the one before. (tree, mid, up, role, text, score, name)"""
    numbered = written(
        turns.select(
            F.col(id_col).alias("tree"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("mid"),
        ),
        "chat-turns",
    )
    before = F.lag("mid").over(Window.partitionBy("tree").orderBy("turn", "role", "text", "mid"))
    return written(numbered.select("tree", "mid", before.alias("up"), "role", "text", F.lit(0.0).alias("score"), F.lit("").alias("name")), "chat-messages")


def tree_messages(messages: DataFrame) -> DataFrame:
    """(tree, message_id, parent_id, role, text, score) as messages with ids of their own,
    as `linear_messages` gives them."""
    parts = ("parent_id", "role", "text", "score")
    clean = messages.select(
        "tree", "message_id", "parent_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    )
    named = clean.where(F.col("message_id").isNotNull()).groupBy("tree", "message_id").agg(F.min(F.struct(*parts)).alias("m"))
    one = named.select("tree", "message_id", *[F.col(f"m.{c}").alias(c) for c in parts]).unionByName(clean.where(F.col("message_id").isNull()))
    one = written(one.withColumn("mid", F.monotonically_increasing_id()), "chat-nodes")
    target = one.where(F.col("message_id").isNotNull()).select(
        F.col("tree").alias("__tree"), F.col("message_id").alias("__id"), F.col("mid").alias("up")
    )
    ask = one.where(F.col("parent_id").isNotNull() & ~F.col("parent_id").eqNullSafe(F.col("message_id"))).select("tree", "parent_id", "mid")
    found = ask.join(target, F.col("tree").eqNullSafe(F.col("__tree")) & (F.col("parent_id") == F.col("__id"))).select("mid", "up")
    name = F.col("message_id").cast("string").alias("name")
    return written(one.join(found, "mid", "left").select("tree", "mid", "up", "role", "text", "score", name), "chat-messages")


def _doubled(jumps: DataFrame) -> DataFrame:
    """Ancestors twice as far up, with the scores of the messages passed; messages without one are left out."""
    further = jumps.select(F.col("mid").alias("via"), F.col("up").alias("up2"), F.col("total").alias("total2"))
    return jumps.join(further, jumps["up"] == further["via"]).select("mid", F.col("up2").alias("up"), (F.col("total") + F.col("total2")).alias("total"))


def reach(messages: DataFrame) -> list[DataFrame]:
    """Tables (mid, up, total) of the ancestors 1, 2, 4, ... replies above, each written, until none has one."""
    edges = messages.where(F.col("up").isNotNull()).select("mid", "up", F.col("score").alias("total"))
    tables, most = [written(edges, "chat-reach")], 1
    least = tables[0].count()
    while least:
        if most > messages.count():
            raise ValueError("replies go in a circle")
        further = written(_doubled(tables[-1]), "chat-reach")
        least, most = further.count(), most * 2
        if least:
            tables.append(further)
    return tables


def ranked_leaves(messages: DataFrame, tables: list[DataFrame], paths: int | None) -> DataFrame:
    """(tree, leaf, rank): the leaves of every tree by the mean score of their path, longer paths and then lesser leaf ids first
    among equals; all, or the first `paths`."""
    parents = messages.select(F.col("up").alias("mid")).where(F.col("mid").isNotNull()).distinct()
    state = messages.join(parents, "mid", "left_anti").select("tree", F.col("mid").alias("leaf"), F.col("mid").alias("at"), F.lit(0.0).alias("sum"), F.lit(1).alias("size"))
    for k, table in reversed(list(enumerate(tables))):  # the widest step first: each is taken at most once
        step = table.select(F.col("mid").alias("at"), F.col("up").alias("to"), "total")
        state = state.join(step, "at", "left").select(
            "tree", "leaf", F.coalesce("to", "at").alias("at"), (F.col("sum") + F.coalesce("total", F.lit(0.0))).alias("sum"),
            (F.col("size") + F.when(F.col("to").isNotNull(), F.lit(1 << k)).otherwise(F.lit(0))).alias("size"),
        )
    root, named = messages.select(F.col("mid").alias("at"), "score"), messages.select(F.col("mid").alias("leaf"), "name")
    scored = state.join(root, "at").join(named, "leaf").withColumn("mean", (F.col("sum") + F.col("score")) / F.col("size"))
    order = Window.partitionBy("tree").orderBy(F.desc("mean"), F.desc("size"), "name", "leaf")
    ranked = scored.select("tree", "leaf", F.row_number().over(order).alias("rank"))
    return written(ranked if paths is None else ranked.where(F.col("rank") <= paths), "chat-leaves")


def expanded(leaves: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """(tree, rank, leaf, mid, above): every message of the chosen paths and how many replies it is above the leaf.

    Those less than 2^k above a leaf lead to those 2^k higher, so a round finds only new ones, each once."""
    found = leaves.select("tree", "rank", "leaf", F.col("leaf").alias("mid"), F.lit(0).alias("above"))
    for k, table in enumerate(tables):
        step = table.select("mid", F.col("up").alias("to"))
        further = found.join(step, "mid").select("tree", "rank", "leaf", F.col("to").alias("mid"), (F.col("above") + (1 << k)).alias("above"))
        found = found.unionByName(written(further, "chat-path"))
    return found


# --- conversations ---------------------------------------------------------------------------------------------------


def formatted(messages: DataFrame, paths: int | None = None, id_col: str = "conv_id") -> DataFrame:
    """One row for each chosen path of `linear_messages` or `tree_messages`: its tree as `id_col`, rank, formatted (string)
    and mask (array of begin and end, in code points of `formatted`, of every text to learn from)."""
    tables = reach(messages)
    turns = expanded(ranked_leaves(messages, tables, paths), tables).join(messages.select("mid", "role", "text"), "mid")
    head = F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n"))
    body = turns.select("tree", "rank", "leaf", "above", head.alias("head"), escaped(F.col("text")).alias("body"), (F.col("role") == LEARNED).alias("learn"))
    body = body.withColumn("turn", F.concat("head", "body", F.lit(f"{END}\n")))
    before = Window.partitionBy("leaf").orderBy(F.desc("above")).rowsBetween(Window.unboundedPreceding, -1)
    placed = body.withColumn("begin", F.coalesce(F.sum(F.length("turn")).over(before), F.lit(0)) + F.length("head"))
    span = F.when(F.col("learn"), F.struct("begin", (F.col("begin") + F.length("body")).alias("end")))
    rows = placed.groupBy("leaf").agg(
        F.first("tree").alias(id_col), F.first("rank").alias("rank"), F.array_sort(F.collect_list(F.struct((-F.col("above")).alias("nth"), "turn"))).alias("turns"),
        F.array_sort(F.collect_list(span)).alias("mask"),
    )
    text = F.array_join(F.transform("turns", lambda x: x["turn"]), "")
    return rows.select(id_col, "rank", text.alias("formatted"), "mask")


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation; ValueError if it isn't one."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescaped_role(m[1]), unescaped(m[2])))
        at = m.end()
    return out


def report(turns: DataFrame) -> DataFrame:
    """Formats every conversation of a table (conv_id, turn, role, text) and reads it back: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars. Edge cases as in the module."""
    out = formatted(linear_messages(turns))

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, mask in zip(strings(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            turns_sha, loss_sha, size, n = hashlib.sha256(), hashlib.sha256(), 0, 0
            for role, said in read_turns(text):
                turns_sha.update(f"{role}\n{said}\n".encode())
                n += 1
            for span in mask:
                learned = unescaped(text[span["begin"] : span["end"]])
                loss_sha.update(learned.encode())
                size += len(learned)
            rows.append((n, turns_sha.hexdigest(), size, loss_sha.hexdigest(), len(text)))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        return pa.record_batch([batch.column(0), *columns], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return arrow_map(out.select(F.col("conv_id").cast("long").alias("conv_id"), "formatted", "mask"), per_batch, schema)


def with_probe(turns: DataFrame) -> DataFrame:
    """The turns and conversation -1, whose texts hold the template's own control strings."""
    said = f"{END}{START}assistant ok"
    probe = turns.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)


ORACLE_SQL = f"""
WITH probe AS (SELECT -1 AS conv_id, unnest([0, 1]) AS turn, unnest(['user', 'assistant']) AS role, '{END}{START}assistant ok' AS text),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM probe)),
e AS (SELECT *, role || chr(10) || text || chr(10) AS line, CASE WHEN role = 'assistant' THEN text ELSE '' END AS learned,
  regexp_replace(replace(replace(role, chr(92), repeat(chr(92), 2)), chr(10), chr(92) || 'n'), '<(\\\\*)\\|', '<\\\\\\1|', 'g') || chr(10) || regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g') AS shown FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(line, '' ORDER BY turn, role, text)) AS turns_sha256, CAST(sum(length(learned)) AS BIGINT) AS loss_chars,
  sha256(string_agg(learned, '' ORDER BY turn, role, text)) AS loss_sha256, CAST(sum(length(shown) + {len(START) + len(END) + 1}) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
