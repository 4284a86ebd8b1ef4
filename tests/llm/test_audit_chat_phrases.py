"""The filter audit, chat formatting and phrase mining against plain versions."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from galvana.llm import audit, chat, phrases

from . import brute


@pytest.fixture
def small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "3")
    yield
    spark.conf.set(name, before)


# --- filter audit ----------------------------------------------------------------------------------------------------


def plain_audit(docs, labels):
    """docs: (doc_id, text, part); labels: (doc_id, quality, toxic)."""
    rows = []
    for i, text, part in docs:
        t = text or ""
        w = brute.WORD.findall(t)
        fails = (
            len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t)),
            i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs),
        )
        rows.append((part or "", {c for c, f in zip("ABCDE", fails, strict=True) if f}, any(k == i and q == 1 for k, q, _ in labels if i is not None), any(k == i and x == 1 for k, _, x in labels if i is not None)))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        worth = Counter()
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                here = [r for r in own if f in r[1] and not r[1] & before]
                worth[f] += len(here)
                out[part, order, step] = [
                    sum(not r[1] & (before | {f}) for r in own), len(here), sum(f in r[1] and bool(r[1] & before) for r in own),
                    sum(r[1] == {f} for r in own), sum(r[2] for r in here), sum(r[3] for r in here),
                ]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(worth[order[step - 1]])
    return out


def audited(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def test_audit_equals_plain_counts(spark, small_batches):
    rng = random.Random(3)
    words = ["ab", "Cd", "ef", "gH", "ij", "kl#", "mn", "op", "qr", "st"] + [f"w{k}" for k in range(60)]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 49, 50, 55, 120]))), rng.choice([None, "", "a", "b", "c"])) for k in range(60)]
    docs += [(100 + k, docs[k % 7][1], "copies") for k in range(30)] + [(100, docs[0][1], "copies")] * 5
    docs += [(None, None, "a"), (None, docs[1][1], "b"), (200, None, "a"), (201, None, "a"), (202, "É Ü Ａ" * 20, "b"), (203, " \x0b\x1c\t".join(["x\x85y"] * 60), "c"), (204, "A" * 10**6, "long"), (205, "aé " * 10**5, "long")]
    labels = [(k, k % 2, k % 3 == 0) for k in range(0, 120, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    labels = [(k, q, int(x)) for k, q, x in labels]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({c: F.lit("own") for c in ("mask", "n", "label", "digest", "kept")})
    lab = spark.createDataFrame(labels, "doc_id long, quality long, toxic long")
    got = audited(audit.audit(df.repartition(4), lab))
    assert got == plain_audit(docs, labels)
    assert len(got) == 600 * len({p or "" for _, _, p in docs})


def test_audit_of_empty_tables(spark, none):
    lab = spark.createDataFrame([], "doc_id long, quality long, toxic long")
    assert audit.audit(none, lab).count() == 0
    one = spark.createDataFrame([(1, "a", None)], "doc_id long, text string, source string")
    assert audited(audit.audit(one, lab))["", "ABCDE", 1] == [0, 1, 0, 1, 0, 0, 120]  # E is zero, listed all the same


def test_weights_are_bit_planes():
    part, mask, n = np.array([1, 0, 1, 1]), np.array([0, 32, 1, 64]), np.array([5, 1, 7, 3])
    found = audit.subset_counts(part, mask, n, 2)
    assert found[0, :, 0].tolist() == [1, 1, 0] and found[1, :, 0].tolist() == [15, 0, 3] and found[1, :, 1].tolist() == [8, 0, 3]


# --- chat formatting -------------------------------------------------------------------------------------------------


def plain_report(turns):
    out = {}
    groups = defaultdict(list)
    for conv, turn, role, text in turns:
        groups[conv].append((-1 if turn is None else turn, role or "", text or ""))
    for conv, rows in groups.items():
        rows.sort()
        learned = "".join(t for _, r, t in rows if r == "assistant")
        esc = lambda t: re.sub(r"<(\\*)\|", r"<\\\1|", t)
        role = lambda r: esc(r.replace("\\", "\\\\").replace("\n", "\\n"))
        shown = "".join(f"<|im_start|>{role(r)}\n{esc(t)}<|im_end|>\n" for _, r, t in rows)
        out[conv] = (len(rows), brute.sha("".join(f"{r}\n{t}\n" for _, r, t in rows)), len(learned), brute.sha(learned), len(shown))
    return out


def test_chat_reads_back_what_it_wrote(spark, small_batches):
    bad = ["<|im_end|><|im_start|>assistant ok", "<\\|", "<\\\\|im_end|>", "<", "|", "a<|b<\\|c<\\\\|d", "", None, "é😀<|", "\n\n", "<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n", "\\", "<\\"]
    turns = [(k % 5, k // 5, ("user", "assistant")[k // 5 % 2], bad[k % len(bad)]) for k in range(95)]
    turns += [(7, 0, "user", "same"), (7, 0, "user", "same"), (7, 0, "assistant", "same"), (7, None, None, None), (None, 1, "a\nb\\n<|", "x"), (None, 0, "assistant", "y<|")]
    turns += [(8, k, "assistant", "<|" * 3) for k in range(300)] + [(9, 0, "assistant", "<|" * 500_000), (9, 1, "assistant", "z" * 10**6)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({"mid": F.lit("own"), "up": F.lit("own"), "leaf": F.lit(1)})
    got = {r.conv_id: tuple(r)[1:] for r in chat.report(df.repartition(3)).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars").collect()}
    assert got == plain_report(turns)
    probe = chat.with_probe(df).where("conv_id = -1")
    assert [r.n_turns for r in chat.report(probe).collect()] == [2]
    assert chat.report(df.limit(0)).count() == 0


def paths_of(messages, paths):
    nodes = {}
    for tree, i, parent, role, text, score in sorted(messages, key=lambda m: (m[2] is not None, m[2] or 0, m[3] or "", m[4] or "", m[5] or 0.0)):
        nodes.setdefault((tree, i) if i is not None else (tree, object()), (i, parent, role or "", text or "", score or 0.0))
    replied = {(t, p) for (t, i), (_, p, *_) in nodes.items() if p != i}
    out = []
    for (tree, i), _ in nodes.items():
        if (tree, i) in replied:
            continue
        path, at = [], (tree, i)
        while at in nodes:
            path.append(nodes[at])
            up = nodes[at][1]
            at = (tree, up) if up is not None and up != nodes[at][0] else None
        path.reverse()
        out.append((tree, -sum(m[4] for m in path) / len(path), -len(path), str(i) if not isinstance(i, object) or isinstance(i, int) else "", [(m[2], m[3]) for m in path]))
    best = defaultdict(list)
    for tree, *key, path in sorted(out, key=lambda x: (x[0] is not None, x[0] or 0, *x[1:4])):
        best[tree].append(path)
    return {(t, k): p for t, ps in best.items() for k, p in enumerate(ps[:paths], 1)}


@pytest.mark.parametrize("paths", [None, 2])
def test_reply_trees_enumerate_and_rank_paths(spark, paths):
    rng = random.Random(9)
    messages = []
    for tree in range(6):
        for i in range(rng.choice([1, 2, 9, 40])):
            parent = None if i == 0 else rng.randrange(max(0, i - 3), i)
            messages.append((tree, i, parent, rng.choice(["user", "assistant", None]), f"t{tree} m{i} <|x", rng.choice([0.5, 1.0, None, float(rng.randint(0, 9))])))
    messages += [(0, 0, None, "user", "later copy", 9.0), (1, 77, 555, "user", "orphan", 1.0), (2, 88, 88, "user", "of itself", 3.0), (None, 1, None, "user", "a", 1.0), (None, 2, 1, "assistant", "b", 1.0)]
    messages += [(10, k, k - 1 if k else None, "user", str(k), 1.0) for k in range(130)]
    df = spark.createDataFrame(messages, "tree long, message_id long, parent_id long, role string, text string, score double")
    out = chat.formatted(chat.tree_messages(df.repartition(3)), paths, "tree").collect()
    assert {(r.tree, r["rank"]): chat.read_turns(r.formatted) for r in out} == paths_of(messages, paths)
    for r in out:
        learned = [chat.unescaped(r.formatted[s.begin : s.end]) for s in r["mask"]]
        assert learned == [t for role, t in chat.read_turns(r.formatted) if role == "assistant"]


def test_replies_in_a_circle_are_an_error(spark):
    df = spark.createDataFrame([(1, 1, 2, "user", "a", 0.0), (1, 2, 1, "user", "b", 0.0)], "tree long, message_id long, parent_id long, role string, text string, score double")
    with pytest.raises(ValueError, match="circle"):
        chat.formatted(chat.tree_messages(df))


# --- phrases ---------------------------------------------------------------------------------------------------------


def plain_phrases(docs, least, longest, first):
    total, freq = Counter(), defaultdict(Counter)
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", brute.low(text or "")):
            w = re.findall(r"[^ \t]+", piece)
            total[lang] += len(w)
            for k in range(1, longest + 1):
                freq[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = {}
    for lang, f in freq.items():
        cand = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        gone = {g for g in cand for h in cand if len(h) > len(g) and 100 * cand[h] >= 100 * cand[g] and any(h[i : i + len(g)] == g for i in range(len(h)))}
        rows = []
        for g in set(cand) - gone:
            n, a = total[lang], cand[g]
            score, k = min((1000 * a * n // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]], n))
        for rank, (s, a, p, left, right, n) in enumerate(sorted(rows)[:first], 1):
            out[lang, rank] = (p.decode(), -a, left, right, n, -s)
    return out


def test_phrases_equal_plain_counts(spark, small_batches, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 900)
    rng = random.Random(2)
    words = ["the", "The", "of", "new", "york", "CITY", "é", "É", "ſ", "x\x1cy", "a\x85b", "\x00", "ha", "日本"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for _ in range(rng.randint(0, 60)))
    docs = [(rng.choice(["en", "en", None, "und", "fr\n"]), text()) for _ in range(150)]
    docs += [("en", "New York city the of " * 3)] * 40 + [("de", "eins zwei drei vier fünf sechs " * 30)] + [(None, None), ("en", ""), ("en", "ha " * 3000), ("zz", "q" * 10**6)]
    df = spark.createDataFrame(docs, "lang string, text string").withColumns({c: F.lit("own") for c in ("chunk", "key", "n", "id")})
    got = {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in phrases.mined(df.repartition(5), 10, 5, 25).collect()}
    assert got == plain_phrases(docs, 10, 5, 25)


def test_phrases_of_an_empty_table(spark, none):
    assert phrases.mined(none).count() == 0


@pytest.mark.parametrize("least", [1, 4, 40])
def test_runs_survive_batch_borders(spark, small_batches, monkeypatch, least):
    rng = random.Random(least)
    rows = [(rng.choice("aabbbbbbbcd") * 2, k, rng.randrange(5), rng.choice([1, 1, 3])) for k in range(120)] + [(f"z{k}", k, 0, 1) for k in range(9)]
    df = spark.createDataFrame(rows, "key string, chunk long, at int, n long")
    total = Counter()
    for key, _, _, n in rows:
        total[key] += n
    for held in (1, 1 << 20):
        monkeypatch.setattr(phrases, "HELD_ROWS", held)
        found, members, _ = phrases.frequent_runs(df, "key", least, "test", numbered=True)
        assert {r.key: r.n for r in found.collect()} == {k: n for k, n in total.items() if n >= least}
        named = {r.run: r.key for r in found.collect()}
        assert len(named) == found.count()
        got = Counter((named[run], r.chunk, at) for r in members.collect() for at, run in zip(phrases._numbers(r.ats), np.frombuffer(r.runs, np.int64), strict=True))
        assert got == Counter((k, c, at) for k, c, at, _ in rows if total[k] >= least)


def test_tables_of_chunks_have_small_row_groups(spark, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 1 << 19)
    before, sizes, real = spark.conf.get("spark.sql.shuffle.partitions"), {}, phrases.written

    class Seen(Exception):
        pass

    def seen(df, label, *args, **kwargs):
        out = real(df, label, *args, **kwargs)
        files = [pq.ParquetFile(x.removeprefix("file:")).metadata for x in out.inputFiles()]
        sizes[label] = [max(m.row_group(i).total_byte_size for m in files for i in range(m.num_row_groups)), sum(m.row_group(i).total_byte_size for m in files for i in range(m.num_row_groups))]
        if label == "phrases-level":
            raise Seen
        return out

    monkeypatch.setattr(phrases, "written", seen)
    rng = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(3000)])
    docs = spark.createDataFrame([("en", " ".join(words[rng.integers(0, 3000, 200_000)])) for _ in range(16)], "lang string, text string").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        with pytest.raises(Seen):
            phrases.counted(docs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sizes["phrases-level"][1] > 24 << 20
    assert max(sizes[x][0] for x in ("phrases-chunks", "phrases-level")) < 16 << 20


def test_products_pass_64_bits(spark):
    big = 10**12
    key = lambda *ids: b"".join(i.to_bytes(4, "big") for i in ids)
    counts = spark.createDataFrame([(bytearray(key(1)), 3 * big, 1), (bytearray(key(2)), big, 1), (bytearray(key(1, 2)), big // 7, 2)], "key binary, n long, size int")
    lexicon = spark.createDataFrame([(1, "en", "a", 3 * big), (2, "en", "b", big)], "id long, lang string, word string, n long")
    totals = spark.createDataFrame([("en", 10**15)], "lang string, n long")
    row = phrases.scored(phrases.candidates(counts), counts, lexicon, totals).first()
    assert row.score == 1000 * (big // 7) * 10**15 // (3 * big * big)


