import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from galvana.llm import bilinear, byte_bpe, fingerprint, graph, lm, packing, quality, secrets, sharding, simhash, substrings

from . import brute


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# --- near duplicates -------------------------------------------------------------------------------------------------


def test_triples_cover_every_four_positions():
    from itertools import combinations

    triples = simhash.covering_triples()
    assert len(triples) == 20
    assert all(any(set(t) <= set(four) for t in triples) for four in combinations(range(8), 4))


def test_simhash_components(docs, texts):
    found = rows(simhash.near_duplicates(docs))
    prints = {i: brute.simhash(t) for i, t in texts}
    want = brute.components(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    assert {i: r.component_id for i, r in found.items()} == want
    assert all(int(r.fingerprint, 16) == prints[i] for i, r in found.items())


def test_simhash_long_posting_lists_are_cut_into_chunks(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    prints = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(60)} | {rng.getrandbits(64) for _ in range(20)}
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        edges = [(r.a, r.b) for r in simhash.near_edges(df, chunk=8).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    near = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 4
    assert all(near(a, b) for a, b in edges)
    pairs = {frozenset(e) for e in edges}
    assert brute.components(signed, near) == brute.components(signed, lambda a, b: frozenset((a, b)) in pairs)
    assert len(pairs) < len(signed) * 20


def test_simhash_odd_rows(odd, none):
    found = simhash.near_duplicates(odd).collect()
    assert len(found) == 8
    zero = [r for r in found if r.fingerprint == "0" * 16]
    assert len(zero) == 4 and {r.component_id for r in zero} == {1}
    assert simhash.near_duplicates(none).count() == 0


def test_one_of_each_keeps_the_smallest(docs, texts):
    prints = {i: brute.simhash(t) for i, t in texts}
    want = brute.components(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_components_of_a_long_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501), (7, 7)], "a long, b long")
    found = {r.node: r.root for r in graph.components(df).collect()}
    assert found == {i: 0 for i in range(101)} | {500: 500, 501: 500}


# --- secrets ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("bound", [0, 10**6])
def test_secret_spans(docs, texts, bound):
    found = rows(secrets.report(docs, bound=bound))
    for i, t in texts:
        want = brute.secret_spans(t)
        assert found[i].base_sha256 == brute.sha(want)
        assert ",".join(x for x in found[i].spans.split(",") if x.split(":")[0] in ("assign", "access", "hex")) == want
    assert any("forge_token" in r.spans for r in found.values())


def test_trigram_queries():
    assert secrets.trigram_query(r"[0-9a-f]{24,}") == []
    assert secrets.trigram_query(r"AKIA[A-Z0-9]+") == [frozenset({"aki", "kia"})]
    assert secrets.trigram_query(r"ab(cd|ef)?") == []
    assert {frozenset({"abc", "bcd"}), frozenset({"abe", "bef"})} == set(secrets.trigram_query(r"ab(cd|ef)"))


def test_secrets_odd_rows(odd, none):
    assert sorted((r.n_assign, r.spans) for r in secrets.report(odd).collect()) == [(0, "")] * 8
    assert secrets.report(none).count() == 0


def test_redaction_of_odd_rows_and_clashing_columns(spark, odd, none):
    """Rows that repeat, null ids and null texts are masked or kept like others; columns of any name stay."""
    key = "-----BEGIN RSA PRIVATE KEY-----\nMIIB\nabc+/=\n-----END RSA PRIVATE KEY----- end"
    more = [(5, "token: abcdefgh"), (5, "token: abcdefgh"), (None, "token: abcdefgh"), (9, "a " + key), (9, "-----BEGIN PRIVATE KEY-----\nMIIB")]
    df = odd.unionByName(spark.createDataFrame(more, "doc_id long, text string")).withColumns({c: F.lit("own") for c in ("k1", "k2", "new_text", "spans", "__key", "key")})
    masked = {"token: abcdefgh": "[secret]", "a " + key: "a [secret] end", "-----BEGIN PRIVATE KEY-----\nMIIB": "[secret]"}
    out = secrets.redacted(df)
    assert out.columns == df.columns
    want = sorted((str(r.doc_id), str(masked.get(r.text, r.text)), "own") for r in df.collect())
    assert sorted((str(r.doc_id), str(r.text), r.k1) for r in out.collect()) == want
    assert secrets.redacted(none).count() == 0 and secrets.redacted(none).columns == none.columns


def test_redaction_masks_and_keeps_the_rest(docs, texts):
    found = rows(secrets.redacted(docs))
    for i, t in texts:
        if brute.secret_spans(t):
            assert "[secret]" in found[i].text and not brute.secret_spans(found[i].text) and found[i].n_chars == len(found[i].text)
        elif found[i].text != t:
            pytest.fail(f"{i} changed")


# --- packing ---------------------------------------------------------------------------------------------------------


def packed_ok(found, ids, window):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    for doc, want in ids.items():
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            part = want[at : at + r.length]
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(want), zlib.crc32(np.array(part, "<u4").tobytes()))
            at += r.length
        assert at == len(want)
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert 0 < at <= window


@pytest.mark.parametrize(("window", "block"), [(2048, 1 << 20), (64, 500)])
def test_packing(docs, texts, window, block):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*tok.encode(t, add_special_tokens=False).ids, 1] for i, t in texts}
    packed_ok(packing.packed(docs, window=window, block=block).collect(), ids, window)


def test_packing_special_token_and_odd_rows(spark, odd, none):
    text = "a <|endoftext|> b"
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    packed_ok(packing.packed(df).collect(), {1: [*tok.encode(text, add_special_tokens=False).ids, 1]}, 2048)
    assert sum(r.length for r in packing.packed(odd).collect()) > 8
    assert packing.packed(none).count() == 0


@given(st.lists(st.integers(1, 9), min_size=1, max_size=9), st.integers(0, 3))
@settings(max_examples=60, deadline=None)
def test_cuts_are_optimal(gaps, penalty):
    places = np.cumsum([0, *gaps])
    pens = np.array([0] + [penalty * (k % 2) for k in range(len(gaps))])
    window = 10
    chosen = packing.choose_cuts(places, pens, window)

    def cost(cut):
        steps = np.diff(places[list(cut)])
        return None if (steps > window).any() else (window - steps).sum() + pens[list(cut)[1:]].sum()

    from itertools import combinations

    middle = range(1, len(places) - 1)
    every = [cost((0, *c, len(places) - 1)) for k in range(len(middle) + 1) for c in combinations(middle, k)]
    assert cost(chosen) == min(x for x in every if x is not None)


# --- fingerprints ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("bits", "run", "bound"), [(64, 2000, 10**6), (2, 7, 0)])
def test_edit_report(docs, texts, bits, run, bound):
    found = rows(fingerprint.edit_report(docs, bits=bits, rows_a_run=run, bound=bound))
    down, seen = sorted(texts, reverse=True), {}
    for k, (i, t) in enumerate(down):
        following = down[(k + 1) % len(down)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), brute.sha(edited))
        own, changed, nxt = map(brute.canonical, (t, edited, following))
        assert (r.near_edited, r.near_next) == (float(own == changed), float(own == nxt))
        for print_, text in ((r.fingerprint, own), (r.edited_fingerprint, changed)):
            assert seen.setdefault(print_, text) == text
    assert len(seen) == len({x for k, (_, t) in enumerate(down) for x in (brute.canonical(t), brute.canonical(t[: len(t) - len(t) // 2] + down[(k + 1) % len(down)][1][: len(t) // 2]))})


def test_canonical_form(spark):
    texts = ["ﬁne  Straße X", "FINE STRASSE x", "é", "é", "Ａ", "a", "", " ", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = rows(fingerprint.fingerprints(df))
    same = lambda a, b: found[a].fingerprint == found[b].fingerprint
    assert same(0, 1) and same(2, 3) and same(4, 5) and same(6, 7) and same(7, 8) and not same(0, 2)


def _signed(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


@pytest.mark.parametrize(("bits", "run"), [(64, 1 << 16), (1, 2), (64, 3)])
def test_fingerprints_of_repeated_ids_and_rows(spark, odd, none, bits, run):
    more = [(5, t) for t in ("aa", "aa", "mm nn", "mm nn", "zz")] + [(None, "zz"), (7, "x"), (7, "X"), (1, "aa")]
    listed = [(r.doc_id, r.text or "") for r in odd.collect()] + more
    df = odd.unionByName(spark.createDataFrame(more, "doc_id long, text string")).repartition(3)
    down = sorted(listed, key=lambda r: (r[0] is not None, r[0] or 0, _signed(r[1]), r[1]), reverse=True)
    want = []
    for k, (i, t) in enumerate(down):
        after = down[(k + 1) % len(down)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        same = lambda a, b: float(brute.canonical(a) == brute.canonical(b))
        want.append((str(i), len(t), brute.sha(edited), same(t, edited), same(t, after)))
    found = fingerprint.edit_report(df, bits=bits, rows_a_run=run).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in found) == sorted(want)
    plain = fingerprint.fingerprints(df.withColumn("canon", F.lit("clash")), bits=bits).collect()
    assert len(plain) == len(listed) and len({r.fingerprint for r in plain}) == len({brute.canonical(t) for _, t in listed})
    assert fingerprint.edit_report(none).count() == 0 and fingerprint.fingerprints(none).count() == 0


def test_ends_of_sentences_by_bytes():
    """Ids and ends of sentences of a text encoded as a whole are those of its pieces, of any white space and script."""
    tokens = packing.Tokens(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert not hasattr(tokens, "known")  # no memo of pieces, which took longer than their encoding
    rng = random.Random(1)
    some = [" ", "  ", "a", "Ab", ".", "!\n", "\n", "é", "7", "\t", "?", "\xa0", "\x1c", "end"]
    for text in ["", " ", " a", "a ", "x" * 5000, "y. " * 300, *("".join(rng.choices(some, k=rng.randint(0, 40))) for _ in range(2000))]:
        cut = byte_bpe.pieces(text)
        coded = [tokens.rank_encode(" " * (k > 0) + x) for k, x in enumerate(cut)]
        ends = np.cumsum([len(x) for x in coded])
        data, stops = tokens(text)
        assert np.frombuffer(data, "<u2").tolist() == [i for x in coded for i in x]
        assert stops.tolist() == [e for e, x in zip(ends.tolist(), cut, strict=True) if x[-1:] in (".", "!", "?", "\n") or "\n" in x], repr(text)


# --- substrings ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("window", "shard"), [(50, 200_000), (12, 500), (12, 60)])
def test_removed_words(docs, texts, window, shard):
    found = rows(substrings.report(docs, window=window, shard_words=shard))
    for i, (words, kept) in brute.removed_words(texts, window).items():
        r = found[i]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(words), len(words) - len(kept), brute.sha(" ".join(kept))), i


def test_substrings_odd_rows(odd, none):
    assert sorted(r.n_removed for r in substrings.report(odd).collect()) == [0] * 8
    assert substrings.report(none).count() == 0 and substrings.deduplicated(none).count() == 0
    assert sorted(map(str, substrings.deduplicated(odd).collect())) == sorted(map(str, odd.collect()))


def test_passages_of_null_and_repeated_ids(spark):
    """Rows of one id are one document, which removes nothing from itself; null ids neither give nor lose words."""
    passage = " ".join(f"p{k}" for k in range(60))
    listed = [(1, passage + " a"), (1, passage + " b"), (2, "x " + passage), (2, "x " + passage), (2, passage + " y"), (None, passage), (3, "only")]
    df = spark.createDataFrame(listed, "doc_id long, text string").withColumn("own_key", F.lit("k")).withColumn("spans", F.lit("s"))
    kept = {(2, "x " + passage): "x", (2, passage + " y"): "y"}
    want = sorted((str(i), kept.get((i, t), t)) for i, t in listed)
    for shard in (200_000, 10):
        got = substrings.deduplicated(df, shard_words=shard)
        assert got.columns == df.columns
        assert sorted((str(r.doc_id), r.text) for r in got.collect()) == want
        sizes = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substrings.report(df, shard_words=shard).collect())
        assert sizes == sorted((str(i), len(t.split()), 60 if (i, t) in kept else 0, brute.sha(kept.get((i, t), t))) for i, t in listed)


def test_common_line_is_cut_finer(spark):
    """A line of 20 words in many different contexts: its anchor is crowded at every level but the last."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(400)}"
    line = [f"line{k}" for k in range(20)]
    listed = [(k, " ".join([word() for _ in range(25)] + line + [word() for _ in range(25)])) for k in range(40)]
    listed += [(100 + k, listed[k][1] + " end") for k in range(0, 40, 7)]
    df = spark.createDataFrame(listed, "doc_id long, text string").repartition(3)
    found = rows(substrings.report(df, window=24, shard_words=400))
    for i, (words, kept) in brute.removed_words(listed, 24).items():
        assert (found[i].n_words, found[i].n_removed, found[i].kept_sha256) == (len(words), len(words) - len(kept), brute.sha(" ".join(kept))), i


def test_copies_of_a_crowded_segment_are_cut_once(spark, monkeypatch):
    """Copies of documents add rows only where each document has rows of its own; results stay those of all windows."""
    rng = random.Random(4)
    line = [f"line{k}" for k in range(20)]
    texts = [" ".join([f"w{rng.randrange(400)}" for _ in range(25)] + line + [f"w{rng.randrange(400)}" for _ in range(25)]) for _ in range(40)]
    real, sizes = substrings.written, {}
    for copies in (2, 8):
        counts = sizes[copies] = Counter()

        def counted(df, label, counts=counts):
            out = real(df, label)
            counts[label] += out.count()
            return out

        monkeypatch.setattr(substrings, "written", counted)
        listed = [(100 * c + k, t) for c in range(copies) for k, t in enumerate(texts)]
        df = spark.createDataFrame(listed, "doc_id long, text string").coalesce(1)
        found = rows(substrings.report(df, window=24, shard_words=400))
        for i, (words, kept) in brute.removed_words(listed, 24).items():
            assert (found[i].n_words, found[i].n_removed) == (len(words), len(words) - len(kept)), i
    own = {"word-summaries", "anchor-lists", "flagged", "segments", "removed-windows", "changed"}
    assert sizes[2]["finer-segments"] > 0
    assert {k: n for k, n in sizes[2].items() if k not in own} == {k: n for k, n in sizes[8].items() if k not in own}


def test_deduplicated_texts(docs, texts):
    found = rows(substrings.deduplicated(docs))
    for i, (words, kept) in brute.removed_words(texts, 50).items():
        assert found[i].text == (dict(texts)[i] if len(words) == len(kept) else " ".join(kept))
        assert found[i].n_chars == len(found[i].text)


@given(st.lists(st.lists(st.integers(0, 2), min_size=3, max_size=14), min_size=1, max_size=8))
@settings(max_examples=80, deadline=None)
def test_shared_windows_against_plain_search(segments):
    segments = [list(x) for x in dict.fromkeys(map(tuple, segments))]
    docs = np.arange(len(segments)) % 5
    flat = np.array([w for s in segments for w in s])
    found = substrings.shared_windows(flat, np.array([len(s) for s in segments]), docs, window=3)
    for k, s in enumerate(segments):
        want = [any(docs[j] < docs[k] and s[i : i + 3] == t[p : p + 3] for j, t in enumerate(segments) for p in range(len(t) - 2)) for i in range(len(s) - 2)]
        assert found[k].tolist() == want


# --- byte-level BPE --------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference_bpe():
    bpe = byte_bpe.coder(byte_bpe.default_path())
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


@given(st.text(max_size=60))
@settings(max_examples=150, deadline=None)
def test_bpe_of_any_text(text):
    bpe = byte_bpe.coder(byte_bpe.default_path())
    whole = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={}) if not hasattr(bpe, "check") else bpe.check
    bpe.check = whole
    ids = bpe.encode(text)
    assert ids == whole.encode_ordinary(text)
    assert bpe.decode(ids) == text.encode()


def test_bpe_round_trip(docs, texts, reference_bpe):
    found = rows(byte_bpe.round_trip(docs))
    for i, t in texts:
        ids = reference_bpe.encode_ordinary(t)
        assert (found[i].n_tokens, found[i].ids_sha256, found[i].decoded_sha256) == (len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(t))
    back = rows(byte_bpe.decoded(byte_bpe.encoded(docs)))
    assert all(bytes(back[i].data) == t.encode() for i, t in texts)


def test_bpe_odd_rows(odd, none):
    assert sorted(r.n_tokens for r in byte_bpe.round_trip(odd).collect())[:4] == [0, 0, 0, 0]
    assert byte_bpe.round_trip(none).count() == 0


# --- quality ---------------------------------------------------------------------------------------------------------


def _labelled(spark, n=2400):
    rng = random.Random(2)
    good = ["amber", "birch", "cedar", "delta", "ember", "fjord", "grove", "heron"]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(good) + str(rng.randint(0, 40)) for _ in range(rng.randint(20, 80))]
        kind = i % 4
        if kind == 1:
            words[rng.randrange(len(words))] = rng.choice(["vile", "crass"])
        elif kind == 2:
            words = [w + "%%%" for w in words]
        docs.append((i, " ".join(words)))
        labels.append((i, int(kind != 2), int(kind == 1)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_documents(spark):
    docs, labels = _labelled(spark)
    model = quality.trained(docs.where("doc_id < 2000"), labels)
    found = rows(quality.scored(docs.where("doc_id >= 2000"), model))
    right = [r.keep == (i % 4 in (0, 3)) for i, r in found.items()]
    assert sum(right) / len(right) > 0.95
    assert all(0 <= r.p_at_least_2 <= r.p_at_least_1 <= 1 and abs(r.expected_grade - r.p_at_least_1 - r.p_at_least_2) < 1e-9 for r in found.values())
    kept = quality.selected(docs.where("doc_id >= 2000"), model)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in found.items() if r.keep)


def _plain_features(text):
    """Names of the features of a text, by their definitions."""
    words = text.split()
    n, found = len(words), set()
    edge = quality._EDGE
    for w in words:
        low = w.lower()
        core = low.strip(edge)
        tail = low[len(low.rstrip(edge)) :] if core else low
        if core:
            found.add("w:" + core)
        if len(tail) > 1 or not core:
            found.add("s:" + tail[:4])
    level = lambda k: round(10 * k / n) if n else 0
    shares = {
        "repeat": level(sum(a == b for a, b in zip(words, words[1:], strict=False))), "pipe": level(words.count("|")), "symbol": level(sum(not w.isalpha() for w in words)),
        "distinct": level(len(set(words))), "size": len(text).bit_length(), "word": min(len(text) // n, 40) if n else 0,
        "upper": level(sum(w.isupper() for w in words)), "digit": level(sum(w.isdigit() for w in words)),
    }
    return {xxhash.xxh32_intdigest(x) % (1 << 18) for x in found | {f"{k}={v}" for k, v in shares.items()}}


def test_quality_scores_against_a_plain_version(docs, texts):
    """Scores, tails and expected grades of made weights, text by text."""
    weights = np.random.default_rng(1).normal(0, 0.3, 1 << 18).astype(np.float32)
    found = rows(quality.scored(docs, quality.OrdinalModel(weights.astype(float), np.array([-1.0, 0.5]))))
    for i, t in texts:
        score = sum(float(weights[b]) for b in _plain_features(t))
        tails = [1 - 1 / (1 + math.exp(score - cut)) for cut in (-1.0, 0.5)]
        r = found[i]
        assert (r.score, r.expected_grade, r.p_at_least_1, r.p_at_least_2) == pytest.approx((score, sum(tails), *tails), abs=1e-5)
        assert (r.n_words, r.keep) == (len(t.split()), tails[1] >= 0.5)


def test_quality_fit_descends_the_likelihood(monkeypatch):
    """Without penalty, the fit ends where finite differences of the plain likelihood vanish, with ordered thresholds."""
    rng = np.random.default_rng(4)
    n, size = 60, 5
    x = rng.random((n, size)) < 0.5
    score = x @ np.array([1.0, -1.0, 0.5, 0.0, 0.8]) + rng.normal(0, 1.2, n)
    grades = np.digitize(score, [-0.2, 0.8])
    weight = rng.integers(1, 4, n).astype(float)
    monkeypatch.setattr(quality, "PENALTY", 0.0)
    at, cols = np.nonzero(x)
    fitted = quality.fit(at, cols, grades, weight, size, steps=6000)

    def loss(w, cuts):
        total = 0.0
        for row, g, k in zip(x, grades, weight, strict=True):
            s = row @ w
            below = [0.0] + [1 / (1 + math.exp(s - c)) for c in cuts] + [1.0]
            total -= k * math.log(below[g + 1] - below[g])
        return total / weight.sum()

    params = np.r_[fitted.weights, fitted.thresholds]
    split = lambda p: loss(p[:size], p[size:])
    slopes = [(split(params + d) - split(params - d)) / 2e-5 for d in np.eye(len(params)) * 1e-5]
    assert np.abs(slopes).max() < 2e-3 and fitted.thresholds[0] < fitted.thresholds[1]


def test_quality_labels(spark):
    """Labels with nulls count for nothing, and a repeated id has its worst grade."""
    labels = [(1, 1, 0), (1, 1, 1), (2, None, 0), (3, 0, None), (4, 0, 0), (5, 1, 0), (5, 1, 0), (None, 1, 0)]
    df = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("grade", F.lit("clash"))
    assert sorted((r.label_id, r.grade) for r in quality._grades(df, "doc_id").collect()) == [(1, 0), (3, 1), (4, 1), (5, 2)]


def test_quality_odd_rows(spark, odd, none):
    docs, labels = _labelled(spark, 40)
    no_labels = labels.where("doc_id < 0")
    model = quality.trained(docs, no_labels)
    assert all(r.keep for r in quality.scored(odd, model).collect())
    assert quality.scored(none, model).count() == 0
    assert quality.trained(none, labels).thresholds.shape == (2,)


# --- language model --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("head", "scale"), [(1 << 17, 24), (20, 1)])
def test_lm_base_scores(docs, texts, head, scale):
    found = rows(lm.scores(docs, head_words=head, entry_scale=scale, least_steps=4))
    for i, (held, tokens, known, total, base) in brute.unigram(texts).items():
        r = found[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, tokens, known, total)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
        assert r.score < 0


def _plain_score(text, counts, scorer):
    """Token by token: softmax over groups, softmax over the places of the group, mixture, share in the class."""
    lex, p = scorer.lexicon, scorer.model.p
    top, size = lex.head[: lex.entries], scorer.model.size
    words = brute.WORD.findall(brute.low(text))
    place = {w: k for k, w in enumerate(top)}
    slot = lambda rank: rank % lex.groups * size + rank // lex.groups
    klass = lambda w: zlib.crc32(w[-3:]) % 512
    coded = [w.encode() for w in words]
    entry = [slot(place[w]) if w in place else slot(len(top) + 1 + klass(w)) for w in coded] + [slot(len(top))]
    start, total = len(p["r"]) - 1, 0.0
    for t, e in enumerate(entry):
        h = sum(p["mix"][k] @ p["r"][entry[t - 1 - k] if t > k else start] for k in range(3))
        wide = entry[max(0, t - 19) : max(0, t - 3)]
        h = h + p["mix"][3] @ (np.mean([p["r"][x] for x in wide], axis=0) if wide else np.zeros(16))
        soft = lambda s: np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        g = e // size
        in_group = slice(g * size, (g + 1) * size)
        model = soft(p["a"] @ h + p["c"])[g] * soft(p["q"][in_group] @ h + p["b"][in_group])[e - g * size]
        total += math.log10(scorer.weight * model + (1 - scorer.weight) * scorer.model.mass[e])
    for w in coded:
        if w not in place:
            others = [x for x in counts if x not in place and klass(x) == klass(w)]
            total += math.log10((counts.get(w, 0) + 1) / (sum(counts[x] + 1 for x in others) + 1))
    return total


@pytest.mark.parametrize(("head", "scale"), [(1 << 17, 4), (60, 4)])
def test_lm_scores_against_a_plain_version(docs, texts, head, scale):
    given = docs.select("doc_id", "text")
    counts = {bytes(r.word): r.c for r in lm.word_counts(given).collect()}
    assert counts == Counter(w.encode() for i, t in texts if not lm.is_held_out(i) for w in brute.WORD.findall(brute.low(t)))
    train_docs = sum(not lm.is_held_out(i) for i, _ in texts)
    lexicon = lm.lexicon_of(lm.word_counts(given), train_docs, head, scale)
    scorer = lm.trained(given, lexicon, 2000, 12)
    found = rows(lm.scores(docs, head_words=head, entry_scale=scale, tokens_a_trainer=2000, least_steps=12))
    for i, t in texts:
        if len(t) < 3000:
            want = _plain_score(t, counts, scorer)
            assert abs(found[i].score - want) < 1e-4 * max(1, abs(want)), i


def test_lm_model_does_not_depend_on_the_layout(docs, monkeypatch):
    """Several trainers, summed by a tree of several levels: the same parameters whatever the partitions of the table."""
    monkeypatch.setattr(lm, "FAN", 2)
    given = docs.select("doc_id", "text")
    lexicon = lm.lexicon_of(lm.written(lm.word_counts(given), "counts"), 60)
    one, other = (lm.trained(d, lexicon, 900, 12) for d in (given.coalesce(1), given.repartition(5, "text")))
    assert one.weight == other.weight
    assert all(np.array_equal(one.model.p[name], other.model.p[name]) for name in one.model.p)


def test_lm_learns_from_every_training_document(spark):
    """Turning round the words of any one training document, which leaves all counts, changes the parameters."""
    rng = random.Random(9)
    listed = [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(60))) for i in range(50)]
    given = lambda at: spark.createDataFrame([(i, " ".join(t.split()[::-1]) if i == at else t) for i, t in listed], "doc_id long, text string").coalesce(1)
    lexicon = lm.lexicon_of(lm.written(lm.word_counts(given(-1)), "counts"), sum(not lm.is_held_out(i) for i, _ in listed))
    plain = lm.trained(given(-1), lexicon, 10**6, 2).model.p
    by_rest: dict[int, int] = {}
    for i, _ in listed:
        by_rest.setdefault(zlib.crc32(str(i).encode()) // 7 % 16, i)
    for i in [by_rest[k] for k in (4, 7, 15)]:
        changed = lm.trained(given(i), lexicon, 10**6, 2).model.p
        assert np.array_equal(plain["r"], changed["r"]) == lm.is_held_out(i)


def test_lm_weight_is_chosen_on_documents_before_they_are_learnt():
    rng = np.random.default_rng(1)
    mass = np.full(16, 1 / 16)
    entries, weights = rng.integers(0, 16, 500).astype(np.int32), (0.0, 0.5, 0.9)
    model = bilinear.Model(mass, 4)
    p = np.exp(model.log_probs(bilinear.Contexts(entries, np.array([300, 200]), 16)))
    found = model.train(entries, np.array([300, 200]), 4, weights=weights)
    assert np.allclose(found, [np.log(w * p + (1 - w) / 16).sum() for w in weights])


def test_lm_batches_give_each_row_once(monkeypatch):
    """What a batch does to one row is summed before rows are gathered; the context gives a row for each token, not for each use."""
    given, plain = [], bilinear.Model._sparse
    monkeypatch.setattr(bilinear.Model, "_sparse", lambda self, name, rows, *rest: (given.append((name, rows.copy())), plain(self, name, rows, *rest)))
    bilinear.Model(np.full(64, 1 / 64), 8).train(np.random.default_rng(2).integers(0, 64, 3000).astype(np.int32), np.full(30, 100))
    assert {name for name, _ in given} == {"q", "r"}
    assert all(len(set(rows.tolist())) == len(rows) for _, rows in given)


@pytest.mark.parametrize("sizes", [[90], [1, 2, 3, 4, 5, 18, 19, 20, 21, 40], [1] * 7])
def test_lm_windows(sizes):
    rows, doc = np.random.default_rng(3).random((sum(sizes), 16), np.float32), np.repeat(np.arange(len(sizes)), sizes)
    inside = lambda t, s: doc[t] == doc[s] and t - 20 < s < t - 3
    each = range(len(rows))
    before, after = (np.array([sum((rows[s] for s in each if (inside(t, s) if back else inside(s, t))), np.zeros(16)) for t in each]) for back in (True, False))
    assert np.allclose(bilinear.window_sums(rows, np.array(sizes)), before, atol=1e-5)
    assert np.allclose(bilinear.window_sums(rows, np.array(sizes), ahead=True), after, atol=1e-5)


@pytest.mark.parametrize("mass", [[1.0], [0.0, 0.0], [0.5, 0, 0.25, 0.25], [1e-9, 1, 3, 0, 7, 7, 1e-3]])
def test_lm_noise_has_the_chances_of_the_masses(mass):
    keep, alias = bilinear.aliases(np.array(mass))
    found = keep + np.bincount(alias, 1 - keep, len(mass))
    assert np.allclose(found, np.array(mass) / sum(mass) * len(mass) if sum(mass) else 1)


def test_lm_scores_beyond_single_precision():
    """Sums of exponentials that single precision can't hold."""
    model = bilinear.Model(np.full(16, 1 / 16), 4)
    entries = np.random.default_rng(4).integers(0, 16, 300)
    model.p["c"][:] = [-200, -300, -250, -220]
    model.p["b"][:8] = 150
    x = bilinear.Contexts(entries, np.array([300]), 16)
    h = model.hidden(x)[0].astype(np.float64)
    soft = lambda s: s - s.max(1, keepdims=True) - np.log(np.exp(s - s.max(1, keepdims=True)).sum(1, keepdims=True))
    group = soft(h @ model.p["a"].T + model.p["c"])
    inside = soft((h @ model.p["q"].T + model.p["b"]).reshape(-1, 4)).reshape(300, 16)
    assert np.allclose(model.log_probs(x), group[np.arange(300), entries // 4] + inside[np.arange(300), entries], atol=1e-3)


def test_lm_words_of_slices(monkeypatch):
    """Texts are split some bytes at a time, a whole text at least, by the spaces of the contract alone."""
    texts = [" A  b ", None, "", "\t\n", "Zq\x1cX\x85y\u2003z  \u00c0B", "one" * 9, "the the\x0bof\x0c", "\u212a"]
    batch = pa.record_batch([pa.array(range(8), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    for size in (1, 12, 1 << 24):
        monkeypatch.setattr(lm, "SLICE", size)
        found = list(lm.slices(iter([batch, batch.slice(0, 0), batch.slice(5)])))
        assert [i for _, ids, _ in found for i in ids] == [*range(8), 5, 6, 7]
        parts = [(words.to_pylist(), at) for words, at in (lm.split(t) for _, _, t in found)]
        each = [[w for w in words[a:z] if w] for words, at in parts for a, z in zip(at, at[1:], strict=False)]
        assert each == [[w.encode() for w in brute.WORD.findall(brute.low(t or ""))] for t in [*texts, *texts[5:]]]


def test_lm_entries_are_normalised():
    rng = np.random.default_rng(0)
    groups, size = bilinear.layout(60)
    mass = np.zeros(groups * size)
    mass[bilinear.place(np.arange(60), groups, size)] = 1 / 60
    model = bilinear.Model(mass, groups)
    model.train(rng.integers(0, 60, 3000), np.full(30, 100), 5)
    context = rng.integers(0, 60, 24)
    last = [np.r_[context, e] for e in range(groups * size)]
    logs = model.log_probs(bilinear.Contexts(np.concatenate(last), np.full(len(last), 25), len(mass)))
    assert np.exp(logs[24::25]).sum() == pytest.approx(1, abs=1e-5)


def test_lm_pieces_of_long_documents():
    rng = np.random.default_rng(0)
    mass = np.full(16, 1 / 16)
    model = bilinear.Model(mass, 4)
    long = rng.integers(0, 16, lm.CHUNK + 500).astype(np.int32)
    whole = model.log_probs(bilinear.Contexts(long, np.array([len(long)]), 16))
    pieces = np.concatenate([p for _, p in lm._log_probs(model, [long, long[:9]])])
    assert np.allclose(pieces, np.r_[whole, whole[:9]], atol=1e-5)


def test_lm_learns_more_than_unigrams(spark):
    """Two invented languages: held-out texts gain 0.15 of the 0.30 digits a token that knowing the language gives."""
    rng = random.Random(6)
    words = [[f"{a}{k}{b}" for k in range(300)] for a, b in (("x", "an"), ("y", "eu"))]
    listed = [(i, " ".join(rng.choice(words[i % 2]) for _ in range(80))) for i in range(1400)]
    found = lm.scores(spark.createDataFrame(listed, "doc_id long, text string")).where("held_out").collect()
    gain = sum(r.score - r.base_score for r in found) / sum(r.n_tokens for r in found)
    assert len(found) > 50 and gain > 0.15


def test_lm_odd_rows(odd, none):
    found = lm.scores(odd, least_steps=2).collect()
    assert len(found) == 8 and all(r.score < 0 for r in found)
    assert sorted(r.n_tokens for r in found) == [1, 1, 1, 1, 3, 3, 4, 4]
    assert len({(r.score, r.base_score) for r in found if r.n_tokens == 1}) == 1
    assert lm.scores(none).count() == 0


# --- sharding --------------------------------------------------------------------------------------------------------


def test_curve_visits_every_cell_by_unit_steps():
    places = sharding.curve()
    cell = {p: c for c, p in enumerate(places)}
    codes = lambda c: np.array([c >> 8, c >> 4 & 15, c & 15])
    assert sorted(places) == list(range(4096))
    assert all(np.abs(codes(cell[p]) - codes(cell[p + 1])).sum() == 1 for p in range(4095))


@pytest.mark.parametrize("rows_a_salt", [1 << 17, 1])
def test_shards(docs, texts, rows_a_salt):
    found = sharding.placed(docs, rows_a_salt=rows_a_salt).collect()
    data = dict(texts)
    slots = defaultdict(list)
    for r in found:
        assert (r.size, r.text_crc32) == (len(data[r.doc_id].encode()) + 1, zlib.crc32(data[r.doc_id].encode()))
        slots[r.shard].append((r.slot, r.curve_place))
    sizes = [len(slots[s]) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(texts)
    order = []
    for s in range(16):
        assert [x for x, _ in sorted(slots[s])] == list(range(len(slots[s])))
        order += [p for _, p in sorted(slots[s])]
    assert order == sorted(order)


def test_shard_codes_and_places(spark):
    """Codes of numbers by exact quantiles, of strings by their order even where their beginnings agree; places on the curve."""
    rng = random.Random(9)
    listed = [(i, "x" * rng.randint(0, 40), f"https://example.org/{rng.randint(0, 9)}", rng.choice([None, 1, 5, 900])) for i in range(300)]
    df = spark.createDataFrame(listed, "doc_id long, text string, source string, year long")
    found = rows(sharding.placed(df, dimensions=[F.col("source"), F.col("year"), F.length("text")]))
    cell_of = {p: c for c, p in enumerate(sharding.curve())}
    codes = {i: (cell_of[r.curve_place] >> 8, cell_of[r.curve_place] >> 4 & 15, cell_of[r.curve_place] & 15) for i, r in found.items()}

    def plain(values):
        known = sorted(v for v in values if v is not None)
        cuts = [known[math.ceil(len(known) * k / 16) - 1] for k in range(1, 16)]
        return [sum(v is not None and v > c for c in cuts) for v in values]

    assert [codes[i][1] for i in range(300)] == plain([r[3] for r in listed])
    assert [codes[i][2] for i in range(300)] == plain([len(r[1]) for r in listed])
    by_source = sorted({(r[2], codes[r[0]][0]) for r in listed})
    assert len(by_source) == 10 and [c for _, c in by_source] == sorted(c for _, c in by_source) and len({c for _, c in by_source}) > 4


def test_string_levels_follow_the_share_of_rows_before(spark):
    """A value that a third of the rows have, many rare ones, nulls, and values that agree at their beginnings."""
    values = ["m" * 3] * 100 + [f"key/{k:04d}" for k in range(150)] + [f"z{k % 7}" for k in range(50)] + [None] * 10
    df = spark.createDataFrame([(v,) for v in values], "s string").repartition(5)
    known = sorted(v for v in values if v is not None)
    want = {v: 16 * known.index(v) // len(known) for v in known} | {None: 0}
    assert {(r.s, r.level) for r in df.select("s", sharding._string_code(df, "s").alias("level")).collect()} == set(want.items())


def test_written_shards_hold_every_row(spark, odd, tmp_path):
    df = odd.withColumn("own_key", F.lit("clash"))
    manifest = sharding.write_shards(df, str(tmp_path / "s"), shards=3)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(map(str, back.select(*df.columns).collect())) == sorted(map(str, df.collect()))
    assert sorted(r["rows"] for r in manifest.collect()) == [2, 3, 3]


def test_shards_odd_rows(odd, none, docs, tmp_path):
    found = sharding.placed(odd).collect()
    assert len(found) == 8 and all(r.size == 1 and r.text_crc32 == 0 for r in found if r.doc_id == 1)
    assert sharding.placed(none).count() == 0
    manifest = sharding.write_shards(docs, str(tmp_path / "shards"))
    assert manifest.agg(F.sum("rows")).first()[0] == docs.count()
