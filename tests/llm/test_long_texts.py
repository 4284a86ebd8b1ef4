"""Texts of a million characters without a space."""

import random

import public_tokenizers
import pytest
import tiktoken

from galvana.llm import byte_bpe, fingerprint, near, packing, secrets, simhash, substrings

from . import brute


@pytest.fixture(scope="module")
def reference():
    bpe = byte_bpe.coder(byte_bpe.default_path())
    return bpe, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


@pytest.mark.parametrize("alphabet", ["a1", "ab1.-é日\n", "<|>0x", "x"])
def test_byte_bpe_is_linear_without_spaces(reference, alphabet):
    bpe, plain = reference
    rng = random.Random(4)
    text = "".join(rng.choice(alphabet) for _ in range(10**6)) if alphabet != "a1" else alphabet * 500_000
    ids = bpe.encode(text)
    assert ids == plain.encode_ordinary(text) and bpe.decode(ids) == text.encode()


@pytest.fixture(scope="module")
def long_docs(spark):
    """A million characters without a space, twice; a hundred thousand words; a thousand secrets; a short text."""
    rng = random.Random(6)
    solid = "".join(rng.choice("abc123.-") for _ in range(10**6))
    words = " ".join(rng.choice(["alpha", "beta", "Gamma", "delta9", "ä"]) for _ in range(100_000))
    secrets = " ".join(f"token=abc{k}defgh AKIA{k:016d}" for k in range(1000))
    rows = [(1, solid), (2, solid), (3, words), (4, words + " more"), (5, secrets), (6, "short text")]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], columns).repartition(2), rows


def test_fingerprints_of_long_texts(long_docs):
    docs, rows = long_docs
    found = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert all(int(found[i].fingerprint, 16) == brute.simhash(t) for i, t in rows)
    assert found[2].component_id == 1 and found[6].component_id == 6
    edited = {r.doc_id: r for r in fingerprint.edit_report(docs).collect()}
    assert edited[1].fingerprint == edited[2].fingerprint and all(edited[i].n_chars == len(t) for i, t in rows)


def test_secrets_of_long_texts(long_docs):
    docs, rows = long_docs
    found = {r.doc_id: r for r in secrets.report(docs).collect()}
    assert all(found[i].base_sha256 == brute.sha(brute.secret_spans(t)) for i, t in rows)
    assert found[5].n_assign == found[5].n_access == 1000


def test_passages_of_long_texts(long_docs):
    docs, rows = long_docs
    found = {r.doc_id: r for r in substrings.report(docs).collect()}
    for i, (words, kept) in brute.removed_words(rows, 50).items():
        assert (found[i].n_words, found[i].n_removed, found[i].kept_sha256) == (len(words), len(words) - len(kept), brute.sha(" ".join(kept)))


def test_packing_of_long_texts(long_docs, reference):
    docs, rows = long_docs
    pieces = {}
    for r in packing.packed(docs).collect():
        assert r.offset + r.length <= 2048
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    for i, t in rows:
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at
            at += length
        assert at == len(reference[0].encode(t)) + 1


def test_near_duplicates_of_long_texts(long_docs):
    docs, _ = long_docs
    kept = {r.doc_id for r in near.one_of_each(docs).select("doc_id").collect()}
    assert kept == {1, 3, 5, 6}
