"""The pipeline's near duplicates against exact similarities of all pairs."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from galvana.llm import near, pipeline, simhash
from galvana.llm.common import table

from . import brute


def shingled(text):
    return brute.shingled(text, 5)


linked = brute.similar


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


def corpus():
    """Texts with one to six edits in 60 to 300 words, copies, and texts too short for a shingle."""
    rng = random.Random(3)
    out = ["", None, "a b", "A  b", "a b c", "one two three four five"]
    for k in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 300))]
        out += [edited(rng, words, k % 7) for _ in range(4)] + [" ".join(words)] * (k % 2)
    return [(3 * i, t) for i, t in enumerate(out)]


def test_stage_drops_what_similarity_links_and_no_more(spark, sf_dir):
    texts = corpus()
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    sets = {i: shingled(t or "") for i, t in texts}
    root = brute.components([i for i, _ in texts], lambda a, b: linked(sets[a], sets[b]))
    kept = {r.doc_id for r in pipeline.near_duplicate_stage(spark, docs, sf_dir).collect()}
    assert kept == {i for i in root if root[i] == i}
    prints = {i: simhash.fingerprint((t or "").encode()) for i, t in texts}
    far = [(a, b) for a in sets for b in sets if a < b and linked(sets[a], sets[b]) and (prints[a] ^ prints[b]).bit_count() > 4]
    assert far  # the fingerprints' bound alone would leave these


def test_parts_of_blocks_are_compared_two_by_two(spark):
    texts = corpus()
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    whole = {(r.doc_id, r.component_id) for r in near.near_duplicates(docs).collect()}
    assert {(r.doc_id, r.component_id) for r in near.near_duplicates(docs, part=150).collect()} == whole


def test_links_of_fingerprints_are_candidates(spark):
    """Without a key of MinHash, similar texts whose fingerprints the first operator links are still found, and only those."""
    texts = corpus()
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    found = near.printed(docs)
    nodes = near.distinct_sets(found).withColumn("bands", F.array().cast("array<long>"))
    edges = near.similar_edges(docs, nodes, near.links(found, nodes))
    rep = {r.node: r.rep for r in nodes.collect()}
    sets = {i: shingled(t or "") for i, t in texts if i in set(rep.values())}
    prints = {i: simhash.fingerprint((t or "").encode(), 5) for i, t in texts}
    close = brute.components(list(sets), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    want = brute.components(list(sets), lambda a, b: close[a] == close[b] and linked(sets[a], sets[b]))
    pairs = {frozenset((rep[r.a], rep[r.b])) for r in edges.collect()}
    assert pairs and brute.components(list(sets), lambda a, b: frozenset((a, b)) in pairs) == want


def test_odd_rows(odd, none):
    assert near.near_duplicates(odd).count() == 8
    assert sorted(r.doc_id or 0 for r in near.one_of_each(odd).collect()) == [0, 0, 1, 1, 5, 5, 5]
    assert near.near_duplicates(none).count() == 0


def test_documents_of_the_tables(spark, sf_dir):
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    sets = {i: shingled(t) for i, t in texts.items()}
    root = brute.components(list(sets), lambda a, b: linked(sets[a], sets[b]))
    found = {r.doc_id: r.component_id for r in near.near_duplicates(table(spark, sf_dir, "documents")).collect()}
    assert found == root


def test_forest_links_through_others():
    sets = [np.arange(k, k + 20) for k in range(0, 12, 2)]
    a, b = near.forest(np.full(6, 20), np.concatenate(sets))
    assert sorted(zip(a, b, strict=True)) == [(k, k + 1) for k in range(5)]


def test_chains_join_the_nodes_of_each_key(monkeypatch):
    """Whatever the batches, the edges connect exactly the nodes that share a key, and no node has many."""
    monkeypatch.setattr(near, "HUB", 4)
    rng = random.Random(8)
    keys = sorted(rng.choice([1, 2, 2, 2, 3, 4, 5]) for _ in range(120))
    for size in (1, 3, 7, 120):
        batches = [pa.record_batch([pa.array(keys[i : i + size]), pa.array(range(i, min(i + size, 120)))], ["key", "node"]) for i in range(0, 120, size)]
        edges = [e for b in near._chains(iter(batches)) for e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        pairs = {frozenset(e) for e in edges}
        assert brute.components(range(120), lambda a, b: frozenset((a, b)) in pairs) == brute.components(range(120), lambda a, b: keys[a] == keys[b])  # noqa: B023
        assert max(sum(x in e for e in edges) for x in range(120)) <= 5
