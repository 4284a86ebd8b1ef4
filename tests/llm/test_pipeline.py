"""The whole pipeline against plain versions of its stages."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from galvana.llm import pipeline, quality, secrets
from galvana.llm.common import table

from . import brute


def test_run_matches_plain_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.trained(docs, table(spark, sf_dir, "labels"))
    texts = {r.doc_id: r.text for r in quality.selected(docs, model).collect()}
    sets = {i: brute.shingled(t, 5) for i, t in texts.items()}
    root = brute.components(list(sets), lambda a, b: brute.similar(sets[a], sets[b]))
    texts = {i: t for i, t in texts.items() if root[i] == i}
    kept = brute.removed_words(list(texts.items()), 50)
    texts = {i: texts[i] if len(w) == len(k) else " ".join(k) for i, (w, k) in kept.items()}
    source = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    texts = {r.doc_id: r.text for r in secrets.redacted(source).collect()}
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = defaultdict(list)
    for r in pipeline.run(spark, sf_dir).collect():
        got[r.doc_id].append(r)
    assert set(got) == set(texts)
    for i, t in texts.items():
        ids, at = [*tok.encode(t, add_special_tokens=False).ids, 1], 0
        for r in sorted(got[i], key=lambda r: r.start):
            assert (r.start, r.ids_crc32) == (at, zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()))
            at += r.length
        assert at == len(ids)


def test_stages_keep_the_columns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]


def test_stages_of_odd_and_empty_tables(spark, odd, none, sf_dir):
    """Null ids and texts, repeated rows and columns of clashing names go through every stage; an empty table stays empty."""
    df = odd.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"), "text_": F.lit("own"), "node": F.lit("x"), "key": F.lit("x")})
    for name, stage in pipeline.STAGES[1:-1]:
        out = stage(spark, df, sf_dir)
        assert out.columns == df.columns, name
        want = {"near_duplicates": 7, "substrings": 8, "secrets": 8}[name]
        assert out.count() == want, name
        assert stage(spark, none, sf_dir).count() == 0, name
    kept = pipeline.quality_stage(spark, df, sf_dir)
    assert kept.columns == df.columns and kept.count() <= 8
    assert pipeline.packing_stage(spark, df, sf_dir).agg(F.countDistinct("sequence_id")).first()[0] >= 1
    assert pipeline.packing_stage(spark, none, sf_dir).count() == 0
