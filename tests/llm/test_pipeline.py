"""The pipeline and the registry."""

import os
import zlib

import numpy as np
import public_tokenizers
import tokenizers

import __spark_entry__ as entry
import corpus_pipeline
import tools_check
from conftest import SF
from tabwarden.llm import language, quality, queries
from test_identifiers import brute as spans_of
from test_near_text import brute as groups_of


def test_pipeline_against_its_parts(spark):
    """Decisions of the classifiers row by row from the operators; the rest by brute force."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = {r.doc_id for r in language.identify(docs, language.learn_profiles(docs)).collect() if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_MARGIN}
    left = docs.where(docs.doc_id.isin(list(known)))
    good = {r.doc_id for r in quality.score(left, quality.train(left, spark.read.parquet(f"{SF}/labels.parquet"))).collect() if r.predicted}
    texts = {r.doc_id: r.text for r in left.collect() if r.doc_id in good}
    kept = [i for i, _, _, keep in groups_of(sorted(texts.items())) if keep]
    tok = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        out.setdefault(r.doc_id, []).append(r)
    assert sorted(out) == kept
    for i, rows in out.items():
        text, parts, at = texts[i], [], 0
        for s in filter(None, spans_of(text)[2].split(",")):
            kind, a, b = s.split(":")
            if int(a) >= at:
                parts += [text[at : int(a)], f"[{kind.upper()}]"]
            at = max(at, int(b))
        ids = np.array([*tok.encode("".join(parts) + text[at:], add_special_tokens=False).ids, 2], "<u4")
        assert sum(r.length for r in rows) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in rows)


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, "en", "s", None), (2, "", None, None, 0), (3, "12 34", "en", "s", 5), (4, "the of and to in is that", "en", "s", 24), (4, "the of and to in is that", "en", "s", 24)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, SF).write.parquet(path := str(tmp_path / str(k)))
        docs = spark.read.parquet(path)
        assert docs.columns == columns
    assert {r.doc_id for r in docs.collect()} <= {4} and docs.count() <= 1


def test_stages_pass_clashing_columns_through(spark, tmp_path):
    """Columns named like the operators' own, and names that need quoting, come through every stage with their values."""
    given = "lang_pred string, score double, predicted int, stat_words double, rid bigint, _text string, _spans string, _clean string, row string, _id bigint, id bigint, node bigint, kept boolean, `odd name` string, none array<struct<`a b`:int>>"
    good = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars > 500").select("doc_id", "text", "lang", "source", "n_chars").limit(40)
    extra = spark.createDataFrame([("x", 0.5, 7, 1.5, 99, "t", "s", "c", "r", 5, 6, 8, False, "o", [(3,)])], given)
    docs = good.crossJoin(extra)
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, "/root/testdata/sf0.01")
        assert out.columns == columns
        out.write.parquet(path := str(tmp_path / str(k)))
        docs = spark.read.parquet(path)
        assert docs.select(*[f"`{c}`" for c in extra.columns]).distinct().collect() == extra.collect() and docs.count() > 10
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0


def test_stages_on_no_documents(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_registry(spark):
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    name = "op5_topk_search"
    sf = os.environ.get("TEST_SF_DIR", SF)
    why, _, _ = tools_check.compare(entry.queries()[name](spark, sf), tools_check.duck(sf), entry.oracle_sql()[name])
    assert why is None, why


def test_full_operators_run_on_given_tables(spark):
    for name in ("op4_packing", "op6_pii", "op10_sentencepiece"):
        rows = queries.QUERIES[name](spark, SF).collect()
        assert {r.doc_id for r in rows} == {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
        assert name != "op10_sentencepiece" or all(r.round_trip for r in rows)
