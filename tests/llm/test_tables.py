"""Every operator on empty tables, clashing column names, nulls and repeated rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from aligngrid.llm import fingerprint, hosts, minhash, mixing, pieces, pii, repetition, revisits, suffix_dedup, toolcalls
from tests.llm.helpers import DOCS, documents, full

ODD = [(1, None), (1, None), (2, ""), (2, ""), (None, "some text of nobody " * 12), (3, "same row " * 9), (3, "same row " * 9),
       (4, "x" * 300_000), (4, "another text of one id"), (5, "word " * 30_000)]
ON_DOCS = {
    "mixing": lambda d: mixing.pareto_mix(d, mixing.n_words()),
    "take": lambda d: mixing.take(d, mixing.n_words()),
    "fingerprint": lambda d: fingerprint.fingerprints(fingerprint.with_edits(d), ["id", "h"], {"own": "text", "other": "edited"}),
    "pii": lambda d: pii.redacted(d, rows=400),
    "repetition": repetition.repetition_rules,
    "pieces": lambda d: pieces.decode_ids(pieces.encode_texts(d)),
    "suffix_dedup": suffix_dedup.without_repeats,
    "minhash": minhash.near_duplicates,
    "keep_one": minhash.keep_one,
}
SAME_ROWS = {"mixing", "pii", "repetition", "pieces", "suffix_dedup", "minhash"}


@pytest.mark.parametrize("name", sorted(ON_DOCS))
def test_empty_table(spark, name):
    empty = spark.createDataFrame([], DOCS)
    assert ON_DOCS[name](empty).collect() == []


@pytest.mark.parametrize("name", sorted(ON_DOCS))
def test_odd_rows_and_clashing_columns(spark, name):
    docs = spark.createDataFrame(full(ODD), DOCS)
    clash = ["id", "h", "text_a", "kept", "ids", "pii", "signature", "rep", "key", "mix_size", "decoded", "host", "n_words",
             "size", "rank", "_fact", "_name", "_copy", "_whole", "_found", "weight", "marks"]
    got = ON_DOCS[name](docs.select("*", *[F.lit("own").alias(c) for c in clash])).collect()
    if name in SAME_ROWS:
        assert len(got) == len(ODD)
        by_row = {}
        for row in got:  # equal rows have equal results
            if row["doc_id"] in (1, 2, 3):
                assert by_row.setdefault(row["doc_id"], row) == row
    if name == "keep_one":
        ids = [r.doc_id for r in got]
        assert sorted(i for i in ids if i is not None) == [1, 3, 4, 4, 5] and ids.count(None) == 1  # two texts of id 4


def test_odd_pages_and_records(spark):
    pages = spark.createDataFrame([(1, None, None), (1, None, None), (2, "no scheme", "x"), (None, "http://a.com/en/", "y"),
                                   (3, "HTTP://", ""), (4, "http://" + "a" * 100_000, "z")], "page_id long, url string, html string")
    outcomes = spark.createDataFrame([(1, None), (2, 1), (2, 0), (None, 1)], "page_id long, bad int")
    got = hosts.judged(pages.withColumn("verdict", F.lit("own")).withColumn("bad", F.lit(7)), outcomes)
    assert got.count() == 6 and got.where("host is null or path is null or verdict is null").count() == 0
    assert hosts.judged(pages.limit(0), outcomes.limit(0)).collect() == []
    none = spark.createDataFrame([], "record_id long, url string, at long, kind string, status int, headers map<string,string>, payload string")
    assert revisits.resolved(none).collect() == []
    assert revisits.resolved(revisits.captures(pages)).count() == 10  # two of each page; repeats of page 1 count once


def test_empty_calls(spark):
    calls = spark.createDataFrame([], "conv_id long, turn long, call_id string, name string, arguments string, needs array<string>")
    results = spark.createDataFrame([], "conv_id long, turn long, call_id string, content string")
    assert toolcalls.linked_calls(calls, results).collect() == []


def test_pipeline_stages_on_empty_and_small_tables(spark, tmp_path):
    rows = documents(5, 40)
    for name, rows in (("empty", []), ("small", full(rows))):
        where = tmp_path / name
        spark.createDataFrame(rows, DOCS).write.parquet(f"{where}/documents.parquet")
        got = corpus_pipeline.run(spark, str(where))
        assert got.columns[0] == "doc_id"
        assert (got.count() > 0) == bool(rows)
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "redaction", "mixture", "encoding"]
