"""The stages one by one on odd rows, and run() against its stages applied in a row."""

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from corpusflow.llm import ngram_jaccard, queries

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_stages_keep_columns_and_odd_rows(spark):
    text = "a text of some words that stands for itself and for nothing else at all today"
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text, "en", "s", 1), (3, None, None, None, None), (4, "", "en", "s", 0), (None, text, "en", "s", 1), (5, 'key "AKIA' + "ABCDEFGHIJKLMNOP" + '" here in a longer text about other things', "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        got[name] = sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect())
    assert all(t for _, t in got["quality_rules"])
    assert [d for d, _ in got["near_duplicates"]] == [0, 1, 3, 4, 5]
    assert len(got["decontamination"]) == len(rows)
    assert "<SECRET>" in dict(got["secret_scans"])[5]
    empty = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_run_is_its_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert 0 < docs.count() <= before
    assert sorted(docs.collect()) == sorted(corpus_pipeline.run(spark, SF).collect())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.oracle_sql()[name]).df()
    got = __spark_entry__.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    form = lambda df: sorted(map(str, df[sorted(df.columns)].astype(object).where(df.notna(), None).itertuples(index=False, name=None)))
    assert form(got.convert_dtypes()) == form(want.convert_dtypes())


def test_near_duplicates_are_counted_in_shares(spark, monkeypatch):
    """Stage 2 sends one share of the n-grams at a time, and those of copies not at all."""
    docs = spark.createDataFrame([(k, " ".join(f"t{k % 6}w{i}" for i in range(30)), "en", "s", 1) for k in range(24)], DOCS)
    sent, packets = [], ngram_jaccard.packets

    def spy(once, *args):
        sent.append(once.count())
        return packets(once, *args)

    monkeypatch.setattr(ngram_jaccard, "packets", spy)
    monkeypatch.setattr(ngram_jaccard, "COUNTED", 100)
    left = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert sorted(r["doc_id"] for r in left.collect()) == list(range(6))
    assert sent == [6] * ngram_jaccard.PASSES


def test_a_large_group_of_near_copies_costs_few_pairs(spark, monkeypatch):
    """Stage 2 holds the near copies of a text against few others each, not each against all."""
    docs = spark.createDataFrame([(k, " ".join(f"t{k}" if i == k % 60 else f"w{i}" for i in range(60 + k % 7)), "en", "s", 1) for k in range(120)], DOCS)
    made, verified = [], ngram_jaccard.verified

    def spy(docs, holders, pairs, *args):
        made.append(pairs.count())
        return verified(docs, holders, pairs, *args)

    monkeypatch.setattr(ngram_jaccard, "verified", spy)
    left = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert [r["doc_id"] for r in left.collect()] == [0]
    assert 119 <= sum(made) < 120 * 12
