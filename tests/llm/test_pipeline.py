"""The pipeline's stages against plain Python, each on what it is given."""

from pyspark.sql import functions as F

import corpus_pipeline
from lodestar.llm import decontaminate, langid, quality

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "decontamination", "bpe"]
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    after = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SF)
        assert docs.columns == before.columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        after.append((before, docs))
    assert ids(after[0][1]) == ids(quality.judge(after[0][0], labels).filter("NOT rejected"))
    assert ids(after[1][1]) == ids(langid.identify(after[1][0]).filter("NOT rejected"))
    fps = {r.doc_id: r.text for r in after[2][0].collect()}
    from tests.llm.test_operators import brute_components, brute_fingerprint

    roots = brute_components({i: brute_fingerprint(t) for i, t in fps.items()})
    assert ids(after[2][1]) == set(roots.values())
    assert ids(after[3][1]) == ids(decontaminate.contamination(after[3][0], bench).filter("NOT contaminated"))
    last = corpus_pipeline.run(spark, SF)
    assert ids(last) == ids(after[3][1])
    assert set(last.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}


def test_stages_take_odd_rows_and_empty_tables(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing extra columns; then no rows at all."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (900_001, None, "en", "s", 0), (900_002, "", None, "s", 0), (900_003, "### 123", "en", "s", 7), (900_004, "the and of to " * 30_000, "en", "s", 420_000)], docs.schema)
    repeated = docs.limit(1)
    rows = docs.unionByName(odd).unionByName(repeated).withColumn("hits", F.lit("clash")).withColumn("scored", F.lit(1))
    again = repeated.first().doc_id
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, SF)
        rows = spark.createDataFrame(rows.collect(), rows.schema)
        assert rows.columns == [*docs.columns, "hits", "scored"], name
        kept = [r.doc_id for r in rows.collect()]
        if name == "quality":
            assert None in kept and {900_001, 900_002} <= set(kept)
        else:
            assert not {None, 900_001, 900_002, 900_003} & set(kept), name
        assert kept.count(again) <= (2 if name in ("quality", "language") else 1)
        assert stage(spark, rows.limit(0), SF).count() == 0, name
    assert corpus_pipeline.tokenize(spark, odd, SF).count() == 5
    assert corpus_pipeline.tokenize(spark, odd.limit(0), SF).count() == 0


def test_every_stage_takes_the_odd_table_itself(spark):
    """Not only what the stages before it have left: nulls, empty texts, repeats, and a column with a dot reach each."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "a text without id", "en", "s", 17), (900_001, None, "en", "s", 0), (900_002, "", None, "s", 0), (900_003, "### 123", "en", "s", 7), (900_004, "the and of to " * 30_000, "en", "s", 420_000), (900_005, "", "en", None, None)], docs.schema)
    rows = docs.unionByName(odd).unionByName(docs.limit(1)).withColumns({"a.b": F.lit("dot"), "fp": F.lit(1), "hits": F.lit(2)})
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, SF)
        assert out.columns == rows.columns, name
        kept[name] = [r.doc_id for r in out.collect()]
    assert {900_001, 900_002, 900_005} <= set(kept["quality"]) and kept["quality"].count(None) == 2
    assert not {900_001, 900_002, 900_003, 900_005} & set(kept["language"])
    # Empty texts share a fingerprint with null ones: one of them stays; rows without id always do.
    assert {900_001, 900_004} <= set(kept["near_duplicates"]) and not {900_002, 900_005} & set(kept["near_duplicates"]) and kept["near_duplicates"].count(None) == 2
    assert {900_001, 900_002, 900_003, 900_004, 900_005} <= set(kept["decontamination"]) and kept["decontamination"].count(None) == 2
    assert corpus_pipeline.tokenize(spark, rows, SF).count() == rows.count()
