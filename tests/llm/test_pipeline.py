from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from gritstone.llm import compression_quality, frames, pii, toxicity


def test_stages_keep_columns_and_take_effect(spark, small, texts):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, ids = docs.columns, set(texts)
    model = toxicity.train(docs, spark.read.parquet(f"{small}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.scores(docs, model).where("predicted = 1").collect()}
    out = p.drop_toxic(spark, docs, small).cache()
    assert out.columns == columns and {r.doc_id for r in out.collect()} == ids - toxic
    good = {i for i in ids - toxic if not brute.quality(texts[i])[5] and compression_quality.compression(texts[i])[3] in ("ok", "short")}
    out = p.drop_poor(spark, out, small).cache()
    assert out.columns == columns and {r.doc_id for r in out.collect()} == good
    components = brute.near_duplicates([(i, texts[i]) for i in good], 5, 80)
    out = p.drop_copies(spark, out, small).cache()
    assert out.columns == columns and sorted(r.doc_id for r in out.collect()) == sorted({c for _, c in components.values()})
    masked = p.mask_private(spark, out, small).cache()
    assert masked.columns == columns
    for r in masked.collect():
        spans = [s for part in pii.find(texts[r.doc_id], pii.field()) for s in part]
        assert (r.text == texts[r.doc_id]) == (not spans)
    packed = p.pack(spark, masked, small).collect()
    assert {r.doc_id for r in packed} == {c for _, c in components.values()}


def _left(spark):
    """Tables in the shared folder."""
    return sorted(Path(frames.shared_dir(spark).removeprefix("file://")).glob("*"))


def test_run_and_names(spark, small):
    assert [n for n, _ in p.STAGES] == ["toxicity", "quality", "near_dedup", "pii", "packing"]
    before = _left(spark)
    assert p.run(spark, small).agg(F.max("length")).first()[0] <= 4096
    assert len(_left(spark)) == len(before) + 1  # only the result's own table is left


def test_runs_side_by_side_and_failures_leave_nothing_behind(spark, small, monkeypatch):
    before = _left(spark)
    with ThreadPoolExecutor(2) as pool:
        runs = [pool.submit(p.run, spark, small) for _ in range(2)]
    counts = [r.result().count() for r in runs]
    assert counts[0] == counts[1] > 0 and len(_left(spark)) == len(before) + 2
    monkeypatch.setattr(p, "STAGES", [*p.STAGES[:3], ("bad", lambda spark, docs, sf_dir: 1 / 0)])
    with pytest.raises(ZeroDivisionError):
        p.run(spark, small)
    assert len(_left(spark)) == len(before) + 2


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d", 1), (1, "a b c d", 1), (None, "a b c d", 2), (2, "e f g h", 3)], "doc_id long, text string, n_chars long")
    assert sorted(str(r.doc_id) for r in p.drop_copies(spark, docs, "").collect()) == ["1", "2", "None"]


def test_no_text_is_lost_where_an_id_has_two(spark):
    a, b = "one text of some length that two ids have", "another text that is not like the first at all"
    docs = spark.createDataFrame([(1, a, "x"), (6, a, "x"), (6, b, "x"), (6, None, "y"), (6, "", "y"), (7, None, "z"), (7, None, "a")], "doc_id long, text string, lang string")
    got = sorted(((r.doc_id, r.text, r.lang) for r in p.drop_copies(spark, docs, "").collect()), key=str)
    assert got == sorted([(1, a, "x"), (6, b, "x"), (6, None, "y"), (6, "", "y"), (7, None, "a")], key=str)


def test_odd_tables(spark, tmp_path, odd_docs, no_docs):
    """Nulls, repeated rows, clashing columns and no rows at all, through the whole run."""
    spark.createDataFrame([(1, 0), (5, 1), (None, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/odd/labels.parquet")
    odd_docs.write.parquet(f"{tmp_path}/odd/documents.parquet")
    got = p.run(spark, f"{tmp_path}/odd").collect()
    assert {r.doc_id for r in got} <= {1, None, 5, 7, 9} and {1, None} <= {r.doc_id for r in got}
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    no_docs.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert p.run(spark, f"{tmp_path}/none").collect() == []


def test_columns_of_any_type_and_name_reach_the_last_stage(spark, small):
    """Maps, structs, binaries and names with dots, blanks and quotes pass all filtering stages unchanged."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select(
        "doc_id", "text", F.create_map(F.lit("k"), F.col("doc_id")).alias("tags"), F.struct("lang", F.array("source").alias("s")).alias("a.b"), F.col("source").cast("binary").alias("row `x`"), F.col("n_chars").alias("own id"), F.lit(None).cast("map<int,array<string>>").alias("order"), F.col("lang").alias("row")
    )
    docs = docs.unionByName(docs.where("doc_id % 3 = 0"))
    before = {r.doc_id: r.asDict(True) for r in docs.collect()}
    for stage in (p.drop_toxic, p.drop_poor, p.drop_copies, p.mask_private):
        docs = stage(spark, docs, small).cache()
        assert docs.columns == list(next(iter(before.values())))
    rows = docs.collect()
    assert len(rows) > 50 and len({r.doc_id for r in rows}) == len(rows)
    assert all({**r.asDict(True), "text": None} == {**before[r.doc_id], "text": None} for r in rows)
    assert p.pack(spark, docs, small).count() >= len(rows)
