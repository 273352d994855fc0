"""The pipeline's stages keep clean documents and columns, and each decision takes effect."""

from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import common

from .conftest import make, words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    near = words(9, 200).split(" ")
    good = [(i, words(i, 60 + i), f"src{i % 5}") for i in range(120)]
    bad = [(200 + i, " ".join(w.upper() + "!!" for w in words(i + 300, 60 + i).split(" ")), "src1") for i in range(40)]
    special = [
        (400, good[0][1], "src2"), (401, " ".join(near), "src1"), (402, " ".join(near[:195] + ["y"] * 5), "src1"),
        (403, words(777, 80) + ' token = "q8Zx81Lk20Vb77Yt55Nw" ' + words(778, 20), "src1"),
    ]
    docs = make(spark, [*good, *bad, *special]).select(COLUMNS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, 0) for i, *_ in good] + [(i, 0, 0) for i, *_ in bad]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = []
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        now = spark.read.parquet(str(tmp_path / f"out{k}"))
        if k < 4:
            assert now.columns == COLUMNS, name
            kept.append({r.doc_id: r.text for r in now.collect()})
    clean = {i for i, *_ in good} | {401, 402, 403}
    assert set(kept[0]) == clean | {400}
    assert set(kept[1]) == clean
    assert set(kept[2]) == clean - {402}
    assert set(kept[3]) == set(kept[2]) and "[SECRET]" in kept[3][403] and all(kept[3][i] == t for i, t in kept[2].items() if i != 403)
    assert {r.doc_id for r in now.select("doc_id").distinct().collect()} == set(kept[3])
    other = common.materialise(docs, "other")  # what others wrote stays
    assert corpus_pipeline.SCRATCH.release(spark) > 0 and other.count() == docs.count()


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty, blank and very long texts, repeated rows, no labels, and an empty table."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    long = words(5, 30_000)
    secret = 'x token = "q8Zx81Lk20Vb77Yt55Nw" y'
    rows = [(1, None, "s"), (2, "", "s"), (None, " \n", None), (3, long, "s"), (4, secret, None), (None, secret + " z", "s"), (5, "plain " * 30, "s"), (5, "plain " * 30, "s"), (None, None, None)]
    docs = make(spark, rows).withColumns({"_id": F.lit(1), "_live": F.lit("x"), "row": F.lit("r"), "component_id": F.lit(None).cast("int")}).repartition(3)
    for empty in (False, True):
        now, counts = docs.where(F.lit(not empty)), []
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = str(tmp_path / f"odd{k}{empty}")
            stage(spark, now, str(tmp_path)).write.parquet(out)
            before, now = now, spark.read.parquet(out)
            assert k == 4 or now.columns == before.columns
            counts.append(now.count())
        if empty:
            assert counts == [0] * 5
        else:
            # Null, empty and blank are one text; so are the repeated rows.
            assert counts[:4] == [9, 5, 5, 5]
            texts = [r.text or "" for r in before.collect()]
            assert sum("[SECRET]" in t for t in texts) == 2 and not any("q8Zx81" in t for t in texts) and long in texts
            assert now.select("doc_id").distinct().count() == 4  # none (the blank one, and one with a secret), 3, 4, 5


def test_stages_decide_by_row(spark, tmp_path):
    good = [(i, words(i, 60 + i), "src1") for i in range(120)]
    bad = [(200 + i, " ".join(w.upper() + "!!" for w in words(i + 300, 60 + i).split(" ")), "src1") for i in range(40)]
    labels = [(i, 1, 0) for i, *_ in good] + [(i, 0, 0) for i, *_ in bad]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    near = words(9, 200).split(" ")
    copy = " ".join(near[:195] + ["y"] * 5)
    # An id with a clean and a rejected text, a rejected text without an id, repeated rows, and copies without an id.
    odd = [(5, bad[3][1], "src1"), (None, bad[4][1], "src1"), good[7], (None, good[8][1], "src1"), (401, " ".join(near), "src1"), (402, copy, "src1"), (402, words(901, 90), "src1"), (None, copy + " z", "src1"), (None, words(902, 90), "src1")]
    now = make(spark, [*good, *bad, *odd]).select(COLUMNS).repartition(3)
    want = [r[:2] for r in [*good, *odd[4:5], *odd[6:7], *odd[8:]]]
    outs = []
    for k, stage in enumerate([corpus_pipeline.quality_stage, corpus_pipeline.exact_dedup_stage, corpus_pipeline.near_dedup_stage]):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        now = spark.read.parquet(str(tmp_path / f"out{k}"))
        outs.append(sorted(((r.doc_id, r.text) for r in now.collect()), key=str))
    order = lambda rows: sorted((tuple(r[:2]) for r in rows), key=str)
    assert outs[0] == order([*good, *odd[2:]])
    assert outs[1] == order([*good, *odd[4:]])
    assert outs[2] == order(want)
    again = corpus_pipeline.near_dedup_stage(spark, make(spark, [good[0]] * 3).select(COLUMNS), str(tmp_path))
    assert again.count() == 1
