"""What operators share, the pipeline on odd tables, and the quality fit against one piece of linear algebra."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import DATA, ODD, SCHEMA, grouped

from strandlake.llm import near_dup, quality, shared


def test_broadcast_goes_by_bytes(spark, monkeypatch):
    rows = spark.range(2000).select("id", F.expr("transform(sequence(1, 50), x -> struct(x as a, repeat('y', 20) as b))").alias("lists"))
    assert shared.small_enough(rows)
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 2 << 20)
    assert not shared.small_enough(rows) and shared.small_enough(rows.select("id"))
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 1999)
    assert not shared.small_enough(rows.select("id")) and shared.small_enough(rows.limit(0))


def test_nulls_match_in_joins(spark):
    a = spark.createDataFrame([(None, 1), (2, 2), (3, 3)], "k int, v int")
    for payload in (False, True):
        got = shared.join_checked(a, a.select("k", F.col("v").alias("w")), "k", "left", payload).collect()
        assert {(r.k, r.v, r.w) for r in got} == {(None, 1, 1), (2, 2, 2), (3, 3, 3)}


def test_statistics_of_blank_texts():
    x = quality.statistics(pa.array(["", None, " \n", "word word"]))
    assert not x[:3].any() and x[3].any()


def test_normal_equations(spark):
    """Partition sums, standardising and the ridge solution against all rows in one piece."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, quality.N_STATS)).astype(np.float32).astype(np.float64)
    y = (np.sin(x[:, 0]) + x[:, 1] ** 2 > 0.7).astype(int)
    ids = np.arange(600)
    stats = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x)], "doc_id long, x array<float>").repartition(5)
    labels = spark.createDataFrame([(int(i), int(v)) for i, v in zip(ids, y)], "doc_id long, quality int")
    model = quality.fit(stats, quality.marked_rows(labels))
    import zlib

    fold = np.array([zlib.crc32(str(i).encode()) % 5 for i in ids])
    known = fold > 0
    mean, scale = x[known].mean(0), x[known].std(0)
    assert np.allclose(model.mean, mean) and np.allclose(model.scale, scale)
    own = known & (fold != 4)
    z = quality.features((x[own] - mean) / scale)
    w = np.linalg.solve(z.T @ z + quality.RIDGE * own.sum() * np.eye(z.shape[1]), z.T @ y[own])
    assert np.allclose(model.weights, w, atol=1e-6)
    raw = model.raw(x[fold == 4])
    assert np.allclose(raw, quality.features((x[fold == 4] - mean) / scale) @ w, atol=1e-6)
    assert (np.diff(model.level) >= 0).all() and (np.diff(model.at) >= 0).all()
    # isotonic levels keep the mean of what they were fitted to
    steps = np.round(raw * quality.STEPS) / quality.STEPS
    assert abs(np.interp(steps, model.at, model.level).mean() - y[fold == 4].mean()) < 1e-6


def test_features_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, quality.N_STATS)) * 0.7
    near = quality.features(x)[:, :-1]
    far = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert np.abs(near @ near.T - np.exp(-far / (2 * quality.SIGMA**2))).max() < 0.25
    assert np.abs(near @ near.T - np.exp(-far / (2 * quality.SIGMA**2))).mean() < 0.05


def test_labels_of_either_kind(spark):
    """1 wins over 0 for one document; other values, nulls and documents without a label are passed over."""
    rows = [(1, 0), (1, 1), (2, 0), (2, 0), (3, None), (None, 1), (4, 7), (6, 1)]
    got = dict(quality.marked_rows(spark.createDataFrame(rows, "doc_id long, quality int")).collect())
    import zlib

    assert got == {d: y for d, y in {1: 1, 2: 0, 6: 1}.items() if zlib.crc32(str(d).encode()) % 5}


@pytest.mark.parametrize("name", ["odd", "none", "long"])
def test_pipeline_on_odd_tables(spark, tmp_path, name):
    """Nulls in each column, repeated rows, clashing columns, empty and very long texts, and no rows at all."""
    import corpus_pipeline

    long = [(20 + k, f"{'lorem ipsum dolor sit amet ' * 800_000}{k}", "en", "src1", 1, *ODD[0][5:]) for k in range(2)]
    rows = {"odd": [*ODD, (None,) * len(ODD[0])], "none": [], "long": [*ODD, *long]}[name]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 1), (1, 1, 0), (None, 1, 1), (2, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "short one", 3), (1, "SHORT one", 3), (2, None, 3), (None, "", 3)], "item_id long, text string, doc_id int").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for stage, f in corpus_pipeline.STAGES[:-1]:
        out = shared.written(f(spark, now, str(tmp_path)), "test")
        assert out.columns == now.columns and [x.dataType for x in out.schema] == [x.dataType for x in now.schema], stage
        now = out
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all("short one" not in (r.text or "").lower() for r in got) and bool(got) == bool(rows)
    assert len([r for r in got if r.text and len(r.text) > 10**7]) <= 2


def test_no_near_copy_reaches_the_end(spark):
    """Near copies, by brute force on what the quality stage kept: after the near-duplicate stage none is left, as whole or as fragment."""
    import corpus_pipeline

    at = DATA.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{at}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = shared.written(stages["quality"](spark, docs, at), "test")
    texts = {r.doc_id: r.text for r in kept.collect()}
    group, _ = grouped(texts, corpus_pipeline.NEAR_PERCENT)
    copies = {i for i in texts if group[i] != i}
    lines = shared.written(stages["line_dedup"](spark, kept, at), "test")
    left = {r.doc_id: r.text for r in shared.written(stages["near_dedup"](spark, lines, at), "test").collect()}
    after, sets = grouped(left, corpus_pipeline.NEAR_PERCENT)
    assert all(after[i] == i for i in left)
    own = near_dup.near_dup_groups(kept, corpus_pipeline.NEAR_PERCENT).where("not kept").count()
    assert own == len(copies)
    # what is left of a near copy shares less than the threshold with what is left of its group
    whole = [i for i in copies if i in left and left[i] == texts[i]]
    assert not whole and len(copies) > 40


def test_tables_on_the_way_are_removed(spark):
    """A stage's own tables go, its result and those from before stay."""
    import os

    before = shared.written(spark.range(5), "before")

    def make():
        own = shared.written(before.selectExpr("id + 1 as id"), "own")
        make.at = own.inputFiles()[0].removeprefix("file://")
        return own.where("id > 2")

    out = shared.written_alone(make, "result")
    assert not os.path.exists(make.at) and sorted(r.id for r in out.collect()) == [3, 4, 5] and before.count() == 5
