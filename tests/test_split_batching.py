"""F1-F4, H1-H4."""

import hashlib
import math

import pandas as pd
import pytest

from framewright.operators import batching as H
from framewright.operators import split as SP


def test_split_exact_disjoint_complete(spark):
    n = 1003
    df = spark.range(n).withColumnRenamed("id", "doc_id")
    out = SP.split_train_val(df, "doc_id").collect()
    val = {r["doc_id"] for r in out if r["split"] == "val"}
    assert len(out) == n and len({r["doc_id"] for r in out}) == n
    assert len(val) == math.ceil(0.2 * n)
    ranked = sorted(range(n), key=lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest())
    assert val == set(ranked[: math.ceil(0.2 * n)])


def test_slice_floor(spark):
    df = spark.range(11).withColumnRenamed("id", "k")
    assert SP.slice_sample(df, "k", 0.5).count() == 5
    assert SP.slice_sample(df, "k", 1.0).count() == 11


def test_split_decides_rows_in_one_scan(spark):
    df = spark.range(50).withColumnRenamed("id", "doc_id")
    began = spark.sparkContext.statusTracker().getJobIdsForGroup()
    out = SP.split_train_val(df, "doc_id")
    assert spark.sparkContext.statusTracker().getJobIdsForGroup() == began  # no job before the frame is used
    plan = out._jdf.queryExecution().optimizedPlan()
    # outside the scalar subquery: the scan and a projection
    assert plan.nodeName() == "Project" and plan.children().head().nodeName() == "Range"


def test_split_with_repeated_and_null_keys(spark):
    keys = [1] * 300 + list(range(2, 400)) + [None] * 3
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(5)
    out = SP.split_train_val(df, "k").collect()
    assert len(out) == len(keys)
    side = {}
    for r in out:
        assert side.setdefault(r["k"], r["split"]) == r["split"]
    digest = lambda k: hashlib.md5(f"42|{'null' if k is None else k}".encode()).hexdigest()
    ranked = sorted(keys, key=digest)
    last = ranked[math.ceil(0.2 * len(keys)) - 1]
    assert {k for k, v in side.items() if v == "val"} == {k for k in keys if digest(k) <= digest(last)}


def test_split_of_nothing_and_of_all(spark):
    df = spark.range(7).withColumnRenamed("id", "k")
    assert SP.split_train_val(df.limit(0), "k").count() == 0
    assert SP.first_by_hash(df, "k", 0).where("is_first").count() == 0
    assert SP.first_by_hash(df, "k", 7).where("is_first").count() == 7
    assert SP.first_by_hash(df, "k", 99).where("is_first").count() == 7


def test_sample_limit_and_report(spark):
    df = spark.range(10).withColumnRenamed("id", "idx")
    assert [r[0] for r in SP.sample_limit(df, "idx", 3).collect()] == [0, 1, 2]
    assert SP.sample_limit(df, "idx", 0).count() == 10
    rep = {r["split"]: r["n_rows"] for r in SP.split_report(SP.split_train_val(df, "idx")).collect()}
    assert rep == {"train": 8, "val": 2}


def test_positions_match_sort_with_hot_values_and_nulls(spark):
    rows = [(i, 5 if i % 3 else (i % 7)) for i in range(300)] + [(300, None), (301, None)]
    df = spark.createDataFrame(rows, "idx long, length long").repartition(5)
    got = {r["idx"]: r["sort_pos"] for r in H.length_positions(df).collect()}
    want = {idx: pos + 1 for pos, (idx, _) in enumerate(sorted(rows, key=lambda r: (r[1] is None, r[1], r[0])))}
    assert got == want


def test_positions_of_repeated_rows_are_distinct(spark):
    df = spark.createDataFrame([(1, 4)] * 5 + [(0, 4), (2, 3)], "idx long, length long")
    got = sorted((r["sort_pos"], r["idx"]) for r in H.length_positions(df).collect())
    assert got == [(1, 2), (2, 0)] + [(k, 1) for k in range(3, 8)]


def test_batches_and_padding(spark):
    rows = [(i, L) for i, L in enumerate([3, 1, 2, 9, 4, 4, 1])]
    df = spark.createDataFrame(rows, "idx long, length long")
    b = H.length_batches(df, 3)
    got = {r["idx"]: r["batch_no"] for r in b.collect()}
    assert got == {1: 0, 6: 0, 2: 0, 0: 1, 4: 1, 5: 1, 3: 2}
    pw = {r["batch_no"]: (r["n_rows"], r["max_length"], r["real_length"], r["padded_length"])
          for r in H.padding_waste(b).collect()}
    assert pw == {0: (3, 2, 4, 6), 1: (3, 4, 11, 12), 2: (1, 9, 9, 9)}


def test_predict_batches_sees_whole_batches(spark):
    df = spark.createDataFrame([(i, "p%d" % i, i % 4) for i in range(10)], "idx long, prompt string, length long")
    b = H.length_batches(df, 4)

    def predictor(pdf: pd.DataFrame) -> pd.Series:
        assert len(pdf) <= 4
        return pdf["prompt"].str.upper() + "/" + str(len(pdf))

    out = {r["idx"]: r["prediction"] for r in H.predict_batches(b, predictor).collect()}
    assert len(out) == 10 and out[0].startswith("P0/")


def test_predictions_of_a_frame_come_together():
    """Batches that end in a later frame are whole; a frame gives one frame of texts, not one a batch; a missing text raises."""
    rows = pd.DataFrame({"idx": range(100, 123), "batch_no": [i // 4 for i in range(23)]})
    frames = [rows.iloc[:0], rows.iloc[:10], rows.iloc[10:11], rows.iloc[11:21].reset_index(drop=True), rows.iloc[21:]]
    seen = []

    def predictor(pdf: pd.DataFrame) -> pd.Series:
        seen.append(list(pdf["idx"]))
        return pd.Series([f"{i}/{len(pdf)}" for i in pdf["idx"]])

    out = list(H.predicted(frames, predictor, "idx"))
    assert seen == [list(range(100 + i, min(104 + i, 123))) for i in range(0, 23, 4)]
    assert [len(x) for x in out] == [8, 12, 3]
    assert [t for x in out for t in x["prediction"]] == [f"{i}/{4 if i < 120 else 3}" for i in range(100, 123)]
    with pytest.raises(ValueError):
        list(H.predicted(frames, lambda pdf: pd.Series(["x"]), "idx"))
