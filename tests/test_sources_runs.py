"""A1-A8, B1-B3, J1-J4 on files in a fresh temporary folder."""

import json
import os

from pyspark.sql import functions as F

from framewright.operators import pairing as B
from framewright.operators import runs as J
from framewright.sources import checkpoints, dataset, files
from tests.helpers import order_tables


def write(path, data, mode="w"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as f:
        f.write(data)


SAMPLE = [{"file_id": 0, "source_code_c": "void f() {\n    int a;\n}\n", "assembly_code": "",
           "label": {"functions": [{"function_name": "f", "stack_allocation_instruction": None,
                                    "stack_allocation_size_bytes": None,
                                    "variable_mapping": [{"variable_name": "a", "assembly_reference": None,
                                                          "allocation_space_offset": None, "size_bytes": 4}]}]}},
          {"file_id": "real_stem", "source_code_c": "x", "assembly_code": "y"}]


def test_read_dataset_explicit_schema_and_roundtrip(spark, tmp_dir):
    p = os.path.join(tmp_dir, "dataset_labels.json")
    write(p, json.dumps(SAMPLE, indent=2))
    df = dataset.read_dataset(spark, p)
    rows = {r["file_key"]: r for r in df.collect()}
    assert set(rows) == {"0", "real_stem"}
    assert rows["0"]["file_no"] == 0 and rows["real_stem"]["file_no"] is None
    assert rows["0"]["label"]["functions"][0]["variable_mapping"][0]["size_bytes"] == 4
    assert rows["real_stem"]["label"] is None
    out = os.path.join(tmp_dir, "out")
    dataset.write_dataset(df, dataset.stage_path(out, "sanitized"))
    back = dataset.read_dataset(spark, dataset.stage_path(out, "sanitized"), multiline=False)
    assert back.count() == 2


def test_write_splits(spark, tmp_dir):
    df = dataset.read_dataset(spark, _sample_file(tmp_dir)).withColumn(
        "split", F.when(F.col("file_key") == "0", "val").otherwise("train"))
    dataset.write_splits(df, os.path.join(tmp_dir, "splits"))
    assert os.path.isdir(os.path.join(tmp_dir, "splits", "split=val"))
    assert os.path.isdir(os.path.join(tmp_dir, "splits", "split=train"))


def _sample_file(tmp_dir):
    p = os.path.join(tmp_dir, "d.json")
    write(p, json.dumps(SAMPLE))
    return p


def test_pair_tree(spark, tmp_dir):
    root = os.path.join(tmp_dir, "tree")
    write(os.path.join(root, "a", "x.c"), "int x;\r\n")
    write(os.path.join(root, "b", "x.asm"), "_x proc near\n")
    write(os.path.join(root, "y.c"), "int y;")
    write(os.path.join(root, "z.txt"), "other")
    write(os.path.join(root, "bad.c"), b"ok\xff!".decode("latin-1"), "w")
    tree = files.read_tree(spark, root)
    pairs = B.pair_files(tree).collect()
    assert [(r["file_id"], r["source_code_c"], r["assembly_code"]) for r in pairs] == \
        [("x", "int x;\n", "_x proc near\n")]


def test_stitch_and_report(spark, tmp_dir):
    folder = os.path.join(tmp_dir, "asm")
    write(os.path.join(folder, "sample_00007.asm"), "L7")
    lst = files.read_listings(spark, folder)
    rec = spark.createDataFrame([(7, ""), (8, "old"), (None, "")], "file_no long, assembly_code string")
    st = B.stitch_listings(rec, lst)
    got = {r["file_no"]: r["assembly_code"] for r in st.collect()}
    assert got == {7: "L7", 8: "old", None: ""}
    assert B.stitch_report(st).first().asDict() == {"stitched": 1, "missing": 1, "no_id": 1}


def test_latest_checkpoint_from_folders(spark, tmp_dir):
    base = os.path.join(tmp_dir, "run")
    state = json.dumps({"log_history": [{"loss": 2.0, "step": 1}, {"eval_loss": 1.5, "step": 1}, {"step": 2}]})
    write(os.path.join(base, "checkpoint-9", "trainer_state.json"), state)
    write(os.path.join(base, "checkpoint-10", "trainer_state.json"), state)
    write(os.path.join(base, "checkpoint-x", "trainer_state.json"), state)
    write(os.path.join(base, "trainer_state.json"), state)
    entries = checkpoints.run_entries(spark, base)
    r = J.latest_checkpoint(entries).first()
    assert r["state_path"] == "checkpoint-10/trainer_state.json"
    log = checkpoints.read_log_history(spark, os.path.join(base, r["state_path"]))
    curve = sorted(tuple(x) for x in J.loss_curve(log).collect())
    assert curve == [("eval", 1, 1.5), ("train", 1, 2.0)]


def test_latest_checkpoint_falls_back_to_root(spark):
    e = spark.createDataFrame([("checkpoint-3", True), ("checkpoint-12", False), ("", True)],
                              "folder string, has_state boolean")
    assert J.latest_checkpoint(e).first()["state_path"] == "trainer_state.json"
    e2 = spark.createDataFrame([("checkpoint-12", False), ("", False)], "folder string, has_state boolean")
    assert J.latest_checkpoint(e2).first()["state_path"] is None


def test_throughput_and_epoch(spark):
    steps = spark.createDataFrame([(i, 1.0 if i >= 5 else 9.0, 100, float(i)) for i in range(8)],
                                  "step long, elapsed_s double, real_tokens long, peak_gb double")
    r = J.throughput_report(steps).first()
    assert (r["avg_step_s"], r["avg_tokens_per_s"], r["measured_steps"], r["peak_gb"]) == (1.0, 100.0, 3, 7.0)
    e = J.epoch_estimate(J.throughput_report(steps)).first()
    assert e["steps_per_epoch"] == 826 and e["tokens_per_epoch"] == 13211 * 1828


def test_rewrite_replaces_whole_folders_or_nothing(spark, tmp_dir):
    import pytest
    path = os.path.join(tmp_dir, "keyed")
    dataset.write_keyed(spark.range(100).select(F.col("id").cast("string").alias("file_id"), F.lit("old").alias("assembly_code")), path, 5)
    new = dataset.rewrite(spark, path, lambda d: d.withColumn("assembly_code", F.concat(F.lit("new"), "file_id")))
    assert {r["file_id"]: r["assembly_code"] for r in new.collect()} == {str(k): f"new{k}" for k in range(100)}
    with pytest.raises(Exception):
        dataset.rewrite(spark, path, lambda d: d.withColumn("assembly_code", F.raise_error(F.lit("stopped"))))
    assert spark.read.parquet(path).where("assembly_code LIKE 'new%'").count() == 100
    part = dataset.rewrite(spark, path, lambda d: d.where("part = 2").withColumn("assembly_code", F.lit("again")))
    assert part.count() == 100 and part.where("assembly_code = 'again'").count() == part.where("part = 2").count()


def test_pairs_of_a_hot_stem(spark):
    rows = [(f"t/{k}/x.c", f"c{k}") for k in range(1000)] + [("t/0/x.asm", "a0"), ("t/9/x.asm", "a9"), ("t/y.c", "y"), ("t/.c", "n"), ("t/z", "z")]
    pairs = B.pair_files(spark.createDataFrame(rows, "path string, content string"))
    assert [tuple(r) for r in pairs.collect()] == [("x", "c999", "a9")]
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert all("content" not in line for line in plan.splitlines() if "Aggregate" in line)


def test_an_array_is_read_by_many_tasks(spark, tmp_dir):
    import random

    import pytest
    rng = random.Random(6)
    odd = ['}', '{"x": [', '\\"', '\\\\', "é\U0001F600", "]", ",", '"', "\n", "}{", "\\"]
    records = [{"file_id": k, "source_code_c": "".join(rng.choice(odd) for _ in range(rng.randint(0, 9))), "assembly_code": "x" * rng.randint(0, 300),
                "label": {"functions": [{"function_name": f"f{k}", "stack_allocation_instruction": None, "stack_allocation_size_bytes": k, "variable_mapping": []}] * (k % 3)}}
               for k in range(700)]
    want = {str(r["file_id"]): (r["source_code_c"], r["assembly_code"], len(r["label"]["functions"])) for r in records}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for k, kw in enumerate(({}, {"indent": 2}, {"ensure_ascii": False, "separators": (",", ":")})):
            p = os.path.join(tmp_dir, f"a{k}.json")
            write(p, json.dumps(records, **kw))
            df = dataset.read_array(spark, p)
            got = {r["file_key"]: (r["source_code_c"], r["assembly_code"], len(r["label"]["functions"])) for r in df.collect()}
            assert got == want
            assert spark.read.option("lineSep", "}").text(p).rdd.getNumPartitions() > 8
        empty = os.path.join(tmp_dir, "e.json")
        write(empty, " [ ]\n")
        assert dataset.read_array(spark, empty).count() == 0
        whole = json.dumps(records[:5])
        for bad in (whole[:-1], whole[:-20], whole[1:], whole + "x", whole.replace('}, {"file', '} {"file', 1), "[1, 2]", '{"file_id": 1}'):
            p = os.path.join(tmp_dir, "bad.json")
            write(p, bad)
            with pytest.raises(Exception):
                dataset.read_array(spark, p).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_steps_without_time_run_at_infinite_speed(spark):
    """Dividing by an elapsed time of zero is no error: the quotient is IEEE's, in warm-up steps and others."""
    steps = spark.createDataFrame([(i, 0.0 if i in (2, 8) else 2.0, 10, 1.0) for i in range(10)], "step long, elapsed_s double, real_tokens long, peak_gb double")
    r = J.throughput_report(steps).first()
    assert (r["max_tokens_per_s"], r["min_tokens_per_s"], r["avg_tokens_per_s"], r["measured_steps"]) == (float("inf"), 5.0, 50 / 8.0, 5)
    still = J.throughput_report(steps.withColumn("elapsed_s", F.lit(0.0)))
    assert still.first()["avg_tokens_per_s"] == float("inf")
    assert J.epoch_estimate(still).first()["epoch_seconds"] == 0.0
    none = J.epoch_estimate(J.throughput_report(steps.withColumn("real_tokens", F.lit(0).cast("long")))).first()
    assert none["epoch_minutes"] == float("inf")


def test_compressed_dataset_is_read_back(spark, tmp_dir):
    """The round trip writes compressed lines; they hold the same records."""
    from framewright.plans.catalog import QUERIES, corpus_files
    from framewright.session import ensure_checkpoint_dir

    tables = order_tables(spark, os.path.join(tmp_dir, "tables"))
    df = corpus_files(spark, tables).withColumn("file_id", F.col("file_key"))
    sizes = {}
    for codec in (None, "gzip"):
        path = os.path.join(tmp_dir, str(codec))
        dataset.write_dataset(df, path, compression=codec)
        sizes[codec] = sum(os.path.getsize(os.path.join(path, f)) for f in os.listdir(path))
        back = dataset.read_dataset(spark, path, multiline=False)
        for c in ("file_id", "source_code_c", "assembly_code", "label"):
            assert back.select(c).exceptAll(df.select(c)).count() == 0 and back.count() == df.count()
    assert sizes["gzip"] * 3 < sizes[None]
    top = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(top))
    assert QUERIES["dataset_roundtrip"](spark, tables).count() == df.count()
    made = [d for d in set(os.listdir(top)) - before if d.startswith("roundtrip-")]
    assert made and all(f.endswith(".json.gz") for d in made for f in os.listdir(os.path.join(top, d)) if f.startswith("part-"))
