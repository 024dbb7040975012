"""A1-A3 on real bytes and broken files; D14 on a procedure without lines."""

import json
import os

import pytest
from pyspark.sql import functions as F

from framewright.operators.locations import LabelRun
from framewright.sources import dataset as DS
from framewright.sources import files as FS
from tests.helpers import files_df


def test_bad_bytes_are_dropped_or_replaced(spark, tmp_dir):
    with open(os.path.join(tmp_dir, "a.asm"), "wb") as f:
        f.write(b"ok\xff! \xef\xbf\xbd kept\r\nend")
    dropped = FS.read_tree(spark, tmp_dir).first()["content"]
    assert dropped == "ok! � kept\nend"
    assert FS.read_listings(spark, tmp_dir).first()["content"] == "ok�! � kept\nend"


def test_a_malformed_array_raises(spark, tmp_dir):
    path = os.path.join(tmp_dir, "d.json")
    with open(path, "w") as f:
        f.write('[{"file_id": 1, "source_code_c": "x"}, {"file_id": 2, ')
    with pytest.raises(Exception):
        DS.read_dataset(spark, path).collect()


def test_ingest_deals_records_over_partitions(spark, tmp_dir):
    path = os.path.join(tmp_dir, "d.json")
    with open(path, "w") as f:
        json.dump([{"file_id": k, "source_code_c": "c", "assembly_code": ""} for k in range(20)], f)
    out = DS.ingest(spark, path, os.path.join(tmp_dir, "out"), 4)
    assert out.count() == 20 and {r["file_key"] for r in out.collect()} == {str(k) for k in range(20)}


def test_eval_report_is_written(spark, tmp_dir):
    results = spark.createDataFrame([(1, "p", "t", True, False), (0, "p", "t", True, True)],
                                    "sample_idx long, prediction string, ground_truth string, json_parse_success boolean, exact_match_success boolean")
    metrics = spark.createDataFrame([(2, 100.0, 50.0)], "total_samples long, json_parse_rate_pct double, exact_match_accuracy_pct double")
    DS.write_eval_report(metrics, results, tmp_dir + "/r", model="m", adapter="a")
    assert spark.read.json(tmp_dir + "/r/metrics").first().asDict() == {
        "total_samples": 2, "json_parse_rate_pct": 100.0, "exact_match_accuracy_pct": 50.0, "model": "m", "adapter": "a"}
    assert spark.read.json(tmp_dir + "/r/results").count() == 2


def test_procedure_of_blank_lines_replaces_stale_values(spark):
    df = files_df(spark, [(1, "", "_f proc near\n \n\n_f endp", [("f", ["a", "ptr_a"])])])
    stale = df.withColumn("label", F.expr("""named_struct('functions', transform(label.functions, f -> named_struct(
        'function_name', f.function_name, 'stack_allocation_instruction', 'OLD', 'stack_allocation_size_bytes', 99L,
        'variable_mapping', transform(f.variable_mapping, v -> named_struct('variable_name', v.variable_name,
            'assembly_reference', 'ebp-1', 'allocation_space_offset', -1L, 'size_bytes', v.size_bytes)))))"""))
    fn = LabelRun(stale).updated_files(stale).first()["label"]["functions"][0]
    assert (fn["stack_allocation_instruction"], fn["stack_allocation_size_bytes"]) == (None, None)
    got = {v["variable_name"]: v["assembly_reference"] for v in fn["variable_mapping"]}
    assert got == {"a": "ebp-1", "ptr_a": None}
