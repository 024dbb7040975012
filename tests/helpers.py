"""Builders for small hand-written inputs."""

from framewright.schemas import FILE_RECORD


def files_df(spark, records):
    """records: list of (file_id, c_source, asm, functions) where functions is a
    list of (name, [variable names] or [(name, old_ref, old_off)])."""
    rows = []
    for fid, c, asm, fns in records:
        label = {"functions": [
            {"function_name": n, "stack_allocation_instruction": None, "stack_allocation_size_bytes": None,
             "variable_mapping": [
                 ({"variable_name": v, "assembly_reference": None, "allocation_space_offset": None, "size_bytes": 4}
                  if isinstance(v, str) else
                  {"variable_name": v[0], "assembly_reference": v[1], "allocation_space_offset": v[2], "size_bytes": 4})
                 for v in vs]} for n, vs in fns]}
        rows.append((str(fid), c, asm, label))
    df = spark.createDataFrame(rows, FILE_RECORD)
    return df.withColumnRenamed("file_id", "file_key")


def proc(name, lines):
    return "\n".join([f"_{name}\tproc\tnear"] + lines + [f"_{name}\tendp"])


def order_tables(spark, folder, orders=30):
    """Tables ``orders`` and ``lineitem`` with the columns that the listing corpus reads: two orders a customer, up to five lines an order."""
    spark.createDataFrame([(k, k // 2) for k in range(1, orders + 1)], "o_orderkey long, o_custkey long").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(k, n, 7 * k + 3 * n) for k in range(1, orders + 1) for n in range(1, 2 + k % 5)],
                          "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{folder}/lineitem.parquet")
    return folder
