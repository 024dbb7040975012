"""Explicit schemas.  JSON inference types all-null fields as STRING, so
every reader takes one of these."""

from pyspark.sql import types as T

VARIABLE = T.StructType([
    T.StructField("variable_name", T.StringType()),
    T.StructField("assembly_reference", T.StringType()),
    T.StructField("allocation_space_offset", T.LongType()),
    T.StructField("size_bytes", T.LongType()),
])

FUNCTION = T.StructType([
    T.StructField("function_name", T.StringType()),
    T.StructField("stack_allocation_instruction", T.StringType()),
    T.StructField("stack_allocation_size_bytes", T.LongType()),
    T.StructField("variable_mapping", T.ArrayType(VARIABLE)),
])

LABEL = T.StructType([T.StructField("functions", T.ArrayType(FUNCTION))])

# file_id is an integer for generated corpora and a file stem for real ones:
# read it as text and derive file_key / file_no.
FILE_RECORD = T.StructType([
    T.StructField("file_id", T.StringType()),
    T.StructField("source_code_c", T.StringType()),
    T.StructField("assembly_code", T.StringType()),
    T.StructField("label", LABEL),
])

MESSAGE = T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
])
MESSAGES = T.ArrayType(MESSAGE)

LOG_ENTRY = T.StructType([
    T.StructField("step", T.LongType()),
    T.StructField("loss", T.DoubleType()),
    T.StructField("eval_loss", T.DoubleType()),
])

TRAINER_STATE = T.StructType([
    T.StructField("log_history", T.ArrayType(LOG_ENTRY)),
])

EVAL_RESULT = T.StructType([
    T.StructField("sample_idx", T.LongType()),
    T.StructField("prediction", T.StringType()),
    T.StructField("ground_truth", T.StringType()),
    T.StructField("json_parse_success", T.BooleanType()),
    T.StructField("exact_match_success", T.BooleanType()),
])
