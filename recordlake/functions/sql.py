"""The engine's scalar functions for SQL users, registered as temporary SQL functions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name, arguments, result, body.
FUNCTIONS = (
    ("rl_norm_label", "x STRING", "STRING", "lower(trim(regexp_replace(x, '(?U)\\\\s+', ' ')))"),
    ("rl_canonical", "x STRING", "STRING", "trim(regexp_replace(lower(x), '[^a-z0-9]+', ' '))"),
    ("rl_meaningful", "x STRING", "BOOLEAN", "x IS NOT NULL AND trim(x) <> ''"),
    ("rl_phrase_in", "text STRING, phrase STRING", "BOOLEAN", "contains(concat(' ', text, ' '), concat(' ', phrase, ' '))"),
    ("rl_json_digest", "x STRING", "STRING", "sha2(to_json(try_parse_json(x)), 256)"),
    ("rl_id_prefix", "x STRING", "STRING", "CASE WHEN substring(replace(x, '-', ''), 1, 2) RLIKE '^[0-9a-f]{2}$' THEN substring(replace(x, '-', ''), 1, 2) ELSE '__' END"),
)


def register(spark: SparkSession) -> list[str]:
    """Registers all of FUNCTIONS with the session; their names. Registering again changes nothing."""
    for name, arguments, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    return [name for name, *_ in FUNCTIONS]
