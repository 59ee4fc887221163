"""Declared schemas of rules, heuristics, manifests, findings and feedback."""

from pyspark.sql import types as T

RULE = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "name", "pattern", "severity", "description")] + [T.StructField("enabled", T.BooleanType())])

HEURISTICS = T.StructType(
    [T.StructField("minLength", T.IntegerType()), T.StructField("minEntropy", T.DoubleType())] + [T.StructField(c, T.ArrayType(T.StringType())) for c in ("sensitiveKeywords", "benignMarkers")]
)

MANIFEST = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("component", "version", "updated")] + [T.StructField("files", T.StructType([T.StructField(c, T.StringType()) for c in ("baseRules", "heuristics")]))]
)

FINDING = T.StructType(
    [
        T.StructField("ord", T.LongType()),
        T.StructField("file", T.StringType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("column", T.IntegerType()),
        T.StructField("end_column", T.IntegerType()),
        T.StructField("rule_id", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("function_name", T.StringType()),
        T.StructField("complexity", T.IntegerType()),
        T.StructField("nesting_depth", T.IntegerType()),
        T.StructField("function_loc", T.IntegerType()),
    ]
)

# The names of findings' fields in JSON.
JSON_NAMES = {
    "end_column": "endColumn", "rule_id": "ruleId", "rule_name": "ruleName", "node_kind": "nodeKind",
    "function_name": "functionName", "nesting_depth": "nestingDepth", "function_loc": "functionLoc",
}

FEEDBACK = T.StructType(
    [T.StructField("why", T.StringType()), T.StructField("fix", T.ArrayType(T.StringType())), T.StructField("maintainability", T.StringType()), T.StructField("example", T.StringType())]
)
