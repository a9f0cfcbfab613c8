"""Names under which SQL can call the library: SQL functions over built-ins, and UDFs over Arrow batches where none expresses it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from driftlens.functions import names, text
from driftlens.operators.linediff import RANGES, changed
from driftlens.operators.scopes import labels

_WORDS = ", ".join(f"'{k}'" for k in text.KEYWORDS)


def _root(x: str) -> str:
    return f"CASE WHEN {x} RLIKE r'{names.GENERATED}' OR {x} RLIKE r'{names.STATE_FIELD}' THEN regexp_replace({x}, r'{names.TAIL}', '') END"


def _sum(x: str) -> str:
    return f"CASE WHEN {x} RLIKE r'{names.SEGMENT}' THEN regexp_replace({x}, r'{names.SEGMENT}', '') END"


#: SQL functions of one string: type and body.
NATIVE = {
    "generated_root": ("STRING", _root("x")),
    "checksum_root": ("STRING", _sum("x")),
    "canonical_generated": ("STRING", f"array_join(transform(regexp_extract_all(x, r'(?s){text.IDENT}|[^A-Za-z_]++|.', 0), t -> coalesce({_root('t')}, {_sum('t')}, t)), '')"),
    "is_identifier": ("BOOLEAN", f"x RLIKE r'^{text.IDENT}$' AND x NOT IN ({_WORDS})"),
}


def register(spark: SparkSession) -> list[str]:
    """Registers line_hunks(old, new), scope_labels(code, rules) and the functions of NATIVE."""

    @F.pandas_udf(RANGES)
    def line_hunks(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("i1", "i2", "j1", "j2"), h, strict=True)) for h in changed(x.split("\n"), y.split("\n"))] for x, y in zip(a, b, strict=True)])

    @F.pandas_udf("array<string>")
    def scope_labels(code: pd.Series, rules: pd.Series) -> pd.Series:
        return pd.Series([labels(c, r) for c, r in zip(code, rules, strict=True)], dtype=object)

    for name, f in (("line_hunks", line_hunks), ("scope_labels", scope_labels)):
        spark.udf.register(name, f)
    for name, (kind, body) in NATIVE.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {kind} RETURN {body}")
    return ["line_hunks", "scope_labels", *NATIVE]
