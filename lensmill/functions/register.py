"""The same functions for SQL users: ``register(spark)``, then ``SELECT wilson_low(agreed, compared) ...``.

They are SQL functions, which Catalyst inlines, not Python ones.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from lensmill.functions.stats import Z

_CENTRE, _HALF = f"(hits / n + {Z * Z} / (2 * n))", f"({Z} * sqrt(hits / n * (1 - hits / n) / n + {Z * Z} / (4 * n * n)))"
FUNCTIONS = {
    "ratio(part DOUBLE, whole DOUBLE) RETURNS DOUBLE": "CASE WHEN whole <> 0 THEN part / whole ELSE 0 END",
    "rate(part DOUBLE, whole DOUBLE) RETURNS DOUBLE": "CASE WHEN whole <> 0 THEN part / whole END",
    "wilson_low(hits DOUBLE, n DOUBLE) RETURNS DOUBLE": f"CASE WHEN n > 0 THEN greatest(0D, ({_CENTRE} - {_HALF}) / (1 + {Z * Z} / n)) END",
    "wilson_high(hits DOUBLE, n DOUBLE) RETURNS DOUBLE": f"CASE WHEN n > 0 THEN least(1D, ({_CENTRE} + {_HALF}) / (1 + {Z * Z} / n)) END",
    "mcnemar_p(gained INT, lost INT) RETURNS DOUBLE": """CASE WHEN gained + lost > 0 THEN least(1D, 2 * aggregate(
        CASE WHEN least(gained, lost) > 0 THEN sequence(1, least(gained, lost)) ELSE CAST(array() AS ARRAY<INT>) END,
        named_struct('term', power(0.5D, gained + lost), 'sum', power(0.5D, gained + lost)),
        (s, i) -> named_struct('term', s.term * (gained + lost - i + 1) / i, 'sum', s.sum + s.term * (gained + lost - i + 1) / i), s -> s.sum)) END""",
    "year_month(at BIGINT) RETURNS STRING": "date_format(timestamp_seconds(at), 'yyyy-MM')",
    "not_blank(t STRING) RETURNS BOOLEAN": r"coalesce(t RLIKE '(?U)\\S', false)",
    "text_key(t STRING) RETURNS STRING": "sha2(t, 256)",
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in this session and return their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [head.partition("(")[0] for head in FUNCTIONS]
