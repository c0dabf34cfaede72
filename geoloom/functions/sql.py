"""Functions for SQL texts: temporary SQL functions, which Spark inlines into the plan, so they cost what their bodies
cost and stay inside generated code where those do."""

from __future__ import annotations

from pyspark.sql import SparkSession

RING = "ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>"
_PAIRS = "arrays_zip(slice(ring, 1, size(ring) - 1), slice(ring, 2, size(ring) - 1))"
#: name(parameters), type, body. Rings are closed; pairs of corners are fields 0 and 1 of what arrays_zip makes.
FUNCTIONS = (
    (f"gl_area(ring {RING})", "DOUBLE", f"abs(aggregate({_PAIRS}, 0D, (s, p) -> s + (p['0'].x * p['1'].y - p['1'].x * p['0'].y) / 2))"),
    (f"gl_perimeter(ring {RING})", "DOUBLE", f"aggregate({_PAIRS}, 0D, (s, p) -> s + sqrt(pow(p['1'].x - p['0'].x, 2) + pow(p['1'].y - p['0'].y, 2)))"),
    (f"gl_signed(ring {RING})", "DOUBLE", f"aggregate({_PAIRS}, 0D, (s, p) -> s + (p['0'].x * p['1'].y - p['1'].x * p['0'].y) / 2)"),
    (
        f"gl_centroid(ring {RING})",
        "STRUCT<x: DOUBLE, y: DOUBLE>",
        f"""named_struct('x', aggregate({_PAIRS}, 0D, (s, p) -> s + (p['0'].x + p['1'].x) * (p['0'].x * p['1'].y - p['1'].x * p['0'].y)) / (6 * gl_signed(ring)),
 'y', aggregate({_PAIRS}, 0D, (s, p) -> s + (p['0'].y + p['1'].y) * (p['0'].x * p['1'].y - p['1'].x * p['0'].y)) / (6 * gl_signed(ring)))""",
    ),
    ("gl_box(x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)", RING, "array(named_struct('x', x0, 'y', y0), named_struct('x', x1, 'y', y0), named_struct('x', x1, 'y', y1), named_struct('x', x0, 'y', y1), named_struct('x', x0, 'y', y0))"),
    ("gl_overlaps(ax0 DOUBLE, ay0 DOUBLE, ax1 DOUBLE, ay1 DOUBLE, bx0 DOUBLE, by0 DOUBLE, bx1 DOUBLE, by1 DOUBLE)", "BOOLEAN", "ax0 < bx1 AND bx0 < ax1 AND ay0 < by1 AND by0 < ay1"),
    ("gl_index(a DOUBLE, b DOUBLE)", "DOUBLE", "try_divide(a - b, a + b)"),
)


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session; returns their names."""
    for head, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    return [head.split("(")[0] for head, _, _ in FUNCTIONS]
