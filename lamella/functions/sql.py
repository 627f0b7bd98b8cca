"""The scalar functions and directions as SQL functions of a session, for queries in plain SQL; Spark inlines them into its plans."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lamella.functions.geometry import BONES

#: Name, parameters, what it returns, and its body.
FUNCTIONS = (
    ("lm_distance", "ax DOUBLE, ay DOUBLE, az DOUBLE, bx DOUBLE, by DOUBLE, bz DOUBLE", "DOUBLE", "sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by) + (az - bz) * (az - bz))"),
    ("lm_clamp", "value DOUBLE, low DOUBLE, high DOUBLE", "DOUBLE", "least(high, greatest(low, value))"),
    ("lm_ellipsoid_volume", "a DOUBLE, b DOUBLE, c DOUBLE", "DOUBLE", "a * b * c * (4 * pi() / 3)"),
    ("lm_ellipsoid_factor", "a DOUBLE, b DOUBLE, c DOUBLE", "DOUBLE", "a / b - b / c"),
    ("lm_filled", "value DOUBLE, background DOUBLE, foreground DOUBLE", "DOUBLE", "least(1, greatest(0, (value - background) / (foreground - background)))"),
    ("lm_bone", "name STRING", "INT", "CAST(greatest(0, coalesce(array_position(array(" + ", ".join(f"'{b}'" for b in BONES) + "), name), 0) - 1) AS INT)"),
    ("lm_directions", "n INT", "TABLE(i BIGINT, x DOUBLE, y DOUBLE, z DOUBLE)", "SELECT i, sqrt(1 - z * z) * cos(i * pi() * (3 - sqrt(5))), sqrt(1 - z * z) * sin(i * pi() * (3 - sqrt(5))), z FROM (SELECT i, 1 - (2 * i + 1) / n AS z FROM (SELECT explode(sequence(0L, n - 1L)) AS i))"),
)


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session, anew if they were; their names."""
    for name, parameters, returns, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")
    return [f[0] for f in FUNCTIONS]
