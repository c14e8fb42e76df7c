"""The scalar layer as temporary SQL functions, which Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "is_empty_value": ("v STRING", "BOOLEAN", "v IS NULL OR v = '' OR lower(trim(v)) IN ('-', 'n/a')"),
    "is_present_value": ("v STRING", "BOOLEAN", "coalesce(v <> '', false)"),
    "collapse_text": ("v STRING", "STRING", r"trim(regexp_replace(coalesce(v, ''), r'(?U)\s+', ' '))"),
    "text_norm": ("v STRING", "STRING", r"replace(lower(trim(regexp_replace(coalesce(v, ''), r'(?U)\s+', ' '))), 'ß', 'ss')"),
    "url_host": ("u STRING", "STRING", r"lower(regexp_replace(regexp_extract(coalesce(u, ''), r'^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)', 1), r'[\[\]]', ''))"),
    "visible_text": (
        "h STRING",
        "STRING",
        r"trim(regexp_replace(regexp_replace(regexp_replace(coalesce(h, ''), r'(?is)<(script|style)[^>]*>.*?</\1>', ' '), '<[^>]+>', ' '), r'(?U)\s+', ' '))",
    ),
    "is_live_status": ("s INT", "BOOLEAN", "coalesce(s IN (200, 301, 302, 303, 307, 308), false)"),
}


def register(spark: SparkSession) -> list[str]:
    """Create all functions in the session; their names."""
    for name, (arguments, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    return list(FUNCTIONS)
