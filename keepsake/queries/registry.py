"""Small helpers to register queries."""

from __future__ import annotations

from keepsake.fixtures import duckdb_sql, load


def framed(label: str, *parts: str) -> str:
    """SQL of digest_column()."""
    return f"sha256(concat('keepsake/{label}/v1|', " + ", '|', ".join(f"CASE WHEN {p} IS NULL THEN '-' ELSE concat(cast(length(cast({p} AS string)) AS string), ':', cast({p} AS string)) END" for p in parts) + "))"


def summed(label: str, member: str) -> str:
    """SQL of sum_digest()."""
    return framed(label, f"count({member})", *[f"sum(cast(cast(concat('0x', substr({member}, {15 * k + 1}, 15)) AS ubigint) AS hugeint))" for k in range(4)])


class Registry:
    def __init__(self):
        self.queries: dict = {}
        self.oracle: dict[str, str] = {}

    def query(self, *tables: str, sql: str | None = None, name: str | None = None):
        """Register f(*tables as DataFrames); sql names fixtures in {braces}."""

        def register(f):
            key = name or f.__name__
            self.queries[key] = lambda spark, sf_dir: f(*[load(spark, sf_dir, t) for t in tables])
            if sql is not None:
                self.oracle[key] = duckdb_sql(sql)
            return f

        return register
