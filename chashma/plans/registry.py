"""Where queries and their SQL are kept: `@query(sql)` registers a function under its own name."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _plain_counts(sql: str) -> str:
    """`count_if(x)`, which is a 128-bit number in DuckDB, as a filtered count, which has 64 bits."""
    while (at := sql.find("count_if(")) >= 0:
        depth, end, quoted = 1, at + 9, False
        while depth:
            quoted ^= sql[end] == "'"
            depth += 0 if quoted else {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}(count(*) FILTER (WHERE {sql[at + 9 : end - 1]})){sql[end:]}"
    return sql


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = _plain_counts(sql)
        return f

    return register
