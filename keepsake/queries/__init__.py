"""Registered queries of the library's own operators, and the same in DuckDB SQL."""

from keepsake.queries import claims, code, corpus, derivations, identity, incremental, ledger, lineage, memory

_MODULES = (incremental, ledger, claims, lineage, memory, corpus, identity, derivations, code)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
