"""Training-data operators: deduplication, decontamination, quality, packing, sharding.

Everything here works on a `documents`-like frame (an id and a text); nothing else in
the package imports this subpackage. `queries()` and `oracle_sql()` list its queries.
"""

from __future__ import annotations


def queries():
    from marketloom.llm.entries import QUERIES

    return dict(QUERIES)


def oracle_sql():
    from marketloom.llm.entries import ORACLES

    return dict(ORACLES)
