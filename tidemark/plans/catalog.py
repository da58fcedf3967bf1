"""All queries of the core: name -> (function of session and data folder, DuckDB SQL or None)."""

from tidemark.plans import books, extras, ledger, lifetimes, p1_skew, p2_once, p3_wide, p4_spans, p6_late, quality, series, simulation, streams, traits

_MODULES = (p1_skew, p2_once, p3_wide, p4_spans, p6_late, series, books, lifetimes, traits, ledger, streams, quality, simulation, extras)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
FLAGSHIP = "standing_ask"
