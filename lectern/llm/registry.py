"""The subpackage's queries and SQL, collected from its modules."""

from __future__ import annotations

from lectern.llm import (
    centroids,
    collocations,
    decontaminate,
    exact_dedup,
    license_scan,
    ngram_join,
    private_data,
    quality_lm,
    source_mix,
    suffix_dedup,
    token_count,
    url_filter,
    warc,
)

_MODULES = (ngram_join, source_mix, token_count, exact_dedup, license_scan, warc, decontaminate, quality_lm, url_filter, suffix_dedup, private_data, collocations, centroids)

QUERIES: dict = {}
ORACLE: dict = {}
for _m in _MODULES:
    QUERIES |= _m.QUERIES
    ORACLE |= _m.ORACLE
