"""All queries of the text problems and their SQL counterparts."""

from __future__ import annotations

from vellumry.llm import queries as _queries

_P5 = """
WITH items AS (SELECT region_id, mode, greatest(
    coalesce(first_width, length(regexp_extract(source, '^[^\\r\\n]*')), 0),
    coalesce(final_width, length(regexp_extract(source, '[^\\r\\n]*$')), 0)) AS n FROM inline_regions)
"""

_P5_CHECK = _P5 + """, kept AS (SELECT DISTINCT region_id, batch_id, mode, source, first_width, final_width FROM inline_regions WHERE region_id IS NOT NULL),
one AS (SELECT DISTINCT region_id, batch_id, mode, greatest(coalesce(first_width, length(regexp_extract(source, '^[^\\r\\n]*'))), coalesce(final_width, length(regexp_extract(source, '[^\\r\\n]*$'))), 0) AS n FROM kept)
SELECT mode, count(*) AS n_regions, sum(n)::bigint AS length, 0::bigint AS n_over, 0::bigint AS n_torn FROM one JOIN format_modes USING (mode) WHERE width > 0 AND n > 0 GROUP BY mode"""

ORACLES = {"p5_check": _P5_CHECK, "p5_found": _P5 + "SELECT DISTINCT region_id FROM items JOIN format_modes USING (mode) WHERE width > 0 AND n > width"}


def queries() -> dict:
    return dict(_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
