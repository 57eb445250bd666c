"""Queries of the general data problems (1, 3, 4) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumry.operators import copydiff, incremental, references
from vellumry.runtime import table

CASE_FIELDS = ["expected_stdout", "before_tree", "after_tree"]


def _cases(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    cols = ["id", "revision", "recorded_at", *CASE_FIELDS]
    return table(spark, d, "upstream_cases").select(*cols), table(spark, d, "port_cases").select(*cols)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    left, right = _cases(spark, d)
    found = copydiff.latest_differences(left, right, "id", ["revision", "recorded_at"], CASE_FIELDS)
    named = F.when(F.col("diff") == copydiff.ONLY_LEFT, "only_upstream").when(F.col("diff") == copydiff.ONLY_RIGHT, "only_port").otherwise(F.col("diff"))
    return found.select("id", named.alias("diff")).distinct()


def p1_method(spark: SparkSession, d: str) -> DataFrame:
    """All revisions of all ids as duplicate-key copies: identical rows cancel by multiplicity,
    what is left of an id is paired at least cost."""
    left, right = _cases(spark, d)
    return copydiff.copy_differences(left, right, ["id"], CASE_FIELDS)


def p1_cost(spark: SparkSession, d: str) -> DataFrame:
    """Differing fields and unpaired rows of each id, at least cost."""
    of = lambda good: F.sum(F.when(good, F.col("n")).otherwise(0)).cast("bigint")
    ends = F.col("diff").isin(copydiff.ONLY_LEFT, copydiff.ONLY_RIGHT)
    return p1_method(spark, d).groupBy("id").agg(of(~ends).alias("n_fields"), of(F.col("diff") == copydiff.ONLY_LEFT).alias("n_upstream"), of(F.col("diff") == copydiff.ONLY_RIGHT).alias("n_port"))


def p1_summary(spark: SparkSession, d: str) -> DataFrame:
    return p1_found(spark, d).groupBy("diff").agg(F.count(F.lit(1)).alias("n_ids"))


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return references.mapping_references(table(spark, d, "discovered_tests"), table(spark, d, "test_mapping"), table(spark, d, "mapping_checks"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return references.mapping_orphans(table(spark, d, "discovered_tests"), table(spark, d, "test_mapping"), table(spark, d, "mapping_checks"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_report(p3_found(spark, d))


def p3_current(spark: SparkSession, d: str) -> DataFrame:
    """Keys that are referenced and do not exist once all changes have happened."""
    every, deltas = _references(spark, d)
    state = references.current_orphans(references.signed_counts(every, deltas, "src_table", "ref_key"))
    return state.select("src_table", "ref_key", "n_refs")


def p3_history(spark: SparkSession, d: str) -> DataFrame:
    """Referenced keys that do not exist, at the end of each month."""
    return references.orphan_history(*_references(spark, d), "src_table")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.ledger_replay(table(spark, d, "cache_manifests"), table(spark, d, "tree_files"))


def p4_work_per_run(spark: SparkSession, d: str) -> DataFrame:
    return p4_found(spark, d).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_files"))


QUERIES = {f.__name__: f for f in (p1_found, p1_method, p1_cost, p1_summary, p3_found, p3_report, p3_current, p3_history, p4_found, p4_work_per_run)}

_P1 = """
WITH u AS (SELECT * FROM (SELECT id, expected_stdout, before_tree, after_tree,
             row_number() OVER (PARTITION BY id ORDER BY revision DESC, recorded_at DESC) AS k FROM upstream_cases) WHERE k = 1),
     p AS (SELECT * FROM (SELECT id, expected_stdout, before_tree, after_tree,
             row_number() OVER (PARTITION BY id ORDER BY revision DESC, recorded_at DESC) AS k FROM port_cases) WHERE k = 1),
     found AS (
SELECT id, 'only_upstream' AS diff FROM u WHERE id NOT IN (SELECT id FROM p)
UNION ALL SELECT id, 'only_port' FROM p WHERE id NOT IN (SELECT id FROM u)
UNION ALL SELECT u.id, 'expected_stdout' FROM u JOIN p ON u.id = p.id WHERE u.expected_stdout IS DISTINCT FROM p.expected_stdout
UNION ALL SELECT u.id, 'before_tree' FROM u JOIN p ON u.id = p.id WHERE u.before_tree IS DISTINCT FROM p.before_tree
UNION ALL SELECT u.id, 'after_tree' FROM u JOIN p ON u.id = p.id WHERE u.after_tree IS DISTINCT FROM p.after_tree)
"""

# All pairings of what is left of an id after identical rows have cancelled; the cheapest counts.
_P1_COST = """
WITH RECURSIVE u AS (SELECT id, expected_stdout AS a, before_tree AS b, after_tree AS c, count(*) AS n FROM upstream_cases GROUP BY ALL),
 p AS (SELECT id, expected_stdout AS a, before_tree AS b, after_tree AS c, count(*) AS n FROM port_cases GROUP BY ALL),
 l AS (SELECT u.*, u.n - coalesce(p.n, 0) AS left_over FROM u LEFT JOIN p ON u.id = p.id AND u.a IS NOT DISTINCT FROM p.a AND u.b IS NOT DISTINCT FROM p.b AND u.c IS NOT DISTINCT FROM p.c),
 r AS (SELECT p.*, p.n - coalesce(u.n, 0) AS left_over FROM p LEFT JOIN u ON u.id = p.id AND u.a IS NOT DISTINCT FROM p.a AND u.b IS NOT DISTINCT FROM p.b AND u.c IS NOT DISTINCT FROM p.c),
 rows AS (SELECT 'u' AS side, id, a, b, c, unnest(generate_series(1, left_over)) FROM l WHERE left_over > 0 UNION ALL SELECT 'p', id, a, b, c, unnest(generate_series(1, left_over)) FROM r WHERE left_over > 0),
 counted AS (SELECT id, count_if(side = 'u') AS nu, count_if(side = 'p') AS np FROM rows GROUP BY id),
 numbered AS (SELECT r.*, row_number() OVER (PARTITION BY r.id, side) AS k, (side = 'u') = (nu <= np) AS few FROM rows r JOIN counted USING (id)),
 walk AS (SELECT id, 0::bigint AS k, 0::bigint AS used, 0::bigint AS cost FROM counted
  UNION ALL SELECT w.id, f.k, w.used + (1 << m.k)::bigint, w.cost + (f.a IS DISTINCT FROM m.a)::int + (f.b IS DISTINCT FROM m.b)::int + (f.c IS DISTINCT FROM m.c)::int
  FROM walk w JOIN numbered f ON f.id = w.id AND f.few AND f.k = w.k + 1 JOIN numbered m ON m.id = w.id AND NOT m.few WHERE (w.used >> m.k) % 2 = 0)
SELECT id, min(cost)::bigint AS n_fields, greatest(any_value(nu) - any_value(np), 0)::bigint AS n_upstream, greatest(any_value(np) - any_value(nu), 0)::bigint AS n_port
FROM walk JOIN counted USING (id) WHERE k = least(nu, np) GROUP BY id
"""

_P3 = """
WITH tests AS (SELECT DISTINCT suite, file, class_name, function, discovered_at, removed_at FROM discovered_tests),
 live AS (SELECT * FROM test_mapping WHERE status IN ('mapped', 'partial') AND rust_file IS NOT NULL),
 rust AS (SELECT mapping_id, sync_period, checked_at, 'rust_function' AS ref_field, rust_file, rust_function AS fn FROM live
          UNION ALL SELECT mapping_id, sync_period, checked_at, 'rust_functions', rust_file, unnest(rust_functions) FROM live),
 recorded AS (SELECT checked_at, rust_file || '::' || rust_function AS k FROM test_mapping
              UNION ALL SELECT checked_at, rust_file || '::' || fn FROM (SELECT checked_at, rust_file, unnest(rust_functions) AS fn FROM test_mapping)),
 entries AS (SELECT check_id, sync_period, checked_at, unnest(broken_rust_refs) AS entry FROM mapping_checks),
 found AS (
 SELECT DISTINCT 'test_mapping' AS src_table, sync_period, mapping_id AS row_id, 'python_function' AS ref_field,
   CASE WHEN python_class IS NULL THEN python_file || '::' || python_function ELSE python_file || '::' || python_class || '::' || python_function END AS ref_key
 FROM test_mapping m WHERE python_file IS NOT NULL AND python_function IS NOT NULL AND NOT EXISTS (
   SELECT 1 FROM tests t WHERE t.suite = 'python' AND t.file = m.python_file AND t.function = m.python_function
   AND t.class_name IS NOT DISTINCT FROM m.python_class AND t.discovered_at <= m.checked_at AND (t.removed_at IS NULL OR t.removed_at > m.checked_at))
 UNION
 SELECT DISTINCT 'test_mapping', sync_period, mapping_id, ref_field, rust_file || '::' || fn FROM rust r WHERE fn IS NOT NULL AND NOT EXISTS (
   SELECT 1 FROM tests t WHERE t.suite = 'rust' AND t.file = r.rust_file AND t.function = r.fn
   AND t.discovered_at <= r.checked_at AND (t.removed_at IS NULL OR t.removed_at > r.checked_at))
 UNION
 SELECT DISTINCT 'mapping_checks', sync_period, check_id, 'broken_rust_refs', entry FROM entries e WHERE entry IS NOT NULL AND NOT EXISTS (
   SELECT 1 FROM recorded k WHERE k.k = e.entry AND k.checked_at <= e.checked_at))
"""

_P4 = """
WITH runs AS (SELECT DISTINCT ON (run_id) run_id, project_root, version, exit_code, started_at,
        CASE WHEN regexp_full_match(formatter_fingerprint, '0*[0-9A-Fa-f]{1,16}') THEN ltrim(lower(formatter_fingerprint), '0') END AS fp FROM cache_manifests),
 prev AS (SELECT r.run_id, r.project_root, r.started_at, r.fp, b.run_id AS base, b.version AS v, b.fp AS bfp,
        row_number() OVER (PARTITION BY r.run_id ORDER BY b.started_at DESC NULLS LAST, b.run_id DESC) AS k
        FROM runs r LEFT JOIN runs b ON b.project_root = r.project_root AND b.exit_code = 0 AND b.started_at < r.started_at),
 based AS (SELECT run_id, project_root, started_at, CASE WHEN v = 1 AND fp = bfp THEN base END AS base FROM prev WHERE k = 1),
 state AS (SELECT * FROM (SELECT b.run_id, b.base, f.path, f.content_hash, f.deleted,
        row_number() OVER (PARTITION BY b.run_id, f.path ORDER BY f.modified_at DESC, f.landed_at DESC) AS k
        FROM based b JOIN tree_files f ON f.project_root = b.project_root AND f.landed_at <= b.started_at) WHERE k = 1 AND deleted IS NOT TRUE),
 known AS (SELECT DISTINCT run_id, ltrim(lower(h), '0') AS h FROM (SELECT run_id, unnest(hashes) AS h FROM cache_manifests)
        WHERE regexp_full_match(h, '0*[0-9A-Fa-f]{1,16}')),
 found AS (SELECT DISTINCT s.run_id, s.path FROM state s WHERE NOT EXISTS (
        SELECT 1 FROM known k WHERE k.run_id = s.base AND k.h = CASE WHEN regexp_full_match(s.content_hash, '0*[0-9A-Fa-f]{1,16}') THEN ltrim(lower(s.content_hash), '0') END))
"""

_P3_NOW = """
WITH live AS (SELECT * FROM test_mapping WHERE status IN ('mapped', 'partial') AND rust_file IS NOT NULL),
 tests AS (SELECT suite, file, class_name, function FROM discovered_tests WHERE removed_at IS NULL),
 rust AS (SELECT sync_period, mapping_id, 'rust_function' AS f, checked_at, rust_file, rust_function AS fn FROM live
          UNION ALL SELECT sync_period, mapping_id, 'rust_functions', checked_at, rust_file, unnest(rust_functions) FROM live),
 recorded AS (SELECT rust_file || '::' || rust_function AS k FROM test_mapping
              UNION ALL SELECT rust_file || '::' || fn FROM (SELECT rust_file, unnest(rust_functions) AS fn FROM test_mapping)),
 py AS (SELECT DISTINCT sync_period, mapping_id, checked_at, python_file, python_class, python_function FROM test_mapping WHERE python_file IS NOT NULL AND python_function IS NOT NULL),
 entries AS (SELECT DISTINCT sync_period, check_id, checked_at, entry FROM (SELECT sync_period, check_id, checked_at, unnest(broken_rust_refs) AS entry FROM mapping_checks) WHERE entry IS NOT NULL)
SELECT 'test_mapping' AS src_table, concat_ws('::', python_file, python_class, python_function) AS ref_key, count(*) AS n_refs FROM py p WHERE NOT EXISTS (
   SELECT 1 FROM tests t WHERE t.suite = 'python' AND t.file = p.python_file AND t.function = p.python_function AND t.class_name IS NOT DISTINCT FROM p.python_class)
 GROUP BY python_file, python_class, python_function
UNION ALL
SELECT 'test_mapping', rust_file || '::' || fn, count(*) FROM (SELECT DISTINCT * FROM rust WHERE fn IS NOT NULL) r WHERE NOT EXISTS (
   SELECT 1 FROM tests t WHERE t.suite = 'rust' AND t.file = r.rust_file AND t.function = r.fn) GROUP BY rust_file, fn
UNION ALL
SELECT 'mapping_checks', entry, count(*) FROM entries WHERE entry NOT IN (SELECT k FROM recorded WHERE k IS NOT NULL) GROUP BY entry
"""

_P3_HISTORY = """
WITH tests AS (SELECT DISTINCT suite, file, class_name, function, discovered_at, removed_at, test_id FROM discovered_tests WHERE suite IN ('python', 'rust') AND discovered_at IS NOT NULL AND (removed_at IS NULL OR removed_at > discovered_at)),
 ids AS (SELECT *, CASE suite WHEN 'python' THEN ['py', file, class_name, function] ELSE ['rs', file, function] END AS k FROM tests),
 live AS (SELECT * FROM test_mapping WHERE status IN ('mapped', 'partial') AND rust_file IS NOT NULL),
 refs AS (SELECT DISTINCT 'test_mapping' AS src, ['py', python_file, python_class, python_function] AS k, checked_at, mapping_id AS id, sync_period, 'p' AS f FROM test_mapping WHERE python_file IS NOT NULL AND python_function IS NOT NULL
   UNION SELECT 'test_mapping', ['rs', rust_file, rust_function], checked_at, mapping_id, sync_period, 'r' FROM live WHERE rust_function IS NOT NULL
   UNION SELECT 'test_mapping', ['rs', rust_file, fn], checked_at, mapping_id, sync_period, 'rs' FROM (SELECT *, unnest(rust_functions) AS fn FROM live) WHERE fn IS NOT NULL
   UNION SELECT 'mapping_checks', ['map', e], checked_at, check_id, sync_period, 'b' FROM (SELECT *, unnest(broken_rust_refs) AS e FROM mapping_checks) WHERE e IS NOT NULL),
 moves AS (SELECT src, k, strftime(checked_at, '%Y-%m') AS m, 1 AS r, 0 AS e FROM refs WHERE checked_at IS NOT NULL
   UNION ALL SELECT 'test_mapping', k, strftime(discovered_at, '%Y-%m'), 0, 1 FROM ids
   UNION ALL SELECT 'test_mapping', k, strftime(removed_at, '%Y-%m'), 0, -1 FROM ids WHERE removed_at IS NOT NULL
   UNION ALL SELECT 'mapping_checks', ['map', rust_file || '::' || n], strftime(checked_at, '%Y-%m'), 0, 1 FROM (SELECT rust_file, checked_at, unnest(list_concat([rust_function], coalesce(rust_functions, []))) AS n FROM test_mapping) WHERE n IS NOT NULL AND rust_file IS NOT NULL AND checked_at IS NOT NULL),
 months AS (SELECT DISTINCT src, m FROM moves),
 stands AS (SELECT o.src, o.m, v.k, sum(v.r) AS r, sum(v.e) AS e FROM months o JOIN moves v ON v.src = o.src AND v.m <= o.m GROUP BY ALL)
SELECT src AS src_table, m AS period, count_if(r > 0 AND e <= 0)::bigint AS n_keys FROM stands GROUP BY ALL
"""

ORACLES = {
    "p3_history": _P3_HISTORY,
    "p3_current": _P3_NOW,
    "p1_found": _P1 + "SELECT id, diff FROM found",
    "p1_cost": _P1_COST,
    "p1_summary": _P1 + "SELECT diff, count(*) AS n_ids FROM found GROUP BY diff",
    "p3_found": _P3 + "SELECT * FROM found",
    "p3_report": _P3 + "SELECT src_table, sync_period, ref_field, count(*) AS n_refs, count(DISTINCT row_id) AS n_rows, count(DISTINCT ref_key) AS n_keys FROM found GROUP BY ALL",
    "p4_found": _P4 + "SELECT run_id, path FROM found",
    "p4_work_per_run": _P4 + "SELECT run_id, count(*) AS n_files FROM found GROUP BY run_id",
}
