"""Queries of the formatter's operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumry.formatting.wrap import Wrap
from vellumry.functions import arrow, text
from vellumry.functions.text import NON_WS
from vellumry.operators import documents, manifest, selection
from vellumry.options import FormatOptions, ListSpacing
from vellumry.runtime import running, spread, table
from vellumry.sources.files import Selection

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query, with its SQL where there is one."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def _q(pattern: str) -> str:
    """A pattern as an SQL string."""
    return "'" + pattern.replace("'", "''") + "'"


def _docs(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return spread(table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", "text", *more), "doc_id")


# The patterns of the SQL are written out from the rules; they share nothing with the operators.
SQL_WS = r"[\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SQL_SOLID = SQL_WS.replace("[", "[^", 1)
_LINKS = r"\[[^\]]*\]\([^)]*\)|\[[^\]]*\]\[[^\]]*\]|\[[^\]]*\]"
_TICKS = r"`{4}(?:.|\n)*?`{4}|`{3}(?:.|\n)*?`{3}|`{2}(?:.|\n)+?`{2}|`[^`]+`"
_PAIRED = r"\{%\s*[^/%\s][^%]*%\}\s*\{%\s*/[^%]*%\}|\{#\s*[^/#\s][^#]*#\}\s*\{#\s*/[^#]*#\}|\{\{\s*[^/}\s][^}]*\}\}\s*\{\{\s*/[^}]*\}\}|<!--\s*[^/\s-][^-]*(?:-[^-]+)*-->\s*<!--\s*/[^-]*(?:-[^-]+)*-->"
_SINGLE = r"\{%(?:.|\n)*?%\}|\{#(?:.|\n)*?#\}|\{\{(?:.|\n)*?\}\}|<!--(?:.|\n)*?-->"
SQL_ATOM = "|".join((_TICKS, _LINKS, _PAIRED, _SINGLE, "</?[a-zA-Z][^>]*>"))
SQL_INLINE = "|".join((_TICKS, _LINKS, r"<[A-Za-z][A-Za-z0-9+.-]*:[^\s<>]*>", r"<[^\s<>@]+@[^\s<>]+>", r"(?:http://|https://|www\.)[^\s<>]*[^]\s<>?!.,:;*_~'\")]"))
SQL_JOINED = "regexp_replace(regexp_replace(regexp_replace(replace(text, '--><!--', '--> <!--'), '(%[}])([{]%)', '\\1 \\2', 'g'), '(#[}])([{]#)', '\\1 \\2', 'g'), '([}][}])([{][{])', '\\1 \\2', 'g')"
_STOPS = r"""(?:[.?!]['"’”)]?|['"’”)][.?!])"""
NORM = "rtrim(regexp_replace(CASE WHEN starts_with(text, chr(65279)) THEN substr(text, 2) ELSE text END, '\\r\\n?', chr(10), 'g'), chr(10)) || chr(10)"
FLAT = f"trim(regexp_replace(text, {_q(SQL_WS + '+')}, ' ', 'g'))"
N_DOCS = f"docs AS (SELECT doc_id, kind, lang, source, {NORM} AS text FROM documents WHERE text IS NOT NULL)"
LINES = N_DOCS + ", lines AS (SELECT doc_id, kind, unnest(generate_series(0, len(l) - 1)) AS i, unnest(l) AS line FROM (SELECT doc_id, kind, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM docs))"


# -- sources ---------------------------------------------------------------------------


@query(f"SELECT doc_id, starts_with(text, chr(65279)) AS had_bom, md5({NORM}) AS digest, length({NORM}) AS n_chars FROM documents WHERE text IS NOT NULL")
def normalize_source(spark, d):
    c = text.normalize_source(F.col("text"))
    return _docs(spark, d).select("doc_id", text.has_bom(F.col("text")).alias("had_bom"), F.md5(c.cast("binary")).alias("digest"), F.length(c).cast("bigint").alias("n_chars"))


@query(f"SELECT doc_id, md5(CASE WHEN starts_with(text, chr(65279)) THEN chr(65279) ELSE '' END || {NORM}) AS digest FROM documents WHERE text IS NOT NULL")
def finalize_output(spark, d):
    c = text.finalize_output(F.col("text"), text.has_bom(F.col("text")))
    return _docs(spark, d).select("doc_id", F.md5(c.cast("binary")).alias("digest"))


@query("SELECT kind, count(*) AS n_docs, count_if(kind <> 'spec') AS n_valid FROM documents WHERE text IS NOT NULL GROUP BY kind")
def utf8_verdict(spark, d):
    """Strict decoding; the texts of one kind get a byte that no UTF-8 text has."""
    content = F.when(F.col("kind") == "spec", F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FF")))).otherwise(F.col("text").cast("binary"))
    return _docs(spark, d, "kind").groupBy("kind").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(text.is_utf8(content)).alias("n_valid"))


_OPENED = "CASE WHEN kind = 'spec' THEN chr(10) || ' --- ' || chr(10) || 'open: 1' || chr(10) || replace(text, '---', '- -') ELSE text END"


@query(f"""WITH docs AS (SELECT doc_id, {NORM} AS text FROM (SELECT doc_id, {_OPENED} AS text FROM documents WHERE text IS NOT NULL)),
l AS (SELECT doc_id, text, string_split(text, chr(10)) AS l, list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, {_q(SQL_WS + '+')}, ' ', 'g'))) AS bare FROM docs),
n AS (SELECT *, list_min(list_filter(generate_series(1, len(l)), lambda k: bare[k] <> '')) AS a FROM l),
m AS (SELECT *, list_min(list_filter(generate_series(a + 1, len(l)), lambda k: bare[k] = '---')) AS b FROM n WHERE bare[a] = '---')
SELECT doc_id, CASE WHEN b IS NULL THEN text ELSE array_to_string(l[a:b], chr(10)) || chr(10) END AS front FROM m""")
def front_matter(spark, d):
    """Front matter; documents of one kind get one that never closes."""
    opened = F.when(F.col("kind") == "spec", F.concat(F.lit("\n --- \nopen: 1\n"), F.replace(F.col("text"), F.lit("---"), F.lit("- -")))).otherwise(F.col("text"))
    rows = _docs(spark, d, "kind").select("doc_id", text.front_matter(text.normalize_source(opened)).alias("front"))
    return rows.where("front <> ''")


@query(r"SELECT project, count(*) AS n_files, sum(n_bytes) AS n_bytes FROM (SELECT DISTINCT project, path, n_bytes FROM tree_files) WHERE path LIKE '%.md' AND NOT regexp_matches(path, '(^|/)(vendor|third_party|node_modules|build|dist|target|o[^/]t|coverage|htmlcov|venv|Pods|__pycache__|_darcs|[^/]*\.egg-info|\.(git|hg|svn|bzr|venv|tox|nox|mypy_cache|ruff_cache|pytest_cache|eggs|next|nuxt|output|cache|parcel-cache|turbo|idea|vscode|vs|fleet|coverage|terraform))/') AND coalesce(n_bytes <= 1048576, true) GROUP BY project")
def selected_files(spark, d):
    """File selection over a table of paths: include, excluded folders, size limit."""
    rows = table(spark, d, "tree_files").select("project", "path", "n_bytes").distinct()
    kept = selection.select_paths(rows, Selection(extend_exclude=["o?t/"]), size_col="n_bytes")
    return kept.groupBy("project").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_bytes").alias("n_bytes"))


@query("SELECT DISTINCT project, path FROM tree_files WHERE path LIKE '%.rs' OR path LIKE '%/READM_.md' ORDER BY project, path")
def sorted_paths(spark, d):
    chosen = Selection(include=["*.rs"], extend_include=["READM?.md"], exclude=[])
    return selection.select_paths(table(spark, d, "tree_files"), chosen).select("project", "path").distinct().orderBy("project", "path")


# -- words and sentences ---------------------------------------------------------------

_END = r"(?:^|[^\pL\pM\pN_])\pL+\p{Ll}" + _STOPS + "$"
_SENTENCES = f"""
words AS (SELECT doc_id, lang, unnest(generate_series(0, len(w) - 1)) AS k, unnest(w) AS word FROM (
    SELECT doc_id, lang, list_filter(string_split({FLAT}, ' '), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL)),
ended AS (SELECT *, CASE WHEN regexp_matches(word, {_q(_END)}) THEN 1 ELSE 0 END AS e FROM words),
counted AS (SELECT *, coalesce(sum(e) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::int AS i FROM ended),
sentences AS (SELECT doc_id, any_value(lang) AS lang, i, string_agg(word, ' ' ORDER BY k) AS sentence FROM counted GROUP BY doc_id, i)
"""


@query(f"WITH {_SENTENCES} SELECT doc_id, i, sentence FROM sentences")
def sentences(spark, d):
    return documents.sentences(_docs(spark, d), ["doc_id"])


@query(f"WITH {_SENTENCES} SELECT lang, count(*) AS n_sentences, max(length(sentence))::bigint AS longest FROM sentences GROUP BY lang")
def sentence_counts_by_lang(spark, d):
    rows = documents.sentences(_docs(spark, d, "lang"), ["doc_id", "lang"])
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n_sentences"), F.max(F.length("sentence")).cast("bigint").alias("longest"))


@query(f"WITH {_SENTENCES} SELECT d.doc_id, coalesce(s.sentence, d.text) AS first FROM documents d LEFT JOIN sentences s ON s.doc_id = d.doc_id AND s.i = 0 WHERE d.text IS NOT NULL")
def first_sentence(spark, d):
    return _docs(spark, d).select("doc_id", text.first_sentence(F.col("text")).alias("first"))


@query(f"WITH {_SENTENCES} SELECT doc_id, list(sentence ORDER BY i) AS firsts FROM sentences WHERE i < 3 GROUP BY doc_id")
def first_sentences(spark, d):
    return _docs(spark, d).select("doc_id", text.first_sentences(F.col("text"), 3).alias("firsts")).where(F.size("firsts") > 0)


@query(f"""WITH RECURSIVE {_SENTENCES.replace('sentences AS', 'unused AS')},
sized AS (SELECT doc_id, k, word, e, octet_length(encode(word)) AS n FROM ended),
fold AS (SELECT doc_id, k, word, e, n AS size, 0 AS i, (e = 1 AND n >= 15) AS cut FROM sized WHERE k = 0
  UNION ALL SELECT s.doc_id, s.k, s.word, s.e, CASE WHEN f.cut THEN s.n ELSE f.size + 1 + s.n END, f.i + f.cut::int,
  (s.e = 1 AND CASE WHEN f.cut THEN s.n ELSE f.size + 1 + s.n END >= 15) FROM fold f JOIN sized s ON s.doc_id = f.doc_id AND s.k = f.k + 1)
SELECT doc_id, i, string_agg(word, ' ' ORDER BY k) AS sentence FROM fold GROUP BY doc_id, i""")
def sentences_min_length(spark, d):
    return documents.sentences(_docs(spark, d), ["doc_id"], min_length=15)


_INLINE = "(?:" + SQL_INLINE + "|" + SQL_SOLID + ")+"


@query(f"""WITH words AS (SELECT doc_id, unnest(generate_series(0, len(w) - 1)) AS k, unnest(w) AS word FROM (
    SELECT doc_id, regexp_extract_all(text, {_q(_INLINE)}) AS w FROM documents WHERE text IS NOT NULL)),
ended AS (SELECT *, CASE WHEN regexp_matches(word, {_q(_END)}) THEN 1 ELSE 0 END AS e FROM words),
counted AS (SELECT *, coalesce(sum(e) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::int AS i FROM ended)
SELECT doc_id, i, trim(regexp_replace(string_agg(word, ' ' ORDER BY k), {_q(SQL_WS + '+')}, ' ', 'g')) AS sentence FROM counted GROUP BY doc_id, i""")
def sentences_atomic(spark, d):
    """Sentences never cut inside code, links or addresses; white space collapsed for comparison."""
    rows = documents.sentences(_docs(spark, d), ["doc_id"], atomic=True)
    return rows.select("doc_id", "i", text.collapse(F.col("sentence")).alias("sentence"))


@query(f"SELECT doc_id, unnest(generate_series(0, len(w) - 1))::int AS i, unnest(w) AS word FROM (SELECT doc_id, list_filter(string_split({FLAT}, ' '), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL)")
def words_simple(spark, d):
    return documents.words(_docs(spark, d), ["doc_id"], atomic=False)


_ATOMIC = "(?:" + SQL_ATOM + "|" + SQL_SOLID + ")+"


@query(f"SELECT doc_id, unnest(generate_series(0, len(w) - 1))::int AS i, unnest(w) AS word FROM (SELECT doc_id, regexp_extract_all({SQL_JOINED}, {_q(_ATOMIC)}) AS w FROM documents WHERE text IS NOT NULL)")
def words_atomic(spark, d):
    return documents.words(_docs(spark, d), ["doc_id"], atomic=True)


# -- wrapping --------------------------------------------------------------------------


def _greedy(units: str, width: int) -> str:
    """SQL of greedy wrapping: ``units`` gives (id, k, word) with k from 0 in each id."""
    return f"""WITH RECURSIVE {LINES}, words AS ({units}),
fold AS (SELECT id, k, word, length(word) AS used, 0 AS line FROM words WHERE k = 0
  UNION ALL SELECT w.id, w.k, w.word, CASE WHEN f.used + 1 + length(w.word) <= {width} THEN f.used + 1 + length(w.word) ELSE length(w.word) END,
  f.line + (f.used + 1 + length(w.word) > {width})::int FROM fold f JOIN words w ON w.id = f.id AND w.k = f.k + 1),
wrapped AS (SELECT id, line, string_agg(word, ' ' ORDER BY k) AS text FROM fold GROUP BY id, line)
"""


_BY_LINE = f"SELECT doc_id * 1000000 + i AS id, unnest(generate_series(0, len(w) - 1)) AS k, unnest(w) AS word FROM (SELECT doc_id, i, list_filter(string_split(trim(regexp_replace(line, {_q(SQL_WS + '+')}, ' ', 'g')), ' '), lambda x: x <> '') AS w FROM lines)"
_BY_DOC = f"SELECT doc_id AS id, unnest(generate_series(0, len(w) - 1)) AS k, unnest(w) AS word FROM (SELECT doc_id, list_filter(string_split({FLAT}, ' '), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL)"


@query(_greedy(_BY_LINE, 40) + "SELECT id // 1000000 AS doc_id, (id % 1000000)::int AS i, line::int AS k, text FROM wrapped")
def wrap_width_40_lines(spark, d):
    rows = documents.lines(_docs(spark, d), ["doc_id"]).select("doc_id", "i", arrow.wrapped_lines(F.col("line"), 40).alias("w"))
    return rows.select("doc_id", "i", F.posexplode("w").alias("k", "text"))


@query(_greedy(_BY_DOC, 88) + "SELECT id AS doc_id, count(*) AS n_lines, max(length(text))::bigint AS longest, md5(string_agg(text, chr(10) ORDER BY line)) AS digest FROM wrapped GROUP BY id")
def wrap_width_88_docs(spark, d):
    # The filter is native: one on the lines would be pushed below the repartition and wrap every text twice.
    rows = _docs(spark, d).where(F.col("text").rlike(NON_WS)).select("doc_id", arrow.wrapped_lines(F.col("text"), 88).alias("w"))
    return rows.select("doc_id", F.size("w").cast("bigint").alias("n_lines"), F.array_max(F.transform("w", F.length)).cast("bigint").alias("longest"), F.md5(F.array_join("w", "\n").cast("binary")).alias("digest"))


@query(f"SELECT doc_id, md5({FLAT}) AS digest FROM documents WHERE text IS NOT NULL")
def wrap_width_0(spark, d):
    rows = _docs(spark, d).select("doc_id", arrow.wrapped_lines(F.col("text"), 0).alias("w"))
    return rows.select("doc_id", F.md5(F.array_join("w", "\n").cast("binary")).alias("digest"))


_PARAGRAPHS = f"SELECT doc_id * 100000 + p AS id, unnest(generate_series(0, len(w) - 1)) AS k, unnest(w) AS word FROM (SELECT doc_id, p, list_filter(string_split(trim(regexp_replace(t, {_q(SQL_WS + '+')}, ' ', 'g')), ' '), lambda x: x <> '') AS w FROM (SELECT doc_id, unnest(generate_series(1, len(ps))) AS p, unnest(ps) AS t FROM (SELECT doc_id, string_split_regex(text, '\\n{{2,}}') AS ps FROM docs)))"


@query(_greedy(_PARAGRAPHS, 72) + ", filled AS (SELECT id, replace(replace(replace(replace(string_agg(text, chr(10) ORDER BY line), '}} {{', '}}{{'), '%} {%', '%}{%'), '#} {#', '#}{#'), '--> <!--', '--><!--') AS p FROM wrapped GROUP BY id) SELECT id // 100000 AS doc_id, md5(string_agg(p, chr(10) || chr(10) ORDER BY id)) AS digest FROM filled GROUP BY doc_id")
def fill_paragraphs(spark, d):
    c = text.normalize_source(F.col("text"))
    rows = _docs(spark, d).where(c.rlike(NON_WS)).select("doc_id", arrow.filled(c, 72, plain=True).alias("t"))
    return rows.select("doc_id", F.md5(F.col("t").cast("binary")).alias("digest"))


_STRIPPED = f"trim(regexp_replace(t, {_q(SQL_WS + '+')}, ' ', 'g'))"
_MODES_SQL = f"""WITH RECURSIVE {N_DOCS},
parts AS (SELECT doc_id, kind, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS p, t FROM (SELECT doc_id, kind, p, {_STRIPPED} AS t FROM (
  SELECT doc_id, kind, unnest(generate_series(1, len(ps))) AS p, unnest(ps) AS t FROM (SELECT doc_id, kind, string_split_regex(text, '\\n{{2,}}') AS ps FROM docs))) WHERE t <> ''),
modes AS (SELECT * FROM (VALUES ('wrap_indent', 4, 4), ('hanging_indent', 0, 4), ('markdown_item', 0, 2)) v(mode, head, other)),
laid AS (SELECT mode, doc_id, p, other, CASE WHEN p = 1 THEN head ELSE other END AS head, regexp_extract_all({SQL_JOINED.replace("text", "t")}, {_q("(?:" + SQL_ATOM + "|" + SQL_SOLID + ")+")}) AS w FROM parts, modes),
words AS (SELECT mode, doc_id, p, head, other, unnest(generate_series(0, len(w) - 1)) AS k, unnest(list_transform(w, lambda x: length(x))) AS n FROM laid),
fold AS (SELECT mode, doc_id, p, k, other, n + CASE WHEN head + n <= 72 THEN head ELSE other END AS used, 0 AS line FROM words WHERE k = 0
  UNION ALL SELECT w.mode, w.doc_id, w.p, w.k, w.other, CASE WHEN f.used + 1 + w.n <= 72 THEN f.used + 1 + w.n ELSE w.other + w.n END, f.line + (f.used + 1 + w.n > 72)::int
  FROM fold f JOIN words w ON w.mode = f.mode AND w.doc_id = f.doc_id AND w.p = f.p AND w.k = f.k + 1),
sized AS (SELECT mode, doc_id, p, max(line) + 1 AS n FROM fold GROUP BY ALL),
filled AS (SELECT mode, doc_id, sum(n) + count(*) - 1 AS n FROM sized GROUP BY ALL),
plain AS (SELECT doc_id, kind, length(text) - length(replace(text, chr(10), '')) + 1 AS n FROM docs)
SELECT kind, sum(n) AS "none", sum(coalesce(a, 1)) AS wrap_indent, sum(n) AS indent_only, sum(coalesce(b, 1)) AS hanging_indent, sum(coalesce(c, 1)) AS markdown_item
FROM plain LEFT JOIN (SELECT doc_id, max(n) FILTER (mode = 'wrap_indent') AS a, max(n) FILTER (mode = 'hanging_indent') AS b, max(n) FILTER (mode = 'markdown_item') AS c FROM filled GROUP BY doc_id) USING (doc_id) GROUP BY kind"""


@query(_MODES_SQL)
def fill_modes(spark, d):
    """Lines per mode of plain-text filling."""
    c = text.normalize_source(F.col("text"))
    counts = [F.sum(F.size(F.split(arrow.filled(c, 72, m), "\n"))).alias(m.name.lower()) for m in (Wrap.NONE, Wrap.WRAP_INDENT, Wrap.INDENT_ONLY, Wrap.HANGING_INDENT, Wrap.MARKDOWN_ITEM)]
    return _docs(spark, d, "kind").groupBy("kind").agg(*counts)


_SEMANTIC_SQL = f"""WITH RECURSIVE
flat AS (SELECT doc_id, {FLAT} AS text FROM documents WHERE text IS NOT NULL),
units AS (SELECT doc_id, unnest(generate_series(0, len(u) - 1)) AS k, unnest(u) AS unit FROM (SELECT doc_id, regexp_extract_all(text, {_q("(?:" + SQL_INLINE + "|" + SQL_SOLID + ")+")}) AS u FROM flat)),
ends AS (SELECT *, coalesce(sum(regexp_matches(unit, {_q(r"(?:^|[^\pL\pM\pN_])\pL+\p{Ll}" + _STOPS + "$")})::int) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::int AS s FROM units),
said AS (SELECT doc_id, s, string_agg(unit, ' ' ORDER BY k) AS text FROM ends GROUP BY ALL),
w AS (SELECT doc_id, s, unnest(generate_series(0, len(w) - 1)) AS k, unnest(w) AS word FROM (SELECT doc_id, s, regexp_extract_all({SQL_JOINED}, {_q("(?:" + SQL_ATOM + "|" + SQL_SOLID + ")+")}) AS w FROM said)),
words AS (SELECT doc_id, s, k, word, regexp_replace(regexp_replace(word, '^([0-9]+)([.)])$', '\\1\\\\\\2'), '^([-*+>]|#+)$', '\\\\\\1') AS safe, row_number() OVER (PARTITION BY doc_id ORDER BY s, k) AS pos FROM w),
fold AS (SELECT doc_id, pos, s, word, 0 AS line, 0 AS held, length(word) AS n, 2 + length(word) AS used, 0 AS more FROM words WHERE pos = 1
  UNION ALL SELECT x.doc_id, x.pos, x.s, CASE WHEN x.s = f.s AND f.used + 1 + length(x.word) > 88 THEN x.safe ELSE x.word END,
   CASE WHEN x.s <> f.s THEN 0 WHEN f.used + 1 + length(x.word) <= 88 THEN f.line ELSE f.line + 1 END,
   CASE WHEN x.s = f.s THEN f.held ELSE x.h END,
   CASE WHEN x.s <> f.s THEN length(x.word) WHEN f.used + 1 + length(x.word) <= 88 THEN f.n + 1 + length(x.word) ELSE length(x.safe) END,
   CASE WHEN x.s <> f.s THEN length(x.word) + CASE WHEN 2 + x.h + length(x.word) <= 88 THEN 2 + x.h ELSE 2 END WHEN f.used + 1 + length(x.word) <= 88 THEN f.used + 1 + length(x.word) ELSE 2 + length(x.safe) END,
   CASE WHEN x.s <> f.s THEN length(x.safe) - length(x.word) ELSE f.more END
  FROM fold f JOIN LATERAL (SELECT y.*, CASE WHEN l.len < 20 THEN l.len ELSE 0 END AS h FROM words y, (SELECT CASE WHEN f.line > 0 THEN f.n WHEN f.held > 0 AND f.held + 1 + f.n <= 88 THEN f.held + 1 + f.n ELSE f.n + f.more END AS len) l WHERE y.doc_id = f.doc_id AND y.pos = f.pos + 1) x ON true),
lines AS (SELECT doc_id, s, line, any_value(held) AS held, string_agg(word, ' ' ORDER BY pos) AS text FROM fold GROUP BY ALL),
joined AS (SELECT *, line = 0 AND held > 0 AND held + 1 + length(text) <= 88 AS joins FROM lines),
ready AS (SELECT doc_id, s, line, joins, CASE WHEN line = 0 AND s > 0 AND NOT joins THEN regexp_replace(regexp_replace(text, '^([0-9]+)([.)])( |$)', '\\1\\\\\\2\\3'), '^([-*+>]|#+)( |$)', '\\\\\\1\\2') ELSE text END AS text FROM joined),
whole AS (SELECT doc_id, string_agg(CASE WHEN joins THEN ' ' WHEN s = 0 AND line = 0 THEN '> ' ELSE chr(10) || '> ' END || text, '' ORDER BY s, line) AS text FROM ready GROUP BY doc_id),
tight AS (SELECT doc_id, replace(replace(replace(replace(text, '%}} {{%', '%}}{{%'), '#}} {{#', '#}}{{#'), '}}}} {{{{', '}}}}{{{{'), '--> <!--', '--><!--') AS text FROM whole)
SELECT doc_id, coalesce(t, '') AS wrapped FROM flat LEFT JOIN (SELECT doc_id, text AS t FROM tight) USING (doc_id)"""


@query(_SEMANTIC_SQL)
def semantic_wrap(spark, d):
    return _docs(spark, d).select("doc_id", arrow.semantic_lines(text.collapse(F.col("text")), 88, "> ", "> ").alias("wrapped"))


@query(f"WITH {N_DOCS} SELECT doc_id, len(string_split_regex(text, '\\\\\\n|  +\\n')) - 1 AS n_breaks, md5(array_to_string(string_split_regex(text, '\\\\\\n|  +\\n'), '\\' || chr(10))) AS digest FROM docs")
def hard_breaks(spark, d):
    pieces = text.hard_break_pieces(text.normalize_source(F.col("text")))
    return _docs(spark, d).select("doc_id", (F.size(pieces) - 1).cast("bigint").alias("n_breaks"), F.md5(F.array_join(pieces, "\\\n").cast("binary")).alias("digest"))


# -- lines -----------------------------------------------------------------------------

_KIND = f"""CASE WHEN trim(regexp_replace(line, {_q(SQL_WS + '+')}, ' ', 'g')) = '' THEN 'blank'
 WHEN regexp_matches(line, '^ {{0,3}}(?:`{{3,}}[^`]*|~{{3,}}.*)$') THEN 'fence'
 WHEN regexp_matches(line, '^ {{0,3}}[*_-]') AND regexp_matches(regexp_replace(line, '[ \\t]+', '', 'g'), '^(?:\\*{{3,}}|-{{3,}}|_{{3,}})$') THEN 'break'
 WHEN regexp_matches(line, '^ {{0,3}}#{{1,6}}(?:[ \\t]|$)') THEN 'heading'
 WHEN regexp_matches(line, {_q(f'^{SQL_WS}*[|](?:{SQL_WS}*:?-+:?{SQL_WS}*[|])+{SQL_WS}*$')}) THEN 'separator'
 WHEN regexp_matches(line, {_q(f'^{SQL_WS}*[|]')}) THEN 'table'
 WHEN regexp_matches(line, {_q(f'^{SQL_WS}*(?:[-*+]|[0-9]{{1,9}}[.)])[ ' + chr(92) + 't]')}) THEN 'list'
 WHEN regexp_matches(line, {_q('(?s)^(?:[{]%|[{]#|[{][{]|<!--).*(?:%[}]|#[}]|[}][}]|-->)' + SQL_WS + '*$')}) THEN 'tag' ELSE 'text' END"""


@query(f"WITH {LINES} SELECT kind AS doc_kind, {_KIND} AS kind, count(*) AS n_lines FROM lines GROUP BY ALL")
def line_classification(spark, d):
    rows = documents.lines(_docs(spark, d, F.col("kind").alias("doc_kind")), ["doc_id", "doc_kind"])
    return rows.groupBy("doc_kind", "kind").agg(F.count(F.lit(1)).alias("n_lines"))


@query(f"""WITH {LINES}, rules AS (SELECT DISTINCT line FROM lines WHERE {_KIND} = 'separator')
SELECT line, '| ' || array_to_string(list_transform(string_split(regexp_replace(regexp_replace(line, {_q(f'^{SQL_WS}*[|]')}, ''), {_q(f'[|]{SQL_WS}*$')}, ''), '|'),
 lambda x: (CASE WHEN starts_with(trim(x), ':') THEN ':' ELSE '' END) || '---' || (CASE WHEN ends_with(trim(x), ':') THEN ':' ELSE '' END)), ' | ') || ' |' AS normal FROM rules""")
def table_separator_normalize(spark, d):
    rows = documents.lines(_docs(spark, d), ["doc_id"]).where("kind = 'separator'").select("line").distinct()
    return rows.select("line", text.separator_row(F.col("line")).alias("normal"))


@query(f"""WITH {LINES}, w AS (SELECT DISTINCT regexp_extract(line, {_q(SQL_SOLID + '+')}) AS word FROM lines)
SELECT word, regexp_replace(regexp_replace(word, '^([0-9]+)([.)])$', '\\1\\\\\\2'), '^([-*+>]|#+)$', '\\\\\\1') AS escaped FROM w WHERE word <> ''""")
def escape_line_start(spark, d):
    rows = documents.lines(_docs(spark, d), ["doc_id"]).select(F.regexp_extract("line", f"{NON_WS}+", 0).alias("word")).where("word <> ''").distinct()
    return rows.select("word", text.escape_word(F.col("word")).alias("escaped"))


_TIGHT = "replace(replace(text, '}} {{', '}}{{'), '%} {%', '%}{%')"


@query("WITH t AS (SELECT doc_id, " + _TIGHT + " AS text FROM documents WHERE text IS NOT NULL) SELECT doc_id, md5(" + SQL_JOINED + """) AS joined,
md5(replace(replace(replace(replace(text, '%} {%', '%}{%'), '#} {#', '#}{#'), '}} {{', '}}{{'), '--> <!--', '--><!--')) AS split, length(""" + SQL_JOINED + ") - length(text) AS n FROM t")
def adjacent_tags(spark, d):
    """One space between adjacent tags, and its removal."""
    tight = F.replace(F.replace(F.col("text"), F.lit("}} {{"), F.lit("}}{{")), F.lit("%} {%"), F.lit("%}{%"))
    rows = _docs(spark, d).select("doc_id", tight.alias("text"), text.join_adjacent(tight).alias("j"), text.split_adjacent(text.join_adjacent(tight)).alias("s"))
    return rows.select("doc_id", F.md5(F.col("j").cast("binary")).alias("joined"), F.md5(F.col("s").cast("binary")).alias("split"), (F.length("j") - F.length("text")).cast("bigint").alias("n"))


_GAPS = "replace(text, chr(10) || chr(10), chr(10) || chr(10) || chr(10))"


@query(f"""WITH RECURSIVE {LINES.replace(NORM + " AS text", NORM.replace("text", _GAPS) + " AS text")},
marked AS (SELECT doc_id, i, line, regexp_extract(line, '^[ ]*(?:[-*+>] +|[0-9]+[.)] +)*(`{{3,}}|~{{3,}})', 1) AS mark FROM lines),
walk AS (SELECT doc_id, i, line, mark AS fence, mark <> '' AS opaque FROM marked WHERE i = 0
  UNION ALL SELECT m.doc_id, m.i, m.line, CASE WHEN w.fence = '' THEN m.mark WHEN m.mark <> '' AND left(m.mark, 1) = left(w.fence, 1) AND length(m.mark) >= length(w.fence) AND regexp_matches(m.line, '[`~] *$') THEN '' ELSE w.fence END,
  w.fence <> '' OR m.mark <> '' FROM walk w JOIN marked m ON m.doc_id = w.doc_id AND m.i = w.i + 1),
b AS (SELECT *, NOT opaque AND trim(regexp_replace(line, {_q(SQL_WS + '+')}, ' ', 'g')) = '' AS blank FROM walk),
c AS (SELECT *, lag(blank) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM b)
SELECT doc_id, count(*) AS n_lines, count_if(blank) AS n_blank FROM c WHERE NOT (blank AND coalesce(before, false)) GROUP BY doc_id""")
def collapse_blank_lines(spark, d):
    """Every gap doubled, then blank runs outside code collapsed."""
    wide = F.replace(F.col("text"), F.lit("\n\n"), F.lit("\n\n\n"))
    rows = documents.collapse_blank_lines(_docs(spark, d).withColumn("text", wide))
    c = F.col("text")
    lines, opaque = text.lines(c), arrow.opaque_flags(c)
    return rows.select("doc_id", lines.alias("l"), opaque.alias("o")).select(
        "doc_id", F.size("l").cast("bigint").alias("n_lines"), F.size(F.filter(F.arrays_zip("l", "o"), lambda x: ~x["o"] & (text.collapse(x["l"]) == ""))).cast("bigint").alias("n_blank"))


@query(f"""WITH {LINES}, o AS (SELECT doc_id, i, line, regexp_matches(line, '^[0-9]{{1,9}}[.)][ \\t]+[A-Za-z]') AS item FROM lines),
g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o WHERE item),
n AS (SELECT *, first_value(regexp_extract(line, '^[0-9]+')::bigint) OVER w + row_number() OVER w - 1 AS n, first_value(i) OVER w AS first FROM g WINDOW w AS (PARTITION BY doc_id, run ORDER BY i))
SELECT doc_id, string_agg(n || '. ' || regexp_replace(line, '^[0-9]{{1,9}}[.)][ \\t]', ''), chr(10) ORDER BY i) AS items FROM n GROUP BY doc_id, first""")
def ordered_list_renumber(spark, d):
    """Items of an ordered list counted on from the first number; the delimiter is a stop."""
    runs = F.regexp_extract_all(text.normalize_source(F.col("text")), F.lit(r"(?m)^((?:[0-9]{1,9}[.)][ \t]+[A-Za-z][^\n]*\n)+)"), 1)
    rows = documents.renumber_lists(_docs(spark, d).select("doc_id", F.explode(runs).alias("text")))
    return rows.select("doc_id", F.regexp_replace("text", r"\n\z", "").alias("items"))


@query(f"""WITH {LINES} SELECT doc_id, i::int AS i, regexp_replace(regexp_replace(line, '^( {{0,3}}#{{1,6}}[ \\t]+)\\*\\*\\*([^*]+)\\*\\*\\*[ \\t]*$', '\\1*\\2*'), '^( {{0,3}}#{{1,6}}[ \\t]+)\\*\\*([^*]+)\\*\\*[ \\t]*$', '\\1\\2') AS line
FROM (SELECT doc_id, i, regexp_replace(line, '^(#{{1,6}} )(.*)$', '\\1**\\2**') AS line FROM lines WHERE regexp_matches(line, '^#{{1,6}} '))""")
def unbold_headings(spark, d):
    """Every heading made bold, then cleaned up."""
    rows = documents.lines(_docs(spark, d), ["doc_id"]).where(F.col("line").rlike(r"\A#{1,6} "))
    return rows.select("doc_id", "i", text.unbold_heading(F.regexp_replace("line", r"\A(#{1,6} )(.*)\z", "$1**$2**")).alias("line"))


# -- typography ------------------------------------------------------------------------


def _curled() -> str:
    """SQL of smart quotes for the text ``x`` between template tags: pairs in four rounds, then apostrophes."""
    ws, word = SQL_WS[1:-1], r"[\pL\pN_]"
    line = rf"\n[\t ]*[^{ws}QU]"  # a line end before a line that is not blank
    sql = "x"
    for _ in range(4):
        for straight, left, right in (('"', "“", "”"), ("'", "‘", "’")):
            inner = f"(?:[^{straight}{left}{right}\\n]|{line})*".replace("QU", straight + left + right)
            pattern = rf"(^|[{ws}—]){straight}({inner}){straight}([{ws}.,;:?!—)]|$)"
            sql = f"regexp_replace({sql}, {_q(pattern)}, '\\1{left}\\2{right}\\3', 'g')"
    for _ in range(2):
        for pattern in (rf"(^|[{ws}])([^{ws}']*{word})'({word}[^{ws}']*)([{ws}]|$)", rf"(^|[{ws}])({word}*[sS])'()([{ws}]|$)"):
            sql = f"regexp_replace({sql}, {_q(pattern)}, '\\1\\2’\\3\\4', 'g')"
    return sql


_QUOTES_SQL = f"""WITH cut AS (SELECT doc_id, string_split_regex(text, {_q(_SINGLE)}) AS segs, regexp_extract_all(text, {_q(_SINGLE)}) AS tags FROM documents WHERE text IS NOT NULL),
new AS (SELECT doc_id, tags, list_transform(segs, lambda x: {_curled()}) AS segs FROM cut),
done AS (SELECT doc_id, array_to_string(list_transform(generate_series(1, len(segs)), lambda k: segs[k] || coalesce(tags[k], '')), '') AS new FROM new)
SELECT doc_id, md5(new) AS digest, len(regexp_extract_all(new, '[“”‘’]'))::bigint AS n_marks FROM done"""


@query(_QUOTES_SQL)
def smart_quotes(spark, d):
    rows = _docs(spark, d).select("doc_id", "text", arrow.smart_quotes(F.col("text")).alias("new"))
    return rows.select("doc_id", F.md5(F.col("new").cast("binary")).alias("digest"), F.size(F.regexp_extract_all("new", F.lit("[“”‘’]"), 0)).cast("bigint").alias("n_marks"))


@query(f"SELECT DISTINCT word, replace(word, '''', '’') AS new FROM (SELECT unnest(string_split({FLAT}, ' ')) AS word FROM documents) WHERE regexp_matches(word, '[\\pL\\pM\\pN_]''[\\pL\\pM\\pN_]') AND length(word) - length(replace(word, '''', '')) = 1 AND NOT contains(word, '\"')")
def apostrophes(spark, d):
    """Words with one apostrophe between word characters."""
    rows = _docs(spark, d).select(F.explode(F.split(text.collapse(F.col("text")), " ")).alias("word")).distinct()
    one = rows.where(F.col("word").rlike(f"{text.WORD}'{text.WORD}") & (F.length("word") - F.length(F.replace("word", F.lit("'"), F.lit(""))) == 1) & ~F.col("word").contains('"'))
    return one.select("word", arrow.smart_quotes(F.col("word")).alias("new"))


_ELLIPSES_SQL = f"""WITH cut AS (SELECT doc_id, string_split_regex(text, '\\.{{3,}}') AS segs, regexp_extract_all(text, '\\.{{3,}}') AS runs FROM documents WHERE text IS NOT NULL),
runs AS (SELECT doc_id, k, len(runs) AS n, segs[k] AS prev, segs[k + 1] AS next, length(runs[k]) AS dots FROM (SELECT *, unnest(generate_series(1, len(runs))) AS k FROM cut)),
a AS (SELECT *, regexp_replace(prev, {_q(SQL_WS + '+$')}, '') AS core FROM runs),
b AS (SELECT *, substr(prev, length(core) + 1) AS tail, right(core, 1) AS c, CASE WHEN dots = 4 THEN '.' WHEN dots = 3 THEN regexp_extract(next, '^[,;:?!)—"''‘’“”-]') ELSE '' END AS mark FROM a),
e AS (SELECT *, regexp_matches(c, '[\\pL\\pN_]') AS word, regexp_matches(c, '["''‘’“”]') AS quote, CASE WHEN dots = 4 THEN next ELSE substr(next, length(mark) + 1) END AS rest FROM b),
f AS (SELECT *, CASE WHEN word OR quote THEN tail WHEN core = '' AND k = 1 THEN tail WHEN contains(tail, chr(10)) THEN substr(tail, strpos(tail, chr(10)) + 1) END AS gap, regexp_extract(rest, {_q('^' + SQL_WS + '*')}) AS ws FROM e),
g AS (SELECT *, CASE WHEN length(rest) > length(ws) THEN substr(rest, length(ws) + 1, 1) WHEN k < n THEN '.' ELSE '' END AS behind FROM f),
h AS (SELECT *, dots < 5 AND gap IS NOT NULL AND (behind = '' OR regexp_matches(behind, '[\\pL\\pN_,:;?!)—"''”’>-]')) AS good FROM g),
j AS (SELECT *, CASE WHEN good THEN length(gap) ELSE 0 END AS off_end, CASE WHEN good THEN length(ws) + CASE WHEN dots = 3 THEN length(mark) ELSE 0 END ELSE 0 END AS off_start,
  CASE WHEN good THEN CASE WHEN gap = '' AND word THEN ' ' ELSE gap END || '…' || mark || CASE WHEN ws = '' AND mark = '' AND regexp_matches(behind, '[\\pL\\pN_]') THEN ' ' ELSE ws END ELSE repeat('.', dots) END AS new FROM h),
m AS (SELECT *, lag(off_start, 1, 0) OVER (PARTITION BY doc_id ORDER BY k) AS from_left FROM j),
done AS (SELECT doc_id, string_agg(substr(prev, from_left + 1, length(prev) - from_left - off_end) || new, '' ORDER BY k) || max(CASE WHEN k = n THEN substr(next, off_start + 1) END) AS new FROM m GROUP BY doc_id)
SELECT d.doc_id, md5(coalesce(e.new, d.text)) AS digest, length(coalesce(e.new, d.text)) - length(replace(coalesce(e.new, d.text), '…', '')) AS n_marks FROM documents d LEFT JOIN done e USING (doc_id) WHERE d.text IS NOT NULL"""


@query(_ELLIPSES_SQL)
def ellipses(spark, d):
    rows = _docs(spark, d).select("doc_id", arrow.ellipses(F.col("text")).alias("new"))
    return rows.select("doc_id", F.md5(F.col("new").cast("binary")).alias("digest"), F.size(F.regexp_extract_all("new", F.lit("…"), 0)).cast("bigint").alias("n_marks"))


# -- joins, intervals, manifest ----------------------------------------------------------

_DEF = r"^ {0,3}\[([^\[\]^][^\[\]]*)\]:[ \t]*(\S+)(?:[ \t].*)?$"


_LINKED = "replace(text, '[the guide](', '[The Guide][Guide] (') || CASE WHEN kind = 'spec' THEN '' ELSE chr(10) || chr(10) || '[guide]: https://old.example/' || chr(10) || '[GUIDE]: https://new.example/' || doc_id END"


@query(f"""WITH {LINES.replace(N_DOCS, N_DOCS.replace(f"{NORM} AS text", f"{NORM.replace('text', 'linked')} AS text").replace("FROM documents", f"FROM (SELECT *, {_LINKED} AS linked FROM documents)"))},
defs AS (SELECT doc_id, lower(regexp_extract(line, {_q(_DEF)}, 1)) AS label, arg_max(regexp_extract(line, {_q(_DEF)}, 2), i) AS url FROM lines WHERE regexp_matches(line, {_q(_DEF)}) GROUP BY ALL),
used AS (SELECT doc_id, lower(l) AS label, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(line, '\\[[^\\[\\]\\n]+\\]\\[([^\\[\\]\\n]+)\\]', 1)) AS l FROM lines WHERE NOT regexp_matches(line, {_q(_DEF)})) GROUP BY ALL)
SELECT doc_id, label, url, n FROM used LEFT JOIN defs USING (doc_id, label)""")
def reference_resolution(spark, d):
    """Inline links turned into reference links, with definitions in all but one kind."""
    more = F.concat(F.lit("\n\n[guide]: https://old.example/\n[GUIDE]: https://new.example/"), F.col("doc_id").cast("string"))
    linked = F.concat(F.replace(F.col("text"), F.lit("[the guide]("), F.lit("[The Guide][Guide] (")), F.when(F.col("kind") == "spec", "").otherwise(more))
    return documents.references(_docs(spark, d, "kind").withColumn("text", linked), ["doc_id"])


def _intervals(spark: SparkSession, d: str) -> DataFrame:
    """Regions of a batch laid end to end; every region begins before its forerunner ends."""
    rows = table(spark, d, "inline_regions").select("region_id", "batch_id", "idx", "kind", F.coalesce(F.length("source"), F.lit(0)).cast("bigint").alias("n")).distinct()
    rows = running(rows.withColumn("idx", F.col("idx").cast("bigint")), ["batch_id"], "idx", F.col("n"), "sum", "upto", ties=[F.col("region_id")], bucket_us=1 << 12)
    start = F.floor((F.col("upto") - F.col("n")) / 2)
    return rows.withColumn("start", start.cast("bigint")).withColumn("end", F.col("start") + F.col("n")).drop("n", "idx", "upto")


_INTERVALS = """cut AS (SELECT DISTINCT region_id, batch_id, idx, kind, coalesce(length(source), 0) AS n FROM inline_regions),
placed AS (SELECT region_id, batch_id, kind, coalesce(sum(n) OVER (PARTITION BY batch_id ORDER BY idx, region_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint // 2 AS s, n FROM cut)"""


@query(f"WITH {_INTERVALS} SELECT region_id, batch_id FROM placed l WHERE kind = 'wikilink' AND EXISTS (SELECT 1 FROM placed r WHERE r.batch_id = l.batch_id AND r.kind = 'code_span' AND r.n > 0 AND l.s < r.s + r.n AND r.s < l.s + l.n)")
def region_overlap_join(spark, d):
    rows = _intervals(spark, d)
    return documents.covered(rows.where("kind = 'wikilink'"), rows.where("kind = 'code_span'"), "batch_id").select("region_id", "batch_id")


@query(f"WITH {_INTERVALS} SELECT batch_id, s AS start, region_id FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, s ORDER BY CASE kind WHEN 'code_span' THEN 20 ELSE 99 END, -n, kind, region_id) AS k FROM placed) WHERE k = 1")
def region_arbitration(spark, d):
    rows = _intervals(spark, d)
    return documents.arbitrate(rows, ["batch_id"], ties=["region_id"]).select("batch_id", "start", "region_id")


_MARK = "fm AS (SELECT DISTINCT h FROM (SELECT unnest(hashes) AS h FROM cache_manifests WHERE version = 1))"


@query(f"WITH {_MARK} SELECT DISTINCT project, content_hash FROM tree_files WHERE content_hash IS NOT NULL AND content_hash NOT IN (SELECT h FROM fm WHERE h IS NOT NULL)")
def unformatted_anti_join(spark, d):
    docs = table(spark, d, "tree_files").where("content_hash is not null").select("project", "content_hash").distinct()
    return manifest.unformatted(docs, _manifest(spark, d), "x").select("project", "content_hash")


@query(f"WITH {_MARK} SELECT DISTINCT project, content_hash FROM tree_files WHERE content_hash IN (SELECT h FROM fm)")
def known_formatted_semi_join(spark, d):
    docs = table(spark, d, "tree_files").where("content_hash is not null").select("project", "content_hash").distinct()
    return manifest.known(docs, _manifest(spark, d), "x").select("project", "content_hash")


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "cache_manifests").where("version = 1").select("project", F.explode("hashes").alias("content_hash")).where("content_hash is not null")
    return rows.select("project", F.lit("x").alias("fingerprint"), "content_hash")


@query("SELECT project, count(*) AS n FROM (SELECT project, unnest(hashes) AS h FROM cache_manifests WHERE version = 1 UNION SELECT project, content_hash FROM tree_files) WHERE h IS NOT NULL GROUP BY project")
def manifest_union(spark, d):
    fresh = table(spark, d, "tree_files").where("content_hash is not null").select("project", F.lit("x").alias("fingerprint"), "content_hash")
    return manifest.merged(_manifest(spark, d), fresh).groupBy("project").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_MARK}, seen AS (SELECT project, content_hash IN (SELECT h FROM fm WHERE h IS NOT NULL) AS hit FROM tree_files), n AS (SELECT project, count_if(hit) AS hits, count(*) - count_if(hit) AS misses FROM seen GROUP BY project) SELECT project, hits, misses, printf('%.1f', round(hits * 100.0::DECIMAL(18, 4) / (hits + misses), 1)) || '%' AS rate FROM n")
def cache_hits(spark, d):
    """Hits, misses and hit rate of each project's file versions."""
    return manifest.hit_counts(table(spark, d, "tree_files"), _manifest(spark, d), "x", ["project"])


@query("SELECT kind, count(*) AS n_docs, sum(length(text))::bigint AS n_chars, true AS timed FROM documents WHERE text IS NOT NULL GROUP BY kind")
def stage_timings(spark, d):
    """Documents and characters per kind; ``timed``: each stage of each document took time."""
    rows = documents.format_metrics(_docs(spark, d, "kind"), options=FormatOptions.auto())
    good = (F.col("parse_us") >= 0) & (F.col("render_us") >= 0) & (F.col("parse_us") + F.col("render_us") > 0)
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"), F.bool_and(good).alias("timed"))


@query("SELECT lower(hex(encode(lower(path)))) AS code, lower(path) AS label FROM (SELECT DISTINCT path FROM documents WHERE path IS NOT NULL)")
def label_codec(spark, d):
    rows = table(spark, d, "documents").where("path is not null").select("path").distinct()
    code = text.label_code(F.col("path"))
    return rows.select(code.alias("code"), text.label_decode(code).alias("label"))


@query("SELECT kind, count(*) AS n_docs, sum(length(text)) AS n_chars, count_if(contains(text, '`')) AS n_with_code, max(greatest(3, coalesce(list_max(list_transform(regexp_extract_all(text, '`+'), lambda x: length(x))), 0) + 1))::int AS fence FROM documents WHERE text IS NOT NULL GROUP BY kind")
def format_stats(spark, d):
    """Sums and counts per kind, and the longest fence that a document's code would need."""
    rows = _docs(spark, d, "kind").withColumn("f", text.fence_length(F.col("text"), F.lit(0)))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("text")).alias("n_chars"), F.count_if(F.col("text").contains("`")).alias("n_with_code"), F.max("f").alias("fence"))


# -- structure and whole documents --------------------------------------------------------


@query()
def block_tree(spark, d):
    return documents.blocks(_docs(spark, d), ["doc_id"])


# Lines with the state of fenced code: an opening mark, then lines up to one that closes it.
_FENCED = f"""WITH RECURSIVE {LINES},
marked AS (SELECT doc_id, i, line, regexp_extract(line, '^[ ]*(?:[-*+>] +|[0-9]+[.)] +)*(`{{3,}}|~{{3,}})', 1) AS mark FROM lines),
walk AS (SELECT doc_id, i, line, mark AS fence, mark <> '' AS opaque, mark <> '' AS opens FROM marked WHERE i = 0
  UNION ALL SELECT m.doc_id, m.i, m.line, CASE WHEN w.fence = '' THEN m.mark WHEN m.mark <> '' AND left(m.mark, 1) = left(w.fence, 1) AND length(m.mark) >= length(w.fence) AND regexp_matches(m.line, '[`~] *$') THEN '' ELSE w.fence END,
  w.fence <> '' OR m.mark <> '', w.fence = '' AND m.mark <> '' FROM walk w JOIN marked m ON m.doc_id = w.doc_id AND m.i = w.i + 1),
fronts AS (SELECT doc_id, min(i) AS last FROM lines l WHERE i > 0 AND line IN ('---', '...') AND EXISTS (SELECT 1 FROM lines f WHERE f.doc_id = l.doc_id AND f.i = 0 AND f.line = '---') GROUP BY doc_id),
state AS (SELECT w.*, coalesce(w.i <= f.last, false) AS front FROM walk w LEFT JOIN fronts f USING (doc_id)),
solid AS (SELECT *, lag(i, 1, -2) OVER (PARTITION BY doc_id ORDER BY i) AS i_before, lag(line, 1, '') OVER (PARTITION BY doc_id ORDER BY i) AS before FROM state WHERE trim(line, chr(9) || ' ') <> ''),
indented AS (SELECT doc_id, i FROM solid WHERE NOT opaque AND NOT front AND i > i_before + 1 AND regexp_matches(line, '^(    |\\t)') AND NOT regexp_matches(before, '^( *[-*+] | *[0-9]+[.)] |  +|\\t)'))
"""


@query(_FENCED + """SELECT doc_id, CASE WHEN opens THEN 'code' ELSE 'heading' END AS kind, i::int AS start_line FROM state WHERE NOT front AND (opens OR NOT opaque AND regexp_matches(line, '^ {0,3}#{1,6}([ \t]|$)')) UNION ALL SELECT doc_id, 'code', i::int FROM indented""")
def outline(spark, d):
    """Headings and code of every document, where they begin."""
    rows = documents.blocks(_docs(spark, d), ["doc_id"]).where("depth = 0 AND kind = 'heading' OR kind = 'code'")
    return rows.select("doc_id", "kind", "start_line")


@query(_FENCED + """, runs AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM state WHERE NOT opaque AND NOT front AND regexp_matches(line, '^(    |\\t)') AND trim(line, chr(9) || ' ') <> ''),
code AS (SELECT doc_id, unnest(generate_series(first, last)) AS i FROM (SELECT doc_id, run, min(i) AS first, max(i) AS last FROM runs GROUP BY ALL) JOIN indented n USING (doc_id) WHERE n.i = first)
SELECT s.doc_id, count(*)::int AS n_lines, count_if(s.opaque OR s.front OR c.i IS NOT NULL)::int AS n_opaque FROM state s LEFT JOIN code c ON c.doc_id = s.doc_id AND c.i = s.i GROUP BY s.doc_id""")
def opaque_lines(spark, d):
    c = arrow.opaque_flags(text.normalize_source(F.col("text")))
    return _docs(spark, d).select("doc_id", c.alias("f")).select("doc_id", F.size("f").alias("n_lines"), F.size(F.filter("f", lambda x: x)).alias("n_opaque"))


@query()
def protected_regions(spark, d):
    return documents.regions(_docs(spark, d), ["doc_id"])


@query(r"SELECT kind, count(*) AS n_docs, count_if(regexp_matches(text, '[`$<{\\]|\[\[|\[!|\[(cadence|contact|epic|feature_flag|issue|vulnerability|wiki_page|work_item):|:::|>>>|\+[-=:]|--') OR regexp_matches(chr(10) || text, '\n(\+\+\+|[ >\t]*\||[ >\t]*([-*+] +|[0-9]+[.)] +)*[:~|][ \t])')) AS n_admitted FROM (SELECT kind, regexp_replace(text, '\r\n?', chr(10), 'g') AS text FROM documents WHERE text IS NOT NULL) GROUP BY kind")
def regions_admission(spark, d):
    """Documents that may hold protected regions; the others are never searched."""
    may = text.may_hold_regions(text.normalize_source(F.col("text")))
    return _docs(spark, d, "kind").groupBy("kind").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(may).alias("n_admitted"))


@query()
def regions_per_kind(spark, d):
    return documents.regions(_docs(spark, d), ["doc_id"]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def _formatted(spark: SparkSession, d: str, options: FormatOptions, *more: str) -> DataFrame:
    return documents.format_documents(_docs(spark, d, *more), options=options)


@query()
def format_markdown(spark, d):
    return _formatted(spark, d, FormatOptions()).select("doc_id", "formatted", "changed")


@query()
def format_markdown_auto(spark, d):
    return _formatted(spark, d, FormatOptions.auto()).select("doc_id", "formatted", "changed")


@query()
def format_markdown_tight(spark, d):
    return _formatted(spark, d, FormatOptions(list_spacing=ListSpacing.TIGHT)).select("doc_id", "formatted")


@query()
def format_markdown_loose(spark, d):
    return _formatted(spark, d, FormatOptions(list_spacing=ListSpacing.LOOSE)).select("doc_id", "formatted")


_ATOMIC_PARTS = f"""SELECT doc_id * 100000 + p AS id, unnest(generate_series(0, len(w) - 1)) AS k, unnest(w) AS word FROM (SELECT doc_id, p, regexp_extract_all({SQL_JOINED.replace("text", "t")}, {_q("(?:" + SQL_ATOM + "|" + SQL_SOLID + ")+")}) AS w FROM (
 SELECT doc_id, p, {_STRIPPED} AS t FROM (SELECT doc_id, unnest(generate_series(1, len(ps))) AS p, unnest(ps) AS t FROM (SELECT doc_id, string_split_regex(text, '\\n{{2,}}') AS ps FROM documents WHERE text IS NOT NULL))) WHERE t <> '')"""


@query(_greedy(_ATOMIC_PARTS, 80) + """, filled AS (SELECT id, replace(replace(replace(replace(string_agg(text, chr(10) ORDER BY line), '}} {{', '}}{{'), '%} {%', '%}{%'), '#} {#', '#}{#'), '--> <!--', '--><!--') AS p FROM wrapped GROUP BY id),
whole AS (SELECT id // 100000 AS doc_id, string_agg(p, chr(10) || chr(10) ORDER BY id) AS formatted FROM filled GROUP BY 1) SELECT d.doc_id, coalesce(w.formatted, '') AS formatted FROM documents d LEFT JOIN whole w USING (doc_id) WHERE d.text IS NOT NULL""")
def format_plaintext(spark, d):
    return _formatted(spark, d, FormatOptions(plaintext=True, width=80)).select("doc_id", "formatted")


@query()
def would_change_by_source(spark, d):
    return documents.would_change(_formatted(spark, d, FormatOptions.auto(), "source"), ["source"])


@query("SELECT n_name AS name, '| id | name |' || chr(10) || '| ---: | --- |' || chr(10) || '| ' || n_nationkey || ' | ' || n_name || ' |' || chr(10) AS formatted FROM nation")
def gfm_table_from_nation(spark, d):
    """A ragged table per nation, rendered in normal form."""
    rows = table(spark, d, "nation")
    ragged = F.concat(F.lit("|id|   name|\n|----:|:-----|\n|"), F.col("n_nationkey").cast("string"), F.lit("  |"), F.col("n_name"), F.lit("|"))
    ragged = F.replace(ragged, F.lit(":-----"), F.lit("------"))
    done = documents.format_documents(rows.select(F.col("n_name").alias("name"), ragged.alias("text")))
    return done.select("name", "formatted")


@query("SELECT NULL::BIGINT AS doc_id, NULL::VARCHAR AS mode WHERE false")
def idempotence_ledger(spark, d):
    """Documents whose second formatting differs from the first, by mode."""
    out = None
    for name, options in (("default", FormatOptions()), ("auto", FormatOptions.auto()), ("nowrap", FormatOptions(width=0)), ("narrow", FormatOptions(width=40))):
        once = _formatted(spark, d, options).select("doc_id", F.col("formatted").alias("text"))
        part = documents.format_documents(once, options=options).where("changed").select("doc_id", F.lit(name).alias("mode"))
        out = part if out is None else out.unionByName(part)
    return out
