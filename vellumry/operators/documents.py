"""DataFrame transforms over a corpus of documents.

All of them read one text column of each row, keep the key columns named by the caller
and shuffle nothing unless stated.  Null texts have null results (or no rows); empty and
blank texts are documents like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumry.formatting.regions import PRIORITY
from vellumry.functions import arrow, text
from vellumry.options import FormatOptions
from vellumry.runtime import running


def format_documents(df: DataFrame, text_col: str = "text", options: FormatOptions = FormatOptions(), read_error: str | None = None) -> DataFrame:
    """``df`` with formatted, changed and error.

    The text may be a string or a binary column; bytes that are not UTF-8 are reported in
    ``error`` and have no formatted text.  A document that cannot be parsed keeps its
    source with normalized line ends, and ``error`` says why.  ``read_error`` names a column with the
    error of reading the document, which comes first.  Columns of these names are replaced.
    """
    c = F.col(text_col)
    failed = F.col(read_error).cast("string") if read_error else F.lit(None).cast("string")
    if df.schema[text_col].dataType.typeName() == "binary":
        good = text.is_utf8(c)
        df = df.withColumn("_failed", F.coalesce(failed, F.when(~good, F.lit("invalid UTF-8")))).withColumn("_text", F.when(good, F.decode(c, "UTF-8")))
    else:
        df = df.withColumn("_failed", failed).withColumn("_text", c)
    done = df.withColumn("_done", arrow.formatted(F.col("_text"), options))
    done = done.withColumn("formatted", F.col("_done.formatted")).withColumn("error", F.coalesce("_failed", "_done.error"))
    return done.withColumn("changed", F.col("formatted") != F.col("_text")).drop("_text", "_failed", "_done")


def format_metrics(df: DataFrame, text_col: str = "text", options: FormatOptions = FormatOptions()) -> DataFrame:
    """``df`` with n_chars, parse_us and render_us: where the time of formatting goes."""
    c = F.col(text_col)
    if df.schema[text_col].dataType.typeName() == "binary":
        c = F.when(text.is_utf8(c), F.decode(c, "UTF-8"))
    return df.withColumn("_m", arrow.timed(c, options)).select(*df.columns, "_m.*")


def _exploded(df: DataFrame, keys: list[str], values: Column, name: str) -> DataFrame:
    return df.select(*keys, F.posexplode(values).alias("i", name))


def sentences(df: DataFrame, keys: list[str], text_col: str = "text", min_length: int = 0, atomic: bool = False) -> DataFrame:
    """(keys, i, sentence)"""
    c = F.col(text_col)
    if atomic:
        return _exploded(df, keys, arrow.sentences_atomic(c, min_length), "sentence")
    return _exploded(df, keys, arrow.sentences_plain(c, min_length) if min_length else text.sentences(c), "sentence")


def words(df: DataFrame, keys: list[str], text_col: str = "text", atomic: bool = True) -> DataFrame:
    """(keys, i, word)"""
    c = F.col(text_col)
    return _exploded(df, keys, arrow.atomic_words(c) if atomic else text.words(c), "word")


def lines(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, i, line, kind) of the normalized text."""
    rows = _exploded(df, keys, text.lines(text.normalize_source(F.col(text_col))), "line")
    return rows.withColumn("kind", line_kind(F.col("line")))


def line_kind(c: Column) -> Column:
    return (
        F.when(text.collapse(c) == "", "blank").when(text.is_fence(c), "fence").when(text.is_thematic_break(c), "break").when(text.is_heading(c), "heading")
        .when(text.is_table_separator(c), "separator").when(text.is_table_row(c), "table").when(text.is_list_item(c), "list").when(text.is_tag_only(c), "tag").otherwise("text")
    )


def blocks(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, ord, parent, depth, kind, start_line, end_line, text): the block tree."""
    return df.select(*keys, F.inline(arrow.block_rows(text.normalize_source(F.col(text_col)))))


def regions(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, idx, kind, form, start, end, source, widths): protected blocks and inline regions."""
    return df.select(*keys, F.inline(arrow.protected_regions(text.normalize_source(F.col(text_col)))))


def scopes(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, kind, start, end): paragraphs, headings, definitions, tables and cells."""
    return df.select(*keys, F.inline(arrow.inline_scopes(text.normalize_source(F.col(text_col)))))


def framed_lines(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, i, line, frames, block, opaque): lines with their containers, block and code flag."""
    c = text.normalize_source(F.col(text_col))
    zipped = F.arrays_zip(text.lines(c).alias("line"), arrow.line_frames(c).alias("frame"), arrow.opaque_flags(c).alias("opaque"))
    rows = df.select(*keys, F.posexplode(zipped).alias("i", "_z"))
    return rows.select(*keys, "i", "_z.line", "_z.frame.frames", "_z.frame.block", "_z.opaque")


def references(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """Reference links with their targets: (keys, label, url, n); url is null where the
    label has no definition.  Of several definitions of a label the last one counts; code
    holds neither links nor definitions."""
    return df.select(*keys, F.inline(arrow.reference_uses(text.normalize_source(F.col(text_col)))))


def arbitrate(candidates: DataFrame, keys: list[str], ties: list[str] | None = None) -> DataFrame:
    """The best candidate at each start: by priority, greater length, name, then ``ties``."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[F.col("kind")], F.lit(99))
    best = Window.partitionBy(*keys, "start").orderBy(rank, F.col("start") - F.col("end"), "kind", *(ties or []))
    return candidates.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")


def covered(left: DataFrame, right: DataFrame, key: str, bucket: int = 1 << 20) -> DataFrame:
    """Rows of ``left`` (each as often as given) whose half-open interval overlaps one of ``right``'s, same key.

    Counting ends instead of pairing: the intervals that start before a row's end minus
    those that end by its start are those that overlap it, so no pairs are formed.
    Positions are cut into buckets of ``bucket``, so a key may hold any share of the rows.
    """
    l = left.select(key, F.col("start").alias("a"), F.col("end").alias("b"), F.struct(*left.columns).alias("row"))
    r = right.select(key, F.col("start").alias("a"), F.col("end").alias("b")).where("a < b")
    at = lambda df, pos, step, opened, closed, row: df.select(key, F.col(pos).alias("at"), F.lit(step).alias("step"), F.lit(opened).alias("o"), F.lit(closed).alias("c"), row)
    none = F.lit(None).cast(l.schema["row"].dataType).alias("row")
    # At one position: ends close first, then starts of rows read, then ends of rows read, then starts open.
    events = at(r, "b", 0, 0, 1, none).unionByName(at(l, "a", 1, 0, 0, F.col("row"))).unionByName(at(l, "b", 2, 0, 0, F.col("row"))).unionByName(at(r, "a", 3, 1, 0, none))
    run = running(events, [key], "at", F.col("o"), "sum", "opened", ties=[F.col("step")], bucket_us=bucket)
    run = running(run, [key], "at", F.col("c"), "sum", "closed", ties=[F.col("step")], bucket_us=bucket).where("row is not null")
    both = run.groupBy(key, "row").agg(F.max(F.when(F.col("step") == 2, F.col("opened"))).alias("o"), F.max(F.when(F.col("step") == 1, F.col("closed"))).alias("c"), F.count_if(F.col("step") == 1).cast("int").alias("n"))
    return both.where(F.col("o") > F.col("c")).select(F.explode(F.array_repeat("row", F.col("n"))).alias("row")).select("row.*")


def collapse_blank_lines(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with its texts normalized and runs of blank lines outside code as one."""
    return df.withColumn(text_col, arrow.single_blanks(text.normalize_source(F.col(text_col))))


def renumber_lists(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with its texts normalized and the items of ordered lists counted on."""
    return df.withColumn(text_col, arrow.renumbered(text.normalize_source(F.col(text_col))))


def would_change(formatted: DataFrame, by: list[str]) -> DataFrame:
    """Verdicts per group: documents, changed ones, and whether any changed."""
    changed = F.coalesce(F.col("changed"), F.lit(False))
    return formatted.groupBy(*by).agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(changed).alias("n_changed"), F.bool_or(changed).alias("any_changed"))
