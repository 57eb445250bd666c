"""Functions registered for SQL."""

from vellumry.functions import sql


def test_registered_functions(spark):
    assert "format_markdown" in sql.register(spark)
    spark.createDataFrame([(1, "# A\nOne two. Three `x` four."), (2, None)], "id int, text string").createOrReplaceTempView("texts")
    assert spark.sql("SELECT format_markdown(text) AS t FROM texts WHERE id = 1").first()["t"] == "# A\n\nOne two. Three `x` four.\n"
    assert spark.sql("SELECT smart_quotes('\"a\"') AS t, ellipses('b...') AS e, fill_text('a\nb') AS f").first() == ("“a”", "b …", "a b")
    rows = spark.sql("SELECT t.id, s.* FROM texts t, LATERAL text_sentences(t.text) s ORDER BY i").collect()
    assert [tuple(r) for r in rows] == [(1, 0, "# A\nOne two."), (1, 1, "Three `x` four.")]
    assert [r["kind"] for r in spark.sql("SELECT b.* FROM texts t, LATERAL text_blocks(t.text) b ORDER BY ord").collect()] == ["heading", "paragraph"]
    assert spark.sql("SELECT r.source FROM texts t, LATERAL text_regions(t.text) r").first()[0] == "`x`"
    assert spark.sql("SELECT count(*) FROM texts t, LATERAL text_words(t.text) w").first()[0] == 7
