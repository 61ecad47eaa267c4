"""Typed blocks of literal pages."""

from millrace.sources.soup import blocks, markdown


def test_headings_come_first_and_chrome_goes():
    html = "<nav><p>menu</p></nav><p>one <b>two</b></p><h2>Head &amp; more</h2><ul><li>item</ul><div class='cookie bar'><p>no</p></div><script>x</script>"
    assert blocks(html)[0] == [("heading", "Head & more", 2), ("paragraph", "one two", None), ("list_item", "item", None)]


def test_loose_text_by_lines():
    assert blocks("first line\n\n second <b>line</b>")[0] == [("paragraph", "first line", None), ("paragraph", "second line", None)]
    assert blocks(None) == ([], []) and blocks("") == ([], [])


def test_tables_are_padded():
    assert blocks("<table><tr><th>a<th>b</tr><tr><td>1</td></tr></table>")[1] == ["| a | b |\n| --- | --- |\n| 1 |  |"]
    assert markdown([["a", "b"], ["1"]]) == "| a | b |\n| --- | --- |\n| 1 |  |" and markdown([]) == ""


def test_blocks_of_rows(spark):
    from millrace.sources.soup import read_blocks

    rows = spark.createDataFrame([(1, "<h1>T</h1><p>x</p>"), (2, None)], "page_id long, html string")
    assert [(r.page_id, r.pos, r.kind, r.text, r.level) for r in read_blocks(rows).orderBy("pos").collect()] == [(1, 0, "heading", "T", 1), (1, 1, "paragraph", "x", None)]
    assert read_blocks(rows.limit(0)).count() == 0
