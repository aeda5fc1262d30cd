import json

from pyspark.sql import functions as F

from tessella.operators import layout as L


def render(spark, html):
    return spark.range(1).select(L.html_table_to_markdown(F.lit(html)).alias("m")).first().m


def test_table(spark):
    assert render(spark, "<table><tr><th>Name</th><th>Q|ty</th></tr><tr><td>a<br>b</td></tr></table>") == "| Name | Q\\|ty |\n| ---- | ----- |\n| a b  |       |"
    assert render(spark, "<table></table>") == "" and render(spark, "") == ""
    # without a header the first row is one; a later header row has the rule after it; rows of blanks stay
    assert render(spark, "<tr><td>1</td></tr><tr><td> </td></tr>") == "| 1   |\n| --- |\n|     |"
    assert render(spark, "<TR><TD>abcd</TD></TR><tr><TH>h</TH></tr>") == "| abcd |\n| h    |\n| ---- |"


def test_convert(spark):
    text = 'a <table>\n<!-- PageNumber="3" -->\n<tr><td>x</td></tr>\n---\n</table> b <table>none</table> c'
    df = spark.createDataFrame([(1, text), (2, "plain"), (3, None)], "id int, text string")
    got = {r.id: (r.text, r.updated) for r in L.reprocess(df).collect()}
    assert got == {1: ("a | x   |\n| --- | b <table>none</table> c", True), 2: ("plain", False), 3: (None, False)}


def layout(spark, pages, paragraphs=(), tables=(), content="x" * 20):
    span = lambda o, n: {"offset": o, "length": n}
    row = (
        1,
        content,
        [{"words": [{"span": span(*w)} for w in p], "lines": []} for p in pages],
        [{"boundingRegions": [{"pageNumber": n} for n in t]} for t in tables],
        [{"content": "p", "spans": [span(*s) for s in p]} for p in paragraphs],
    )
    return spark.createDataFrame([row], L.LAYOUT)


def test_page_ranges(spark):
    got = L.page_ranges(layout(spark, [[(0, 4), (5, 3)], [], [(12, 2)]], content="0123456789abcdefghij")).orderBy("page_number").collect()
    assert [(r.page_start, r.page_end, r.content) for r in got] == [(0, 9, "012345678"), (9, 12, "9ab"), (12, 20, "cdefghij")]
    got = L.page_ranges(layout(spark, [[], []])).orderBy("page_number").collect()
    assert [(r.page_start, r.page_end) for r in got] == [(0, 1), (1, 20)]
    assert L.page_ranges(layout(spark, [])).count() == 0


def test_overlaps(spark):
    df = layout(spark, [[(0, 5)], [(10, 5)]], paragraphs=[[(8, 4)], [(5, 5)], [(10, 0)], [(30, 2)], [(2, 1), (11, 1)]], tables=[[1, 2, 2], [9], [2]])
    for bucket in (4096, 3):
        got = {(r.page_number, r.paragraph_no) for r in L.paragraphs_on_page(df, bucket).collect()}
        assert got == {(1, 0), (2, 0), (1, 1), (1, 4), (2, 4)}
    assert {(r.page_number, r.table_no) for r in L.tables_on_page(df).collect()} == {(1, 0), (2, 0), (2, 2)}
    assert L.tables_on_page(df).count() == 3
    assert tuple(L.totals(df).first()) == (1, 2, 3, 5)


def test_layout_service_is_a_hook(spark):
    reply = lambda data: json.dumps({"content": data.decode(), "pages": [{"words": [{"span": {"offset": 0, "length": len(data)}}], "lines": []}], "tables": [], "paragraphs": []}) if data != b"bad" else "{"
    rows = spark.createDataFrame([("a.pdf", b"hello"), ("b.pdf", b"bad")], "path string, content binary")
    got = L.analyze(rows, reply)
    assert sorted((r.doc_id, r.page_number, r.content) for r in L.page_ranges(got).collect()) == [("a.pdf", 1, "hello")]
    assert {r.doc_id: r.content for r in got.collect()} == {"a.pdf": "hello", "b.pdf": None}


def test_reprocessed_tables_are_counted(spark):
    t = "<table><tr><td>a</td></tr></table>"
    rows = spark.createDataFrame([(t + "x" + t,), ("none",), (None,), ("<table></table>",)], "text string")
    assert tuple(L.reprocess_counts(L.reprocess(rows)).first()) == (4, 1, 3)
