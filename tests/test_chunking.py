from tessella.operators import chunking as C


def chunk(spark, name, text, utility="UtilA"):
    rows = C.chunk_documents(spark.createDataFrame([(name, utility, text)], "source string, utility string, text string"))
    return rows.orderBy("chunk_index").collect()


def test_basics(spark):
    got = chunk(spark, "g1.md", "# Guide\n\nIntro line one\nIntro line two\n\n## Rates\n| a | b |\n|---|---|\n| 1 | 2 |\n\nAfter\n")
    assert [r.chunk_id for r in got] == ["g1_0000_cb16927876c2", "g1_0001_14fca6eb9f03"]
    assert got[0].content == "Intro line one\n\nIntro line two"
    assert (got[0].heading_level, got[0].topic, got[0].subtopic, got[0].section) == (1, "Guide", "", "Guide")
    assert (got[1].heading_level, got[1].subtopic, got[1].section) == (2, "Rates", "Guide > Rates")
    assert [r.content_type for r in got] == ["text", "table"]
    assert [r.has_table for r in got] == [False, True]
    assert [(r.metadata.char_count, r.metadata.token_estimate) for r in got] == [(30, 7), (36, 9)]
    assert {(r.energy_utility_name, r.region, r.page_start, r.is_table) for r in got} == {("UtilA", "New York", None, False)}


def test_level_skip(spark):
    got = chunk(spark, "x.md", "# a\n1\n### b\n2\n### c\n3\n### d\n4\n")
    assert [r.section for r in got] == ["a", "a > b", "a > b > c", "a > b > d"]


def test_pages(spark):
    got = chunk(spark, "g3.md", '<!-- PageNumber="3" -->\n# A\nx\n<!-- PageNumber="4" -->\ny\n# B\nz\n')
    assert [(r.chunk_id, r.content, r.page_start, r.page_end) for r in got] == [("g3_0000_e98b517bcf91", "x\n\ny", 3, 4), ("g3_0001_25155c306800", "z", 4, 4)]


def test_one_line_table_swallows(spark):
    got = chunk(spark, "t.md", "# T\n<table><tr><td>a</td></tr></table>\nlost\n</table>\nkept\n")
    assert [r.content for r in got] == ["a\n\nkept"]


def test_process_table(spark):
    rows = [["PROCESS NAME:", "Enroll"], ["PROCESS NUMBER", "7"], ["Owner", "Ops", "Team"], ["extra"]]
    html = "<table>\n" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>\n" for r in rows) + "</table>\n"
    [r] = chunk(spark, "p.md", html)
    assert r.content == "PROCESS NUMBER: 7\nPROCESS NAME: Enroll\nOwner: Ops Team extra"
    assert (r.content_type, r.has_table, r.section) == ("text", True, "Document")


def test_figure(spark):
    text = "<figure>\n<figcaption>Flow of enrollment</figcaption>\n<!-- AI Description: A box  and arrow -->\nStart then verify then finish ✓\n</figure>\n"
    [r] = chunk(spark, "f.md", text)
    assert r.content == "[Figure Caption] Flow of enrollment\n[Figure Description] A box and arrow\n[Figure Content] Flow of enrollment Start then verify then finish"
    assert r.content_type == "figure" and r.has_figure and r.figure_count == 1


def test_packing():
    text, atom = (lambda n: ("x" * n, False)), (lambda n: ("y" * n, True))
    sizes = lambda *p: [len(w) for w in C.pack(list(p))]
    assert sizes(text(2000), atom(300), atom(500), text(100)) == [2302, 602]
    assert sizes(text(2000), atom(300), text(200)) == [2302, 522]
    assert sizes(atom(3000), text(100)) == [3000, 100]
    assert sizes() == []


def test_splitter():
    text = "".join(chr(0x4E00 + k) for k in range(5000))
    place = lambda n: [(text.index(p), len(p)) for p in C.split_overlap(text[:n])]
    assert place(2400) == [(0, 2400)]
    assert place(2401) == [(0, 2400), (2080, 321)]
    assert place(4480) == [(0, 2400), (2080, 2400), (4160, 320)]
    assert place(5000) == [(0, 2400), (2080, 2400), (4160, 840)]
    assert C.split_overlap("  ") == [] and C.split_overlap(" a ") == [" a "]


def test_states(spark):
    assert [r.content for r in chunk(spark, "m.md", "| a |\n\n| b |\n")] == ["| a |\n| b |"]
    assert [r.content for r in chunk(spark, "h.md", "###### x\n#x\n---\nsee PageNumber here\n")] == ["###### x\n\n#x"]
    assert [r.content for r in chunk(spark, "o.md", "| p |\n<table>\n<tr><td>q</td></tr>\n</table>\nend\n")] == ["q\n\n| p |\n\nend"]
    assert chunk(spark, "e.md", "") == [] and chunk(spark, "u.md", "<figure>\nnever closed\n") == []
    [r] = chunk(spark, "s.md", '<!-- PageFooter="Submitted: May 4" -->\nbody\n')
    assert r.metadata.submitted == "May 4"


def test_metadata(spark):
    [r] = chunk(spark, "d.md", "Source PDF: [a b.pdf](https://x.org/a.pdf)\nTotal Pages: 12\nVersion 1.2\nCase 98-M-0667\n", "")
    m = r.metadata
    assert (m.source_pdf_name, m.source_pdf_url, m.total_pages, m.total_tables, m.doc_version, m.case_number) == ("a b.pdf", "https://x.org/a.pdf", 12, None, "1.2", "98-M-0667")
    [r] = chunk(spark, "d.md", "Source PDF at https://x.org/q/b.pdf?v=1 now", "")
    assert (r.source_pdf_name, r.source_pdf_url) == ("b.pdf", "https://x.org/q/b.pdf?v=1")


def test_full_window_closes():
    text, atom = (lambda n: ("x" * n, False)), (lambda n: ("y" * n, True))
    sizes = lambda *p: [len(w) for w in C.pack(list(p))]
    assert sizes(text(2380), atom(20), text(100)) == [2402, 100]  # filled exactly: closed, no tail goes along
    assert sizes(text(2379), atom(20), text(100)) == [2401, 422]  # a character less: still open, the tail goes along
