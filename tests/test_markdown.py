"""Markdown sections by literal rows."""

from recallgrid.operators import documents as D


def parts(text):
    return [(s.path, s.label, s.text) for s in D.markdown_sections(text)]


def test_sections_and_paths():
    text = "# A b!\none\n### Deep\ntwo\n## C_d #\nthree\n#### too deep\nfour\n# A b!\nfive\n#nohead\n"
    assert parts(text) == [("a-b", "A b!", "# A b!\none"), ("a-b/deep", "Deep", "### Deep\ntwo"), ("a-b/c-d", "C_d", "## C_d #\nthree\n#### too deep\nfour"), ("a-b", "A b!", "# A b!\nfive\n#nohead")]
    assert parts("# ??\nx") == [("section", "??", "# ??\nx")]


def test_fences_hide_headings():
    assert parts("# A\n```\n# b\n```\n## C") == [("a", "A", "# A\n```\n# b\n```"), ("a/c", "C", "## C")]


def test_front_matter_and_preambles():
    long = "p" * 50
    assert parts(f"---\na: 1\n---\n{long}\n# A") == [("preamble", "preamble", long), ("a", "A", "# A")]
    assert parts("+++\na = 1\n+++\nshort\n# A") == [("a", "A", "# A")]
    assert parts("plain") == [("preamble", "(whole file)", "plain")] and parts("") == [] and parts(" \n ") == []
    s = D.markdown_sections("---\na: 1\n---\n# A\nx")[0]
    assert (s.start, s.end, s.sure) == (13, 18, 1.0)


def test_long_sections_are_cut_between_paragraphs():
    body = ["w" * 9000, "v" * 9000, "u" * 20000]
    got = D.markdown_sections("# A\n\n" + "\n\n".join(body))
    assert [(s.path, s.label, s.sure) for s in got] == [(f"a/part-{k}", f"A (part {k})", 0.6) for k in (1, 2, 3)]
    assert [s.text for s in got] == ["# A\n\n" + body[0], *body[1:]] and got[1].start == got[0].end + 2


def test_on_spark(spark):
    docs = spark.createDataFrame([(1, "# A\nx"), (2, None), (3, "")], "id int, text string")
    assert [tuple(r) for r in D.chunk_markdown(docs, "id", "text").collect()] == [(1, 0, "a", "A", 0, 5, 1.0, "# A\nx")]
