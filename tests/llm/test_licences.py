"""Licence lookup on texts with known answers."""

from tidemark.llm import licence_texts, licences

MIT = licences.KNOWN[2][1]


def found(spark, texts, known=licences.KNOWN):
    docs = spark.createDataFrame([(n, t, "z", "q") for n, t in enumerate(texts)], "doc_id int, text string, licence string, lines string")
    out = licences.scan(docs, licences.known_licences(spark, known))
    assert out.columns == ["doc_id", "text_digest", "licence", "line_licences"]
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == len(texts)
    return [(rows[n].licence, rows[n].line_licences) for n in range(len(texts))], rows


def test_whole_texts_and_lines(spark):
    reworded = MIT.upper().replace("SUBLICENSE", "sub-licence").replace("<YEAR> <COPYRIGHT HOLDERS>", "2019 Some Body").replace(", ", " ,\t")
    texts = [
        MIT, reworded, "\n\n" + MIT + "\n© 2020 X\nAll rights reserved.", MIT + " extra", "Released under the MIT Licence!",
        "intro\n  * released under the mit license *\r\nmore\nLicensed under CC BY-NC 4.0.\nLicensed  under CC-BY NC 4 0\n",
        "It is not Released under the MIT License.", None, "", "\n \n", "Copyright (c) only", "x " * 300_000 + "\nReleased under the MIT License.",
        "Released under the MIT License.", "Released under the MIT License.",
    ]
    got, rows = found(spark, texts)
    one = ("MIT", ["MIT"])
    assert got == [
        ("MIT", []), ("MIT", []), ("MIT", []), (None, []), one, (None, ["CC-BY-NC-4.0", "MIT"]), (None, []), (None, []),
        (None, []), (None, []), (None, []), (None, ["MIT"]), one, one,
    ]
    assert len({rows[n].text_digest for n in (7, 8, 9, 10)}) == 1 and rows[0].text_digest == rows[1].text_digest


def test_spellings_next_to_each_other(spark):
    got, _ = found(spark, ["licence licence per cent", "License, LICENSE percent"], (("a", "license license percent"),))
    assert got == [("a", ["a"])] * 2


def test_no_rows_and_no_licences(spark):
    assert found(spark, [])[0] == []
    assert found(spark, ["Released under the MIT License."], (("a", " .. "),))[0] == [(None, [])]


def test_whole_texts_of_every_book(spark):
    wrapped = MIT.replace("AUTHORS OR COPYRIGHT", "AUTHORS OR\nCOPYRIGHT").replace("the above copyright", "the above\ncopyright")
    body = MIT.split("\n\n", 2)[2]
    flat = lambda t: " ".join(t.split())
    bsd = "BSD 3-Clause License\n\nCopyright (c) 2021, Some Body\nAll rights reserved.\n\n" + licence_texts.BSD.replace("copyright notice", "\ncopyright notice")
    texts = [
        wrapped, body, "Copyright 2011 Some Body\n" + body, bsd, licence_texts.BSD_REGENTS, licence_texts.APACHE,
        licence_texts.APACHE.replace("[yyyy] [name of copyright owner]", "2020 X").replace("(c) You", "\n(c) You"),
        licence_texts.GPL, licence_texts.CC0, flat(licence_texts.CC0), licence_texts.BY_SA,
    ]
    got, _ = found(spark, texts)
    assert [g[0] for g in got] == ["MIT"] * 3 + ["BSD-3-Clause"] * 2 + ["Apache-2.0"] * 2 + ["GPL-3.0", "CC0-1.0", "CC0-1.0", "CC-BY-SA-4.0"]
