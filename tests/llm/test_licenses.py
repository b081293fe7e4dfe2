import re
import textwrap
from pathlib import Path

import duckdb
import pytest

from gritstone.llm import licenses
from gritstone.llm.queries import ORACLE, QUERIES

#: Full texts that this system has, by file.
FOLDER = Path("/usr/share/common-licenses")


def test_variants_have_one_digest(spark):
    text = licenses.KNOWN[0][1]
    variants = [text, text.upper(), text.replace("Copyright (c) <year> <holder>", "Copyright (C) 2019 Some One\n(c) 2020 Others"), text.replace(",", " ,  ").replace("\n", "\n\n"), text.replace("License", "Licence"), text.replace("NONINFRINGEMENT", "NON-INFRINGEMENT"), "* " + text.replace("\n", "\n * ")]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(variants)), "doc_id long, text string")).collect()
    assert {r.license_id for r in rows} == {"MIT"} and len({r.digest for r in rows}) == 1


def test_every_known_text_is_found_and_others_are_not(spark):
    rows = [(i, t) for i, (_, t) in enumerate(licenses.KNOWN)] + [(100, licenses.KNOWN[0][1] + " and more"), (101, "Licensed under CC BY-NC 4.0.")]
    got = {r.doc_id: r.license_id for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == name for i, (name, _) in enumerate(licenses.KNOWN)) and got[100] is None and got[101] is None


def test_odd_rows_and_plan(odd_docs, no_docs):
    rows = licenses.scan(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r.digest is None for r in rows if r.doc_id in (2, 3, 4))
    assert licenses.scan(no_docs).collect() == []
    assert "Python" not in licenses.scan(odd_docs)._jdf.queryExecution().toString()


def _found(spark, texts):
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [r.license_id for r in sorted(rows, key=lambda r: r.doc_id)]


@pytest.mark.skipif(not FOLDER.exists(), reason="no licence texts on this system")
def test_full_texts_in_any_wrapping(spark):
    texts, names = [], []
    for file, name in (("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3", "LGPL-3.0"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0"), ("Artistic", "Artistic-1.0-Perl")):
        text = (FOLDER / file).read_text(errors="replace")
        parts = re.split(r"\n\s*\n", text)
        wrapped = ["\n\n".join(x if re.search("copyright", x, re.I) and re.search(r"\(c\)|19|20", x, re.I) else textwrap.fill(x, width, break_long_words=False) for x in parts) for width in (50, 61, 95)]
        texts += [text, "// " + text.replace("\n", "\n// "), *wrapped]
        names += [name] * 5
    got = _found(spark, texts)
    assert [(i, n) for i, n in enumerate(names) if got[i] != n] == []


def test_a_wrapped_body_keeps_its_copyright_lines(spark):
    mit, bsd = licenses.KNOWN[0][1], licenses.KNOWN[6][1]
    wrapped = [mit.replace("OR COPYRIGHT HOLDERS", "OR\nCOPYRIGHT HOLDERS"), bsd.replace("the above copyright notice", "the above\ncopyright notice"), *(textwrap.fill(x.split("\n\n", 2)[2], w, break_long_words=False) for x in (mit, bsd) for w in range(30, 90, 7))]
    assert _found(spark, wrapped) == ["MIT", "BSD-2-Clause"] + ["MIT"] * 9 + ["BSD-2-Clause"] * 9


def test_neighbouring_spellings_and_notices(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("licence licence, LICENCE",), ("per cent per cent",), ("Copyright 2020 A\n(c) 2021 B\n# Copyright (c) C\n© <year> D\nx",), ("copyright holders\n(c) You must",)], "t string")
    assert [r[0] for r in rows.select(licenses.canonical(F.col("t"))).collect()] == ["license license license", "percent percent", "x", "copyright holders c you must"]


def test_sql_twin(spark):
    rows = {r.doc_id: (r.digest, r.license_id) for r in QUERIES["license_variants"](spark, "").collect()}
    assert rows == {i: (d, n) for i, d, n in duckdb.sql(ORACLE["license_variants"]).fetchall()}
    texts = dict(licenses.variants())
    for i, (name, _) in enumerate(licenses.KNOWN):
        assert [rows[5 * i + k][1] for k in range(4)] == [name] * 4 and rows[5 * i + 4][1] is None, texts[5 * i]
