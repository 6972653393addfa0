"""Digests of licenses do not depend on where their lines break."""

import os
import textwrap

import duckdb
import pytest
from pyspark.sql import functions as F

from gridloom.llm.license_texts import DIGESTS, TEXTS
from gridloom.llm.licenses import canonical, known_licenses, scan_licenses
from gridloom.llm.queries import op4_license_scan, oracle_sql

WIDTHS = (20, 33, 40, 47, 55, 60, 66, 70, 72, 75, 78, 79, 80, 90, 100, 120, 10**6)


def test_known_texts_in_other_widths(spark):
    wrapped = lambda text, n: textwrap.fill(" ".join(text.split()), n, break_long_words=False, break_on_hyphens=False)
    rows = [(name, wrapped(text, n)) for name, text in TEXTS.items() for n in WIDTHS]
    rows += [(name, " ".join(text.split()).replace(" copyright", "\ncopyright").replace(" COPYRIGHT", "\nCOPYRIGHT")) for name, text in TEXTS.items()]
    docs = spark.createDataFrame([(f"{name}#{k}", text) for k, (name, text) in enumerate(rows)], "doc_id string, text string")
    missed = [r["doc_id"] for r in scan_licenses(docs, known_licenses(spark, TEXTS)).collect() if r["license"] != r["doc_id"].split("#")[0]]
    assert not missed, f"{len(missed)} of {len(rows)}"


def test_only_owner_lines_go(spark):
    isc = TEXTS["ISC"]
    heads = ["Copyright (c) 2020 A\n", "Copyright 2020 A\n", "# (C) 2001 A\n", "© A\n", "Copyright © 2020 A. All rights reserved.\n", "All rights reserved.\n", "copyright: 2019-2021 A\r\n"]
    bodies = ["(c) You must retain all notices\n", "copyright notice of others\n", "All rights reserved by law are kept\n"]
    docs = spark.createDataFrame(list(enumerate(h + isc for h in heads + bodies)), "doc_id long, text string")
    got = {r["doc_id"]: r["license"] for r in scan_licenses(docs, known_licenses(spark, TEXTS)).collect()}
    assert [got[k] for k in range(len(got))] == ["ISC"] * len(heads) + [None] * len(bodies)


def test_titles_and_notices_in_front_of_bodies(spark):
    mit, isc, bsd = TEXTS["MIT"], TEXTS["ISC"], TEXTS["BSD-3-Clause"]
    line = lambda t: " ".join(t.split())
    rows = [
        ("MIT", "MIT License\n\nCopyright (c) 2025 Some One\n\n" + mit),
        ("MIT", "The MIT License (MIT)\nCopyright © 2001-2020 Some One <a@b.c>\n" + mit),
        ("MIT", "Copyright (c) 2020 Some One " + line(mit)),
        ("MIT", textwrap.fill("Copyright 2020 Some One. " + line(mit), 60)),
        ("ISC", "ISC License\n\nCopyright (c) 4-digit 1999, A B\n\n" + isc),
        ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2019, A B\nAll rights reserved.\n\n" + bsd.replace("copyright holder nor", "copyright owner nor")),
        (None, "MIT License\n\nsomething else"),
        (None, mit.replace("Software", "Programme", 1)),
    ]
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["license"] for r in scan_licenses(docs, known_licenses(spark, TEXTS)).collect()}
    assert [got[k] for k in range(len(rows))] == [x for x, _ in rows]


def test_only_whole_words_are_respelled(spark):
    rows = [("A programme and a licence licence.", "a  program  and  a  license  license"), ("programmed analogues", "programmed  analogues"), ("sub-licence https://x.y per cent", "sublicense  http  x  y  per  cent")]
    got = spark.createDataFrame(rows, "t string, w string").select(canonical(F.col("t")).alias("c"), "w").collect()
    assert [r["c"] for r in got] == [r["w"] for r in got]


LONG = {"Apache-2.0": "Apache-2.0", "Artistic-1.0-Perl": "Artistic", "CC0-1.0": "CC0-1.0", **{f"GPL-{k}.0": f"GPL-{k}" for k in (1, 2, 3)}, "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0"}


def test_long_licenses_by_digest(spark):
    folder = "/usr/share/common-licenses"
    if not os.path.isdir(folder):
        pytest.skip("this machine has no license texts")
    texts = {name: open(f"{folder}/{file}", encoding="utf-8", errors="replace").read() for name, file in LONG.items()}
    rows = [(name, form(t)) for name, t in texts.items() for form in (str, str.upper, lambda t: "\r\n".join(x.strip() for x in t.splitlines()))]
    docs = spark.createDataFrame([(f"{n}#{k}", t) for k, (n, t) in enumerate(rows)], "doc_id string, text string")
    missed = [r["doc_id"] for r in scan_licenses(docs, known_licenses(spark, TEXTS, DIGESTS)).collect() if r["license"] != r["doc_id"].split("#")[0]]
    assert not missed


def test_rows_that_match_equal_the_sql(spark, tmp_path):
    rows = [(k, f"{head}{t}") for k, (head, t) in enumerate((h, t) for t in TEXTS.values() for h in ("", "MIT License\n\nCopyright (c) 2025 A\n\n", "Copyright 2001 B ", "# © C\n", "x "))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(oracle_sql()["op4_license_scan"] + " ORDER BY doc_id").fetchall()
    found = op4_license_scan(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == want and sum(r["license"] is not None for r in found) > 20
