import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import queries
from gridloom.llm.license_texts import TEXTS
from gridloom.llm.licenses import known_licenses, scan_licenses
from gridloom.llm.preference import preference_pairs
from gridloom.llm.quality_rules import js_distance, quality_rules


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if windows[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def same_rules(docs):
    rows = quality_rules(docs).collect()
    want = Counter((r["doc_id"], *base(r["text"])) for r in docs.collect())
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows) == want
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    return rows


def test_rules_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in same_rules(docs) if not r["base_failed"] and r["doc_id"] in quality]
    assert np.mean([r["kept"] for r in rows if quality[r["doc_id"]] == 1]) > 0.99
    assert np.mean([r["kept"] for r in rows if quality[r["doc_id"]] == 0]) < 0.3


def test_rules_of_odd_rows(odd, none):
    same_rules(odd)
    assert quality_rules(none).count() == 0


def test_rules_stay_in_the_jvm(documents):
    plan = quality_rules(documents)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_js_distance(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([0.5, 0.5], [0.5, 0.5]), ([0.5, 0.5], [0.9, 0.1])], "p array<double>, q array<double>")
    got = [r[0] for r in rows.select(js_distance(F.col("p"), F.col("q"))).collect()]
    m, p, q = np.array([0.7, 0.3]), np.array([0.5, 0.5]), np.array([0.9, 0.1])
    want = np.sqrt(0.5 * (p * np.log2(p / m)).sum() + 0.5 * (q * np.log2(q / m)).sum())
    assert got == pytest.approx([1.0, 0.0, want])


def test_licenses_in_other_spellings(spark, odd, none):
    known = known_licenses(spark, TEXTS)
    mit = TEXTS["MIT"]
    texts = {
        1: mit, 2: "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace("\n", "  \r\n"), 3: mit.replace("sublicense", "sublicence").replace('"', "'"), 4: mit + " and more",
        5: None, 6: "", 7: "Copyright 1999", 8: "released under the mit licence", 9: "# (C) 2001 X\n" + TEXTS["ISC"],
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["license"] for r in scan_licenses(docs, known).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: "MIT", 4: None, 5: None, 6: None, 7: None, 8: "MIT notice", 9: "ISC"}
    assert scan_licenses(odd, known).count() == odd.count() and scan_licenses(none, known).count() == 0


def test_licenses_by_salted_shuffle(spark, monkeypatch):
    from gridloom.llm import common, licenses

    monkeypatch.setattr(licenses, "join_small_or_salted", lambda *a: common.join_small_or_salted(*a, limit=1))
    docs = spark.createDataFrame([(k, TEXTS["ISC"] if k % 2 else f"text {k}") for k in range(50)], "doc_id long, text string")
    got = scan_licenses(docs, known_licenses(spark, TEXTS)).collect()
    assert len(got) == 50 and sum(r["license"] == "ISC" for r in got) == 25


SCHEMA = "pair_id long, turn long, role string, text string, spans string, side string"


def brute_pairs(chosen, rejected):
    def turns(rows, p):
        return sorted(((r[1] if r[1] is not None else 1 << 62, r[2] or "", r[3] or "") for r in rows if r[0] == p))

    out = []
    for p in {r[0] for r in chosen + rejected}:
        a, b = turns(chosen, p), turns(rejected, p)
        first = None
        for t in sorted({x[0] for x in a + b}):
            if [x for x in a if x[0] == t] != [x for x in b if x[0] == t]:
                first = t
                break
        common = [x for x in a if first is None or x[0] < first]
        for name, rows in (("prompt", common), ("chosen", [x for x in a if first is not None and x[0] >= first]), ("rejected", [x for x in b if first is not None and x[0] >= first])):
            text, spans = "", []
            for _, role, body in rows:
                text += f"<|im_start|>{role}\n"
                end = len(text) + len(body) + len("<|im_end|>\n")
                if role == "assistant" and name != "prompt":
                    spans.append((len(text), end))
                text += body + "<|im_end|>\n"
            if rows or name != "prompt":
                out.append((p, name, len(rows), text, tuple(spans)))
    return sorted(out, key=repr)


def merged(rows):
    """Chunks of a segment put together; a turn without a number is a chunk of its own."""
    out = {}
    for r in sorted(rows, key=lambda r: (r["chunk"], r["part"])):
        n, text, spans = out.get((r["pair_id"], r["segment"]), (0, "", ()))
        out[r["pair_id"], r["segment"]] = n + r["n_turns"], text + r["text"], spans + tuple((s["from"] + len(text), s["to"] + len(text)) for s in r["spans"])
    return sorted(((*k, *v) for k, v in out.items()), key=repr)


def test_pairs(spark):
    u, a = "user", "assistant"
    chosen = [(1, 0, u, "hi"), (1, 1, a, "good"), (1, 2, u, "more"), (1, 3, a, "best"), (2, 0, u, "x"), (3, 0, u, "same"), (3, 1, a, "same"), (4, 0, u, None), (4, 1, None, "é🙂"), (None, 0, u, "n"), (5, 0, u, "twice"), (5, 0, u, "twice"), (5, None, a, "last"), (6, 0, u, "p"), (8, 0, u, "q"), (8, 0, u, "q")]
    rejected = [(1, 0, u, "hi"), (1, 1, a, "good"), (1, 2, u, "more"), (1, 3, a, "bad"), (2, 0, a, "x"), (3, 0, u, "same"), (3, 1, a, "same"), (4, 0, u, ""), (4, 1, a, "b"), (None, 0, u, "n"), (5, 0, u, "twice"), (5, None, a, "end"), (6, 0, u, "p"), (6, 1, a, "x"), (7, 0, u, "alone"), (8, 0, u, "r"), (8, 0, u, "r")]
    frame = lambda rows: spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    got = preference_pairs(frame(chosen), frame(rejected)).collect()
    assert merged(got) == brute_pairs(chosen, rejected)
    assert preference_pairs(frame([]), frame([])).count() == 0


def test_long_conversations_come_in_chunks(spark):
    turns = lambda last: [(1, k, "user" if k % 2 == 0 else "assistant", f"t{k}" if k < 150 else last) for k in range(200)]
    frame = lambda rows: spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    got = preference_pairs(frame(turns("a")), frame(turns("b")), chunk_turns=64).collect()
    assert merged(got) == brute_pairs(turns("a"), turns("b")) and max(r["n_turns"] for r in got) == 64


def test_very_many_rows_of_one_turn_come_in_parts(spark):
    turns = lambda last: [(1, 0, "user", "hi"), *[(1, None, "assistant", f"{last}{k % 7}") for k in range(500)], *[(2, 5, "user", "same")] * 300]
    frame = lambda rows: spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA).repartition(5)
    got = preference_pairs(frame(turns("a")), frame(turns("b")), chunk_turns=64).collect()
    assert merged(got) == brute_pairs(turns("a"), turns("b")) and max(r["n_turns"] for r in got) == 64


def test_preference_formatting_runs_no_python(spark, data):
    plan = queries.op10_preference_pairs(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "InPandas", "InArrow"))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    found, want = queries.queries()[name](spark, data), con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r)) for r in found.select(*names).collect())
