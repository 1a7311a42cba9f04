"""Licence digests: normalisation, whole texts, notices and SQL."""

from rfmlens.llm import licenses as L


def scan(spark, texts, known=None):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, license string")
    return [(r.license, r.notices, r.n_notices) for r in L.scan(docs, known).orderBy("doc_id").collect()]


def test_known_texts_in_other_dress(spark):
    mit = dict(L.KNOWN[1:2])["MIT"]
    texts = [mit, "Copyright (c) 2021 Some One\n© 2020 Other\n\n" + mit.upper(), mit.replace(",", "").replace(" ", "  \n "),
             mit.replace("sublicense", "sub-licence"), mit + " And more.", "x " + mit, mit.replace("Software", "Softwares")]
    assert [r[0] for r in scan(spark, texts)] == ["MIT"] * 4 + [None] * 3


def test_notices_and_edges(spark):
    texts = [None, "", "...", "a line\nReleased under the MIT Licence!\nmore\n  licensed under CC BY-NC 4.0\n", "Released under the MIT License.",
             "Released under the MIT License.\nreleased under the mit license", "it says Released under the MIT License.", "Copyright 2020 me", "x" * 300_000]
    got = scan(spark, texts)
    assert got[:3] == [(None, "", 0)] * 3
    assert got[3] == (None, "CC-BY-NC-4.0,MIT", 2) and got[4] == ("MIT", "MIT", 1) and got[5] == (None, "MIT", 2)
    assert got[6:] == [(None, "", 0)] * 3


def test_own_table_and_shuffle_join(spark, monkeypatch):
    known = spark.createDataFrame([("B", "One, two."), ("A", "one two"), ("E", ""), (None, "three"), ("N", None)], "name string, text string")
    want = [("A", "A", 1), (None, "", 0), (None, "", 0)]
    assert scan(spark, ["ONE TWO", "three", ""], known) == want
    monkeypatch.setattr(L, "BROADCAST_ROWS", 0)
    assert scan(spark, ["ONE TWO", "three", ""], known) == want
    assert scan(spark, ["ONE TWO"], known.where("false")) == [(None, "", 0)]
    docs = spark.createDataFrame([(None, "one two"), (1, "one two"), (1, "one two")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in L.scan(docs, known).collect()) == ["1", "1", "None"]
    assert L.scan(docs.where("false"), known).count() == 0


def test_query_against_sql(spark):
    from tools.compare_oracle import compare
    assert compare(spark, "/root/testdata/sf0.001", ["op8_licenses"]) == {"op8_licenses": "ok"}


def test_sql_knows_what_the_query_knows(spark, tmp_path):
    """Short texts, file headers over several lines, SPDX tags and full texts by digest: each row in Spark and in SQL."""
    import duckdb
    from rfmlens.llm.license_texts import HEADERS
    texts = [t for _, t in L.KNOWN[:6]] + [t for _, t in HEADERS] + ["# " + t.replace("\n", "\n# ") + "\n\ncode()" for _, t in HEADERS]
    texts += ["SPDX-License-Identifier: BSD-3-Clause", "// SPDX-License-Identifier: GPL-3.0-only\nx\n", "a\n\n\nb\nc", "\nreleased under\nthe MIT license.\n", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = L.op8_licenses(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(L.OP8_SQL).project(", ".join(got.columns)).fetchall()
    key = lambda r: r[0]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert sum(r[2] is not None for r in want) >= 8 and sum(r[4] > 0 for r in want) >= 2 * len(HEADERS)
