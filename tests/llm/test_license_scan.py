"""License scans against plain Python over every line and every place."""

import math
import re

import duckdb

from strandworks.llm import license_scan as ls

TEXTS = [
    None,
    "",
    "CC BY cc, by. cc\nby",
    "General Public\nLicense and the General  Public-License; license public general",
    "All Rights Reserved. all rights\treserved all rights all rights reserved",
    "Licensed under the Apache License, Version 2.0.\nx",
    "licensed the apache license 2 0 version\nLicensed under\nthe Apache License, Version 2.0",
    "This work is licensed under the GNU General Public License, version 3.",
    "permission granted free of charge any person obtaining copy this software hereby is to a",
    "Licensed under CC BY-NC 4.0.",
    "cc" + " by" * 3 + " é cc by İcc by",
    "word " * 30_000 + "all rights reserved" + " word" * 30_000,
    "Released under the MIT license.",
    "gpl cc-by reserved",
]


def plain(text):
    text = text or ""
    words = ls.plain_words(text)
    places = [(i, p.label) for p in ls.PHRASES for i in range(len(words)) if words[i : i + len(ls.plain_words(p.text))] == ls.plain_words(p.text)]
    met = [(label, 1.0) for _, label in places]
    step = max(len(ls.plain_words(t.text)) for t in ls.NOTICES)
    for at in range(0, max(1, len(words)), step):
        have = set(words[at : at + 2 * step])
        for t in ls.NOTICES:
            want = set(ls.plain_words(t.text))
            if len(want & have) >= max(1, math.ceil(t.least * len(want) - 1e-9)) and set(ls.plain_words(t.must)) <= have:
                met.append((t.label, len(want & have) / len(want)))
    joined = lambda xs: ",".join(sorted(set(xs)))
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), joined(x for _, x in places), joined(x for x, _ in met), round(max([s for _, s in met], default=0.0), 6)


def test_equals_plain_python(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(TEXTS)] + [(None, TEXTS[2], "x", "y"), (2, TEXTS[2], "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, KEY string, words string")
    got = ls.license_documents(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        text = TEXTS[r["doc_id"] if r["doc_id"] is not None else 2]
        assert (*r[1:-1], round(r["score"], 6)) == plain(text)
    assert ls.license_documents(docs.limit(0)).count() == 0


BY_HAND = {
    "Redistribution and use in source and binary forms, with or without\nmodification, are permitted": "bsd",
    "/* Licensed under\n * the Apache License, Version 2.0\n */": "apache-2.0",
    "Licensed under the Mozilla Public License, Version 2.0": "",
    "This work is licensed under the GNU General Public License, version 2": "gpl",
    "This work is licensed under the GNU General Public License, version 3": "gpl,gpl-3.0",
    "Permission is hereby granted, free of charge,\nto any person obtaining\na copy of this software": "mit-grant",
    "Released under the BSD license": "",
    "word " * 33 + "Released\nunder the\nMIT license " + "word " * 40: "mit",
    "Licensed under CC BY-SA\n4.0": "cc-by,cc-by-sa-4.0",
    "released under the " + "word " * 60 + "mit license " + "word " * 60: "",
}


def test_wrapped_and_sibling_licenses(spark):
    docs = spark.createDataFrame(list(enumerate(BY_HAND)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in ls.license_documents(docs).collect()}
    assert [got[i] for i in range(len(BY_HAND))] == list(BY_HAND.values())


def test_hot_text(spark):
    rows = [(i, TEXTS[5]) for i in range(500)] + [(None, TEXTS[3])] * 200
    got = ls.license_documents(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("labels").count().collect()
    assert {r["labels"]: r["count"] for r in got} == {"apache-2.0": 500, "gpl": 200}


def test_registered_query_equals_its_sql(spark):
    duck = duckdb.connect()
    duck.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    columns = "doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score"
    want = duck.execute(f"SELECT {columns} FROM ({ls.op1_sql()})").fetchall()
    got = [tuple(r) for r in ls.op1_license_scan(spark, "/root/testdata/sf0.001").select(*columns.split(", ")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(r[6] for r in got)


def test_prefixes_lose_nothing():
    """Every word set that meets a template has a word of its prefix, whatever the order of words."""
    templates = ls.PHRASES + ls.NOTICES
    vocabulary = {w for t in templates for w in ls.plain_words(t.text)}
    plan = ls.plan_templates(templates, {w: len(w) * 7 % 5 for w in vocabulary})
    for k, (t, s) in enumerate(zip(templates, plan.sets, strict=True)):
        need = max(1, math.ceil(t.least * len(s) - 1e-9))
        filed = {x[0] for x in plan.index if x[1] == k}
        assert len(s) - len(filed) == need - 1  # one word too few without the prefix
        assert sorted(s) == sorted(set(re.findall(ls.WORD, t.text)))
