from collections import Counter
from hashlib import sha256
from zlib import crc32

from pyspark.sql import functions as F

from tamis.llm.decontam import contamination
from tamis.llm.exact_dedup import drop_duplicates_exact, exact_dedup
from tamis.llm.license_scan import MARKS, SENTENCES, licences
from tamis.llm.ngram_join import drop_near_duplicates
from tamis.llm.sharding import fill, shard_rows

SCHEMA = "doc_id long, text string, __len string"


def test_exact_dedup(spark):
    rows = [(1, "Ab", "x"), (2, "aB", "x"), (3, None, None), (4, "", "y"), (5, "É", "x"), (6, "é", "x"), (7, "zz" * 9999, "")]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {
        1: (2, 2, False), 2: (2, 2, True), 3: (4, 2, False), 4: (4, 2, True),
        5: (5, 1, True), 6: (6, 1, True), 7: (7, 1, True),
    }
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shards_are_even_and_gapless(spark):
    df = spark.range(1003).selectExpr("if(id % 50 = 0, null, id div 2) doc_id", "if(id % 7 = 0, null, repeat('é', int(id % 5))) text", "id slot")
    rows = shard_rows(df).collect()
    said = Counter((r.doc_id, r.size, r.text_crc32) for r in rows)
    assert said == Counter((r.doc_id, len((r.text or "").encode()) + 1, crc32((r.text or "").encode())) for r in df.collect())
    per = Counter(r.shard for r in rows)
    assert len(rows) == 1003 and max(per.values()) - min(per.values()) <= 1
    for s in per:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(per[s]))
    assert shard_rows(df.limit(0)).count() == 0


def test_fill_places_every_row_with_one_hot_cell():
    runs = fill({5: 900, 70: 3, 65535: 97}, 8)
    assert sum(r.hi - r.lo for r in runs) == 1000
    assert set(Counter({s: sum(r.hi - r.lo for r in runs if r.shard == s) for s in range(8)}).values()) == {125}


def test_contamination_against_brute_force(spark):
    docs = [(1, "x A b c d e f g h i J k y"), (2, "a b c d e f g h i"), (3, None), (4, "Qq, rr! zz"), (5, "")]
    items = [(10, "a b c d e f g h i j k"), (9, "qq rr"), (8, None), (7, "nowhere at all")]
    got = contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got.collect()} == {
        1: (13, 11, ["10"]), 2: (9, 0, []), 3: (0, 0, []), 4: (3, 2, ["9"]), 5: (0, 0, []),
    }


def test_contamination_of_a_long_monotonous_text(spark):
    import random

    rng = random.Random(1)
    text = [rng.choice("abcde") for _ in range(20_000)]
    rows = [(i, " ".join(rng.choice("abcde") for _ in range(10))) for i in range(800)] + [(900, "a b"), (901, "A"), (902, "zz yy xx")]
    docs = spark.createDataFrame([(1, " ".join(text), 1, 2), (2, "x", 1, 2), (2, "A zz. Yy xx", 1, 2), (None, "a b c", 1, 2)], "doc_id long, text string, n int, wid int")
    items = spark.createDataFrame(rows, "item_id long, text string")
    hit, found = set(), set()
    for i, t in rows:
        w = t.lower().split()
        for s in range(len(text) - len(w) + 1):
            if text[s : s + len(w)] == w:
                hit |= set(range(s, s + len(w)))
                found.add(str(i))
    got = {(r.doc_id, r.n_words): (r.n_hit, r["items"]) for r in contamination(docs, items).collect()}
    assert got == {(1, 20_000): (len(hit), sorted(found)), (2, 1): (0, []), (2, 4): (4, ["901", "902"]), (None, 3): (2, ["900", "901"])}
    assert contamination(docs, items.limit(0)).where("n_hit > 0").count() == contamination(docs.limit(0), items).count() == 0


def test_licences(spark):
    docs = [(1, "Foo bar.\nReleased under the MIT License.\nX. All rights reserved."), (2, None), (3, "mit license")]
    got = {r.doc_id: r.licences for r in licences(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: "MIT,Proprietary", 2: "", 3: ""}


def test_exact_dedup_counts_rows_and_keeps_one(spark):
    rows = [(1, "a", "x"), (1, "A", "y"), (2, "b", "x"), (2, "c", "x"), (None, "n", "x"), (None, "n", "x"), (None, "B", "x"), (9, "q", "x"), (9, "q", "x"), (3, "q", "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = exact_dedup(docs, digest=True).collect()
    want = Counter({(1, 1, 2): 2, (2, 2, 2): 1, (2, 2, 1): 1, (None, None, 2): 2, (None, 2, 2): 1, (9, 9, 3): 2, (3, 9, 3): 1})
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == want
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(sha256(t.encode()).hexdigest() for t in "abcnq")
    left = drop_duplicates_exact(docs).collect()
    assert Counter((r.doc_id, r.text.lower()) for r in left) == Counter([(1, "a"), (2, "b"), (2, "c"), (None, "n"), (9, "q")])
    assert left[0].asDict().keys() == {"doc_id", "text", "__len"} and drop_duplicates_exact(docs.limit(0)).count() == 0


def test_near_duplicates_with_null_and_repeated_ids(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, long), (None, long + " z"), (5, long + " y"), (5, "other words that stand quite alone here"), (7, None), (7, ""), (8, long), (8, long)]
    left = drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.text) for r in left) == Counter([rows[2], rows[3], rows[4], rows[5]])
    left = drop_near_duplicates(spark.createDataFrame([rows[0], rows[1], rows[0]], "doc_id long, text string")).collect()
    assert len(left) == 1


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including ...
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, ..."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
%sTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, ..."""
THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.\n"""
GNU = """you can redistribute it and/or modify it under the terms of the GNU %sGeneral Public License as published by
# the Free Software Foundation, either version %s of the License, or (at your option) any later version."""


def test_licence_texts(spark):
    want = {
        "This file is released under the MIT license.": "MIT",
        "prose\n" + MIT: "MIT",
        MIT.partition("THE SOFTWARE IS")[0]: "",
        BSD % "": "BSD-2-Clause",
        BSD % THIRD: "BSD-3-Clause",
        "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES": "ISC",
        GNU % ("", "2"): "GPL-2.0",
        GNU % ("", "3"): "GPL-3.0",
        GNU % ("Lesser ", "2.1"): "LGPL-2.1",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "MPL-2.0",
        "# SPDX-License-Identifier: (MIT OR GPL-2.0-or-later)\nprose": "MIT,GPL-2.0",
        "licensed under a Creative Commons Attribution-ShareAlike 4.0 International Licence.": "CC-BY-SA-4.0",
        "It is distributed under the terms of the Apache License 2.0": "Apache-2.0",
        "a driving license and the permission to copy": "",
    }
    docs = spark.createDataFrame(list(want), "string").toDF("text").withColumn("doc_id", F.col("text"))
    assert {r.doc_id: r.licences for r in licences(docs).collect()} == want
    assert all(any(m in p for m in MARKS) for p in SENTENCES)
