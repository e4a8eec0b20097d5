"""Whole jobs of the operators: cases that earlier forms left out."""

import textwrap

import pytest
from pyspark.sql import functions as F

from wordloom.llm import licenses, mixing, warc

LEAF = ("segment", "seq", "offset", "length", "digest")


def archive(spark, n=300, segment_records=32):
    pages = spark.createDataFrame([(i, f"http://a.example.com/{i}", f"<p>page {i}</p>" * (i % 5)) for i in range(n)], "page_id long, url string, html string")
    recs = warc.records(pages)
    return recs, warc.manifest(recs, segment_records)


def test_offset_ranges_and_inserted_records_are_audited(spark):
    _, man = archive(spark, 60, 4096)
    leaves = man.select(*LEAF)
    rows = {r.seq: r for r in man.collect()}
    bad = lambda replica: {r.seq for r in warc.audit(man, replica).collect() if not r.intact}
    for c in ("offset", "length"):
        assert bad(leaves.withColumn(c, F.col(c) + F.when(F.col("seq") == 7, 1).otherwise(0))) == {7}
    one = man.where("seq = 0")
    assert {r.intact for r in warc.audit(one, one.select(*LEAF).withColumn("offset", F.lit(5).cast("long"))).collect()} == {False}

    def laid(order):
        out, at = [], 0
        for k, (digest, length) in enumerate(order):
            out.append(("", k, at, length, digest))
            at += length
        return spark.createDataFrame(out, "segment string, seq long, offset long, length long, digest string")

    own = [(rows[k].digest, rows[k].length) for k in range(60)]
    hurt = own[:5] + own[6:9] + [("f" * 64, 11)] + own[10:30] + own[5:6] + own[30:40] + own[41:]
    states = {(r.page_id, r.seq, r.state) for r in warc.compare(man, laid(hurt)).collect() if r.state != "intact"}
    assert states == {(rows[5].page_id, 5, "moved"), (rows[9].page_id, 9, "lost"), (None, 8, "inserted"), (rows[40].page_id, 40, "lost")}


def test_drill_hashes_the_bytes_of_a_copy(spark):
    """Each kind of damage is there, read from bytes, and none condemns a whole record."""
    recs, man = archive(spark, 3000, 4096)
    first = recs.withColumn("record", F.concat("record", F.lit("changed")))
    assert {r.digest for r in warc.damaged_copy(first, man).collect()}.isdisjoint({r.digest for r in man.collect()})
    found = warc.compare(man, warc.damaged_copy(recs, man)).collect()
    own = [r for r in found if r.page_id is not None]
    assert len(own) == 3000 and all((r.state == "lost") == (r.digest[:2] in ("00", "01")) and r.state in ("lost", "intact") for r in own)
    extra = [r for r in found if r.page_id is None]
    inserted = sum(r.digest[:3] < "024" and r.digest[:2] == "02" for r in own)
    assert inserted and len(extra) == inserted + sum(r.digest < "01" or "018" <= r.digest < "02" for r in own)


def test_every_epoch_has_a_training_position(spark):
    docs = spark.createDataFrame([(3 * k + s, "w " * (1 + k % 4), f"s{s}") for s in range(3) for k in range(40)] + [(999, None, "s2")], "doc_id long, text string, source string")
    rows, folded = mixing.training_order(docs).collect(), {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert len(folded) == docs.count() and [r.position for r in rows] == sorted(r.position for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for d, r in folded.items():
        mine = by.get(d, [])
        assert r.taken == sum(x.taken for x in mine) and r.positions == [x.position for x in mine] and r.position == (mine[0].position if mine else None)
    # The heaviest source: its stream runs over the epochs without a gap up to its target, along its schedule.
    heavy = [r for r in rows if r.doc_id % 3 == 2]
    assert {r.epoch for r in heavy} == {0, 1} and abs(sum(r.taken for r in heavy) - heavy[0].target) <= 1
    at = 0
    for r in heavy:
        share = 0.5 * r.position + 0.5 * r.position**2  # the integral of 1 + 0.5 * (2t - 1)
        assert abs(share - at / r.target) < 1e-6
        at += r.taken
    assert max(r.position for r in heavy) > 0.97


MIT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
"""
GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version.\n"
BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", ";; ", "dnl "])
@pytest.mark.parametrize("width", [40, 72, 10_000])
def test_wrapped_licence_texts(mark, width):
    scanner = licenses.Scanner(licenses.SENTENCES, licenses.RULES, licenses.MAX_GAP)
    for text, want in ((MIT, ("mit-full", "MIT")), (GPL.format(3), ("gpl3-header", "GPL-3.0")), (GPL.format(2), ("gpl2-header", "GPL-2.0")), (BSD2, ("bsd2-full", "BSD-2-Clause")), (BSD3, ("bsd3-full", "BSD-3-Clause"))):
        for end in ("\n", "\r\n"):
            lines = [mark + x for line in text.split("\n") for x in (textwrap.wrap(line, width, break_on_hyphens=False) or [""])]
            n, found = scanner.recognise(end.join(["some text before", *lines, "some text after"]).encode())
            assert [m[:2] for m in scanner.match(found)] == [want], (text, mark, width)


def test_notices_on_single_lines_stay():
    scanner = licenses.Scanner(licenses.SENTENCES, licenses.RULES, licenses.MAX_GAP)
    n, found = scanner.recognise(b"words without an end\nAll rights reserved\nmore words\n\nlast")
    assert n == 4 and [m[0] for m in scanner.match(found)] == ["reserved"]
