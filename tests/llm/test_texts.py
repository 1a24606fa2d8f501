"""WARC derivatives, decontamination, licenses, quality rules: SQL, brute force and edge cases."""

import html
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from pacelake.llm import decontaminate, licenses, quality, queries, warc
from pacelake.llm.common import words_of


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_duckdb(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf).toArrow(), con.execute(queries.ORACLE_SQL[name]).to_arrow_table()
    names = sorted(want.column_names)
    assert sorted(got.column_names) == names
    assert sorted(repr(list(r.values())) for r in got.select(names).to_pylist()) == sorted(repr(list(r.values())) for r in want.select(names).to_pylist())


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, text string")


def test_warc_records_link_up(spark):
    src = pages(spark, [(1, "http://a/x", "<title>T &amp; t</title><p>One<br>two &lt;b&gt; &#233;&#x41;&#0; &amp;lt;</p><script>no()</script><!-- c --><a href='x'>y</a>", "clash"), (2, None, None, None), (None, "u", "", "")])
    records = warc.responses(src)
    ids = {r.record_id: r for r in records.collect()}
    assert len(ids) == 3
    rows = warc.derive(records).collect()
    assert len(rows) == 6
    by = {r.record_id: r for r in rows}
    for r in rows:
        source = ids[r.refers_to]
        assert by[r.concurrent_to].concurrent_to == r.record_id and by[r.concurrent_to].record_type != r.record_type
        assert (r.source_payload_digest, r.source_block_digest) == (source.payload_digest, source.block_digest)
        assert r.content_length == len(r.block.encode())
        if r.record_type == "metadata":
            assert source.payload_digest in r.block and "source-Content-Type: text/html; charset=utf-8\r\n" in r.block
    text = {r.page_id: r.block for r in rows if r.record_type == "conversion"}
    assert text[1] == "T & t\nOne\ntwo <b> éA� &lt;\n y" or text[1].startswith("T & t\nOne\ntwo <b> éA� &lt;")
    assert text[2] == "" and text[None] == ""
    whole = [r.record for r in warc.serialised(warc.derive(records)).collect()]
    assert all(x.startswith("WARC/1.1\r\nWARC-Type: ") and x.endswith("\r\n\r\n") for x in whole)
    assert sum("WARC-Target-URI" in x for x in whole) == 4
    assert warc.derive(warc.responses(pages(spark, []))).count() == 0


@pytest.mark.parametrize("piece", ["<a", "<script", "<title>", "<a href ", "</div", "<!--", "&#x", "<p> \n", "</script "])
def test_whatever_is_left_open_a_long_page_is_read_once(spark, piece):
    src = pages(spark, [(1, "u", piece * (1_000_000 // len(piece)), "")])
    began = time.monotonic()
    assert warc.derive(warc.responses(src)).count() == 2
    assert warc.derive(warc.responses(src)).agg(F.sum("content_length")).first()[0] >= 0
    assert time.monotonic() - began < 20


def test_repeated_pages_repeat_their_records(spark):
    out = warc.derive(warc.responses(pages(spark, [(1, "u", "<p>x <a b <i>y</i>", "")] * 2))).collect()
    assert len(out) == 4 and len({tuple(r) for r in out}) == 2
    assert {r.block for r in out if r.record_type == "conversion"} == {"x <a b y"}


def test_entities_like_the_standard_library(spark):
    for name, char in warc.ENTITIES.items():
        assert html.unescape(f"&{name};") == char
    x = "caf&#233; &#x1F642; &#55296; a&#b &#12345678901;"
    assert spark.range(1).select(warc.text_of(F.lit(x)).alias("t")).first().t == "café 🙂 � a&#b &#12345678901;"


def plain_near(w, p, slop):
    """Whether places of the words of p ascend in w, each within the slop of a common start and its offset."""
    for s in range(-slop, len(w) + slop):
        reached = {-1}
        for i, word in enumerate(p):
            reached = {x for x in range(max(0, s + i - slop), min(len(w), s + i + slop + 1)) if w[x] == word and any(y < x for y in reached)}
            if not reached:
                break
        if reached:
            return True
    return False


def plain_hits(text, items, slop=2):
    w = words_of(text)
    known = set(w)
    hit, found, near = set(), set(), set()
    for item, phrase in items:
        for p in decontaminate.windows(phrase):
            if not known.issuperset(p):
                continue
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    hit |= set(range(i, i + len(p)))
                    found.add(item)
            if item not in near and plain_near(w, p, slop):
                near.add(item)
    return len(w), len(hit), sorted(found), sorted(near)


def test_decontamination_against_brute_force(spark, docs_of, monkeypatch):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(str(i), " ".join(rng.choices(vocabulary, k=rng.randrange(1, 14)))) for i in range(20)] + [("x", None), ("y", "...")]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(60))) for _ in range(30)] + [None, "", "w1 " * 50_000]
    texts += [f"A {items[3][1].upper()}! {items[4][1]}", items[5][1], items[5][1]]
    bench = spark.createDataFrame(items + [(None, "w1")], "item_id string, text string")
    index = decontaminate.build(docs_of(texts))
    want = {i: plain_hits(t, [x for x in items if x[1]]) for i, t in enumerate(texts)}
    assert any(len(x[3]) > len(x[2]) for x in want.values())
    for words in (2_000_000, 40):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", words)
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.near_items) for r in decontaminate.search(index, bench, slop=0).collect()}
        assert got == {i: (*x[:3], x[2]) for i, x in want.items()}
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.near_items) for r in decontaminate.search(index, bench).collect()}
        assert got == want
    repeated = decontaminate.search(decontaminate.build(docs_of([items[5][1]] * 3, [7, 7, None])), bench, slop=0).collect()
    assert sorted(map(str, (r.doc_id for r in repeated))) == ["7", "7", "None"] and len({(r.n_hit, str(r["items"])) for r in repeated}) == 1
    assert decontaminate.report(docs_of([]), bench).count() == 0
    assert {r.n_hit for r in decontaminate.report(docs_of(["a b"]), spark.createDataFrame([], "item_id string, text string")).collect()} == {0}


def test_proximity_and_spans(spark, docs_of):
    bench = spark.createDataFrame([("q", "a b c d")], "item_id string, text string")
    index = decontaminate.build(docs_of(["a b c d", "z a x b c d", "a x x x x b c d", "d c b a", "c d", "a b"]))
    rows = {(r.doc_id, r.item_id, r.start, r.end, r.exact) for r in decontaminate.matches(index, bench, slop=1).collect()}
    assert (0, "q", 0, 4, True) in rows
    assert {r[0] for r in rows} == {0, 1} and not any(r[4] for r in rows if r[0] == 1)
    near = {r.doc_id: r.near_items for r in decontaminate.search(index, bench, slop=1).collect()}
    assert near == {0: ["q"], 1: ["q"], 2: [], 3: [], 4: [], 5: []}


def test_no_layout_changes_a_proximity_match(spark, docs_of):
    """Whatever else a segment holds: each word has one place of its own, and order counts."""
    texts = ["a x b c x d", "a a a", "c c c", "d d d", "b a d c", "a b c d"]
    bench = spark.createDataFrame([("q", "a b c d"), ("r", "a a a a")], "item_id string, text string")
    for parts in (1, 6):
        got = {r.doc_id: r.near_items for r in decontaminate.search(decontaminate.build(docs_of(texts).repartition(parts, "doc_id")), bench, slop=1).collect()}
        assert got == {i: plain_hits(t, [("q", "a b c d"), ("r", "a a a a")], slop=1)[3] for i, t in enumerate(texts)} == {0: ["q"], 1: [], 2: [], 3: [], 4: [], 5: ["q"]}


def test_whole_table_in_one_and_many_partitions(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(str(r.item_id), r.text) for r in bench.collect()]
    want = {r.doc_id: plain_hits(r.text, items) for r in docs.collect()}
    for parts in (1, 64):
        got = decontaminate.search(decontaminate.build(docs.repartition(parts)), bench).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r["items"], r.near_items) for r in got} == want


def test_report_and_query_run_the_proximity_search(spark, sf, docs_of):
    item = "the quick brown fox jumps over the lazy dog today"
    bench = spark.createDataFrame([("q", item)], "item_id string, text string")
    got = {r.doc_id: r for r in decontaminate.report(docs_of([f"so {item} indeed", item.replace("over", "right over"), item.replace("over", "a b c d e over"), "the dog", item.replace("over", "a b c over")]), bench).collect()}
    assert [(got[i].n_items, got[i].n_near_items, got[i].n_hit, got[i].contaminated) for i in range(4)] == [(1, 1, 10, True), (0, 1, 0, False), (0, 0, 0, False), (0, 0, 0, False)]
    assert (got[4].n_items, got[4].n_near_items) == (0, 1)  # two places before a start and one behind it
    assert got[1].near_items_sha256 == got[0].items_sha256 != got[2].near_items_sha256
    rows = queries.QUERIES["op2_proximity"](spark, sf).collect()
    assert all(r.n_near_items >= r.n_items for r in rows) and any(r.n_near_items for r in rows)


def test_long_phrases_keep_their_slop_within_documents(spark, docs_of):
    words = [f"w{i}" for i in range(63)]
    put_in = words[:30] + ["x"] + words[30:]
    bench = spark.createDataFrame([("q", " ".join(words))], "item_id string, text string")
    index = decontaminate.build(docs_of([" ".join(put_in), " ".join(words[:60]), " ".join(words[60:])]).coalesce(1))
    got = {r.doc_id: (r["items"], r.near_items) for r in decontaminate.search(index, bench, size=63).collect()}
    assert got == {0: ([], ["q"]), 1: ([], []), 2: ([], [])}
    short = spark.createDataFrame([("r", "z1 z2")], "item_id string, text string")
    apart = decontaminate.build(docs_of(["z1", "z2"]).coalesce(1))
    assert [r.near_items for r in decontaminate.search(apart, short, slop=31).collect()] == [[], []]


@pytest.mark.parametrize(
    ("template", "text", "spans"),
    [
        ("a b <<beginOptional>>c <<endOptional>>d", "x a b d a b c d a b c c d", [(1, 4), (4, 8)]), ("a <<var;name=\"v\";match=\"[0-9]+\";words=\"1-2\">> z", "a 1 z a 1 2 z a x z a z a 1 2 3 z", [(0, 3), (3, 7)]),
        ("<<beginOptional>>x <<beginOptional>>y <<endOptional>><<endOptional>>a", "x y a y a x a", [(0, 3), (4, 5), (5, 7)]), ("a b", "A, b! a c b", [(0, 2)]),
    ],
)
def test_template_automata(template, text, spans):
    words = words_of(text)
    assert licenses.compile_template(template).matches(words, set(words)) == spans


def test_broken_templates_are_refused():
    for t in ("<<beginOptional>>a", "a<<endOptional>>", "<<var;name=\"v\";match=\".+\";words=\"1-2\">> a", "<<beginOptional>>a<<endOptional>>"):
        with pytest.raises(ValueError):
            licenses.compile_template(t)


def test_license_scan_edge_cases(spark, docs_of):
    texts = [None, "", "Released under the MIT License.", "the Apache License", "GNU GENERAL public license; cc by", "x " * 60_000 + "cc by"]
    got = {r.doc_id: (r.n_words, r.base_places, r.base_labels, [f.label for f in r.found]) for r in licenses.scan(docs_of(texts)).collect()}
    assert got == {0: (0, [], [], []), 1: (0, [], [], []), 2: (5, [3], ["mit"], ["MIT"]), 3: (3, [1], ["apache"], []), 4: (6, [0, 4], ["cc-by", "gpl"], []), 5: (60_002, [60_000], ["cc-by"], [])}
    assert licenses.scan(docs_of([])).count() == 0


def test_licenses_need_their_whole_wording(spark, docs_of):
    grant = licenses._MIT_GRANT
    notice = "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    end = licenses._MIT_DISCLAIMER.replace("<<beginOptional>>NONINFRINGEMENT<<endOptional>><<beginOptional>>NON-INFRINGEMENT<<endOptional>>", "NONINFRINGEMENT").replace(licenses._HOLDER, "THE AUTHORS OR COPYRIGHT HOLDERS")
    bsd, bsd_end = (x.replace("<<beginOptional>>", "").replace("<<endOptional>>", "").replace(licenses._HOLDER, "THE COPYRIGHT HOLDERS AND CONTRIBUTORS") for x in (licenses._BSD_CONDITIONS, licenses._BSD_DISCLAIMER))
    gpl = "This work is licensed under the GNU General Public License, version 3"
    free = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, {}."
    cases = [
        (grant, []), (f"{grant}, {notice} {end}", ["MIT-text"]), (f"{grant}. {end}", ["MIT-0-text"]), (f"{grant}, {notice} The Software shall be used for Good, not Evil. {end}", ["JSON-text"]),
        (f"{grant}, {notice} {end} Except as contained in this notice, the name of the X Consortium shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from the X Consortium.", ["X11-text"]),
        (f"{grant}, {notice} The name may not be used. {end}", []), (f"{gpl}.", ["GPL-3.0-only"]), (f"{gpl}. Or so", ["GPL-3.0-only"]), (f"{gpl} or later.", ["GPL-3.0-or-later-name"]), (f"{gpl}, or (at your option) any later version.", ["GPL-3.0-or-later-name"]), (f"{gpl} or newer", []),
        (free.format("General Public License", "either version 3 of the License, or (at your option) any later version"), ["GPL-3.0-or-later"]), (free.format("General Public License", "version 2 of the License"), ["GPL-2.0-only-notice"]), (free.format("Lesser General Public License", "either version 2.1 of the License, or any later version"), ["LGPL-2.1-or-later"]),
        (f"{bsd} {bsd_end}", ["BSD-2-Clause-text"]), (f"{bsd} 3. Neither the name of the holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {bsd_end}", ["BSD-3-Clause-text"]), (bsd, []),
        ("Licensed under CC BY 4.0.", ["CC-BY-4.0"]), ("Licensed under CC BY-SA 4.0.", ["CC-BY-SA-4.0"]), ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]), ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["CC-BY-SA-4.0-name"]),
    ]
    got = {r.doc_id: [f.label for f in r.found] for r in licenses.scan(docs_of([t for t, _ in cases])).collect()}
    assert got == {i: labels for i, (_, labels) in enumerate(cases)}


def test_a_line_is_judged_alike_in_small_and_large_hosts(spark, docs_of):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    def removed(n, with_line):
        docs = docs_of([f"{own(i)}" + "\nread on in the app" * (i < with_line) for i in range(n)])
        return quality.rules(docs).where("removed_chars > 0").count()

    assert removed(20, 4) == 0 and removed(20, 5) == 5 and removed(20, 20) == 20  # a share, from FEW_DOCS on
    assert removed(400, 40) == 0 and removed(400, 41) == 41
    assert removed(3000, 50) == 0 and removed(3000, 51) == 51  # an absolute count, whatever the share


def plain_repeats(words):
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    return len({k for at in seen.values() if len(at) > 1 for i in at for k in range(i, i + 8)})


def test_quality_rules(spark, docs_of):
    rng = random.Random(9)
    own = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    footer = "Subscribe to our newsletter and follow us everywhere you like today"
    texts = [f"{own(60)}\n{footer}" for _ in range(60)] + [f"{own(21)}\n" + "\n".join([footer] * 4)] + [own(5), None, "", "a b c d e f g h " * 30, own(30) + "\nx\nx\n\n \n", own(40) + "\t\v " + own(3) + " # $ |", "w " * 50_000]
    docs = docs_of(texts).withColumnRenamed("lang", "hash")
    got = {r.doc_id: r for r in quality.rules(docs, with_text=True).collect()}
    for i, t in enumerate(texts):
        words = [w for w in (t or "").replace("\t", " ").replace("\v", " ").replace("\n", " ").split(" ") if w]
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\r\v\f")]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), plain_repeats(words)), i
        assert (r.n_symbols, r.n_dup_lines) == (sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)))
        assert footer not in r.text
    assert all(got[i].kept for i in range(60)) and all(got[i].removed_chars == len(footer) for i in range(60))
    assert not got[60].kept and (got[60].base_failed or got[60].removed_chars == 4 * len(footer))
    assert [got[i].base_failed for i in range(61, 65)] == [True] * 4
    assert quality.rules(docs_of([])).count() == 0
    nulls = spark.createDataFrame([(None, None, None)], "doc_id long, text string, source string")
    assert [(r.doc_id, r.n_words, r.kept) for r in quality.rules(nulls).collect()] == [(None, 0, False)]
