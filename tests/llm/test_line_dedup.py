import random
from collections import Counter

import pyarrow as pa

from pacelake.llm import line_dedup
from pacelake.llm.components import components


def grams(norm):
    return {norm[i : i + line_dedup.SHINGLE] for i in range(max(1, len(norm) - line_dedup.SHINGLE + 1))}


def plain_decisions(rows):
    """Removed lines of each row, from all pairs of distinct lines, their shingles as strings."""
    places, of = [], {}
    for n, (doc_id, text) in sorted(enumerate(rows), key=lambda r: (r[1][0] is not None, r[1][0] or 0, r[0])):
        for k, line in enumerate((text or "").split("\n")):
            if norm := line_dedup.normal_form(line):
                places.append((n, k, norm))
                of.setdefault(norm, len(of))
    parent, sets = list(range(len(of))), list(map(grams, of))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for i, own in enumerate(sets):
        common = Counter(j for g in own for j in holders.get(g, ()))
        for j, n in common.items():
            if 5 * n >= 4 * (len(own) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for g in own:
            holders.setdefault(g, []).append(i)
    gone, seen = [[] for _ in rows], set()
    for n, k, norm in places:
        part = find(of[norm])
        if part in seen:
            gone[n].append(k)
        seen.add(part)
    return [sorted(g) for g in gone]


def found(docs):
    return sorted((r.doc_id, r.removed) for r in line_dedup.decisions(docs).collect())


def links_of(docs):
    lines = line_dedup.line_table(docs)
    near = line_dedup.candidates(lines)
    return line_dedup.links(near, line_dedup.forms(lines, near))


def test_whole_table_against_all_pairs(spark, sf, docs_of):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = plain_decisions(rows)
    assert sum(map(len, want)) > 100
    for limit in ("10m", "-1"):  # the candidates' forms by broadcast and by shuffle
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        assert found(docs_of([t for _, t in rows], [d for d, _ in rows])) == sorted((d, w) for (d, _), w in zip(rows, want, strict=True))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_large_bucket_in_shards_loses_no_link(spark, docs_of, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    base = [word() for _ in range(40)]
    texts = []
    for _ in range(120):
        w = list(base)
        w[rng.randrange(40)] = word()
        texts.append(" ".join(w))
    texts += [" ".join(word() for _ in range(40)) for _ in range(30)]
    want = list(enumerate(plain_decisions(list(enumerate(texts)))))
    for shard, block in ((4096, 8192), (16, 32)):
        monkeypatch.setattr(line_dedup, "SHARD", shard)
        monkeypatch.setattr(line_dedup, "BLOCK", block)
        assert found(docs_of(texts)) == want
    monkeypatch.undo()
    assert links_of(docs_of(texts)).count() < 12 * 150


def test_large_group_without_a_hub(spark, docs_of, monkeypatch):
    """Lines that share a beginning only, in a few chains: no pivot holds them all, and each shard meets all lines."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts = []
    for _ in range(12):
        w = [word() for _ in range(30)]
        for k in range(8):
            texts.append(" ".join(w))
            w[k * 3] = word()
    monkeypatch.setattr(line_dedup, "SHARD", 10)
    monkeypatch.setattr(line_dedup, "BLOCK", 16)
    lines = line_dedup.line_table(docs_of(texts))
    near = lines.where("norm is not null").selectExpr("1L as group", "line").distinct()
    got = components(line_dedup.links(near, line_dedup.forms(lines, near))).count()
    want = plain_decisions(list(enumerate(texts)))
    assert got == sum(map(len, want)) > 80


def test_edge_cases(spark, docs_of):
    line = "the very same line of some length"
    texts = [line, None, "", f"{line}\nshort\n{line.upper()}", line, line, "short\nshort", "y" * 200_000]
    ids = [4, 5, 6, 2, 9, 9, 8, None]
    docs = docs_of(texts, ids).withColumnRenamed("lang", "line_row")
    rows = sorted((str(r.doc_id), r.n_lines, r.removed) for r in line_dedup.decisions(docs).collect())
    assert rows == sorted([("4", 1, [0]), ("5", 1, []), ("6", 1, []), ("2", 3, [2]), ("9", 1, [0]), ("9", 1, [0]), ("8", 2, [0, 1]), ("None", 1, [])])
    out = line_dedup.deduplicated(docs)
    assert out.columns == docs.columns
    assert {(r.doc_id, r.text, r.n_chars) for r in out.where("doc_id < 7").collect()} == {(4, "", 0), (5, None, 0), (6, "", 0), (2, f"{line}\nshort", len(line) + 6)}
    assert line_dedup.decisions(docs_of([])).count() == 0


def test_of_repeated_rows_one_keeps_the_line(spark, docs_of):
    line = "the very same line of some length"
    assert found(docs_of([line, line, line], [1, 1, 2])) == [(1, []), (1, [0]), (2, [0])]
    out = line_dedup.deduplicated(docs_of([f"{line}\nx", f"{line}\nx", line], [1, 1, 2])).collect()
    assert sorted((r.doc_id, r.text) for r in out) == [(1, ""), (1, f"{line}\nx"), (2, "")]


def test_a_form_with_half_of_the_hash_in_common_is_left_alone(spark, docs_of, monkeypatch):
    monkeypatch.setattr(line_dedup, "xxh128_intdigest", lambda raw: (5 << 64) + len(raw))
    docs = docs_of(["the first line", "another line of text"])
    lines = list(line_dedup._lines(iter([pa.RecordBatch.from_pylist([{"row": i, "doc_id": i, "doc": i, "text": r.text} for i, r in enumerate(docs.collect())])])))
    assert [(r["line"] + (1 << 63), r["check"] + (1 << 63)) for b in lines for r in b.to_pylist() if r["line"] is not None] == [(5, 14), (5, 20)]


def test_short_lines_are_judged(spark, docs_of):
    texts = ["Read more\nthe first text", "READ  more\nthe second one\nContents", "contents\nseven77\nseven77", "Share this page\nRead more"]
    got = {r.doc_id: r.removed for r in line_dedup.decisions(docs_of(texts)).collect()}
    assert got == {0: [], 1: [0], 2: [0, 2], 3: [1]}


def test_bands_miss_few_pairs_at_the_limit():
    assert (1 - 0.8**line_dedup.ROWS) ** line_dedup.BANDS < 0.002
    rng, met, n = random.Random(3), 0, 0
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=40))
    while n < 4000:
        x = word() + word() + word()
        k = rng.randrange(20, 100)
        y = x[:k] + "".join(rng.choices("qrstuvwxyz", k=5)) + x[k:]
        a, b = grams(x), grams(y)
        if 0.8 <= len(a & b) / len(a | b) < 0.9:
            p, q = line_dedup.band_keys([x, y])
            n, met = n + 1, met + bool((p == q).any())
    assert met >= 0.995 * n, met / n
