"""The queries of this subpackage: each operator over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, licenses, line_dedup, prefix_trie, quality, rule_ensemble, runs, simhash, token_counts, token_file, toxicity, warc
from .common import documents


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(spark.read.parquet(f"{sf_dir}/pages.parquet"))).drop("block")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact columns of the report; the search behind them has the slop of op2_proximity."""
    return decontaminate.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("n_near_items", "near_items_sha256")


def op2_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report, with the items that occur within the slop."""
    return decontaminate.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    shared = byte_bpe.vocabulary(spark, _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return byte_bpe.round_trip(documents(spark, sf_dir), shared)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.decisions(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", F.size("removed").alias("n_removed"), F.concat_ws(",", F.col("removed").cast("array<string>")).alias("removed_lines"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(documents(spark, sf_dir))
    own = F.transform("found", lambda x: x["label"])
    at = F.col("base_places")
    return found.select(
        "doc_id", "n_words", F.size(at).cast("long").alias("n_base"), F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"),
        F.concat_ws(",", "base_labels").alias("base_labels"), F.concat_ws(",", F.array_sort(F.array_union("base_labels", own))).alias("labels"),
        F.when(F.size("found") > 0, 1.0).when(F.size(at) > 0, 0.5).otherwise(0.0).alias("score"),
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(documents(spark, sf_dir))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.write(documents(spark, sf_dir), _tokenizer("word_bpe_49k.json")).documents()


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.runs(documents(spark, sf_dir), runs.planted, keep_text=False))


def op12_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(spark.read.parquet(f"{sf_dir}/conversations.parquet"), prefix_trie.shared_turns(F.col("conv_id")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_derivatives": op1_warc_derivatives,
    "op2_decontamination": op2_decontamination,
    "op2_proximity": op2_proximity,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_line_dedup": op4_line_dedup,
    "op5_licenses": op5_licenses,
    "op6_quality": op6_quality,
    "op7_token_counts": op7_token_counts,
    "op8_toxicity": op8_toxicity,
    "op9_token_file": op9_token_file,
    "op10_simhash": op10_simhash,
    "op11_word_runs": op11_word_runs,
    "op12_rule_ensemble": op12_rule_ensemble,
    "op13_prefix_trie": op13_prefix_trie,
}

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP2 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS p
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
starts AS (SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS p
    FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT r, starts.n, i, item_id FROM starts JOIN win USING (n, p)),
hits AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM found) GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS s FROM found GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""

_BLANKS = "chr(9) || chr(13) || ' '"

_OP6 = f"""
WITH d AS (SELECT doc_id, source, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
win AS (SELECT r, i, array_to_string(list_slice(w, i, i + 7), ' ') AS p FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) > 8)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, p) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS k FROM twice) GROUP BY r),
lines AS (SELECT r, source, lower(trim(x, {_BLANKS})) AS line, length(x) AS chars FROM (SELECT r, source, unnest(l) AS x FROM w)),
freq AS (SELECT source, line, count(DISTINCT r) AS n FROM lines GROUP BY ALL HAVING count(DISTINCT r) >= 5),
hosts AS (SELECT source, count(*) AS n FROM d GROUP BY ALL),
bad AS (SELECT f.source, f.line FROM freq f JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source WHERE f.n > 50 OR f.n > 0.1 * h.n),
gone AS (SELECT r, sum(chars) AS n FROM lines JOIN bad ON lines.line = bad.line AND lines.source IS NOT DISTINCT FROM bad.source GROUP BY r),
total AS (SELECT r, sum(chars) AS n FROM lines GROUP BY r),
base AS (SELECT doc_id, w.r, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS removed_chars, coalesce(total.n, 0) AS chars
    FROM w LEFT JOIN rep USING (r) LEFT JOIN gone USING (r) LEFT JOIN total USING (r)),
failed AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_chars, NOT base_failed AND chars - removed_chars >= 0.5 * chars AS kept FROM failed
"""



def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


#: The rules of op1 written down again for RE2: what is hidden, tags that end a line, other tags; then blanks.
_STRIPPED = [
    (r"(?is)<(?:!--.*?(?:-->|\z)|script\b[^<>]*>.*?(?:</script\s*>|\z)|style\b[^<>]*>.*?(?:</style\s*>|\z)|noscript\b[^<>]*>.*?(?:</noscript\s*>|\z)|template\b[^<>]*>.*?(?:</template\s*>|\z))", " "),
    (r"(?i)</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|table|tr|td|th|h1|h2|h3|h4|h5|h6|pre|form|option|nav|main|header|footer|section|article|aside|address|blockquote|figure|figcaption|title)\b[^<>]*>", "\n"),
    (r"<[!/?A-Za-z][^<>]*>", ""),
]
_TIDIED = [(r"[ \t\r\f]+", " "), (r" ?\n(?: |\n)*", "\n"), (r"^(?: |\n)+", ""), (r"(?: |\n)+\z", "")]
_NAMED = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "pound": "£", "copy": "©", "laquo": "«", "reg": "®", "deg": "°", "middot": "·", "raquo": "»", "times": "×",
    "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "bull": "•", "hellip": "…", "euro": "€", "trade": "™",
}
_DIGITS = "^#([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"


def _warc_sql() -> str:
    def replaced(x: str, pairs: list[tuple[str, str]]) -> str:
        for pattern, by in pairs:
            x = f"regexp_replace({x}, {_text(pattern)}, {_text(by)}, 'g')"
        return x

    digits = f"regexp_extract(p, {_text(_DIGITS)}, 1)"
    point = f"CASE WHEN lower({digits})[1] = 'x' THEN CAST('0x' || {digits}[2:] AS BIGINT) ELSE TRY_CAST({digits} AS BIGINT) END"
    named = " ".join(f"WHEN starts_with(p, '{name};') THEN {_text(char)} || substr(p, {len(name) + 2})" for name, char in _NAMED.items())
    urn = lambda x: f"'<urn:uuid:' || regexp_replace(md5({x}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') || '>'"
    crlf = "chr(13) || chr(10)"
    return f"""
WITH r AS (SELECT page_id, url AS target_uri, '1970-01-01T00:00:00Z' AS date, coalesce(html, '') AS payload,
    {urn("'response|' || coalesce(CAST(page_id AS VARCHAR), '') || '|' || coalesce(url, '')")} AS refers_to,
    'Content-Type: text/html; charset=utf-8' || {crlf} || 'source-Content-Length: ' || strlen(coalesce(html, '')) AS source,
    'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} || 'Content-Length: ' || strlen(coalesce(html, '')) || {crlf} || {crlf} AS headers FROM pages),
s AS (SELECT *, {replaced("payload", _STRIPPED)} AS x FROM r),
n AS (SELECT *, string_split(x, '&') AS ps FROM s),
t AS (SELECT *, ps[1] || array_to_string(list_transform(ps[2:], lambda p: CASE WHEN {digits} <> '' THEN
    CASE WHEN {point} BETWEEN 1 AND 55295 OR {point} BETWEEN 57344 AND 1114111 THEN chr(CAST({point} AS INTEGER)) ELSE chr(65533) END || substr(p, length({digits}) + 3)
    {named} ELSE '&' || p END), '') AS y FROM n),
u AS (SELECT *, {replaced("y", _TIDIED)} AS text, {urn("'conversion|' || refers_to")} AS conversion_id, {urn("'metadata|' || refers_to")} AS metadata_id,
    'sha256:' || sha256(payload) AS source_payload_digest, 'sha256:' || sha256(headers || payload) AS source_block_digest FROM t),
v AS (SELECT *, 'source-' || source || {crlf} || 'source-payload-digest: ' || source_payload_digest || {crlf} || 'source-block-digest: ' || source_block_digest || {crlf}
    || 'title: ' || regexp_replace(trim(regexp_extract(payload, '(?i)<title\\b[^<>]*>([^<]*)<', 1)), '\\s+', ' ', 'g') || {crlf} || 'outlinks: ' || len(regexp_extract_all(payload, '(?i)<a\\s[^<>]*href\\s*=')) || {crlf}
    || 'text-characters: ' || length(text) || {crlf} AS fields FROM u)
SELECT page_id, 'conversion' AS record_type, conversion_id AS record_id, refers_to, metadata_id AS concurrent_to, target_uri, date, 'text/plain' AS content_type,
    CAST(strlen(text) AS BIGINT) AS content_length, 'sha256:' || sha256(text) AS block_digest, source_payload_digest, source_block_digest FROM v
UNION ALL SELECT page_id, 'metadata', metadata_id, refers_to, conversion_id, target_uri, date, 'application/warc-fields', CAST(strlen(fields) AS BIGINT), 'sha256:' || sha256(fields), source_payload_digest, source_block_digest FROM v
"""


def _license_sql() -> str:
    """Templates as regular expressions over the words, each with a space after it."""
    def expression(parts: list) -> str:
        out = ""
        for p in parts:
            if isinstance(p, bytes):
                out += f"{p.decode()} "
            elif isinstance(p, licenses.Var):
                out += f"(?:{p.match.replace('.', '[^ ]')} ){{{p.low},{p.high}}}"
            else:
                out += f"(?:{expression(p)})?"
        return out

    phrases = ", ".join(f"({_text(p)}, {_text(x)}, {len(p.split())})" for p, x in licenses.BASE.items())
    needed = lambda t: "[" + ", ".join(_text(w.decode()) for w in sorted(licenses.compile_template(t).needed)) + "]"
    templates = ", ".join(f"({_text(x)}, {_text('(^| )' + expression(licenses.parse(t)))}, {needed(t)})" for x, t in licenses.TEMPLATES.items())
    return f"""
WITH phrases(p, label, n) AS (VALUES {phrases}), templates(label, re, needed) AS (VALUES {templates}),
d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
base AS (SELECT r, label, unnest(list_filter(range(0, len(w) - n + 1), lambda i: array_to_string(w[i + 1:i + n], ' ') = p)) AS k FROM d, phrases),
b AS (SELECT r, count(*) AS n, min(k) AS first_word, max(k) AS last_word, list(DISTINCT label) AS labels FROM base GROUP BY r),
m AS (SELECT r, list(DISTINCT label) AS labels FROM d, templates
    WHERE CASE WHEN list_has_all(w, needed) THEN regexp_matches(array_to_string(w, ' ') || ' ', re) ELSE false END GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
    coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels, coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ','), '') AS labels,
    CASE WHEN m.labels IS NOT NULL THEN 1.0::DOUBLE WHEN b.n > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN m USING (r)
"""


#: CRC-32 of the decimal digits of c, bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda v, k: xor(v >> 1, (v & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT)"""

_OP13 = f"""
WITH raw AS (SELECT CAST(conv_id AS BIGINT) AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
keyed AS (SELECT *, md5(length(role) || ':' || role || text) AS t, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS w FROM raw),
own AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, t) AS o, t, w FROM keyed),
ids AS (SELECT c, c - c % 20 AS b, CAST({_CRC} % 4 AS BIGINT) AS h FROM (SELECT DISTINCT c FROM own)),
heads AS (SELECT ids.c, own.o, own.t, own.w FROM ids JOIN own ON own.c = ids.b AND own.o <= ids.h),
led AS (SELECT ids.c, h, count(heads.o) AS k FROM ids LEFT JOIN heads ON heads.c = ids.c GROUP BY ids.c, h),
turns AS (SELECT * FROM heads UNION ALL SELECT own.c, k + o - h, t, w FROM own JOIN led ON own.c = led.c WHERE o > h),
pre AS (SELECT c, o AS d, md5(string_agg(t, ',') OVER (PARTITION BY c ORDER BY o)) AS k, w FROM turns UNION ALL SELECT c, 0, '', 0 FROM ids),
linked AS (SELECT *, lag(k) OVER (PARTITION BY c ORDER BY d) AS up, max(d) OVER (PARTITION BY c) AS last FROM pre),
node AS (SELECT d, k, any_value(up) AS up, any_value(w) AS w, min(c) AS m, count(*) AS n, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE d = last) AS ends FROM linked GROUP BY d, k),
kids AS (SELECT d - 1 AS d, up AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
below AS (SELECT p.d, p.k, sum((x.n - 1) * x.w) AS saved, count(*) FILTER (WHERE kids.n IS NULL) AS leaves
    FROM node x LEFT JOIN kids ON kids.d = x.d AND kids.k = x.k JOIN pre p ON p.c = x.m AND p.d <= x.d GROUP BY p.d, p.k)
SELECT x.m AS conv_id, CAST(x.d AS BIGINT) AS depth, y.m AS parent_conv_id, x.n AS n_convs, CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
    CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(x.ends, '')) AS ends_sha256
FROM node x LEFT JOIN node y ON y.d = x.d - 1 AND y.k = x.up LEFT JOIN kids ON kids.d = x.d AND kids.k = x.k JOIN below ON below.d = x.d AND below.k = x.k
"""

ORACLE_SQL: dict[str, str] = {"op13_prefix_trie": _OP13, "op1_warc_derivatives": _warc_sql(), "op5_licenses": _license_sql(), "op6_quality": _OP6, "op2_decontamination": _OP2}
