"""WARC derivatives: metadata and plain-text conversion records of response records.

``responses`` wraps fetched pages as response records; ``derive`` turns each response into
a conversion record (the text of its HTML) and a metadata record (source headers, digests,
title, counts) that point at the response by WARC-Refers-To and at each other by
WARC-Concurrent-To.  Record ids follow from the source record's id and the record type, so
a rerun makes the same records and a repeated row repeats them.  ``serialised`` gives a
record's header and block as they stand in a WARC/1.1 file.

All of it is column expressions: a scan and a projection, no shuffle; every record is
as long as its page.

A tag ends at its >, or is none if another < comes first; a title ends at the next <.  So every pattern
reads a page once, whatever is left open in it.

Null payloads are empty payloads; null URIs stay null and leave their header lines out.
Comments, scripts, styles and templates go (an unclosed one up to the end), block tags
become line ends, other tags vanish; the entities of ``ENTITIES`` and numeric ones are
decoded once; blanks are collapsed and empty lines dropped.  Extra columns are not read; an
empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import let

#: Named entities and the characters they stand for.
ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "copy": "©", "reg": "®", "trade": "™", "middot": "·", "bull": "•",
    "hellip": "…", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»",
    "euro": "€", "pound": "£", "deg": "°", "times": "×", "amp": "&",
}
#: Tags whose contents are no text, and tags that end a line.
HIDDEN = ("script", "style", "noscript", "template")
BLOCKS = ("address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "figcaption", "figure", "footer", "form", "h[1-6]", "header", "hr", "li", "main", "nav", "ol", "option", "p", "pre", "section", "table", "td", "th", "title", "tr", "ul")
#: Patterns that both Java's and RE2's regular expressions read alike, with what replaces them.
_GONE = "|".join([r"!--.*?(?:-->|\z)", *(rf"{t}\b[^<>]*>.*?(?:</{t}\s*>|\z)" for t in HIDDEN)])
STRIP = [(rf"(?is)<(?:{_GONE})", " "), (rf"(?i)</?(?:{'|'.join(BLOCKS)})\b[^<>]*>", "\n"), (r"<[a-zA-Z/!?][^<>]*>", "")]
TIDY = [(r"[ \t\r\f]{2,}|[\t\r\f]", " "), (r" ?\n[ \n]*", "\n"), (r"^[ \n]+|[ \n]+\z", "")]
#: A numeric reference behind its &, with or without x for hexadecimal.
NUMERIC = r"^#([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"
TITLE = r"(?i)<title\b[^<>]*>([^<]*)<"
#: The date of records whose source names none.
NO_DATE = "1970-01-01T00:00:00Z"


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for pattern, by in pairs:
        text = F.regexp_replace(text, pattern, by)
    return text


def _decoded(text: Column) -> Column:
    """Named and numeric character references, each once: what follows an & up to its semicolon."""
    def one(piece: Column) -> Column:
        name, digits = F.substring_index(piece, ";", 1), F.regexp_extract(piece, NUMERIC, 1)
        point = F.when(digits.startswith("x") | digits.startswith("X"), F.conv(F.substring(digits, 2, 8), 16, 10)).otherwise(digits).cast("long")
        valid = ((point > 0) & (point < 0xD800)) | ((point > 0xDFFF) & (point < 0x110000))
        number = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")).otherwise("\ufffd")
        out = F.when(~piece.contains(";"), F.concat(F.lit("&"), piece)).when(piece.startswith("#"), F.when(digits == "", F.concat(F.lit("&"), piece)).otherwise(F.concat(number, F.substr(piece, F.length(digits) + 3))))
        for entity, char in ENTITIES.items():
            out = out.when(name == entity, F.concat(F.lit(char), F.substr(piece, F.lit(len(entity) + 2))))
        return out.otherwise(F.concat(F.lit("&"), piece))

    return let(F.split(text, "&"), lambda p: F.concat(F.get(p, F.lit(0)), F.array_join(F.transform(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), one), "")))


def text_of(html: Column) -> Column:
    """Plain text of an HTML page."""
    return _replaced(_decoded(_replaced(html, STRIP)), TIDY)


def urn(*parts: Column) -> Column:
    """A record id that follows from its parts."""
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def responses(pages: DataFrame, date: str = NO_DATE) -> DataFrame:
    """Response records of pages (page_id, url, html): record_id, target_uri, date, http_headers, payload, digests."""
    html = F.coalesce("html", F.lit(""))
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), urn(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit(""))).alias("record_id"),
        F.col("url").alias("target_uri"), F.lit(date).alias("date"), headers.alias("http_headers"), html.alias("payload"),
        digest(html).alias("payload_digest"), digest(F.concat(headers, html)).alias("block_digest"),
    )


def derive(records: DataFrame) -> DataFrame:
    """Two rows for each response record: its conversion and its metadata record."""
    text = text_of(F.col("payload"))
    made = records.select("page_id", "record_id", "target_uri", "date", "http_headers", "payload_digest", "block_digest", text.alias("text"), F.trim(F.regexp_extract("payload", TITLE, 1)).alias("title"), F.regexp_count("payload", F.lit(r"(?i)<a\s[^<>]*href\s*=")).alias("links"))
    made = made.withColumn("conversion_id", urn(F.lit("conversion"), F.col("record_id"))).withColumn("metadata_id", urn(F.lit("metadata"), F.col("record_id")))
    source = F.replace(F.rtrim(F.regexp_replace("http_headers", r"^[^\r\n]*\r\n", "")), F.lit("\r\n"), F.lit("\r\nsource-"))
    source = F.regexp_replace(source, r"(\r\nsource-)*$", "")
    fields = F.concat(
        F.lit("source-"), source, F.lit("\r\nsource-payload-digest: "), F.col("payload_digest"), F.lit("\r\nsource-block-digest: "), F.col("block_digest"),
        F.lit("\r\ntitle: "), F.regexp_replace("title", r"\s+", " "), F.lit("\r\noutlinks: "), F.col("links").cast("string"),
        F.lit("\r\ntext-characters: "), F.char_length("text").cast("string"), F.lit("\r\n"),
    )
    def record(kind: str, own: str, other: str, mime: str, block: Column) -> Column:
        return F.struct(F.lit(kind).alias("record_type"), F.col(own).alias("record_id"), F.col("record_id").alias("refers_to"), F.col(other).alias("concurrent_to"), F.lit(mime).alias("content_type"), block.alias("block"))

    both = F.array(record("conversion", "conversion_id", "metadata_id", "text/plain", F.col("text")), record("metadata", "metadata_id", "conversion_id", "application/warc-fields", fields))
    out = made.select("page_id", "target_uri", "date", F.col("payload_digest").alias("source_payload_digest"), F.col("block_digest").alias("source_block_digest"), F.explode(both).alias("r"))
    return out.select("page_id", "r.record_type", "r.record_id", "r.refers_to", "r.concurrent_to", "target_uri", "date", "r.content_type", F.octet_length("r.block").cast("long").alias("content_length"), digest(F.col("r.block")).alias("block_digest"), "source_payload_digest", "source_block_digest", "r.block")


def serialised(records: DataFrame) -> DataFrame:
    """page_id, record_type, record_id and the whole record as it stands in a WARC/1.1 file."""
    line = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(c).cast("string"), F.lit("\r\n"))).otherwise("")
    names = {"WARC-Type": "record_type", "WARC-Record-ID": "record_id", "WARC-Refers-To": "refers_to", "WARC-Concurrent-To": "concurrent_to", "WARC-Target-URI": "target_uri", "WARC-Date": "date", "WARC-Block-Digest": "block_digest", "Content-Type": "content_type", "Content-Length": "content_length"}
    head = F.concat(F.lit("WARC/1.1\r\n"), *(line(n, c) for n, c in names.items()), F.lit("\r\n"))
    return records.select("page_id", "record_type", "record_id", F.concat(head, F.col("block"), F.lit("\r\n\r\n")).alias("record"))
