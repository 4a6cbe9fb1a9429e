"""WARC derivatives: from each response record a linked metadata record and a plain-text conversion record.

Both refer to the response (WARC-Refers-To, target URI, date) and carry its payload digest; the metadata record lists the
source's status line, each of its headers, title, language and out-links, the conversion record the readable text, with
named and numeric character references spelt out. Identifiers are made from the source's, so a record made again has the
same name. All columns are expressions: one pass, no shuffle.

A null payload counts as empty: its conversion is empty and its digests are those of no bytes. A null URI stays null and
is left out of the header. A null http_header has no lines. A comment, script, title or tag without its end reaches to the page's
end, as in browsers; a link's address is found in front of any angle bracket within its tag. References to no character stay as they are. A repeated row
gives its two records again, under the same identifiers, as they are the same records; extra columns are not read.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import let

# Patterns of markup, in the dialect that Java and RE2 share.
# What has no end reaches to the page's end, so no place is passed twice, whatever the page.
DROPPED = "(?is)" + "|".join(rf"<{t}\b[^>]*(?:>.*?(?:</{t}\s*>|\z)|\z)" for t in ("script", "style", "noscript", "template")) + r"|<!--.*?(?:-->|\z)"
BLOCK_ENDS = r"(?i)<(br|/p|/div|/li|/h[1-6]|/tr|/article|/section|/title|/table|/ul|/ol|hr)\b[^>]*(?:>|\z)"
ANY_TAG = r"(?s)<[a-zA-Z/!?][^>]*(?:>|\z)"
TITLE = r"(?is)<title[^>]*(?:>(.*?)(?:</title|\z)|\z)"
FIRST_TAG, LANGUAGE = r"(?is)\A.*?<html\b([^>]*)", r"(?i)\blang=[\"']?([a-z-]+)"
LINK = r"(?i)<a\s[^<>]*?href=[\"']([^\"'<>\s]+)[\"']"
REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
#: Named references by the standard's table; a no-break space is read as a space.
NAMED = {name: chr(code) for name, code in sorted(name2codepoint.items())} | {"apos": "'", "nbsp": " "}


def _unescaped(text: Column) -> Column:
    """Character references spelt out, in one pass."""
    names = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])

    def one(reference: Column) -> Column:
        name = F.substring(reference, F.lit(2), F.length(reference) - 2)
        code = F.when(F.regexp_like(name, F.lit("^#[xX]")), F.conv(F.substring(name, F.lit(3), F.length(name)), 16, 10)).when(F.startswith(name, F.lit("#")), F.substring(name, F.lit(2), F.length(name))).cast("int")
        real = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        spelt = F.when(code == 160, F.lit(" ")).when(real, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        return F.coalesce(F.when(code.isNull(), F.try_element_at(names, name)).otherwise(spelt), reference)

    def whole(t: Column) -> Column:
        made = F.transform(F.regexp_extract_all(t, F.lit(REFERENCE), F.lit(0)), one)
        joined = F.array_join(F.zip_with(F.split(t, REFERENCE, -1), made, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
        return F.when(F.contains(t, F.lit("&")), joined).otherwise(t)

    return let(text, whole)


def _squeezed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[ \t\r\f]+", " "), r" ?\n[ \n]*", "\n"), r"^[ \n]+|[ \n]+$", "")


def plain_text(html: Column) -> Column:
    """Markup to text: scripts, styles and comments go, block ends become line ends, references are spelt out."""
    text = F.regexp_replace(html, DROPPED, " ")
    text = F.regexp_replace(F.regexp_replace(text, BLOCK_ENDS, "\n"), ANY_TAG, "")
    return _squeezed(_unescaped(text))


def record_urn(*parts: Column) -> Column:
    """A urn:uuid made from the parts."""
    h = F.sha2(F.concat_ws("|", *parts), 256)
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def _bytes(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", content_type: str = "text/html; charset=utf-8") -> DataFrame:
    """Pages (page_id, url, html) as response records: record_id, target_uri, date, content_type, http_header, payload."""
    payload = F.coalesce("html", F.lit(""))
    header = F.concat(F.lit(f"HTTP/1.1 200 OK\r\nContent-Type: {content_type}\r\nContent-Length: "), _bytes(payload).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(
        "page_id", record_urn(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit(""))).alias("record_id"),
        F.col("url").alias("target_uri"), F.lit(date).alias("date"), F.lit(content_type).alias("content_type"), header.alias("http_header"), payload.alias("payload"),
    )


def derivatives(records: DataFrame) -> DataFrame:
    """Two rows for each response: page_id, warc_type, record_id, refers_to, target_uri, date, content_type, content_length,
    block_digest, source_digest, block, and header (the record's WARC header block)."""
    source = _digest(F.col("payload"))
    title = _squeezed(_unescaped(F.regexp_replace(F.regexp_extract("payload", TITLE, 1), ANY_TAG, "")))
    links = F.regexp_extract_all("payload", F.lit(LINK), F.lit(1))
    lines = F.split(F.regexp_replace(F.coalesce("http_header", F.lit("")), r"(?<!\n)(\r\n)++$", ""), "\r\n")
    headers = F.transform(F.filter(F.slice(lines, F.lit(2), F.size(lines)), lambda x: F.contains(x, F.lit(":"))), lambda x: F.concat(F.lit("http-header-"), F.lower(F.substring_index(x, ":", 1)), F.regexp_extract(x, "(?s)(:.*)$", 1), F.lit("\r\n")))
    fields = F.concat(
        F.lit("http-status-line: "), lines[0], F.lit("\r\n"), F.array_join(headers, ""),
        F.lit("title: "), title, F.lit("\r\nlanguage: "), F.lower(F.regexp_extract(F.regexp_extract("payload", FIRST_TAG, 1), LANGUAGE, 1)),
        F.lit("\r\noutlinks: "), let(links, lambda found: F.concat(F.size(found).cast("string"), F.lit("\r\n"), F.array_join(F.transform(found, lambda x: F.concat(F.lit("outlink: "), x, F.lit("\r\n"))), ""))),
    )
    made = F.inline(
        F.array(
            F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
            F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), plain_text(F.col("payload")).alias("block")),
        )
    )
    rows = records.withColumn("source_digest", source).select("page_id", F.col("record_id").alias("refers_to"), "target_uri", "date", "source_digest", made)
    rows = rows.withColumns({"record_id": record_urn(F.col("warc_type"), F.col("refers_to")), "content_length": _bytes(F.col("block")), "block_digest": _digest(F.col("block"))})
    line = [("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"),
            ("WARC-Block-Digest", "block_digest"), ("WARC-Source-Digest", "source_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length")]
    header = F.concat(F.lit("WARC/1.1\r\n"), *[F.coalesce(F.concat(F.lit(f"{k}: "), F.col(c).cast("string"), F.lit("\r\n")), F.lit("")) for k, c in line], F.lit("\r\n"))
    return rows.select("page_id", "warc_type", "record_id", "refers_to", "target_uri", "date", "content_type", "content_length", "block_digest", "source_digest", "block", header.alias("header"))


def record_texts(made: DataFrame) -> DataFrame:
    """Whole records, ready to be written one after the other."""
    return made.select("page_id", "warc_type", "record_id", F.concat("header", "block", F.lit("\r\n\r\n")).alias("record"))
