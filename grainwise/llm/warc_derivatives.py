"""Metadata and plain-text records derived from WARC responses.

Each response gives two linked records: ``metadata`` (title, language, links, as
``name: value`` fields) and ``conversion`` (the page's text). Both refer to the response's
record id and carry its target, date, HTTP headers and payload digest. All of it is column
expressions over one scan, so nothing is shuffled.
"""

from __future__ import annotations

import json
from html.entities import html5, name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Comments and elements whose content is no text; what opens first hides the others.
HIDDEN = "(?is)<(?:!--.*?-->|" + "|".join(f"{tag}[ >].*?</{tag} *>" for tag in ("script", "style", "noscript", "template")) + ")"
BLOCK_TAG = r"(?i)</?(?:p|div|br|hr|li|ul|ol|tr|td|th|table|h[1-6]|nav|header|footer|article|section|aside|main|title|head|body|html|blockquote|pre|form|option|dd|dt|dl)\b[^>]*>"
#: A tag begins with a letter, a slash or a mark; any other ``<`` is text.
TAG = r"<[A-Za-z/!?][^>]*>"
#: The named character references of HTML that end in a semicolon, frequent ones first.
NAMED = {name: html5[f"{name};"] for name in dict.fromkeys(("amp", "lt", "gt", "quot", "apos", *name2codepoint, *(k[:-1] for k in html5 if k.endswith(";"))))}
#: Those that HTML reads without a semicolon too, longer ones first.
BARE = sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k))
#: Numeric references that do not mean their code point: 128 to 159 are those of Windows-1252.
NUMBERED = {"#0": "\ufffd", **{f"#{n}": c for n in range(128, 160) if (c := bytes([n]).decode("cp1252", "ignore"))}}
# Names first: a look-up goes through the table in order.
REFERENCES = {k: " " if c == "\xa0" else c for k, c in {**NAMED, **NUMBERED, "#160": " "}.items()}
REFERENCE = r"^(#0{0,24}[0-9]{1,7}|#[xX]0{0,24}[0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
BARE_REFERENCE = f"^({'|'.join(BARE)})"
CRLF = "\r\n"
#: Value of an attribute in double, single or no quotes.
VALUE = r"\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+))"
LANGUAGE = rf"(?i)<html(?=\s)[^>]*?\slang{VALUE}"
LINK = rf"(?i)<a(?=\s)[^>]*?\shref{VALUE}"


def decoded(text: Column, bare: bool = True) -> Column:
    """The text with every character reference as its character, no-break spaces as spaces.

    Named references of HTML and numeric ones, which end in a semicolon; with ``bare`` also
    the old names that HTML reads without one, as it does in text but not in addresses.
    Zero, surrogates and numbers beyond Unicode give U+FFFD, unknown names stay. A result is
    not decoded again.
    """
    table = F.from_json(F.lit(json.dumps(REFERENCES)), "map<string,string>")  # folded to a constant
    look_up = lambda key: F.try_element_at(table, F.nullif(key, F.lit("")))
    rest = lambda x, at: F.substr(x, F.length(at) + 1)

    def read(x: Column, i: Column) -> Column:
        """Only the beginning of a part can be a reference."""
        return F.struct(x.alias("x"), F.when(i > 0, F.regexp_extract(F.substring(x, 1, 48), REFERENCE, 1)).otherwise("").alias("ref"))

    def meant(p: Column) -> Column:
        ref = p["ref"]
        code = F.when(F.lower(F.substring(ref, 2, 1)) == "x", F.conv(F.substring(ref, 3, 99), 16, 10)).otherwise(F.substring(ref, 2, 99)).cast("bigint")
        valid = F.coalesce(look_up(F.concat(F.lit("#"), code.cast("string"))), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        numbered = F.when((code > 0x10FFFF) | code.between(0xD800, 0xDFFF), "\ufffd").otherwise(valid)
        return F.struct(p["x"].alias("x"), ref.alias("ref"), F.when(F.startswith(ref, F.lit("#")), numbered).otherwise(look_up(ref)).alias("c"))

    def shown(p: Column, i: Column) -> Column:
        known = F.when(i == 0, p["x"]).when(p["c"].isNotNull(), F.concat(p["c"], F.substr(p["x"], F.length(p["ref"]) + 2)))
        if bare:
            old = F.regexp_extract(F.substring(p["x"], 1, 48), BARE_REFERENCE, 1)
            known = F.coalesce(known, F.concat(look_up(old), rest(p["x"], old)))
        return F.coalesce(known, F.concat(F.lit("&"), p["x"]))

    return F.array_join(F.transform(F.transform(F.transform(F.split(text, "&"), read), meant), shown), "")


def plain_text(html: Column) -> Column:
    """Visible text: a line per block element, references decoded, runs of blanks as one, no empty lines."""
    shown = decoded(F.regexp_replace(F.regexp_replace(F.regexp_replace(html, HIDDEN, " "), BLOCK_TAG, "\n"), TAG, ""))
    for blank in "\t\r\f":
        shown = F.replace(shown, F.lit(blank), F.lit(" "))
    # Only what changes is matched: runs of two or more.
    shown = F.replace(F.regexp_replace(shown, "  +", " "), F.lit(" \n"), F.lit("\n"))
    return F.trim(F.regexp_replace(shown, r"\n[ \n]+", "\n"), F.lit(" \n"))


def record_id(*parts: Column) -> Column:
    """urn:uuid made from the SHA-256 of the parts: the same on every run."""
    h = F.sha2(F.concat_ws("\n", *parts), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(h.substr(a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def responses(pages: DataFrame, date: str, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """Response records from a table of fetched pages: key, record_id, target_uri, date, http_headers, payload, payload_digest.

    A NULL body is empty and a NULL url an empty target.
    """
    payload, target = F.coalesce(F.col(body), F.lit("")), F.coalesce(F.col(url), F.lit(""))
    headers = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(payload).cast("string"), F.lit(CRLF))
    return pages.select(
        F.col(key), record_id(F.lit("response"), F.col(key).cast("string"), target, payload).alias("record_id"), target.alias("target_uri"), F.lit(date).alias("date"), headers.alias("http_headers"), payload.alias("payload"), F.concat(F.lit("sha256:"), F.sha2(payload, 256)).alias("payload_digest")
    )


HEADER = ("record_id", "target_uri", "date", "http_headers", "payload_digest")


def derive(source: DataFrame, key: str = "page_id") -> DataFrame:
    """Two records per response, in the columns of a WARC header, and the block.

    Repeated responses give repeated records. Pages without title, language or links leave
    those fields out; a page without text gives an empty conversion block. Other columns of
    the source are not carried. Character references are decoded in text, title and links;
    line breaks in a title or link become spaces, as they would begin a field.
    """
    payload = F.col("payload")
    line = lambda x, bare=True: F.trim(F.regexp_replace(decoded(x, bare), r"[ \t\r\n]+", " "))
    # What is found ends with the value, whose own quote is not in it.
    quoted = lambda x, quote: F.rtrim(F.substring_index(x, quote, -2), F.lit(quote))
    value = lambda x: F.when(F.endswith(x, F.lit('"')), quoted(x, '"')).when(F.endswith(x, F.lit("'")), quoted(x, "'")).otherwise(F.regexp_extract(x, r"=\s*([^\s\"'=<>`]+)$", 1))
    links = F.transform(F.transform(F.regexp_extract_all(payload, F.lit(LINK), F.lit(0)), value), lambda x: F.when(x.rlike(r"[&\s]"), line(x, bare=False)).otherwise(x))
    # A select of its own: each is read more than once below.
    fields = {"__title": line(F.regexp_extract(payload, r"(?is)<title[^>]*>(.*?)</title", 1)), "__html": F.regexp_extract(payload, LANGUAGE, 0), "__links": links}
    source = source.select(F.col(key).alias("__key"), *HEADER, "payload", *(c.alias(name) for name, c in fields.items()))
    title, language, links = F.col("__title"), value(F.col("__html")), F.col("__links")
    field = lambda name, value: F.when(value != "", F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise("")
    outlinks = F.when(F.size(links) > 0, F.concat(F.lit("outlink: "), F.array_join(links, f"{CRLF}outlink: "), F.lit(CRLF))).otherwise("")
    made = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), F.concat(field("title", title), field("language", language), outlinks).alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain").alias("content_type"), plain_text(payload).alias("block")),
    )
    rows = source.select(F.col("__key").alias(key), F.col("record_id").alias("refers_to"), "target_uri", "date", F.col("http_headers").alias("source_headers"), F.col("payload_digest").alias("source_digest"), F.explode(made).alias("r"))
    return rows.select(key, record_id(F.col("r.record_type"), F.col("refers_to")).alias("record_id"), "r.record_type", "refers_to", "target_uri", "date", "r.content_type", "source_headers", "source_digest", F.concat(F.lit("sha256:"), F.sha2(F.col("r.block"), 256)).alias("block_digest"), F.octet_length("r.block").cast("long").alias("content_length"), "r.block")


def as_text(records: DataFrame) -> DataFrame:
    """Each record in WARC/1.0 form, in one string column ``value``, but for the last line break."""
    names = (("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("X-Source-Payload-Digest", "source_digest"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"))
    source = F.replace(F.regexp_replace("source_headers", r"\r\n$", ""), F.lit(CRLF), F.lit(f"{CRLF}X-Source-Header: "))
    lines = [F.lit("WARC/1.0"), *(F.concat(F.lit(f"{name}: "), F.col(c).cast("string")) for name, c in names), F.concat(F.lit("X-Source-Header: "), source), F.lit("")]
    return records.select(F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF), F.col("block"), F.lit(CRLF)).alias("value"))


def write_warc(records: DataFrame, path: str) -> None:
    """Gzipped WARC files, one per task."""
    as_text(records).write.option("compression", "gzip").option("lineSep", CRLF).text(path)
