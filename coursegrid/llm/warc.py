"""WARC derivatives: each response becomes a metadata record and a plain-text conversion record that refer to it.

`responses` shapes crawled pages into response records. `derive` turns response records into the two derived kinds:
both carry `WARC-Refers-To` with the response's identifier, its target address, date and payload digest and its source
headers; each has an identifier and digests of its own, and the metadata record names the conversion record
(`WARC-Concurrent-To`, which the format does not allow on conversions). `serialized` gives the bytes of a record as they stand in a WARC file, and
`write` writes Parquet of records or, through Spark's text writer, files of records.

One scan and one projection: a response's records come from its own row, so nothing is shuffled.

Defined cases: a null or empty payload gives an empty text with its digest; a null address or header block is left out of the
record; a null date becomes the stated `undated`, as every record needs one; an entity of no known name stays as it is, a number
that is no character becomes U+FFFD; a null response id gets an identifier made from the row's address and payload; repeated rows
give repeated, equal records; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
#: The date of records whose capture time is not known.
UNDATED = "1970-01-01T00:00:00Z"
# Elements whose content is no text, and elements that end a line.
SILENT = ("script", "style", "noscript", "template", "head")
BREAKING = (
    "address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr html li main nav ol option p pre section table tbody td tfoot th thead tr ul"
).split()
ENTITY = "&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
#: The named entities of HTML 4 and `&apos;`; a blank that does not break is a blank here.
NAMED = {f"&{name};": chr(code) for name, code in name2codepoint.items()} | {"&apos;": "'", "&nbsp;": " "}

TITLE = "(?is)<title[^>]*>(.*?)</title\\s*>"
LANGUAGE = "(?is)<html[^>]*?\\slang\\s*=\\s*[\"']?([A-Za-z0-9-]+)"
LINK = "(?i)<a\\s[^>]*?href\\s*=\\s*[\"']?[^\"'\\s>]"


def silent() -> str:
    """Comments and silent elements, in one pass from left to right."""
    return "(?is)<!--.*?-->" + "".join(f"|<{n}(?:\\s[^>]*)?>.*?</{n}\\s*>" for n in SILENT)


#: Runs of white space other than a single blank.
FOLDED = "[\\r\\n\\t][\\r\\n\\t ]*| [\\r\\n\\t ]+"
BREAKS = f"(?i)</?(?:{'|'.join(BREAKING)})(?:[\\s/][^>]*)?>"
TAGS = "</?[A-Za-z!][^>]*>"


def stripped(html: Column) -> Column:
    """A page without markup, its entities as they were."""
    text = html
    for pattern, value in ((silent(), ""), (FOLDED, " "), (BREAKS, "\n"), (TAGS, "")):
        text = F.regexp_replace(text, pattern, value)
    return text


def lines(text: Column) -> Column:
    """Text lines of a stripped page: entities resolved once, blanks folded, empty lines left out.

    The text is looked at several times, so it is to be a column of its own and not a longer expression.
    """
    text = F.when(F.contains(text, F.lit("&")), resolved(text)).otherwise(text)
    for pattern, value in ((" *\\n[ \\n]*", "\n"), (" {2,}", " ")):
        text = F.regexp_replace(text, pattern, value)
    return F.btrim(text, F.lit(" \n"))


def resolved(text: Column) -> Column:
    """The text with its entities resolved once, named and numeric ones."""
    named = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])

    def value(entity: Column) -> Column:
        hexadecimal = F.lower(F.substring(entity, 3, 1)) == "x"
        digits = F.regexp_replace(entity, "[&#xX;]", "")
        code = F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(digits).cast("int")
        bad = (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
        code = F.when(bad, 0xFFFD).when(code == 0xA0, 0x20).otherwise(code)
        numeric = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(F.startswith(entity, F.lit("&#")), numeric).otherwise(F.coalesce(named[entity], entity))

    gaps, hits = F.split(text, ENTITY, -1), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))
    return F.array_join(F.zip_with(gaps, hits, lambda gap, hit: F.concat(gap, F.coalesce(value(hit), F.lit("")))), "")


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def identifier(*parts: Column) -> Column:
    """A stable record identifier: the first 32 hex digits of a hash of the parts in the form of a UUID."""
    h = F.sha2(F.concat_ws("\n", *parts), 256)
    pieces = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces), F.lit(">"))


def responses(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date_col: str | None = None
) -> DataFrame:
    """Response records of crawled pages, which come without HTTP headers: a plain status line stands for them.

    `date_col` has the capture time as the format writes it, like `2024-01-31T12:00:00Z`; without one it is not known.
    """
    date = F.lit(None) if date_col is None else F.col(date_col)
    html = F.coalesce(F.col(html_col), F.lit(""))
    return pages.select(
        F.col(id_col).alias("source_id"),
        identifier(F.lit("response"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(url_col), F.lit("")), digest(html)).alias("record_id"),
        F.col(url_col).alias("target_uri"),
        date.cast("string").alias("date"),
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8").alias("http_headers"),
        html.alias("payload"),
        digest(html).alias("payload_digest"),
    )


def _fields(pairs: list[tuple[str, Column]]) -> Column:
    """`Name: value` lines; a null value leaves its line out, line ends inside a value become blanks."""
    return F.concat_ws(CRLF, *[F.concat(F.lit(f"{n}: "), F.regexp_replace(v.cast("string"), "[\\r\\n]+", " ")) for n, v in pairs])


def derive(records: DataFrame, undated: str = UNDATED) -> DataFrame:
    """Two rows per response record: `metadata` and `conversion`."""
    payload = F.coalesce(F.col("payload"), F.lit(""))
    base = records.select(
        "source_id",
        F.coalesce(
            F.col("record_id"), identifier(F.lit("response"), F.coalesce("target_uri", F.lit("")), payload)
        ).alias("refers_to"),
        "target_uri",
        F.coalesce("date", F.lit(undated)).alias("date"),
        "http_headers",
        F.coalesce("payload_digest", digest(payload)).alias("payload_digest"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        stripped(payload).alias("stripped"),
        F.trim(F.regexp_replace(F.regexp_extract(payload, TITLE, 1), "\\s+", " ")).alias("title"),
        F.lower(F.regexp_extract(payload, LANGUAGE, 1)).alias("lang"),
        F.regexp_count(payload, F.lit(LINK)).cast("long").alias("n_links"),
    ).withColumns(
        {
            "body": lines(F.col("stripped")),
            "meta_id": identifier(F.lit("metadata"), F.col("refers_to")),
            "text_id": identifier(F.lit("conversion"), F.col("refers_to")),
        }
    )
    about = _fields(
        [
            ("title", F.nullif("title", F.lit(""))),
            ("languages", F.nullif("lang", F.lit(""))),
            ("outlinks", F.col("n_links")),
            ("payload-bytes", F.col("payload_bytes")),
            ("text-digest", digest(F.col("body"))),
        ]
    )

    def record(kind: str, own: str, other: Column, media: str, block: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("warc_type"),
            F.col(own).alias("record_id"),
            other.alias("concurrent_to"),
            F.lit(media).alias("content_type"),
            block.alias("block"),
        )

    both = base.withColumn(
        "r",
        F.explode(
            F.array(
                record("metadata", "meta_id", F.col("text_id"), "application/warc-fields", about),
                record("conversion", "text_id", F.lit(None).cast("string"), "text/plain; charset=utf-8", F.col("body")),
            )
        ),
    )
    block = F.col("r.block")
    return both.select(
        "source_id",
        "r.warc_type",
        "r.record_id",
        "refers_to",
        "r.concurrent_to",
        "target_uri",
        "date",
        "r.content_type",
        F.col("http_headers").alias("source_headers"),
        "payload_digest",
        digest(block).alias("block_digest"),
        F.octet_length(block).cast("long").alias("content_length"),
        block.alias("block"),
    )


def serialized() -> Column:
    """A derived row as a record of a WARC file: version line, named fields, block; the source headers are one field."""
    head = _fields(
        [
            ("WARC-Type", F.col("warc_type")),
            ("WARC-Record-ID", F.col("record_id")),
            ("WARC-Refers-To", F.col("refers_to")),
            ("WARC-Concurrent-To", F.col("concurrent_to")),
            ("WARC-Target-URI", F.col("target_uri")),
            ("WARC-Date", F.col("date")),
            ("WARC-Refers-To-Payload-Digest", F.col("payload_digest")),
            ("WARC-Block-Digest", F.col("block_digest")),
            ("X-Source-Headers", F.regexp_replace("source_headers", "[\\r\\n]+", "; ")),
            ("Content-Type", F.col("content_type")),
            ("Content-Length", F.col("content_length")),
        ]
    )
    return F.concat(F.lit(f"WARC/1.1{CRLF}"), head, F.lit(CRLF * 2), F.col("block"), F.lit(CRLF * 2))


def write(derived: DataFrame, path: str, compression: str = "gzip") -> None:
    """Files of records under `path`, one after another as the format asks, written by Spark's text writer.

    The writer's line end is the second of the two line ends that close a record.
    """
    value = F.regexp_replace(serialized(), "\\r\\n\\z", "").alias("value")
    derived.select(value).write.mode("errorifexists").options(lineSep=CRLF, compression=compression).text(path)
