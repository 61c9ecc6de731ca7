"""Web archive derivatives: each response becomes a conversion record of plain text and a metadata record, both linked to it."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DROPPED = re.compile(r"(?is)<!--.*?(?:-->|(?P<comment>\Z))|<(script|style|noscript|template)\b[^>]*>.*?(?:</\2\s*>|(?P<element>\Z))")
_BREAK = re.compile(r"(?i)</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|section|article|header|footer|title|body|head|html|nav|pre|hr)\b[^>]*>")
_TAG = re.compile(r"<[A-Za-z/!?][^>]*>")
_SPACE = re.compile(r"[ \t\r\f\v\xa0]+")


def _without_hidden(page: str) -> str:
    """The page without comments and hidden elements; one that is not closed hides the rest of the page.

    Tags are only sought before the last ``>``. Behind it a search for a tag's end would run to the end of the page from every ``<``;
    there only a comment can begin, and none can end.
    """
    cut, at, kept = page.rfind(">") + 1, 0, []
    for m in _DROPPED.finditer(page, 0, cut):
        kept.append(page[at : m.start()])
        at = m.end()
        if m["comment"] is not None or m["element"] is not None:
            return " ".join([*kept, ""])
    comment = page.find("<!--", cut)
    return " ".join([*kept, page[at:]] if comment < 0 else [*kept, page[at:comment], ""])


def plain_text(page: str | None) -> str:
    """Visible text: scripts, styles and comments go, blocks break lines, entities are resolved, white space is collapsed."""
    text = _without_hidden(page or "")
    cut = text.rfind(">") + 1
    text = _TAG.sub("", _BREAK.sub("\n", text[:cut])) + text[cut:]
    lines = (_SPACE.sub(" ", line).strip() for line in html.unescape(text).split("\n"))
    return "\n".join(line for line in lines if line)


def _urn(*parts: Column) -> Column:
    """Record id made from the record's content, the same on every run."""
    h = F.md5(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def _record(kind: str, fields: list[tuple[str, Column]], block: Column) -> Column:
    """Version line, header lines of the fields that are not null, an empty line, the block, two empty lines."""
    lines = [F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in fields]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block, F.lit("\r\n\r\n"))


#: Columns of the response that are passed on where the table has them.
GIVEN = ("warc_record_id", "warc_date", "warc_digest", "warc_content_type", "warc_headers")


def derive_records(pages: DataFrame, date: str = "1970-01-01T00:00:00Z", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep``, the three record ids, both digests, the text and the two derived records of every page.

    ``conversion`` and ``metadata`` carry the response's id in ``WARC-Refers-To``; the target address and the source's digest
    go with both, and the metadata record names the conversion record, so each of the three leads to the others.
    Where the table has them, ``warc_record_id``, ``warc_date`` and ``warc_digest`` of the response are preserved, and its
    ``warc_content_type`` and ``warc_headers`` (text, a header a line) are fields of the metadata record. Otherwise the id and digest
    come from the page's id, address and content, and the date is the one given. A map over rows: nothing is shuffled.

    Defined results: a null page is an empty response with an empty text; a null address leaves its header out; a null or blank
    given column counts as absent; line breaks in an address or a given value are written as spaces; header lines without a colon
    are left out; time grows with the length of a page; equal rows give equal records; columns not named here are not
    read; an empty table gives no rows.
    """
    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(plain_text, na_action=None) if len(batch) else batch.astype(object)

    given = [c for c in GIVEN if c in pages.columns]
    columns = dict.fromkeys([*keep, "page_id", "url", "html", *given])

    def own(name: str, made: Column) -> Column:
        if name not in given:
            return made
        value = F.trim(F.regexp_replace(F.col(name).cast("string"), r"[\r\n]+", " "))
        return F.coalesce(F.when(value != "", value), made)

    none = F.lit(None).cast("string")
    headers = F.split(F.col("warc_headers").cast("string"), r"[\r\n]+") if "warc_headers" in given else F.array().cast("array<string>")
    source = F.coalesce(F.col("html"), F.lit(""))
    found = pages.select(*columns).select(
        *keep, F.regexp_replace("url", r"[\r\n]+", " ").alias("_url"),
        own("warc_record_id", _urn(F.lit("response"), F.col("page_id"), F.col("url"), F.col("html"))).alias("response_id"),
        own("warc_digest", _digest(source)).alias("source_digest"), own("warc_date", F.lit(date)).alias("_date"),
        own("warc_content_type", none).alias("_type"), F.filter(headers, lambda h: h.rlike("^[^: ]+:")).alias("_headers"),
        F.octet_length(source).cast("long").alias("source_bytes"), text_of(source).alias("plain"))
    found = found.withColumns({
        "conversion_id": _urn(F.lit("conversion"), F.col("response_id"), F.col("plain")),
        "metadata_id": _urn(F.lit("metadata"), F.col("response_id")), "text_digest": _digest(F.col("plain"))})
    shared = [("WARC-Target-URI", F.col("_url")), ("WARC-Date", F.col("_date")), ("WARC-Refers-To", F.col("response_id"))]
    about = F.concat_ws(
        "\r\n", F.concat(F.lit("conversion-record: "), F.col("conversion_id")), F.concat(F.lit("source-digest: "), F.col("source_digest")),
        F.concat(F.lit("source-length: "), F.col("source_bytes").cast("string")), F.concat(F.lit("text-digest: "), F.col("text_digest")),
        F.concat(F.lit("source-content-type: "), F.col("_type")), F.transform("_headers", lambda h: F.concat(F.lit("source-header: "), h)), F.lit(""))
    conversion = _record("conversion", [("WARC-Record-ID", F.col("conversion_id")), *shared, ("WARC-Block-Digest", F.col("text_digest")),
                                        ("WARC-Source-Digest", F.col("source_digest")), ("Content-Type", F.lit("text/plain; charset=utf-8"))], F.col("plain"))
    metadata = _record("metadata", [("WARC-Record-ID", F.col("metadata_id")), *shared, ("WARC-Block-Digest", _digest(about)),
                                    ("Content-Type", F.lit("application/warc-fields"))], about)
    return found.select(*keep, "response_id", "conversion_id", "metadata_id", "source_digest", "text_digest", "plain",
                        conversion.alias("conversion"), metadata.alias("metadata"))
