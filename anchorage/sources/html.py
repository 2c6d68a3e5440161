"""Markup of layout blocks as text, expressions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entities decoded, the ampersand last so that nothing is decoded twice; formatting tags.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
FORMATTING = "sup|sub|u|b|i|em|strong|span|br|p"


def repair_sup(html: Column) -> Column:
    """Undo the doubly escaped footnote mark."""
    return F.regexp_replace(html, r"<sup>&amp;</sup>lt;sup&gt;(.*?)&lt;/sup&gt;", "<sup>$1</sup>")


def is_repaired(html: Column) -> Column:
    """The mark was doubly escaped, or a sub- or superscript is escaped once."""
    return html.rlike(r"<sup>&amp;</sup>lt;sup&gt;(.*?)&lt;/sup&gt;") | html.rlike(r"&lt;su[bp]&gt;.*?&lt;/su[bp]&gt;")


def html_to_text(html: Column) -> Column:
    """Repair, formulas to $..$, escaped formatting tags back to tags, tags to blanks, entities last, blanks collapsed."""
    out = F.regexp_replace(repair_sup(F.coalesce(html, F.lit(""))), r"(?s)<math[^>]*>\s*(.*?)\s*</math>", r"\$$1\$")
    out = F.regexp_replace(out, rf"(?i)&lt;(/?)({FORMATTING})\b([^&<>]*?)(/?)&gt;", "<$1$2$3$4>")
    out = F.regexp_replace(out, "<[^>]+>", " ")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r"^\s+|\s+$", "")


def table_rows(html: Column) -> Column:
    """Cells of a table's rows as text, each row padded to the widest."""
    rows = F.transform(F.regexp_extract_all(html, F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), F.lit(1)), lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?s)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), html_to_text))
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    return F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))


def table_markdown(html: Column) -> Column:
    """A table as header, rule and body; placeholders for an empty and an unreadable one."""
    rows = table_rows(html)
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(rows[0], lambda c: F.lit("---")), "|"), F.lit("|"))
    body = F.concat(F.array(line(rows[0]), rule), F.transform(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), line))
    return F.when(F.coalesce(html, F.lit("")) == "", F.lit("*[empty table]*")).when(F.size(rows) == 0, F.lit("*[table with no parseable rows]*")).otherwise(F.array_join(body, "\n"))


def page_id(block_id: Column) -> Column:
    """'/page/N/...' as page_N."""
    n = F.regexp_extract(block_id, r"/page/(\d+)/", 1)
    return F.when(n != "", F.concat(F.lit("page_"), n))


def page_number(page: Column) -> Column:
    """The page from 1, NULL without a number."""
    return F.nullif(F.regexp_extract(page, r"(\d+)\s*$", 1), F.lit("")).cast("int") + 1


def heading_level(html: Column, hierarchy: Column) -> Column:
    """The tag's level, else one below the deepest of the hierarchy (6 at most), else 2."""
    tag = F.nullif(F.regexp_extract(html, r"(?i)<h([1-6])", 1), F.lit("")).cast("int")
    deepest = F.array_max(F.transform(F.map_keys(hierarchy), lambda k: k.cast("int")))
    return F.coalesce(tag, F.least(F.lit(6), deepest + 1), F.lit(2))
