"""Links, headings, list items and blocks of stored listing pages.

Elements are found by a fold over the tags of one name that keeps the stack of open ones, so an element ends at its own
closing tag and nested elements are elements too. Tags in comments, scripts and styles do not count; an element that is
never closed reaches to the end of the page.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.functions.vectors import let

#: The rest of a tag: quoted values may hold a closing bracket.
REST = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
HEADING = r"(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]\s*>"
NO_RESULT = "No subtitles found"
#: Named references; the ampersand comes last, so that nothing is decoded twice.
NAMED = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "amp": "&"}


def decoded(text: Column) -> Column:
    """Character references, numbered ones and the usual names, as characters."""
    def number(reference: Column) -> Column:
        digits = F.regexp_replace(reference, "[&#xX;]", "")
        base = F.when(F.lower(F.substring(reference, 3, 1)) == "x", F.lit(16)).otherwise(F.lit(10))
        code = F.conv(digits, 16, 16)
        return F.decode(F.unhex(F.lpad(F.when(base == 16, code).otherwise(F.conv(digits, 10, 16)), 8, "0")), "UTF-32")

    valid = r"&#(?:[0-9]{1,6}|[xX][0-9a-fA-F]{1,5});"
    numbered = F.aggregate(F.array_distinct(F.regexp_extract_all(text, F.lit(valid), F.lit(0))), text, lambda t, r: F.replace(t, r, number(r)))
    for name, character in NAMED.items():
        numbered = F.replace(numbered, F.lit(f"&{name};"), F.lit(character))
    return F.when(F.contains(text, F.lit("&")), numbered).otherwise(text)


def visible_text(html: Column) -> Column:
    return F.trim(decoded(F.regexp_replace(F.regexp_replace(html, rf"</?[A-Za-z]{REST}", ""), r"<[^>]*>", "")))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of an opening tag, in either kind of quotes or none; null without the attribute."""
    pairs = F.regexp_extract_all(tag, F.lit(r"""[^\s"'<>/=]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""), F.lit(0))
    mine = F.filter(pairs, lambda p: F.lower(F.trim(F.substring_index(p, "=", 1))) == name)
    return decoded(F.regexp_replace(F.get(mine, F.lit(0)), r"""(?s)^[^=]*=\s*(["']?)(.*)\1$""", "$2"))


def elements(html: Column, name: str) -> Column:
    """``array<struct<tag, inner, depth>>`` of all elements of a name in the order of their opening tags.

    The page is cut before every tag of the name. The fold pairs the cuts: a closing tag ends the element opened last.
    """
    shown = F.regexp_replace(html, HIDDEN, "")
    start = rf"(?i)(?=</?{name}\b)"

    def paired(parts: Column) -> Column:
        def step(state: Column, part: Column) -> Column:
            at, stack = state["at"] + 1, state["stack"]
            opens, closes = part.rlike(rf"(?i)^<{name}\b"), part.rlike(rf"(?i)^</{name}\b") & (F.size(stack) > 0)
            done = F.array(F.struct(F.element_at(stack, -1).alias("first"), at.alias("last"), F.size(stack).alias("depth")))
            return F.struct(
                at.alias("at"),
                F.when(opens, F.array_append(stack, at)).when(closes, F.slice(stack, F.lit(1), F.size(stack) - 1)).otherwise(stack).alias("stack"),
                F.when(closes, F.concat(state["pairs"], done)).otherwise(state["pairs"]).alias("pairs"))

        none = F.array().cast("array<int>")
        begun = F.struct(F.lit(0).alias("at"), none.alias("stack"), F.array().cast("array<struct<first:int,last:int,depth:int>>").alias("pairs"))

        def with_open_ones(state: Column) -> Column:
            still = F.transform(state["stack"], lambda a, i: F.struct(a.alias("first"), (state["at"] + 1).alias("last"), (i + 1).alias("depth")))
            return F.sort_array(F.concat(state["pairs"], still))

        return F.aggregate(parts, begun, step, with_open_ones)

    def cut(parts: Column) -> Column:
        def element(p: Column) -> Column:
            whole = F.array_join(F.slice(parts, p["first"], p["last"] - p["first"]), "")
            tag = F.regexp_extract(whole, rf"(?is)^<{name}\b{REST}", 0)
            return F.struct(tag.alias("tag"), F.substr(whole, F.length(tag) + 1).alias("inner"), p["depth"].alias("depth"))

        return F.filter(F.transform(paired(parts), element), lambda e: e["tag"] != "")

    return let(F.split(shown, start), cut)


def with_classes(found: Column, classes: str | Sequence[str]) -> Column:
    """Those elements whose class attribute holds all the given class names."""
    wanted = classes.split() if isinstance(classes, str) else list(classes)
    return F.filter(found, lambda e: F.size(F.array_except(F.array(*map(F.lit, wanted)), F.split(F.coalesce(attribute(e["tag"], "class"), F.lit("")), r"\s+"))) == 0)


def hrefs(html: Column) -> Column:
    """Links of all anchors in order, without empty ones."""
    tags = F.regexp_extract_all(F.regexp_replace(html, HIDDEN, ""), F.lit(rf"(?is)<a\b{REST}"), F.lit(0))
    return F.filter(F.transform(tags, lambda t: attribute(t, "href")), lambda h: h != "")


def first_link(html: Column) -> Column:
    """First link of the page, ``N/A`` where there is none."""
    return F.coalesce(F.get(hrefs(html), F.lit(0)), F.lit("N/A"))


def block(html: Column, name: str, classes: str | Sequence[str]) -> Column:
    """Content of the first element of a name with the given classes, null where there is none."""
    return F.get(with_classes(elements(html, name), classes), F.lit(0))["inner"]


def block_links(pages: DataFrame, name: str, classes: str | Sequence[str], key: str = "page_id", html: str = "html") -> DataFrame:
    """``(key, found, n_links, links)`` of the first block with the classes; a page without it has no links."""
    inner = pages.select(key, block(F.col(html), name, classes).alias("inner"))
    links = inner.select(key, F.col("inner").isNotNull().alias("found"), F.coalesce(hrefs(F.col("inner")), F.array().cast("array<string>")).alias("links"))
    return links.select(key, "found", F.size("links").cast("bigint").alias("n_links"), "links")


def item_links(pages: DataFrame, key: str = "page_id", html: str = "html", classes: str | Sequence[str] = ()) -> DataFrame:
    """One row per list item, nested ones too: its position, its first link and its title, the heading or else all its text."""
    found = elements(F.col(html), "li")
    items = pages.select(key, F.posexplode(with_classes(found, classes) if classes else found).alias("pos", "item"))
    inner = F.col("item.inner")
    heading = F.nullif(visible_text(F.regexp_extract(inner, HEADING, 1)), F.lit(""))
    return items.select(key, F.col("pos").cast("bigint"), F.coalesce(F.get(hrefs(inner), F.lit(0)), F.lit("")).alias("href"),
                        F.coalesce(heading, visible_text(inner)).alias("title"))


def page_summary(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    body = F.col(html)
    shown = F.regexp_replace(body, HIDDEN, "")
    links = pages.select(key, html, hrefs(body).alias("_links"))
    return links.select(
        key,
        F.coalesce(F.get("_links", F.lit(0)), F.lit("N/A")).alias("first_href"),
        F.size("_links").cast("bigint").alias("links"),
        F.regexp_count(shown, F.lit(r"(?i)<li\b")).cast("bigint").alias("items"),
        visible_text(F.regexp_extract(shown, HEADING, 1)).alias("heading"),
        F.contains(body, F.lit(NO_RESULT)).alias("no_result"),
    )
