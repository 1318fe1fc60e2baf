"""Scalar functions over titles, file names, links and versions, all as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R
from .regex import apply_rules, extract, extract_all, replace_all, trim_ws

__all__ = [
    "child_link", "container_id", "decode_uri", "depth", "encode_uri", "file_id", "front_matter", "iso_date", "let",
    "page_filename", "page_status", "page_url", "relative_path", "simple_name", "slugify", "slugify50",
    "split_extension", "text_decode", "trim_ws", "unslugify", "url_basename", "yaml_quote",
]


def let(col: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``col`` once and use the value several times in ``body``."""
    return F.transform(F.array(col), body)[0]


def slugify(text: Column) -> Column:
    return apply_rules(F.lower(text), R.SLUG_RULES)


def slugify50(text: Column) -> Column:
    return F.substring(slugify(text), 1, R.SLUG_LIMIT)


def unslugify(slug: Column) -> Column:
    """Hyphens to spaces, first letter of every word in upper case."""
    words = extract_all(F.replace(slug, F.lit("-"), F.lit(" ")), r"\w+|\W+", 0)
    return F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), ""
    )


def split_extension(name: Column) -> Column:
    """``struct(base, ext)`` at the last dot, unless the dot comes first."""
    pattern = r"\A([\s\S]+)(\.[^.]*)\z"
    base = extract(name, pattern, 1)
    return F.when(base == "", F.struct(name.alias("base"), F.lit("").alias("ext"))).otherwise(
        F.struct(base.alias("base"), extract(name, pattern, 2).alias("ext"))
    )


def page_filename(page_id: Column, title: Column, ext: str = ".md") -> Column:
    return F.concat(page_id, F.lit("-"), slugify(title), F.lit(ext))


def page_url(base_url: str, page_id: Column) -> Column:
    """Address of the page in the wiki, empty when the base address is unknown."""
    if not base_url:
        return F.lit("")
    return F.concat(F.lit(base_url.removesuffix("/") + R.PAGE_URL_SUFFIX), page_id)


def page_status(version: Column, downloaded_version: Column, downloaded_at: Column, modified_at: Column) -> Column:
    """``struct(needs_download, reason, details)``: is the stored body older than the index says?"""
    current = F.coalesce(version, F.lit(0))
    stored = F.coalesce(downloaded_version, F.lit(0))

    def status(needs: bool, reason: str, details: Column) -> Column:
        return F.struct(
            F.lit(needs).alias("needs_download"), F.lit(reason).alias("reason"), details.cast("string").alias("details")
        )

    return (
        F.when(downloaded_at.isNull(), status(True, "new", F.lit(None)))
        .when(
            current > stored,
            status(True, "updated", F.concat(F.lit("v"), stored.cast("string"), F.lit(" → v"), current.cast("string"))),
        )
        .when((stored == 0) & (modified_at > downloaded_at), status(True, "updated", F.lit("modified after download")))
        .otherwise(status(False, "up-to-date", F.lit(None)))
    )


def file_id(name: Column) -> Column:
    return F.substring_index(name, "-", 1)


def url_basename(src: Column) -> Column:
    """Text after the last slash, or ``image`` when that is empty, without the query string."""
    last = F.substring_index(src, "/", -1)
    return F.substring_index(F.when(last == "", F.lit("image")).otherwise(last), "?", 1)


def container_id(tag: Column, page_id: Column) -> Column:
    found = extract(tag, R.CONTAINER_ID, 1, "i")
    return F.when(found == "", page_id).otherwise(found)


def encode_uri(text: Column) -> Column:
    """Percent-encode everything but letters, digits and ``- _ . ! ~ * ' ( )``."""
    out = F.url_encode(text)
    for encoded, plain in [("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")]:
        out = F.replace(out, F.lit(encoded), F.lit(plain))
    return out


def decode_uri(text: Column) -> Column:
    """Undo percent-encoding; null when the text is malformed."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def simple_name(name: Column) -> Column:
    """Drop leading punctuation and cut at the first character unusual in file names."""
    return extract(replace_all(name, r"\A[^a-z0-9]+", "", "i"), r"\A[a-z0-9.\-_]*", 0, "i")


def text_decode(text: Column) -> Column:
    for entity, plain in R.ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def yaml_quote(text: Column) -> Column:
    return F.replace(text, F.lit('"'), F.lit('\\"'))


def iso_date(text: Column) -> Column:
    return F.substring_index(text, "T", 1)


def child_link(title: Column) -> Column:
    return F.concat(F.lit("- ["), title, F.lit("]("), slugify(title), F.lit(".md)"))


def relative_path(path: Column, root: str) -> Column:
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)


def depth(path: Column, root: str) -> Column:
    """Number of folders between the root and the path."""
    return F.size(F.split(relative_path(path, root), "/")) - 1


def front_matter(title: Column, page_id: Column, url: Column) -> Column:
    """The YAML block that opens every Markdown file; the address is left out when empty."""
    return F.concat_ws(
        "\n",
        F.lit(R.FRONT_MATTER_FENCE),
        F.concat(F.lit('title: "'), yaml_quote(title), F.lit('"')),
        F.concat(F.lit('id: "'), page_id, F.lit('"')),
        F.when(url != "", F.concat(F.lit('url: "'), url, F.lit('"'))),
        F.lit(R.FRONT_MATTER_FENCE),
    )
