"""HTML to Markdown as Column expressions: every stage maps a text column to a text column.

The stages need no Python worker and no shuffle.  Stages that refer to other
tables take the resolved texts as map columns (see :mod:`.refs`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.regex import (
    apply_rules, extract, extract_all, has_exotic, java, matches, replace_all, rewrite, rewrite_spans, trim_ws,
)
from ..functions.text import child_link, container_id, let, slugify, split_extension, text_decode, url_basename

# Private-use characters fence what is put in place after the text rules have run.  A page's own such characters are
# escaped by others meanwhile, so no text of a page can look like a fence.
INCLUDE_OPEN, INCLUDE_CLOSE = "\ue000", "\ue001"
ESCAPE = "\ue002"
ESCAPED = {ESCAPE: "\ue005", INCLUDE_OPEN: "\ue003", INCLUDE_CLOSE: "\ue004"}
INCLUDE_TOKEN = f"{INCLUDE_OPEN}([^{INCLUDE_CLOSE}]*){INCLUDE_CLOSE}"


def normalize_newlines(text: Column) -> Column:
    """Line ends as ``\\n``.  ``text`` is read twice, so pass a plain column."""
    return F.when(text.contains("\r"), apply_rules(text, R.PREPARE_RULES)).otherwise(text)


def escape_fences(text: Column) -> Column:
    """The page's own fence characters as pairs of others."""
    for own, other in ESCAPED.items():  # the escape itself first
        text = F.replace(text, F.lit(own), F.lit(ESCAPE + other))
    return text


def unescape_fences(text: Column) -> Column:
    for own, other in reversed(ESCAPED.items()):
        text = F.replace(text, F.lit(ESCAPE + other), F.lit(own))
    return text


# ---- table cells and tables -------------------------------------------------


def flatten_cell_lists(html: Column) -> Column:
    """Lists inside table cells become ``• one; • two`` behind the cell's other text."""

    def cell(tag: Column) -> Column:
        inner = extract(tag, R.TABLE_CELL, 2, "i")
        items = F.filter(
            F.transform(extract_all(inner, R.LIST_ITEM, 1, "i"), lambda item: trim_ws(replace_all(item, R.ANY_TAG, ""))),
            lambda item: item != "",
        )
        rest = trim_ws(apply_rules(inner, R.CELL_LIST_RULES))
        flat = F.concat(
            F.lit("<td"), extract(tag, R.TABLE_CELL, 1, "i"), F.lit(">"),
            rest,
            F.when(rest == "", "").otherwise(" "),
            F.array_join(F.transform(items, lambda item: F.concat(F.lit("• "), item)), "; "),
            F.lit("</td>"),
        )
        return F.when(matches(inner, R.LIST_OPEN, "i") & (F.size(items) > 0), flat).otherwise(tag)

    return let(
        html, lambda x: F.when(matches(x, "<td", "i"), rewrite_spans(x, R.CELL_OPEN, R.CELL_CLOSE, cell, "i")).otherwise(x)
    )


def tables_to_markdown(html: Column) -> Column:
    """Each table as pipe rows; the first row is the header."""

    def cell(inner: Column) -> Column:
        flat = trim_ws(apply_rules(inner, R.TABLE_CELL_RULES))
        return F.replace(flat, F.lit("|"), F.lit("\\|"))

    def table(tag: Column) -> Column:
        rows = F.filter(
            F.transform(
                extract_all(tag, R.TABLE_ROW, 1, "i"),
                lambda row: F.transform(extract_all(row, R.TABLE_ROW_CELL, 1, "i"), cell),
            ),
            lambda row: F.size(row) > 0,
        )
        lines = F.transform(rows, lambda row: F.concat(F.lit("| "), F.array_join(row, " | "), F.lit(" |")))
        rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(rows[0])))
        body = F.array_join(
            F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))), "\n"
        )
        return F.when(F.size(rows) == 0, tag).otherwise(F.concat(F.lit("\n\n"), body, F.lit("\n\n")))

    return let(html, lambda x: F.when(matches(x, "<table", "i"), rewrite_spans(x, R.TABLE_OPEN, R.TABLE_CLOSE, table, "i")).otherwise(x))


def trim_table_cells(text: Column) -> Column:
    """In lines that open and close with a pipe, trim every cell."""

    def line(row: Column) -> Column:
        cells = F.array_join(F.transform(F.split(row, r"\|", -1), trim_ws), "|")
        return F.when(row.startswith("|") & row.endswith("|") & (F.length(row) > 2), cells).otherwise(row)

    return let(
        text,
        lambda x: F.when(x.contains("|"), F.array_join(F.transform(F.split(x, "\n", -1), line), "\n")).otherwise(x),
    )


# ---- macros -----------------------------------------------------------------


def fold_macros(html: Column, paired: Callable[..., Column], alone: Callable[[Column], Column]) -> Column:
    """Rebuild macros from the inside out, at any depth, in one pass over their tags.

    ``paired(tag, inner, closing)`` is the text of a macro whose inner macros
    are rebuilt already, ``alone(tag)`` that of a self-closing one.  Tags in
    CDATA are text, and so are tags without partner.
    """
    regex = java(R.MACRO_TAG, "is")
    gaps = F.split(html, regex, -1)
    steps = F.zip_with(
        F.regexp_extract_all(html, F.lit(regex), F.lit(0)),
        F.slice(gaps, F.lit(2), F.size(gaps)),
        lambda tag, gap: F.struct(tag.alias("tag"), gap.alias("gap")),
    )

    def frame(tag: Column, text: Column) -> Column:
        return F.array(F.struct(tag.alias("tag"), text.alias("text")))

    def step(frames: Column, x: Column) -> Column:
        tag, gap, size = x["tag"], x["gap"], F.size(frames)
        top, below = F.element_at(frames, -1), F.try_element_at(frames, F.lit(-2))
        opening, closing = tag.startswith("<a") | tag.startswith("<A"), tag.startswith("</")

        def on_top(text: Column) -> Column:
            return F.concat(F.slice(frames, F.lit(1), size - 1), frame(top["tag"], F.concat(top["text"], text, gap)))

        shut = F.concat(
            F.slice(frames, F.lit(1), F.greatest(size - 2, F.lit(0))),
            frame(below["tag"], F.concat(below["text"], paired(top["tag"], top["text"], tag), gap)),
        )
        return (
            F.when(opening & tag.endswith("/>"), on_top(alone(tag)))
            .when(opening, F.concat(frames, frame(tag, gap)))
            .when(closing & (size > 1), shut)
            .otherwise(on_top(tag))
        )

    left = F.aggregate(steps, frame(F.lit(""), gaps[0]), step)
    return F.array_join(F.transform(left, lambda f: F.concat(f["tag"], f["text"])), "")


def _macro_name(tag: Column) -> Column:
    return F.lower(extract(tag, R.MACRO_NAME, 1, "i"))


def unwrap_tables(html: Column) -> Column:
    """Table macros give way to the table they hold; a self-closing one holds none."""

    def paired(tag: Column, inner: Column, closing: Column) -> Column:
        body = F.concat(extract(inner, R.MACRO_BODY, 1, "i"), F.lit("\n\n"))
        is_table = _macro_name(tag).isin(*R.TABLE_MACROS) & matches(inner, R.MACRO_BODY, "i")
        return F.when(is_table, body).otherwise(F.concat(tag, inner, closing))

    def alone(tag: Column) -> Column:
        return F.when(_macro_name(tag).isin(*R.TABLE_MACROS), F.lit("")).otherwise(tag)

    some_table = "|".join(f'ac:name="{name}"' for name in R.TABLE_MACROS)
    return let(html, lambda x: F.when(matches(x, some_table, "i"), fold_macros(x, paired, alone)).otherwise(x))


def _marker(tag: Column) -> Column:
    text = F.concat(F.lit(R.OTHER_MACRO[0]), extract(tag, R.MACRO_NAME, 1, "i"), F.lit(R.OTHER_MACRO[1]))
    name = _macro_name(tag)
    for known, marker in R.MARKER_MACROS.items():
        text = F.when(name == known, F.lit(marker)).otherwise(text)
    return text


def _code_block(inner: Column) -> Column:
    language = extract(extract(inner, R.CODE_BODY, 1, "is"), R.CODE_LANGUAGE, 1, "is")
    return F.concat(F.lit("```"), language, F.lit("\n"), extract(inner, R.CODE_BODY, 2, "is"), F.lit("\n```\n\n"))


def _info_panel(inner: Column) -> Column:
    title = trim_ws(extract(inner, R.INFO_TITLE, 1, "i"))
    return F.concat(
        F.when(title == "", "").otherwise(F.concat(F.lit("[i] "), title, F.lit("\n\n"))),
        trim_ws(extract(inner, R.MACRO_BODY, 1, "i")),
        F.lit("\n\n"),
    )


def convert_macros(html: Column) -> Column:
    """Code, info, warning, note, panel, excerpt and marker macros, nested to any depth.

    A macro without the body its kind needs leaves a marker.
    """

    def paired(tag: Column, inner: Column, closing: Column) -> Column:
        name, with_body = _macro_name(tag), matches(inner, R.MACRO_BODY, "i")
        text = _marker(tag)
        for kind, (before, after) in R.BODY_MACROS.items():
            body = F.concat(F.lit(before), extract(inner, R.MACRO_BODY, 1, "i"), F.lit(after))
            text = F.when((name == kind) & with_body, body).otherwise(text)
        text = F.when(name == "info", _info_panel(inner)).otherwise(text)
        return F.when((name == "code") & matches(inner, R.CODE_BODY, "is"), _code_block(inner)).otherwise(text)

    return _where_macros(html, lambda x: fold_macros(x, paired, _marker))


def _where_macros(html: Column, convert) -> Column:
    return let(html, lambda x: F.when(matches(x, "<ac:structured-macro", "i"), convert(x)).otherwise(x))


def macro_title(tag: Column) -> Column:
    return extract(tag, R.MACRO_TITLE, 1, "i")


def expand_children(html: Column, by_title: Column, own: Column) -> Column:
    """``children`` macros become the child list of the titled page, or of this page."""

    def macro(tag: Column) -> Column:
        title = macro_title(tag)
        return F.coalesce(F.when(title != "", F.try_element_at(by_title, title)), own, F.lit(R.NO_CHILDREN))

    return _where_macros(html, lambda x: rewrite(x, R.CHILDREN_MACRO, macro, "i"))


def expand_list_children(html: Column, own: Column) -> Column:
    """``list-children`` macros become the child list of this page."""
    return _where_macros(
        html, lambda x: rewrite(x, R.LIST_CHILDREN_MACRO, lambda _: F.coalesce(own, F.lit(R.NO_LISTED_CHILDREN)), "is")
    )


def mark_includes(html: Column, known: Column) -> Column:
    """``include`` macros of known titles become tokens, all others a marker text."""

    def macro(tag: Column) -> Column:
        title = macro_title(tag)
        token = F.concat(F.lit(INCLUDE_OPEN), F.base64(F.encode(title, "utf-8")), F.lit(INCLUDE_CLOSE))
        missing = F.concat(F.lit(R.INCLUDE_NOT_FOUND[0]), title, F.lit(R.INCLUDE_NOT_FOUND[1]))
        return (
            F.when(title == "", F.lit(R.NO_INCLUDE_TITLE))
            .when(F.try_element_at(known, title).isNotNull(), token)
            .otherwise(missing)
        )

    return _where_macros(html, lambda x: rewrite(x, R.INCLUDE_MACRO, macro, "i"))


def fill_includes(text: Column, known: Column) -> Column:
    """Put the included texts in place of their tokens."""

    def fill(token: Column) -> Column:
        title = F.decode(F.unbase64(extract(token, INCLUDE_TOKEN, 1)), "utf-8")
        return F.coalesce(F.try_element_at(known, title), F.lit(""))

    return let(text, lambda x: F.when(x.contains(INCLUDE_OPEN), rewrite(x, INCLUDE_TOKEN, fill)).otherwise(x))


# ---- links and images ---------------------------------------------------------


def link_users(html: Column, by_name: Column, by_key: Column) -> Column:
    """User references become ``@Display Name``; unknown users keep a short handle."""

    def name(tag: Column) -> Column:
        key = extract(tag, R.USERNAME_LINK, 1, "i")
        return F.concat(F.lit("@"), F.coalesce(F.try_element_at(by_name, key), key))

    def user_key(tag: Column) -> Column:
        key = extract(tag, R.USERKEY_LINK, 1, "i")
        return F.concat(
            F.lit("@"), F.coalesce(F.try_element_at(by_key, key), F.concat(F.lit("user-"), F.right(key, F.lit(8))))
        )

    def link(x: Column) -> Column:
        x = rewrite(x, R.USERNAME_LINK, name, "i")
        return let(x, lambda y: rewrite(y, R.USERKEY_LINK, user_key, "i"))

    return let(html, lambda x: F.when(matches(x, "<ri:user", "i"), link(x)).otherwise(x))


def link_pages(html: Column, targets: Column | None = None) -> Column:
    """Page references become Markdown links; ``targets`` maps titles to real file names."""

    def to_link(pattern: str):
        def link(tag: Column) -> Column:
            title = extract(tag, pattern, 1, "i")
            file = F.concat(slugify(title), F.lit(".md"))
            if targets is not None:
                file = F.coalesce(F.try_element_at(targets, title), file)
            return F.concat(F.lit("["), title, F.lit("]("), file, F.lit(")"))

        return link

    def both(x: Column) -> Column:
        x = rewrite(x, R.PAGE_LINK, to_link(R.PAGE_LINK), "i")
        return let(x, lambda y: rewrite(y, R.BARE_PAGE_LINK, to_link(R.BARE_PAGE_LINK), "i"))

    return let(html, lambda x: F.when(matches(x, "<ri:page", "i"), both(x)).otherwise(x))


def image_file(name: Column) -> Column:
    """The file an image is stored under: slug of the base name plus the extension."""
    return let(name, lambda n: let(split_extension(n), lambda s: F.concat(slugify(s["base"]), s["ext"])))


def link_images(html: Column) -> Column:
    """Attached images become Markdown images below ``images/``."""

    def image(name: Column) -> Column:
        return let(
            name,
            lambda n: F.concat(F.lit("!["), n, F.lit("](images/"), image_file(n), F.lit(")")),
        )

    def both(x: Column) -> Column:
        x = rewrite(x, R.STORAGE_IMAGE, lambda tag: image(extract(tag, R.STORAGE_IMAGE, 1, "i")), "i")
        return let(
            x, lambda y: rewrite(y, R.INLINE_IMAGE, lambda tag: image(url_basename(extract(tag, R.INLINE_IMAGE, 1, "i"))), "i")
        )

    return let(html, lambda x: F.when(matches(x, "<ac:image|<img", "i"), both(x)).otherwise(x))


def image_refs(html: Column, page_id: Column, named: Callable[[Column], Column] = lambda name: name) -> Column:
    """The image references of a text in order: ``array<struct(kind, container_id, name)>``; ``named`` restores a name."""
    storage = F.transform(
        extract_all(html, R.STORAGE_IMAGE, 1, "i"),
        lambda name: F.struct(F.lit("storage").alias("kind"), page_id.alias("container_id"), named(name).alias("name")),
    )
    inline = F.transform(
        extract_all(html, R.INLINE_IMAGE, 0, "i"),
        lambda tag: F.struct(
            F.lit("inline").alias("kind"),
            container_id(tag, page_id).alias("container_id"),
            named(url_basename(extract(tag, R.INLINE_IMAGE, 1, "i"))).alias("name"),
        ),
    )
    return F.concat(storage, inline)


# ---- text rules -----------------------------------------------------------------


def drop_scripts(html: Column) -> Column:
    """Scripts, styles and comments go."""

    def drop(text: Column, opening: str, closing: str, flags: str) -> Column:
        nothing = lambda _: F.lit("")
        return let(text, lambda x: F.when(matches(x, closing, flags), rewrite_spans(x, opening, closing, nothing, flags)).otherwise(x))

    for span in R.DROPPED_SPANS:
        html = drop(html, *span)
    return html


def strip_layout(html: Column, wide: bool = True) -> Column:
    """Layout tags go, time tags leave their date."""
    return apply_rules(html, R.LAYOUT_RULES, wide)


def restore_links(text: Column, wide: bool = True) -> Column:
    return apply_rules(text, R.RESTORE_LINK_RULES, wide)


def html_to_markdown(html: Column, wide: bool = True) -> Column:
    """Headings, emphasis, links, lists, paragraphs and code; all other tags go, entities are decoded."""
    text = text_decode(apply_rules(html, R.HTML_RULES, wide))
    return trim_ws(apply_rules(text, R.BLANK_LINE_RULES, wide))


def clean_markdown(text: Column, wide: bool = True) -> Column:
    """Remove what the conversion leaves behind: empty headers, markers, links, items and lines."""
    text = apply_rules(text, R.PATTERN_RULES + R.GENERAL_RULES, wide)
    text = F.concat(trim_ws(text), F.lit("\n"))
    text = apply_rules(text, R.PATTERN_RULES + R.COLLAPSE_RULES, wide)
    return F.concat(trim_ws(text), F.lit("\n"))


def final_unescape(text: Column) -> Column:
    return apply_rules(text, R.UNESCAPE_RULES)


def strip_page(text: Column) -> Column:
    """The stages before tables: scripts, styles, comments, layout and time tags."""
    return strip_layout(drop_scripts(text), wide=False)


def finish_page(df: DataFrame, column: str) -> DataFrame:
    """Everything after tables and includes, as :func:`restore_links`, :func:`html_to_markdown`
    and :func:`clean_markdown` do, with most of the scanning left out.

    Each group of rules runs only on texts holding what every match of the
    group must contain; looking for a literal costs a tenth of a regex pass.
    Rules run with ASCII classes unless the text holds other white space.
    Every step reads its input more than once, so the steps stay separate
    projections inside one whole-stage code generation span.
    """
    col, lowered, exotic = F.col(column), F.col("_lowered"), F.col("_exotic")
    names = {rule[0]: rule for rule in R.HTML_RULES + R.PATTERN_RULES + R.GENERAL_RULES}

    def step(frame: DataFrame, guard: Column | None, rules: list[R.Rule]) -> DataFrame:
        changed = F.when(exotic, apply_rules(col, rules, wide=True)).otherwise(apply_rules(col, rules, wide=False))
        return frame.withColumn(column, changed if guard is None else F.when(guard, changed).otherwise(col))

    def some(text: Column, *literals: str) -> Column:
        guard = text.contains(literals[0])
        for literal in literals[1:]:
            guard = guard | text.contains(literal)
        return guard

    def pick(*wanted: str) -> list[R.Rule]:
        return [names[name] for name in wanted]

    df = df.withColumn("_exotic", has_exotic(col))
    df = step(df, some(col, ".md", "\\["), R.RESTORE_LINK_RULES)
    df = step(df, some(col, "<ac:link"), pick("ac_link"))
    # None of the rules up to ``p`` can put a tag together, so one lower-case copy serves them all.
    df = df.withColumn("_lowered", F.lower(col))
    for level in range(1, 7):
        df = step(df, some(lowered, f"</h{level}>"), pick(f"h{level}"))
    df = step(df, some(lowered, "</strong>", "</b>", "</em>", "</i>"), pick("strong", "b", "em", "i"))
    df = step(df, some(lowered, "</a>"), pick("a"))
    df = step(df, some(lowered, "<ul", "</ul>"), pick("ul_open", "ul_close"))
    df = step(df, some(lowered, "<ol", "</ol>"), pick("ol_open", "ol_close"))
    df = step(df, some(lowered, "</li>"), pick("li"))
    df = step(df, some(lowered, "</p>"), pick("p"))
    df = step(df, some(col, "<"), pick("pre_code", "code", "br", "any_tag"))
    df = df.withColumn(column, F.when(col.contains("&"), text_decode(col)).otherwise(col))
    df = step(df, some(col, "\n\n\n"), R.BLANK_LINE_RULES).withColumn(column, trim_ws(col))

    def patterns(frame: DataFrame) -> DataFrame:
        frame = step(frame, some(col, "**"), pick("bold_over_blank", "bold_line"))
        frame = step(frame, some(col, "#"), pick("empty_header"))
        frame = step(frame, some(col, "*"), pick("empty_bold", "empty_italic"))
        frame = step(frame, some(col, ">"), pick("empty_quote"))
        frame = step(frame, some(col, "```"), pick("empty_code"))
        return step(frame, None, pick("short_rule"))

    df = patterns(df)
    headers = [rule for rule in R.GENERAL_RULES if rule[0].startswith("header_")]
    df = step(df, some(col, "#") & some(col, "*", "_"), headers)
    df = step(df, some(col, "**"), pick("touching_bold"))
    df = step(df, some(col, "__"), pick("touching_underscore"))
    df = step(df, some(col, "*"), pick("italic_line"))
    df = step(df, some(col, "_"), pick("underscore_line"))
    df = step(df, some(col, "*"), pick("italic_over_lines"))
    df = step(df, some(col, "]("), pick("empty_link"))
    df = step(df, None, pick("empty_item"))
    df = step(df, some(col, "\n\n\n\n"), R.COLLAPSE_RULES)
    df = step(df, None, pick("line_ends")).withColumn(column, F.concat(trim_ws(col), F.lit("\n")))
    df = step(patterns(df), some(col, "\n\n\n\n"), R.COLLAPSE_RULES)
    # A filter on the result would be rewritten in terms of the input, doubling at every step above; the optimizer moves
    # no filter below a column that depends on the task.  Unlike a generator's, such a column goes with all its
    # steps where nothing reads it.
    done = F.when(F.spark_partition_id() >= 0, F.concat(trim_ws(col), F.lit("\n"))).alias(column)
    columns = [c for c in df.columns if c not in ("_exotic", "_lowered")]
    return df.select(*(done if c == column else c for c in columns))


def convert_plain(df: DataFrame, column: str, includes: Column | None = None) -> DataFrame:
    """Turn ``column`` from HTML with resolved references into clean Markdown.

    The projections stay apart because each reads its input more than once.
    """
    col = F.col(column)
    df = df.withColumn(column, strip_page(col))
    df = df.withColumn(column, trim_table_cells(tables_to_markdown(col)))
    if includes is not None:
        df = df.withColumn(column, fill_includes(col, includes))
    return finish_page(df, column)


def markdown_pages(pages: DataFrame, tasks: int | None = None) -> DataFrame:
    """Markdown of raw web pages: the text rules alone, without a shuffle.

    ``tasks`` deals the pages to so many tasks first, for input files of few splits.
    """
    plain = pages.select("id", "html")
    scan = (plain.repartition(tasks) if tasks else plain).withColumn("html", normalize_newlines(F.col("html")))
    return convert_plain(scan, "html").withColumnRenamed("html", "markdown")


def child_list(lines: Column) -> Column:
    return F.concat(F.array_join(lines, "\n"), F.lit("\n\n"))


