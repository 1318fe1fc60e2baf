"""DuckDB renderings of the text functions and stages, from the same rule lists."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from wikitables.functions import rules as R
from wikitables.functions.regex import WHITE_SPACE, re2
from wikitables.operators.markdown import INCLUDE_CLOSE, INCLUDE_OPEN

_names = itertools.count()



def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def replace_all(x: str, pattern: str, replacement: str, flags: str = "") -> str:
    return f"regexp_replace({x}, {lit(re2(pattern, flags))}, {lit(replacement)}, 'g')"


def chain(x: str, rules: list[R.Rule]) -> str:
    for _, flags, pattern, replacement in rules:
        x = replace_all(x, pattern, replacement, flags)
    return x


def extract(x: str, pattern: str, group: int = 1, flags: str = "") -> str:
    return f"regexp_extract({x}, {lit(re2(pattern, flags))}, {group})"


def extract_all(x: str, pattern: str, group: int = 1, flags: str = "") -> str:
    return f"regexp_extract_all({x}, {lit(re2(pattern, flags))}, {group})"


def matches(x: str, pattern: str, flags: str = "") -> str:
    return f"regexp_matches({x}, {lit(re2(pattern, flags))})"


def trim(x: str) -> str:
    return f"trim({x}, {lit(WHITE_SPACE)})"


def let(x: str, body: Callable[[str], str]) -> str:
    v = f"v{next(_names)}"
    return f"list_transform([{x}], lambda {v}: {body(v)})[1]"


def each(items: str, body: Callable[[str], str]) -> str:
    v = f"v{next(_names)}"
    return f"list_transform({items}, lambda {v}: {body(v)})"


def keep(items: str, test: Callable[[str], str]) -> str:
    v = f"v{next(_names)}"
    return f"list_filter({items}, lambda {v}: {test(v)})"


def join(items: str, sep: str) -> str:
    return f"coalesce(array_to_string({items}, {lit(sep)}), '')"


def rewrite(x: str, pattern: str, rebuild: Callable[[str], str], flags: str = "") -> str:
    regex = lit(re2(pattern, flags))

    def body(v: str) -> str:
        found = each(f"regexp_extract_all({v}, {regex}, 0)", rebuild)
        zipped = f"list_zip(string_split_regex({v}, {regex}), {found})"
        return join(each(zipped, lambda z: f"({z}[1] || coalesce({z}[2], ''))"), "")

    return let(x, body)


# ---- functions ---------------------------------------------------------------------


def slug(x: str) -> str:
    return chain(f"lower({x})", R.SLUG_RULES)


def slug50(x: str) -> str:
    return f"substring({slug(x)}, 1, {R.SLUG_LIMIT})"


def unslug(x: str) -> str:
    words = extract_all(f"replace({x}, '-', ' ')", r"\w+|\W+", 0)
    return join(each(words, lambda w: f"(upper({w}[1:1]) || {w}[2:])"), "")


def base_of(x: str) -> str:
    return let(x, lambda n: f"CASE WHEN {extract(n, _EXT, 1)} = '' THEN {n} ELSE {extract(n, _EXT, 1)} END")


_EXT = r"\A([\s\S]+)(\.[^.]*)\z"


def ext_of(x: str) -> str:
    return extract(x, _EXT, 2)


def child_link(x: str) -> str:
    return f"('- [' || {x} || '](' || {slug(x)} || '.md)')"


def encode_uri(x: str) -> str:
    out = f"url_encode({x})"
    for a, b in [("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%2A", "*")]:
        out = f"replace({out}, '{a}', {lit(b)})"
    return out


def decode_uri(x: str) -> str:
    return f"CASE WHEN contains(regexp_replace({x}, '%[0-9A-Fa-f]{{2}}', '', 'g'), '%') THEN NULL ELSE url_decode({x}) END"


def simple_name(x: str) -> str:
    return extract(replace_all(x, r"\A[^a-z0-9]+", "", "i"), r"\A[a-z0-9.\-_]*", 0, "i")


def text_decode(x: str) -> str:
    for entity, plain in R.ENTITIES:
        x = f"replace({x}, {lit(entity)}, {lit(plain)})"
    return x


def url_basename(x: str) -> str:
    last = f"string_split({x}, '/')[-1]"
    return f"string_split(CASE WHEN {last} = '' THEN 'image' ELSE {last} END, '?')[1]"


def front_matter(title: str, page_id: str, url: str = "''") -> str:
    return (
        f"concat_ws(chr(10), '---', 'title: \"' || replace({title}, '\"', '\\\"') || '\"', 'id: \"' || {page_id} || '\"', "
        f"CASE WHEN {url} <> '' THEN 'url: \"' || {url} || '\"' END, '---')"
    )


# ---- stages --------------------------------------------------------------------------


def newlines(x: str) -> str:
    return chain(x, R.PREPARE_RULES)


def flatten_cell_lists(x: str) -> str:
    def cell(tag: str) -> str:
        inner = extract(tag, R.TABLE_CELL, 2, "i")
        items = keep(
            each(extract_all(inner, R.LIST_ITEM, 1, "i"), lambda i: trim(replace_all(i, R.ANY_TAG, ""))),
            lambda i: f"{i} <> ''",
        )
        rest = trim(chain(inner, R.CELL_LIST_RULES))
        flat = (
            f"('<td' || {extract(tag, R.TABLE_CELL, 1, 'i')} || '>' || {rest} || CASE WHEN {rest} = '' THEN '' ELSE ' ' END || "
            + join(each(items, lambda i: f"('• ' || {i})"), "; ")
            + " || '</td>')"
        )
        return f"CASE WHEN {matches(inner, R.LIST_OPEN, 'i')} AND len({items}) > 0 THEN {flat} ELSE {tag} END"

    return rewrite(x, R.TABLE_CELL, cell, "i")


def tables(x: str) -> str:
    def cell(inner: str) -> str:
        return f"replace({trim(chain(inner, R.TABLE_CELL_RULES))}, '|', '\\|')"

    def table(tag: str) -> str:
        rows = keep(
            each(extract_all(tag, R.TABLE_ROW, 1, "i"), lambda r: each(extract_all(r, R.TABLE_ROW_CELL, 1, "i"), cell)),
            lambda r: f"len({r}) > 0",
        )

        def body(rs: str) -> str:
            lines = each(rs, lambda r: f"('| ' || {join(r, ' | ')} || ' |')")
            text = let(lines, lambda ls: join(f"list_concat({ls}[1:1], ['|' || repeat(' --- |', len({rs}[1]))], {ls}[2:])", "\n"))
            return f"CASE WHEN len({rs}) = 0 THEN {tag} ELSE chr(10) || chr(10) || {text} || chr(10) || chr(10) END"

        return let(rows, body)

    return rewrite(x, R.TABLE, table, "i")


def trim_cells(x: str) -> str:
    def line(row: str) -> str:
        cells = join(each(f"string_split({row}, '|')", trim), "|")
        return f"CASE WHEN starts_with({row}, '|') AND ends_with({row}, '|') AND length({row}) > 2 THEN {cells} ELSE {row} END"

    return join(each(f"string_split({x}, chr(10))", line), "\n")


def unwrap_tables(x: str) -> str:
    return chain(x, R.TABLE_MACRO_RULES)


def convert_macros(x: str) -> str:
    def code(tag: str) -> str:
        language = extract(extract(tag, R.CODE_MACRO, 1, "is"), R.CODE_LANGUAGE, 1, "is")
        return f"('```' || {language} || chr(10) || {extract(tag, R.CODE_MACRO, 2, 'is')} || {lit(chr(10) + '```' + chr(10) * 2)})"

    def info(tag: str) -> str:
        inner = extract(tag, R.INFO_MACRO, 1, "is")
        title = trim(extract(inner, R.INFO_TITLE, 1, "i"))
        head = f"CASE WHEN {title} = '' THEN '' ELSE '[i] ' || {title} || {lit(chr(10) * 2)} END"
        return f"({head} || {trim(extract(inner, R.INFO_BODY, 1, 'i'))} || {lit(chr(10) * 2)})"

    x = rewrite(x, R.CODE_MACRO, code, "is")
    x = rewrite(x, R.INFO_MACRO, info, "is")
    x = chain(x, R.BODY_MACRO_RULES + R.BODY_MACRO_RULES)
    return chain(x, R.MARKER_MACRO_RULES)


def macro_title(tag: str) -> str:
    return extract(tag, R.MACRO_TITLE, 1, "i")


def expand_children(x: str, by_title: str, own: str) -> str:
    def macro(tag: str) -> str:
        return f"coalesce(CASE WHEN {macro_title(tag)} <> '' THEN {by_title}[{macro_title(tag)}] END, {own}, {lit(R.NO_CHILDREN)})"

    return rewrite(x, R.CHILDREN_MACRO, macro, "i")


def expand_list_children(x: str, own: str) -> str:
    return rewrite(x, R.LIST_CHILDREN_MACRO, lambda _: f"coalesce({own}, {lit(R.NO_LISTED_CHILDREN)})", "is")


def mark_includes(x: str, known: str) -> str:
    a, b = R.INCLUDE_NOT_FOUND

    def macro(tag: str) -> str:
        title = macro_title(tag)
        return (
            f"CASE WHEN {title} = '' THEN {lit(R.NO_INCLUDE_TITLE)} WHEN {known}[{title}] IS NOT NULL THEN "
            f"{lit(INCLUDE_OPEN)} || to_base64(encode({title})) || {lit(INCLUDE_CLOSE)} ELSE {lit(a)} || {title} || {lit(b)} END"
        )

    return rewrite(x, R.INCLUDE_MACRO, macro, "i")


def fill_includes(x: str, known: str) -> str:
    token = f"{INCLUDE_OPEN}([^{INCLUDE_CLOSE}]*){INCLUDE_CLOSE}"
    return rewrite(x, token, lambda t: f"coalesce({known}[decode(from_base64({extract(t, token, 1)}))], '')")


def link_users(x: str, by_name: str, by_key: str) -> str:
    def name(tag: str) -> str:
        key = extract(tag, R.USERNAME_LINK, 1, "i")
        return f"('@' || coalesce({by_name}[{key}], {key}))"

    def user_key(tag: str) -> str:
        key = extract(tag, R.USERKEY_LINK, 1, "i")
        return f"('@' || coalesce({by_key}[{key}], 'user-' || right({key}, 8)))"

    return rewrite(rewrite(x, R.USERNAME_LINK, name, "i"), R.USERKEY_LINK, user_key, "i")


def link_pages(x: str, targets: str | None = None) -> str:
    def link(pattern: str):
        def one(tag: str) -> str:
            title = extract(tag, pattern, 1, "i")
            file = f"{slug(title)} || '.md'"
            if targets:
                file = f"coalesce({targets}[{title}], {file})"
            return f"('[' || {title} || '](' || {file} || ')')"

        return one

    return rewrite(rewrite(x, R.PAGE_LINK, link(R.PAGE_LINK), "i"), R.BARE_PAGE_LINK, link(R.BARE_PAGE_LINK), "i")


def image_file(x: str) -> str:
    return let(x, lambda n: f"({slug(base_of(n))} || {ext_of(n)})")


def link_images(x: str) -> str:
    def image(name: str) -> str:
        return let(name, lambda n: f"('![' || {n} || '](images/' || {image_file(n)} || ')')")

    x = rewrite(x, R.STORAGE_IMAGE, lambda t: image(extract(t, R.STORAGE_IMAGE, 1, "i")), "i")
    return rewrite(x, R.INLINE_IMAGE, lambda t: image(url_basename(extract(t, R.INLINE_IMAGE, 1, "i"))), "i")


def image_refs(x: str, page_id: str) -> str:
    storage = each(
        extract_all(x, R.STORAGE_IMAGE, 1, "i"), lambda n: f"{{'kind': 'storage', 'container_id': {page_id}, 'name': {n}}}"
    )
    inline = each(
        extract_all(x, R.INLINE_IMAGE, 0, "i"),
        lambda t: f"{{'kind': 'inline', 'container_id': coalesce(nullif({extract(t, R.CONTAINER_ID, 1, 'i')}, ''), {page_id}), "
        f"'name': {url_basename(extract(t, R.INLINE_IMAGE, 1, 'i'))}}}",
    )
    return f"list_concat({storage}, {inline})"


def strip_page(x: str) -> str:
    return chain(chain(x, R.DROP_RULES), R.LAYOUT_RULES)


def html_to_markdown(x: str) -> str:
    return trim(chain(text_decode(chain(x, R.HTML_RULES)), R.BLANK_LINE_RULES))


def clean(x: str) -> str:
    x = f"({trim(chain(x, R.PATTERN_RULES + R.GENERAL_RULES))} || chr(10))"
    return f"({trim(chain(x, R.PATTERN_RULES + R.COLLAPSE_RULES))} || chr(10))"


def restore_links(x: str) -> str:
    return chain(x, R.RESTORE_LINK_RULES)


def finish(x: str) -> str:
    return clean(html_to_markdown(restore_links(x)))


def convert_plain(x: str, includes: str | None = None) -> str:
    x = trim_cells(tables(strip_page(x)))
    if includes:
        x = fill_includes(x, includes)
    return finish(x)


def unescape(x: str) -> str:
    return chain(x, R.UNESCAPE_RULES)


def include_items(x: str) -> str:
    def item(inner: str) -> str:
        return f"('- ' || {trim(replace_all(chain(trim(inner), R.ANCHOR_RULES), R.ANY_TAG, ''))})"

    def anchor(tag: str) -> str:
        text = trim(replace_all(extract(tag, R.ANCHOR, 2, "i"), R.ANY_TAG, ""))
        return f"('- [' || {text} || '](' || {extract(tag, R.ANCHOR, 1, 'i')} || ')')"

    def items(v: str) -> str:
        listed = each(extract_all(extract(v, R.FIRST_LIST, 1, "i"), R.LIST_ITEM, 1, "i"), item)
        return f"CASE WHEN len({listed}) > 0 THEN {listed} ELSE {each(extract_all(v, R.ANCHOR, 0, 'i'), anchor)} END"

    return let(x, items)
