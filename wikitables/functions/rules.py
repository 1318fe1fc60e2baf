"""The text rules of the wiki-to-Markdown conversion, as plain data.

Each rule is ``(name, flags, pattern, replacement)``; groups in replacements
are written ``\\1``.  Patterns are written once and rendered for Java regex
(Spark) or RE2 (DuckDB checks) by :mod:`wikitables.functions.regex`, which also
spells out ``\\s`` and ``.`` so that both engines see the same characters.
Users may extend or replace any of these lists.
"""

from __future__ import annotations

Rule = tuple[str, str, str, str]

# --------------------------------------------------------------------------
# Patterns and output texts that must equal the wiki's storage
# format and the expected Markdown.
# --------------------------------------------------------------------------

# Line ends are unified and script, style and comments dropped before anything else.
PREPARE_RULES: list[Rule] = [
    ("newlines", "", r"\r\n?", "\n"),
]

DROP_RULES: list[Rule] = [
    ("script", "i", r"<script[^>]*>[\s\S]*?</script>", ""),
    ("style", "i", r"<style[^>]*>[\s\S]*?</style>", ""),
    ("comment", "", r"<!--[\s\S]*?-->", ""),
]

# The same as openings and closings of spans: (opening, closing, flags).
DROPPED_SPANS = [(r"<script[^>]*>", "</script>", "i"), (r"<style[^>]*>", "</style>", "i"), ("<!--", "-->", "")]

TABLE_MACRO_RULES: list[Rule] = [
    (
        "table_macro",
        "is",
        r'<ac:structured-macro[^>]*ac:name="(?:table|table-filter)"[^>]*>[\s\S]*?<ac:rich-text-body>([\s\S]*?)</ac:rich-text-body>[\s\S]*?</ac:structured-macro>',
        "\\1\n\n",
    ),
]

# Macros whose whole span is matched once and then rebuilt from its parts.
CODE_MACRO = r'<ac:structured-macro[^>]*ac:name="code"[^>]*>(.*?)<ac:plain-text-body><!\[CDATA\[(.*?)\]\]></ac:plain-text-body>.*?</ac:structured-macro>'
CODE_LANGUAGE = r'<ac:parameter[^>]*ac:name="language"[^>]*>(.*?)</ac:parameter>'
INFO_MACRO = r'<ac:structured-macro[^>]*ac:name="info"[^>]*>([\s\S]*?)</ac:structured-macro>'
INFO_TITLE = r'<ac:parameter[^>]*ac:name="title"[^>]*>([\s\S]*?)</ac:parameter>'
INFO_BODY = r"<ac:rich-text-body>([\s\S]*?)</ac:rich-text-body>"
# Tags of macros, and CDATA, whose content is text; without an end it reaches to the end.
MACRO_TAG = r"<!\[CDATA\[.*?(?:\]\]>|\z)|</?ac:structured-macro[^>]*>"
MACRO_NAME = r'ac:name="([^"]*)"'
# The body of one macro whose inner macros may still stand: from its first opening to its last closing.
MACRO_BODY = r"<ac:rich-text-body>([\s\S]*)</ac:rich-text-body>"
CODE_BODY = r"^(.*?)<ac:plain-text-body><!\[CDATA\[(.*?)\]\]></ac:plain-text-body>"
# What stands before and after the body of a macro.
BODY_MACROS = {"warning": ("> **Warning:** ", "\n\n"), "note": ("> **Note:** ", "\n\n"), "panel": ("", "\n\n"), "excerpt": ("", "\n\n")}
MARKER_MACROS = {
    "toc": "<!-- Table of Contents -->\n\n",
    "contentbylabel": "<!-- Content by Label -->\n\n",
    "livesearch": "<!-- Live Search -->\n\n",
    "jira": "<!-- Jira Issues -->\n\n",
    "recently-updated": "<!-- Recently Updated Pages -->\n\n",
    "popular-labels": "<!-- Popular Labels -->\n\n",
}
OTHER_MACRO = ("<!-- Confluence Macro: ", " -->\n\n")
TABLE_MACROS = ("table", "table-filter")

BODY_MACRO_RULES: list[Rule] = [
    ("warning", "is", r'<ac:structured-macro[^>]*ac:name="warning"[^>]*>.*?<ac:rich-text-body>(.*?)</ac:rich-text-body>.*?</ac:structured-macro>', "> **Warning:** \\1\n\n"),
    ("note", "is", r'<ac:structured-macro[^>]*ac:name="note"[^>]*>.*?<ac:rich-text-body>(.*?)</ac:rich-text-body>.*?</ac:structured-macro>', "> **Note:** \\1\n\n"),
    ("panel", "is", r'<ac:structured-macro[^>]*ac:name="panel"[^>]*>.*?<ac:rich-text-body>(.*?)</ac:rich-text-body>.*?</ac:structured-macro>', "\\1\n\n"),
    ("excerpt", "is", r'<ac:structured-macro[^>]*ac:name="excerpt"[^>]*>.*?<ac:rich-text-body>(.*?)</ac:rich-text-body>.*?</ac:structured-macro>', "\\1\n\n"),
]

# A self-closing macro is taken on its own; otherwise the span runs to the next closing tag.
MARKER_MACRO_RULES: list[Rule] = [
    ("toc", "is", r'<ac:structured-macro[^>]*ac:name="toc"[^>]*?(?:/>|>.*?</ac:structured-macro>)', "<!-- Table of Contents -->\n\n"),
    ("contentbylabel", "is", r'<ac:structured-macro[^>]*ac:name="contentbylabel"[^>]*?(?:/>|>.*?</ac:structured-macro>)', "<!-- Content by Label -->\n\n"),
    ("livesearch", "is", r'<ac:structured-macro[^>]*ac:name="livesearch"[^>]*?(?:/>|>.*?</ac:structured-macro>)', "<!-- Live Search -->\n\n"),
    ("jira", "is", r'<ac:structured-macro[^>]*ac:name="jira"[^>]*?(?:/>|>.*?</ac:structured-macro>)', "<!-- Jira Issues -->\n\n"),
    ("recently_updated", "is", r'<ac:structured-macro[^>]*ac:name="recently-updated"[^>]*?(?:/>|>.*?</ac:structured-macro>)', "<!-- Recently Updated Pages -->\n\n"),
    ("popular_labels", "is", r'<ac:structured-macro[^>]*ac:name="popular-labels"[^>]*?(?:/>|>.*?</ac:structured-macro>)', "<!-- Popular Labels -->\n\n"),
    ("other_macro", "is", r'<ac:structured-macro[^>]*ac:name="([^"]*)"[^>]*?(?:/>|>.*?</ac:structured-macro>)', "<!-- Confluence Macro: \\1 -->\n\n"),
]

# References that are resolved against other tables.
CHILDREN_MACRO = r'<ac:structured-macro[^>]*ac:name="children"[^>]*?(?:/>|>[\s\S]*?</ac:structured-macro>)'
LIST_CHILDREN_MACRO = r'<ac:structured-macro[^>]*ac:name="list-children"[^>]*?(?:/>|>.*?</ac:structured-macro>)'
INCLUDE_MACRO = r'<ac:structured-macro[^>]*ac:name="include"[^>]*?(?:/>|>[\s\S]*?</ac:structured-macro>)'
MACRO_TITLE = r'ri:content-title="([^"]+)"'
USERNAME_LINK = r'<ac:link[^>]*><ri:user[^>]*ri:username="([^"]+)"[^>]*/></ac:link>'
USERKEY_LINK = r'<ac:link[^>]*><ri:user[^>]*ri:userkey="([^"]+)"[^>]*/></ac:link>'
PAGE_LINK = r'<ac:link[^>]*>\s*<ri:page[^>]*ri:content-title="([^"]+)"[^>]*/>\s*</ac:link>'
BARE_PAGE_LINK = r'<ri:page[^>]*ri:content-title="([^"]+)"[^>]*/>'
STORAGE_IMAGE = r'<ac:image[^>]*><ri:attachment[^>]*ri:filename="([^"]+)"[^>]*/></ac:image>'
INLINE_IMAGE = r'<img[^>]*src="([^"]*/download/attachments/[^"\s]+)"[^>]*>'
CONTAINER_ID = r'data-linked-resource-container-id="([^"<>]+)"'

NO_CHILDREN = "<!-- Child Pages -->\n\n"
NO_LISTED_CHILDREN = "<!-- Child Pages List -->\n\n"
NO_INCLUDE_TITLE = "<!-- Include macro -->\n\n"
INCLUDE_NOT_FOUND = ("<!-- Include: ", " (page not found) -->\n\n")

# Table cells holding lists.
TABLE_CELL = r"<td([^>]*)>([\s\S]*?)</td>"
CELL_OPEN, CELL_CLOSE = r"<td[^>]*>", "</td>"
LIST_OPEN = r"<ul[^>]*>|<ol[^>]*>"
LIST_ITEM = r"<li[^>]*>([\s\S]*?)</li>"
ANY_TAG = r"<[^>]+>"
CELL_LIST_RULES: list[Rule] = [
    ("cell_ul", "i", r"<ul[^>]*>[\s\S]*?</ul>", ""),
    ("cell_ol", "i", r"<ol[^>]*>[\s\S]*?</ol>", ""),
]

# Tables: the first row is the header, cells are single lines.
TABLE = r"<table[^>]*>[\s\S]*?</table>"
TABLE_OPEN, TABLE_CLOSE = r"<table[^>]*>", "</table>"
TABLE_ROW = r"<tr[^>]*>([\s\S]*?)</tr>"
TABLE_ROW_CELL = r"<t[hd](?:\s[^>]*)?>([\s\S]*?)</t[hd]>"
TABLE_CELL_RULES: list[Rule] = [
    ("cell_breaks", "i", r"</?(?:p|div|br|ul|ol|li)(?:\s[^>]*)?/?>", " "),
    ("cell_spaces", "", r"\s+", " "),
]

# Lists of an included page.
FIRST_LIST = r"<ul[^>]*>([\s\S]*?)</ul>"
ANCHOR = r'<a[^>]*href="([^"]+)"[^>]*>(.*?)</a>'
ANCHOR_RULES: list[Rule] = [("anchor", "i", ANCHOR, r"[\2](\1)")]

LAYOUT_RULES: list[Rule] = [
    ("layout", "i", r"</?ac:layout[^>]*>", ""),
    ("time", "i", r'<time[^>]*datetime="([^"]+)"[^>]*/?>', r"\1"),
]

RESTORE_LINK_RULES: list[Rule] = [
    ("page_link", "", r"\\?\[([^\]]+)\\?\]\\?\(([^)]+\.md)\\?\)", r"[\1](\2)"),
    ("image", "", r"!\\\[([^\]]+)\\\]\(\s*([^\)]+)\s*\)", r"![\1](\2)"),
    ("link", "", r"\\\[([^\]]+)\\\]\(\s*([^\)]+)\s*\)", r"[\1](\2)"),
]

HTML_RULES: list[Rule] = [
    ("ac_link", "", r"<ac:link[^>]*>[\s\S]*?</ac:link>", ""),
    ("h1", "i", r"<h1[^>]*>(.*?)</h1>", "\n# \\1\n"),
    ("h2", "i", r"<h2[^>]*>(.*?)</h2>", "\n## \\1\n"),
    ("h3", "i", r"<h3[^>]*>(.*?)</h3>", "\n### \\1\n"),
    ("h4", "i", r"<h4[^>]*>(.*?)</h4>", "\n#### \\1\n"),
    ("h5", "i", r"<h5[^>]*>(.*?)</h5>", "\n##### \\1\n"),
    ("h6", "i", r"<h6[^>]*>(.*?)</h6>", "\n###### \\1\n"),
    ("strong", "i", r"<strong[^>]*>(.*?)</strong>", r"**\1**"),
    ("b", "i", r"<b(?:\s[^>]*)?>(.*?)</b>", r"**\1**"),
    ("em", "i", r"<em(?:\s[^>]*)?>(.*?)</em>", r"*\1*"),
    ("i", "i", r"<i(?:\s[^>]*)?>(.*?)</i>", r"*\1*"),
    ("a", "i", r'<a[^>]*href="([^"]*)"[^>]*>(.*?)</a>', r"[\2](\1)"),
    ("ul_open", "i", r"<ul[^>]*>", "\n"),
    ("ul_close", "i", r"</ul>", "\n"),
    ("ol_open", "i", r"<ol[^>]*>", "\n"),
    ("ol_close", "i", r"</ol>", "\n"),
    ("li", "i", r"<li(?:\s[^>]*)?>(.*?)</li>", "- \\1\n"),
    ("p", "i", r"<p(?:\s[^>]*)?>(.*?)</p>", "\\1\n\n"),
    ("pre_code", "i", r"<pre[^>]*><code[^>]*>([\s\S]*?)</code></pre>", "```\n\\1\n```\n"),
    ("code", "i", r"<code[^>]*>(.*?)</code>", r"`\1`"),
    ("br", "i", r"<br\s*/?>", "\n"),
    ("any_tag", "", r"<[^>]+>", ""),
]

ENTITIES: list[tuple[str, str]] = [
    ("&nbsp;", " "),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
]

BLANK_LINE_RULES: list[Rule] = [("blank_lines", "", r"\n{3,}", "\n\n")]

# White space "with a line break in it" is written as blanks, line break, anything: the same
# texts match, but in one pass instead of one per way to place the break.
PATTERN_RULES: list[Rule] = [
    ("bold_over_blank", "", r"\*\*[^\S\n]*\n[^\S\n]*\n\s*\*\*", ""),
    ("bold_line", "m", r"^\s*\*\*\s*$", ""),
    ("empty_header", "m", r"^#+\s*$", ""),
    ("empty_bold", "", r"\*\*\s+\*\*", " "),
    ("empty_italic", "", r"\*\s+\*", " "),
    ("empty_quote", "m", r"^>\s*$", ""),
    ("empty_code", "", r"```[^\S\n]*\n\s*```", ""),
    ("short_rule", "m", r"^[-*_]\s*$", ""),
]

GENERAL_RULES: list[Rule] = [
    ("header_bold", "m", r"^#+\s*\*\*\s*$", ""),
    ("header_italic", "m", r"^#+\s*\*\s*$", ""),
    ("header_bold_underscore", "m", r"^#+\s*__\s*$", ""),
    ("header_italic_underscore", "m", r"^#+\s*_\s*$", ""),
    ("header_bold_lines", "m", r"^(#+)\s*\*\*[^\S\n]*\n\s*\*\*\s*$", ""),
    ("header_italic_lines", "m", r"^(#+)\s*\*[^\S\n]*\n\s*\*\s*$", ""),
    ("touching_bold", "", r"\*\*\s*\*\*", ""),
    ("touching_underscore", "", r"__\s*__", ""),
    ("italic_line", "m", r"^\s*\*\s*$", ""),
    ("underscore_line", "m", r"^\s*_\s*$", ""),
    ("italic_over_lines", "", r"\*[^\S\n]*\n\s*\*", "\n\n"),
    ("empty_link", "", r"\[\s*\]\(\s*\)", ""),
    ("empty_item", "m", r"^[-*+]\s*$", ""),
    ("blank_lines", "", r"\n{4,}", "\n\n\n"),
    ("line_ends", "m", r"[^\S\n]+$", ""),
]

COLLAPSE_RULES: list[Rule] = [("collapse", "", r"\n{4,}", "\n\n\n")]

UNESCAPE_RULES: list[Rule] = [("unescape", "", r"\\([\[\]()])", r"\1")]

SLUG_RULES: list[Rule] = [
    ("drop_special", "", r"[^\w\s-]", ""),
    ("spaces", "", r"\s+", "-"),
    ("hyphens", "", r"-+", "-"),
]

SLUG_LIMIT = 50
FRONT_MATTER_FENCE = "---"
PAGE_URL_SUFFIX = "/pages/viewpage.action?pageId="
SITE_TREE_HEADING = "# Documentation Links"
