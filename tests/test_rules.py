"""Hand-derived results of the text rules and functions."""

import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from checks import duck as D
from wikitables.functions import rules as R
from wikitables.functions import text as T
from wikitables.functions.regex import EXOTIC, apply_rules, has_exotic, java, rewrite_spans
from wikitables.operators import markdown as M
from wikitables.operators.refs import attachment_candidates, include_items


def run(spark, fn, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = [r[0] for r in df.orderBy("i").select(fn(F.col("t"))).collect()]
    return out[0] if len(out) == 1 else out


@pytest.mark.parametrize(
    "title, slug",
    [
        ("My Page Title!", "my-page-title"),
        ("  outer  spaces ", "-outer-spaces-"),
        ("a -- b", "a-b"),
        ("Ünïcode Ärger", "ncode-rger"),
        ("Пример", ""),
        ("tab and　wide", "tab-and-wide"),
        ("snake_case", "snake_case"),
    ],
)
def test_slugify(spark, title, slug):
    assert run(spark, T.slugify, title) == slug


def test_slug_is_stable_on_its_own_output(spark):
    once = run(spark, T.slugify, "A b", "C -- d!", "x" * 70)
    assert run(spark, T.slugify, *once) == once
    assert len(run(spark, T.slugify50, "x" * 70)) == 50


def test_unslugify(spark):
    assert run(spark, T.unslugify, "200001-my-page_two") == "200001 My Page_two"
    assert run(spark, T.unslugify, "it's-fine") == "It'S Fine"


def test_extension(spark):
    split = lambda c: F.concat_ws("|", T.split_extension(c)["base"], T.split_extension(c)["ext"])
    assert run(spark, split, "a.b.png", ".hidden", "plain", "x.") == ["a.b|.png", ".hidden|", "plain|", "x|."]


def test_uri(spark):
    assert run(spark, T.encode_uri, "a b+c!*'()~é/") == "a%20b%2Bc!*'()~%C3%A9%2F"
    assert run(spark, T.decode_uri, "a%20b+c", "bad%zz") == ["a b+c", None]


def test_names(spark):
    assert run(spark, T.url_basename, "/x/y.png?v=1", "/x/", "/x/?q") == ["y.png", "image", ""]
    assert run(spark, T.simple_name, "--Pic_1.png%20x", "###") == ["Pic_1.png", ""]


def test_attachment_candidates(spark):
    inline = lambda c: attachment_candidates(F.lit("inline"), c)
    assert run(spark, inline, "a%20b.png", "bad%zz.png", "plain.png") == [
        ["a%20b.png", "a b.png", "a"], ["bad%zz.png"], ["plain.png"],
    ]
    assert run(spark, lambda c: attachment_candidates(F.lit("storage"), c), "My Pic.png") == ["My Pic.png", "My%20Pic.png"]


def test_entities_decode_in_order(spark):
    assert run(spark, T.text_decode, "&amp;lt;&nbsp;&quot;") == '< "'


def test_front_matter(spark):
    text = run(spark, lambda c: T.front_matter(c, F.lit("7"), F.lit("")), 'Say "hi"')
    assert text == '---\ntitle: "Say \\"hi\\""\nid: "7"\n---'


@pytest.mark.parametrize(
    "macro, out",
    [
        ('<ac:structured-macro ac:name="toc" />kept<ac:structured-macro ac:name="jira">x</ac:structured-macro>',
         "<!-- Table of Contents -->\n\nkept<!-- Jira Issues -->\n\n"),
        ('<ac:structured-macro ac:name="warning"><ac:rich-text-body>Hot</ac:rich-text-body></ac:structured-macro>', "> **Warning:** Hot\n\n"),
        ('<ac:structured-macro ac:name="note"><ac:rich-text-body>N</ac:rich-text-body></ac:structured-macro>', "> **Note:** N\n\n"),
        ('<ac:structured-macro ac:name="info"><ac:rich-text-body> B </ac:rich-text-body></ac:structured-macro>', "B\n\n"),
        ('<ac:structured-macro ac:name="info"><ac:parameter ac:name="title">T</ac:parameter><ac:rich-text-body>B</ac:rich-text-body></ac:structured-macro>',
         "[i] T\n\nB\n\n"),
        ('<ac:structured-macro ac:name="panel"><ac:rich-text-body>o <ac:structured-macro ac:name="panel"><ac:rich-text-body>i</ac:rich-text-body></ac:structured-macro> p</ac:rich-text-body></ac:structured-macro>',
         "o i\n\n p\n\n"),
        ('<ac:structured-macro ac:name="code"><ac:plain-text-body><![CDATA[a]]></ac:plain-text-body></ac:structured-macro>&<ac:structured-macro ac:name="code"><ac:parameter ac:name="language">py</ac:parameter><ac:plain-text-body><![CDATA[b$1]]></ac:plain-text-body></ac:structured-macro>',
         "```\na\n```\n\n&```py\nb$1\n```\n\n"),
        ('<ac:structured-macro ac:name="livesearch"/>', "<!-- Live Search -->\n\n"),
        ('<ac:structured-macro ac:name="contentbylabel"></ac:structured-macro>', "<!-- Content by Label -->\n\n"),
        ('<ac:structured-macro ac:name="recently-updated"/>', "<!-- Recently Updated Pages -->\n\n"),
        ('<ac:structured-macro ac:name="popular-labels"/>', "<!-- Popular Labels -->\n\n"),
        ('<ac:structured-macro ac:name="excerpt"><ac:rich-text-body>E</ac:rich-text-body></ac:structured-macro>', "E\n\n"),
    ],
)
def test_macros(spark, macro, out):
    assert run(spark, M.convert_macros, macro) == out


@pytest.mark.parametrize(
    "html, out",
    [
        ("<h1>A</h1><h6 class='x'>B</h6>", "# A\n\n###### B"),
        ("<strong>a</strong> <b>b</b> <em>c</em> <i>d</i>", "**a** **b** *c* *d*"),
        ("<b>open<br>next", "open\nnext"),
        ('<img src="x"><i>a</i>', "*a*"),
        ('<a class="q" href="u">t</a>', "[t](u)"),
        ("<ul><li>a</li><li>b</li></ul>", "- a\n- b"),
        ("<p>a</p><p>b</p>", "a\n\nb"),
        ("<pre><code>x\ny</code></pre><code>z</code>", "```\nx\ny\n```\n`z`"),
        ("a &lt;b&gt; &amp;amp;", "a <b> &amp;"),
        ("a\n\n\n\nb", "a\n\nb"),
    ],
)
def test_html(spark, html, out):
    assert run(spark, M.html_to_markdown, html) == out


@pytest.mark.parametrize(
    "text, out",
    [
        ("**a**\n\n**b**", "**ab**\n"),
        ("##  \nx", "x\n"),
        ("a ** ** b", "a   b\n"),
        ("> \nq", "q\n"),
        ("## **\nx", "x\n"),
        ("[ ]( )y  \nz\t", "y\nz\n"),
        ("-\n*\n_\nk", "k\n"),
        ("a\n\n\n\n\n\nb", "a\n\n\nb\n"),
        ("x 　\ny", "x\ny\n"),
    ],
)
def test_clean(spark, text, out):
    assert run(spark, M.clean_markdown, text) == out


def test_tables(spark):
    html = "<table><tr><th>k</th><th> v </th></tr><tr><td>a<br/>b</td><td>x|y</td></tr></table>"
    text = run(spark, lambda c: M.trim_table_cells(M.tables_to_markdown(c)), html)
    assert text == "\n\n|k|v|\n|---|---|\n|a b|x\\|y|\n\n"
    assert run(spark, M.tables_to_markdown, "<table></table>") == "<table></table>"


def test_cell_lists(spark):
    cell = '<td class="c">x<ul><li>one</li><li><b>two</b></li><li> </li></ul></td>'
    assert run(spark, M.flatten_cell_lists, cell) == '<td class="c">x • one; • two</td>'
    assert run(spark, M.flatten_cell_lists, "<td><ul></ul></td>") == "<td><ul></ul></td>"


def test_restore_links(spark):
    # The backslash before a closing bracket belongs to the title here; the last stage removes it.
    text = r"\[T\]\(t.md\) !\[i\]( a.png) \[x\](y)"
    assert run(spark, M.restore_links, text) == r"[T\](t.md) ![i](a.png) [x](y)"
    assert run(spark, lambda c: M.final_unescape(M.restore_links(c)), text) == "[T](t.md) ![i](a.png) [x](y)"


def test_include_items(spark):
    assert run(spark, include_items, '<ul><li> <a href="u">L</a>x</li><li></li></ul>') == ["- [L](u)x", "- "]
    assert run(spark, include_items, '<ul></ul><a href="u"><b>L</b></a>') == ["- [L](u)"]
    assert run(spark, include_items, "none") == []


def _fuzz(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    atoms = (
        "a B ** * _ __ # ## > ``` ` - + | [ ] ( ) \\ ! \n \n \n\n \t   　 \r\n   <b> </b> <B> <i> </I> <p> </p> <p class='x'> "
        "<h1> </h1> <h3> </H3> <ul> <li> </li> </ul> <ol> </ol> <br> <br/> <pre><code> </code></pre> <code> </code> "
        "<a href=\"u\"> </a> <strong> </strong> <em> </em> <td> </td> <tr> </tr> <table> </table> &amp; &lt; &nbsp; x.md "
        "<ac:link> </ac:link> <ac:layout> <time datetime=\"d\"/> <!-- --> <script> </script> é ß"
    ).split(" ") + [" ", "  ", " \n"]
    return ["".join(rng.choice(atoms) for _ in range(rng.randint(1, 30))) for _ in range(n)]


def test_both_engines_and_both_spellings_agree(spark):
    """The guarded steps equal the plain chain in Spark and the same rules in RE2."""
    texts = _fuzz(7, 4000)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, html string").repartition(8)
    plain = df.select("id", M.clean_markdown(M.html_to_markdown(M.restore_links(F.col("html")))).alias("want"))
    both = M.finish_page(df, "html").join(plain, "id")
    assert [tuple(r) for r in both.where("html <> want").limit(3).collect()] == []

    whole = M.convert_plain(df.withColumn("html", M.normalize_newlines(F.col("html"))), "html")
    mine = {r["id"]: r["html"] for r in whole.collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (id INT, html VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(texts)))
    theirs = dict(con.sql(f"SELECT id, {D.convert_plain(D.newlines('html'))} FROM t").fetchall())
    assert [(texts[i], mine[i], theirs[i]) for i in mine if mine[i] != theirs[i]][:3] == []
    assert not any("\n\n\n\n" in text for text in mine.values())


def test_long_blank_runs_take_one_pass(spark):
    """Many blank lines after a marker must not multiply the ways to match."""
    blank = " \n" * 1_000
    assert run(spark, M.clean_markdown, f"**{blank}x", f"```{blank}x", f"# **{blank}x", f"*{blank}x") is not None


def test_replacements_keep_dollars(spark):
    assert run(spark, lambda c: apply_rules(c, [("x", "", "(a)", r"$1\1")]), "a") == "$1a"
    assert {r[0] for r in R.HTML_RULES} >= {"h1", "p", "any_tag"}


def macro(name, inner="", title=None):
    parameter = f'<ac:parameter ac:name="title">{title}</ac:parameter>' if title else ""
    return f'<ac:structured-macro ac:name="{name}">{parameter}<ac:rich-text-body>{inner}</ac:rich-text-body></ac:structured-macro>'


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (macro("panel", "A" + macro("panel", "B" + macro("panel", "C") + "D") + "E") + "F", "ABC\n\nD\n\nE\n\nF"),
        ('<ac:structured-macro ac:name="info" />KEEP1' + macro("toc") + "END", "<!-- Confluence Macro: info -->\n\nKEEP1<!-- Table of Contents -->\n\nEND"),
        ('<ac:structured-macro ac:name="note"/>KEEP2' + macro("note", "n"), "<!-- Confluence Macro: note -->\n\nKEEP2> **Note:** n\n\n"),
        (
            '<ac:structured-macro ac:name="code" />KEEP3<ac:structured-macro ac:name="code"><ac:plain-text-body><![CDATA[a<ac:structured-macro ac:name="x">b]]></ac:plain-text-body></ac:structured-macro>',
            '<!-- Confluence Macro: code -->\n\nKEEP3```\na<ac:structured-macro ac:name="x">b\n```\n\n',
        ),
        (macro("info", "in " + macro("warning", macro("excerpt", "x")), "T"), "[i] T\n\nin > **Warning:** x\n\n"),
        ("a</ac:structured-macro>b" + '<ac:structured-macro ac:name="panel">open', 'a</ac:structured-macro>b<ac:structured-macro ac:name="panel">open'),
    ],
)
def test_macros_at_any_depth(spark, html, want):
    assert spark.createDataFrame([(html,)], "t string").select(M.convert_macros(F.col("t"))).first()[0] == want


def test_table_macros_nest(spark):
    html = macro("table-filter", macro("note", "n") + "<table/>") + '<ac:structured-macro ac:name="table" />' + macro("note", "m")
    want = macro("note", "n") + "<table/>\n\n" + macro("note", "m")
    assert spark.createDataFrame([(html,)], "t string").select(M.unwrap_tables(F.col("t"))).first()[0] == want


@pytest.mark.parametrize("piece", ["<script>", "<!--", "<style>", "<td>", "<table>", '<ac:structured-macro ac:name="code">', "<![CDATA["])
def test_unclosed_spans_take_linear_time(spark, piece):
    """A megabyte of openings without closings; the quadratic search took minutes."""
    text = piece * (1_000_000 // len(piece)) if "ac:" not in piece else piece * 2_000
    started = time.time()
    df = spark.createDataFrame([("a" + text,)], "t string")
    for stage in (M.drop_scripts, M.flatten_cell_lists, M.tables_to_markdown, M.unwrap_tables, M.convert_macros):
        assert df.select(stage(F.col("t"))).first()[0].startswith("a")
    assert time.time() - started < 60


@pytest.mark.parametrize("seed", range(3))
def test_spans_equal_the_lazy_pattern(spark, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choices(["<td a>", "<td>", "</td>", "</TD>", "x", "\n", "<"], k=rng.randrange(12))) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    span = rewrite_spans(F.col("t"), R.CELL_OPEN, R.CELL_CLOSE, lambda s: F.concat(F.lit("["), s, F.lit("]")), "i")
    for r in df.select("t", span.alias("got")).collect():
        assert r["got"] == re.sub(r"(?is)<td[^>]*>.*?</td>", lambda m: f"[{m[0]}]", r["t"])


def test_unusual_white_space_is_found_by_literals(spark):
    """The literal search finds exactly the characters of the class, which the conversion's plan no longer holds."""
    rows = [(i, f"a{chr(i)}b") for i in range(1, 0x10000) if not 0xD800 <= i <= 0xDFFF] + [(0, None)]
    df = spark.createDataFrame(rows, "i int, t string")
    found = has_exotic(F.col("t"))
    assert df.where(~found.eqNullSafe(F.col("t").rlike(java(EXOTIC)))).count() == 0
    assert df.where(found).count() == 20
    plan = M.finish_page(df.select("i", F.col("t").alias("html")), "html")._jdf.queryExecution().optimizedPlan().toString()
    assert java(EXOTIC) not in plan
