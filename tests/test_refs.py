"""Reference resolution and the corpus conversion."""

from pyspark.sql import functions as F

from wikitables.operators import refs
from wikitables.operators.refs import MarkdownOptions

LIST = '<ac:structured-macro ac:name="list-children"></ac:structured-macro>'


def include(title):
    return f'<ac:structured-macro ac:name="include"><ri:page ri:content-title="{title}" /></ac:structured-macro>'


def children(title=None):
    inner = f'<ri:page ri:content-title="{title}" />' if title else ""
    return f'<ac:structured-macro ac:name="children">{inner}</ac:structured-macro>'


def make(spark, *rows):
    """``(id, title, parent_id, html)``."""
    full = [(n, *row) for n, row in enumerate(rows)]
    return spark.createDataFrame(full, "pos long, id string, title string, parent_id string, html string")


def bodies(df):
    """Markdown without its front matter, by page."""
    out = {}
    for r in df.collect():
        assert r["id"] not in out
        out[r["id"]] = r["markdown"].split("---\n\n", 1)[-1]
    return out


def convert(pages, users, **options):
    return refs.pages_to_markdown(pages, pages.drop("html"), users, MarkdownOptions(**options))


def test_links_and_lists(spark):
    users = spark.createDataFrame([("key1", "ann", "Ann $1 \\1")], "user_key string, username string, display_name string")
    pages = make(
        spark,
        ("1", "Home", None,
         '<p><ac:link><ri:user ri:username="ann" /></ac:link>, <ac:link><ri:user ri:username="x.y" /></ac:link>, '
         '<ac:link><ri:user ri:userkey="key1" /></ac:link>, <ac:link><ri:user ri:userkey="0123456789abcdef" /></ac:link></p>' + LIST),
        ("2", "First Child", "1", '<ac:link> <ri:page ri:content-title="Home" /> </ac:link> ' + children("Home")),
        ("3", "Second $1 Child", "1", children() + children("Home") + children("Nobody")),
        ("4", "Home", None, LIST + "text"),
    )
    got = bodies(convert(pages, users))
    assert got["1"] == (
        "@Ann $1 \\1, @x.y, @Ann $1 \\1, @user-89abcdef\n\n- [First Child](first-child.md)\n- [Second $1 Child](second-1-child.md)\n"
    )
    both = "- [First Child](first-child.md)\n- [Second $1 Child](second-1-child.md)\n"
    assert got["2"] == "[Home](home.md) " + both
    assert got["3"] == both
    assert got["4"] == "text\n"


def test_resolved_links(spark, no_users):
    pages = make(spark, ("1", "Home", None, '<ri:page ri:content-title="Home" /> <ri:page ri:content-title="No" />'))
    assert bodies(convert(pages, no_users, resolved_links=True)) == {"1": "[Home](1-home.md) [No](no.md)\n"}


def test_includes(spark, no_users):
    pages = make(
        spark,
        ("1", "Listed", None, '<ul><li><a href="u">L</a></li></ul>'),
        ("2", "Linked", None, '<a href="v"><b>M</b></a>'),
        ("3", "Plain", None, "<h2>P</h2>body" + include("Listed")),
        ("4", "Reader", None, include("Listed") + "and" + include("Linked") + "also" + include("Nope") + include("Plain")),
        ("5", "Narcissus", None, "me" + include("Narcissus")),
        ("6", "Empty", None, ""),
        ("7", "Wants Empty", None, "x" + include("Empty")),
    )
    got = bodies(convert(pages, no_users))
    assert got["4"] == (
        "## Listed\n\n- [L](u)\n\nand\n\n## Linked\n\n- [M](v)\n\nalso\n\n## Plain\n\n## P\nbody\n"
    )
    assert got["3"].endswith("body\n\n## Listed\n\n- [L](u)\n")
    assert got["5"] == "me\n" and got["6"] == "\n" and got["7"] == "x\n"


def test_overrides_win(spark, no_users):
    pages = make(spark, ("1", "Useful", None, "<ul><li>one</li></ul>"), ("2", "Other", None, "<ul><li>two</li></ul>"), ("3", "R", None, include("Useful")))
    overrides = spark.createDataFrame([("Useful", "2")], "title string, id string")
    got = bodies(refs.pages_to_markdown(pages, pages.drop("html"), no_users, overrides=overrides))
    assert got["3"] == "## Useful\n\n- two\n"


def test_long_child_list(spark, no_users):
    """More than 64,000 children: one page, one text, all children in order."""
    index = spark.range(1, 65_500).select(
        F.col("id").alias("pos"), F.col("id").cast("string").alias("id"), F.concat(F.lit("Page "), "id").alias("title"), F.lit("0").alias("parent_id")
    )
    top = make(spark, ("0", "Top", None, "<p>before</p>" + LIST + "<p>after</p>"))
    row = refs.pages_to_markdown(top, index.unionByName(top.drop("html")), no_users).collect()
    lines = [line for line in row[0]["markdown"].split("---\n\n", 1)[1].split("\n") if line]
    assert len(row) == 1 and lines == ["before", *[f"- [Page {n}](page-{n}.md)" for n in range(1, 65_500)], "after"]


def test_private_use_characters(spark, no_users):
    """Icon fonts use the characters that fence includes meanwhile."""
    odd = "\ue000x\ue001 \ue002\ue003 \ue005"
    pages = make(
        spark,
        ("1", f"T {odd}", None, f"{odd} one"),
        ("2", "Reader", "1", f'{odd}<ac:image><ri:attachment ri:filename="a{odd}.png" /></ac:image>' + include(f"T {odd}") + include(f"No {odd}")),
        ("3", "Lists", None, children(f"T {odd}") + include("Reader")),
        ("4", f"Child {odd}", "3", "x"),
        ("5", "Parent", None, children("Lists")),
    )
    df = convert(pages, no_users)
    got = bodies(df)
    assert got["1"] == f"{odd} one\n"
    assert got["2"].startswith(odd + f"![a{odd}.png](images/") and f"## T {odd}\n\n{odd} one" in got["2"]
    assert got["5"].startswith(f"- [Child {odd}](") and "## Reader" in got["3"]
    assert df.where("id = '2'").first()["images"][0]["name"] == f"a{odd}.png"


def test_page_included_whole_keeps_its_references(spark):
    users = spark.createDataFrame([("k", "ann", "Ann")], "user_key string, username string, display_name string")
    pages = make(
        spark,
        ("1", "Whole", None, '<p>by <ac:link><ri:user ri:username="ann" /></ac:link></p>' + LIST),
        ("2", "Below", "1", "x"),
        ("3", "Reader", None, include("Whole")),
    )
    assert "by @Ann\n\n- [Below](below.md)" in bodies(convert(pages, users))["3"]
    html = {r["id"]: r["html"] for r in refs.expand_includes(pages, pages.drop("html"), users).collect()}
    assert "by @Ann\n\n- [Below](below.md)" in html["3"]


def test_equal_page_ids(spark, no_users):
    pages = make(spark, ("1", "Home", None, LIST + "a"), ("2", "Sub", "1", "b"))
    twice = pages.unionByName(pages.where("id = '1'"))
    assert refs.pages_to_markdown(twice, pages.drop("html"), no_users).count() == 3


def test_front_matter_and_file(spark, no_users):
    pages = make(spark, ("7", 'A "b" ' + "x" * 60, None, "t"))
    row = convert(pages, no_users, base_url="http://w/").first()
    assert row["file"] == "7-a-b-" + "x" * 46 + ".md" and len(row["file"]) == 2 + 50 + 3
    assert row["markdown"] == f'---\ntitle: "7 A B X{"x" * 45}"\nid: "7"\nurl: "http://w/pages/viewpage.action?pageId=7"\n---\n\nt\n'


def test_images_and_attachments(spark, no_users):
    pages = make(
        spark,
        ("1", "A", None, '<ac:image><ri:attachment ri:filename="My Pic$1.png" /></ac:image>'
                         '<img src="/download/attachments/9/a%20b.png?x=1" data-linked-resource-container-id="9">'
                         '<img src="/download/attachments/1/gone.png">'),
    )
    df = convert(pages, no_users)
    assert bodies(df)["1"] == "![My Pic$1.png](images/my-pic1.png)![a%20b.png](images/a20b.png)![gone.png](images/gone.png)\n"
    files = spark.createDataFrame([("1", "My%20Pic%241.png", b"p"), ("9", "a b.png", b"q"), ("9", "a", b"r")], "page_id string, filename string, content binary")
    got = refs.resolve_attachments(refs.image_manifest(df), files).orderBy("pos").collect()
    assert [(r["container_id"], r["filename"], bytes(r["content"]) if r["content"] else None, r["found"]) for r in got] == [
        ("1", "My%20Pic%241.png", b"p", True), ("9", "a b.png", b"q", True), ("1", None, None, False),
    ]


def test_crlf_and_filter_on_result(spark, no_users):
    pages = make(spark, ("1", "A", None, "a\r\n<p>b</p>\rc"))
    df = convert(pages, no_users)
    assert bodies(df)["1"] == "a\nb\n\nc\n"
    assert df.where(F.col("markdown").contains("b")).count() == 1


def test_manifest_needs_no_markdown(spark, no_users):
    """The image manifest takes the steps up to the images, a filter on the Markdown none twice."""
    pages = make(spark, ("1", "A", None, '<p><strong>x</strong></p><ac:image><ri:attachment ri:filename="a.png" /></ac:image>'))
    converted = convert(pages, no_users)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "</strong>" in plan(converted)
    assert "</strong>" not in plan(refs.image_manifest(converted))
    assert plan(converted.where(F.col("markdown").contains("x"))).count("</strong>") == plan(converted).count("</strong>")
    assert [(r["pos"], r["name"]) for r in refs.image_manifest(converted).collect()] == [(0, "a.png")]


def test_assemble_in_parts(spark):
    pieces = spark.range(10).select(F.lit("p").alias("id"), "id").toDF("id", "pos").withColumn("s", F.col("pos").cast("string"))
    assert [tuple(r) for r in refs.assemble_page(pieces, ",", size=4).collect()] == [("p", "0,1,2,3,4,5,6,7,8,9")]
