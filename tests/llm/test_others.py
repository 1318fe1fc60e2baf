"""Fingerprints, page texts, shards and the pipeline."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from wikitables.llm import fingerprints, html_extract, sharding

SF = "/root/testdata/sf0.001"


def test_levels():
    rng = np.random.default_rng(0)
    for n in (31, 32, 33, 500, 70_000):
        data = rng.choice(np.frombuffer(b"aaaabcdefgh .,\xc3", np.uint8), n)
        found = fingerprints.levels(data)
        assert len(found) == max(n - 31, 0)
        for at in range(0, len(found), max(len(found) // 50, 1)):
            counts = np.bincount(data[at : at + 32], minlength=256)
            assert found[at] == 1000 - int(fingerprints._TERMS[counts].sum()) * 1000 // int(fingerprints._TERMS[32])


def test_fingerprints_depend_on_the_text_alone():
    rng = np.random.default_rng(1)
    rank = rng.permutation(1001)
    texts = [bytes(rng.integers(97, 110, int(n), dtype=np.uint8)) for n in (0, 1, 31, 32, 33, 90, 3000, 40_000)]
    alone = [fingerprints.fingerprints([t], rank)[0] for t in texts]
    assert alone == fingerprints.fingerprints(texts, rank) and list(reversed(alone)) == fingerprints.fingerprints(texts[::-1], rank)
    assert alone[0] == b"" and all(alone[1:]) and len(alone[-1]) > 256
    assert fingerprints.likeness(b"", b"") == 1 and fingerprints.likeness(b"", alone[3]) == 0 and fingerprints.likeness(alone[7], alone[7]) == 1
    half = fingerprints.fingerprints([texts[7][:20_000] + texts[7][:5000][::-1] * 4], rank)[0]
    assert 0.3 < fingerprints.likeness(alone[7], half) < 0.8 and fingerprints.likeness(alone[6], alone[7]) < 0.1


def test_edited_short_texts_are_near():
    """Texts of 60 to 600 bytes, some of two-byte characters, keep half of their features with their first half; strangers none."""
    rng = np.random.default_rng(5)
    rank = rng.permutation(1001)
    for n in range(60, 600, 20):
        for letters in ("abcdefghijklmnop ", "абвгдежзиклмн "):
            text, other = ("".join(rng.choice(list(letters), n)) for _ in range(2))
            for following in (other, "".join(rng.choice(list("qrstuvwxyz"), n))):
                edited = fingerprints.edited_text(text, following)
                one, two, strange = fingerprints.fingerprints([t.encode() for t in (text, edited, other)], rank)
                assert fingerprints.likeness(one, two) > 0.15 and fingerprints.likeness(one, strange) < 0.1, n


def test_chain(stored_docs, hard_docs, hard, no_docs):
    found = fingerprints.fingerprint_chain(hard_docs).collect()
    assert len(found) == len(hard)
    texts = defaultdict(list)
    for i, t in hard:
        texts[i].append(t or "")
    order = sorted((i for i in texts if i is not None), reverse=True) + [None]
    for r in found:
        mine = texts[r["doc_id"]][0]
        following = texts[r["doc_id"]] if len(texts[r["doc_id"]]) > 1 else []
        following = [*following, texts[order[(order.index(r["doc_id"]) + 1) % len(order)]][0]]
        allowed = {hashlib.sha256(fingerprints.edited_text(mine, f).encode()).hexdigest() for f in following}
        assert r["n_chars"] == len(mine) and r["edited_sha256"] in allowed and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    prints = defaultdict(set)
    for r in found:
        prints[texts[r["doc_id"]][0]].add(bytes(r["fingerprint"]))
    assert all(len(p) == 1 for p in prints.values())
    assert fingerprints.fingerprint_chain(no_docs).count() == 0
    single = fingerprints.fingerprint_chain(stored_docs([(5, "abcdef")])).collect()
    assert [(r["edited_sha256"], r["near_next"]) for r in single] == [(hashlib.sha256(b"abcabc").hexdigest(), 1.0)]


ARTICLE = """<html><head><title>t</title><style>p{}</style></head><body class="home"><header class="masthead"><h1>Site</h1></header>
<div id="menu"><ul><li><a href=x>Home</a><li>News</ul></div><div class="cookie-notice">We use cookies</div>
<div id=content><article class=post><header><h1>Title &amp; more</h1></header><p>First<br>line &copy 2020<p>Second <b>bold</b> t<i>ex</i>t
<table><tr><td>a<td>b<tr><td>c</table><form><input>q</form><div class="ad">buy</div><ul><li>one<li>two</ul>
<section class="comments"><p>nice</p></section></article><aside>side</aside></div><footer>f</footer><script>if(a<b){"</p>"}</script></body>"""


def test_article():
    assert html_extract.main_text(html_extract.parse(ARTICLE), {}) == "Title & more\nFirst line © 2020\nSecond bold text\na b\nc\none\ntwo"
    assert html_extract.main_text(html_extract.parse('<p>a<p>b <a href="x>y">l</a> <div class=sidebar>no</div> 1 < 2 & 3 <p cla'), {}) == "a\nb l\n1 < 2 & 3"


def test_names_that_tell_of_layout_or_headings_drop_nothing():
    read = lambda source: html_extract.main_text(html_extract.parse(source), {})
    for names in ("no-sidebar", "hentry comments-open", "layoutWithSidebar", "search-results has-sidebar"):
        for tag in ("body", "article", "main", "html"):
            assert read(f'<{tag} class="{names}"><h2 id="related-work">Related</h2><p>text<h2 id=search>Search</h2></{tag}>') == "Related\ntext\nSearch"
    assert read("<div class=layoutWithSidebar><p>a</p><div class=left-sidebar>b</div><p class=page-search-area>c</p><div id=commentForm>d</div></div>") == "a\nc"
    source = "<body><div class=widget><p>all there is</p></div><nav>n</nav></body>"
    batch = pa.RecordBatch.from_pylist([{"carried": 1, "html": source, "slots": []}])
    assert [b.column("text").to_pylist() for b in html_extract._extract(iter([batch]))] == [["all there is"]]


@pytest.mark.parametrize("piece", ["<script>", "<!--", "<td>", "<p>", "<div>", '<a "', "<b><p>", "</div>", "<a b='"])
def test_broken_markup_is_read_in_linear_time(piece):
    html_extract.parse(piece * (500_000 // len(piece)))


def page(host, k, body):
    return (k, f"https://{host}/p{k}", body, "x", 1)


def test_template_finds_the_main_slot(spark, tmp_path):
    """Pages without article: the slot with the text wins over named and link-heavy parts; small hosts share a template."""
    rows = []
    for k in range(9):
        host = ["a.org", "b.org", f"small{k}.org"][k % 3]
        paragraphs = "".join(f"<p>Sentence {n} of page {k} on {host}.</p>" for n in range(3 + k % 3))
        links = "".join(f"<a href=x>link {k} {n} with a long text for so little</a> " for n in range(9))
        rows.append(page(host, k, f"<body><div class=top>Same line</div><div class=links>{links}</div><div class=c1>{paragraphs}</div><div class=sidebar>s {k}</div></body>"))
    rows += [page("a.org", 20, None), page("a.org", 21, ""), (22, None, "<p>bare", "x", 1), (None, "not a url", "<p>x", "x", 1)]
    path = f"{tmp_path}/pages"
    spark.createDataFrame(rows, "page_id long, url string, html string, host string, row int").write.parquet(path)
    pages = spark.read.parquet(path)
    found = {r["carried"]["page_id"]: r["text"] for r in html_extract.extract_pages(pages).collect()}
    assert len(found) == len(rows) and found[20] == found[21] == "" and found[22] == "bare" and found[None] == "x"
    for k in range(9):
        host = ["a.org", "b.org", f"small{k}.org"][k % 3]
        assert found[k] == "\n".join(f"Sentence {n} of page {k} on {host}." for n in range(3 + k % 3))
    assert html_extract.extract_pages(pages.limit(0)).count() == 0


def test_slots_beside_the_main_slot(spark, tmp_path):
    """Title, lead and both bodies of a container without article; links beside them stay out; of two articles both are kept."""
    rows, wanted = [], {}
    for k in range(5):
        links = "".join(f"<a href=x>see page {k} {n}</a> " for n in range(5))
        body = "".join(f"<p>Sentence {n} of {k}.</p>" for n in range(4 + k))
        parts = f"<h1>Title {k}</h1><p class=lead>Lead {k}.</p><div class=body>{body}</div><div class=more><p>More {k}.</p></div><div class=tags>{links}</div>"
        rows.append(page("a.org", k, f"<body><div class=top>Same line</div><div class=content>{parts}</div><div class=end>End line</div></body>"))
        wanted[k] = "\n".join([f"Title {k}", f"Lead {k}.", *(f"Sentence {n} of {k}." for n in range(4 + k)), f"More {k}."])
        two = f"<div class=left><article class=one><p>One {k}</article></div><div class=right><article class=two><p>Two {k}</article></div>"
        rows.append(page("b.org", 10 + k, f"<body><div class=top>Same line</div>{two}</body>"))
        wanted[10 + k] = f"One {k}\nTwo {k}"
    path = f"{tmp_path}/pages"
    spark.createDataFrame(rows, "page_id long, url string, html string, host string, row int").write.parquet(path)
    found = html_extract.extract_pages(spark.read.parquet(path)).collect()
    assert {r["carried"]["page_id"]: r["text"] for r in found} == wanted


def test_shards(hard_docs, hard, no_docs, spark, tmp_path):
    found = sharding.shard_documents(hard_docs, 4, slots=64, folder=str(tmp_path / "map")).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in found if r["doc_id"] is not None) == sorted(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in hard if i is not None
    )
    by_shard = defaultdict(list)
    for r in found:
        by_shard[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values()) and set(by_shard) <= set(range(4))
    version, shard_of = sharding.load_map(spark, str(tmp_path / "map"))
    assert version == 1 and all(shard_of[r["virtual_slot"]] == r["shard"] for r in found)
    assert sharding.shard_documents(no_docs, 4, slots=64).count() == 0


def test_map_is_even_and_grows_into_the_new_shard_only(spark, tmp_path):
    rng = np.random.default_rng(2)
    sizes = {v: (int(rng.integers(1, 1000)), 1) for v in range(2000)} | {5: (40_000, 1)}
    filled = lambda m: np.bincount(m, weights=[sizes.get(v, (0, 0))[0] for v in range(len(m))])
    first = sharding.balanced_map(sizes, 8, 2048)
    assert np.ptp(filled(first)) < 1000
    second = sharding.grown_map(first, sizes)
    assert all(b in (a, 8) for a, b in zip(first, second)) and 8 in second and np.ptp(filled(second)) < 5000
    for version, shard_of in ((1, first), (2, second)):
        sharding.save_map(spark, shard_of, str(tmp_path / "m"), version)
    assert sharding.load_map(spark, str(tmp_path / "m")) == (2, second) and sharding.load_map(spark, str(tmp_path / "m"), 1) == (1, first)


def test_calls_on_a_folder_follow_its_map(spark, tmp_path):
    """A second call uses the map, one for more shards edits it: records move into new shards alone, and none is without an id in one slot."""
    folder = str(tmp_path / "map")
    rows = [(k if k % 3 else None, "x" * (k * 37 % 400) + str(k)) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def placed(shards, docs=docs):
        found = sharding.shard_documents(docs, shards, slots=256, folder=folder).collect()
        by_shard = defaultdict(list)
        for r in found:
            by_shard[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in by_shard.values()) and len(found) == docs.count()
        return {(r["doc_id"], r["text_crc32"]): r["shard"] for r in found}, len(by_shard), [sum(r["size"] for r in found if r["shard"] == s) for s in by_shard]

    first, n, filled = placed(4)
    assert n == 4 and max(filled) < 1.1 * min(filled)
    assert placed(4)[0] == first and sharding.load_map(spark, folder)[0] == 1
    assert len({r["virtual_slot"] for r in sharding.sized_rows(docs.where("doc_id IS NULL"), 256).collect()}) > 100
    second, n, filled = placed(6)
    assert n == 6 and sharding.load_map(spark, folder)[0] == 3 and max(filled) < 1.5 * min(filled)
    assert all(second[k] in (first[k], 4, 5) for k in first)
    fewer = docs.where("text LIKE '%7'")
    assert placed(6, fewer)[0].items() <= second.items()  # other records, same map
    for shards, slots in ((5, 256), (6, 128)):
        with pytest.raises(ValueError):
            sharding.shard_documents(docs, shards, slots=slots, folder=folder)


def test_pipeline(spark, tmp_path):
    """Every stage works on what the one before kept; the last packs all of it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{tmp_path}/{k}"
        stage(spark, docs, SF).write.parquet(path)
        out = spark.read.parquet(path)
        if name != "packing":
            assert out.columns == columns and 0.5 * before < out.count() <= before
            before = out.count()
            docs = out
    assert out.select("doc_id").distinct().count() == before
    run = corpus_pipeline.run(spark, SF)
    assert run.count() == out.count() and run.agg({"length": "sum"}).first() == out.agg({"length": "sum"}).first()


def test_pipeline_stages_of_nothing(spark, hard_docs, no_docs, tmp_path):
    for k, docs in enumerate((no_docs, hard_docs)):
        documents = docs.select("doc_id", "text", "lang", "source", "n_chars")
        for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, documents, SF).write.parquet(f"{tmp_path}/{k}-{n}")
            documents = spark.read.parquet(f"{tmp_path}/{k}-{n}")
        assert (documents.count() > 0) == (k == 1)


def test_named_inline_elements_keep_their_text():
    page = '<article><p>See <span class="comment"># a note</span>, <a class="share-price" href=x>the price</a> and <em class=promo>more</em>.</p><div class="share">Share</div></article>'
    parsed = html_extract.parse(page)
    assert html_extract.main_text(parsed, {}) == "See # a note, the price and more."
