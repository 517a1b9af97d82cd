"""Archives and wrappers."""

import gzip
import hashlib
import os
import re

import pytest

from tokengrove.llm import capture_index as ci, wrapper
from tokengrove.llm.queries import ORACLES, QUERIES
from oracle import compare, connect
from .conftest import prose


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(name, spark, small):
    assert compare(QUERIES[name](spark, small), connect(small), ORACLES[name]) is None


ODD = [
    (1, "http://a.example.org/x", "<p>" + "a" * 200), (2, "http://a.example.org/x", "<p>" + "a" * 200), (3, None, None), (4, "not a url", ""),
    (5, "https://B.example.org:8080/q?x=1#f", "short"), (6, "https://b.example.org/q", "short"), (None, "http://c.example.org", "<p>" + "a" * 200),
    (7, "http://a.example.org/x\ty\r\nz", "é" * 5000), (1, "http://a.example.org/x", "<p>" + "a" * 200), (8, "http://ü.example.org/ä b", "€" * 40),
]


@pytest.fixture(scope="module")
def odd_pages(spark):
    return spark.createDataFrame([(*r, 0, "x") for r in ODD], "page_id long, url string, html string, digest int, host string")


def test_round_trip_odd_rows(odd_pages):
    rows = sorted((tuple(r) for r in ci.archive_round_trip(odd_pages).collect()), key=str)
    wanted = []
    for page_id, _, html in ODD:
        payload = (html or "").encode()
        revisit = len(payload) >= 100 and html.startswith("<p>") and page_id != 1
        wanted.append(
            (page_id, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if revisit else "response", 1 if revisit else None)
        )
    assert rows == sorted(wanted, key=str)
    assert ci.archive_round_trip(odd_pages.limit(0)).count() == 0


def test_archive_is_gzip_members_of_warc_records(spark, odd_pages, tmp_path):
    captures = ci.write_archive(odd_pages, str(tmp_path / "w")).collect()
    for c in captures:
        with open(tmp_path / "w" / c["file"], "rb") as f:
            f.seek(c["offset"])
            record = ci.parse_record(gzip.decompress(f.read(c["length"])))
        assert record["headers"]["warc-type"] in ("response", "revisit")
    whole = b"".join(gzip.open(os.path.join(tmp_path / "w", f)).read() for f in os.listdir(tmp_path / "w") if f.endswith(".gz"))
    assert whole.count(b"WARC/1.1\r\n") == len(ODD)


def test_lookup_by_address_over_many_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ci, "BLOCK_LINES", 3)
    monkeypatch.setattr(ci, "PAGE_BLOCKS", 2)
    rows = [(i, f"http://www.site{i % 5}.example.com/p{i % 7}", f"page {i}") for i in range(200)]
    rows += [(1000 + i, "http://hot.example.com/", f"hot {i}") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    captures = ci.write_archive(pages, str(tmp_path / "w"))
    directory = ci.build_index(captures, str(tmp_path / "i"))
    assert directory.count() > 10
    asked = [("com,example,hot)/",), ("com,example,site3,www)/p4",), ("com,example,nowhere)/",)]
    found = ci.read_captures(
        ci.lookup(spark.createDataFrame(asked, "key string"), directory, str(tmp_path / "i")), str(tmp_path / "w")
    ).collect()
    wanted = sorted(i for i, u, _ in rows if u in ("http://hot.example.com/", "http://www.site3.example.com/p4"))
    assert sorted(r["page_id"] for r in found) == wanted
    assert all(bytes(r["payload"]).decode() == dict((i, h) for i, _, h in rows)[r["page_id"]] for r in found)


def page(title, paragraphs, menu, extra=""):
    return (
        f"<!doctype html><html><head><title>{title}</title><style>p{{}}</style></head><body>"
        f"<header>Site name</header><nav><ul>{''.join(f'<li><a href=#>{m}</a>' for m in menu)}</ul></nav>"
        f"<div class='cookie-notice'>We use cookies</div><div id=main><h1>{title}</h1>"
        + "".join(f"<p>{p}" for p in paragraphs)
        + f"<p class=sig>All rights reserved by the editors</p></div><div class=comments><p>First! {title}</p></div>{extra}"
        "<form><label>Name</label><input></form><footer>&copy; us</footer></body></html>"
    )


def test_template_is_what_stays_the_same(spark):
    rows = [
        (i, f"http://news.example.com/{i}", page(f"Title {i}", [f"First &amp; only {i} text<br>of   the day.", f"More about {i}"], ["Home", "Now"]))
        for i in range(6)
    ]
    out = wrapper.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    for r in out:
        i = r["page_id"]
        assert r["text"] == f"Title {i}\nFirst & only {i} text of the day.\nMore about {i}"
        assert r["n_chars"] == len(r["text"])


def test_equal_pages_have_no_template(spark):
    rows = [(i, "http://one.example.com/", page("Same", ["Same text"], ["Home"])) for i in range(5)]
    out = wrapper.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in out} == {"Same\nSame text\nAll rights reserved by the editors"}


def test_wrapper_odd_rows(spark):
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    rows = [
        (1, "http://x.example.com", None), (2, None, "<article><p>a<p>b <b>c</article>"), (3, "", ""), (4, "http://x.example.com", deep),
        (5, "http://y.example.com", "plain & simple <!-- never closed"), (6, "http://y.example.com", "<script>var a = '</p>';</script><p>x &lt; y"),
        (7, "http://z.example.com", "<p>" + "word " * 50_000), (7, "http://z.example.com", "<p>" + "word " * 50_000),
    ]
    frame = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    found = {r["page_id"]: r["text"] for r in wrapper.extract_text(frame).collect()}
    assert found[1] == "" and found[2] == "a\nb c" and found[3] == "" and found[4] == "deep"
    assert found[5] == "plain & simple" and found[6] == "x < y" and found[7] == ("word " * 50_000).strip()
    assert wrapper.extract_text(frame.limit(0)).count() == 0


def test_articles_of_the_test_pages(spark, small):
    import html
    import re

    def article(page):
        inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        blocks = [
            re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " ")))).strip()
            for b in re.split(r"</?(?:p|h1)>", inner)
        ]
        return "\n".join(b for b in blocks if b)

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    for r in QUERIES["op7_wrapper"](spark, small).collect():
        assert r["text"] == article(pages[r["page_id"]])


def test_simple_tree_matching_counts_the_most_nodes():
    def tree(shape):
        label, *kids = shape
        return [label, 1, 0, 0, 0, 0, [tree(k) for k in kids]]

    a = tree(("r", ("x", ("y",), ("z",)), ("w",), ("x", ("z",))))
    b = tree(("r", ("w",), ("x", ("y",), ("z",)), ("v",)))
    assert wrapper.match_size(a, b, {}) == 4


def texts_of(spark, bodies, host="site"):
    rows = [(i, f"http://{host}.example.com/{i}", f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)]
    found = wrapper.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r["text"] for r in sorted(found, key=lambda r: r["page_id"])]


def test_what_stands_beside_the_largest_block_stays(spark):
    links = "<ul><li><a href=#>One</a><li><a href=#>Two</a></ul>"
    said = [[prose(100 * i + k, 12 * k) for k in range(1, 6)] for i in range(5)]
    for shape in (
        "<div id=main><h1>{0}</h1><p class=lead>{1}</p><div class=body><p>{2}<p>{3}</div></div>",
        "<div class=first><p>{0}<p>{3}</div><div class=second><p>{1}<p>{2}</div>",
        "<div><p>{0}</p><ul><li>{1}<li>{3}</ul><p>{2}</p></div>",
        "<div><p>{0}</p><pre>{3}</pre><blockquote>{1}</blockquote><table><tr><td>{2}</table></div>",
    ):
        found = texts_of(spark, [links + shape.format(*s) for s in said])
        for text, s in zip(found, said):
            assert sorted(text.split("\n")) == sorted(s[:4])


def test_pages_of_another_layout_are_whole(spark):
    said = [[prose(100 * i + k, 12 * k) for k in range(1, 4)] for i in range(6)]
    bodies = ["<div><a href=#>More</a></div><article><h1>{0}</h1><p>{1}<p>{2}</article>".format(*s) for s in said[:5]]
    bodies.append("<div><a href=#>More</a></div><article><p>{0}</article><div class=story><p>{1}<p>{2}</div>".format(*said[5]))
    assert texts_of(spark, bodies) == ["\n".join(s) for s in said]


def test_copies_count_once(spark):
    notice = "<div class=legal><p>{}</p></div>".format(prose(5, 9))
    other = [f"<h1>{prose(i, 4)}</h1><div><p>{prose(50 + i, 40)}</p></div>" for i in range(4)]
    kept = [prose(900 + i, 30) for i in range(5)]
    near = [
        "<h1>Same title</h1><h2>Same line</h2><div><p>{}<p>{}<ul><li>{}</ul><p>{}<p>{}</div>".format(*kept[:3], prose(i, 10), kept[4])
        for i in range(200, 209)
    ]
    for copies in (near, near[:1] * 9):
        found = texts_of(spark, [notice + b for b in other + copies])
        for text, body in zip(found, other + copies):
            assert text == "\n".join(t for t in re.split(r"\s*<[^>]*>\s*", body) if t)
    # Nothing but near copies: nothing is known to be template.
    assert all(kept[0] in t and "Same title" in t for t in texts_of(spark, near))


@pytest.mark.parametrize(
    "shape",
    [
        "<div style='overflow:hidden'><h1>{0}</h1><p>{1}<p>{2}</div>",
        "<div data-hidden class=x><h1>{0}</h1><p>{1}<p>{2}</div>",
        "<div class='content with-sidebar'><h1>{0}</h1><p>{1}<p>{2}</div><div class=sidebar>Other</div>",
        "<article class='post no-comments'><h1>{0}</h1><p>{1}<p>{2}</article>",
        "<div class=related-post><h1>{0}</h1><p>{1}<p>{2}</div>",
        "<div class='elementor-widget a'>{0}</div><div class='elementor-widget b'>{1}</div><div class='elementor-widget c'>{2}</div>",
        "<form><div class='no-comments'><nav><a href=#>Home</a></nav><h1>{0}</h1><p>{1}<p>{2}</div></form>",
        "<article><header><h1>{0}</h1></header><p>{1}<p>{2}</article>",
        "<nav><a href=#>Home</a><article><h1>{0}</h1><p>{1}<p>{2}</article>",
        "<div id=wrap><div class=ad>Buy<main><h1>{0}</h1><p>{1}<p>{2}</main></div><footer>Us</footer>",
        "<header>Site<article><h1>{0}</h1><p>{1}<p>{2}</article>",
        "<article><h1>{0}</h1><p>{1}<p>{2}</article><div class=related><article>Short teaser</article></div>",
        "<div><h1>{0}</h1><p>{1}<p>{2}</p></div><div class=comments><p>{3}</div>",
    ],
)
def test_names_do_not_drop_the_content(spark, shape):
    said = [[*(prose(100 * i + k, 12 * k) for k in range(1, 4)), prose(100 * i + 50, 100)] for i in range(4)]
    wanted = ["\n".join(s[:3]) for s in said]
    assert texts_of(spark, [shape.format(*s) for s in said]) == wanted
    assert texts_of(spark, [shape.format(*said[0])]) == wanted[:1]
    # The only page of its kind on its host.
    others = [f"<div class=text><h1>{prose(i, 5)}</h1><p>{prose(i, 300)}</div>" for i in range(70, 75)]
    assert texts_of(spark, [*others, shape.format(*said[0])])[-1] == wanted[0]
