"""HTML extraction and WARC archives."""

from __future__ import annotations

import base64
import gzip
import hashlib
import os
import random

import pytest

from momentloom.llm import htmltext, warc

PAGES = "page_id long, url string, html string, shard string, sha string, text string"
PROSE = "This is a sentence, with commas; it ends here. Another one follows, and then more words come. "


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "s", "x", "t") for i, u, h in rows], PAGES)


FULL = f"""<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>var a="</p><p>no</p>";</script></head>
<body><header class="top"><h2>Site, of all sites.</h2></header><nav><ul><li><a href="/">Home</a></li><li>More</li></ul></nav>
<div class="cookie-notice"><p>{PROSE}</p></div><div class='ad'>{PROSE}</div>
<article><header><h1>The &amp; title</h1></header><p>First   {PROSE}
 &lt;b&gt; <b>bold</b><!-- {PROSE} --> end<br>second line<p>Unclosed &eacute;&#233;&#x41; {PROSE}
<ul><li>one<li>two</ul><aside>{PROSE}</aside><p>Short.</p><form>{PROSE}<input value="x"></form></article>
<div id="comments"><div class="comment"><p>{PROSE}</p></div></div><div class="sidebar">{PROSE}</div><footer>&copy; me. {PROSE}</footer></body></html>"""
WANT = ["The & title", "First " + PROSE.strip() + " <b> bold end", "second line", "Unclosed ééA " + PROSE.strip(), "one", "two", "Short."]


def test_article():
    assert htmltext.main_text(FULL).split("\n") == WANT


def test_page_without_article_elements():
    body = "".join(f"<div class='story'><p>{PROSE}{i}</p></div>" for i in range(6))
    menu = "".join(f"<div class='m'><a href='/{i}'>Link {i}</a></div>" for i in range(12))
    page = f"<body><div>{menu}</div><div><h2>Head</h2>{body}<p>Tiny.</p></div><div><span>Imprint</span></div></body>"
    assert htmltext.main_text(page).split("\n") == ["Head", *(f"{PROSE}{i}" for i in range(6)), "Tiny."]


def test_nothing_of_the_article_is_lost():
    body = "".join(f"<p>{PROSE}{i}</p>" for i in range(40))
    lines = [f"{PROSE}{i}" for i in range(40)]
    page = f"<body><article><h1>T</h1><div class='body'>{body}</div><p>The closing words, at last.</p></article></body>"
    assert htmltext.main_text(page).split("\n") == ["T", *lines, "The closing words, at last."]
    page = f"<body><main><h1>T</h1><article><section><h2>A</h2>{body}</section><section><h2>B</h2><p>{PROSE}</p></section></article></main></body>"
    assert htmltext.main_text(page).split("\n") == ["T", "A", *lines, "B", PROSE.strip()]
    page = f"<body><div><a href='/'>Home</a></div><div><h1>T</h1><div><div>{body}</div></div><div><p>{PROSE}</p></div></div></body>"
    assert htmltext.main_text(page).split("\n") == ["T", *lines, PROSE.strip()]


@pytest.mark.parametrize("cut", ["<article><p>Some text, here. <foo", "<article><p>Some text, here. </p", "<article><p>Some text, here. <!-- open",
                                 "<article><p>Some text, here. <", "<article><p>Some text, here. <script>x"])
def test_cut_off_pages(cut):
    assert htmltext.main_text(cut) == "Some text, here."


def test_table_of_pages(spark):
    rows = [(1, "u", FULL), (2, None, None), (3, "u", ""), (4, "u", "plain  text &amp; more"), (5, "u", "<p>" + PROSE * 3000), (None, "u", FULL), (1, "u", FULL)]
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in htmltext.extract(frame(spark, rows)).collect()), key=str)
    full = "\n".join(WANT)
    want = [(1, full), (2, ""), (3, ""), (4, "plain text & more"), (5, (PROSE * 3000).strip()), (None, full), (1, full)]
    assert got == sorted(((i, t, len(t)) for i, t in want), key=str)
    assert htmltext.extract(frame(spark, [])).count() == 0


def page_rows():
    rng = random.Random(9)
    rows = [(i * 7, f"http://h/{i}?q=\n é", "".join(rng.choice("abc\r\n é") for _ in range(rng.randrange(0, 3000)))) for i in range(120)]
    rows += [(2000, None, rows[5][2]), (2001, "u", rows[5][2]), (2002, "u", None), (2003, "u", ""), (2004, "u", "y" * 300_000)]
    return rows


def test_round_trip(spark, tmp_path):
    rows = page_rows()
    manifest = warc.write_archives(frame(spark, rows), str(tmp_path / "a"), shard_bytes=40_000, roll_bytes=8_000)
    listed = {r["file"]: r for r in manifest.collect()}
    assert len(listed) > 6 and sum(r["records"] for r in listed.values()) == len(rows)
    on_disk = {f for f in os.listdir(tmp_path / "a") if not f.startswith(".") and f != "manifest"}
    assert on_disk == set(listed)
    for name, r in listed.items():
        data = (tmp_path / "a" / name).read_bytes()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (r["bytes"], r["sha256"])
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: ")
    firsts = [listed[f]["first_page"] for f in sorted(listed)]
    assert firsts == sorted(firsts)
    holder: dict[str, int] = {}
    for i, _, h in rows:
        holder[h or ""] = max(i, holder.get(h or "", i))
    got = {r["page_id"]: r for r in warc.read_archives(spark, str(tmp_path / "a")).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        data, keep = (h or "").encode(), holder[h or ""]
        want = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if keep == i else "revisit", None if keep == i else keep)
        assert (got[i]["payload_bytes"], got[i]["payload_digest"], got[i]["record_type"], got[i]["refers_to"]) == want
        assert got[i]["html"] == ((h or "") if keep == i else None)
    again = warc.write_archives(frame(spark, rows[::-1]), str(tmp_path / "b"), shard_bytes=40_000, roll_bytes=8_000)
    assert {r["file"]: r["sha256"] for r in again.collect()} == {f: r["sha256"] for f, r in listed.items()}


def test_archive_edges(spark):
    rows = [(None, "u", "same"), (4, "u", "same"), (4, "u", "same"), (None, "u", "alone"), (-9, None, None)]
    got = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in warc.archive(frame(spark, rows)).collect())
    assert got == sorted([("None", "revisit", 4), ("4", "response", None), ("4", "response", None), ("None", "response", None), ("-9", "response", None)])
    assert warc.archive(frame(spark, [])).count() == 0


def test_damaged_archive_is_noticed(spark, tmp_path):
    warc.write_archives(frame(spark, page_rows()[:3]), str(tmp_path / "a"))
    name = next(f for f in os.listdir(tmp_path / "a") if f.endswith(".gz"))
    data = (tmp_path / "a" / name).read_bytes()
    (tmp_path / "a" / name).write_bytes(data[:-20])
    with pytest.raises(Exception, match="ends inside a record"):
        warc.read_archives(spark, str(tmp_path / "a")).collect()


BODY = "<h1>Title here</h1><p>One long sentence of the article, with words.</p><p>Another sentence follows it.</p>"
KEPT = "Title here\nOne long sentence of the article, with words.\nAnother sentence follows it."


@pytest.mark.parametrize("page", [
    f'<div class="site no-sidebar"><article>{BODY}</article><div class="sidebar">Links.</div></div>',
    f'<div class="page header-fixed"><article>{BODY}</article></div>',
    f'<div id="content" class="ad-free"><article>{BODY}</article></div>',
    f'<div class="sidebar"><main>{BODY}</main></div>',
    f'<form id="page"><article>{BODY}</article></form>',
    f'<article><div class="entry-header"><h1>Title here</h1></div>{BODY[19:]}</article>',
    f'<article><h1>Title here</h1><section id="social-policy">{BODY[19:]}</section></article>',
    BODY.replace("<p>", '<p title="a hidden gem">', 1).join(["<article>", "</article>"]),
    f'<article>{BODY}<p hidden>no</p><p class="ad-slot">Buy now.</p><section class="comments">{"A comment. " * 90}</section></article>',
    f'<div class="widget">{BODY}</div><div class="footer-links">Imprint</div>',
    f'<div class="content">{BODY}</div><div id="comments"><p>{"A long comment. " * 40}</p></div>',
], ids=str)
def test_wrappers_named_like_a_sidebar_keep_their_article(page):
    assert htmltext.main_text(page) == KEPT
