"""Cases of earlier findings: texts that were lost, and inputs that took quadratic time."""

import time

import numpy as np
import pytest

from lodestar.llm import decontaminate, html_extract, langid, media, simhash

RUNNING = "".join(f"<p>Paragraph {i} of running text that goes on for some while, with words.</p>" for i in range(8))
KEPT = {
    "a short section beside a long one": (f"<body><div><section>{RUNNING * 2}</section><section><h2>Conclusion</h2><p>The end of it all is here now.</p></section></div>", "Conclusion\nThe end of it all is here now."),
    "a section on menus": (f"<body><article>{RUNNING}<section id='menu'><h2>The menu</h2><p>We had soup, bread and a very long list of other dishes to choose from.</p></section></article>", "The menu\nWe had soup"),
    "a paragraph on shares": (f"<body><article>{RUNNING}<div class='share'><p>The share price fell by a tenth on Monday, the steepest decline since the year 2009.</p></div></article>", "share price fell"),
    "a list on promotions": (f"<body><article>{RUNNING}<ul class='promotion'><li><p>The sergeant was promoted to lieutenant after the long and difficult winter campaign.</p></li></ul></article>", "sergeant"),
    "a word in a button": (f"<body><article><p>Press <button>OK</button> to go on.</p>{RUNNING}</article>", "Press OK to go on."),
    "a standfirst": (f"<body><article><header><h1>Title</h1><p>A standfirst that says in one sentence what the whole article is about.</p><p>By A. B.</p></header>{RUNNING}</article>", "A standfirst that"),
}
LOST = {
    "comments": f"<body><article>{RUNNING}<div class='comments'><p>UNWANTED: what a great article, I liked reading it from its start to the end!</p></div></article>",
    "links to share by": f"<body><article>{RUNNING}<div class='share'><p><a href=x>UNWANTED: share on this network of people</a> <a href=y>or share it on that other network</a></p></div></article>",
    "a byline": f"<body><article><header><h1>Title</h1><p>UNWANTED by A. B.</p></header>{RUNNING}</article>",
    "a button of its own": f"<body><article>{RUNNING}<button>UNWANTED</button></article>",
}


@pytest.mark.parametrize("case", KEPT)
def test_article_text_stays(case):
    html, text = KEPT[case]
    assert text in html_extract.main_text(html, None)


@pytest.mark.parametrize("case", LOST)
def test_what_is_beside_the_article_goes(case):
    found = html_extract.main_text(LOST[case], None)
    assert "UNWANTED" not in found and "Paragraph 7" in found


TOWERS = {
    "b over div": lambda n: "<b>" * n + "<div>" * n + "</b>" * n, "i over hr": lambda n: "<i>" * n + "<hr>" * n, "nested text": lambda n: "<div>text " * n, "links": lambda n: "<a>" * n + "<div>x" * n + "</a>" * n,
    "lists": lambda n: "<ul><li><a>x</a>y" * n, "sections": lambda n: "<div>" + "<section><p>text text <a>text</a></p></section>" * n, "tables": lambda n: "<table><tr><td>x" * n, "headings": lambda n: "<h1><span>" * n,
}


def grows(f, small, large, spare=0.6):
    def seconds(n):
        began = time.process_time()
        f(n)
        return time.process_time() - began

    seconds(small // 10)
    return seconds(large) < spare + 2.5 * (large / small) * min(seconds(small), seconds(small))


@pytest.mark.parametrize("tower", TOWERS)
def test_towers_of_tags_take_time_in_proportion(tower):
    both = lambda n: (html_extract.votes(TOWERS[tower](n)), html_extract.main_text(TOWERS[tower](n), None))
    assert grows(both, 2_000, 16_000)


@pytest.mark.parametrize("piece", [b"GIF89aaaaaaaa!a", b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + b"\0" * 17, b"\xff\xd8\xff\xe0\0\x04ab", b"BM" + b"\0" * 30, b"%PDF-startxref", b"RIFF\xff\0\0\0WAVE"])
def test_signatures_take_time_in_proportion(piece):
    finder = media.automaton()
    assert grows(lambda n: media.sniffed(piece * n, finder), 2_000, 16_000)


def test_chains_are_followed_as_before():
    gif = b"GIF89a\1\0\1\0\0\0\0!\xfe\3abc\0,\0\0\0\0\1\0\1\0\0\2\2\x44\1\0;"
    finder = media.automaton()
    assert media.sniffed(gif + b"junk" + gif, finder) == [("image/gif", 0, len(gif)), ("image/gif", len(gif) + 4, len(gif))]
    assert media.sniffed(gif[:-1] + b"x" * 9, finder) == [] and media.sniffed(b"GIF89a\1\0\1\0\0\0\0;", finder) == []


def test_equal_windows_are_kept_once():
    shared = " ".join(f"w{i}" for i in range(40))
    items = [(f"i{i}", f"{shared} q{i} x{i} z{i}".encode()) for i in range(300)] + [("short", b"w1 w2 w3"), ("same", b"w1 w2 w3"), ("none", b"...")]
    block = decontaminate.Block(items, 13, 5)
    assert len(block.starts) == 28 + 3 * 300 + 1 and len(block.owners) == 31 * 300 + 2
    words = (f"{shared} " * 50).encode().split()
    counts: dict[int, int] = {}
    block.count(words, counts)
    keys = np.array(sorted(counts), np.uint64)
    block.order(keys, np.array([counts[int(k)] for k in keys]))
    assert block.hits(words) == ([0, 2000], sorted([f"i{i}" for i in range(300)] + ["same", "short"]))
    assert block.hits(b"w1 w2 w3 q7".split()) == ([0, 3], ["same", "short"])
    assert block.hits(b"w9 w8".split()) == ([], [])


def test_columns_may_have_dots_and_quotes(spark):
    df = spark.createDataFrame([(1, "one two three four", "en", 5, 6), (2, "one two three four", "en", 7, 8), (3, None, None, 1, 2)], "doc_id long, text string, lang string, `a.b` int, `c``d` int")
    kept = simhash.keep_one_of_each(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
    benchmark = spark.createDataFrame([("x", "nothing of this")], "item_id string, text string")
    assert decontaminate.drop_contaminated(df, benchmark).columns == df.columns
    assert langid.keep_identified(df).columns == df.columns
