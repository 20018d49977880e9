"""Golden rows of the URL, host, text and HTML functions."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.config import EngineConfig, Policy
from millrace.functions import html, text, urls

P = Policy()


def column(spark, values, expression):
    rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
    names = ["i", "a", "b"][: len(rows[0])]
    kinds = ", ".join(f"{n} string" for n in names[1:])
    frame = spark.createDataFrame(rows, f"i long, {kinds}")
    return [r[0] for r in frame.orderBy("i").select(expression).collect()]


def test_domain(spark):
    cases = {
        "https://WWW.A-b.com:8080/x?y#z": "a-b.com", "http://user:pw@h.com/": "user", "//h.com/x": "h.com", "h.com/x": "",
        "https://a_b.com/x": "a_b.com", "https://www.www.x.com/": "www.x.com", "": "", "http://[::1]/": "[",
    }
    assert column(spark, list(cases), urls.domain(F.col("a"))) == list(cases.values())


HOSTS = {
    "x.com": (True, False), "zootax.com.cn": (False, False), "nhmshop.co.uk": (True, False), "shop.elsevier.com": (True, False),
    "bishopmuseum.org": (False, False), "fr.copernicus.org": (False, False), "wordpress.com": (True, False),
    "svpow.wordpress.com": (False, False), "blog.tumblr.com": (True, False), "m.example.org": (True, False),
    "en.wikipedia.org": (False, False), "es.wikipedia.org": (False, True), "commons.wikimedia.org": (False, True),
    "notwikipedia.org": (False, True), "fi.edu": (False, True), "geohack.toolforge.org": (True, False), "axbcom": (False, False),
}


def test_hosts(spark):
    assert column(spark, list(HOSTS), urls.is_vetoed(F.col("a"), P)) == [v for v, _ in HOSTS.values()]
    assert column(spark, list(HOSTS), urls.is_other_language(F.col("a"), P)) == [v for _, v in HOSTS.values()]


def test_promising(spark):
    cases = [
        ("https://chambers.com/", None, False), ("https://gazetawroclawska.pl/", None, False),
        ("https://parisrevolutionnaire.org/", None, False), ("https://example.org/dinosaurio", None, False),
        ("https://example.org/wiki/Dinosaur_Park", None, True), ("https://example.org/x", "Amber finds", True),
    ]
    assert column(spark, [c[:2] for c in cases], urls.is_promising(F.col("a"), F.col("b"), P)) == [c[2] for c in cases]
    assert column(spark, ["https://example.org/x"], urls.is_promising(F.col("a"), None, P)) == [False]


def test_traps(spark):
    yes = [
        "https://a.org/search", "https://shop.a.org/", "https://a.org/2024/05/06/x", "https://a.org/?utm_source=f", "https://a.org/fr/x",
        "https://a.org/wiki/Special:Random", "https://a.org/feed/", "https://a.org/commentary",
    ]
    no = ["https://a.org/research", "https://a.org/wiki/Category:Fossils", "https://a.org/feed/x", "https://a.org/2024/5/6"]
    assert column(spark, yes + no, urls.is_trap(F.col("a"), P)) == [True] * len(yes) + [False] * len(no)


def test_links_and_canonical_urls(spark):
    base = "https://h.org/a/b?x=1#f"
    cases = {
        "http://o.org/": "http://o.org/", "//c.org/p": "https://c.org/p", "/r": "https://h.org/r", "?q": "https://h.org/a/b?q",
        "n": "https://h.org/a/n", "#z": "https://h.org/a/b?x=1#z", "": "https://h.org/a/b?x=1",
    }
    assert column(spark, [(base, h) for h in cases], urls.resolve(F.col("a"), F.col("b"))) == list(cases.values())
    assert column(spark, [(base, "../c"), (base, "http://[")], urls.resolve_exact(F.col("a"), F.col("b"))) == ["https://h.org/c", None]
    given = {"http://h.org": "http://h.org/", "http://h.org/x?b=2&a=1#t": "http://h.org/x?a=1&b=2", "http://h.org/x?": "http://h.org/x"}
    assert column(spark, list(given), urls.canonical(F.col("a"))) == list(given.values())
    assert column(spark, ["http://h.org/a.PDF?x", "http://h.org/pdf"], urls.is_denied_extension(F.col("a"), P)) == [True, False]


def test_topic(spark):
    cases = ["", "Dinosaur bones and a fossil", "fossil-bearing rock", None]
    tokens = text.topic_tokens(F.col("a"))
    assert column(spark, cases, text.topic_score(tokens, P)) == [0, 5, 0, 0]
    assert column(spark, cases, text.topic_density(tokens, P)) == [0.0, 600.0, 0.0, 0.0]


def test_language(spark):
    words = lambda n, m: " ".join(["the"] * n + ["zebra"] * (m - n))
    cases = [
        ("en-US", ""), ("EN_us", ""), ("  ", ""), (None, words(30, 39)), (None, words(18, 100)), (None, words(19, 100)), ("", words(20, 100)),
        (None, words(0, 400) + " the" * 400),
    ]
    got = column(spark, cases, text.language(F.col("a"), text.topic_tokens(F.col("b")), EngineConfig()))
    assert got == ["en", "en", "", "xx", "xx", "en", "en", "xx"]


def model_clean(value):
    import re

    lines = [re.sub(r"[ \t\r\f\v]+", " ", x).strip() for x in value.splitlines()]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


@pytest.mark.parametrize("seed", range(3))
def test_clean_and_count_words_as_a_plain_model(spark, seed):
    random.seed(seed)
    pool = ["a", "bc", " ", "  ", "\t", "\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", " ", "　", "é"]
    cases = ["".join(random.choices(pool, k=random.randint(0, 30))) for _ in range(300)]
    assert column(spark, cases, text.clean(F.col("a"))) == [model_clean(c) for c in cases]
    assert column(spark, cases, text.word_count(F.col("a"))) == [len(c.split()) for c in cases]


def test_small_text_functions(spark):
    assert column(spark, ["Año-nuevo's día 3", None], text.stats_tokens(F.col("a"))) == [["año-nuevo's", "día"], []]
    assert column(spark, ["Text/HTML; charset=x", ""], text.content_type(F.col("a"))) == ["text/html", ""]
    assert column(spark, [("", "b"), (None, None), ("a", "b")], text.first_given(F.col("a"), F.col("b"))) == ["b", "", "a"]
    sizes = spark.createDataFrame([(0,), (1,), (4096,), (4097,)], "n long")
    assert [r[0] for r in sizes.select(text.disk_bytes(F.col("n"))).collect()] == [4096, 4096, 4096, 8192]
    assert column(spark, [("h.org", "abcd")], text.storage_path(F.col("a"), F.col("b"))) == ["h.org/ab/abcd.txt"]
    assert column(spark, ["x"], text.event_line("VISITA", F.col("a"))) == ["VISITA    x"]


PAGE = """<html lang="en-GB"><head><title> A &amp; B </title><style>p{}</style></head><body><nav><a href="/n">nav</a></nav>
<!-- hidden --><article><p>First <b>bold</p><p>Second &lt;x&gt;</p></article><script>var t="</p>";</script><footer>end</footer></body></html>"""


def test_html(spark):
    a = F.col("a")
    assert column(spark, [PAGE], html.title(a)) == ["A & B"]
    assert column(spark, [PAGE, "<html>"], html.declared_language(a)) == ["en-GB", None]
    got = column(spark, [PAGE, None], html.main_text(a, P))
    assert got[1] == "" and "First" in got[0] and "Second <x>" in got[0]
    assert not any(x in got[0] for x in ("nav", "hidden", "end", "var"))
    assert [(x["href"], x["anchor"]) for x in column(spark, [PAGE], html.links(a))[0]] == [("/n", "nav")]
    assert column(spark, ["fossil " * 8, "fossil " * 7, None], html.is_rich(a, P, 8)) == [True, False, False]
    nested = "<div>a<nav>x<nav>y</nav>z</nav>b</div>"
    assert "".join(column(spark, [nested], html.tree_text(a))[0].split()) == "ab"


def test_texts_of_a_million_characters(spark):
    n = 1_000_000
    cases = ["ab-" * (n // 3) + "c", "\u00a0" * n, "x" + "\u00a0" * n + "y", " \u3000\n" * (n // 3) + "z", "\n" * n, "a" * n, "a'" * (n // 2)]
    assert column(spark, cases, F.length(text.clean(F.col("a")))) == [n, 0, n + 2, 1, 0, n, n]
    assert column(spark, cases, F.size(text.stats_tokens(F.col("a")))) == [1, 0, 2, 1, 0, 1, 1]
    assert column(spark, cases, text.word_count(F.col("a"))) == [1, 0, 2, 1, 0, 1, 1]
    page = "<p>x</p>" * (n // 8) + "<script>" + "y" * n + "</script><!--" + "z" * n + "-->"
    assert column(spark, [page], F.length(html.main_text(F.col("a"), P)))[0] < n and column(spark, [page], F.size(html.links(F.col("a")))) == [0]


def test_the_outer_of_nested_dropped_tags_goes_first(spark):
    page = "a<style>b<script>c</style>d<nav>e<form>f</form>g</nav>h"
    assert "".join(column(spark, [page], html.main_text(F.col("a"), P))[0].split()) == "adh"
