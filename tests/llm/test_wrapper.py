import random
import re
from collections import defaultdict
from functools import cache
from pathlib import Path
from urllib.parse import urlsplit

import pyarrow.parquet as pq
import pytest

from mosaicflow.llm import wrapper as wr
from mosaicflow.llm.queries import op7_wrapper_induction

PAGES = "page_id long, url string, html string, text string, host string"


def page(i, text):
    return f'<html><body><div id="top"><a href=/>Home</a><a>About us</a></div><div class="wrap"><div class="post"><h2>T{i}</h2><p>{text} one &amp; two</p><p>Please write to us</p><p>{text[::-1]} more<br>lines</p></div><div class="reader-comments"><p>nice</p></div></div><div class=foot>All rights</div></body></html>'


TEXTS = ["alpha beta gamma", "delta eps zeta", "eta theta iota", "kappa lam"]


def test_template_goes_and_content_stays():
    wrapper = wr.fit([page(i, t) for i, t in enumerate(TEXTS)])
    assert wr.main_text(page(9, "new words"), wrapper) == "T9\n\nnew words one & two\n\nsdrow wen more lines"
    again = wr.unpacked(wrapper.packed())
    assert again.packed() == wrapper.packed() and wr.main_text(page(9, "new words"), again) == wr.main_text(page(9, "new words"), wrapper)


def test_copies_of_one_article_keep_it():
    same = [page(1, "the one article") + f"<!-- {i} -->" for i in range(5)]
    assert "the one article one & two" in wr.main_text(same[0], wr.fit(same))


def test_the_content_slot_goes_before_tags():
    def teasers(i, t):
        return f'<body><main><div class="story"><p>{t} {i} {t[::-1]} and on</p><p>{t} at length, {i}</p></div><div class="more"><article><p>Top {i}</p></article><article><p>Also</p></article></div></main></body>'

    def plain(i, t):
        return f'<body><div class="head">Welcome</div><div class="x"><div class="y"><p>{t} {i}</p><p>{t[::-1]}</p></div></div><div class="foot"><p>Terms</p></div></body>'

    text = "new words of a story"
    wrapper = wr.fit([teasers(i, t) for i, t in enumerate(TEXTS)])
    assert wr.main_text(teasers(9, text), wrapper) == f"{text} 9 {text[::-1]} and on\n\n{text} at length, 9"
    assert wr.main_text("<div><main><p>other layout</p></main></div>", wrapper) == "other layout"
    assert wr.main_text(plain(9, text), wr.fit([plain(i, t) for i, t in enumerate(TEXTS)])) == f"{text} 9\n\n{text[::-1]}"


def test_template_goes_from_short_articles():
    def short(text):
        return f'<body><div class="a"><div class="b"><p>{text}</p><p>{"All of this stands on every page. " * 20}</p><div class="links"><p>One</p><p>Two</p></div></div></div></body>'

    assert wr.main_text(short("news"), wr.fit([short(f"{t} {t[::-1]} and some more words") for t in TEXTS])) == "news"
    same = [short(f"the one article of {i}") for i in range(5)]
    assert wr.main_text(same[0], wr.fit(same)).count("stands on every page") == 20


def test_every_page_and_layout_counts(frame):
    """Template of a layout that few sampled pages have, and of hosts of two and three pages."""
    words = lambda k: " ".join(f"w{k * 31 % 97}x{i * k}" for i in range(1, 12))

    def layout(k, name):
        return f'<body><div class="{name}-top"><p>Read {name} first</p></div><div class="{name}"><p>{words(k)}</p><p>Sent from {name}</p></div></body>'

    rows = [(k, "http://big.example/", layout(k, f"l{k % 12}")) for k in range(1, 121)]
    rows += [(200 + k, "http://two.example/", layout(k, "a")) for k in (1, 2)] + [(300 + k, f"http://three{h}.example/", layout(k * h, "a")) for h in range(1, 30) for k in (1, 2, 3)]
    got = wr.extract(frame([(i, u, h, "x", "y") for i, u, h in rows], PAGES)).collect()
    assert len(got) == len(rows)
    wanted = {h: h.split("<p>")[2].split("</p>")[0] for *_, h in rows}
    assert sorted(r.text for r in got) == sorted(wanted[h] for *_, h in rows)


def test_elements_that_are_never_content():
    html = """<head><title>t</title></head><nav>menu</nav><header>site</header><main><article><header><h1>Head</h1><p>by me</p></header><p>One  &lt;b&gt;
    two<b>!</b><p>Three<ul><li>x<li>y</ul><form>f</form><aside>a</aside><script>if (a<b) "</p>"</script><style>p{}</style><div class="cookie-notice">c</div>
    <div role="navigation">r</div><p hidden>h</p><p style="display: none">d</p><pre>c o
    d e</pre><section class="comments"><p>bad</p></section></article></main><footer>foot</footer><div class=ad>ad</div>"""
    assert wr.main_text(html).split("\n\n") == ["Head", "One <b> two!", "Three", "x", "y", "c o d e"]


def test_simple_tree_matching():
    def tree(html):
        return wr.runs_of(wr.parse(html))

    assert wr.match(tree("<div><p>a</p><ul></ul></div>"), tree("<div><p>b</p><p>c</p><ol></ol><ul></ul></div>"))[0] == 3
    assert wr.match(tree("<div></div><p></p>"), tree("<p></p><div></div>"))[0] == 1
    assert wr.match([], tree("<p></p>")) == (0, [])


def made_trees(seed):
    rng = random.Random(seed)

    def nodes(depth):
        return [wr.Slot(rng.choice("abc"), nodes(depth - 1) if depth else []) for _ in range(rng.randint(0, 4))]

    return nodes(2), nodes(2)


def largest(a, b):
    """Simple tree matching as it is defined, by trying every way."""

    @cache
    def best(i, j):
        if i == len(a) or j == len(b):
            return 0
        paired = 1 + largest(a[i].children, b[j].children) + best(i + 1, j + 1) if a[i].label == b[j].label else 0
        return max(best(i + 1, j), best(i, j + 1), paired)

    return best(0, 0)


@pytest.mark.parametrize("cells", [1 << 20, 4])
def test_matching_against_brute_force(monkeypatch, cells):
    monkeypatch.setattr(wr, "MOST_CELLS", cells)
    for seed in range(300):
        a, b = made_trees(seed)
        size, pairs = wr.match(a, b)
        assert size == len(pairs) == largest(a, b)
        assert all(x.label == y.label for x, y in pairs)
        order = lambda top: {id(x): i for i, x in enumerate(flat(top))}
        first, second = order(a), order(b)
        placed = sorted((first[id(x)], second[id(y)]) for x, y in pairs)
        assert [j for _, j in placed] == sorted(j for _, j in placed)


def flat(nodes):
    return [y for x in nodes for y in (x, *flat(x.children))]


def test_long_lists_keep_their_order():
    page = lambda k, n: "<body>" + "".join(f"<div><p>{k} {i} {'ab'[i % 2]} of many</p></div><h2>{k}{i}</h2>" for i in range(n)) + "<div><p>Bye</p><ul></ul></div></body>"
    wrapper = wr.fit([page(k, 700 + k) for k in range(4)])
    blocks = wr.main_text(page(9, 900), wrapper).split("\n\n")
    assert blocks == [x for i in range(900) for x in (f"9 {i} {'ab'[i % 2]} of many", f"9{i}")]


def bare(html):
    """A page without article, main, class, id and role."""
    return re.sub(r"<(/?)(?:article|main)\b", r"<\1div", re.sub(r"\s(?:class|id|role)=(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "", html))


def test_wrappers_alone_find_the_article():
    """Pages whose marks are taken away: the host's wrapper finds what the marks say."""
    path = Path("/root/testdata/sf0.01/pages.parquet")
    if not path.exists():
        pytest.skip("no test data")
    hosts = defaultdict(list)
    for r in pq.read_table(path).to_pylist():
        hosts[urlsplit(r["url"]).netloc].append(r["html"])
    n = right = 0
    for pages in hosts.values():
        if len(different := list(dict.fromkeys(map(bare, pages)))) > 1:
            wrapper = wr.fit(different)
            got = [wr.read(bare(p), wrapper) for p in pages]
            right += sum(g == (wr.main_text(p), "wrapper") for g, p in zip(got, pages, strict=True))
            n += len(pages)
    assert n > 200 and right >= 0.95 * n


def test_classes_are_a_prior_alone():
    story = lambda t: f"<p>{t} and {t[::-1]} at length</p><p>Again {t}, {t}</p>"

    def odd(t):  # the article is where a class says that adverts are
        return f'<body><div class="head">Welcome</div><div class="widget">{story(t)}</div><div class="foot">Terms</div></body>'

    assert wr.main_text(odd("new words"), wr.fit([odd(t) for t in TEXTS])) == "new words and sdrow wen at length\n\nAgain new words, new words"
    for name, kept in (("share-price", True), ("widget-review", True), ("reader-comments", False), ("ad-slot", False), ("shareButtons", False), ("no-sidebar", True), ("post-ads", False), ("adventure", True), ("cookie-banner-v2", False), ("nav-primary", False), ("google-ad-300x250", False), ("comment-list-item", False), ("menu-of-the-day", True)):
        assert (wr.main_text(f'<article><p>a</p><div class="{name}">b</div></article>') == "a\n\nb") == kept, name
    assert wr.main_text("<article>Let <math><mi>x</mi></math> be a <object>number</object>.<xmp>a &amp; <b></xmp></article>") == "Let x be a number.\n\na &amp; <b>"


def test_numbered_names_are_one_label():
    page = lambda k: f'<body><div id="post-{k}"><p>{TEXTS[k]} {k}</p><p>{TEXTS[k][::-1]}</p></div><div><p>Read also {k}</p></div></body>'
    assert wr.main_text(page(3), wr.fit([page(k) for k in range(3)])) == f"{TEXTS[3]} 3\n\n{TEXTS[3][::-1]}"


def test_broken_pages():
    for html in ("<", "<p", "a < b > c", "<p>x</b></i>", "<!-- open", "<script>open", "<a href='x>y</a><p>z", "</p></div>", "<div>" * 3000 + "deep", "<" * 5000, '<a "' * 2000, "&#xfffffff; &amp &nope; &#0;", "<table><tr><td>1<td>2<tr><td>3</table>"):
        assert isinstance(wr.main_text(html), str)
    assert wr.main_text("<div>" * 3000 + "deep") == "deep"
    assert wr.main_text("<table><tr><td>1<td>2<tr><td>3</table>") == "1\n\n2\n\n3"


def test_rows(frame):
    rows = [(i, "http://H.example/x", page(i, t)) for i, t in enumerate(TEXTS)] + [(7, None, "<p>alone</p>"), (8, "no url", "<p>b</p>"), (9, "http://h.example/", None), (10, "http://one.example", ""), (None, "http://h.example/y", page(0, TEXTS[0])), (11, "http://long.example", "<p>" + "word " * 50_000)]
    table = frame([(i, u, h, "x", "y") for i, u, h in rows], PAGES)
    got = {r.page_id: r for r in wr.extract(table).collect()}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got.values())
    assert got[2].text == "T2\n\neta theta iota one & two\n\natoi ateht ate more lines" and got[None].text == got[0].text
    assert got[7].text == "alone" and got[8].text == "b" and got[9].text == got[10].text == "" and got[11].n_chars == 249_999
    assert wr.extract(table.limit(0)).count() == 0


def test_hosts_go_to_the_shard_that_spark_gives(spark):
    from pyspark.sql import functions as F

    hosts = ["a.example", "b.example", "é.example", "x"]
    rows = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", F.pmod(F.xxhash64("h"), F.lit(7)).alias("s")).collect()
    assert all(wr._shard(wr._hash(r.h), 7) == r.s for r in rows)


def test_made_articles_come_back(spark, sf_dir):
    """Pages of the test data: everything in the article element, nothing else."""
    import html
    import re

    rows = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in op7_wrapper_induction(spark, sf_dir).collect():
        inner = re.search(r"<article>(.*?)(?:</article>|<footer|\Z)", rows[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(b for b in blocks if b), r.page_id


def sections(k, extra=""):
    """An article with headings that all pages of its host have, and a line that all have between its own."""
    t = TEXTS[k]
    return (
        f'<body><div class="top"><h3>Our paper</h3><p>Read daily</p></div><article><h1>{t} {k}</h1><h2>Summary</h2><p>{t} in short</p><p>As told by our own correspondent.</p><p>{t[::-1]} at length</p>{extra}'
        f"<h2>References</h2><ul><li>{t} one</li><li>{t} two</li></ul><h2>Stay in touch</h2><p>Write to us today.</p></article><div><h3>Imprint</h3><p>All rights are ours</p></div></body>"
    )


def test_headings_that_all_articles_have():
    """They stay where they head what varies; other lines that all have go, with headings of nothing else."""
    wrapper = wr.fit([sections(k) for k in range(4)])
    for k in range(4):
        t = TEXTS[k]
        own = [f"{t} {k}", "Summary", f"{t} in short", f"{t[::-1]} at length", "References", f"{t} one", f"{t} two"]
        assert wr.read(sections(k), wrapper) == ("\n\n".join(own), "wrapper")


def test_a_whole_slot_that_is_the_same_goes():
    box = '<div class="offer"><p>Buy one, get one</p></div>'
    wrapper = wr.fit([sections(k, box) for k in range(4)])
    assert "Buy one" not in wr.main_text(sections(0, box), wrapper) and "References" in wr.main_text(sections(0, box), wrapper)


def test_text_that_varies_beats_a_name_of_what_is_the_same_everywhere():
    """Not a name of what differs from page to page without being content, as comments do."""
    for name, kept in (("social", True), ("notice-box", True), ("reader-comments", False), ("related", False), ("ad-slot", False)):
        pages = [sections(k, f'<div class="{name}"><p>{TEXTS[k]} was told to us by {TEXTS[-k]}</p></div>') for k in range(4)]
        assert all((f"{TEXTS[k]} was told to us" in wr.main_text(p, wr.fit(pages))) == kept for k, p in enumerate(pages)), name
    same = [sections(k, '<div class="social"><p>Share this with your friends</p></div>') for k in range(4)]
    assert "Share this" not in wr.main_text(same[0], wr.fit(same))


def test_own_blocks():
    b = lambda text, heading=False, template=False: wr._Block(text, heading, template)
    h = lambda text: b(text, True, True)
    assert wr._own([b("edge", template=True), h("H1"), b("x"), b("mid", template=True), h("H2"), b("late", template=True), h("H3"), b("y"), h("H4"), b("end", template=True), b("H5", True)]) == ["H1", "x", "H3", "y", "H5"]
    assert wr._own([h("only"), b("t", template=True)]) == [] and wr._own([]) == []


def test_files_are_sized_by_bytes(frame, monkeypatch):
    """Many large pages of many hosts: more files, the same texts."""
    rows = [(10 * i + k, f"http://h{i}.example/{k}", sections(k).replace("at length", f"at length {i} " + "word " * 400)) for i in range(30) for k in range(4)]
    table = frame([(*r, "x", "y") for r in rows], PAGES, 3)
    texts = lambda: {r.page_id: (r.text, r.decided_by) for r in wr.extract(table).collect()}
    before, sizes = texts(), []
    monkeypatch.setattr(wr, "BYTES_PER_SHARD", 20_000)
    monkeypatch.setattr(wr, "SLOTS_PER_SHARD", 100)
    count = wr.shard_count
    monkeypatch.setattr(wr, "shard_count", lambda total, each: sizes.append(count(total, each)) or sizes[-1])
    assert texts() == before and max(sizes) > 5 and all(by == "wrapper" for _, by in before.values())
