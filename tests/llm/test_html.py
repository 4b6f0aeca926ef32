import random
import re
from collections import Counter
from html import escape, unescape
from html.parser import HTMLParser

from granary.llm import html

ARTICLE = "The first of the paragraphs is long enough to count as text, and it has many of the common words that are in any text of this kind."
LONG = "Qwrt plkj zxcv mnbv hgfd asdf poiu ytre wqlk jhgf dsam nbvc xzlk jhgf dsap oiuy trew qlkj"


class Reader(HTMLParser):
    """Blocks of well-formed pages once more, by the parser of the standard library: (text, characters in links, within the article,
    boilerplate by markup, within a heading)."""

    AWAY = {"nav", "footer", "aside", "form", "header"}

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.open, self.rows, self.text, self.links = [], [], [], 0
        self.feed(page)
        self.close()
        self.flush()

    def flush(self):
        names = [n for n, _ in self.open]
        away = any(n in self.AWAY or c in ("ad", "comments") for n, c in self.open)
        if (text := " ".join("".join(self.text).split())) and not {"script", "style"} & set(names):
            self.rows.append((text, self.links, "article" in names, away, bool({"h1", "h2"} & set(names))))
        self.text, self.links = [], 0

    def handle_starttag(self, tag, attrs):
        if tag not in ("a", "b"):
            self.flush()
        self.open.append((tag, dict(attrs).get("class")))

    def handle_endtag(self, tag):
        if tag not in ("a", "b"):
            self.flush()
        self.open.pop()

    def handle_data(self, data):
        if self.open and self.open[-1][0] in ("script", "style"):
            return
        self.text.append(data)
        if any(n == "a" for n, _ in self.open):
            self.links += len("".join(data.split()))


def brute(page):
    """The two passes, block by block, each looking at the whole list."""
    rows = Reader(page).rows
    marked = any(inside and not away for _, _, inside, away, _ in rows)
    rows = [r for r in rows if not r[3] and r[2] == marked]
    words = [re.findall(r"[^\W\d_]+", r[0].lower()) for r in rows]
    stop = [sum(w in html.STOP_WORDS for w in ws) / len(ws) if ws else 0 for ws in words]
    dense = [r[1] / max(1, len(r[0].replace(" ", ""))) > 0.5 for r in rows]
    label = {}
    for k, r in enumerate(rows):
        if dense[k]:
            if not marked or dense[k - 1 : k] == [True] or dense[k + 1 : k + 2] == [True]:
                label[k] = False
        elif len(r[0]) < 70:
            if r[1] and not marked:
                label[k] = False
        elif marked:
            if stop[k] >= 0.1:
                label[k] = True
        elif not any(stop) or stop[k] >= 0.3 or (stop[k] >= 0.15 and len(r[0]) > 200):
            label[k] = True
        elif stop[k] < 0.15:
            label[k] = False
    out = []
    for k, r in enumerate(rows):
        before = max((x for x in label if x < k), default=None)
        after = min((x for x in label if x > k), default=None)
        if k in label:
            good = label[k]
        elif marked:
            good = before is None or after is None or label[before] or label[after]
        elif not any(label.values()):
            good = True
        elif before is None or after is None:
            good = label[after if before is None else before]
        else:
            good = label[after] if r[4] or after - k < k - before else label[before]
        if good:
            out.append(r[0])
    return "\n".join(out)


def page_of(rnd, marked):
    def block():
        text = rnd.choice([ARTICLE, ARTICLE + " " + ARTICLE, LONG, "Short & plain", "Of the few", "123", LONG[:60]])
        text = " ".join(rnd.sample(text.split(), len(text.split())))
        inner = escape(text)
        if rnd.random() < 0.3:
            inner = f"<a href='x'>{inner}</a>" + ("" if rnd.random() < 0.7 else " " + rnd.choice([ARTICLE, "and more"]))
        return f"<{(t := rnd.choice(['p', 'p', 'p', 'h2', 'li', 'div']))}>{inner}</{t}>"

    blocks = lambda: "".join(block() for _ in range(rnd.randrange(9)))
    away = lambda: rnd.choice(
        [
            "",
            f"<nav>{blocks()}</nav>",
            f"<div class='ad'>{block()}</div>",
            f"<section class='comments'>{blocks()}</section>",
            "<script>if (a < b) x('<p>');</script>",
            f"<footer>{block()}</footer>",
        ]
    )
    main = blocks() + away() + blocks()
    return f"<html><body>{away()}{blocks() if marked else ''}{f'<article>{main}</article>' if marked else main}{away()}</body></html>"


def test_two_passes_equal_brute_force():
    rnd = random.Random(31)
    seen = Counter()
    for k in range(3000):
        page = page_of(rnd, k % 2)
        found = list(html.blocks(page))
        assert "\n".join(b.text for b in html.classify(found)) == brute(page), page
        seen.update((k % 2, b.kind) for b in found)
    # Both passes decide both ways, with an article and without.
    assert all(seen[marked, kind] > 50 for marked in (0, 1) for kind in ("good", "bad", "kept", "dropped")), seen


def test_pages_of_the_tables(spark):
    """The pages of the tables hold one article; a plain reading of it must be what comes out, by either pass."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    seen = Counter()
    for r in html.extracted(pages).collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>|<[^>]*\Z", "", inner.replace("<br>", " ")))
        want = "\n".join(x for x in (" ".join(unescape(b).split()) for b in blocks) if x)
        assert r.text == want, r.page_id
        found = list(html.blocks(r.html))
        html.classify(found)
        seen.update(b.kind for b in found)
    assert seen["good"] > 1000 and seen["kept"] > 500


def test_pages_without_article_tags(spark):
    """The same pages with nothing but their text to go by: most of what comes out is the article, and most of the article comes out."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    caught = whole = given = 0
    for r in pages:
        want = Counter(html.main_text(r.html).split("\n"))
        plain = re.sub(r"</?(?:article|nav|footer)>", "", r.html).replace('<div class="ad">', "<div>")
        got = Counter(html.main_text(plain).split("\n"))
        size = lambda c: sum(len(x) * n for x, n in c.items())
        caught, whole, given = caught + size(want & got), whole + size(want), given + size(got)
    assert caught >= 0.85 * whole and caught >= 0.9 * given, (caught / whole, caught / given)


def test_boilerplate_goes():
    page = f"""<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body class="has-sidebar">
      <header><a href="/">Site name</a> and a slogan of the site that is long enough to be taken for a text by its words</header>
      <nav><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></nav>
      <div id="cookie-notice">This site uses cookies and you are asked to agree to the use of all of them before you go on.</div>
      <noscript>Please switch scripts on to see all of the things that this site has for you and for all of your friends.</noscript>
      <div class="content"><h2>Short title</h2><p>{ARTICLE}</p><p>Short one.</p><script>if (a < b) document.write("<p>no</p>")</script>
      <p>{ARTICLE} &amp; more&nbsp;&#233;<br>after <i>the</i> break</p></div>
      <aside><p>{ARTICLE}</p></aside><form><p>{ARTICLE}</p></form><div class="ad-box">{ARTICLE}</div>
      <section class="comments"><article class="comment"><p>{ARTICLE}</p></article></section>
      <p><a href=1>{ARTICLE}</a></p><footer><p>{ARTICLE}</p></footer></body></html>"""
    assert html.main_text(page) == f"Short title\n{ARTICLE}\nShort one.\n{ARTICLE} & more é after the break"


def test_an_article_needs_no_stop_words():
    assert html.main_text(
        "<nav>menu</nav><article><header><h1>Xyz</h1><p>by someone</p></header><p>qwr plk</p><p>" + "xkcd " * 40 + "</p></article><p>" + ARTICLE
    ) == "Xyz\nqwr plk\n" + ("xkcd " * 40).strip()


def test_links_within_an_article():
    links = "<ul>" + "".join(f"<li><a href={k}>elsewhere {k}</a></li>" for k in range(4)) + "</ul>"
    lone = "<p><a href=1>the one source of it</a></p>"
    assert html.main_text(f"<article><p>{ARTICLE}</p>{lone}<p>{ARTICLE}</p>{links}<p>short</p></article>") == "\n".join(
        [ARTICLE, "the one source of it", ARTICLE, "short"]
    )


def test_alternatives_and_formulas_stay():
    assert html.main_text(
        "<article><p>a <math><mi>x</mi></math> b <noscript>c</noscript> <canvas>d</canvas><svg><text>no</text></svg></p></article>"
    ) == "a x b c d"


def test_a_named_container_counts_where_there_is_no_article():
    body = "<div class='pageHeader'>Site</div><p>Outside. " + ARTICLE + "</p><div id='postContent'><h1>Title</h1><p>a | b | c</p><div class='AD'>buy</div></div>"
    assert html.main_text(body) == "Title\na | b | c"
    assert html.main_text(f"<div class=content><p>{ARTICLE}</p><article><p>inner</p></article></div>") == "inner"


def test_second_pass_takes_the_nearest_label():
    bad = "<p><a href=1>links and more links and more of the links that go on</a></p>"
    short = "<p>undecided</p>"
    assert html.main_text(f"<body>{bad}{short}<p>{ARTICLE}</p>{short}{short}{short}{bad}") == "\n".join(  # the middle one is as near to either: what comes before counts
        [ARTICLE, "undecided", "undecided"]
    )


def test_odd_pages(spark):
    for page in (None, "", "   ", "<", "<p", "<p title='>'", "</", "<!--", "<script>x", "<!doctype html>", "&am"):
        html.main_text(page)
    assert html.main_text(None) == html.main_text("") == html.main_text("<p title='x") == ""
    assert html.main_text("plain &lt;text&gt; &am") == "plain <text> &am"
    assert html.main_text("<article><p>a<p>b</div><p>c &copy") == "a\nb\nc ©"
    assert len(html.main_text("<article>" + f"<p>{ARTICLE}</p>" * 20_000)) == 20_000 * (len(ARTICLE) + 1) - 1
    assert html.main_text("<div>" * 5000 + ARTICLE) == ARTICLE
    frame = spark.createDataFrame(
        [(1, "u", "<p>a", "clash", "mine"), (1, "u", "<p>a", "clash", "mine"), (2, None, None, None, None)],
        "page_id long, url string, html string, links string, text string",
    )
    rows = html.extracted(frame).orderBy("page_id").collect()
    assert [(r.text, r.text_before) for r in rows] == [("a", "mine"), ("a", "mine"), ("", None)]
    assert [r.html for r in html.extracted(frame, into="html").orderBy("page_id").collect()] == ["a", "a", ""]
    assert html.extracted(frame.limit(0)).count() == 0
