"""Main text: wrappers of hosts with different layouts, odd markup, and the parts of the inference."""
import json
import random

import pytest

from opsloom.llm import wrappers

PAGES = "page_id long, url string, html string, host string, text string"
WORDS = "amber birch cobalt dune ember fjord grove harbor inlet juniper kelp lagoon meadow nectar orchid pebble quartz raven spruce tundra".split()


def sentence(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n)).capitalize() + "."


def article(rnd):
    title = sentence(rnd, 5)
    return title, [sentence(rnd, rnd.randint(8, 40)) for _ in range(rnd.randint(2, 7))]


def semantic(rnd, title, paragraphs, i):
    comments = "".join(f"<div class='comment'><b>{rnd.choice(WORDS)}</b><p>{sentence(rnd, 12)}</p></div>" for _ in range(rnd.randint(0, 5)))
    return (f"<html><head><title>{title}</title></head><body class='has-sidebar post'><header><a href='/'>Site of things</a></header>"
            f"<nav><ul>{''.join(f'<li><a href=x>{w}</a>' for w in rnd.sample(WORDS, 4))}</ul></nav><div class='cookie-notice'>We use cookies. <button>OK</button></div>"
            f"<main><article><header><h1>{title}</h1></header>{''.join(f'<p>{p}</p>' for p in paragraphs)}<ul class='share-buttons'><li>Share</li></ul></article>"
            f"<section id='comments'><h2>Comments</h2>{comments}</section></main><aside><p>{sentence(rnd, 9)}</p></aside>"
            f"<form><label>Mail</label><input><p>Join our list</p></form><footer>&copy; {2000 + i}</footer><script>var a='<p>no</p>'</script></body></html>")


def named(rnd, title, paragraphs, i):
    advert = f"<div class='ad-slot'>{sentence(rnd, 6)}</div>" if i % 2 else ""
    return (f"<body><div id=header><div class=logo>Daily</div></div><div class='top-menu'>{' '.join(f'<a href=#>{w}</a>' for w in rnd.sample(WORDS, 5))}</div>"
            f"<div id='wrap'><div class='content with-sidebar'><h1>{title}</h1>{advert}{''.join(f'<p>{p}' for p in paragraphs)}<div class='related-posts'><ul>"
            f"{''.join(f'<li><a href=x>{sentence(rnd, 4)}</a></li>' for _ in range(rnd.randint(1, 4)))}</ul></div></div>"
            f"<div id='sidebar'><p>{sentence(rnd, 20)}</p></div></div><div class='footer'>All rights reserved</div></body>")


def soup(rnd, title, paragraphs, i):
    menu = "".join(f"<td><a href=x>{w}</a></td>" for w in rnd.sample(WORDS, rnd.randint(3, 6)))
    return (f"<html><body><table><tr>{menu}</tr></table><div><div>Welcome to the plain site, read it every day</div><div><h1>{title}</h1><div>"
            f"{''.join(f'<p>{p}</p>' for p in paragraphs)}</div><div>Printed on recycled paper</div></div></div><div>Write to us at any hour</div></body></html>")


@pytest.mark.parametrize("layout", [semantic, named, soup])
def test_articles_of_a_host_come_out_whole(spark, layout):
    rnd = random.Random(layout.__name__)
    rows, want = [], {}
    for i in range(24):
        title, paragraphs = article(rnd)
        rows.append((i, f"https://one.example/{i}", layout(rnd, title, paragraphs, i), "x", "x"))
        want[i] = "\n\n".join([title, *paragraphs])
    got = {r.page_id: r.text for r in wrappers.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == want


def test_odd_pages(spark):
    long = "<article>" + "<p>a b</p>" * 50_000 + "</article>"
    deep = "<div>" * 3000 + "<p>low</p>"
    rows = [(1, None, None), (2, "http://h/a", ""), (3, "http://h/b", "plain &amp; text"), (4, "x", "<article><p>one<br>two &lt;b&gt;&nbsp; three<li>four<li>five</article>"), (4, "x", "<article><p>one<br>two &lt;b&gt;&nbsp; three<li>four<li>five</article>"),
            (5, "http://l/", long), (6, "http://d/", deep), (7, "http://e/", "<article><p>a < b and <!-- no > --> c <a href='x>y'>d</a><p hidden>no</p><p>Q<span class='ad'>buy</span>R"),
            (8, "http://f/", "<article><p>x <a title=\"open>y</p><p>z</p>"), (9, "http://g/", "<nav>only a menu</nav>")]
    got = {}
    for r in wrappers.main_text(spark.createDataFrame([(*r, "x", "x") for r in rows], PAGES).repartition(3)).collect():
        got.setdefault(r.page_id, []).append(r.text)
    assert got[1] == [""] and got[2] == [""] and got[3] == ["plain & text"] and got[9] == [""]
    assert got[4] == ["one two <b> three\n\nfour\n\nfive"] * 2
    assert got[5] == ["\n\n".join(["a b"] * 50_000)] and got[6] == ["low"]
    assert got[7] == ["a < b and c d\n\nQR"] and got[8][0].startswith("x")
    assert wrappers.main_text(spark.createDataFrame([], PAGES)).count() == 0


def shape(page):
    return wrappers.folded(wrappers.parse(page)[0])


def tags(node):
    mark = "*" if node.many and node.optional else "+" if node.many else "?" if node.optional else ""
    return ("#" if node.tag == "#" else node.tag + "(" + " ".join(tags(k) for k in node.kids) + ")") + mark


def test_repetitions_and_options():
    assert tags(shape("<ul><li>a<li>b<li>c</ul>")) == "(ul(li(#)+))"
    assert tags(shape("<dl><dt>a<dd>b<dt>c<dd>d<dt>e<dd>f</dl>")) == "(dl(()(dt(#) dd(#))+))"
    a, b = shape("<div><h1>t</h1><p>x</p></div>"), shape("<div><h1>t</h1><blockquote>q</blockquote><p>x</p><p>y</p></div>")
    both = wrappers.generalised(a, b, lambda x, y: x)
    assert tags(both) == "(div(h1(#) blockquote(#)? p(#)+))"
    assert tags(wrappers.Node.of(json.loads(json.dumps(both.plain())))) == tags(both)


def test_many_shapes_of_one_host_are_aligned_in_rounds(spark):
    rnd = random.Random(9)
    # 300 shapes of one host: every page has its own mixture of parts.
    rows, want = [], {}
    for i in range(300):
        parts = [(rnd.choice(["p", "h2", "blockquote", "pre", "h3"]), sentence(rnd, 9)) for _ in range(8)]
        rows.append((i, "http://many.example/", f"<body><div class=menu>{sentence(rnd, 3)}</div><article>" + "".join(f"<{t}>{s}</{t}>" for t, s in parts) + "</article></body>", None, None))
        want[i] = "\n\n".join(s for _, s in parts)
    pages = spark.createDataFrame(rows, PAGES)
    assert {r.page_id: r.text for r in wrappers.main_text(pages).collect()} == want


def by_table(a, b):
    """The alignment of most likeness by the whole table."""
    like = lambda x, y: wrappers.likeness(x.tag, x.words, y.tag, y.words)
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + like(a[i], b[j]))
    i = j = 0
    while i < len(a) and j < len(b):
        if like(a[i], b[j]) and best[i][j] == best[i + 1][j + 1] + like(a[i], b[j]):
            yield a[i], b[j]
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            yield a[i], None
            i += 1
        else:
            yield None, b[j]
            j += 1
    yield from [(x, None) for x in a[i:]] + [(None, y) for y in b[j:]]


def test_alignments_of_any_length_are_those_of_the_whole_table():
    rnd = random.Random(4)
    for n, m, times in ((6, 7, 400), (150, 140, 4), (1200, 1100, 1)):
        for _ in range(times):
            kinds = [(rnd.choice(["p", "h2", "pre"]), frozenset(rnd.sample("abcdef", rnd.randint(0, 3)))) for _ in range(rnd.randint(1, 12) if times > 1 else 9)]
            a, b = ([wrappers.Node(*rnd.choice(kinds)) for _ in range(size)] for size in (n, m))
            # Ends that are unlike leave the rest to the table.
            a, b = [wrappers.Node("dl"), *a, wrappers.Node("dl")], [wrappers.Node("ol"), *b, wrappers.Node("ol")]
            assert [tuple(map(id, pair)) for pair in wrappers.aligned(a, b)] == [tuple(map(id, pair)) for pair in by_table(a, b)]


def test_pages_of_many_mixed_parts_keep_all_of_them(spark):
    rnd = random.Random(11)
    rows, want = [], {}
    for i in range(4):
        used = []
        # No run of up to four elements comes twice in a row, so nothing is folded.
        while len(used) < 1300:
            used.append(rnd.choice(["p", "h2", "blockquote", "pre", "h3"]))
            if any(used[-w:] == used[-2 * w:-w] for w in (1, 2, 3, 4)):
                used.pop()
        parts = [(t, sentence(rnd, 4)) for t in used]
        rows.append((i, "http://long.example/", "<body><article>" + "".join(f"<{t}>{s}</{t}>" for t, s in parts) + "</article></body>", None, None))
        want[i] = "\n\n".join(s for _, s in parts)
    got = {r.page_id: r.text for r in wrappers.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert {i: len(t) for i, t in got.items()} == {i: len(t) for i, t in want.items()} and got == want
