import html
import re

import pytest

from quarryline.llm.html_text import densities, extract_text, main_text, parse

WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore".split()
P = [" ".join(WORDS[k % 7 :] * (2 + k % 3)) + f" {k}." for k in range(12)]
MENU = "<ul>" + "".join(f"<li><a href='/{w}'>{w}</a>" for w in WORDS) + "</ul>"


def page(body, head="<title>T</title><style>p{}</style><script>var a='<p>x</p>'</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


def test_article_among_noise():
    body = f"<nav>{MENU}</nav><div class='ad'>Buy now</div><article><h1>Title &amp; more</h1><p>{P[0]}<p>{P[1]}<br>{P[2]}</p><aside>side</aside><form>f</form><section><h2>Next</h2><p>{P[3]}</p></section><div id='comments'><p>{P[4]}</p></div></article><footer>&copy; x</footer>"
    assert main_text(page(body)) == "\n".join(["Title & more", P[0], f"{P[1]} {P[2]}", "Next", P[3]])


@pytest.mark.parametrize("wrap", ["<div>{}</div>", "<div><div>{}</div></div>", "<main>{}</main>", "<div id='content'><section>{}</section></div>"])
def test_no_article(wrap):
    text = "".join(f"<p>{p}</p>" for p in P)
    for noise in (f"<div>{MENU}</div>", f"<div class='sidebar'><p>{P[0]}</p></div>", "<div><a href='x'>one</a> <a href='y'>two</a></div>"):
        assert main_text(page(noise + wrap.format("<h1>Head</h1>" + text) + "<div><a href=z>end</a></div>")) == "\n".join(["Head", *P])


def test_parts_of_a_page():
    assert main_text(page("<article><p>a&nbsp;b\n\t c&#233;&lt;</p><pre>x\n  y</pre><table><tr><td>1<td>2<tr><td>3</table><ul><li>i<li>j</ul></article>")) == "a b cé<\nx y\n1\n2\n3\ni\nj"
    assert main_text("<article><p><b>Bold.<br><p>Next</p></article><footer>f</footer>") == "Bold.\nNext"
    assert main_text(page("<header>site</header><article><header><h1>Own</h1></header><p>x y</p><p hidden>no</p><div style='display: none'>no</div></article>")) == "Own\nx y"
    assert main_text("plain words only") == "plain words only"
    assert [main_text(x) for x in (None, "", "<html></html>", "<script>x", "<!-- never closed")] == [""] * 5
    assert main_text("<p>a < b and c > d</p>") == "a < b and c > d"


def test_tree_is_sound():
    t = parse("<div><p>a<div>b</div></b></p>c</div><li>x<ul><li>y</ul><li>z")
    assert all(p < k for k, p in enumerate(t.parents))


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in extract_text(pages).collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(b for b in blocks if b)


def test_table(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "<div>" * 3000 + "deep"), (None, "<p>x</p>")], "page_id long, html string").selectExpr("*", "'clash' as text")
    assert sorted(r["text"] for r in extract_text(df).collect()) == ["", "", "", "deep", "x"]
    assert extract_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("wrap", ["{}", "<div>{}</div>", "<main>{}</main>"])
@pytest.mark.parametrize("sizes", [(3, 3), (5, 3, 4), (2, 6)])
def test_sibling_articles_stay(wrap, sizes):
    parts = [[f"Head {k}", *(f"{p} part {k}" for p in P[:n])] for k, n in enumerate(sizes)]
    articles = "".join(f"<article><h2>{x[0]}</h2>" + "".join(f"<p>{p}</p>" for p in x[1:]) + "</article>" for x in parts)
    teaser = f"<article>{MENU}</article>"
    for before, after in (("", ""), (f"<nav>{MENU}</nav>", f"<div>{MENU}</div>")):
        for extra in ("", teaser):
            assert main_text(page(before + wrap.format(articles + extra) + after)) == "\n".join(x for part in parts for x in part)


def test_long_pages_take_time_in_proportion():
    import time

    pages = ["<b>" * 340_000 + "text", "<p title='" + "<p " * 340_000, "<p title='" + "<p " * 340_000 + ">x", '<p "a>" ' * 130_000, "<div><span>" * 90_000 + "x" + "</b></i>" * 40_000, "<!-" * 300_000, "<" * 1_000_000, "<article>" + "<p>words and more words" * 45_000]
    for page in pages:
        began = time.process_time()
        main_text(page)
        assert time.process_time() - began < 20, page[:40]


def test_densities_are_those_of_brute_force():
    import math
    import random

    rng = random.Random(3)

    def node(depth):
        if depth == 0 or rng.random() < 0.3:
            return " ".join(rng.choice(("alpha", "b", "gamma & delta")) for _ in range(rng.randrange(0, 9)))
        tag = rng.choice(("div", "section", "span", "a", "b"))
        return f"<{tag}>" + "".join(node(depth - 1) for _ in range(rng.randrange(1, 5))) + f"</{tag}>"

    for _ in range(60):
        t = parse("<html><body>" + node(6) + "</body></html>")
        density, sums, _, body = densities(t)
        n = len(t.tags)
        inside = [[k == i or i in path for i in range(n)] for k in range(n) for path in [above(t, k)]]
        size = [sum(len(" ".join(s.split())) for k, s in t.flow if s and inside[k][i]) for i in range(n)]
        link = [sum(len(" ".join(s.split())) for k, s in t.flow if s and inside[k][i] and any(t.tags[j] == "a" for j in (k, *above(t, k)))) for i in range(n)]
        below = [[k for k in range(n) if k != i and inside[k][i]] for i in range(n)]
        want = []
        for i in range(n):
            c, lc, tags, lt = size[i], link[i], max(1, len(below[i])), max(1, sum(t.tags[k] == "a" for k in below[i]))
            if not c:
                want.append(0.0)
                continue
            base = math.log(c / max(1, c - lc) * lc + link[body] / size[body] * c + math.e)
            want.append(c / tags * math.log(max(1.0, c / max(1, lc) * tags / lt)) / max(math.log(base), 0.1))
        assert all(math.isclose(x, y, abs_tol=1e-9) for x, y in zip(density, want, strict=True))
        assert all(math.isclose(sums[i], sum(want[k] for k in range(n) if t.parents[k] == i), abs_tol=1e-9) for i in range(n))


def above(t, k):
    out = []
    while t.parents[k] >= 0:
        k = t.parents[k]
        out.append(k)
    return out
