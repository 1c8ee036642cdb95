import itertools

import numpy as np

from veilgraph.llm import pages as P


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_shared_is_a_longest_common_subsequence():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a, b = (list(rng.integers(0, rng.integers(1, 8), rng.integers(0, 30))) for _ in range(2))
        got = sorted(P.shared(a, b))
        it = iter(b)
        assert all(a[i] in it for i in got) and len(got) == lcs(a, b)


PAGE = """<!DOCTYPE html><head><title>No</title><style>p{}</style></head><body class="has-sidebar"><header>Top</header><nav><ul><li>Menu</ul></nav>
<div class="cookie-notice">We use cookies</div>{0}<footer>&copy; no</footer><script>var t="<p>x</p>";</script></body>"""


def text(page, other=None):
    return P.main_text(P.blocks(page), P.blocks(other))


def test_markup():
    article = '<article><header><h1>Head&amp;line</h1></header><p>One <b>bo</b>ld&nbsp;x<br>y\n z<p title="a>b">Two</p><div class="ad">Buy</div><aside>Side</aside><form>Name</form><p class=comments>He said<p>Three<section id="comments"><p>Reader</section></article><p>after</p>'
    assert text(PAGE.replace("{0}", article)) == "Head&line One bold x y z Two Three"
    assert text("") == text(None) == text("<nav>a</nav>") == ""
    assert text("<article>cut off &am<p") == "cut off &am"
    assert text("plain &lt;b&gt; text") == "plain <b> text"
    assert text("<article>" + "<p>w</p>" * 20000 + "</article>") == " ".join(["w"] * 20000)


def test_differencing():
    a = PAGE.replace("{0}", "<div>Site name</div><div>Story A</div><div>Terms</div>")
    b = PAGE.replace("{0}", "<div>Site name</div><div>Story B</div><div>Terms</div>")
    assert text(a, b) == "Story A" and text(a) == "Site name Story A Terms"


def test_table_in_any_number_of_ranges(spark):
    page = "<div>Site {0}</div><div>Story {1}</div><div>Terms {0}</div>"
    rows = [(i, f"https://h{i % 3 if i % 2 else 0}.org/a/{i}?q#f", page.format(i % 3 if i % 2 else 0, i), "x") for i in range(200)]
    odd = [(None, None, None, "x"), (500, None, "", "x"), (501, "https://alone.org/", page.format(9, 9), "x"), (502, "http://dup.org/a", "<article>d</article>", "x"), (502, "http://dup.org/a", "<article>d</article>", "x")]
    df = spark.createDataFrame(rows + odd, "page_id long, url string, html string, host string")
    want = sorted([(i, u, f"Story {i}", 6 + len(str(i))) for i, u, _, _ in rows] + [(None, None, "", 0), (500, None, "", 0), (501, "https://alone.org/", "Site 9 Story 9 Terms 9", 22)] + [(502, "http://dup.org/a", "d", 1)] * 2, key=str)
    for n in ("1", "4", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        assert sorted(map(tuple, P.extract(df).collect()), key=str) == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert P.extract(df.limit(0)).collect() == []


def test_class_words():
    assert all(map(P.marked, ("ad", "ad-slot", "cookie_banner", "site-footer", "nav-main", "comment-list")))
    assert not any(map(P.marked, ("article-header", "page-with-sidebar", "no-sidebar", "post-comments-count", "headline", "", "-")))
    assert text('<div class="page-with-sidebar"><div class="article-header"><h1>T</h1></div><p>Body</p><div class="sidebar">S</div></div>') == "T Body"


def test_deep_nesting_is_not_quadratic():
    n = 60_000
    assert text("<div>" * n + "x" + "</div>" * n) == "x" and text("<b>" * n + "<p>y" + "</b>" * n + "</p>") == "y"


def test_random_sites_against_brute_force():
    """Pages of lines without markup of their own: what is left is what no longest common subsequence has."""
    rng = np.random.default_rng(4)
    for _ in range(60):
        frame = [f"frame {i}" for i in range(rng.integers(1, 6))]
        own = [[f"story {k} {i}" for i in range(rng.integers(0, 8))] for k in (0, 1)]
        at = [sorted(rng.integers(0, len(o) + 1, len(frame))) for o in own]
        lines = []
        for o, places in zip(own, at, strict=True):
            got, j = [], 0
            for i in range(len(o) + 1):
                while j < len(frame) and places[j] == i:
                    got.append(frame[j])
                    j += 1
                got += o[i : i + 1]
            lines.append(got)
        page = ["".join(f"<div>{x}</div>" for x in got) for got in lines]
        assert text(page[0], page[1]) == " ".join(x for x in lines[0] if x not in frame)
        assert len(lines[0]) - len(own[0]) == lcs(*lines)
