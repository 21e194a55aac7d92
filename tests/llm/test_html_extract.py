import itertools
import os
import random
import re
import time

import pytest

from wayfold.llm import html_extract as hx

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>no</article>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li>Menu</li></ul></nav><!-- <p>no</p> --><div class="cookie-notice"><div>Accept</div>cookies</div>
<article><h1>Head&amp;amp;line</h1><p><b>One<br>two  <i>th</i>ree&nbsp;x<p>Second &lt;p&gt;</p><div class="ad banner"><p>Buy</p></div><aside>side</aside><form><p>Mail</p></form>
<ul><li>a</li><li>b</li></ul><section id="comments"><p>I agree</p></section></article><div class="sidebar"><p>More</p></div><footer>&copy;</footer></body></html>"""


def kinds(html):
    return [(t, "sure open outside".split()[k]) for t, k in hx.lines(html)]


def test_marked_article():
    assert [t for t, k in kinds(PAGE) if k == "sure"] == ["Head&amp;line", "One two three x", "Second <p>", "a", "b"]
    assert {k for _, k in kinds(PAGE)} <= {"sure", "outside"}


def test_odd_markup():
    assert kinds("") == []
    assert kinds("plain  text") == [("plain text", "open")]
    assert kinds("<nav><p>menu<article><p>in") == [("in", "sure")]
    assert kinds("<p>a<script>x") == [("a", "open")] and kinds("<p>a<!-- x") == [("a", "open")] and kinds("a < b <") == [("a < b <", "open")]
    assert kinds("<P CLASS='x'>a</P><DIV HIDDEN>no</DIV>b") == [("a", "open"), ("b", "open")]
    assert len(hx.lines("<p>word " * 20000)) == 20000
    assert kinds("<main><article>x</article>y</main>z") == [("x", "sure"), ("y", "sure"), ("z", "outside")]
    assert kinds('<article class="comment"><p>c</p></article><p>t') == [("t", "open")]


def test_doubtful_elements():
    html = '<article><p>a <button>b</button></p><div class="share-box"><div>c</div><p>d</div><p>e</p><button>f</button><dialog>g<article>h</article>'
    assert kinds(html) == [("a b", "sure"), ("c", "open"), ("d", "open"), ("e", "sure"), ("f", "open"), ("g", "open"), ("h", "sure")]
    assert kinds('<article><p>a<svg><title>x</title></svg></p><p class="legal">l</article><p>m') == [("a", "sure"), ("x", "open"), ("l", "open"), ("m", "outside")]


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_common_lines_equal_brute_force():
    rng = random.Random(3)
    for n in [9] * 400 + [60] * 30:
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(n))] for _ in "ab")
        pairs = hx.common_lines(a, b)
        assert len(pairs) == lcs(a, b) and all(a[i] == b[j] for i, j in pairs)
        assert all(i < k and j < m for (i, j), (k, m) in itertools.pairwise(pairs))


def test_equal_lines_and_long_pages_are_quick():
    began = time.perf_counter()
    assert len(hx.common_lines(["x"] * 3000, ["x"] * 2500 + ["y"])) == 2500
    a, b = ["x"] * 6000 + ["y"] * 6000, ["y"] * 6000 + ["x"] * 6001
    assert len(hx.common_lines(a, b)) == 6000
    assert time.perf_counter() - began < 10


def brute(rows):
    """``extract`` over a list of (page_id, url, html), page by page."""
    seen = []
    for n, (i, url, html) in enumerate(rows):
        found = hx.lines(html or "")
        head, mark, rest = (url or "").partition("://")
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in re.split("[/?#]", rest)[0])
        path = re.split("[?#]", rest[len(host):])[0]
        seen.append((host, path, (i is not None, i or 0), found, n))
    digest = lambda f: tuple(f)
    out = {}
    for host, path, _, found, n in seen:
        others = sorted((x for x in seen if x[0] == host and host), key=lambda x: x[:3])
        at = next((k for k, x in enumerate(others) if x[4] == n), None)
        text = [t for t, k in found if k != hx.OUTSIDE]
        if at is not None and any(k == hx.OPEN for _, k in found):
            before = next((x for x in reversed(others[:at]) if digest(x[3]) != digest(found)), None)
            after = next((x for x in others[at + 1 :] if digest(x[3]) != digest(found)), None)
            near = sorted((x for x in (before, after) if x), key=lambda x: -len(os.path.commonprefix([x[1], path])))
            for x in near:
                pairs = hx.common_lines([t for t, _ in found], [t for t, _ in x[3]])
                mine, theirs = ([t for k, (t, kind) in enumerate(f) if kind != hx.OUTSIDE and k not in {p[s] for p in pairs}] for s, f in enumerate((found, x[3])))
                if not hx.alike(mine, theirs):
                    text = [t for k, (t, kind) in enumerate(found) if kind != hx.OUTSIDE and (kind == hx.SURE or k not in {p[0] for p in pairs})]
                    break
        out[n] = (*rows[n][:2], "\n\n".join(text), len("\n\n".join(text)))
    return sorted(out.values(), key=repr)


def site():
    rng, rows = random.Random(5), []
    words = [f"w{i}" for i in range(60)]
    line = lambda n=6: " ".join(rng.choice(words) for _ in range(n))
    for h in range(6):
        top, end, share = line(), line(), line()
        for k in range(rng.choice([1, 2, 5, 40])):
            own = "".join(f"<p>{line(rng.randrange(1, 15))}</p>" for _ in range(rng.randrange(4)))
            if rng.random() < 0.4:
                own = f'<article>{own}<div class="share">{rng.choice([share, line()])}</div></article>'
            html = f"<div>{top}</div>{own}<div>{end}</div><footer>f</footer>"
            for _ in range(rng.choice([1, 1, 1, 2, 12])):  # runs of equal pages
                rows.append((len(rows), f"http://h{h}.x/{rng.choice('ab')}/{len(rows):04}?q", html))
    rows += [(None, None, None), (None, "bad", "<p>x"), (9999, "http://h1.x/a/0", ""), (9999, "http://H1.x/a/0#z", "<p>other"), (9998, "http://alone.y", "<div>frame")]
    return rows


@pytest.mark.parametrize("partitions", [1, 4, 8, 200])
def test_equals_brute_force_whatever_the_partitions(spark, partitions):
    rows = site()
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, path int")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = sorted((tuple(r) for r in hx.extract(df.repartition(partitions)).collect()), key=repr)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == brute(rows)


def test_frames_go_and_copies_stay(spark):
    page = "<body><div>Frame top</div><div>{}</div><div>{}</div><div>Frame end</div>".format
    rows = [(i, f"http://h.x/a/{i}", page(f"own {i}", f"more {i}")) for i in range(6)]
    rows += [(10, "http://one.y/a", page("alone", "x")), (12, "http://c.z/a", page("copy", "y")), (13, "http://c.z/a", page("copy", "y")), (14, "bad", "<article>k</article>")]
    rows += [(20, "http://d.z/a", page("a long text of many words here", "y")), (21, "http://d.z/b", page("a long text of many words there", "y")), (22, "http://d.z/c", page("something else", "z"))]
    got = {r.page_id: r.text for r in hx.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"own {i}\n\nmore {i}" for i in range(6))
    assert got[10] == "Frame top\n\nalone\n\nx\n\nFrame end" and got[12] == got[13] == "Frame top\n\ncopy\n\ny\n\nFrame end" and got[14] == "k"
    assert got[21] == "a long text of many words there\n\ny" and got[22] == "something else\n\nz"
    assert hx.extract(spark.createDataFrame(rows, "page_id long, url string, html string").limit(0)).collect() == []
