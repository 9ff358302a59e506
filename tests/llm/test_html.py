import html as htmllib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm.html_text import common_lines, content, extract_text, page_lines, shared_lines

PAGE = "<html><head><title>t</title><style>p{{}}</style></head><body><nav>menu {n}</nav><div class='ad'>buy</div>{body}<footer>foot</footer><script>x='</p>'</script></body></html>"


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4), max_size=14))
def test_alignment_is_a_longest_common_subsequence(a, b):
    shared = common_lines(np.array(a, np.int64), np.array(b, np.int64))
    kept = [x for x, s in zip(a, shared) if s]
    it = iter(b)
    assert all(x in it for x in kept) and len(kept) == lcs(a, b)


def test_long_pages_are_aligned_whole():
    a = np.arange(5000) % 2600
    b = np.r_[9999, np.full(2500, 7), a, 9998]
    assert common_lines(a, b).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4), max_size=14))
def test_halved_alignment_is_a_longest_common_subsequence(a, b):
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr("corvane.llm.html_text.TABLE_CELLS", 6)
        shared = common_lines(np.array(a, np.int64), np.array(b, np.int64))
    kept, it = [x for x, s in zip(a, shared) if s], iter(b)
    assert all(x in it for x in kept) and len(kept) == lcs(a, b)


def text(html, shared=None):
    return content(page_lines(html), None if shared is None else np.array(shared, np.int64))


@pytest.mark.parametrize(
    "html, want",
    [
        (None, ""), ("", ""), ("plain  text\n here", "plain text here"), ("a &lt; b &amp;amp; c&nbsp;d", "a < b &amp; c d"), ("<p>one<p>two <b>bo</b>ld<br>x", "one two bold x"),
        ("<article><h1>T</h1><p>x</p><section class='comments'>c</section></article><p>out</p>", "T x"), ("<main><header><h1>H</h1></header>y</main>", "H y"),
        ("<header>site</header><p>y</p><aside>z</aside><form>f</form>", "y"), ("<div id=cookie-notice>c</div><div class='post'>p</div><div role=navigation>n</div>", "p"),
        ("<p>a<script>if(1<2){'</p>'}</script>b</p>", "a b"), ("<p>x<!-- <p>no</p> -->y", "xy"), ("<p title='a>b'>q", "q"), ("3 < 4 and <3", "3 < 4 and <3"), ("<p hidden>no</p><p>yes", "yes"),
    ],
)
def test_content_of_markup(html, want):
    assert text(html) == want


@pytest.mark.parametrize("html", ["<div " * 50_000, "<div>" * 50_000, "<a \"" * 50_000, "</div>" * 50_000 + "<b>" * 50_000 + "</i>" * 50_000, "<" * 100_000, "<!--" * 50_000])
def test_broken_markup_takes_linear_time(html):
    import time

    began = time.time()
    page_lines(html)
    assert time.time() - began < 5


def make(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_differencing_drops_template_lines_without_marked_content(spark):
    rng = random.Random(1)
    rows = []
    for host in ("a.example", "b.example"):
        for i in range(40):
            own = "".join(f"<p>own {host} {i} {rng.random()}</p>" for _ in range(3))
            rows.append((len(rows), f"http://{host}/x/{i:03d}?q=1", PAGE.format(n=i, body=f"<div>Welcome to {host}</div>{own}<div>Call us</div>")))
    got = extract_text(make(spark, rows).repartition(7)).collect()
    for r in got:
        want = " ".join(re.findall(r"<p>(own[^<]*)</p>", rows[r.page_id][2]))
        assert r.text == want and r.n_chars == len(want) and r.n_shared >= 2
        assert rows[r.partner][1].split("/")[2] == r.url.split("/")[2]


def test_copies_are_compared_with_the_next_other_page(spark):
    page = "<p>menu</p><p>own {}</p><p>notice</p>"
    rows = [(i, f"http://h/a?v={i}", page.format("a")) for i in range(9)] + [(20 + i, f"http://h/b/{i}", page.format("b")) for i in range(5)]
    got = sorted((r.page_id, r.text, r.partner, r.n_shared) for r in extract_text(make(spark, rows)).collect())
    assert got == [(i, "own a", 20, 2) for i in range(9)] + [(20 + i, "own b", 0, 2) for i in range(5)]


def test_marked_content_and_copies_stay(spark):
    body = "<article><h1>T</h1><p>same article</p></article>"
    rows = [(1, "http://h/a", PAGE.format(n=1, body=body)), (2, "http://h/b", PAGE.format(n=1, body=body)), (3, "http://h/c", PAGE.format(n=2, body=body))]
    rows += [(4, "http://solo/a", "<p>alone</p>"), (5, None, None), (6, "no host", ""), (None, "http://h/d", PAGE.format(n=9, body=body)), (1, "http://h/a", rows[0][2])]
    docs = make(spark, rows).selectExpr("*", "1 AS text", "2 AS partner", "3 AS th")
    got = sorted(((r.page_id, r.text) for r in extract_text(docs).collect()), key=repr)
    assert got == sorted([(i, "T same article") for i in (1, 1, 2, 3, None)] + [(4, "alone"), (5, ""), (6, "")], key=repr)


def test_partner_is_the_nearest_path_however_rows_are_dealt(spark):
    rng = random.Random(5)
    paths = sorted({f"/{rng.choice('ab')}/{rng.choice('xyz')}{rng.randrange(40)}" for _ in range(90)})
    rows = [(i, f"https://h{p}", f"<p>t</p><p>{i}</p>") for i, p in enumerate(paths)]

    def common(a, b):
        return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    want = {}
    for i, p in enumerate(paths):
        sides = [(common(p, paths[j]), -k, j) for k, j in enumerate((i - 1, i + 1)) if 0 <= j < len(paths)]
        want[i] = max(sides)[2]
    for parts in (1, 4, 60):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {r.page: r.partner for r in shared_lines(make(spark, rows).repartition(3), "page_id", "url", "html").collect()}
        assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", 4)


ARTICLE = "<p>Welcome</p><article><h1>T</h1><p>{0} one</p><div class='share-price'>{1}</div><div class=ad>buy {0}</div></article><div>{0} goes on</div><p>Call us</p>"


def test_differencing_decides_what_markup_leaves_open(spark):
    """Lines outside an article, and lines in it whose class only looks like a mark, stay unless the neighbour has them."""
    rows = [(i, f"http://h/{i:02d}", ARTICLE.format(f"own{i}", "Share this" if i < 6 else f"price {i}")) for i in range(12)]
    got = {r.page_id: r.text for r in extract_text(make(spark, rows)).collect()}
    assert got == {i: f"T own{i} one {f'price {i} ' if i >= 6 else ''}own{i} goes on" for i in range(12)}
    lone = extract_text(make(spark, rows[7:8])).first()
    assert lone.text == "T own7 one" and lone.partner is None


def brute_text(rows):
    """Every page against the nearest path of its host with other lines, by a plain table of lengths."""
    lines = {(k, h): page_lines(h) for k, _, h in rows}
    words = lambda r: tuple(x[0] for x in lines[(r[0], r[2])])
    path = lambda r: re.sub(r"^https?://[^/]*|[?#].*", "", r[1])
    host = lambda r: r[1].split("/")[2]
    out = {}
    for row in rows:
        firsts = {}
        for r in sorted(rows, key=lambda r: (path(r), r[0])):
            if host(r) == host(row):
                firsts.setdefault(words(r), r)
        order = sorted(firsts.values(), key=lambda r: (path(r), r[0]))
        at = order.index(firsts[words(row)])
        near = [order[i] for i in (at - 1, at + 1) if 0 <= i < len(order)]
        start = lambda r: len(next(iter([p for p in [path(order[at])[:n] for n in range(len(path(r)), -1, -1)] if path(r).startswith(p)])))  # noqa: B023, E731
        partner = max(near, key=lambda r: (start(r), r is near[0])) if near else None
        a, b = words(row), words(partner) if partner else ()
        shared = np.array(sorted(lcs_places(a, b)), np.int64) if partner else None
        out[row[0]] = content(lines[(row[0], row[2])], shared)
    return out


def lcs_places(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    i, j, out = len(a), len(b), set()
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.add(i)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_texts_match_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(70):
        body = [f"<p>{rng.choice(['menu', 'call us', 'own ' + str(rng.random())])} {k}</p>" for k in range(rng.randrange(6))]
        if rng.random() < 0.5:
            body.insert(rng.randrange(len(body) + 1), f"<article><p>story {rng.randrange(30)}</p><div class='menu-card'>{rng.choice('abc')}</div></article>")
        rows.append((i, f"http://{rng.choice('ab')}.x/{rng.choice('pq')}{rng.randrange(50):02d}/{i:03d}?z", "".join(body)))
    got = {r.page_id: r.text for r in extract_text(make(spark, rows).repartition(5)).collect()}
    assert got == brute_text(rows)


def test_empty_table(spark):
    assert extract_text(make(spark, [])).count() == 0
    assert htmllib.unescape("&lt;") == "<"
