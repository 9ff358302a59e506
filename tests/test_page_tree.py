import pytest
from pyspark.sql import functions as F

from corvane.sources.page_tree import beneath, code_pages, law_sections, page_nodes, texts_within


@pytest.fixture(scope="module")
def tree_of(spark):
    def make(*pages, id_type="long"):
        return page_nodes(spark.createDataFrame(list(pages), f"page long, html string, node string").repartition(2), "page", "html")

    return make


def rows(df, *columns):
    return sorted([tuple(r[c] for c in columns) for r in df.collect()], key=repr)


def sections(tree_of, body, page=1):
    found = law_sections(tree_of((page, f'<section>x</section><div id="leaf-statute-body">{body}</div><section>y</section>', None)), "page")
    return [(r.place, r.label, r.text, r.level, r.history) for r in found.orderBy("place").collect()]


def test_nodes_have_numbers_parents_and_paths(tree_of):
    got = tree_of((7, "<div class=a><p>One<p>Two <br><b>three</b></div>tail &amp; end", None)).orderBy("node").collect()
    assert [(r.node, r.parent, r.depth, r.tag, r.text) for r in got] == [
        (0, None, 0, "div", None), (1, 0, 1, "p", None), (2, 1, 2, None, "One"), (3, 0, 1, "p", None), (4, 3, 2, None, "Two "), (5, 3, 2, "br", None),
        (6, 3, 2, "b", None), (7, 6, 3, None, "three"), (8, None, 0, None, "tail & end"),
    ]
    assert [(e.node, e.tag, e.attributes) for e in got[7].path] == [(0, "div", {"class": "a"}), (3, "p", {}), (6, "b", {})]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<ul><li>a<li>b<ul><li>c</ul>d</ul>", [("a", 2), ("b", 2), ("c", 4), ("d", 2)]),
        ("</p>x</div>", [("x", 0)]),
        ("<b><i>x</b>y", [("x", 2), ("y", 0)]),
        ("<p>x<!-- <p>no -->y", [("x", 1), ("y", 1)]),
        ("<tr><td>1<td>2<tr><td>3", [("1", 2), ("2", 2), ("3", 2)]),
        ("<p>a<section><p>b</section>c", [("a", 1), ("b", 2), ("c", 0)]),
        ("<div id=1 id=2>x<script>a < b</script>", [("x", 1), ("a < b", 2)]),
        (" \n ", []),
    ],
)
def test_odd_markup(tree_of, html, want):
    assert [(r.text, r.depth) for r in tree_of((1, html, None)).where("tag IS NULL").orderBy("node").collect()] == want


def test_null_and_empty_pages_have_no_rows(tree_of):
    assert tree_of((1, None, None), (2, "", None)).count() == 0
    assert law_sections(tree_of((1, "<p>no body</p>", None)), "page").count() == 0
    assert code_pages(tree_of((1, "<p>no content</p>", None)), "page").count() == 0


def test_texts_within(tree_of):
    nodes = tree_of((1, "<div><p>a <b>b</b></p><p></p><p>c</p></div><p>d</p>", "x"))
    inner = beneath(F.col("path"), lambda e: e["tag"] == "div")
    got = texts_within(nodes, "page", F.filter(inner, lambda e: e["tag"] == "p"), ~F.exists("path", lambda e: e["tag"] == "b"))
    assert rows(got, "text") == [("a",), ("c",)]


def test_text_behind_an_inner_section_stays(tree_of):
    assert sections(tree_of, '<section class="level-0"><h2>(a)</h2> A <section class="level-1"><h3>(1)</h3> B</section> C tail</section>') == [(0, "a", "A B C tail", 0.0, None), (1, "1", "B", 1.0, None)]


def test_labels_levels_and_history(tree_of):
    got = sections(
        tree_of,
        '<section class="level-2 x"><h2>2.10.</h2><p>t</p></section><section><h4>Rules of (a)</h4>u</section><section><h3>(a)(b)</h3>v</section><section><h2>3..</h2>w</section>'
        '<section class="meta">old</section><section class="meta non-meta">x</section><section class="meta"> new <a class="pedantic">l</a></section><section> <h2>(z)</h2> </section><section><p>y<a class="b pedantic">no</a></section>',
    )
    assert got == [(0, "2.10", "t", 2.0, "new l"), (1, None, "u", 0.0, "new l"), (2, None, "v", 0.0, "new l"), (3, None, "w", 0.0, "new l"), (4, None, "x", 0.0, "new l"), (5, None, "y", 0.0, "new l")]


def test_an_outer_section_without_a_heading_has_the_inner_ones_label(tree_of):
    assert [x[:3] for x in sections(tree_of, "<section>A <section><h2>(b)</h2>B</section></section>")] == [(0, "b", "A B"), (1, "b", "B")]


def test_pages_without_sections_are_read_whole(tree_of):
    assert sections(tree_of, "<p>All <b>of</b> it</p>Source: there") == [(0, None, "All of it", 0.0, None)]
    assert sections(tree_of, 'Text<section class="meta">m</section>') == [(0, None, "Text m", 0.0, "m")]
    assert sections(tree_of, "Source: only") == [(0, None, "Source: only", 0.0, None)]


def brute_sections(depth, key):
    """The text of each section, by recursion."""
    if depth > 60:
        return "", []
    inner, below = brute_sections(depth + 1, key) if (key * 7 + depth) % 5 else ("", [])
    text = " ".join(x for x in (f"w{key} d{depth}", inner, f"tail{depth}") if x)
    return text, [(str(depth), text, float(depth))] + below


def html_of(depth, key):
    inner = html_of(depth + 1, key) if (key * 7 + depth) % 5 and depth <= 60 else ""
    return "" if depth > 60 else f'<section class="level-{depth}"><h2>{depth}.</h2><p>w{key}\n d{depth}{inner}<i>tail{depth}</i></section>'


def test_many_pages_equal_recursion(tree_of):
    pages = [(k, f'<div id="leaf-statute-body">{html_of(1, k)}</div>', None) for k in range(40)]
    got = law_sections(tree_of(*pages), "page")
    want = [(k, i, *x) for k in range(40) for i, x in enumerate(brute_sections(1, k)[1])]
    assert rows(got, "page", "place", "label", "text", "level") == sorted(want, key=repr)


def test_code_pages(tree_of):
    page = """<h4>site</h4><div id=codeLawSectionNoHead><h4>Vehicle Code - VEH</h4><h4>DIVISION 1. Old</h4><h5>General Provisions</h5><h4>DIVISION 11. Rules [21000 - 23336]</h4><h5>chapter 2.5A. Signs</h5>
    <i>enacted</i><font face=x><h6>21453.</h6><p>Intro</p><p style="margin-left: 1.5em;">(a) A <b>b</b></p><p> </p><p style="margin-left:x">(1) c</p><i>(Added.)</i><i>(Amended.)</i><i> </i></font></div><p>footer</p>"""
    got = code_pages(tree_of((3, page, None)), "page").first()
    assert got.code_name == "Vehicle Code" and got.section == "21453" and got.history == "(Amended.)"
    assert {k: tuple(v) for k, v in got.hierarchy.items()} == {"division": ("11", "Rules", "21000 - 23336"), "chapter": ("2.5A", "Signs", None)}
    assert [tuple(p) for p in got.paragraphs] == [(None, "Intro", 0.0), ("a", "A b", 1.5), ("1", "c", 0.0)]
    bare = code_pages(tree_of((4, "<div id=codeLawSectionNoHead><h4>Family Code</h4><h6>12a</h6><p>t</p></div>", None)), "page").first()
    assert (bare.code_name, bare.section, bare.history, bare.hierarchy) == ("Family Code", "12a", None, {}) and len(bare.paragraphs) == 1


def test_many_pages_of_one_batch_keep_their_own_elements(spark):
    """Rows of elements name them by their places in the batch: more rows than are handed on at once, null ids too."""
    from pyspark.sql import functions as F

    pages = spark.range(3000).select(F.when(F.col("id") != 7, F.col("id")).alias("id"), F.concat(F.lit("<div class='c"), "id", F.lit("' data-x><p>t <b>"), "id", F.lit("</b><i></div>u"))).toDF("id", "html").coalesce(1)
    got = page_nodes(pages, "id", "html")
    bold = got.where("text IS NOT NULL AND exists(path, e -> e.tag = 'b')").select("id", "text", F.col("path")[0]["attributes"].alias("a"), F.transform("path", lambda e: e["node"]).alias("p"))
    rows = {r.text: r for r in bold.collect()}
    assert len(rows) == 3000 and all(r.a == {"class": f"c{t}", "data-x": ""} and r.p == [0, 1, 3] for t, r in rows.items())
    assert rows["7"].id is None and all(str(r.id) == t for t, r in rows.items() if t != "7")
    assert got.where("tag = 'div' AND attributes['class'] = concat('c', id) AND size(path) = 0").count() == 2999
