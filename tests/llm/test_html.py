"""Pages and what is seen of them."""

import time

import pytest

from hypothesis import given, settings, strategies as st

from quadrille.llm.html_text import extract_text, visible_text

CASES = [
    ("", ""),
    ("  a \n b  <b> c</b>d", "a b cd"),
    ("<b>a</b> <i>b</i>", "a b"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<p>a<p>b", "a\n\nb"),
    ("</p>x</div>", "x"),
    ("<h1>T</h1><div>a</div><div>b</div><p>c</p>", "T\n\na\nb\n\nc"),
    ("a<hr>b", "a\n\n---\n\nb"),
    ("<pre>a  b\n  c</pre>", "a  b\n  c"),
    ("&lt;b&gt; &amp; &copy; &#x41;", "<b> & © A"),
    ("1 < 2 <3", "1 < 2 <3"),
    # lists
    ("<ul><li>x<li>y<ol start=3><li>z</ol></ul>", "- x\n- y\n  3. z"),
    ("<ul><li></li><li>k</ul>", "- k"),
    ("<li><p>one</p><p>two</p></li>", "- one\n\n  two"),
    ("<ol><li>a<li>b</ol>", "1. a\n2. b"),
    ("<dl><dt>t<dd>d<dt>u</dl>", "t\n  d\nu"),
    # tables
    ("<table><tr><td>a<td>bbb<tr><td>cccc<td>d</table>", "a     bbb\ncccc  d"),
    ("<table><tr><th colspan=2>head<tr><td>a<td>b</table>", "head\na  b"),
    ("<table><tr><td rowspan=2>r<td>1<tr><td>2</table>", "r  1\n   2"),
    ("<table><td>a<br>b<td>c</table>", "a  c\nb"),
    ("<table><tr><td>a<table><tr><td>in<td>ner</table><td>z</table>", "a        z\n\nin  ner"),
    ("<table>before<tr><td>x</table>", "before\n\nx"),
    ("<td>lone</td>x", "lone\nx"),
    # what is not seen
    ("<head><title>t</title></head><body>x", "x"),
    ("<script>var a='<p>no</p>'</script><style>p{}</style><!-- no -->yes", "yes"),
    ("<div hidden>no</div><div style='display: none'>no<p>no</div>yes", "yes"),
    ("<span style='visibility:hidden'>no<b style='visibility:visible'>yes</b></span>", "yes"),
    ("<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details>", "s\nt\nyes"),
    ("<noscript>no</noscript><template>no</template><textarea>no</textarea>ok", "ok"),
    ("a<!-- no end", "a"),
    ("a<script>no end", "a"),
    ("<img alt='picture'> text", "picture text"),
    # what a browser shows beside these
    ("<head><title>T</title>Hello", "Hello"),
    ("<head> <meta charset=a><br>x<title>T</title>", "x"),
    ("so <math><semantics><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></semantics></math>.", "so x=2."),
    ("<svg><title>no</title><text x=1>Chart</text><g><text>Q1<tspan> up</tspan></text></g><path d=z></svg>on", "Chart\nQ1 up\non"),
    ("<svg><defs><text>no</text></defs><g style='display:none'><text>no</text></g>no<foreignObject><p>in</p></foreignObject></svg>", "in"),
    ("<div hidden><svg><text>no</text></svg></div>yes", "yes"),
    ("<select><option>a<option selected>b</select> c", "b c"),
    ("Size: <select><option disabled>pick<option>small <b>one</b><option>large</select>.", "Size: small one ."),
    ("<select><optgroup label=no><option label=L>text</option></optgroup></select>", "L"),
    ("<select multiple><option>a<option>b</select>", "a\nb"),
    ("<select hidden><option>no</select><select></select>x", "x"),
    ("<select><option selected>a<option selected>b", "b"),
    ("<object data=a><param name=b>instead</object> on", "instead on"),
]


@pytest.mark.parametrize("html,text", CASES)
def test_page(html, text):
    assert visible_text(html) == text


@pytest.mark.parametrize("html", ["<div>" * 50_000 + "x", "<b>x " * 50_000, "<p>x " * 50_000, "<" * 100_000, "<!--" * 50_000, "<a " * 50_000, "<script>" * 50_000, "<table><tr><td>" * 3000 + "x", "<a b='" * 30_000])
def test_odd_pages_take_linear_time(html):
    began = time.time()
    visible_text(html)
    assert time.time() - began < 20


@pytest.mark.parametrize("html", ["<table>" + "<tr><td rowspan=60000>x" * 1500, "<table><tr>" + "<td>x" * 10_000, "<ul><li>x" * 4000, "<table><tr><td>" + "w" * 8000 + "<td>b" + "<tr><td>a<td>b" * 2800, "<p><template>" + "<span>" * 4000 + "<div>" * 4000, "<blockquote>x" * 3000, "<ul><li>" * 5000 + "x", ("<table><tr><td>" + "w" * 300 + "<td>") * 60 + "x<br>" * 3000, "<table><tr><td colspan=1000>x" + "<td colspan=1000>y" * 2500])
def test_odd_pages_give_text_in_proportion(html):
    began = time.time()
    text = visible_text(html)
    assert time.time() - began < 3 and len(text) < 10 * len(html)


def plain_table(rows: list[list[tuple[str, int, int]]]) -> str:
    """A table laid out on a grid of places, cell by cell."""
    taken, cells = set(), []
    for r, row in enumerate(rows):
        c = 0
        for text, across, down in row:
            while (r, c) in taken:
                c += 1
            taken |= {(r + i, c + j) for i in range(down) for j in range(across)}
            cells.append((r, c, across, text))
            c += across
    widths = {}
    for spanning in (False, True):
        for _, c, across, text in cells:
            if (across > 1) == spanning:
                room = sum(widths.get(k, 0) for k in range(c, c + across)) + 2 * (across - 1)
                widths[c + across - 1] = widths.get(c + across - 1, 0) + max(0, len(text) - room)
    lines = []
    for r in range(len(rows)):
        line = ""
        for _, c, _, text in [x for x in cells if x[0] == r and x[3]]:
            line = line.ljust(sum(widths.get(k, 0) + 2 for k in range(c))) + text
        if line:
            lines.append(line)
    return "\n".join(lines)


#: No cell reaches into one that spans columns: HTML lets those overlap, in ways that layouts differ on.
CELLS = st.tuples(st.text("abc", max_size=6), st.just(1), st.integers(1, 3))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(CELLS, max_size=4), max_size=5), st.lists(st.tuples(st.text("abc", max_size=9), st.integers(1, 3), st.just(1)), max_size=3))
def test_tables_against_a_grid(rows, head):
    rows = [head, *rows]
    html = "<table>" + "".join("<tr>" + "".join(f"<td colspan={a} rowspan={d}>{t}</td>" for t, a, d in row) for row in rows) + "</table>"
    assert visible_text(html) == plain_table(rows)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["one ", "two ", "x&amp;y ", "<p>", "</p>", "<div>", "</div>", "<b>", "</b>", "<ul>", "<li>", "</ul>", "<br>", "<table><tr><td>", "<td>", "<tr>", "</table>", "<!-- no -->", "<h1>", "</h1>", "</nothing>", "<pre>", "</pre>"]), max_size=40))
def test_no_word_is_lost(parts):
    """Words come out once each, whatever tags are open, but for cells beside each other in their order."""
    want = sorted(p.replace("&amp;", "&").strip() for p in parts if not p.startswith("<"))
    assert sorted(w for w in visible_text("".join(parts)).replace("-", " ").split()) == want


def test_clashing_names_stay(spark):
    df = spark.createDataFrame([(1, "<p>a", "mine", "mine", "mine", "mine")], "page_id bigint, html string, _row string, _text string, _html string, text string")
    rows = extract_text(df)
    assert rows.columns == ["page_id", "_row", "_text", "_html", "text"]
    assert tuple(rows.first()) == (1, "mine", "mine", "mine", "a")


def test_table_of_pages(spark):
    df = spark.createDataFrame([(1, None, "keep"), (2, "", "keep"), (3, "<p>a<p>b", "keep"), (3, "<p>a<p>b", "keep")], "page_id bigint, html string, _row string")
    rows = extract_text(df)
    assert rows.columns == ["page_id", "_row", "text"]
    assert sorted((r["page_id"], r["text"]) for r in rows.collect()) == [(1, ""), (2, ""), (3, "a\n\nb"), (3, "a\n\nb")]
    assert extract_text(df.limit(0)).count() == 0
