import html
import re
import time

import pytest

from tidemark.llm import html_text as H

TABLE = "/root/testdata/sf0.01/pages.parquet"


def by_markup(page):
    """The article of the test pages, cut by its own tags."""
    inside = re.search("<article>(.*?)</article>", page, re.DOTALL)
    parts = re.split("</?(?:p|h1)>", inside.group(1) if inside else "")
    texts = [" ".join(html.unescape(re.sub("</?(?:b|i|br)>", lambda m: " " if "br" in m.group() else "", p)).split()) for p in parts]
    return "\n\n".join(t for t in texts if t)


def test_pages_of_the_table(spark):
    pages = spark.read.parquet(TABLE)
    wanted = {r.page_id: by_markup(r.html) for r in pages.collect()}
    rows = H.extract(pages).collect()
    assert len(rows) == len(wanted)
    assert all(r.text == wanted[r.page_id] and r.n_chars == len(r.text) for r in rows)


def test_other_layouts_held_out(spark):
    texts = [r.html for r in spark.read.parquet(TABLE).orderBy("page_id").collect()]
    field = H.Field().train(H.training_chains(texts[:100]))
    right = total = 0
    for chain, labels in H.training_chains(texts[150:200], seed=5):
        right += sum(a == b for a, b in zip(field.decode(chain), labels))
        total += len(labels)
    assert right / total > 0.99


def test_blocks():
    page = "<p>a &amp; b&nbsp;c<br>d</p><!-- <p>x --><script>'</p>'</script><ul><li>one<li><a href='>'>two</a></ul>tail<p hidden>z"
    assert [(t, n) for t, _, n in H.leaf_blocks(page)] == [("a & b c d", 0), ("one", 0), ("two", 3), ("tail", 0), ("z", 0)]
    assert list(H.leaf_blocks("")) == [] and list(H.leaf_blocks("<div><<<p")) != 0


def laid(page, how):
    """A page of the table without its article element: in a named box, a plain one, or a layout table."""
    before, inside, after = re.split("</?article[^>]*>", page)
    start, end = {"named": ('<div class="post-content">', "</div>"), "plain": ("<div>", "</div>"), "td": ("<table><tr><td>", "</td></tr></table>")}[how]
    return before + start + inside + end + after


def test_pages_without_article_elements(spark):
    rows = [r for r in spark.read.parquet(TABLE).orderBy("page_id").collect() if len(re.split("</?article[^>]*>", r.html)) == 3][:120]
    for kinds in (("named",), ("plain",), ("td",), ("named", "plain", "td", None)):
        shown = [(r, kinds[i % len(kinds)]) for i, r in enumerate(rows)]
        pages = spark.createDataFrame([(r.page_id, r.url, laid(r.html, how) if how else r.html) for r, how in shown], "page_id long, url string, html string")
        got = {r.page_id: r.text for r in H.extract(pages).collect()}
        assert sum(got[r.page_id] == by_markup(r.html) for r, _ in shown) >= 0.95 * len(shown), kinds


def test_no_page_says_anything():
    field = H.Field().train(H.training_chains(["<div>a</div>", ""]))
    texts = H._FIXED[1]
    page = "<div id=menu><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></div><div class=x>" + "".join(f"<p>{t}</p>" for t in texts) + "</div><div class=footer>&copy; us</div>"
    assert H.main_text(page, field) == "\n\n".join(texts)


def test_scripts_and_open_heads_end():
    texts = lambda page: [t for t, _, _ in H.leaf_blocks(page)]
    assert texts("<p>a<script>for(i=0;i<n;i++){}</script><p>b") == ["a", "b"]
    assert texts("<p>a<STYLE>x<y{}</Style ><p>b<script>'</scripts>'<z</script\n><p>c") == ["a", "b", "c"]
    assert texts("<p>a<object><script>i<n</script></object>b<p>c<script>d") == ["ab", "c"]
    assert texts("<html><head><meta charset=x><title>t</title><script>a<b</script><p>one<p>two") == ["one", "two"]
    assert texts("<head><link href=x><a href=y>one</a><div>two</div>") == ["one", "two"]
    assert texts("<head><title>t</title>one<p>two") == ["one", "two"]
    assert texts("<head> <style>p{}</style> </head> <body>one") == ["one"]


def test_viterbi_is_the_best_of_all():
    from itertools import product

    field = H.Field({"a": 1.1, "b": -0.7, "c": 0.3}, [0.2, -0.5, -0.9, 0.6])
    chain = [["a"], ["b"], ["b", "c"], ["c"], ["a", "b"], ["b"]]

    def total(ys):
        return sum(e for e, y in zip(field.emissions(chain), ys) if y) + sum(field.pairs[2 * a + b] for a, b in zip(ys, ys[1:]))

    assert total(field.decode(chain)) == max(map(total, product((0, 1), repeat=6)))
    p, _ = field.marginals(chain)
    from math import exp

    weight = {ys: exp(total(ys)) for ys in product((0, 1), repeat=6)}
    assert all(abs(p[i] - sum(w for ys, w in weight.items() if ys[i]) / sum(weight.values())) < 1e-9 for i in range(6))


def test_edges(spark):
    schema = "page_id long, url string, html string, text int"
    rows = [(1, None, None, 1), (2, "u", "", 1), (None, "u", "<p>" + "word " * 100_000 + ".</p>", 1), (2, "u", "", 1)]
    got = H.extract(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 4 and sum(r.n_chars == 0 for r in got) >= 3
    assert H.extract(spark.createDataFrame([], schema)).collect() == []


MEGABYTE = 1 << 20
HOSTILE = {
    "tags": "<a" * (MEGABYTE // 2), "blanks": "<p>hi</p><a" + " " * MEGABYTE + '"x', "quotes": "<a " + '"' * MEGABYTE, "mixed quotes": "<a \"'" * (MEGABYTE // 5),
    "declarations": "<!" * (MEGABYTE // 2), "comments": "<!--" * (MEGABYTE // 4), "open quotes": '<p class="' * (MEGABYTE // 10), "unmatched": "<div>" * (MEGABYTE // 10) + "</p>" * (MEGABYTE // 10),
    "brackets": "<" * MEGABYTE, "scripts": "<script>" * (MEGABYTE // 8),
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_take_linear_time(name):
    started = time.process_time()
    list(H.leaf_blocks(HOSTILE[name]))
    assert time.process_time() - started < 5


def test_deep_pages():
    deep = "<div>x" * 5000
    assert len(list(H.leaf_blocks(deep))) == 5000 and max(len(a) for _, a, _ in H.leaf_blocks(deep)) == H.DEPTH
    assert isinstance(H.main_text(deep, H.Field()), str)


def test_broken_tags():
    texts = lambda page: [t for t, _, _ in H.leaf_blocks(page)]
    assert texts('<p title="x>Second</p><p>Third</p>') == ["Second", "Third"]
    assert texts("a <b and c < d <p>x</p>") == ["a <b and c < d", "x"]
    assert texts("<p title=\"a > b\">ok</p><p data-x=\"<i>\" class='z'>fine</p>") == ["ok", "fine"]
