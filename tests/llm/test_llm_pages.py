import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from haulscope.llm import wrapper_induction as w
from haulscope.llm.html_text import parse, squeeze

SCHEMA = "page_id bigint, url string, html string"


def main_text(page):
    return "\n\n".join(w.main_blocks(parse(page), set()))


def body(inner):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body>{inner}</body></html>"


CASES = [
    ("<article><h1>Top</h1><p>One &amp; two</p><p>a<br>b\n c&nbsp;d</article>", "Top\n\nOne & two\n\na b c d"),
    ("<nav><a>x</a></nav><header>Site</header><main><p>Text</p></main><footer>f</footer>", "Text"),
    ("<article><p><b>open<p>next<script>var t='</p>';</script> more</p></article>", "open\n\nnext more"),
    ("<article><p>a</p><aside>side</aside><form><p>mail</p></form><div class='ad'>buy</div></article>", "a"),
    ("<article><p>a</p><section id=comments><article><p>first!</p></article></section></article>", "a"),
    ("<article><p>a</p></article><article class='comment'><p>a much longer reader comment</p></article>", "a"),
    ("<div class='cookie-notice'><p>We use cookies</p></div><div><p>Body text that is long.</p></div>",
     "Body text that is long."),
    ("<div class='with-sidebar'><article><p>in</p></article></div>", "in"),
    ("<article><header><h1>Head</h1></header><ul><li>x<li>y</ul><table><tr><td>1<td>2</table></article>",
     "Head\n\nx\n\ny\n\n1\n\n2"),
    ("<article>bare <i>text</i><p>then</article>", "bare text\n\nthen"),
    ("<article><p>1 &lt; 2 &#233; &#x1F600; &unknown; &copy;</p><!-- <p>no</p> --></article>", "1 < 2 é 😀 &unknown; ©"),
    ("<article><p title='a > b'>q</p><p hidden>h</p><p style='display:none'>n</p></article>", "q"),
    ("", ""),
]


@pytest.mark.parametrize("inner, text", CASES)
def test_main_text(inner, text):
    assert main_text(body(inner)) == text


def test_broken_pages_do_not_break_the_parser():
    for page in ("", "<", "<p", "</p>", "<p a=\"", "<!--", "<script>", "text", "<b></p></b>", "<div>" * 3000):
        main_text(page)
    assert squeeze(" a\n\tb&#32;c ") == "a b c"


def test_alignment_matches_as_much_as_it_can():
    a = parse("<div><h2>x</h2><p>1</p><p>2</p><ul><li>i</ul></div>")
    b = parse("<div><p>1</p><h2>x</h2><p>9</p><p>8</p><ul><li>i<li>j</ul><p>z</p></div>")
    pairs = [(x.tag, y.tag) for x, y in w.align(a, b)]
    assert all(x == y for x, y in pairs)
    assert sorted(x for x, _ in pairs) == ["#root", "div", "h2", "li", "p", "p", "ul"]


def pages():
    """Pages of one host with unmarked boilerplate, which only the comparison can tell."""
    rows = []
    for i in range(12):
        rows.append(
            (i, f"https://h.example/{i}", body(
                "<div><span>Home of things</span></div><div><div>All about things since 1901</div>"
                f"<p>Story {i} tells of {'many ' * (i + 3)}events.</p><p>It ends on page {i}.</p>"
                "<div>Write to the editor</div></div>"
            ))
        )
    return rows


def test_text_that_stays_the_same_over_a_host_is_template(spark):
    df = spark.createDataFrame([*pages(), (50, "https://other.example/", pages()[0][2])], SCHEMA)
    found = {r.page_id: r for r in w.extract(df.repartition(3)).collect()}
    for i in range(12):
        assert found[i].text == f"Story {i} tells of {'many ' * (i + 3)}events.\n\nIt ends on page {i}."
        assert found[i].n_chars == len(found[i].text)
    # A host with a single page has nothing to compare with.
    assert "Write to the editor" in found[50].text


def test_copies_of_one_article_are_not_template(spark):
    page = lambda i: body(f"<nav>{i}</nav><article><p>The same long text.</p></article>")
    df = spark.createDataFrame([(i, "http://c.example/x", page(i)) for i in range(9)], SCHEMA)
    assert {r.text for r in w.extract(df).collect()} == {"The same long text."}


def test_nulls_repeats_empty_tables_and_clashing_columns(spark):
    rows = [*pages(), (None, None, None), (3, None, ""), (4, "nonsense", "<p>x</p>"), *pages()[:2]]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"text": F.lit("mine"), "node": F.lit(1)})
    found = w.extract(df)
    assert found.where("node = 1").count() == len(rows) and "html" not in found.columns
    texts = {(r.page_id, r.url): r.text for r in found.collect()}
    assert texts[None, None] == "" and texts[3, None] == "" and texts[4, "nonsense"] == "x"
    assert w.extract(df.limit(0)).count() == 0


def test_very_long_pages_take_time_in_proportion(spark):
    long = lambda k: body("<article>" + "".join(f"<p>{k} {i}</p>" for i in range(20_000)) + "</article>")
    df = spark.createDataFrame([(k, "http://l.example", long(k)) for k in range(4)], SCHEMA)
    assert all(r.text.count("\n\n") == 19_999 for r in w.extract(df).collect())


def test_short_stories_lose_long_boilerplate(spark):
    frame = "<div>All about things since 1901</div><p>{}</p><div>" + "Write to the editor. " * 20 + "</div>"
    rows = [(i, f"https://s.example/{i}", body(frame.format(f"Story {i}."))) for i in range(8)]
    # Copies of one story share a vote: they don't make it template.
    rows += [(100 + i, f"https://s.example/{i}", body(f"<nav>{i}</nav>" + frame.format("Twice told."))) for i in range(40)]
    found = {r.page_id: r.text for r in w.extract(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert found == {i: f"Story {i}." if i < 100 else "Twice told." for i in found} and len(found) == 48


def test_each_layout_of_a_host_has_a_template(spark):
    """60 of 100 pages in one layout, 40 in another; each has its own constant text."""
    one = "<div><span>Slogan of one</span></div><div><p>{}</p></div><div>Footer of one</div>"
    two = "<section><h2>Slogan of two</h2></section><section><p>{}</p><ul><li>Menu of two</ul></section>"
    rows = [(i, f"https://two.example/{i}", body((two if i % 5 < 2 else one).format(f"Story {i} is told."))) for i in range(30)]
    found = {r.page_id: r.text for r in w.extract(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert found == {i: f"Story {i} is told." for i in range(30)}


def test_layouts_tell_templates_and_not_articles():
    at = lambda inner: w.layout(parse(body(inner)))
    assert at("<div>a</div><div><p>b</div>") == at("<div>x</div><div><h2>t</h2><p>y<p>z</div>")
    assert at("<div>a</div><div><p>b</div>") != at("<section><p>b</section>")
    assert at("<div><div>a</div><main>b</main></div>") == at("<div>a</div><main>b</main>")


def test_deep_pages_of_one_host(spark):
    deep = lambda k: body("<div>" * 1_200 + f"<p>Story {k}.")
    inline = lambda k: body("<p>" + "<font>" * 1_500 + f"Story {k}.")
    rows = [(i, "http://deep.example/", page(i)) for i, page in enumerate([deep, deep, inline, inline])]
    found = {r.page_id: r.text for r in w.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {i: f"Story {i}." for i in range(4)}


@pytest.mark.parametrize("n", [30, 400, 900])
def test_constant_text_in_the_middle_of_long_lists(n):
    def thread(k, n, at):
        items = [f"<div><h3>{k} by {i}</h3><p>{k} says {i}</p></div>" for i in range(n)]
        items.insert(at, "<div>House rules</div>")
        return parse("<section>" + "".join(items) + "</section>")

    pairs = w.align(thread(1, n, n // 2), thread(2, n + 1, n // 2 + 1))
    assert len(pairs) == 2 + 3 * n + 1
    assert [w.own_text(y) for x, y in pairs if w.own_text(x) == "House rules"] == ["House rules"]


def test_divided_tables_are_as_good_as_whole_ones(monkeypatch):
    rng = random.Random(5)
    for _ in range(200):
        weights = np.array([[rng.choice([-(1 << 40), 1, 2, 1_001]) for _ in range(4)] for _ in range(3)])
        r, c = (np.array([rng.randrange(k) for _ in range(rng.randint(1, 12))]) for k in (3, 4))
        whole = w._weighed(r.tolist(), c.tolist(), weights.tolist())
        monkeypatch.setattr(w, "SMALL_TABLE", 3)
        parts = sorted(w._divided(r, c, weights))
        assert all(i < k and j < m for (i, j), (k, m) in zip(parts, parts[1:], strict=False))
        weigh = lambda pairs: sum(weights[r[i], c[j]] for i, j in pairs)
        assert weigh(parts) == weigh(whole)
