import numpy as np
import pytest

from gaugeworks.llm import html_text as ht
from gaugeworks.llm.boosted_trees import fit


def page(i, side=""):
    rng = np.random.default_rng(i)
    words = [f"word{j}" for j in range(50)]
    body = "".join(f"<p>{' '.join(rng.choice(words, rng.integers(1, 70)))} &amp; so on.</p>" for _ in range(int(rng.integers(2, 9))))
    return (f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/a>One</a></li>"
            f"<li><a href=/b>Two</a></li></ul></nav><!-- ad --><div class=\"ad\">Buy {' '.join(rng.choice(words, 12))}</div><article><h1>Title {i}</h1>{body}{side}</article>"
            f"<footer>&copy; site</footer></body></html>"), body


def truth(i, body):
    return "\n\n".join([f"Title {i}", *[p.replace("</p>", "").replace("&amp;", "&") for p in body.split("<p>")[1:]]])


@pytest.fixture(scope="module")
def model(spark):
    df = spark.createDataFrame([(page(i)[0],) for i in range(60)], "html string")
    return ht.learn(df)


def test_held_out_pages(model):
    pages = [page(i) for i in range(1000, 1100)]
    assert ht.extract([p for p, _ in pages], model) == [truth(i, b) for i, (_, b) in zip(range(1000, 1100), pages)]


@pytest.mark.parametrize("side", [
    "<section class='comments'><p>I read this and liked it a lot, thank you.</p><p>Me too.</p></section>", "<aside><p>Related: something else to read here.</p></aside>",
    "<div id=cookie-notice>We use cookies, as all do.</div>", "<form><p>Your name</p><input><button>Send</button></form>",
])
def test_marked_blocks_inside_the_article_go(model, side):
    for i in range(200, 210):
        p, body = page(i, side)
        assert ht.extract([p], model) == [truth(i, body)]


def test_page_without_marks(model):
    p, body = page(77)
    assert ht.extract([p.replace("article", "div")], model) == [truth(77, body)]


@pytest.mark.parametrize("raw,text", [
    ("", ""), ("plain", "plain"), ("<p>a<p>b<br>c", "a\n\nb c"), ("a &lt;b&gt; &#233; &nbsp; x &amp y &am", "a <b> é x & y &am"),
    ("<div>a<script>x</script> b<!-- c --><style>d</style></div>", "a b"), ("<p>a</div>b</p></p>", "ab"), ("x<script>never closed", "x"),
    ("<p title='a>b'>q</p><p title=\"unclosed>r</p>", "q\n\nr"), ("<ul><li>1<li>2</ul><table><tr><td>3<td>4</table>", "1\n\n2\n\n3\n\n4"), ("1 < 2 <3", "1 < 2 <3"),
])
def test_reading(raw, text):
    assert ht.extract([raw], None) == [text]


def test_long_and_deep_pages():
    assert len(ht.extract(["<ul>" + "<li>x" * 20000 + "</ul>"], None)[0]) == 59998
    assert ht.extract(["<div>" * 3000 + "deep" + "</div>" * 3000], None) == ["deep"]


def test_no_kept_block_below_a_dropped_one():
    rng = np.random.default_rng(0)
    nodes = ht.parse("<div><div><p>a</p><p>b</p></div><div><div><p>c</p></div><p>d</p></div></div>")
    ht.features(nodes)
    for _ in range(300):
        p = rng.random(len(nodes))
        keep = ht.decode(nodes, p)
        best = None
        for mask in range(1 << len(nodes)):
            k = [bool(mask >> i & 1) for i in range(len(nodes))]
            if any(k[i] and n.parent and not k[n.parent.index] for i, n in enumerate(nodes)):
                continue
            value = sum(np.log(p[i] if k[i] else 1 - p[i]) for i in range(len(nodes)))
            best = max(best, (value, k)) if best else (value, k)
        assert keep == best[1]


def test_rows(spark):
    rows = [(1, page(1)[0], "x"), (2, None, "x"), (3, "", None), (1, page(1)[0], "x")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = ht.extract_pages(df).collect()
    assert [(r.page_id, r.n_chars) for r in got if r.page_id != 1] == [(2, 0), (3, 0)]
    assert {r.text for r in got if r.page_id == 1} == {truth(1, page(1)[1])} and len(got) == 4
    assert ht.extract_pages(df.limit(0)).collect() == []


def test_boosted_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 5))
    y = ((x[:, 1] > 0.3) & (x[:, 3] < 0.6)).astype(float)
    p = fit(x[:1500], y[:1500]).probability(x[1500:])
    assert ((p > 0.5) == (y[1500:] > 0.5)).mean() > 0.98
