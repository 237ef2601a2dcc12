import html
import math
import random
import re

import pytest

from strandline.llm import html_text

CASES = [
    (None, ""),
    ("", ""),
    ("just text", "just text"),
    ("<nav><a>menu</a></nav><article><h1>T &amp; U</h1><p>one\n  two<p>three &eacute;</article><footer>f</footer>", "T & U\none two\nthree é"),
    ("<head><title>no</title><style>p{}</style><body><div class='ad'>buy</div><article><p>yes <b>bold</b> text</p><div class='comments'><p>c</p></div></article>", "yes bold text"),
    ("<article><p>a<br>b<script>var t='</p>';</script></p><form>f<input></form><aside>s</aside><p>c</article>", "a\nb\nc"),
    ("<article><p><b>open<br><p>next</p></article><footer>no</footer>", "open\nnext"),
    ("<main><p>in main</p></main><div id='cookie-notice'>no</div>", "in main"),
    ("<article><p>x</p></nav></div><p>stray ends</p></article>", "x\nstray ends"),
    ("<article>" + "<p>w</p>" * 3000 + "</article>", "\n".join("w" * 3000)),
    ("<header>site</header><article><header><h1>Title</h1></header><p>text</p><footer>by</footer></article>", "Title\ntext"),
    ("<main><header><h1>Title</h1></header><p>text</p><footer>by</footer></main>", "Title\ntext"),
    ("<header>site</header><p>one <button>press</button> line</p><nav>menu</nav>", "one line"),
    ("<nav>only</nav><footer>these</footer>", ""),
    ("<article><p class='share-price'>a</p><section id='search-algorithms'>b</section><p class='notice-board'>c</p><fieldset>d</fieldset></article>", "a\nb\nc\nd"),
    ("<article><p>a</p><div class='lead site-header'>no</div><ul class=related-posts><li>no</ul><div id=comment-list>no</div><div class='commentary'>yes</div></article>", "a\nyes"),
    ("<article>" + "<div>" * 5000 + "deep" + "</div>" * 5000 + "</article>", "deep"),
]


@pytest.mark.parametrize(("page", "want"), CASES)
def test_cases(page, want):
    assert "\n".join(t for t, _ in html_text.content_blocks(page)) == want


def test_without_marks_the_dense_region_wins():
    links = "".join(f"<li><a href='/{i}'>l{i}</a></li>" for i in range(12))
    body = "".join(f"<p>{'long sentence of the story ' * 12}{i}</p>" for i in range(6))
    got = "\n".join(t for t, _ in html_text.content_blocks(f"<div><ul>{links}</ul></div><div>{body}</div><div><ul>{links}</ul></div>"))
    assert got.count("story") == 72 and "l5" not in got


def test_marked_teasers_do_not_replace_the_text():
    teasers = "".join(f"<article><a href='/{i}'><b>teaser</b></a> {i}</article>" for i in range(5))
    body = "".join(f"<div>{'long sentence of the story ' * 12}{i}</div>" for i in range(6))
    for page in (f"<div>{body}</div>{teasers}", f"{teasers}<div>{body}</div>", f"<div>{body}</div><article>a box</article>"):
        got = "\n".join(t for t, _ in html_text.content_blocks(page))
        assert got.count("story") == 72
    links = "".join(f"<li><a href='/{i}'>l{i}</a></li>" for i in range(12))
    got = "\n".join(t for t, _ in html_text.content_blocks(f"<ul>{links}</ul><main><h1>T</h1>{body}<p>e</p></main><ul>{links}</ul>"))
    assert got.startswith("T\n") and got.endswith("\ne") and "l5" not in got


def test_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<article>x</article>", 3), (1, "u", "<article>x</article>", 3), (None, None, None, 1)], "page_id long, url string, html string, n_chars int")
    got = html_text.main_text(pages).collect()
    assert sorted((x.text, x.n_chars) for x in got) == [("", 0), ("x", 1), ("x", 1)]
    assert html_text.main_text(pages.where("false")).count() == 0


def test_clusters_choose_without_names(spark):
    """Pages whose elements and classes say nothing: what menus, adverts and footers hold is told from its ratios alone."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("html").collect()]
    text = lambda html: "\n".join(t for t, _ in html_text.content_blocks(html))
    marked = [text(h) for h in pages]

    def same(names, ad=False):
        bare = [re.sub(rf"(</?)({names})\b", r"\1div", h) for h in pages]
        return sum(a == text(h.replace('<div class="ad">', "<div>") if ad else h) for a, h in zip(marked, bare, strict=True)) / len(pages)

    assert same("article") == 1
    assert same("nav|article") >= 0.99
    assert same("footer") >= 0.97 and same("none", ad=True) >= 0.99
    assert same("nav|article|footer") >= 0.93
    assert same("nav|article|footer", ad=True) >= 0.93
    # which parts the clusters alone drop
    parts = {"menu": 0, "advert": 0, "footer": 0}
    for h in pages:
        kept = text(re.sub(r"(</?)(nav|article|footer)\b", r"\1div", h).replace('<div class="ad">', "<div>"))
        line = lambda form, h=h: " ".join(re.sub("<[^>]*>", "", html.unescape(re.search(form, h, re.S)[1])).split())
        parts["menu"] += line("<li>(.*?)</li>") not in kept.split("\n")
        parts["advert"] += line('<div class="ad">(.*?)</div>') not in kept
        parts["footer"] += line("<footer>(.*?)</footer>") not in kept
    assert parts["menu"] >= 0.97 * len(pages) and parts["advert"] >= 0.97 * len(pages) and parts["footer"] >= 0.93 * len(pages), parts


def test_names_drop_what_reads_like_content():
    story = "".join(f"<p>{'long sentence of the story ' * 12}{i}</p>" for i in range(3))
    got = "\n".join(t for t, _ in html_text.content_blocks(f"<div>{story}</div><div class='comments'>{story.replace('story', 'reply')}</div>"))
    assert got.count("story") == 36 and "reply" not in got
    got = "\n".join(t for t, _ in html_text.content_blocks(f"<p>tiny</p><footer>{story}</footer>"))
    assert got == "tiny"


def test_region_rules():
    story = "".join(f"<p>{'long sentence of the story ' * 12}{i}</p>" for i in range(3))
    links = "".join(f"<li><a href='/{i}'>l{i}</a></li>" for i in range(12))
    got = "\n".join(t for t, _ in html_text.content_blocks(f"<div>{story}</div><ul>{links}</ul><div>{story}<p>The end.</p></div>"))
    assert got.count("story") == 72 and "l5" not in got and got.endswith("The end.")
    got = "\n".join(t for t, _ in html_text.content_blocks(f"<div>{story}<ul><li>Milk<li>Eggs</ul>{story}</div>"))
    assert "Milk\nEggs" in got


def plain_choice(lines, sigma=1.0):
    """The rules once more, with plain loops."""
    own = [i for i, x in enumerate(lines) if not x.aside]
    if not own:
        return []
    raw = [len(x.text) / max(1, x.tags) for x in lines]
    regions = sorted({x.region for x in lines})
    level = {}
    for r in regions:
        places = [i for i, x in enumerate(lines) if x.region == r]
        for a, i in enumerate(places):
            w = {j: math.exp(-0.5 * ((a - b) / sigma) ** 2) for b, j in enumerate(places) if abs(a - b) <= 3}
            level[i] = sum(w[j] * raw[j] for j in w) / sum(w.values())
    size = {r: sum(len(x.text) for x in lines if x.region == r) for r in regions}
    mean = {r: sum(len(x.text) * level[i] for i, x in enumerate(lines) if x.region == r) / size[r] for r in regions}
    centre = lambda rs: sum(size[r] * mean[r] for r in rs) / sum(size[r] for r in rs)
    low, high = min(mean.values()), max(mean.values())
    for _ in range(50):
        over, under = [r for r in regions if mean[r] > (low + high) / 2], [r for r in regions if mean[r] <= (low + high) / 2]
        if not over or not under or (low, high) == (centre(under), centre(over)):
            break
        low, high = centre(under), centre(over)
    upper = {r for r in regions if mean[r] > (low + high) / 2} if high >= 2 * low else set(regions)
    if not any(lines[i].region in upper for i in own):
        upper.add(max(regions, key=lambda r: sum(len(x.text) * level[i] for i, x in enumerate(lines) if x.region == r and not x.aside) / size[r]))
    places = [i for i in own if lines[i].region in upper]
    loose = {r for r in regions if 2 * sum(y.linked for y in lines if y.region == r) <= size[r]}
    inside = {x.region for x in lines[places[0] : places[-1] + 1]} & loose
    chosen = [i for i in own if lines[i].region in upper | inside]
    if 2 * sum(len(lines[i].text) for i in chosen if lines[i].mark) >= sum(len(lines[i].text) for i in chosen):
        marks = {lines[i].mark for i in chosen} - {0}
        chosen = [i for i in own if lines[i].mark in marks and (i in chosen or lines[i].region in loose)]
    return chosen


@pytest.mark.parametrize("seed", range(40))
def test_choice_against_plain_loops(seed):
    rng = random.Random(seed)
    lines, region = [], 0
    for _ in range(rng.randrange(1, 60)):
        region = rng.choice([region, region, region, rng.randrange(8)])
        n = rng.choice([1, 5, 20, 300])
        lines.append(html_text.Line("x" * rng.randrange(1, n + 1), rng.randrange(0, 9), region, rng.choice([0, region % 3]), rng.choice([0, 0, n]), rng.random() < 0.2))
    assert html_text.chosen_lines(lines, html_text.line_levels(lines, 1.0)).tolist() == plain_choice(lines)


def test_long_pages_and_clashing_columns(spark):
    big = "<nav>m</nav><article>" + "<p>paragraph of the text</p>" * 100_000 + "</article>"
    pages = spark.createDataFrame([(1, "u", big, "a", "b", 1, "c")], "page_id long, url string, html string, text string, _id string, n_blocks int, ratio string")
    got = html_text.main_text(pages).collect()
    assert got[0].n_blocks == 100_000 and got[0].n_chars == len(got[0].text) == 100_000 * 22 - 1
