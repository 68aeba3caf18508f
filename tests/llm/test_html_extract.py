from __future__ import annotations

import html as H
import itertools
import random
import re
import resource

import numpy as np
import pytest

from lexispark.llm import html_extract as X

LONG = "The council met on Tuesday, and after a long debate it agreed to rebuild the old bridge over the river."
MORE = "Work will begin in spring, the mayor said, and the road stays open for most of the year; costs are shared."


def page(body):
    return f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>";</script></head><body>{body}</body></html>'


def test_semantic_page():
    body = f"""<header><h1>Site</h1></header><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav>
      <!-- <p>no</p> --><div class="cookie-notice"><p>We use cookies.</p></div><div class="ad">Buy now</div>
      <article><header><h1>Bridge &amp; river</h1></header><p>{LONG}<br>  Next&nbsp;line <b>bold<p>{MORE}</p>
      <aside>Related: x</aside><form><label>Mail</label><input></form>
      <section class="comments"><p>I like this very much, thanks a lot for writing it.</p></section></article>
      <div id="sidebar"><p>Most read</p></div><footer>&copy; Site</footer>"""
    assert X.extract(page(body)).split("\n") == ["Bridge & river", f"{LONG} Next line bold", MORE]


def test_page_without_semantic_tags_is_labelled_by_the_cut():
    links = "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(8))
    body = f"<div><ul>{links}</ul></div><div><div><p>{LONG}</p><p>Short one.</p><p>{MORE}</p></div></div><div><a href=/x>Home</a> <a href=/y>About</a></div>"
    assert X.extract(page(body)).split("\n") == [LONG, "Short one.", MORE]


def test_broken_and_odd_markup():
    assert X.extract(None) == X.extract("") == X.extract("<script>alert('x')") == X.extract("<!-- " + LONG) == ""
    assert X.extract(f"<article><p>{LONG}") == LONG
    assert X.extract(f"<article><p>a &lt; b &#233; &unknown; {LONG}</article>") == f"a < b é &unknown; {LONG}"
    assert X.extract(f"<article><p hidden>{MORE}</p><p>{LONG}</p><p style='display: none'>{MORE}</p></article>") == LONG
    assert X.extract(f"<article>{LONG}<div>{MORE}</div>tail of it.</article>").split("\n") == [LONG, MORE, "tail of it."]
    deep = "<div>" * 2000 + f"<article><p>{LONG}</p></article>"
    assert X.extract(deep) == LONG


def brute_cut(z, edges):
    """Cheapest labelling by trying all: costs of content softplus(-z), of the other softplus(z)."""
    best = None
    for labels in itertools.product([False, True], repeat=len(z)):
        cost = sum(max(0.0, -a) if on else max(0.0, a) for a, on in zip(z, labels, strict=True))
        cost += sum(w for (i, j), w in edges.items() if labels[i] != labels[j])
        if best is None or cost < best - 1e-9:
            best = cost
    return best


def cost_of(z, edges, labels):
    return sum(max(0.0, -a) if on else max(0.0, a) for a, on in zip(z, labels, strict=True)) + sum(w for (i, j), w in edges.items() if labels[i] != labels[j])


def test_cut_is_the_cheapest_labelling():
    rng = random.Random(6)
    for _ in range(150):
        n = rng.randrange(1, 9)
        z = np.array([rng.choice([-3, -1, -0.4, 0.0, 0.3, 1, 2.5]) for _ in range(n)])
        edges = {(i, j): rng.choice([0.2, 0.5, 1.0, 2.0]) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}
        assert cost_of(z, edges, X.minimum_cut(z, edges)) == pytest.approx(brute_cut(z, edges))


def test_cut_of_many_undecided_blocks_ends():
    n = 4000
    z = np.array([0.3 if i % 3 else -0.5 for i in range(n)])
    edges = {(i, i + 1): 0.7 for i in range(n - 1)}
    labels = X.minimum_cut(z, edges)
    assert len(labels) == n


def test_fit_learns_from_semantic_tags():
    pages = [page(f"<nav>{''.join(f'<li><a href=/{i}>Go {i}</a>' for i in range(6))}</nav><article><p>{LONG}</p><p>{MORE}</p></article>") for _ in range(5)]
    w = X.fit(pages)
    found = X.blocks(pages[0])
    z = X.features(found) @ w
    assert all((a > 0) == (b.evidence > 0) for a, b in zip(z, found, strict=True))
    assert X.fit([]) is X.DEFAULT_WEIGHTS


def test_query_on_whole_table(spark, sf_dir):
    from lexispark.llm.queries_pages import op4_html_extract

    got = {r.page_id: r for r in op4_html_extract(spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(H.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert got[r.page_id].text == "\n".join(x for x in parts if x)
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def article_parts(source):
    article = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    parts = [" ".join(H.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
    return [x for x in parts if x]


def sources(spark, sf_dir):
    return [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect()]


def neutral(source):
    """The page without tags and classes that say what a block is."""
    return re.sub(r' class="[^"]*"', "", re.sub(r"<(/?)(article|nav|footer|ul|li|h1)\b", r"<\1div", source))


def test_pages_without_semantic_names(spark):
    pages = sources(spark, "/root/testdata/sf0.01")
    weights = X.fit(pages)
    kept = whole = found = 0
    for source in pages:
        bare = neutral(source)
        assert not any(b.evidence for b in X.blocks(bare))
        got, want = set(X.extract(bare, weights).split("\n")), article_parts(source)
        kept += sum(len(x) for x in want if x in got)
        whole += sum(map(len, want))
        found += sum(map(len, got))
    assert kept >= 0.95 * whole and kept >= 0.95 * found


def test_the_cut_beats_the_signs_on_noisy_pages(spark):
    # short lines inside the article, a sentence in the menu, and no tag or class that tells them apart
    pages, rng = sources(spark, "/root/testdata/sf0.01"), random.Random(3)
    weights = X.fit(pages)
    cut = signs = right = wrong = 0
    for source in pages:
        short = lambda m: f"</p><p>{rng.choice(['Anna', '12 31', 'Photo', 'Part two', 'M. L.'])}</p><p>" if rng.random() < 0.4 else m[0]
        before, rest = source.split("<article>", 1)
        article, after = rest.split("</article>", 1)
        noisy = before.replace("</li><li>", "</li><li>All of the news of the day, and more than that.</li><li>", 1) + "<article>" + re.sub("</p><p>", short, article) + "</article>" + after
        want, bare = article_parts(noisy), neutral(noisy)
        found = X.blocks(bare)
        z = X.log_odds(X.features(found), weights)
        labels, own = X.minimum_cut(z, X.smoothness(found)), z > 0
        assert X.extract(bare, weights) == "\n".join(b.text for b, on in zip(found, labels, strict=True) if on)
        cut += [b.text for b, on in zip(found, labels, strict=True) if on] == want
        signs += [b.text for b, on in zip(found, own, strict=True) if on] == want
        for b, on, sign in zip(found, labels, own, strict=True):
            if on != sign:
                right, wrong = right + ((b.text in want) == on), wrong + ((b.text in want) != on)
    assert right >= 10 and right > 3 * wrong
    assert cut > signs and cut >= 0.95 * len(pages)


def test_a_clear_text_outweighs_a_cue(spark):
    weights = X.fit(sources(spark, "/root/testdata/sf0.01"))
    assert abs(weights[-X.CUES :]).max() < X.TEXT_LIMIT
    source = page(f'<article><h1>{LONG}</h1><p>{LONG}</p><p>{MORE}</p></article><div class="story"><a href=/x>Go</a></div>')
    found = X.blocks(source)
    assert found[-1].evidence > 0 > X.log_odds(X.features(found), weights)[-1]
    assert X.extract(source, weights) == "\n".join([LONG, LONG, MORE])


def test_boilerplate_inside_the_article_and_the_flow(spark, monkeypatch):
    pages = sources(spark, "/root/testdata/sf0.01")
    weights, cut = X.fit(pages), []
    flow = X._source_side
    monkeypatch.setattr(X, "_source_side", lambda group, *rest: cut.append(len(group)) or flow(group, *rest))
    extra = '<section class="comments"><p>I like this one, really. Thanks a lot, it was good to read.</p></section><form><p>Write to us, please.</p></form></article>'
    for source in pages:
        inner = source.replace("</p><p>", '</p><div class="ad">Buy these now, they are very good and cheap.</div><p>', 1).replace("</article>", extra)
        assert X.extract(inner, weights).split("\n") == X.extract(source, weights).split("\n") == article_parts(source)
    assert len(cut) >= 2 * len(pages)  # the maximum flow decides on every page


def test_a_block_takes_the_label_of_its_surroundings():
    # a name and a line of numbers among paragraphs; a sentence among links
    body = f"<div><p>{LONG}</p><p>{MORE}</p><p>Anna</p><p>{LONG}</p><p>12 31</p><p>{MORE}</p></div><div>" + "<p><a href=/x>Go there</a></p>" * 6 + "<p>Or here.</p>" + "<p><a href=/x>Go there</a></p>" * 6 + "</div>"
    assert X.extract(page(body)).split("\n") == [LONG, MORE, "Anna", LONG, "12 31", MORE]
    found = X.blocks(page(body))
    own = X.log_odds(X.features(found), X.DEFAULT_WEIGHTS)
    assert own[2] < 0 < own[12]  # against what they say of themselves


def test_deep_nesting_takes_time_and_memory_that_follow_the_page():
    n, before = 50_000, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for source in ("<div>x y. " * n, "<div>" * n + "z</b></i></p>" * n, "<b><a><i>" * n + "<p>t</b></a>" * n, "<ul><li>" * n + "<table><tr><td>q" * 1000):
        X.extract(source + f"<article><p>{LONG}</p></article>")
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300 << 10


def test_distance_is_counted_by_the_common_parent():
    found = X.blocks("<div><div><p>a</p></div><div><ul><li>b</li></ul></div>c</div>d")
    assert [X._apart(a.home, b.home) for a, b in itertools.pairwise(found)] == [5, 3, 1]


def test_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (2, None, ""), (None, "u", f"<article><p>{LONG}</p>"), (3, "u", "<article>" + f"<p>{LONG}</p>" * 3000)]
    pages = spark.createDataFrame([(*r, "x", 1, 2, 3, 4, 5, 6) for r in rows], "page_id bigint, url string, html string, text string, n_chars int, _key int, k int, u int, h int, x int")
    got = sorted((str(r.page_id), r.n_chars) for r in X.extract_pages(pages, X.fit_from_table(pages)).collect())
    assert got == [("1", 0), ("2", 0), ("2", 0), ("3", 3000 * (len(LONG) + 1) - 1), ("None", len(LONG))]
    assert X.extract_pages(pages.limit(0), X.fit_from_table(pages.limit(0))).count() == 0
