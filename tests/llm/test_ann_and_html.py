"""One-bit codes: recall, reranked share and awkward vectors; main text of hand-made pages of unlike styles."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from imprint.llm import domcrf, rabitq


def _search_in_numpy(v, queries, k=10, eps=rabitq.EPS):
    """Both passes over one block: recall and the share of rows that the bounds leave to rerank."""
    centre, turn = v.mean(axis=0), rabitq.rotation(v.shape[1])
    code, norm, ip = rabitq.codes(v, centre, turn)
    block = rabitq.Block(code, norm, ip, eps)
    q_norm, unit = rabitq._units(v[queries], centre, turn, 1.0)
    hits = reranked = inside = 0
    for j, q in enumerate(queries):
        low, high = block.bounds(unit[j], q_norm[j])
        high[q] = np.inf
        some = np.flatnonzero((low <= np.partition(high, k - 1)[k - 1]) & (np.arange(len(v)) != q))
        d = ((v - v[q]) ** 2).sum(axis=1)
        inside += np.mean((low <= d) & (d <= np.where(np.isinf(high), d, high)))
        d[q] = np.inf
        found = some[np.argsort(d[some])[:k]]
        hits += len(set(found.tolist()) & set(np.argsort(d)[:k].tolist()))
        reranked += len(some)
    return hits / (k * len(queries)), reranked / (len(queries) * (len(v) - 1)), inside / len(queries)


@pytest.mark.parametrize("kind", ["clustered", "isotropic"])
def test_bounds_choose_few_rows_and_keep_the_neighbours(kind):
    r = np.random.default_rng(1)
    if kind == "clustered":
        v = r.normal(size=(300, 128))[r.integers(0, 300, 100_000)] + 0.4 * r.normal(size=(100_000, 128))
    else:
        v = r.normal(size=(60_000, 64))
        v /= np.linalg.norm(v, axis=1)[:, None]
    recall, share, inside = _search_in_numpy(v, list(range(0, len(v), len(v) // 25)))
    assert recall >= 0.9 and share < 0.2 and inside > 0.9


def test_search_reports_what_it_reranked(spark):
    r = np.random.default_rng(2)
    v = (r.normal(size=(40, 32))[r.integers(0, 40, 3000)] + 0.3 * r.normal(size=(3000, 32))).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(4)
    rows = rabitq.search(df, F.col("vec_id") % 100 == 0, block_rows=500, query_rows=7).collect()
    hits, v = 0, v.astype(float)
    for q in range(0, 3000, 100):
        d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:10].tolist()) & {x["vec_id"] for x in rows if x["query_id"] == q})
    assert hits >= 0.9 * 300 and len(rows) == 300
    assert sum({x["query_id"]: x["n_reranked"] for x in rows}.values()) < 0.3 * 30 * 2999


def test_awkward_vectors_take_part_or_do_not(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (100, [1e160, 0.0]), (200, [3.0]), (200, [2.0]), (300, [nan]), (400, [0.0, 0.0]), (500, None),
            (600, []), (1, [1e160, 1e150]), (2, [2.0, 0.0]), (3, [2.0, 0.0, 0.0]), (3, [2.0, 0.0, 0.0]), (None, [2.0, 0.0]),
            (4, [inf]), (5, [1.0, None]), (6, [0.0, -7.0])]
    df = spark.createDataFrame([(*x, "c") for x in rows], "vec_id long, embedding array<double>, score string")
    got = {}
    for x in rabitq.search(df, F.col("vec_id") % 100 == 0, k=20).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append((x["vec_id"], x["score"]))
    assert set(got) == {0, 100, 200}  # the others hold nothing that can be compared
    assert [i for i, _ in got[200]][:4] == [2, 3, 3, None] and {s for _, s in got[200][:4]} == {0.0}
    assert len(got[0]) == len(rows) - 6 - 1 - 0 - 0 and dict(got[0])[6] == np.sqrt(1 + 81)
    assert got[100][0] == (1, 1e150) or abs(got[100][0][1] / 1e150 - 1) < 1e-12
    assert all(np.isfinite(s) for found in got.values() for _, s in found)


STORY = [f"Paragraph {i} tells how the river rose over the old bridge, and what the people of the town did then." for i in range(5)]
BODY = "".join(f"<p>{x}</p>" for x in STORY)
SIDE = '<div class="sidebar"><h3>More</h3><ul><li><a href="/a">Other tale</a></li><li><a href="/b">Second tale</a></li></ul></div>'
END = '<footer><p>Copyright of the gazette, all rights reserved.</p></footer>'
NAV = '<nav><ul><li><a href="/">Start</a></li><li><a href="/n">News</a></li><li><a href="/c">Contact</a></li></ul></nav>'
PAGES = {
    "layout in the class": f'<body>{NAV}<div class="content-with-sidebar"><h1>Flood</h1>{BODY}</div>{SIDE}{END}</body>',
    "state of the wrapper": f'<div class="site-content has-sidebar"><article><h1>Flood</h1>{BODY}</article></div>{SIDE}{END}',
    "closed menu": f'<div class="wrap nav-closed">{NAV}<h1>Flood</h1>{BODY}{SIDE}</div>{END}',
    "facts of a post": f'<article class="post tags-hidden category-search"><h1>Flood</h1>{BODY}</article>{SIDE}{END}',
    "page in a form": f'<form id="aspnetForm" action="/">{NAV}<div><h1>Flood</h1>{BODY}</div>{SIDE}{END}</form>',
    "quote in a value": f"{NAV}<div data-x=it's><h1>Flood</h1>{BODY}</div><p class=x>Don't.</p>{END}",
    "quote without end": f'{NAV}<main><h1>Flood</h1>{BODY}</main><p title="abc>{END.replace(chr(34), "")}',
    "names in data attributes": f'{NAV}<div data-id="nav" data-class="menu"><h1>Flood</h1>{BODY}</div>{SIDE}{END}',
    "plain": f"<html><body><h1>Flood</h1>{BODY}</body></html>",
    "main": f"{NAV}<main><h1>Flood</h1>{BODY}</main>{SIDE}{END}",
    "entry-content": f'<div id="page">{NAV}<div class="entry-content"><h2>Flood</h2>{BODY}</div>{SIDE}{END}</div>',
    "section": f'{NAV}<section id="main"><h1>Flood</h1>{BODY}</section>{END}',
    "camel case": f'{NAV}<div class="postBody"><h1>Flood</h1>{BODY}</div><div class="sideBar"><a href="/q">Other tale</a></div>{END}',
    "upper case tags": f"<BODY>{NAV}<DIV CLASS='story'><H1>Flood</H1>{BODY.replace('<p>', '<P>')}</DIV>{END}</BODY>",
    "unclosed paragraphs": f"{NAV}<article><h1>Flood</h1>{BODY.replace('</p>', '')}</article>{SIDE}{END}",
    "comments after": f'<article><h1>Flood</h1>{BODY}</article><div id="comments"><p>I was there, Other tale says it all.</p></div>{END}',
    "scripts between": f"<main><h1>Flood</h1><script>var a='<p>Other tale</p>';</script>{BODY}<style>p{{}}</style></main>{END}",
    "comment between": f"<main><h1>Flood</h1><!-- <p>Other tale</p> -->{BODY}</main>{END}",
    "list in the story": f"<article><h1>Flood</h1>{BODY}<ul><li>One more thing that they did was to build walls.</li></ul></article>{END}",
    "table layout": f'<table><tr><td>{NAV}</td><td><h1>Flood</h1>{BODY}</td></tr></table>{END}',
    "cookie notice": f'<div class="cookie-notice">We use cookies, Other tale.</div><main><h1>Flood</h1>{BODY}</main>{END}',
    "advert inside": f'<article><h1>Flood</h1>{BODY}<div class="advert">Buy the Other tale</div></article>{END}',
    "entities": f"<main><h1>Flood</h1>{BODY.replace(' and ', ' &amp; ')}</main>{END}",
    "role": f'{NAV}<div role="main"><h1>Flood</h1>{BODY}</div><div role="complementary">Other tale</div>{END}',
    "hidden": f'<main><h1>Flood</h1>{BODY}</main><div style="display: none"><p>Other tale is hidden here.</p></div>{END}',
    "newsletter form": f'<main><h1>Flood</h1>{BODY}</main><form class="newsletter"><p>Get the Other tale</p><input></form>{END}',
    "breadcrumbs": f'<ol class="breadcrumbs"><li><a href="/">Other tale</a></li></ol><main><h1>Flood</h1>{BODY}</main>{END}',
    "share bar": f'<main><h1>Flood</h1>{BODY}<div class="share"><ul><li><a href="/s">Other tale</a></li></ul></div></main>{END}',
    "hyphen states": f'<div class="layout nav-left sidebar-hidden">{NAV}<article><h1>Flood</h1>{BODY}</article></div>{END}',
    "truncated": f"{NAV}<article><h1>Flood</h1>{BODY}<p>And the",
    "no markup": " ".join(STORY),
}


@pytest.fixture(scope="module")
def model():
    return domcrf.trained()


@pytest.mark.parametrize("name", sorted(PAGES))
def test_hand_made_pages(name, model):
    text = domcrf.main_text(PAGES[name], model).replace(" & ", " and ")
    words = " ".join(STORY).split()
    kept = sum(len(x.split()) for x in STORY if x in text)
    assert kept > 0.95 * len(words)
    for junk in ("Other tale", "Start", "Contact", "all rights reserved"):
        assert junk not in text
    assert "<p" not in text and "abc>" not in text
