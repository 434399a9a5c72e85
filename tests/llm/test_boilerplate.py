import random
import re
from html import unescape

import numpy as np
import pytest

from strandline.llm import boilerplate
from strandline.llm.boilerplate import ARTICLE, GONE, OPEN, blocks_of, extract, main_texts, op11_html_extraction, repeated


def brute_repeated(pages, least):
    """Every window of every page against every other page."""
    windows = [{tuple(p[i : i + least]) for i in range(len(p) - least + 1)} for p in pages]
    out = []
    for k, p in enumerate(pages):
        hit = [False] * len(p)
        for i in range(len(p) - least + 1):
            if any(tuple(p[i : i + least]) in w for j, w in enumerate(windows) if j != k):
                hit[i : i + least] = [True] * least
        out += hit
    return out


@pytest.mark.parametrize("least", [1, 2, 3, 5, 12])
def test_repeats_against_brute_force(least):
    r = random.Random(least)
    for _ in range(30):
        pages = [[r.randrange(r.choice([1, 2, 3])) for _ in range(r.choice([0, 1, 4, 30]))] for _ in range(r.randrange(1, 6))]
        shared = [7, 8, 9, 7, 8, 9] * 3
        pages = [p + shared * (r.random() < 0.5) + p[:3] for p in pages]
        tokens = np.array([t for p in pages for t in p], np.int64)
        page = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
        assert repeated(tokens, page, least).tolist() == brute_repeated(pages, least)


def places(page):
    return [(b.place, b.text) for b in blocks_of(page)]


def test_markup():
    page = """<!DOCTYPE html><html><head><title>No &lt;p></title><style>p{}</style><script>var t="</p><article>x";</script></head><body class="has-sidebar">
    <div id="topMenu">menu</div><!-- <p>hidden --> <article class=post><header><h1>Head&nbsp;line</h1> by me</header><p>One <b>bo<i>ld</b>\n text<br>two<p class="ad">buy<p>Three &amp; four &copy 5 &am; a < b
    <ul><li>x<li class='share-links'>tweet<li>y</ul><aside>side</aside><form><p>name</form><table><tr><td>c1<td>c2</table><div class="comments"><article>reader</article></div><p hidden>no</p>end</article>
    <footer>foot</footer></body>"""
    assert places(page) == [
        (GONE, "menu"), (ARTICLE, "Head line"), (GONE, "by me"), (ARTICLE, "One bold text two"), (GONE, "buy"), (ARTICLE, "Three & four © 5 &am; a < b"),
        (ARTICLE, "x"), (GONE, "tweet"), (ARTICLE, "y"), (GONE, "side"), (GONE, "name"), (ARTICLE, "c1"), (ARTICLE, "c2"), (GONE, "reader"), (GONE, "no"), (ARTICLE, "end"), (GONE, "foot"),
    ]
    assert places("<aside><article>teaser</article></aside><div class=sidebar-left><main>real</main></div>") == [(GONE, "teaser"), (ARTICLE, "real")]
    assert places("plain <b>text") == [(OPEN, "plain text")] and places("<p>cut <scr") == [(OPEN, "cut <scr")] and places("<p>a<script>b") == [(OPEN, "a")] and places("<p>x<!-- open") == [(OPEN, "x")]
    assert places("") == [] and places("</p></div>a</article>") == [(OPEN, "a")]
    assert places('<p title="a>b">c</p>') == [(OPEN, "c")]


def test_deep_and_long_pages():
    deep = "<div>" * 20_000 + "in" + "<b>" * 20_000 + "</i>" * 20_000 + " x" + "</div>" * 20_000
    assert [t for _, t in places(deep)] == ["in x"]
    long = "<article>" + "<p>w" * 100_000 + "</article>"
    assert extract([long])[0].text == "\n".join(["w"] * 100_000)


MENU = "<div>home news sport weather about us contact help legal terms privacy jobs press</div>"


def unmarked(k):
    r = random.Random(k)
    return f"{MENU}<div><h2>{r.random()}</h2><p>{' '.join(str(r.random()) for _ in range(30))}</p></div><div>all rights are reserved by the owner of this site since 1999 until now</div>"


def test_repeats_decide_unmarked_pages():
    pages = [unmarked(k) for k in range(5)]
    found = extract(pages)
    for page, f in zip(pages, found, strict=True):
        assert f.text == "\n".join(re.findall(r"<h2>(.*?)</h2><p>(.*?)</p>", page)[0])
        assert f.covered >= 14 + 15 and f.tokens == 14 + 15 + 2 + 31
    # alone, nothing is known to be furniture; equal pages are one page
    assert extract(pages[:1])[0].text.startswith("home news") and extract(pages[:1] * 3)[2].text.startswith("home news")
    # a copy with one word changed keeps its text
    near = pages[0].replace("<p>", "<p>changed ")
    assert extract([pages[0], near])[1].text.count("\n") == 3
    # without coverage the answer is another
    assert extract(pages)[0] != extract(pages[:1])[0]


def test_articles_on_several_pages_stay(spark):
    article = "<article><h1>T</h1><p>" + " ".join(f"w{i}" for i in range(60)) + "</p></article>"
    rows = [(i, "http://a.b/x" if i < 4 else None, MENU + article + f"<footer>{i}</footer>") for i in range(8)] + [(9, "u", None), (10, "http://a.b/", ""), (10, "http://a.b/", "")]
    df = spark.createDataFrame([(i, u, h, "n") for i, u, h in rows], "page_id long, url string, html string, host string")
    got = {(r.page_id, r.url): r for r in main_texts(df).collect()}
    want = "T\n" + " ".join(f"w{i}" for i in range(60))
    for i, u, h in rows:
        r = got[i, u]
        assert (r.text, r.n_chars) == ((want, len(want)) if h else ("", 0))
    assert main_texts(df).count() == 11 and main_texts(df.limit(0)).count() == 0
    assert got[0, "http://a.b/x"].n_repeated == 14 + 2 + 61 + 1


def test_query_against_the_tables_markup(spark, sf_dir):
    rows = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = {r.page_id: r for r in op11_html_extraction(spark, sf_dir).collect()}
    assert set(got) == set(rows)
    for i, r in rows.items():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = (" ".join(unescape(re.sub(r"<[^>]*>", " " if "br" in b else "", b)).split()) for b in re.split(r"</?p>|</?h1>", article))
        blocks = [b for b in blocks if b]
        assert got[i].text == "\n".join(blocks) and got[i].n_chars == len(got[i].text) and got[i].url == r.url


def test_large_hosts_in_stretches(monkeypatch, spark):
    monkeypatch.setattr(boilerplate, "GROUP_CHARS", 2000)
    import pyarrow as pa

    pages = [unmarked(k) for k in range(40)]
    batch = pa.record_batch([pa.array(["h"] * 40), pa.array([0] * 40), pa.array(range(40), pa.int64()), pa.array(["http://h"] * 40), pa.array(pages)], names=["host", "part", "page_id", "url", "html"])
    out = pa.Table.from_batches(boilerplate._by_host(iter([batch])))
    assert out.column("page_id").to_pylist() == list(range(40))
    assert not any("home news" in t or "rights" in t for t in out.column("text").to_pylist())
    monkeypatch.setattr(boilerplate, "GROUP_CHARS", 10_000)  # four parts
    df = spark.createDataFrame([(k, "http://h", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    found = {r.page_id: r.text for r in main_texts(df).collect()}
    assert len(found) == 40 and not any("home news" in t or "rights" in t for t in found.values())


def test_size_of_parts_moves_no_result(monkeypatch, spark):
    """Blocks on two of a host's pages go wherever the pages are dealt; copies and pages with one article count by their texts."""
    notice = ["<p>" + " ".join(f"n{k // 2}x{i}" for i in range(20)) + "</p>" for k in range(60)]
    pages = [unmarked(k).replace("<div><h2>", f"<div>{notice[k]}</div><div><h2>") for k in range(60)]
    pages += [pages[3], pages[3], pages[7] + "<p>end", "", f"<article>{notice[9]}</article>", "<p>" + " ".join(map(str, range(11)))]
    rows = [(k, f"http://H/{k}", p) for k, p in enumerate(pages)] + [(900, "http://other/", pages[0]), (901, None, pages[1])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    want = dict(enumerate(extract(pages))) | {900: extract(pages[:1])[0], 901: extract(pages[1:2])[0]}
    assert not any("n1x" in f.text for f in want.values()) and "n0x" in want[900].text
    for chars in (1 << 20, 10_000, 2000):
        monkeypatch.setattr(boilerplate, "GROUP_CHARS", chars)
        got = {r.page_id: (r.text, r.n_tokens, r.n_repeated) for r in main_texts(df).collect()}
        assert got == {k: (f.text, f.tokens, f.covered) for k, f in want.items()}


def test_stretches_tell_each_other_what_they_share():
    pages = {k: blocks_of(unmarked(k)) for k in range(6)}
    pages[0] += [(OPEN, "p", " ".join(map(str, range(40))))]
    pages[5] += [(OPEN, "p", " ".join(map(str, range(13))))]
    pages = {k: [boilerplate.Block(*b) for b in blocks] for k, blocks in pages.items()}
    one, two = boilerplate.Stretch({k: pages[k] for k in (0, 1)}), boilerplate.Stretch({k: pages[k] for k in (3, 5)})
    shared = np.intersect1d(one.anchors, two.anchors)
    keys = np.intersect1d(one.distinct(shared)[0], two.distinct(shared)[0])
    assert set(keys) == set(np.intersect1d(one.windows, two.windows)) and len(keys)
    whole = boilerplate.Stretch({k: pages[k] for k in (0, 1, 3, 5)}).found(boilerplate.NONE)
    assert one.found(keys) | two.found(keys) == whole


def shuffled(spark):
    """Bytes of shuffles that all stages so far wrote."""
    jvm = spark.sparkContext._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_what_stretches_tell_is_small_beside_the_pages(monkeypatch, spark):
    monkeypatch.setattr(boilerplate, "GROUP_CHARS", 100_000)  # some 20 parts, each sharing a fifth of its text with others
    r = random.Random(1)
    vocabulary = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randrange(2, 9))) for _ in range(20_000)]
    passages = [" ".join(r.choices(vocabulary, k=80)) for _ in range(300)]
    pages = [f"<p>{' '.join(r.choices(vocabulary, k=320))}<p>{r.choice(passages)}" for _ in range(900)]
    df = spark.createDataFrame([(k, "http://h", p) for k, p in enumerate(pages)], "page_id long, url string, html string").coalesce(1)
    before = shuffled(spark)
    found = {row.page_id: (row.text, row.n_repeated) for row in main_texts(df).collect()}
    packed = sum(len(b) for batch in boilerplate._read(iter(df.selectExpr("'h' host", "*").toArrow().to_batches())) for b in batch.column("blocks").to_pylist())
    assert (shuffled(spark) - before) / packed < 2.2  # 2.7 with a row for each key
    assert found == {k: (f.text, f.covered) for k, f in enumerate(extract(pages))}


def test_copies_over_all_parts_are_one_page(monkeypatch, spark):
    pages = [unmarked(k) for k in range(30)] + [f"<p>{' '.join(f'c{i}' for i in range(60))}</p>"] * 40 + [f"<p>{' '.join(f'd{i}' for i in range(60))}<p>{k % 2}</p>" for k in range(40)]
    df = spark.createDataFrame([(k, "http://h", p) for k, p in enumerate(pages)], "page_id long, url string, html string").repartition(3)
    want = {k: (f.text, f.tokens, f.covered) for k, f in enumerate(extract(pages))}
    assert want[35][2] == 0 and want[75][2] == 62
    for chars in (20_000, 3000, 300):
        monkeypatch.setattr(boilerplate, "GROUP_CHARS", chars)
        monkeypatch.setattr(boilerplate, "MEETING", 2)
        assert {r.page_id: (r.text, r.n_tokens, r.n_repeated) for r in main_texts(df).collect()} == want


def test_pages_at_home_are_counted():
    pages = {k: [boilerplate.Block(OPEN, "p", " ".join(map(str, range(lo, hi))))] for k, (lo, hi) in enumerate([(0, 30), (10, 40), (20, 50), (90, 120)])}
    stretch = boilerplate.Stretch(pages, lambda k: k in (1, 2))
    keys, counts = stretch.distinct(stretch.anchors)
    of = dict(zip(keys.tolist(), counts.tolist(), strict=True))
    at = {k: [of[w] for w, s in zip(stretch.windows.tolist(), stretch.starts.tolist(), strict=True) if stretch.page[s] == k] for k in pages}
    # each page's first window has the mark of its block
    assert at[0] == [0] * 11 + [1] * 9 and at[1] == [1] * 11 + [2] * 9 and at[2] == [1] + [2] * 9 + [1] * 10 and at[3] == [0] * 20


def test_packed_keys():
    r = np.random.default_rng(1)
    full = np.sort(np.concatenate([r.integers(-(1 << 63), (1 << 63) - 1, 5000), [-(1 << 63), (1 << 63) - 1, 0]]))
    for keys in (full, full[:1], full[:0], np.unique(full & -(1 << 24))):
        assert boilerplate._unpacked(boilerplate._packed(keys)).tolist() == keys.tolist()
    assert len(boilerplate._packed(np.unique(r.integers(-(1 << 63), (1 << 63) - 1, 40_000) & -(1 << 24)))) < 40_000 * 4
