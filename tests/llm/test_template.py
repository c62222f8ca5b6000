"""Template deduction against a plain one, odd markup, long pages, and hosts whose names say nothing."""

import itertools
import random
import time

import numpy as np
import pytest

from tessera.llm import html, markup


def plain_classes(pages):
    """The same definition with dictionaries and loops, over lists of tokens."""
    vectors = {t: tuple(p.count(t) for p in pages) for p in pages for t in p}
    often = [t for t, v in vectors.items() if sum(map(bool, v)) >= max(html.MIN_PAGES, html.SUPPORT * len(pages))]
    groups = [[t for t in often if vectors[t] == v] for v in {vectors[t] for t in often}]
    groups = sorted((sorted(g) for g in groups if len(g) >= html.LEAST), key=lambda g: (-sum(map(bool, vectors[g[0]])), -len(g), g[0]))

    def order(group):
        found = None
        for p in pages:
            seq = [t for t in p if t in group]
            found = found or seq[: len(group)]
            if seq != found * (len(seq) // len(group)) or len(set(found)) < len(found):
                return None
        return found

    def gaps(inner, outer):
        """Each cycle of inner as the gaps of outer that its tokens are in."""
        for p in pages:
            if any(t in outer for t in p):
                seen, cycle, whole = 0, [], sum(t in outer for t in p)
                for t in p:
                    if t in outer:
                        seen += 1
                    elif t in inner:
                        cycle.append((seen, "before" if seen == 0 else "after" if seen == whole else seen % len(outer)))
                        if len(cycle) == len(inner):
                            yield cycle
                            cycle = []

    def one_gap(inner, outer):
        cycles = list(gaps(inner, outer))
        return all(len({k for k, _ in c}) == 1 for c in cycles) and len({c[0][1] for c in cycles}) <= 1

    kept = []
    for g in groups:
        o = order(g)
        if o and all(one_gap(o, k) or one_gap(k, o) for k in kept):
            kept.append(o)
    return kept


@pytest.mark.parametrize("seed", range(12))
def test_classes_as_the_plain_deduction(seed):
    rng = random.Random(seed)
    pages = []
    for _ in range(rng.randint(6, 12)):
        page = [0, 1]
        for _ in range(rng.randint(0, 3)):  # a list, sometimes out of order
            page += [2, 3, rng.randint(100, 120), 4]
            if rng.random() < 0.03:
                page[-1], page[-2] = page[-2], page[-1]
        page += [5, 6, *(rng.randint(100, 120) for _ in range(rng.randint(0, 9))), 7, 8]
        if rng.random() < 0.9:
            page += [9, rng.choice([10, 100]), 11, 12]
        if rng.random() < 0.3:
            page.insert(rng.randint(0, len(page)), 5)
        pages.append(page)
    pages = [list(p) for p in dict.fromkeys(map(tuple, pages))]
    got = [o for o, _ in html.Pages([np.array(p, np.int64) for p in pages]).nested()]
    assert got == plain_classes(pages) and (seed or got)


def test_crossing_classes_do_not_nest():
    a, b = [0, 1, 2], [3, 4, 5]
    apart, crossed = [[*a, *b]] * 6, [[0, 3, 1, 4, 2, 5], *[[*a, *b]] * 5]
    distinct = lambda pages: [np.array([*p, 50 + k], np.int64) for k, p in enumerate(pages)]
    assert len(html.Pages(distinct(apart)).nested()) == 1  # equal vectors, one class
    more = [p + a for p in crossed]  # a twice a page, b once: two classes
    assert [o for o, _ in html.Pages(distinct(more)).nested()] == [a]


@pytest.fixture
def without_names(monkeypatch):
    """No rule of names is left: what is found comes from the template."""
    for what in ("ROLES", "NAMES", "ARTICLES"):
        monkeypatch.setattr(markup, what, frozenset())
    monkeypatch.setattr(markup, "BOILERPLATE", frozenset(["head", "title"]))


def page(k, words):
    menu = "".join(f"<li><a href=/{w}>{w}</a></li>" for w in words[: 2 + k % 4])
    story = "".join(f"<p>{' '.join(words[j:])} {j}" for j in range(3))
    return f"<html><head><title>{words[0]}</title></head><body><div class=x1><ul>{menu}</ul></div><div class=x2>Today {words[1]}</div><div class=x3><h1>{words[2]} {k}</h1>{story}</div><div class=x4>&copy; host &middot; {words[3]}</div></body></html>"


def test_slots_give_the_text_without_names(without_names):
    rng = random.Random(1)
    words = [[f"w{rng.randint(0, 400)}" for _ in range(20)] for _ in range(9)]
    got = html.texts_of([page(k, w) for k, w in enumerate(words)], True)
    assert got == ["\n".join([f"{w[2]} {k}", *(f"{' '.join(w[j:])} {j}" for j in range(3))]) for k, w in enumerate(words)]
    tokens = html.Tokens()
    template = html.deduce([tokens.page(page(k, w)).tokens for k, w in enumerate(words)], tokens)
    assert {len(c) for c in template.classes} >= {4} and max(map(len, template.classes)) >= 15  # list entries, and the page with ©, host and ·


def test_hosts_of_the_test_table_without_names(without_names, spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").toPandas()
    rows["host"] = rows.url.str.extract(r"://(?:[^/?#@]*@)?([^/?#:]+)")[0]
    for _, g in rows.groupby("host"):
        if len(g) >= 12:
            for h, text in zip(g.html, html.texts_of(g.html.tolist(), True)):
                inner = h[h.index("<article>") : h.index("</article>")]
                assert text == html.texts_of([inner], False)[0]


@pytest.mark.parametrize("text, want", [
    ("<p title=it's>Hello</p><p>don't</p>", "Hello\ndon't"), ('<p class="x>bad</p>', "bad"), ("<p a='b>c'>d", "d"), ("a < b <3 </ c>", "a < b <3"), ("<p x = 'y'z=1>t", "t"),
    ("<div class=related-work>Hi</div>", "Hi"), ("<div class=related-posts>Hi</div>x", "x"), ("<noscript>a<p>b", "a\nb"), ("<!-- x --><p>y<!-- z", "y"), ("<script/>x</script>y", "y"), ("<![CDATA[x]]>y<![CDATA[z", "y"), ("&eacute;&amp;lt; &#x41;", "é&lt; A"),
])
def test_odd_markup(text, want):
    assert html.texts_of([text], False) == [want]


@pytest.mark.parametrize("part", ["<a '", '<a x="', "<", "<!--", "<b ", "<svg>", "</x", "<div a=1 ", "<b>", "<p><i>", "<li><b>", "&#", '<a x="y\'', "<div>"])
def test_long_odd_pages_take_linear_time(part):
    took = []
    for n in (60_000, 240_000):
        began = time.process_time()
        html.texts_of([part * (n // len(part)) + "<div></div>" * 2000], False)
        took.append(time.process_time() - began)
    assert took[1] < 1 + 10 * took[0]


def test_hosts_are_dealt_into_groups(spark, monkeypatch):
    monkeypatch.setattr(html, "GROUP", 20)
    words = [[f"w{k}{j}" for j in range(20)] for k in range(45)]
    rows = [(k, f"http://a.example/{k}", page(k, w).replace("x3", "card"), "x") for k, w in enumerate(words)]
    rows += [(None, None, None, "x"), (7, None, "<p>n", "x"), (8, "http://b.example", "", "x")] + [(9, "http://c.example/", "<p>same", "x")] * 3
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, deal string").repartition(5))
    assert got.columns == ["page_id", "url", "text"]
    texts = {r.url: r.text for r in got.collect()}
    assert all(texts[f"http://a.example/{k}"].startswith(f"{w[2]} {k}\n") and "©" not in texts[f"http://a.example/{k}"] for k, w in enumerate(words))
    assert texts["http://b.example"] == "" and texts["http://c.example/"] == "same"
    assert got.filter("url is null").count() == 2 and got.count() == len(rows)


def test_very_long_page(spark):
    long = "<body><div class=menu>m</div><article>" + "".join(f"<p>{k} {'word ' * 40}" for k in range(20_000)) + "</article>"
    got = html.extract(spark.createDataFrame([(1, "http://a.example", long)], "page_id long, url string, html string")).first().text
    assert got.count("\n") == 19_999 and got.startswith("0 word") and not list(itertools.islice((c for c in got if c in "<>m"), 1))
