import random

from ontoweave.llm import html_text as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body class="has-sidebar"><header><a href=/>Site</a></header><div class="cookie-notice">We use cookies</div>
<main><header><h1>Head &amp; tail</h1><p>by me</p></header><p>One <b>t</b>wo&nbsp;three<p>four<ul><li>a<li>b</ul><div class="share-buttons">share</div><aside>aside</aside><pre>x
  y</pre><form>search<input name=q></form><table><tr><td>c1<td>c2</table><section id="comments"><article class=comment>bad</article></section></main><footer>foot</footer></body></html>"""


def main(page):
    return H.main_texts([H.blocks(page)])[0][0]


def test_article():
    assert main(PAGE) == "Head & tail One two three four a b x y c1 c2"


def test_odd_markup():
    assert main("<div class=ad>Ad<article><p>Body</p></article>") == "Body"
    assert main("plain <b>te</b>xt 1 < 2 <style>p{}</style> &lt;p&gt;<!-- no <p> -->") == "plain text 1 < 2 <p>"
    assert main("<article><p><b>open<br>next<p>more") == "open next more"
    assert main("<ARTICLE><P STYLE='display: none'>x</P><P hidden>y</P><p>z</p></ARTICLE><p>after") == "z"
    assert main('<article><div class="article-header"><h2>T</h2><p>by</p></div><p>b</p><div class="ad-slot"><h3>Buy</h3></div></article>') == "T b"
    assert main('<div id="content"><p>one</p><div class="sidebar"><ul><li>x</ul></div><p>two</p></div><ol class="commentlist"><li>c</ol>') == "one two"
    assert main("") == main("<html><body><nav>menu</nav></body></html>") == ""
    assert main("<p>" + "w " * 200000) == ("w " * 200000).strip()


def test_names_that_hold_the_article():
    assert main('<div class="entry no-comments"><p>one two</p></div>') == "one two"
    assert main('<a>Skip</a><div class="page has-sidebar"><article><p>the text of this page</p></article></div>') == "the text of this page"
    assert main('<a>Skip</a><div class="sidebar-left layout"><article><p>the text of this page</p></article><div class="ad">Buy</div></div>') == "the text of this page"
    assert main('<div><p>short text</p></div><section id="comments"><article><p>a very long comment of a reader</p></article></section>') == "short text"
    assert main('<div><p>a text that is longer than a teaser</p></div><div class="related"><article>teaser</article></div>') == "a text that is longer than a teaser"


def brute_texts(pages, least_words=8, least_pages=3):
    """Main texts of a host's pages by comparing all windows of all pages."""
    found = [H.blocks(p) for p in pages]
    inside = [[t for t, s in f if s == H.IN_MAIN] for f in found]
    rest = [H._merged(f) for f in found]
    outside = [[(w, s) for t, s in r for w in t.split(" ")] for r in rest]
    keys = [tuple(i) or tuple(r) for i, r in zip(inside, rest)]
    one = [i for i, k in enumerate(keys) if keys.index(k) == i]
    runs = lambda i: {tuple(w for w, _ in outside[i][j : j + least_words]) for j in range(len(outside[i]) - least_words + 1)}
    every = {i: runs(i) for i in one}
    articles = [set(inside[i]) for i in one if inside[i]]
    out = []
    for i in range(len(pages)):
        if inside[i]:
            share = lambda b: sum(b in x for x in articles)
            out.append(" ".join(b for b in inside[i] if len(b.split(" ")) < least_words or share(b) < H.ARTICLE_PAGES or share(b) <= H.ARTICLE_SHARE * len(articles)))
            continue
        hit = [False] * len(outside[i])
        for j in range(len(hit) - least_words + 1):
            run = tuple(w for w, _ in outside[i][j : j + least_words])
            if sum(run in x for x in every.values()) >= least_pages:
                hit[j : j + least_words] = [True] * least_words
        out.append(" ".join(w for (w, s), h in zip(outside[i], hit) if s == H.OPEN and not h))
    return out


def random_pages(r, n, words="abcdefg"):
    run = lambda k: " ".join(r.choice(words) for _ in range(k))
    shared, para = [run(r.randint(8, 12)) for _ in range(4)], [run(r.randint(8, 12)) for _ in range(4)]
    pages = []
    for i in range(n):
        top = f"<nav>{r.choice(shared)}</nav>" if r.random() < 0.5 else ""
        open_ = "".join(f"<div>{r.choice([*shared, run(r.randint(1, 14))])}</div>" for _ in range(r.randint(0, 3)))
        body = "".join(f"<p>{para[0] if r.random() < 0.7 else r.choice([*para, run(r.randint(1, 14))])}</p>" for _ in range(r.randint(1, 3)))
        pages.append(top + open_ + (f"<article>{body}</article>" if r.random() < 0.5 else ""))
    return pages + [pages[0]] * 4 + [""]


def test_texts_of_a_host_against_brute_force():
    r = random.Random(5)
    changed = 0
    for _ in range(12):
        pages = random_pages(r, 25)
        got = [t for t, _ in H.main_texts([H.blocks(p) for p in pages])]
        assert got == brute_texts(pages)
        changed += sum(t != " ".join(x for x, s in H.blocks(p) if s == (H.IN_MAIN if "<article>" in p else H.OPEN)) for t, p in zip(got, pages))
    assert changed > 50


def test_groups_of_a_host_give_the_texts_of_the_whole(spark):
    r = random.Random(6)
    pages = random_pages(r, 120, "abcd")
    frame = spark.createDataFrame([(i, f"http://h/{i}", p, "x") for i, p in enumerate(pages)] + [(3, "http://h/3", pages[3], "x"), (500, "http://b/", pages[1], "x")], "page_id long, url string, html string, key string")
    want = dict(enumerate(brute_texts(pages)))
    for size in (7, 40, 1000):
        got = H.extract(frame, group_pages=size).collect()
        assert len(got) == len(pages) + 2 and all(x["text"] == want[x["page_id"]] for x in got if x["page_id"] < 500), size


def test_a_large_host_gives_the_texts_of_a_small_one(spark):
    menu = "Home News Sports Weather Contact About Imprint Privacy Terms"
    six = [(i, f"http://a/{i}", f"<div>{menu}</div><div>unique{i} text{i} of{i} page{i}</div>") for i in range(6)]
    few = [(i, f"http://a/{i}", f"<div>page {i} of this host</div>") for i in range(6, 8)]
    many = [(i, f"http://a/{i}", f"<div>page {i} of this host</div>") for i in range(6, 5000)]
    texts = lambda rows: {x["page_id"]: x["text"] for x in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).where("page_id < 8").collect()}
    assert texts(six + few) == texts(six + many) == {i: f"unique{i} text{i} of{i} page{i}" if i < 6 else f"page {i} of this host" for i in range(8)}


def test_hosts(spark):
    menu = "Home News Sports Weather Contact About Imprint Privacy Terms"
    rows = [(i, f"http://www.a.org/{i}", f"<div>{menu}</div><div>unique{i} text{i} of{i} page{i}</div>") for i in range(8)]
    rows += [(20, "http://a.org/x", PAGE), (21, None, None), (22, "http://b.org", f"<p>{menu}</p>"), (20, "http://a.org/x", PAGE), (None, "odd url", "<p>kept</p>")]
    frame = spark.createDataFrame([(*x, "c") for x in rows], "page_id long, url string, html string, text string")
    got = [(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in H.extract(frame).collect()]
    assert len(got) == len(rows)
    text = {i: t for i, _, t, _ in got}
    assert text[3] == "unique3 text3 of3 page3" and text[20].startswith("Head & tail") and text[21] == "" and text[22] == menu and text[None] == "kept"
    assert all(n == len(t) for _, _, t, n in got)
    assert H.extract(frame.limit(0)).count() == 0


def test_articles_keep_what_repeats(spark):
    para = "this passage stands in the articles of very many pages of one host and stays"
    rows = [(i, "http://a/", f"<nav>menu of all the pages here is one long menu</nav><article><p>{para if i < 5 else i}</p><p>p{i}</p></article>") for i in range(10)]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r["text"] == f"{para if r['page_id'] < 5 else r['page_id']} p{r['page_id']}" and r["n_repeated"] == 10 for r in got)


def test_a_block_of_most_articles_is_a_template(spark):
    note = "get the news of this paper every morning into your box for free"
    rows = [(i, "http://a/", f"<article><p>p{i} of the articles</p><p>{note}</p></article>") for i in range(7)] + [(7, "http://a/", "<article><p>alone</p></article>"), (8, "http://b/", f"<article><p>{note}</p></article>")]
    got = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"p{i} of the articles" for i in range(7)} | {7: "alone", 8: note}
