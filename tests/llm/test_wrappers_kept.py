"""Article text that looks like the host's own: copies of one page, links in an article, layout classes."""

import random

from sedgewren.llm import queries, wrappers


def test_article_text_is_kept(spark):
    rows, want = [], []
    for i in range(6):
        rows.append((f"https://copies.example/{i}", "<div><p>one story</p><blockquote>said so</blockquote></div>"))
        want.append("one story\nsaid so")
    for i in range(6):
        rows.append((f"https://links.example/{i}", f"<article><p>story {i}</p><ul><li><a href=1>source {i}</a></li></ul></article>"))
        want.append(f"story {i}\nsource {i}")
    for i, c in enumerate(("has-sidebar", "post no-comments", "with_menu")):
        rows.append((f"https://layout{i}.example/", f'<div class="{c}"><p>told {i}</p><div class="site-footer">by us</div></div>'))
        want.append(f"told {i}")
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrappers.main_text(df).collect()}
    assert [got[i] for i in range(len(rows))] == want


def bare(rng, i):
    """A host without a single class: only the same text on all pages tells its menu and footer from the story."""
    say = lambda k: " ".join(rng.choice("ab bc cd de ef fg gh hi".split()) for _ in range(k))
    story = [say(rng.randint(4, 20)) for _ in range(rng.randint(1, 3))]
    body = "".join(f"<div>{x}</div>" for x in story)
    return f"<div>House of words</div><div><b>since 1900</b></div>{body}<div>All rights reserved</div>", "\n".join(story)


def test_only_the_wrapper_tells():
    rng = random.Random(3)
    pages = [bare(rng, i) for i in range(12)]
    made = None
    for html, _ in pages:
        one = wrappers.folded(wrappers.tree([b.path for b in wrappers.blocks(html)])[0])
        made = one if made is None else wrappers.aligned(made, one)
    read = wrappers.Filled()
    ignored = [wrappers.main_of([(0, b) for b in wrappers.blocks(h)], frozenset()) for h, _ in pages]
    said: dict = {}
    for html, _ in pages:
        for slot, b in read.blocks(html, wrappers.dumped(made)):
            said.setdefault(slot, set()).add(b.text)
    drop = frozenset(s for s, x in said.items() if len(x) == 1)
    got = [wrappers.main_of(read.blocks(h, wrappers.dumped(made)), drop) for h, _ in pages]
    assert got == [truth for _, truth in pages] and all(a != b for a, b in zip(got, ignored, strict=True))


def test_query_over_pages(spark, tmp_path):
    """The query on a table of its own, against texts that are known."""
    rng, rows, want = random.Random(8), [], []
    add = lambda url, html, text: (rows.append((len(rows), url, html)), want.append(text))
    for i in range(10):
        add(f"https://bare.example/{i}", *bare(rng, i))
    long = "column-of-a-layout-that-was-named-with-very-many-words-in-one-class-"
    for i in range(6):
        add(f"https://long.example/{i}", f'<div class="{long}menu-entries"><a href=1>go</a> <a href=2>on</a></div><div class="{long}story-body">told {i}</div>', f"told {i}")
    for _ in range(5):
        add("https://five.example/", "<div><p>one page in five rows</p></div>", "one page in five rows")
    add("https://a.example/", "<article><p>so</p><p class=legal>by law</p><div class='related-work'>others</div><ul><li><a href=1>a source</a></ul><div class=ad>buy</div></article>", "so\nby law\nothers\na source")
    add("https://b.example/", f"<div><p>{'the story ' * 20}</p></div><article class=card><p>next</p></article>", ("the story " * 20).strip())
    add("https://c.example/", "<div>" * 5000 + "deep" + "</div>" * 5000, "deep")
    add(None, None, "")
    add("", "", "")
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in queries.op8_main_text(spark, str(tmp_path)).collect()}
    assert [got[i].text for i in range(len(rows))] == want
    assert all(got[i].n_chars == len(t) and got[i].url == rows[i][1] for i, t in enumerate(want))
