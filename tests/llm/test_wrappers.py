"""Main text of pages made from templates whose articles are known."""

import random

from sedgewren.llm import wrappers

WORDS = "able bird corn dusk echo fern glow hill iris jade kelp loom moss nest opal pine".split()


def page(rng, host, n):
    say = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    title, paragraphs = say(5), [say(rng.randint(3, 60)) for _ in range(rng.randint(1, 6))]
    truth = [title, *paragraphs]
    inner = f"<h1>{title}</h1>"
    for i, p in enumerate(paragraphs):
        inner += f"<p>{p.replace(' ', '  ' if i % 2 else chr(10), 1)}</p>"
    if n % 3 == 0:
        items = [say(3) for _ in range(rng.randint(1, 4))]
        inner += "<ul>" + "".join(f"<li>{x} &amp; <b>more</b>" for x in items) + "</ul>"
        truth += [f"{x} & more" for x in items]
    body = {
        "a": f'<header><p>{host} site</p></header><nav><a href="/">home</a> <a href="/x">{say(2)}</a></nav><article>{inner}</article><aside>{say(9)}</aside><footer>&copy; {say(3)}</footer>',
        "b": f'<div class="menu"><ul><li><a href=1>{say(1)}</a><li><a href=2>{say(1)}</a></ul></div><div id="content">{inner}</div><div class="sidebar">{say(8)}</div><div class="comments"><p>{say(12)}</p></div>',
        "c": f'<div role=banner>{say(2)}</div><main>{inner}</main><section class="comments"><article class="comment">{say(7)}</article></section><form><input name=q><button>Go</button><p>{say(2)}</p></form>',
        "d": f'<div class="xa">{inner}</div><div class="xb">All rights of {host} reserved here</div><div class="xc"><a href=1>{say(2)}</a> <a href=2>{say(2)}</a></div>',
    }[host]
    html = f"<!doctype html><html><head><title>{title}</title><style>p{{a:b}}</style><script>var x='<p>no</p>';</script></head><body><!-- <p>no</p> -->{body}</body></html>"
    return html, "\n".join(truth)


def test_templates(spark):
    rng, rows, want = random.Random(5), [], {}
    for i in range(120):
        host = "abcd"[i % 4]
        html, truth = page(rng, host, i)
        rows.append((i, f"https://{host}.example/{i}", html, "old", 1))
        want[i] = truth
    odd = [(None, ""), ("", ""), ("no markup  at\nall", "no markup at all"), ("<p>cut off <b>here", "cut off here"), ("<article>a &lt;b&gt; &amp c</article>", "a <b> & c"), ("<p>" + "w " * 200_000, ("w " * 200_000).strip())]
    for i, (html, truth) in enumerate(odd):
        rows.append((200 + i, None if i % 2 else f"https://odd{i}.example/", html, "old", 1))
        want[200 + i] = truth
    rows += [rows[0], rows[0]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, TEXT string, h int")
    got = wrappers.main_text(df).collect()
    assert len(got) == len(rows)
    wrong = [(r.page_id, r.text, want[r.page_id]) for r in got if r.text != want[r.page_id]]
    assert not wrong, wrong[:3]
    assert wrappers.main_text(df.limit(0)).count() == 0


def paths_of(html):
    return [b.path for b in wrappers.blocks(html)]


def folded(html):
    return wrappers.folded(wrappers.tree(paths_of(html))[0])


def test_wrapper_fits_all_its_pages():
    """Every block of the pages that a wrapper was aligned from fills a slot of its own kind."""
    rng, made, pages = random.Random(7), None, []
    for i in range(40):
        pages.append(page(rng, "ab"[i % 2], i)[0])
        one = folded(pages[-1])
        made = one if made is None else wrappers.aligned(made, one)
    assert wrappers.dumped(wrappers.loaded(wrappers.dumped(made))) == wrappers.dumped(made)
    kinds = [node[0] for _, node in wrappers.flat(made)]
    for html in pages:
        paths = paths_of(html)
        slots = wrappers.matched(*wrappers.tree(paths), made)
        assert [kinds[s] for s in slots] == [p[-1][0] for p in paths]
    shown = wrappers.expression(made)
    assert "?" in shown and "+" in shown and "#" in shown and "|" not in shown  # optional, repeated, slots, no unions


def test_alignment_marks():
    both = wrappers.aligned(folded("<ul><li>a<li>b</ul><p>c</p>"), folded("<ul><li>a</ul><div>d</div>"))
    assert wrappers.expression(both) == "page(ul(li(#)+) p(#)? div(#)?)"
    # Ends are paired first, so what is between them is the optional part.
    menus = wrappers.aligned(folded("<div>m</div><div>s</div><div>f</div>"), folded("<div>m</div><div>s</div><div>t</div><div>f</div>"))
    assert wrappers.expression(menus) == "page(div(#) div(#) div(#)? div(#))"
