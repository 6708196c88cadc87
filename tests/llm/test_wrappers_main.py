"""The main subtree of a host's wrapper: boilerplate that varies, pages without classes, hostile markup, and a plain version."""

import collections
import random
import re
import time

import pytest

from sedgewren.llm import queries, wrappers

WORDS = "able bird corn dusk echo fern glow hill iris jade kelp loom moss nest opal pine".split()


def plain(pages):
    """Texts of one host's pages, and what they are without the wrapper: pages aligned one after the other, slots counted in dictionaries."""
    made, seen, said_by = None, set(), collections.defaultdict(list)
    for p in dict.fromkeys(pages):
        one = wrappers.folded(wrappers.tree([b.path for b in wrappers.blocks(p)])[0])
        made = one if made is None else wrappers.aligned(made, one)
    text, read = wrappers.dumped(made), wrappers.Filled()
    for p in pages:
        said = {}
        for slot, x in read.blocks(p, text):
            if slot >= 0 and not x.off:
                s = said.setdefault(slot, ["", 0, 0, x.main])
                s[0], s[1], s[2] = s[0] + x.text + "\n", s[1] + len(x.text), s[2] + x.links
        key = repr(said)
        if key not in seen:
            seen.add(key)
            for slot, s in said.items():
                said_by[slot].append(s)
    slots = {}
    for slot, all_ in said_by.items():
        times = collections.Counter(t for t, *_ in all_)
        length = {t: n for t, n, *_ in all_}
        most, top = max(times.items(), key=lambda x: (x[1], length[x[0]] * x[1]))
        same = len(all_) > 1 and 2 * top > len(all_)
        chars = sum(n for _, n, *_ in all_)
        slots[slot] = wrappers.Slot(chars, sum(x[2] for x in all_), chars - (length[most] * top if same else 0), sum(x[1] for x in all_ if x[3]), same)
    drop = frozenset(set(slots) - set(wrappers.chosen(wrappers.loaded(text), slots, len(seen))))
    return [wrappers.main_of(read.blocks(p, text), drop) for p in pages], [wrappers.main_of(read.blocks(p, text), frozenset()) for p in pages]


def host(kind, i, rng):
    """A page without classes or telling elements: its menu, advert, notice and footer vary from page to page."""
    say = lambda k: " ".join(rng.choices(WORDS, k=k))
    story = [say(rng.randint(12, 60)) for _ in range(rng.randint(2, 6))]
    inner, told = f"<h2>{story[0]}</h2>" + "".join(f"<p>{x}</p>" for x in story[1:]), "\n".join(story)
    menu = "<div><ul>" + "".join(f"<li><a href=1>{say(1)}</a></li>" for _ in range(4)) + "</ul></div>"
    advert, notice = f"<div>{say(5)}</div>", f"<div>{say(4)}</div>"
    footer = f"<div>{say(rng.randint(3, 6))}</div>" if i % 3 else ""
    body = {
        "side": f"{menu}{advert}<div>{inner}</div>{notice}{footer}",
        "deep": f"<div>{menu}<div>{notice}<div>{inner}</div></div></div>{advert}{footer}",
        "table": f"<table><tr><td>{say(2)}</td></tr></table>{advert}<div><p>{story[0]}</p>" + "".join(f"<p>{x}</p>" for x in story[1:]) + f"</div>{footer}",
    }[kind]
    return f"<html><body>{body}</body></html>", told


def test_query_takes_the_main_subtree(spark, tmp_path):
    rng, rows, want, ignored = random.Random(4), [], [], 0
    for kind in ("side", "deep", "table"):
        pages = [host(kind, i, rng) for i in range(12)]
        alone = plain([h for h, _ in pages])
        assert alone[0] == [t for _, t in pages]
        ignored += sum(a == b for a, b in zip(*alone, strict=True))
        for i, (h, t) in enumerate(pages):
            rows.append((len(rows), f"https://{kind}.example/{i}", h))
            want.append(t)
    assert not ignored  # without its wrapper every page has other text
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.text for r in queries.op8_main_text(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(len(rows))] == want


def test_query_equals_the_plain_version(spark, sf, duck):
    """All given pages, as they are and with classes and telling elements taken out."""
    pages = duck.sql("SELECT page_id, url, html FROM pages").fetchall()
    bare = lambda h: re.sub(r"<(/?)(article|nav|footer|aside|main|header|section)>", r"<\1div>", re.sub(r' (class|id|role)="[^"]*"', "", h or ""))
    for change in (lambda h: h, bare):
        rows = [(i, u, change(h)) for i, u, h in pages]
        got = {r.page_id: r.text for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), carry=["page_id"]).collect()}
        of = collections.defaultdict(list)
        for i, u, h in rows:
            of[(u or "").partition("://")[2].partition("/")[0].partition("?")[0].lower()].append((i, h or ""))
        for same in of.values():
            texts, _ = plain([h for _, h in same])
            assert [got[i] for i, _ in same] == texts


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9])
def test_no_size_decides(spark, n):
    """A repeated notice goes on two pages as on nine; an article wins over a notice of any length beside it."""
    rng = random.Random(n)
    say = lambda k: " ".join(rng.choices(WORDS, k=k))
    told = [[say(30), say(40)] for _ in range(n)]
    rows = [(i, "https://few.example/", "<div><p>kept for all</p>" + "".join(f"<p>{x}</p>" for x in t) + "</div><div>one notice on all pages of the house</div>") for i, t in enumerate(told)]
    rows += [(100 + i, f"https://one{k}.example/", f"<article>{'x' * 50}</article><div>{'y' * k}</div>") for i, k in enumerate((1, 99, 100, 101, 102, 5000))]
    got = {r.page_id: r.text for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("notice" not in got[i] and got[i].endswith("\n".join(t)) for i, t in enumerate(told))
    assert {got[100 + i] for i in range(6)} == {"x" * 50}


HOSTILE = {
    "open questions": lambda n: "<?x " * n + "end",
    "open marks": lambda n: "<p>" + "<! " * n,
    "stray ends": lambda n: "<div>" * n + "</p>" * n + "deep",
    "open elements": lambda n: "".join(f"<div>{i % 7}" for i in range(n)),
    "open lists": lambda n: "".join(f"<ul><li>{i % 7}" for i in range(n)),
    "quotes": lambda n: "<a \"'" * n,
    "comments": lambda n: "<!--x" * n,
}


@pytest.mark.parametrize("name", sorted(HOSTILE))
def test_hostile_pages_are_read_in_linear_time(name):
    def seconds(n):
        best = 9e9
        for _ in range(2):
            began = time.process_time()
            found = list(wrappers.blocks(HOSTILE[name](n)))
            root, holders = wrappers.tree([b.path for b in found])
            best = min(best, time.process_time() - began)
            assert len(holders) == len(found)
        return best

    small, large = seconds(6_000), seconds(48_000)
    assert large < 24 * small + 0.3


def test_hostile_pages_in_the_query(spark):
    rows = [(i, "https://odd.example/", make(3000)) for i, make in enumerate(HOSTILE.values())] + [(50, "https://odd.example/", "<div>" * 20_000 + "deep"), (51, "https://odd.example/", "w" * 2_000_000)]
    got = {r.page_id: r.text for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows) and got[51] == "w" * 2_000_000 and "deep" in got[50]
