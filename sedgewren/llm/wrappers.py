"""HTML extraction by wrappers inferred per host, union-free regular expressions over token streams.

Each page's token stream is read as an expression: an element with its children in order, neighbours of one labelled kind as one
repeated group (+), text as a slot (#). The expressions of a host are aligned with each other, a few at a time in rounds of grouped
aggregation; what has no counterpart becomes an optional group (?), until one wrapper per host fits all its pages. Every page is then
matched against its host's wrapper, which tells the slot that each of its texts fills, and the wrapper is judged once per host over all
its different pages: the subtree that holds most of what varies and is no link is the main one, and what lies beside it goes, whether it
varies or not. Within it, but not in an article, a slot that says the same on most pages, or that is mostly links, is the host's own
text. A page's main text is what fills the slots that remain. Names of elements and classes weigh in that choice, and decide alone where
a host has one page.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, free_name, small
from .urls import host_and_path

#: Elements whose text is never main text, whatever the host.
OFF = frozenset("head nav footer aside form script style noscript template button select option textarea menu dialog iframe object svg math canvas audio video map datalist".split())
#: Words in class, id or role that mark what surrounds an article, wherever it is, and those that do so outside an article only.
ANYWHERE = frozenset(
    "nav navbar navigation menu menubar sidebar side-bar complementary aside ad ads advert adverts advertisement adbox adsense sponsor sponsored banner promo cookie cookies consent gdpr popup modal overlay"
    " newsletter subscribe signup login search breadcrumb breadcrumbs pagination pager share sharing social related recommended toolbar widget comment comments respond reply replies disqus".split()
)
OUTSIDE = frozenset("header masthead topbar footer contentinfo notice notices alert tags copyright legal disclaimer skip".split())
#: Words that say nothing about what a container with one of the above has.
PLAIN = frozenset("site page main top bottom left right primary secondary global box block area section container wrapper wrap inner outer slot unit list item items link links button buttons bar panel group row text form thread tree the".split())
READERS = frozenset("comment comments respond reply replies disqus".split())
#: Article elements that only point to another page's article.
TEASERS = frozenset("card teaser preview".split())
#: Words before or after those of readers' comments.
BESIDE = frozenset("post article entry user reader readers wp".split())
#: Elements that hold the article where a page has them.
MAIN = frozenset(("article", "main"))
#: Elements inside a line of text; all others bound a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark meter output picture progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr td th".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is raw up to their own end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
#: An end tag may be left out: an open element of the value ends when one of the key begins.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
#: Slots outside MAIN that say the same on more than this share of the different pages that fill them are the host's own text.
SAME_SHARE = 0.5
#: How many times a character in MAIN counts in the choice of the main subtree.
PRIOR = 4
#: A subtree is left for its heaviest part if that has more than half of its weight and nothing beside it has more than this share of the part's.
BESIDE_SHARE = 0.25
#: Children that make a bare element one of prose, which is never aligned with one of another kind.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
#: Larger shares of a slot's text in links mark a menu.
LINK_SHARE = 0.6
#: Expressions aligned in one group, about.
FAN_IN = 8

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?]|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)/?>""", re.S)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
RAW_END = {t: re.compile(rf"</{t}(?=[\s>/])[^>]*>", re.I) for t in RAW}


def marked(words: list[str], inside: bool) -> bool:
    """Whether a word of class, id or role names what surrounds an article: all parts of it do, or are PLAIN."""
    for word in words:
        parts = [x for x in re.split(r"[-_:./]+|(?<=[a-z])(?=[A-Z])", re.sub(r"[0-9]+", "", word)) if x]
        low = [x.lower() for x in parts]
        off = ANYWHERE if inside else ANYWHERE | OUTSIDE
        if word.lower() in off or (not off.isdisjoint(low) and all(x in off or x in PLAIN or (x in BESIDE and not READERS.isdisjoint(low)) for x in low)):
            return True
    return False


#: An element on the way to a block: its signature and its number on the page.
Step = tuple[str, int]
#: The way to a block from the inside: what is above (None: nothing) and the element. Blocks share what is above them.
Path = tuple["Path | None", Step]


class Block(NamedTuple):
    path: Path | None
    text: str
    links: int  # characters in links
    main: bool  # in an article or main element
    off: bool  # in an element that is never main text


def blocks(page: str) -> Iterator[Block]:
    """Every block with text, in page order.

    A signature is the element's name, its words from class, id and role, and ! if it is off."""
    stack: list[tuple[str, Path]] = []
    opened: dict[str, int] = {}  # open elements by name
    text: list[str] = []
    links, in_link, at, made, inside, outside, no_end = 0, 0, 0, 0, 0, 0, False

    def flush():
        nonlocal text, links
        said = " ".join(html.unescape("".join(text)).split())
        got = Block(stack[-1][1] if stack else None, said, min(links, len(said)), inside > 0, outside > 0) if said else None
        text, links = [], 0
        return got

    def add(piece: str) -> None:
        nonlocal links
        text.append(piece)
        if in_link:
            links += len(piece)

    def pop() -> str:
        nonlocal inside, outside
        tag, (_, (signature, _)) = stack.pop()
        opened[tag] -= 1
        inside -= tag in MAIN
        outside -= signature[-1] == "!"
        return tag

    while m := TOKEN.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            if m[0] in ("<!", "<?"):
                end = -1 if no_end else page.find(">", at)
                no_end = end < 0
                if no_end:
                    add(m[0])
                else:
                    at = end + 1
            continue
        tag = m[2].lower()
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if m[1] else 1
            if tag in ("br", "td", "th"):
                text.append(" ")
            continue
        if got := flush():
            yield got
        if m[1]:
            if opened.get(tag):
                while pop() != tag:
                    pass
                in_link = 0
            continue
        if stack and (stack[-1][0] == "p" or stack[-1][0] in ENDS.get(tag, ())):
            pop()
        if tag in VOID:
            continue
        words = [w for x in NAMED.findall(m[3]) for w in next(filter(None, x), "").split()] if m[3] else []
        if tag in ("html", "body"):
            off, words = False, []
        elif tag == "header":
            off = not inside
        else:
            off = tag in OFF or (bool(words) and (marked(words, inside > 0 or tag in MAIN) or (tag in MAIN and not TEASERS.isdisjoint(w.lower() for w in words))))
        # Numbers in names are left out, as they count pages or entries.
        label = tag + ("." + ".".join(sorted(set(re.sub(r"[0-9]+", "", " ".join(words).lower()).split()))) if words else "")
        if tag in RAW:
            end = RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if m[0].endswith("/>"):
            continue
        made += 1
        inside += tag in MAIN
        outside += off
        opened[tag] = opened.get(tag, 0) + 1
        stack.append((tag, (stack[-1][1] if stack else None, (label + "!" * off, made))))
    if at < len(page):
        add(page[at:])
    if got := flush():
        yield got


# A node is [signature, marks, children]; marks are a subset of "?+#" (optional, repeated, has a text slot). Pages may nest elements
# thousands deep, so nothing below recurses.

#: Neighbours of these kinds without a label are not taken for one repeated group: they may be a menu, a story and a footer.
BARE = frozenset("div section body html center table".split())


def _marks(marks: str) -> str:
    return "".join(c for c in "?+#" if c in marks)


def tree(paths: list[Path | None]) -> tuple[list, list[list]]:
    """The page's root, and for each block the node that has its text. A bare element with prose in it has ~ after its name."""
    root: list = ["", "", []]
    nodes, holders = {0: root}, []
    for path in paths:
        new = []
        while path is not None and path[1][1] not in nodes:
            new.append(path[1])
            path = path[0]
        above = nodes[path[1][1] if path is not None else 0]
        for signature, number in reversed(new):
            nodes[number] = [signature, "", []]
            above[2].append(nodes[number])
            above = nodes[number]
        above[1] = "#"
        holders.append(above)
    for node in nodes.values():
        if node[0] in BARE and any(c[0].split(".")[0] in PROSE for c in node[2]):
            node[0] += "~"
    return root, holders


def runs(children: list[list]) -> list[list[list]]:
    """Neighbours of one kind together, unless it is BARE."""
    out: list[list[list]] = []
    for c in children:
        if out and out[-1][0][0] == c[0] and c[0].rstrip("~") not in BARE:
            out[-1].append(c)
        else:
            out.append([c])
    return out


def folded(root: list) -> list:
    """The page's expression: runs become repeated groups that fit all their members, the deepest first."""
    order, made = [root], {}
    for node in order:
        order += node[2]
    for node in reversed(order):
        children = []
        for run in runs(node[2]):
            group = made[id(run[0])]
            for more in run[1:]:
                group = aligned(group, made[id(more)])
            children.append(group if len(run) == 1 else [group[0], _marks(group[1] + "+"), group[2]])
        made[id(node)] = [node[0], node[1], children]
    return made[id(root)]


def paired(x: list[str], y: list[str]) -> Iterator[tuple[int | None, int | None]]:
    """Places of x and y in one order, counterparts together: from both ends in turn as far as they are equal, so that what lies in the
    middle varies; then whichever mismatch is passed with the fewer left out."""
    i, end, most, moved = 0, 0, min(len(x), len(y)), True
    while moved:
        moved = False
        if i + end < most and x[i] == y[i]:
            i, moved = i + 1, True
        if i + end < most and x[-1 - end] == y[-1 - end]:
            end, moved = end + 1, True
    j, stop = i, (len(x) - end, len(y) - end)
    yield from ((k, k) for k in range(i))
    at: tuple[dict[str, list[int]], dict[str, list[int]]] = ({}, {})
    for seen, signatures, upto in zip(at, (x, y), stop, strict=True):
        for k in range(i, upto):
            seen.setdefault(signatures[k], []).append(k)

    def ahead(seen: dict[str, list[int]], signature: str, start: int) -> int | None:
        places = seen.get(signature, ())
        k = bisect_left(places, start)
        return places[k] - start if k < len(places) else None

    while i < stop[0] or j < stop[1]:
        if i < stop[0] and j < stop[1] and x[i] == y[j]:
            yield i, j
            i, j = i + 1, j + 1
            continue
        in_x = ahead(at[0], y[j], i) if j < stop[1] else None
        in_y = ahead(at[1], x[i], j) if i < stop[0] else None
        if j == stop[1] or (i < stop[0] and (in_y is None or (in_x is not None and in_x < in_y))):
            yield i, None
            i += 1
        else:
            yield None, j
            j += 1
    for k in range(end):
        yield stop[0] + k, stop[1] + k


def aligned(a: list, b: list) -> list:
    """The expression that fits whatever a or b fits: what has no counterpart becomes optional."""
    top: list = [a[0], _marks(a[1] + b[1]), []]
    work = [(top, a, b)]
    while work:
        out, x, y = work.pop()
        for i, j in paired([c[0] for c in x[2]], [c[0] for c in y[2]]):
            if i is None or j is None:
                one = y[2][j] if i is None else x[2][i]
                out[2].append([one[0], _marks(one[1] + "?"), one[2]])
            else:
                p, q = x[2][i], y[2][j]
                child: list = [p[0], _marks(p[1] + q[1]), []]
                out[2].append(child)
                work.append((child, p, q))
    return top


def flat(root: list) -> list[tuple[int, list]]:
    """Nodes with their depths, parents before children in order."""
    out, stack = [], [(0, root)]
    while stack:
        depth, node = stack.pop()
        out.append((depth, node))
        stack += [(depth + 1, c) for c in reversed(node[2])]
    return out


def dumped(root: list) -> str:
    """A line per node: depth, signature, marks (signatures have no white space)."""
    return "\n".join(f"{depth}\t{node[0]}\t{node[1]}" for depth, node in flat(root))


def loaded(text: str) -> list:
    path: list[list] = []
    for line in text.split("\n"):
        depth, signature, marks = line.split("\t")
        node: list = [signature, marks, []]
        del path[int(depth) :]
        if path:
            path[-1][2].append(node)
        path.append(node)
    return path[0]


def expression(wrapper: list) -> str:
    """The wrapper as a regular expression to read: element(children) with ?, + and # for text."""
    out, ends, before = "", [], -1
    for depth, (signature, marks, _) in flat(wrapper):
        while len(ends) > depth:
            out += ends.pop()
        out += (" " if depth <= before or "#(" in out[-2:] else "") + f"{signature or 'page'}(" + "#" * ("#" in marks)
        ends.append(")" + marks.replace("#", "").replace("?+", "*"))
        before = depth
    return out + "".join(reversed(ends))


def numbered(wrapper: list) -> dict[int, int]:
    """Numbers of a wrapper's nodes by their identity."""
    return {id(node): i for i, (_, node) in enumerate(flat(wrapper))}


def matched(root: list, holders: list[list], wrapper: list, number: dict[int, int] | None = None) -> list[int]:
    """The slot of each block of a page: the number of the wrapper's node that its element fills, -1 if none fits.

    Children are paired in order as in `aligned`; one that finds no counterpart goes to the nearest node of its kind."""
    number = numbered(wrapper) if number is None else number
    fills = {id(root): wrapper}
    work = [(root, wrapper)]
    while work:
        node, fit = work.pop()
        groups, kinds = runs(node[2]), [c[0] for c in fit[2]]
        to: dict[int, int] = {}
        near = 0
        for i, j in paired([g[0][0] for g in groups], kinds):
            near = near if j is None else j
            if i is not None:
                same = [k for k, kind in enumerate(kinds) if kind == groups[i][0][0]] if j is None else ()
                if j is not None or same:
                    to[i] = j if j is not None else min(same, key=lambda k: abs(k - near))
        for i, j in to.items():
            for member in groups[i]:
                fills[id(member)] = fit[2][j]
                work.append((member, fit[2][j]))
    return [number[id(fills[id(h)])] if id(h) in fills else -1 for h in holders]


def pages_folded(pages: DataFrame) -> DataFrame:
    """h and w, the page's expression. pages: h, page."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [dumped(folded(tree([x.path for x in blocks(page.as_py() or "")])[0])) for page in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.string())], names=["h", "w"])

    return pages.mapInArrow(work, "h string, w string").distinct()


def inferred(expressions: DataFrame) -> DataFrame:
    """One wrapper per host from distinct expressions (h, w): rounds that align about FAN_IN of a host's at a time."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for group in b.column(1).to_pylist():
                wrapper = loaded(group[0])
                for other in group[1:]:
                    wrapper = aligned(wrapper, loaded(other))
                made.append(dumped(wrapper))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.string())], names=["h", "w"])

    turn = 0
    while True:
        counts = cut(expressions.groupBy("h").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("h", "c_h"))
        if (counts.agg(F.max("n")).first()[0] or 0) <= 1:
            return expressions
        turn += 1
        bucket = F.pmod(F.xxhash64("w", F.lit(turn)), F.ceil(F.col("n") / FAN_IN))
        dealt = expressions.join(small(counts), F.col("h") == F.col("c_h")).withColumn("bucket", bucket)
        groups = dealt.groupBy("h", "bucket").agg(F.sort_array(F.collect_list("w")).alias("ws"))
        expressions = cut(groups.select("h", "ws").mapInArrow(work, "h string, w string").distinct())


SAID = T.ArrayType(T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("main", T.BooleanType()), T.StructField("hash", T.LongType()), T.StructField("chars", T.LongType()), T.StructField("links", T.LongType())]))


class Filled:
    """Pages read through wrappers; a wrapper is built once per run of its pages."""

    def __init__(self) -> None:
        self.text, self.wrapper, self.number = None, None, {}

    def blocks(self, page: str, wrapper: str) -> list[tuple[int, Block]]:
        """The page's blocks and the slots that they fill."""
        if wrapper != self.text:
            self.text, self.wrapper = wrapper, loaded(wrapper)
            self.number = numbered(self.wrapper)
        found = list(blocks(page))
        root, holders = tree([x.path for x in found])
        return list(zip(matched(root, holders, self.wrapper, self.number), found, strict=True))


def slots_said(pages: DataFrame) -> DataFrame:
    """h and what the slots say on each page, but for what is off. pages: h, page, wrapper."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        read = Filled()
        for b in batches:
            seen = []
            for page, wrapper in zip(b.column(1), b.column(2), strict=True):
                said: dict[int, list] = {}
                for slot, x in read.blocks(page.as_py(), wrapper.as_py()):
                    if slot >= 0 and not x.off:
                        s = said.setdefault(slot, [x.main, xxhash.xxh3_64(), 0, 0])
                        s[1].update(x.text.encode("utf-8", "surrogatepass") + b"\n")
                        s[2] += len(x.text)
                        s[3] += x.links
                seen.append([{"slot": k, "main": m, "hash": h.intdigest() - (1 << 63), "chars": c, "links": n} for k, (m, h, c, n) in said.items()])
            kind = pa.list_(pa.struct([("slot", pa.int32()), ("main", pa.bool_()), ("hash", pa.int64()), ("chars", pa.int64()), ("links", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(seen, kind)], names=["h", "said"])

    return pages.select("h", "page", "wrapper").mapInArrow(work, T.StructType([T.StructField("h", T.StringType()), T.StructField("said", SAID)]))


class Slot(NamedTuple):
    """What a slot says on a host's different pages: characters, those in links, those of texts that are not most pages', and those in MAIN."""

    chars: int
    links: int
    varying: int
    main: int
    same: bool  # one text on most of the pages


def chosen(wrapper: list, slots: dict[int, Slot], pages: int) -> list[int]:
    """The slots that are main text, of a host with so many different pages.

    From the root on, a subtree is left for its heaviest part while that has more than half of its weight and nothing beside it comes near
    (BESIDE_SHARE). A slot weighs what varies in it and is no link, PRIOR times in MAIN. Slots of the host's own text go."""
    nodes = flat(wrapper)
    weight = [0.0] * len(nodes)
    for i, x in slots.items():
        share = max(0.0, 1 - x.links / x.chars) if x.chars else 0.0
        weight[i] = (x.varying if pages > 1 else x.chars) * share * (PRIOR if 2 * x.main > x.chars else 1)
    total, number = list(weight), numbered(wrapper)
    for i in range(len(nodes) - 1, -1, -1):
        total[i] += sum(total[number[id(c)]] for c in nodes[i][1][2])
    at = 0
    while pages > 1:
        parts = sorted((total[number[id(c)]], -number[id(c)]) for c in nodes[at][1][2])
        if not parts:
            break
        best, beside = -parts[-1][1], max([weight[at], *(t for t, _ in parts[:-1])])
        if "+" in nodes[best][1][1] or not nodes[best][1][2] or 2 * total[best] <= total[at] or beside > BESIDE_SHARE * total[best]:
            break
        at = best
    depth, end = nodes[at][0], at + 1
    while end < len(nodes) and nodes[end][0] > depth:
        end += 1
    kept = [i for i in range(at, end) if i in slots]
    inside = [i for i in kept if 2 * slots[i].main > slots[i].chars]
    if inside and (pages == 1 or 2 * sum(weight[i] for i in inside) > sum(weight[i] for i in kept)):
        return inside
    return [i for i in kept if i in inside or not (slots[i].same or slots[i].links > slots[i].chars * LINK_SHARE)]


def wrappers(pages: DataFrame, host: str = "h", page: str = "page") -> DataFrame:
    """host_key, wrapper and drop (its slots that are not main text) for every host."""
    pages = pages.select(F.col(host).alias("h"), F.col(page).alias("page"))
    fitted = cut(inferred(cut(pages_folded(pages))).select(F.col("h").alias("host_key"), F.col("w").alias("wrapper")))
    said = slots_said(pages.join(small(fitted), F.col("h") == F.col("host_key")))
    # Copies of a page are one page: what they share says nothing about the host. Partial sums are shuffled, a row a slot, text and task.
    each = cut(said.select("h", F.xxhash64("said").alias("p"), "said").groupBy("h", "p").agg(F.first("said").alias("said")))
    texts = each.select("h", F.explode("said").alias("s")).select("h", "s.*").groupBy("h", "slot", "hash").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.sum(F.when(F.col("main"), F.col("chars")).otherwise(0)).alias("main")
    )
    top = F.max(F.struct("pages", "chars"))
    slots = texts.groupBy("h", "slot").agg(F.sum("pages").alias("pages"), F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.sum("main").alias("main"), top.alias("top"))
    same = (F.col("pages") > 1) & (F.col("top.pages") > F.col("pages") * SAME_SHARE)
    slots = slots.select("h", F.struct("slot", "chars", "links", (F.col("chars") - F.when(same, F.col("top.chars")).otherwise(0)).alias("varying"), "main", same.alias("same")).alias("s"))
    facts = slots.groupBy("h").agg(F.collect_list("s").alias("slots"))  # a wrapper's slots
    count = each.groupBy(F.col("h").alias("n_h")).agg(F.count(F.lit(1)).alias("pages"))
    told = fitted.join(facts, F.col("host_key") == F.col("h"), "left").join(count, F.col("host_key") == F.col("n_h"), "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            drop = []
            for wrapper, slots, pages in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
                said = {x.pop("slot"): Slot(**x) for x in slots or ()}
                drop.append(sorted(set(said) - set(chosen(loaded(wrapper), said, pages or 1))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(drop, pa.list_(pa.int32()))], names=["host_key", "wrapper", "drop"])

    return cut(told.select("host_key", "wrapper", "slots", "pages").mapInArrow(work, "host_key string, wrapper string, drop array<int>"))


def main_of(found: list[tuple[int, Block]], drop: frozenset[int]) -> str:
    """What fills the slots that remain. A page of which nothing does is read by the names of its elements alone."""
    kept = [x for _, x in found if not x.off]
    filled = [x for slot, x in found if slot not in drop and not x.off]
    inside = [x for x in kept if x.main]
    return "\n".join(x.text for x in filled or inside or kept)


def main_text(df: DataFrame, url_col: str = "url", html_col: str = "html", name: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns of `carry` (all by default) and the main text of every page, by the wrapper of its host.

    Null or empty HTML gives the empty text; a page without any markup is one block. Pages without a host share one wrapper. Repeated
    pages are one to one. A column `name` is replaced. Time and memory grow with a page's length, whatever its markup: unclosed, stray
    or very deep elements are read once.
    """
    keep = [c for c in (df.columns if carry is None else carry) if c.lower() != name.lower()]
    host, _ = host_and_path(F.col(url_col))
    rows = df.select(*[F.col(c).alias(f"in_{i}") for i, c in enumerate(keep)], host.alias("h"), F.coalesce(F.col(html_col), F.lit("")).alias("page"))
    found = wrappers(rows)
    joined = rows.join(small(found), F.col("h") == F.col("host_key")).select(*[f"in_{i}" for i in range(len(keep))], "page", "wrapper", "drop")
    text = free_name(df.select(*keep), name)
    schema = T.StructType([*joined.select(*[f"in_{i}" for i in range(len(keep))]).schema.fields, T.StructField(text, T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Filled()
        for b in batches:
            n = b.num_columns - 3
            made = [main_of(read.blocks(page.as_py(), wrapper.as_py()), frozenset(drop.as_py())) for page, wrapper, drop in zip(*b.columns[n:], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(made, pa.string())], names=[*b.schema.names[:n], text])

    out = joined.mapInArrow(work, schema)
    return out.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(keep)], text)
