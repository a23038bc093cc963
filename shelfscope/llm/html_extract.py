"""Main text of web pages by a minimum cut over their text blocks.

A page becomes a chain of text blocks with the tags around them. A small classifier turns what is known of a block into
two integer costs, the capacities from the source (cost of calling it boilerplate) and to the sink (cost of calling it
content). Neighbours in page order and blocks of the same container are joined by smoothness edges. Max-flow gives the
cheapest labelling; the source's side is the content.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Comments, declarations and tags; a quote that never closes ends at the next ">".
MARKUP = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>", re.S
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
# Their content is no text of the page. The first four are read as raw text up to their own end tag.
RAW = frozenset("script style textarea title".split())
UNSEEN = frozenset("script style textarea title head noscript template svg math iframe object select option datalist button canvas audio video map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
CONTAINERS = frozenset("html body main article section div nav header footer aside form ul ol dl table figure details dialog fieldset".split())
# Where a new one of the first opens, an open one of the others ends.
IMPLIED_ENDS = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]), "body": frozenset(["head"]),
}
BAD_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promoted promotion outbrain taboola "
    "nav navbar navigation menu menubar submenu breadcrumb breadcrumbs pagination pager toc topbar toolbar "
    "header masthead footer foot bottombar copyright colophon sidebar aside rail widget widgets "
    "comment comments commentlist respond reply replies disqus discussion feedback reviews "
    "cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login signin register "
    "share sharing social follow related recommended recommendations trending popular more-links tags tagcloud "
    "search searchbox form skip hidden legal disclaimer paywall".split()
)
# "has-sidebar" says what stands beside; "entry-header" is the head of the entry.
BESIDE = frozenset("has with without no is not".split())
OWN_HEADS = frozenset("header head heading title footer meta".split())
# Readers' comments, wherever they stand; "comments-closed" and the like only say something about them.
COMMENT_NAMES = frozenset("comment comments commentlist disqus respond".split())
COMMENT_STATES = frozenset("open closed off on enabled disabled".split())
ABOUT_COMMENTS = COMMENT_STATES | frozenset("count counter link icon".split())
GOOD_NAMES = frozenset("article content post entry story main body text prose".split())
SENTENCE_END = re.compile(r"[.!?…。！？][\"'”’»)\]]*(?:\s|$)")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[^\W\d_]+")


@dataclass(frozen=True)
class Costs:
    """Weights of the classifier and of the smoothness edges, in the same integer unit."""

    bad_container: int = 60
    bad_name: int = 48
    doubtful_name: int = 16
    good_container: int = 24
    good_name: int = 6
    heading: int = 4
    page_header: int = 40
    links: int = 12
    sentence: int = 3
    most_sentences: int = 12
    unpunctuated: int = 4
    adjacent: int = 3
    same_container: int = 2


@dataclass
class Block:
    """A run of text between block tags. ``container``: the open container; ``place``: what is known of its ancestors."""

    container: int
    place: Place
    tag: str
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


@dataclass(frozen=True)
class Place:
    """Sum over the ancestors: inside boilerplate, by tag or role or by name (1 doubtful, 2 plain), the article, a header, a link,
    something unseen."""

    bad: bool = False
    named: int = 0
    article: bool = False
    good_name: bool = False
    header: bool = False
    linked: bool = False
    unseen: bool = False


def _names(attrs: str, with_id: bool) -> tuple[set[str], int, bool, str, bool]:
    """Lower-case name parts of class and id, how bad the names are (0 to 2), whether they name readers' comments, the role,
    and whether the element is hidden."""
    names: set[str] = set()
    named, comments, role, hidden = 0, False, "", bool(re.search(r"(?:^|\s)hidden(?:\s|$)", attrs))
    for key, *values in ATTRIBUTE.findall(attrs):
        value, key = "".join(values), key.lower()
        if key in ("class", "id"):
            for token in unescape(value).split():
                parts = [p.lower() for p in NAME_PARTS.findall(token)]
                names.update(parts)
                comments |= _of_comments(parts)
                if key == "class" or with_id:
                    named = max(named, _badness(token.lower(), parts))
        elif key == "role":
            role = value.strip().lower()
        elif key == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        elif key == "aria-hidden":
            hidden |= value.lower() == "true"
    return names, named, comments, role, hidden


def _of_comments(parts: list[str]) -> bool:
    return not COMMENT_NAMES.isdisjoint(parts) and parts[0] not in BESIDE and ABOUT_COMMENTS.isdisjoint(parts)


def _badness(token: str, parts: list[str]) -> int:
    """2 for a name of boilerplate, whole or as the last part (``site-footer``), 1 for one with such a part elsewhere."""
    if token in BAD_NAMES:
        return 2
    bad = [p in BAD_NAMES for p in parts]
    if parts and parts[-1] in COMMENT_STATES and not COMMENT_NAMES.isdisjoint(parts):
        return 0
    if not any(bad) or parts[0] in BESIDE or parts[0] in GOOD_NAMES and parts[-1] in OWN_HEADS:
        return 0
    return 2 if bad[-1] else 1


def _place(tag: str, attrs: str, outer: Place) -> Place:
    in_article = outer.article and tag in ("section", *HEADINGS)  # their ids name a topic
    given = attrs and ("=" in attrs or "hidden" in attrs)
    names, named, comments, role, hidden = _names(attrs, not in_article) if given else (set(), 0, False, "", False)
    is_main, is_article = tag == "main" or role == "main", tag == "article" or role == "article"
    if tag in ("body", "html") or is_main or is_article:  # theme names of the page's frame say nothing
        named, comments = 0, comments and tag == "article" and outer.article  # an article in an article may be a comment
    outer_named = 0 if is_main or is_article and outer.named == 1 else outer.named
    return Place(
        bad=(outer.bad and not is_main) or tag in BAD_TAGS or role in BAD_ROLES or comments,
        named=max(outer_named, named),
        article=outer.article or is_main or is_article,
        good_name=outer.good_name or not names.isdisjoint(GOOD_NAMES),
        header=outer.header or tag == "header",
        linked=outer.linked or tag == "a",
        unseen=outer.unseen or tag in UNSEEN or hidden,
    )


class _Open:
    """The open tags. Where each name, the last block and the last container stand is kept with them, so no step searches the stack."""

    def __init__(self) -> None:
        self.tags: list[tuple[str, Place, int, int, int]] = [("", Place(), 0, 0, 0)]
        self.places: dict[str, list[int]] = {}

    def push(self, tag: str, place: Place, container: int) -> None:
        at = len(self.tags)
        block = at if tag not in INLINE else self.last_block
        self.tags.append((tag, place, container, block, at if tag in CONTAINERS else self.last_container))
        self.places.setdefault(tag, []).append(at)

    def last(self, tag: str) -> int:
        """Place of the innermost open tag of a name, 0 if there is none."""
        open_ = self.places.get(tag)
        return open_[-1] if open_ else 0

    def cut(self, place: int) -> None:
        for tag, *_ in self.tags[place:]:
            self.places[tag].pop()
        del self.tags[place:]

    place = property(lambda self: self.tags[-1][1])
    container = property(lambda self: self.tags[-1][2])
    last_block = property(lambda self: self.tags[-1][3])
    last_container = property(lambda self: self.tags[-1][4])
    block_tag = property(lambda self: self.tags[self.last_block][0])


def blocks_of(html: str) -> list[Block]:
    """Text blocks in page order; never fails on broken markup."""
    stack = _Open()
    blocks: list[Block] = []
    current: Block | None = None
    n_containers, at, size = 0, 0, len(html)
    last = html.rfind(">") + 1  # behind it no tag is complete

    def text(raw: str) -> None:
        nonlocal current
        place, container = stack.place, stack.container
        if place.unseen or not raw:
            return
        if current is None:
            if raw.isspace():
                return
            current = Block(container, place, stack.block_tag)
            blocks.append(current)
        decoded = unescape(raw) if "&" in raw else raw
        current.parts.append(decoded)
        if place.linked:
            current.linked += len(decoded)

    while at < size:
        found = MARKUP.search(html, at, last) if at < last else None
        if not found:
            comment = html.find("<!--", at)
            text(html[at : comment if comment >= 0 else size])
            break
        text(html[at : found.start()])
        at = found.end()
        if not found["tag"]:
            if at == last and found[0].startswith("<!--") and not found[0].endswith(("-->", "--!>")):
                break  # a comment that never closes
            continue
        tag = found["tag"].lower()
        if tag not in INLINE:
            current = None
        if found["end"]:
            place = stack.last(tag)
            if place and not (tag in INLINE and place < stack.last_block):  # an inline end tag closes nothing outside its block
                stack.cut(place)
            continue
        attrs = found["attrs"]
        if tag in VOID:
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = close.end() if close else size
            continue
        if attrs.endswith("/") and tag in ("svg", "path", "iframe"):
            continue
        if tag not in INLINE:
            if tag == "p" or tag in CONTAINERS or tag[0] == "h" and tag[1:].isdigit() or tag in ("li", "pre", "blockquote"):
                # An open paragraph ends where a block begins, with the inline tags left open in it.
                if stack.last("p") > stack.last_container:
                    stack.cut(stack.last("p"))
            place = max((stack.last(t) for t in IMPLIED_ENDS.get(tag, ())), default=0)
            if place and place >= stack.last_container:
                stack.cut(place)
        if tag in CONTAINERS:
            n_containers += 1
        stack.push(tag, _place(tag, attrs, stack.place), n_containers if tag in CONTAINERS else stack.container)
    for block in blocks:
        block.text = " ".join("".join(block.parts).split())
    return [b for b in blocks if b.text]


def terminal_costs(block: Block, costs: Costs, page_has_article: bool) -> tuple[int, int]:
    """(cost of calling it boilerplate, cost of calling it content)."""
    place, keep, drop = block.place, 1, 0
    if place.bad:
        drop += costs.bad_container
    elif place.named:
        drop += costs.bad_name if place.named > 1 else costs.doubtful_name
    if place.article and not place.bad:
        keep += costs.good_container
    elif page_has_article:
        drop += costs.good_container
    if place.header and not place.article:
        drop += costs.page_header
    if place.good_name:
        keep += costs.good_name
    if block.tag[:1] == "h" and block.tag[1:].isdigit():
        keep += costs.heading
    if 2 * block.linked > len(block.text):
        drop += costs.links
    ends = len(SENTENCE_END.findall(block.text))
    keep += min(costs.most_sentences, costs.sentence * ends)
    if not ends:
        drop += costs.unpunctuated
    return keep, drop


def minimum_cut(terminals: list[tuple[int, int]], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Whether each node is on the source's side of a minimum cut; of equal cuts the one with most nodes there.

    Shortest augmenting paths by levels. Each node's smaller capacity is sent straight through first, so flow only
    moves between blocks that disagree.
    """
    n = len(terminals)
    spare = [keep - drop for keep, drop in terminals]  # left from the source if positive, to the sink if negative
    links: list[list[list[int]]] = [[] for _ in range(n)]  # [other node, capacity, place of the reverse edge]
    for a, b, capacity in edges:
        links[a].append([b, capacity, len(links[b])])
        links[b].append([a, capacity, len(links[a]) - 1])
    while True:
        level = [-1] * n
        queue = [v for v in range(n) if spare[v] > 0]
        for v in queue:
            level[v] = 0
        reached = False
        for v in queue:
            reached |= spare[v] < 0
            for other, capacity, _ in links[v]:
                if capacity and level[other] < 0:
                    level[other] = level[v] + 1
                    queue.append(other)
        if not reached:
            break
        tried = [0] * n
        for source in range(n):
            while spare[source] > 0:
                path, v = [], source
                while spare[v] >= 0 or v == source:
                    while tried[v] < len(links[v]):
                        edge = links[v][tried[v]]
                        if edge[1] and level[edge[0]] == level[v] + 1:
                            break
                        tried[v] += 1
                    else:
                        if not path:
                            break
                        v = path.pop()[0]
                        tried[v] += 1
                        continue
                    path.append((v, edge))
                    v = edge[0]
                if not path:
                    break
                pushed = min(spare[source], -spare[v], *(edge[1] for _, edge in path))
                spare[source] -= pushed
                spare[v] += pushed
                for u, edge in path:
                    edge[1] -= pushed
                    links[edge[0]][edge[2]][1] += pushed
    to_sink = [spare[v] < 0 for v in range(n)]
    queue = [v for v in range(n) if to_sink[v]]
    for v in queue:
        for other, _, back in links[v]:
            if links[other][back][1] and not to_sink[other]:
                to_sink[other] = True
                queue.append(other)
    return [not x for x in to_sink]


def main_blocks(html: str, costs: Costs) -> list[Block]:
    blocks = blocks_of(html)
    # An article is the page's only if it holds most of the running text: a teaser can be one beside the text.
    said = [0, 0]
    for b in blocks:
        if not b.place.bad and b.place.named < 2 and not b.place.header and SENTENCE_END.search(b.text):
            said[b.place.article] += max(0, len(b.text) - b.linked)
    has_article = said[1] >= said[0] and any(b.place.article and not b.place.bad for b in blocks)
    edges, last_in = [], {}
    for i, block in enumerate(blocks):
        if i:
            edges.append((i - 1, i, costs.adjacent if block.place == blocks[i - 1].place else 1))
        before = last_in.get(block.container)
        if before is not None:
            edges.append((before, i, costs.same_container))
        last_in[block.container] = i
    kept = minimum_cut([terminal_costs(b, costs, has_article) for b in blocks], edges)
    return [b for b, keep in zip(blocks, kept, strict=True) if keep]


def main_text(html: str | None, costs: Costs = Costs()) -> str:  # noqa: B008  frozen
    return " ".join(b.text for b in main_blocks(html or "", costs))


def extract_main_text(pages: DataFrame, costs: Costs | None = None, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``pages`` without the html, plus ``text``: the main text of the whole page.

    Row-wise in Arrow batches, no shuffle; the graph of a page has two edges a block at most.

    Defined cases: null, empty or text-free html gives ""; broken markup is read as far as it goes; of equal cuts the
    larger content is taken; repeated rows give a row each; an empty table gives no rows. A column of ``pages`` called
    ``text`` is replaced, other columns are carried along.
    """
    costs = costs or Costs()
    carried = [c for c in pages.columns if c not in (html_col, "text")]
    rows = pages.select(*carried, F.col(html_col).alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html.as_py(), costs) for html in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], "text"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, schema + "text string")
