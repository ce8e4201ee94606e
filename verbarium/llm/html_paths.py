"""HTML extraction: hosts vote on the path of their main container.

A page is a stream of tags and text. Each text block counts for its nearest container, and by
half for that one's parent, unless it stands in a menu, an advert, a footer or the like; links
count less. From the best container the way goes up as long as the one around it holds more of the
same text: words of its own, or further containers of prose. The path of generalised tags and
classes (no ids, no digits) is the page's vote. Reader comments go, whatever they hold. Any other
element that only its class, id or role names as boilerplate is judged by what it holds: an article
or main element inside stays, and so does what holds most of the page's text. All steps take time
and memory in proportion to the page, however deep its elements stand in each other.
Spark sums the votes by host; each page is then extracted again along its host's
winning path. Pages without such a container are extracted by their own best one.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbarium.llm.common import map_rows, staged

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>?|<\?[^>]*>?|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>|$)|</?[a-zA-Z][^>]*>?", re.S)
TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
ATTRIBUTE = re.compile(r"""\s(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
NAME = re.compile(r"[a-z]+")

# Elements of HTML by their part in a page.
RAW = set("script style textarea title xmp iframe noembed noframes noscript template".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = set("head script style noscript template nav footer aside form button select textarea iframe svg math dialog menu object noembed noframes xmp title".split())
CONTAINERS = set("body article main section div td form blockquote center".split())
BLOCKS = CONTAINERS | set(
    "html h1 h2 h3 h4 h5 h6 p ul ol li dl dt dd table caption thead tbody tfoot tr th pre figure figcaption header footer aside nav address fieldset hr details summary hgroup search".split()
)
CLOSES_P = BLOCKS - {"html", "body", "td", "th", "tr", "caption", "thead", "tbody", "tfoot"}
BOILERPLATE = set(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent
    gdpr notice notices alert sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer foot comment comments
    disqus replies respond share sharing social related recommended recommendations newsletter subscribe subscription
    signup popup modal widget widgets masthead toolbar pagination pager""".split()
)
# Of these, what is never the text of a page.
NEVER_TEXT = BOILERPLATE - set("sponsor sponsored promo promotion notice notices alert sidebar side footer foot comment comments replies respond share sharing social related recommended recommendations widget widgets".split())
# Words that leave a class, id or role as boilerplate as the word beside them.
FILLERS = set("area bar block box button buttons container form item items left links list page posts right section site text title top bottom wrap wrapper".split())
# Names of reader comments, and what may stand beside them in a name.
COMMENTS = set("comment comments commentlist disqus replies respond".split())
COMMENT_FILLERS = FILLERS | set("body content thread author meta reply post count all user users reader readers visitor fb facebook wp js even odd alt depth parent children".split())
# Elements of the text itself; inside an article only NEVER_TEXT drops them.
TEXT_TAGS = set("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote table tbody tr td th figure figcaption caption".split())
# Shares of the page's text: what is less is minor, what is more is the page's own text.
MINOR, DOMINANT = 0.25, 0.8
PAGE_HEADER = {"header", "banner", "masthead", "topbar"}
# Share of a container's prose above which its neighbours' prose is part of the text.
MORE_PROSE = 0.2
# Share of links above which a container is no prose.
LINKED = 0.3
# Classes on elements that hold the page itself.
NEVER_BOILERPLATE = {"html", "body", "article", "main"}


@dataclass(slots=True, eq=False)
class Node:
    tag: str
    step: str  # of its path, for containers: tag and classes
    skipped: bool
    parent: Node | None
    article: Node | None = None  # the outermost article or main element around it
    named: Named | None = None  # the nearest element, itself included, with a name of boilerplate
    container: Node | None = None  # the nearest container, itself included
    matched: int = -1  # steps of the wanted path, if all of its own are the first of them
    chosen: bool = False  # on the wanted path or below its end
    number: int = 0  # in the order of the page
    score: float = 0.0
    own: Prose | None = None  # of the blocks whose nearest container it is
    whole: Prose | None = None


@dataclass(slots=True)
class Prose:
    length: int = 0
    linked: int = 0
    heading: bool = False

    def add(self, other: Prose) -> None:
        self.length += other.length
        self.linked += other.linked
        self.heading = self.heading or other.heading

    def value(self) -> float:
        """Characters of prose; none where links make up too much."""
        return self.length - self.linked if self.linked <= LINKED * self.length else 0.0


@dataclass(slots=True, eq=False)
class Named:
    """An element with a name of boilerplate: how sure it is, where it stands, and what it holds."""

    level: int
    in_article: bool
    above: Named | None
    # Whether it or an element around it is sure, and whether such a one stands in an article.
    sure: bool = False
    sure_in_article: bool = False
    length: int = 0
    linked: int = 0
    articles: int = 0
    # The same of texts in sure boilerplate, which only count for that.
    sure_length: int = 0
    sure_linked: int = 0
    sure_articles: int = 0
    drops_text: bool = False
    drops_article: bool = False

    def __post_init__(self):
        always = self.level == ALWAYS
        above = self.above
        self.sure = always or above is not None and above.sure
        self.sure_in_article = always and self.in_article or above is not None and above.sure_in_article


WEAK, STRONG, ALWAYS = 1, 2, 3


@dataclass
class Block:
    """A text block: its pieces, its nearest element, and how much of it is links."""

    node: Node
    pieces: list[str] = field(default_factory=list)
    linked: int = 0


def names_of(tag: str) -> tuple[str, ...]:
    """Parts of the class, id and role of a tag, in lower case and without digits."""
    found = []
    for m in ATTRIBUTE.finditer(tag):
        found += NAME.findall(m[2].lower())
    return tuple(found)


def class_of(tag: str) -> str:
    for m in ATTRIBUTE.finditer(tag):
        if m[1].lower() == "class":
            return ".".join(sorted(set(NAME.findall(m[2].lower()))))
    return ""


def tokens_of(tag: str) -> list[list[str]]:
    """The classes, id and role of a tag, each as its parts."""
    return [NAME.findall(x) for m in ATTRIBUTE.finditer(tag) for x in m[2].lower().strip("\"'").split()]


def boilerplate_level(tag: str, token: str, names: tuple[str, ...], inside_article: bool) -> int:
    """0 if no class, id or role names boilerplate, else how sure it is.

    A name is strong if it consists of words of boilerplate and fillers, as in "cookie-notice";
    others, as "has-sidebar" or "related-work", are weak.
    """
    if tag in NEVER_BOILERPLATE:
        return 0
    if not inside_article and tag == "header":
        return ALWAYS
    words, never = (BOILERPLATE, NEVER_TEXT) if inside_article else (BOILERPLATE | PAGE_HEADER, NEVER_TEXT | PAGE_HEADER)
    if words.isdisjoint(names):
        return 0
    found = WEAK
    for parts in tokens_of(token):
        if not words.isdisjoint(parts) and (words | FILLERS).issuperset(parts):
            found = max(found, STRONG if never.isdisjoint(parts) else ALWAYS)
    if inside_article and tag in TEXT_TAGS and found < ALWAYS:
        return 0
    return found


def is_comments(tag: str, token: str) -> bool:
    """Whether a class, id or role says that reader comments stand here, and nothing else."""
    if tag in ("html", "body", "main"):
        return False
    return any(not COMMENTS.isdisjoint(parts) and COMMENT_FILLERS.union(COMMENTS).issuperset(parts) for parts in tokens_of(token))


def judge(blocks: list[Block], named: list[Named]) -> None:
    """Marks as skipped what stands in boilerplate, once all of the page is known.

    ``named``: from the outside to the inside, so that what an element holds is known from the
    back and what it drops from the front.
    """
    open_blocks = [b for b in blocks if not b.node.skipped]
    total = 0
    for block in open_blocks:
        length = sum(map(len, block.pieces))
        over, in_article = block.node.named, block.node.article is not None
        # Sure boilerplate is no text of the elements around it; only an article in it may be.
        sure = over is not None and (over.sure_in_article if in_article else over.sure)
        total += 0 if sure else length
        if over is None:
            continue
        if sure:
            over.sure_length += length
            over.sure_linked += block.linked
            over.sure_articles += length * in_article
        else:
            over.length += length
            over.linked += block.linked
            over.articles += length * in_article
    for n in reversed(named):
        if n.above is not None:
            for part in ("length", "linked", "articles", "sure_length", "sure_linked", "sure_articles"):
                setattr(n.above, part, getattr(n.above, part) + getattr(n, part))
        if n.level == ALWAYS:
            n.length, n.linked, n.articles = n.length + n.sure_length, n.linked + n.sure_linked, n.articles + n.sure_articles
        if n.in_article:
            n.articles = 0

    def drops(n: Named, article: bool) -> bool:
        links = n.linked > 0.5 * n.length
        share = n.length / total if total else 0.0
        if n.in_article:
            return n.level > WEAK or links
        if n.articles and (n.level == WEAK or article and n.articles >= MINOR * total):
            return False
        if n.level == ALWAYS:
            return True
        return links or share < (DOMINANT if n.level == STRONG else MINOR)

    for n in named:
        n.drops_text = drops(n, False) or n.above is not None and n.above.drops_text
        n.drops_article = drops(n, True) or n.above is not None and n.above.drops_article
    for block in open_blocks:
        node = block.node
        if node.named is not None:
            node.skipped = node.named.drops_article if node.article is not None else node.named.drops_text


def parse(page: str, path: str | None = None) -> list[Block]:
    """The text blocks of a page, in order, with the elements they stand in, those along ``path``
    marked as chosen."""
    wanted = path.split(">")[1:] if path else []
    root = Node("", "", False, None, matched=0 if wanted else -1)
    stack = [root]
    open_tags: Counter = Counter()
    named_elements: list[Named] = []
    blocks: list[Block] = []
    current: Block | None = None
    links = count = 0
    at = 0
    raw_end: str | None = None
    size = len(page)

    def text(piece: str) -> None:
        nonlocal current
        if not piece:
            return
        if current is None:
            if piece.isspace():
                return
            current = Block(stack[-1])
            blocks.append(current)
        current.pieces.append(piece)
        if links:
            current.linked += len(piece)

    while at < size:
        if raw_end is not None:
            # Raw elements end at their own closing tag only.
            m = re.compile(rf"</{raw_end}(?=[\s>/]|$)", re.I).search(page, at)
            at = m.start() if m else size
            raw_end = None
            continue
        m = TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        token = m[0]
        named = TAG.match(token)
        if named is None:
            continue
        tag = named[1].lower()
        closing = token[1] == "/"
        if tag in BLOCKS or tag in SKIPPED:
            current = None
        if tag == "br":
            text(" ")
            continue
        if closing:
            if tag == "a":
                links = max(0, links - 1)
            if not open_tags[tag]:
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    open_tags.subtract(node.tag for node in stack[i:])
                    del stack[i:]
                    break
                # A closing tag inside a cell does not end what is around the table.
                if stack[i].tag in ("td", "th") and tag not in ("tr", "table", "tbody", "thead", "tfoot", "body", "html"):
                    break
            continue
        if tag == "a":
            links = 1
        if tag not in BLOCKS and tag not in SKIPPED:
            if tag in RAW:
                raw_end = tag
            continue
        if tag in CLOSES_P and stack[-1].tag == "p":
            open_tags[stack.pop().tag] -= 1
        if tag == "li" and stack[-1].tag == "li" or tag in ("dt", "dd") and stack[-1].tag in ("dt", "dd"):
            open_tags[stack.pop().tag] -= 1
        if tag in VOID or (token.endswith("/>") and tag in ("svg", "math")):
            continue
        parent = stack[-1]
        article = parent.article
        skipped = parent.skipped or tag in SKIPPED or is_comments(tag, token)
        level = 0 if skipped else boilerplate_level(tag, token, names_of(token), article is not None)
        named_by = parent.named
        if level:
            named_by = Named(level, article is not None, parent.named)
            named_elements.append(named_by)
        count += 1
        node = Node(tag, "", skipped, parent, article, named_by, parent.container, parent.matched, parent.chosen, count)
        if tag in CONTAINERS:
            kind = class_of(token)
            node.step = f"{tag}.{kind}" if kind else tag
            node.container, node.own, node.whole = node, Prose(), Prose()
            on_path = 0 <= parent.matched < len(wanted) and wanted[parent.matched] == node.step
            node.matched = parent.matched + 1 if on_path else -1
            node.chosen = node.chosen or on_path and node.matched == len(wanted)
        if article is None and tag in ("article", "main") and not skipped:
            node.article = node
        open_tags[tag] += 1
        stack.append(node)
        links = 0
        if tag in RAW:
            raw_end = tag
    judge(blocks, named_elements)
    return blocks


def clean(block: Block) -> str:
    """The text of a block: references decoded, white space as single blanks."""
    return " ".join(html.unescape("".join(block.pieces)).split())


def best_container(blocks: list[Block]) -> tuple[Node, float] | None:
    """The container of the text and its score; inside an article or main element, that element.

    It is the container with the highest score, or one around it that holds more of the text.
    """
    found: dict[int, Node] = {}
    for block in blocks:
        own = block.node.container
        if block.node.skipped or own is None:
            continue
        length = sum(map(len, block.pieces))
        value = length - 0.9 * block.linked
        if block.node.named is not None and block.node.article is None:
            value *= 0.5
        own.own.add(Prose(length, block.linked, block.node.tag in ("h1", "h2")))
        own.score += value
        node: Node | None = own
        while node is not None and id(node) not in found:
            found[id(node)] = node
            node = node.parent.container
        if own.parent.container is not None:
            own.parent.container.score += 0.5 * value
    if not found:
        return None
    ordered = sorted(found.values(), key=lambda node: node.number)
    best = max(ordered, key=lambda node: node.score)
    return (best.article or widened(best, ordered)), best.score


def widened(best: Node, containers: list[Node]) -> Node:
    """The outermost container to reach from ``best`` through ones that hold more of its text.

    One around it does if it has text of its own, or further containers with prose of
    ``MORE_PROSE`` of what stands in it so far. The body of a page, which also holds what is
    around the text, needs a heading or that share. ``containers`` go from the outside in.
    """
    around: list[Node] = []
    node: Node | None = best
    while node is not None:
        around.append(node)
        node = node.parent.container
    leading = set(map(id, around))
    beside = dict.fromkeys(leading, 0.0)
    for node in reversed(containers):
        node.whole.add(node.own)
        above = node.parent.container
        if above is not None:
            above.whole.add(node.whole)
            if id(above) in leading and id(node) not in leading:
                beside[id(above)] += node.whole.value()
    inside, chosen = best.own.value() + beside[id(best)], best
    for node in around[1:]:
        direct = node.own.length - node.own.linked
        more = direct + beside[id(node)]
        if more > 0 and more >= MORE_PROSE * inside or direct > 0 and (node.tag != "body" or node.own.heading):
            chosen = node
        inside += more
    return chosen


def below(node: Node, top: Node, known: dict[int, bool]) -> bool:
    """Whether ``node`` stands in ``top``; ``known`` keeps the answers, so each element is passed once."""
    way = []
    at: Node | None = node
    while at is not None and at is not top and id(at) not in known:
        way.append(at)
        at = at.parent
    answer = at is top or at is not None and known[id(at)]
    known.update((id(n), answer) for n in way)
    return answer


def extract(page: str, path: str | None) -> str:
    """The text along ``path``, or in the page's own best container if nothing stands there."""
    blocks = [b for b in parse(page, path) if not b.node.skipped]
    chosen = [b for b in blocks if b.node.chosen]
    if not chosen:
        best = best_container(blocks)
        if best is not None:
            known: dict[int, bool] = {}
            chosen = [b for b in blocks if below(b.node, best[0], known)]
        else:
            # Text outside any container, as in a fragment.
            chosen = blocks
    return "\n".join(t for b in chosen if (t := clean(b)))


def vote(page: str) -> tuple[str | None, float]:
    best = best_container(parse(page))
    if best is None:
        return None, 0.0
    steps, node = [], best[0]
    while node is not None:
        steps.append(node.step)
        node = node.parent.container
    return "".join(f">{step}" for step in reversed(steps)), best[1]


def host_of(url: F.Column) -> F.Column:
    """Host of an address in lower case; the empty string without one."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def winning_paths(pages: DataFrame) -> DataFrame:
    """host and path: the path with the most votes, then the highest score, of every host."""

    def work(rows: dict[str, list]) -> dict[str, list]:
        votes = [vote(page) for page in rows["html"]]
        return {"host": rows["host"], "path": [p for p, _ in votes], "score": [s for _, s in votes]}

    chosen = pages.select("host", "html")
    votes = map_rows(chosen, work, "host string, path string, score double").where("path IS NOT NULL")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum(F.floor("score")).alias("score"))
    return counted.groupBy("host").agg(F.max_by("path", F.struct("votes", "score", "path")).alias("path"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``.

    A null html is empty and gives an empty text; rows without a host vote together. Repeated
    rows and null ids stay; an empty table gives an empty result.
    """
    ready = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    # One row per host, written first, so that the join knows its size when it is planned.
    paths = staged(winning_paths(ready), "host-paths")
    joined = ready.join(paths, "host", "left").select("page_id", "url", "html", "path")
    kind = pages.schema["page_id"].dataType.simpleString()

    def work(rows: dict[str, list]) -> dict[str, list]:
        texts = [extract(page, path) for page, path in zip(rows["html"], rows["path"], strict=True)]
        return {"page_id": rows["page_id"], "url": rows["url"], "text": texts, "n_chars": list(map(len, texts))}

    return map_rows(joined, work, f"page_id {kind}, url string, text string, n_chars long")
