"""Main text of web pages by tag-path ratios.

For each page: every text block has the path of its block-level tags from the
root.  Text length and punctuation are summed by path and divided by the
number of blocks with that path; both ratios are smoothed over the paths in
page order (near paths weigh more) and fused into one score.  Paths whose
score passes a threshold are content.  The smallest container that holds the
content paths, or the articles if they do, is then entered; in it the blocks of
all paths above a second, lower threshold stay, so short paragraphs of an
article are kept and lists of links are not.

Parts that HTML itself marks as no article text (menus, page footers, asides,
scripts, styles, hidden parts) are left out before the ratios are taken.  Names
of classes and ids are only hints: an element named as a notice, advert,
sidebar, comments and so on goes only if the page's text does not hang on it,
so no word of a name can empty a page, and in an article names that can also be
those of a chapter (discussion, related, search) do not count against sentences.

One page is one row; a map without shuffle.  A page is scanned once, and
elements and paths are kept as numbers, so time and memory follow its length.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from sceneline.llm.common import map_texts

#: A path is content from this share of the best path's score on; within the container from LOW on.
SHARE, LOW = 0.1, 0.001
#: Spread of the smoothing, in paths.
SIGMA = 1.0
#: A container is entered while one child holds this share of the content.
HOLD = 0.85
#: What stands beside the container is entered too if a path that is content has a block of so many characters there, unlinked and punctuated.
BESIDE = 40
#: A list of links in an article is text if its items are so long, or half of them punctuated, or a heading stands before it.
LONG_LINK = 24
#: A name that stands on this share of the page's text is no hint; an element is not dropped if less than LEFT would be left.
MUCH, LEFT = 0.5, 0.1

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math mfrac mi mn mo mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: The text up to the end tag is no markup.
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_OUT = frozenset("nav footer aside head button dialog menu datalist legend applet map noscript template svg object canvas audio video select".split())
#: Left out as a rule, but they can also be around a whole page.
_SOFT = frozenset("form fieldset".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: What an opening tag ends, and the tags at which the search stops.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "body": ({"head"}, {"html"}),
}
_CONTAINERS = frozenset("html body div main article section center td tr tbody table form".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
_HINTS = re.compile(
    r"^(?:ads?|adbox|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|cookies?|consent|gdpr|notices?|alerts?|popup|popover|modal|overlay|newsletter|subscri\w*|"
    r"sidebar\w*|aside|menus?|nav|navbar|navigation|navs?|breadcrumbs?|footer|foot|masthead|topbar|comments?|commentlist|discussion|disqus|repl(?:y|ies)|respond|responses|"
    r"shar(?:e|ing)|social|related|recommend\w*|widgets?|toolbar|pager|pagination|login|signin|signup|register|search|searchbox|copyright|legal|disclaimer|skip|"
    r"header|topheader|pageheader|siteheader)$"
)
#: Names that a chapter of an article can have as well.
_CHAPTERS = frozenset("discussion related search legal register respond responses recommend recommended recommendation recommendations disclaimer copyright widget widgets skip overlay foot menu menus signup alert alerts".split())
#: Headings of lists of links that are no part of an article.
_MORE = re.compile(r"^(?:related|more|read|see also|share|follow|tags?|topics?|categories|recommended|popular|trending|latest|next|previous|menu|navigation|comments?|sponsored|you (?:may|might))\b", re.I)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_HEADS = re.compile(r"^(?:\w*header|masthead|topbar|banner\w*)$")
#: A hint after one of these, or before one of those, tells of the state of the page, not what the element is.
_STATE_BEFORE = frozenset("no not non has have having with without is are can hide show open close js enable disable supports".split())
_STATE_AFTER = frozenset("on off enabled disabled active open closed true false loaded ready none".split())
#: A header of these is part of the article.
_OF_ARTICLE = frozenset("post article entry story content section title single".split())
#: Words that leave a name as plain as it was.
_PLAIN = re.compile(r"^(?:area|list|box|section|wrap|wrapper|container|block|bar|item|items|body|panel|left|right|top|bottom|site|page|global|inner|outer|form|links?|title|text|main|primary|secondary|slot|unit|zone|the|div|\d+|[a-z])$")

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_REST = re.compile(r"([^>=]*+(?:=\s*+(?:\"[^\"]*+\"|'[^']*+')?+[^>=]*+)*+)>")
_ATTR = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
#: The end of a comment; one that is opened and closed at once has no text.
_COMMENT_END = re.compile(r"--!?>")
_PUNCT = re.compile(r"[.,;:!?。，、；：！？…]")


def hints(name: str) -> list[tuple[str, bool, bool]]:
    """Of a class or id attribute: (token, whether the token says nothing else, whether it names a header) of each token that hints at no article text."""
    out = []
    for token in name.split():
        words = [w for w in re.split(r"[^a-z0-9]+", token) if w]
        for i, w in enumerate(words):
            if not _HINTS.match(w) or _STATE_BEFORE.intersection(words[:i]) or words[-1] in _STATE_AFTER:
                continue
            head = bool(_HEADS.match(w))
            if head and _OF_ARTICLE.intersection(words):
                continue
            out.append((token, all(_HINTS.match(v) or _PLAIN.match(v) for v in words), head))
            break
    return out


def marks(tag: str, attrs: str) -> tuple[bool, list[tuple[str, bool, bool]]]:
    """Whether an element is hidden or has a role that is no article text, and the hints of its names."""
    if not attrs or tag in ("html", "body"):
        return False, []
    if _HIDDEN.search(attrs.lower()):
        return True, []
    found = []
    for m in _ATTR.finditer(attrs):
        name, given = m[1].lower(), m[2] or m[3] or m[4] or ""
        value = given.lower()
        if name == "role" and value in _ROLES or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, []
        if name in ("class", "id"):
            found += hints(_CAMEL.sub("-", given).lower())
    return False, found


@dataclass
class Page:
    """What a scan of a page finds.

    Elements and paths are numbers; ``parent`` of an element, and ``above`` of a path, is smaller
    than itself.  Blocks are (text, path, element, punctuation, link characters).
    """

    parent: list[int] = field(default_factory=lambda: [0])
    tags: list[str] = field(default_factory=lambda: [""])
    named: dict[int, list[tuple[str, bool, bool]]] = field(default_factory=dict)
    above: list[int] = field(default_factory=lambda: [0])
    depth: list[int] = field(default_factory=lambda: [0])
    paths: dict[tuple[int, str], int] = field(default_factory=dict)
    blocks: list[tuple[str, int, int, int, int]] = field(default_factory=list)

    def path(self, above: int, tag: str) -> int:
        p = self.paths.setdefault((above, tag), len(self.above))
        if p == len(self.above):
            self.above.append(above)
            self.depth.append(self.depth[above] + 1)
        return p


def scan(page: str) -> Page:
    """The blocks that may be article text, in one pass over the page."""
    out = Page()
    # Of each open element: tag, path, element, left out for sure, within article or main, whether text ends with it.
    stack: list[tuple[str, int, int, bool, bool, bool]] = [("", 0, 0, False, False, True)]
    opened: Counter[str] = Counter()
    pieces: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            if text := " ".join("".join(pieces).split()):
                out.blocks.append((text, stack[-1][1], stack[-1][2], len(_PUNCT.findall(text)), linked))
            pieces.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not stack[-1][3]:
            text = html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if opened["a"]:
                linked += len(text)

    def pop_to(k: int) -> None:
        if any(t[5] for t in stack[k:]):
            flush()
        opened.subtract(t[0] for t in stack[k:])
        del stack[k:]

    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        nxt = page[lt + 1 : lt + 2]
        m = _NAME.match(page, lt + 1)
        if not m and nxt not in ("!", "?", "/"):  # a plain character
            add(page[at : lt + 1])
            at = lt + 1
            continue
        add(page[at:lt])
        if not m:
            if page.startswith(("<!-->", "<!--->"), lt):
                at = page.index(">", lt) + 1
            elif page.startswith("<!--", lt):
                end = _COMMENT_END.search(page, lt + 4)
                at = end.end() if end else size
            else:
                at = page.find(">", lt) + 1 or size
            continue
        tag = m[1].lower()
        rest = _REST.match(page, m.end())
        if not rest:  # no end of the tag in the page
            break
        at, attrs = rest.end(), rest[1]
        if nxt == "/":
            if opened[tag] > 0:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        pop_to(k)
                        break
                    if tag in _INLINE and stack[k][0] not in _INLINE:
                        break
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in _VOID:
            if tag in ("br", "hr"):
                flush()
            continue
        if tag == "svg" and attrs.endswith("/"):
            continue
        if tag in _CLOSES_P and opened["p"] > 0:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    pop_to(k)
                    break
                if stack[k][0] not in _INLINE:
                    break
        if tag in _ENDS:
            ended, stop = _ENDS[tag]
            low = 0
            if any(opened[t] > 0 for t in ended):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in ended:
                        low = k
                    elif low or stack[k][0] in stop:
                        break
            if low:
                pop_to(low)
        _, path, element, left_out, inside, _ = stack[-1]
        inline = tag in _INLINE
        hidden, found = marks(tag, attrs) if not left_out and (not inline or tag == "span") else (False, [])
        hidden = hidden or tag in _OUT
        ends = not inline or hidden or bool(found)
        if ends:
            flush()
            if not left_out and not hidden:
                out.parent.append(element)
                out.tags.append(tag)
                element = len(out.tags) - 1
                if tag == "header" and not inside:
                    found = [*found, ("<header>", True, True)]
                elif tag in _SOFT:
                    found = [*found, (f"<{tag}>", False, False)]
                if found:
                    out.named[element] = found
            if not inline:
                path = out.path(path, tag)
        opened[tag] += 1
        stack.append((tag, path, element, left_out or hidden, inside or tag in ("article", "main"), ends))
    flush()
    return out


def dropped(page: Page) -> list[bool]:
    """Elements that are no article text by their names, or within such."""
    n = len(page.tags)
    weight, articles, titles, mains, sentences = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for text, _, e, punct, linked in page.blocks:
        weight[e] += max(0, len(text) - linked)
        sentences[e] += punct > 0 and len(text) - linked >= BESIDE
    for e, tag in enumerate(page.tags):
        articles[e], titles[e], mains[e] = tag == "article" and e not in page.named, tag == "h1", tag == "main"
    for e in range(n - 1, 0, -1):
        for sums in (weight, articles, titles, mains, sentences):
            sums[page.parent[e]] += sums[e]
    total = weight[0]
    last = list(range(n))  # the last element within each
    for e in range(n - 1, 0, -1):
        last[page.parent[e]] = max(last[page.parent[e]], last[e])
    # A name counts for the outermost elements that have it.
    by_name: Counter[str] = Counter()
    ends: dict[str, int] = {}
    for e, found in page.named.items():  # in page order
        for token in {token for token, _, _ in found}:
            if e > ends.get(token, -1):
                by_name[token] += weight[e]
                ends[token] = last[e]
    out, within = [False] * n, [False] * n
    for e in range(1, n):
        out[e] = out[page.parent[e]]
        within[e] = within[page.parent[e]] or page.tags[page.parent[e]] in ("article", "main") and page.parent[e] not in page.named
        for token, plain, head in () if out[e] else page.named.get(e, ()):
            if within[e] and sentences[e] and not _CHAPTERS.isdisjoint(re.split(r"[^a-z0-9]+", token)):
                continue  # a chapter of an article
            around = mains[e] or articles[e] and not (plain and not head)
            if plain:
                around = around or titles[e] and not head
                alone = weight[e] > (1 - LEFT) * total and titles[0] == titles[e] and articles[0] == articles[e]
                out[e] = not (around or alone)
            else:
                out[e] = not (around or titles[e] or by_name[token] >= MUCH * total)
            if out[e]:
                break
    return out


def scores(page: Page, blocks: list[tuple[str, int, int, int, int]]) -> dict[int, float]:
    """The smoothed and fused ratios of each path."""
    sums: dict[int, list[int]] = {}
    for text, path, _, punct, linked in blocks:
        s = sums.setdefault(path, [0, 0, 0])
        s[0] += max(0, len(text) - linked)
        s[1] += punct if linked * 2 < len(text) else 0
        s[2] += 1
    paths = list(sums)
    ratios = [(t / n, q / n) for t, q, n in sums.values()]

    def common(a: int, b: int) -> int:
        while a != b:
            if page.depth[a] >= page.depth[b]:
                a = page.above[a]
            else:
                b = page.above[b]
        return page.depth[a]

    out = {}
    for i, a in enumerate(paths):
        total = text = punct = 0.0
        for j in range(max(0, i - 2), min(len(paths), i + 3)):
            w = 1.0 if i == j else 0.5 * common(a, paths[j]) / max(1, page.depth[a], page.depth[paths[j]])
            w *= 2.718281828 ** (-((i - j) ** 2) / (2 * SIGMA**2))
            total += w
            text += w * ratios[j][0]
            punct += w * ratios[j][1]
        # A path of many blocks and much text is no chance find: the total enters by its fourth root.
        out[a] = (text / total) * (1 + punct / total) ** 0.5 * (1 + sums[a][0]) ** 0.25
    return out


def main_text(source: str | None) -> str:
    """Text of the article of a page; empty for a null or empty page, or one without article text."""
    if not source:
        return ""
    page = scan(source)
    out = dropped(page)
    blocks = [b for b in page.blocks if not out[b[2]]]
    score = scores(page, blocks)
    best = max(score.values(), default=0.0)
    if best <= 0:
        return ""
    n = len(page.tags)
    weight, inside = [0] * n, [False] * n
    for text, path, e, _, linked in blocks:
        if score[path] >= SHARE * best:
            weight[e] += max(1, len(text) - linked)
    for e in range(n - 1, 0, -1):
        weight[page.parent[e]] += weight[e]
    # The articles if they hold the content, else the smallest container that does.
    outer = [False] * n
    held = 0
    for e in range(1, n):
        outer[e] = outer[page.parent[e]] or page.tags[e] in ("article", "main") and not out[e]
        if outer[e] and not outer[page.parent[e]]:
            held += weight[e]
    if held >= HOLD * weight[0]:
        inside = outer
    else:
        at = max((e for e in range(1, n) if page.tags[e] in _CONTAINERS and weight[e] >= HOLD * weight[0]), default=0)
        inside[at] = True
        for e in range(at + 1, n):
            inside[e] = inside[page.parent[e]] or at == 0
    # What stands beside these and has sentences of a content path.
    rooms = {page.parent[e] for e in range(1, n) if inside[e] and not inside[page.parent[e]]}
    branch = [0] * n
    for e in range(1, n):
        branch[e] = branch[page.parent[e]] or (e if page.parent[e] in rooms and not inside[e] else 0)
    beside = {branch[e] for text, path, e, punct, linked in blocks if branch[e] and punct and len(text) - linked >= BESIDE and score[path] >= SHARE * best}
    for e in range(1, n):
        inside[e] = inside[e] or branch[e] in beside
    # A title before the container, if that has none of its own, belongs to it.
    titles = {e for _, _, e, _, linked in blocks if page.tags[e] == "h1" and not linked}
    if len(titles) == 1 and not any(inside[e] and page.tags[e] in ("h1", "h2") for e in range(n)):
        inside[titles.pop()] = True
    links: dict[int, list[int]] = {}
    for text, path, _, punct, linked in blocks:
        s = links.setdefault(path, [0, 0, 0, 0])
        for i, v in enumerate((linked, len(text), 1, punct > 0)):
            s[i] += v
    most = {p for p, s in links.items() if 2 * s[0] > s[1]}  # paths of links
    keep = {p for p, v in score.items() if v >= SHARE * best or v >= LOW * best and p not in most}
    read = {p for p in most if links[p][1] >= LONG_LINK * links[p][2] or 2 * links[p][3] >= links[p][2]}
    out_text, headed = [], False
    for text, path, e, _, _ in blocks:
        if inside[e] and (path in keep or outer[e] and (path in read or headed)):
            out_text.append(text)
        headed = (headed and path in most) or page.tags[e] in _HEADINGS and not _MORE.match(text)
    return " ".join(out_text)


class Extract:
    """For :func:`map_texts`."""

    def __call__(self, pages: list[str | None]):
        found = [main_text(p) for p in pages]
        return found, [len(t) for t in found]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``.

    A null or empty page, or one that is all menus and the like, has an empty text.  Repeated rows
    give repeated results; null ids and urls stay null; other columns are ignored; an empty table
    gives an empty result.  Time and memory are in proportion to the page, whatever its markup.
    """
    keyed = pages.selectExpr("struct(page_id, url) AS page", "html")
    found = map_texts(keyed, Extract(), {"text": "string", "n_chars": "long"}, key="page", text="html", step=64)
    return found.select("page.page_id", "page.url", "text", "n_chars")
