"""Pages as rows of text blocks: a forgiving reader of HTML that keeps where in the page each block stands.

It goes through the page once and keeps a stack of open elements, with the implied ends that pages rely on (a new
paragraph ends the one before, a list entry the entry before). Its work is in proportion to the page.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

# Elements of HTML by what they mean for text.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody "
    "td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("head script style template svg math canvas audio video object select button datalist map".split())
IN_HEAD = frozenset("title meta link script style base noscript template head html".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an open element of the left is ended by, up to the elements on the right.
ENDED_BY = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
            "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
            "tbody": ({"tbody", "thead", "tfoot", "tr"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
            "tfoot": ({"tbody", "thead", "tfoot", "tr"}, {"table"}), "a": ({"a"}, {"table", "td"})}

#: Regions of a page, as bits.
ARTICLE, NAV, HEADER, FOOTER, ASIDE, FORM, ADVERT, NOTICE, COMMENT, RELATED = (1 << i for i in range(10))
OUTSIDE = NAV | HEADER | FOOTER | ASIDE | FORM | ADVERT | NOTICE | COMMENT | RELATED
BY_TAG = {"article": ARTICLE, "main": ARTICLE, "nav": NAV, "menu": NAV, "header": HEADER, "footer": FOOTER, "aside": ASIDE,
          "form": FORM, "dialog": NOTICE}
BY_ROLE = {"navigation": NAV, "menu": NAV, "menubar": NAV, "banner": HEADER, "contentinfo": FOOTER, "complementary": ASIDE,
           "form": FORM, "search": FORM, "main": ARTICLE, "article": ARTICLE, "dialog": NOTICE, "alertdialog": NOTICE,
           "alert": NOTICE}
#: Parts of class names and ids, split at anything but letters and digits.
BY_WORD = {
    NAV: "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc",
    HEADER: "masthead topbar",
    FOOTER: "footer copyright colophon",
    ASIDE: "sidebar aside widget rail",
    FORM: "login signin signup search searchbox contactform",
    ADVERT: "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner",
    NOTICE: "cookie cookies consent gdpr notice popup modal overlay newsletter subscribe paywall alert disclaimer",
    COMMENT: "comment comments respond disqus replies discussion",
    RELATED: "related recommended recommendations share sharing social teaser teasers trending popular",
    ARTICLE: "article articlebody post entry story maincontent",
}
WORDS = {w: bit for bit, words in BY_WORD.items() for w in words.split()}
#: What a class only says about the page around the element.
ABOUT = frozenset("has with without no is".split())

TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
END_OF_RAW = {name: re.compile(rf"</{name}(?=[\s/>]|$)", re.I) for name in RAW}


@dataclass(slots=True)
class Block:
    """``near`` is the number of elements between this block and the one before; ``parent`` the element it stands in."""
    text: str
    linked: int
    tag: str
    region: int
    parent: int
    near: int


def _hints(attributes: str) -> int:
    region = 0
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        value = (a or b or c).lower()
        if name.lower() == "role":
            region |= BY_ROLE.get(value.strip(), 0)
        elif name.lower() == "itemprop":
            region |= ARTICLE if value == "articlebody" else 0
        else:
            for part in value.split():
                words = re.split(r"[^a-z0-9]+", part)
                if words[0] not in ABOUT:
                    for word in words:
                        region |= WORDS.get(word, 0)
    return region


def read(html: str) -> list[Block]:
    """The blocks of a page that hold text, in order: references decoded, white space turned into one space."""
    out: list[Block] = []
    # An open element: name, region, whether its text is unseen, whether it is a link, its number.
    stack: list[tuple[str, int, bool, bool, int]] = [("", 0, False, False, 0)]
    open_at: dict[str, list[int]] = {}
    pieces: list[str] = []
    links: list[str] = []
    holder = stack[0], stack[0]
    count, last_depth, lowest = 0, 0, 0

    def finish() -> None:
        nonlocal last_depth, lowest
        text = " ".join("".join(pieces).split())
        if text:
            depth = len(stack)
            low = min(lowest, depth)
            out.append(Block(text, len(" ".join("".join(links).split())), holder[0][0], holder[0][1], holder[1][4],
                             last_depth - low + depth - low))
            last_depth = lowest = depth
        pieces.clear()
        links.clear()

    def close(down_to: int) -> None:
        nonlocal lowest
        while len(stack) > down_to:
            open_at[stack.pop()[0]].pop()
        lowest = min(lowest, len(stack))

    def say(chunk: str) -> None:
        nonlocal holder
        top = stack[-1]
        if top[2] or not chunk:
            return
        if "&" in chunk:
            chunk = unescape(chunk)
        if not pieces:
            at = len(stack) - 1
            while at and stack[at][0] not in BLOCK:
                at -= 1
            holder = stack[at], stack[max(at - 1, 0)]
        pieces.append(chunk)
        if top[3]:
            links.append(chunk)

    at, size = 0, len(html)
    while at < size:
        mark = html.find("<", at)
        if mark < 0:
            say(html[at:])
            break
        say(html[at:mark])
        following = html[mark + 1:mark + 2]
        if following == "!" or following == "?":
            if html.startswith("<!--", mark):
                end = html.find("-->", mark + 2)
                at = size if end < 0 else end + 3
            else:
                end = html.find(">", mark)
                at = size if end < 0 else end + 1
            continue
        match = TAG.match(html, mark) or LOOSE.match(html, mark)
        if not match:
            name = html[mark + 1:mark + 3].lstrip("/")
            if name[:1].isalpha() and name[:1].isascii():  # the page ends within a tag
                break
            say("<")
            at = mark + 1
            continue
        at = match.end()
        name = match[2].lower()
        if match[1]:
            if name in BLOCK:
                finish()
            places = open_at.get(name)
            if places:
                place = places[-1]
                if name in BLOCK or all(stack[i][0] not in BLOCK for i in range(place + 1, len(stack))):
                    close(place)
            continue
        if name in BLOCK:
            finish()
            places = open_at.get("p")
            if places and name not in ("html", "head", "body"):
                close(places[-1])
        elif name == "br":
            say(" ")
        if open_at.get("head") and name not in IN_HEAD:
            close(open_at["head"][-1])
        if name in ENDED_BY:
            ended, bounds = ENDED_BY[name]
            floor = max((open_at[b][-1] for b in bounds if open_at.get(b)), default=0)
            firsts = [open_at[e][-1] for e in ended if open_at.get(e) and open_at[e][-1] > floor]
            if firsts:
                close(min(firsts))
        if name in RAW:
            end = END_OF_RAW[name].search(html, at)
            at = end.start() if end else size
            continue
        if name in VOID:
            continue
        _, region, unseen, link, _ = stack[-1]
        if name in ("article", "main"):  # what classes around an article say is not about it
            region &= NAV | FOOTER | ASIDE | COMMENT
        if name in BY_TAG and not (name == "header" and region & ARTICLE):
            region |= BY_TAG[name]
        if match[3] and name not in ("html", "body"):
            region |= _hints(match[3])
        count += 1
        open_at.setdefault(name, []).append(len(stack))
        stack.append((name, region, unseen or name in UNSEEN, link or name == "a", count))
    finish()
    return out
