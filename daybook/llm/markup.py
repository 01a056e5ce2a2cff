"""Tokens of a web page: tags and runs of text, each with the place it stands in.

A token's key is a hash of the path of elements above it and of itself, so the same word or tag in
two places is two tokens. Elements left open are closed as browsers do for the common cases
(a new paragraph, list item or cell ends the last one); a closing tag without its opening is
ignored. Comments, declarations, and the contents of scripts and styles are not tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import xxhash

# Element names and attribute words with a known part in a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript iframe textarea title xmp noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol "
    "optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Opening one of these ends an open paragraph.
ENDS_PARAGRAPH = BLOCK - set("br button caption option optgroup legend summary title".split())
#: Opening the first ends an open one of the second, up to the third.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
ASIDE_ELEMENTS = set(
    "aside button dialog footer head input label menu nav object select svg template".split()
)
ASIDE_WORDS = set(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice "
    "notices pager pagination popup promo promoted promotion recommended related replies respond share sharing "
    "sidebar signup social sponsor sponsored subscribe toolbar topbar widget".split()
)
ASIDE_ROLES = set("banner complementary contentinfo dialog alert form menu menubar navigation search".split())
#: Words that only say whether another part of the page has the word after them.
ABOUT_OTHERS = set("has hide is no with without".split())
ARTICLE_LABELS = set(
    "article articlebody article-body article-content article-text blog-post content-body entry-content "
    "post-body post-content story-body story-content".split()
)
MAIN_LABELS = set("content main main-content maincontent page-content primary-content site-content".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SHUT = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for name in RAW}
_DIGITS = re.compile(r"\d+")

HARD, FORM = 1, 2
CLOSING = 1 << 62


@dataclass(slots=True)
class Token:
    """One token: key, name (empty for text), text, and what the elements above it say.

    ``aside`` is set inside a part that is not the article, ``rank`` is 2 inside an article, 1
    inside the main part, else 0; ``opens`` is the rank that the tag itself opens.
    """

    key: int
    name: str
    text: str
    aside: bool
    rank: int
    link: bool
    opens: int


@dataclass(slots=True)
class _Element:
    name: str
    key: int
    aside: int
    rank: int
    link: bool


def _hash(parent: int, label: str) -> int:
    return xxhash.xxh64_intdigest(label, parent) >> 2


def _read(name: str, rest: str, above: _Element) -> tuple[str, int, int]:
    """Label of a tag, whether it begins a part that is not the article, and its rank."""
    label, aside, rank = name, HARD if name in ASIDE_ELEMENTS else 0, {"article": 2, "main": 1}.get(name, 0)
    if name == "form":
        aside = FORM
    if name == "header" and above.rank < 2:
        aside = HARD
    if not rest:
        return label, aside, rank
    for kind, *values in _ATTRIBUTE.findall(rest):
        kind, value = kind.lower(), next((v for v in values if v), "")
        if kind == "hidden" or (kind == "aria-hidden" and value.lower() == "true"):
            aside = HARD
        elif kind == "role":
            aside = aside or (HARD if value.lower() in ASIDE_ROLES else 0)
            rank = max(rank, {"main": 1, "article": 2}.get(value.lower(), 0))
        elif kind == "itemprop":
            rank = max(rank, 2 if value.lower() == "articlebody" else 0)
        elif kind in ("class", "id"):
            label += f" {kind}={_DIGITS.sub('#', value)}"
            for part in value.split():
                plain = part.lower().replace("_", "-")
                rank = max(rank, 2 if plain in ARTICLE_LABELS else 1 if plain in MAIN_LABELS else 0)
                words = [w.lower() for w in _WORD.findall(part)]
                if name == "article":
                    words = words[:1]  # the others tell what it is about
                for word, last in zip(words, ["", *words]):
                    header = word == "header" and above.rank < 2
                    if (word in ASIDE_WORDS or header) and last not in ABOUT_OTHERS:
                        aside = aside if name in ("html", "body", "main") else HARD
    return label, aside, 0 if aside else rank


def _close(stack: list[_Element], names: set[str], until: set[str] = frozenset()) -> _Element | None:
    """Remove the last element of these names and all above it, unless one of ``until`` lies between."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].name in names:
            found = stack[i]
            del stack[i:]
            return found
        if stack[i].name in until:
            return None
    return None


def tokens(html: str) -> Iterator[Token]:
    """All tokens of a page in order."""
    stack, at, end, search = [_Element("", 0, 0, 0, False)], 0, len(html), _TOKEN.search
    while at < end:
        found = search(html, at)
        cut = found.start() if found else end
        if cut > at:
            top, text = stack[-1], html[at:cut]
            text = unescape(text) if "&" in text else text
            plain = text.split()
            key = _hash(top.key, " ".join(["text", *plain])) if plain else 0
            yield Token(key, "", text, bool(top.aside), top.rank, top.link, 0)
        if not found:
            return
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if found[1]:
            gone = _close(stack, {name})
            top = stack[-1]
            yield Token(gone.key | CLOSING if gone else 0, name, "", bool(top.aside), top.rank, top.link, 0)
            continue
        if name in ENDS_PARAGRAPH:
            _close(stack, {"p"}, BLOCK - {"p"})
        if name in ENDS:
            names, until = ENDS[name]
            while _close(stack, names, until):
                pass
        top = stack[-1]
        label, aside, rank = _read(name, found[3], top)
        key = _hash(top.key, label)
        inside = (top.aside & ~FORM if rank == 2 else top.aside) | aside
        made = _Element(name, key, inside, max(top.rank, rank), top.link or name == "a")
        yield Token(key, name, "", bool(made.aside), made.rank, made.link, 0 if made.aside else rank)
        if name in RAW:
            shut = _SHUT[name].search(html, at)
            at = shut.end() if shut else end
        elif name not in VOID:
            stack.append(made)
