"""HTML extraction by tree scoring.

A page is read into a forgiving tree: an open paragraph ends where a block
begins, items end at the next item, a stray end tag is ignored, and what is open
at the end is closed. Text between block boundaries makes one block. Each block
gives points for its length and commas to its parent, and fewer to further
ancestors; a container's sum is discounted by the share of its text that is in
links. The best container, and its siblings of any length and the text between
them that are not links for the most part, hold the article: all their blocks
are kept in page order but those inside menus, headers, footers, sidebars, notices, adverts, forms and
comments.

Menus and the like are known by their element, or only named by a class, an id,
a role or a form. A name is a hint: it removes no element that holds the page's
main article or most of the points of its paragraphs, since wrappers of whole
pages have such names too, and no heading, paragraph, item or cell, unless it is
named an advert, a comment or the like or is links for the most part. A page is
read in time that grows with its length alone, however broken it is.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .text import tidy

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: What an opening tag ends, up to the nearest of the elements that hold it.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
#: Elements that never hold the article; and elements, roles and words of class and id that seldom do.
LEFT_OUT = frozenset("nav footer aside dialog button select datalist svg annotation object canvas audio video menu".split())
FORMS = frozenset({"form", "fieldset"})
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
WORDS = re.compile(
    r"(?:ad|ads|adv|advert\w*|adbox|banner|breadcrumbs?|comments?|commentlist|consent|cookies?|disclaimer|disqus|footer|gdpr|header|masthead|menu|modal|nav|navbar|"
    r"navigation|newsletter|notice|notices|notification|outbrain|pager|pagination|popup|promo\w*|related|replies|respond|share|sharing|sidebar|social|"
    r"sponsor\w*|subscribe|taboola|toolbar|widget)"
)
#: Words that don't name wrappers: what they name can be longer than the article.
FIRM = re.compile(
    r"comments?|commentlist|disqus|replies|respond|consent|cookies?|gdpr|disclaimer|notices?|notification|newsletter|popup|outbrain|taboola|advert\w*|sponsor\w*"
)
OWN = frozenset({"article", "post", "entry", "story"})
KEPT = frozenset("html body main article".split())
#: Elements of prose, which a name alone does not remove, and the names that do.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption td th caption".split())
SHARP = re.compile(r"ad|ads|adv|adbox|advert\w*|sponsor\w*|comments?|commentlist|replies|respond|disqus|cookies?|consent|gdpr|newsletter|outbrain|taboola")
#: A comment, a declaration, or a tag with its attributes and end, if no quoted value holds a bracket; other ends are found from the quotes of the page.
START = re.compile(r"""<!--|<[!?]|<(/?)([a-zA-Z][^\s/>]*+)(?:((?:[^'"<>]++|"[^"<>]*+"|'[^'<>]*+')*+)>)?""")
MARK = re.compile("[\"'>]")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: Parameters of the scores.
LEAST = 25
#: From this share of links on, what stands beside the article is a menu.
DENSE = 0.5
#: Points of a part of the article whose class is no more than such a word.
PART = 4.0


def left_out(tag: str, attributes: str) -> bool:
    """Whether an element is hidden, or never holds the article."""
    if tag in LEFT_OUT:
        return True
    if tag in KEPT or not attributes:
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def named(tag: str, attributes: str, inside_article: bool) -> str:
    """The first name by which an element seldom holds the article: a part of class or id, a role or a tag; or none."""
    if tag in FORMS:
        return f"<{tag}>"
    if tag == "header" and not inside_article:
        return tag
    for name, *values in ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), "".join(values).lower()
        if name == "role" and value in ROLES:
            return "<form>" if value == "form" else value
        if name in ("class", "id"):
            for part in value.split():
                words = re.split(r"[^a-z0-9]+", part)
                if any(WORDS.fullmatch(w) for w in words) and not (words[-1] in ("header", "banner") and OWN & set(words)):
                    return part
    return ""


def sharp(name: str) -> bool:
    """Whether a name is that of an advert, a comment or the like."""
    return any(SHARP.fullmatch(w) for w in re.split(r"[^a-z0-9]+", name))


class TagEnds:
    """Where tags end on one page, quotes minded: found once for all of its quotes and brackets."""

    def __init__(self, html: str) -> None:
        self.at = [m.start() for m in MARK.finditer(html)]
        self.ends, self.brackets = [-1] * len(self.at), [-1] * len(self.at)
        # read backwards: where a tag ends if read on from here outside quotes, or inside double or single ones
        outside = double = single = bracket = -1
        for i in range(len(self.at) - 1, -1, -1):
            c = html[self.at[i]]
            if c == ">":
                outside = bracket = self.at[i]
            elif c == '"':
                outside, double = double, outside
            else:
                outside, single = single, outside
            self.ends[i], self.brackets[i] = outside, bracket

    def after(self, place: int) -> int:
        """The bracket that ends a tag read on from a place; if quotes never close, the next one; -1 without any."""
        i = bisect_left(self.at, place)
        if i == len(self.at):
            return -1
        return self.ends[i] if self.ends[i] >= 0 else self.brackets[i]


class Tree:
    """Nodes as parallel lists, and the blocks of text with the node that holds each."""

    def __init__(self, html: str) -> None:
        self.tag, self.parent, self.out, self.name, self.holder, self.side = ["#root"], [-1], [False], [""], [0], [0]
        self.blocks: list[tuple[int, str, int, int]] = []  # node, text, characters in links, innermost element
        self._stack, self._links, self._articles = [0], 0, 0
        self._text: list[tuple[int, str, int]] = []  # named element within the line or 0, text, characters in links
        self._depths: dict[str, list[int]] = {}  # places on the stack of the open elements of each tag
        self._read(html)

    def _add(self, raw: str) -> None:
        top = self._stack[-1]
        if not self.out[top]:
            text = unescape(raw) if "&" in raw else raw
            self._text.append((self.side[top], text, len("".join(text.split())) if self._links else 0))

    def _flush(self) -> None:
        """The block so far: one text, and apart from it what stands in named elements at its end, or in adverts.

        What is named otherwise and has text after it in the block is part of its
        sentence.
        """
        parts, self._text = self._text, []
        last = max((i for i, (side, text, _) in enumerate(parts) if not side and text.strip()), default=-1)
        whole: dict[int, list[tuple[str, int]]] = {}
        for i, (side, text, links) in enumerate(parts):
            within = not side or (i < last and not sharp(self.name[side]))
            whole.setdefault(0 if within else side, []).append((text, links))
        top = self._stack[-1]
        for side in sorted(whole):
            text = " ".join("".join(t for t, _ in whole[side]).split())
            if text:
                self.blocks.append((self.holder[side or top], text, sum(n for _, n in whole[side]), side or top))

    def _last(self, tags) -> int:
        """The place on the stack of the innermost open element of some tags; 0 without one."""
        return max((self._depths[t][-1] for t in tags if self._depths.get(t)), default=0)

    def _pop(self, depth: int) -> None:
        """Close the elements from a place of the stack on."""
        if any(self.tag[n] in BLOCK and not self.out[self.parent[n]] for n in self._stack[depth:]):
            self._flush()
        for n in self._stack[depth:]:
            self._depths[self.tag[n]].pop()
            self._links -= self.tag[n] == "a"
            self._articles -= self.tag[n] in ("article", "main")
        del self._stack[depth:]

    def _end(self, names, until) -> None:
        """Close the innermost element of some names, unless it holds an open one of others."""
        depth = self._last(names)
        if depth > self._last(until):
            self._pop(depth)

    def _open(self, tag: str, attributes: str) -> None:
        if tag in BLOCK and not self.out[self._stack[-1]]:
            self._flush()
            self._end(("p",), ("table", "td", "th", "button", "caption", "object", "svg"))
        if tag in ENDS:
            self._end(*ENDS[tag])
        if tag == "a" and self._links:
            self._end(("a",), ("td", "th"))
        top = self._stack[-1]
        out = self.out[top] or left_out(tag, attributes)
        within = tag not in BLOCK
        name = "" if out or (within and self._depths.get("pre")) else named(tag, attributes, self._articles > 0)
        if tag in VOID:
            if tag == "br":
                self._add(" ")
            return
        self.tag.append(tag)
        self.parent.append(top)
        self.out.append(out)
        self.name.append(name)
        self.holder.append(self.holder[top] if within else len(self.tag) - 1)
        self.side.append((self.side[top] or (len(self.tag) - 1 if name else 0)) if within else 0)
        self._depths.setdefault(tag, []).append(len(self._stack))
        self._stack.append(len(self.tag) - 1)
        self._links += tag == "a"
        self._articles += tag in ("article", "main")

    def _read(self, html: str) -> None:
        at, ends = 0, None
        while (m := START.search(html, at)) is not None:
            if m.start() > at:
                self._add(html[at : m.start()])
            at, tag = m.end(), m[2]
            if not tag:  # a comment or declaration; one that never ends hides the rest
                mark = "-->" if m[0] == "<!--" else ">"
                found = html.find(mark, at)
                at = found + len(mark) if found >= 0 else len(html)
                continue
            attributes = m[3]
            if attributes is None:
                ends = ends or TagEnds(html)
                close = ends.after(m.end(2))
                if close < 0:  # no tag ends any more: what looks like one is text
                    hidden = re.compile("<[!?]").search(html, m.start() + 1)
                    self._add(html[m.start() : hidden.start() if hidden else len(html)])
                    at = len(html)
                    break
                attributes, at = html[m.end(2) : close], close + 1
            tag = tag.lower()
            if m[1]:
                if tag == "br":
                    self._add(" ")
                depth = self._last((tag,))
                if depth > (0 if tag in BLOCK else self._last(("td", "th", "table"))):
                    self._pop(depth)
                continue
            if tag in RAW:
                close = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, m.start() + 1)
                at = close.end() if close else len(html)
                continue
            self._open(tag, attributes)
        if at < len(html):
            self._add(html[at:])
        self._pop(1)
        self._flush()


def points(text: str) -> float:
    return 1 + text.count(",") + min(len(text) / 100, 3) if len(text) >= LEAST else 0.0


def dropped(tree: Tree) -> list[bool]:
    """Whether an element is inside one that its name leaves out."""
    n, tag, parent, name = len(tree.tag), tree.tag, tree.parent, tree.name
    marked = [bool(name[i]) and tag[i] not in KEPT for i in range(n)]
    if not any(marked):
        return marked
    own, size, linked, plain = [0.0] * n, [0] * n, [0] * n, 0.0
    under = marked[:]
    for i in range(1, n):
        under[i] |= under[parent[i]]
    for _, text, links, at in tree.blocks:
        long = len(text) - text.count(" ")
        gain = points(text) * (1 - min(1.0, links / long))
        own[at] += gain
        size[at] += long
        linked[at] += links
        plain += 0.0 if under[at] else gain
    for i in range(n - 1, 0, -1):
        own[parent[i]] += own[i]
        size[parent[i]] += size[i]
        linked[parent[i]] += linked[i]
    # the main element, and its longest article or the page's; one that only named elements hold must outweigh the rest
    most = max((i for i in range(n) if tag[i] == "main" and size[i]), key=lambda i: (size[i], -i), default=0)
    inside = [i == most for i in range(n)]
    for i in range(1, n):
        inside[i] |= inside[parent[i]]
    articles = (i for i in range(n) if tag[i] == "article" and size[i] and inside[i] and not name[i] and (most or not under[i] or own[i] >= plain))
    anchors = {i for i in (most, max(articles, key=lambda i: (size[i], -i), default=0)) if i}
    holds, within = [i in anchors for i in range(n)], [i in anchors for i in range(n)]
    for i in range(n - 1, 0, -1):
        holds[parent[i]] |= holds[i]
    together: dict[str, float] = {}  # points of the outermost elements of each name
    path, names = [0], Counter()  # the elements that hold the next one, and their names
    for i in range(1, n):
        within[i] |= within[parent[i]]
        while path[-1] != parent[i]:
            names[name[path.pop()]] -= 1
        if marked[i] and not names[name[i]]:
            together[name[i]] = together.get(name[i], 0.0) + own[i]
        path.append(i)
        names[name[i]] += 1
    for i in range(1, n):
        if marked[i]:
            words = re.split(r"[^a-z0-9]+", name[i])
            exact = WORDS.fullmatch(name[i]) or name[i] in ROLES
            if tag[i] in PROSE and not sharp(name[i]):
                keep = linked[i] < DENSE * size[i]
            elif any(FIRM.fullmatch(w) for w in words):
                keep = not anchors and 0 < own[0] == own[i]
            elif exact:
                keep = own[i] > own[0] / 2 and (not anchors or (within[i] and own[i] >= PART))
            else:
                keep = together.get(name[i], 0.0) > own[0] / 2 or (within[i] and own[i] >= PART)
            marked[i] = not (keep or holds[i])
        marked[i] |= marked[parent[i]]
    return marked


def extract(html: str | None) -> str:
    """The blocks of a page's article, joined by empty lines; empty without any."""
    if not html:
        return ""
    tree = Tree(html)
    if not tree.blocks:
        return ""
    drop = dropped(tree)
    kept = [block for block in tree.blocks if not drop[block[3]]]
    if not kept:
        return ""
    blocks = [block[:3] for block in kept]
    n = len(tree.tag)
    score, size, linked = [0.0] * n, [0] * n, [0] * n
    for node, text, links in blocks:
        gain = points(text)
        # a paragraph gives its points to its parent; text right in a container counts for the container
        holder = tree.parent[node] if tree.tag[node] not in ("div", "section", "article", "main", "body", "td", "#root") else node
        score[max(holder, 0)] += gain
        size[node] += len(text) - text.count(" ")  # links are measured without blanks too
        linked[node] += links
    for node in range(n - 1, 0, -1):  # children come after their parents
        size[tree.parent[node]] += size[node]
        linked[tree.parent[node]] += linked[node]
        score[tree.parent[node]] += score[node] / 2  # further ancestors get half as much each
    for node in range(n):
        score[node] *= 1 - min(1.0, linked[node] / size[node]) if size[node] else 0.0
    best = max(range(n), key=lambda i: (score[i], -i))
    if score[best] <= 0:  # nothing but short lines: an article if there is one, else the page
        best = max((i for i in range(n) if tree.tag[i] == "article" and size[i]), key=lambda i: (size[i], -i), default=0)
    else:
        up = best
        while up > 0:  # the article that holds the best container is the container
            if tree.tag[up] == "article":
                best = up
                break
            up = tree.parent[up]
    # beside it, all that is not links for the most part, and the text between
    chosen, beside = {best}, tree.parent[best]
    for node in range(1, n):
        if best and tree.parent[node] == beside and size[node] and linked[node] < DENSE * size[node]:
            chosen.add(node)
    inside = [False] * n
    for node in range(n):
        inside[node] = node in chosen or (node > 0 and inside[tree.parent[node]])
    between = beside if best else -1
    # a title in a wrapper of its own before the container, if that has none
    titles = [(at, inside[top]) for at, (node, text, links, top) in enumerate(kept) if "h1" in (tree.tag[node], tree.tag[top]) and links < DENSE * len(text)]
    start = next((at for at, (node, *_) in enumerate(kept) if inside[node]), len(kept))
    if titles and not any(own for _, own in titles):
        before = [at for at, _ in titles if at < start]
        if before:
            inside[kept[before[-1]][0]] = True
    return "\n\n".join(text for node, text, links in blocks if inside[node] or (node == between and links < DENSE * (len(text) - text.count(" "))))


def main_text(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """key, url, text and n_chars (code points) of every row.

    A null or empty page, and one without any text, has an empty text. Pages of
    any length are read whole. Repeated rows give repeated results; extra columns
    are left out; an empty table gives no rows.
    """
    wanted = pages.select(pages[key].alias("key"), "url", pages[html].alias("html"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page.as_py()) for page in batch.column("html")]
            sizes = pa.array([len(text) for text in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("url"), pa.array(texts, pa.string()), sizes], [key, "url", "text", "n_chars"])

    return wanted.mapInArrow(run, f"{key} {dict(pages.dtypes)[key]}, url string, text string, n_chars long")
