"""Main text of web pages from flat text blocks and a decision tree.

A page becomes a flat list of text blocks. Each is described by its word count and link density,
those of the blocks before and after it, what kind of element it is, and how large a share of the
page's words lies in the marked elements around it; a tree trained on a small table of labelled
blocks says which are main text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirmesh.llm import text as tx
from weirmesh.llm.labelled_pages import PAGES, filled

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "kind", "furniture", "marked", "comments", "article", "of_longest")
#: Elements that end a block.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
#: Elements that hold page furniture, always or where they are a small part of a page.
FURNITURE = frozenset("nav aside footer button select option menu label textarea".split())
PART = frozenset("form header fieldset dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text isn't shown, and those of them whose end tag may be missing to the page's end.
HIDDEN = frozenset("script style title noscript template svg iframe object canvas textarea".split())
TO_THE_END = frozenset("script style title".split())
#: Words of class, id and role by what they speak for.
COMMENTS = re.compile(r"comments?|commentlist|repl(?:y|ies)|disqus|respond")
STRONG = re.compile(r"ads?|advert\w*|sponsor\w*|promo\w*|cookies?|consent|popup|modal|newsletter|subscri\w*|sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|login|signup|widget|pagination|pager|toolbar|banner|dialog|contentinfo|complementary")
WEAK = re.compile(r"side|social|shar(?:e|ing)|related|recommend\w*|search|notice|legal|copyright|header|discussion|toc|teasers?|outbrain|meta")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:_-]*")
ATTRIBUTE = re.compile(r"""[\s/]*([^\s=>"'/][^\s=>/]*)?(\s*=\s*)?""")
KINDS = {t: 1.0 for t in ("p", "blockquote", "pre", "figcaption")} | {f"h{k}": 2.0 for k in range(1, 7)} | {t: 3.0 for t in ("li", "dd", "dt", "td", "th", "caption")}


class Tree:
    """A binary decision tree by Gini impurity, grown until its leaves are pure or small."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, depth: int = 9, least: int = 3) -> None:
        self.feature, self.cut, self.left, self.right, self.share = [], [], [], [], []
        self._grow(rows, labels, depth, least)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, least: int) -> int:
        at = len(self.share)
        for name, v in (("feature", -1), ("cut", 0.0), ("left", -1), ("right", -1), ("share", float(y.mean()))):
            getattr(self, name).append(v)
        best = (1e-9, -1, 0.0)
        whole = len(y) * self._gini(y)
        for f in range(x.shape[1]) if depth and 0 < y.mean() < 1 else ():
            values = np.unique(x[:, f])
            for c in (values[1:] + values[:-1]) / 2:
                low = x[:, f] < c
                if min(low.sum(), (~low).sum()) >= least:
                    gain = whole - low.sum() * self._gini(y[low]) - (~low).sum() * self._gini(y[~low])
                    if gain > best[0]:
                        best = (gain, f, c)
        if best[1] >= 0:
            low = x[:, best[1]] < best[2]
            self.feature[at], self.cut[at] = best[1], float(best[2])
            self.left[at] = self._grow(x[low], y[low], depth - 1, least)
            self.right[at] = self._grow(x[~low], y[~low], depth - 1, least)
        return at

    @staticmethod
    def _gini(y: np.ndarray) -> float:
        p = y.mean()
        return 2 * p * (1 - p)

    def predict(self, row: tuple[float, ...]) -> bool:
        i = 0
        while self.feature[i] >= 0:
            i = self.left[i] if row[self.feature[i]] < self.cut[i] else self.right[i]
        return self.share[i] >= 0.5


class _Scanner:
    """Tags and texts of a page in one pass; what was found missing once isn't looked for again."""

    def __init__(self, page: str) -> None:
        self.page, self.missing = page, set()

    def find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        i = self.page.find(what, at)
        if i < 0:
            self.missing.add(what)
        return i

    def attributes(self, at: int) -> tuple[int, list[tuple[str, str]], bool]:
        """Where a tag that is open at a position ends, its attributes, and whether it closes itself."""
        page, found, n = self.page, [], len(self.page)
        while at < n:
            if page[at] == ">":
                return at + 1, found, page[at - 1] == "/"
            m = ATTRIBUTE.match(page, at)
            name, value = m[1], ""
            at = max(m.end(), at + (m.end() == at))  # a stray quote is passed over
            if m[2] and at < n:
                end = self.find(page[at], at + 1) if page[at] in "\"'" else -1
                if end >= 0:
                    value, at = page[at + 1 : end], end + 1
                elif page[at] in "\"'":  # without its pair a quote ends with the tag
                    end = self.find(">", at)
                    value, at = (page[at + 1 : end], end) if end >= 0 else (page[at + 1 :], n)
                else:
                    end = at
                    while end < n and page[end] not in " \t\n\r\f>":
                        end += 1
                    value, at = page[at:end], end
            if name:
                found.append((name.lower(), value))
        return n, found, False

    def __iter__(self) -> Iterator[tuple[str, str, list[tuple[str, str]]]]:
        """("text", its text), ("open" or "shut", a name, attributes) in order."""
        page, at, n = self.page, 0, len(self.page)
        while at < n:
            lt = self.find("<", at)
            if lt != at:
                yield "text", page[at : lt if lt >= 0 else n], []
                if lt < 0:
                    return
            after = page[lt + 1 : lt + 2]
            if after in ("!", "?"):
                mark = "-->" if page.startswith("<!--", lt) else ">"
                end = self.find(mark, lt + 2)
                at = end + len(mark) if end >= 0 else n
                continue
            m = NAME.match(page, lt + 1 + (after == "/"))
            if not m:
                yield "text", "<", []
                at = lt + 1
                continue
            at, found, alone = self.attributes(m.end())
            name = m[0].lower()
            if after == "/":
                yield "shut", name, []
            elif name in HIDDEN and not alone:
                at = self._hidden(name, at)
            elif not alone and name not in VOID or name in BLOCKS or name == "br":
                yield "open", name, found

    def _hidden(self, name: str, at: int) -> int:
        """Where the text that isn't shown ends."""
        key = f"</{name}"
        if key not in self.missing:
            m = re.compile(f"</{name}[\\s/>]", re.I).search(self.page, at)
            if m:
                end = self.find(">", m.start())
                return end + 1 if end >= 0 else len(self.page)
            self.missing.add(key)
        return len(self.page) if name in TO_THE_END else at


class _Block:
    __slots__ = ("text", "links", "kind", "around", "article", "main", "words")

    def __init__(self, text: str, links: float, kind: float, around: list[tuple[str, list[int]]], article: bool, main: bool) -> None:
        self.text, self.links, self.kind, self.around, self.article, self.main = text, links, kind, around, article, main
        self.words = text.count(" ") + 1


def _mark(name: str, attributes: list[tuple[str, str]]) -> list[str]:
    """What an element and its class, id and role speak for."""
    words = [w.lower() for k, v in attributes if k in ("class", "id", "role") for w in WORD.findall(v)] if name not in ("html", "body", "article", "main") else []
    out = ["always"] if name in FURNITURE else ["furniture"] if any(STRONG.fullmatch(w) for w in words) else []
    out += ["comments"] if any(COMMENTS.fullmatch(w) for w in words) else []
    return out + (["marked"] if name in PART or any(WEAK.fullmatch(w) for w in words) else [])


def blocks(page: str) -> list[_Block]:
    """The text blocks of a page.

    Unclosed elements end with what encloses them; stray end tags, a comment without end and a
    page that breaks off are all taken as far as they go. Time grows with the page's length.
    """
    out: list[_Block] = []
    # name, what it is marked as with the place in sizes of its words, main text or not by label
    stack: list[tuple[str, list[tuple[str, list[int]]], bool | None]] = []
    around: list[tuple[str, list[int]]] = []
    labels: list[bool] = []
    parts: list[str] = []
    linked = chars = anchors = articles = 0

    def flush() -> None:
        nonlocal linked, chars
        if parts:
            s = " ".join(html.unescape("".join(parts)).split())
            if s:
                kind = next((KINDS.get(e[0], 0.0) for e in reversed(stack) if e[0] in BLOCKS), 0.0)
                links = min(linked / chars, 1.0) if chars else 0.0
                b = _Block(s, links, kind, list(around), articles > 0, bool(labels) and labels[-1])
                for _, size in around:
                    size[0] += b.words
                out.append(b)
            parts.clear()
        linked = chars = 0

    def close(n: int) -> None:
        nonlocal anchors, articles
        for name, marks, label in stack[n:]:
            anchors -= name == "a"
            articles -= name in ("article", "main")
            del around[len(around) - len(marks) :]
            if label is not None:
                labels.pop()
        del stack[n:]

    depth: dict[str, int] = {}  # open elements by name, so that a stray end tag costs nothing
    for what, name, attributes in _Scanner(page):
        if what == "text":
            parts.append(name)
            n = len(name.strip())
            chars += n
            linked += n if anchors else 0
            continue
        if name in BLOCKS:
            flush()
        elif name == "br":
            parts.append(" ")
        if what == "shut":
            if depth.get(name):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        for e in stack[i:]:
                            depth[e[0]] -= 1
                        close(i)
                        break
                    if name not in BLOCKS and stack[i][0] in BLOCKS:
                        break  # an inline end tag doesn't reach out of its block
            continue
        if name in VOID:
            continue
        if name in BLOCKS:  # a new block ends an open paragraph, and a like one its list item or cell
            for i in range(len(stack) - 1, max(len(stack) - 12, -1), -1):
                if stack[i][0] == "p" or stack[i][0] == name and name in ("li", "td", "th", "tr", "dd", "dt", "option"):
                    for e in stack[i:]:
                        depth[e[0]] -= 1
                    close(i)
                    break
                if stack[i][0] in BLOCKS:
                    break
        elif len(stack) >= DEEPEST:
            continue  # formatting that is never closed adds nothing
        given = dict(attributes)
        marks = [(m, [0]) for m in _mark(name, attributes)] if len(stack) < DEEPEST else []
        label = True if "data-main" in given else False if "data-not" in given else None
        stack.append((name, marks, label))
        if label is not None:
            labels.append(label)
        depth[name] = depth.get(name, 0) + 1
        around += marks
        anchors += name == "a"
        articles += name in ("article", "main")
    flush()
    return out


DEEPEST = 400  # open elements, beyond which inline ones aren't kept and marks aren't read


def features(found: list[_Block]) -> list[tuple[float, ...]]:
    """A row in the order of FEATURES for each block.

    furniture, marked and comments: the smallest share of the page's words that an element so marked
    around the block holds, 1 where there is none; so a name or form that wraps a whole page doesn't
    count. Elements that are furniture by themselves count as 0.
    """
    total = max(sum(b.words for b in found), 1)
    longest = max((b.words * (1 - b.links) for b in found), default=0.0) or 1.0
    rows = []
    for i, b in enumerate(found):
        share = {"furniture": 1.0, "marked": 1.0, "comments": 1.0}
        for m, size in b.around:
            if m == "always":
                share["furniture"] = 0.0
            else:
                share[m] = min(share[m], size[0] / total)
        before = (float(found[i - 1].words), found[i - 1].links) if i else (0.0, 0.0)
        after = (float(found[i + 1].words), found[i + 1].links) if i + 1 < len(found) else (0.0, 0.0)
        rows.append((float(b.words), b.links, *before, *after, b.kind, share["furniture"], share["marked"], share["comments"], float(b.article), min(b.words / longest, 1.0)))
    return rows


def labelled_table(pages: dict[str, str] = PAGES) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of all blocks of the labelled pages."""
    x, y = [], []
    for page in pages.values():
        found = blocks(filled(page))
        x += features(found)
        y += [b.main for b in found]
    return np.array(x), np.array(y, float)


@cache
def labelled_tree() -> Tree:
    return Tree(*labelled_table())


def main_text(page: str | None, tree: Tree) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, row in zip(found, features(found), strict=True) if tree.predict(row))


def _extract(tree: Tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.pieces(batches, "row.html"):
            out = [main_text(x, tree) for x in tx.field(b, "row.html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(out, pa.string())], ["row", "text"])

    return run


def extract(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """row (all columns of pages as a struct) and text for every row of pages(html, ..).

    Blocks that the tree takes for main text, one on each line, with character references decoded
    and white space inside them made single spaces. Null and empty pages, and pages without such
    blocks, give an empty text. Pages of any length are read whole.
    """
    rows = pages.select(F.struct(*pages.columns).alias("row"))
    return rows.mapInArrow(_extract(tree or labelled_tree()), rows.select("row").schema.add("text", "string"))
