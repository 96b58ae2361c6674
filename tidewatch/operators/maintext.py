"""Main text of a page: blocks with their share of links, the best run of blocks, then simpler ways."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser

BLOCKS = {"address", "article", "aside", "blockquote", "body", "br", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul"}
UNREAD = {"script", "style", "noscript", "template", "head", "svg", "button", "select", "textarea"}
BESIDE = {"nav", "aside", "footer", "form", "menu"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Words in classes and ids of what stands beside a text.
NAMES = re.compile(r"(?i)(^|[\s_-])(ads?|advert\w*|banner|breadcrumbs?|comments?|cookie\w*|disqus|footer|menu|nav\w*|newsletter|promo\w*|recommend\w*|related|share|sharing|side-?bar|social|sponsor\w*|subscribe|tags?|teasers?|widget)($|[\s_-])")
LINK_COST, BLOCK_COST = 3.0, 25.0
LEAST = 10


@dataclass
class Block:
    text: str
    linked: int
    beside: bool
    heading: bool = False

    @property
    def score(self) -> float:
        """Characters for the text, more so the fewer of them are links; what stands beside a text counts against it. A heading costs nothing."""
        n = len(self.text)
        if self.beside:
            return -n - BLOCK_COST
        return n - LINK_COST * self.linked - (0 if self.heading else BLOCK_COST)


class BlockParser(HTMLParser):
    """Blocks of a page in order; title and description."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.title, self.description = "", ""
        self.stack: list[tuple[str, bool]] = []  # element, and whether it or one above stands beside the text
        self.parts: list[str] = []
        self.linked = 0

    def _cut(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            heading = any(len(t) == 2 and t[0] == "h" and t[1].isdigit() for t, _ in self.stack[-3:])
            self.blocks.append(Block(text, self.linked, bool(self.stack) and self.stack[-1][1], heading))
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        own = dict(attrs)
        if tag == "meta" and (own.get("name") or own.get("property") or "").lower() in ("description", "og:description") and not self.description:
            self.description = (own.get("content") or "").strip()
        if tag in BLOCKS:
            self._cut()
        if tag not in VOID:
            names = f"{own.get('class') or ''} {own.get('id') or ''}"
            self.stack.append((tag, (bool(self.stack) and self.stack[-1][1]) or tag in BESIDE or (tag not in ("body", "html") and bool(NAMES.search(names)))))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                if any(t in BLOCKS for t, _ in self.stack[i:]):
                    self._cut()
                del self.stack[i:]
                return

    def handle_data(self, data: str) -> None:
        tags = [t for t, _ in self.stack]
        if tags and tags[-1] == "title" and "svg" not in tags:
            self.title += data
        elif not any(t in UNREAD for t in tags):
            self.parts.append(data)
            if "a" in tags:
                self.linked += len("".join(data.split()))

    def close(self) -> None:
        super().close()
        self._cut()


def best_run(scores: list[float]) -> tuple[int, int]:
    """First and one past the last place of the run with the largest sum; of equal ones the first; (0, 0) without a positive one."""
    best, found, start, total = 0.0, (0, 0), 0, 0.0
    for i, score in enumerate(scores):
        if total <= 0:
            start, total = i, 0.0
        total += score
        if total > best:
            best, found = total, (start, i + 1)
    return found


def main_text(html: str | None, least: int = LEAST) -> tuple[str, str, str, str]:
    """(title, text, method, status) of a page: the best run of blocks; else all blocks that stand beside nothing; else
    title and description (partial); else nothing (failed). Each needs least characters."""
    page = BlockParser()
    page.feed(html or "")
    page.close()
    title = " ".join(page.title.split())
    start, end = best_run([b.score for b in page.blocks])
    run = [b for b in page.blocks[start:end] if not b.beside and 2 * b.linked <= len(b.text)]
    for method, text in (("density", "\n".join(b.text for b in run)), ("blocks", "\n".join(b.text for b in page.blocks if not b.beside and 2 * b.linked <= len(b.text)))):
        if len(text) >= least:
            return title, text, method, "full"
    text = "\n".join(x for x in (title, page.description) if x)
    if len(text) >= least:
        return title, text, "title", "partial"
    return title, "", "none", "failed"
