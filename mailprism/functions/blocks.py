"""Template blocks of one page, in one pass over its tokens; runs in table functions and Arrow batches on the executors."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

from mailprism.functions import markup

# Elements of headings and texts, and the marks of button links.
BLOCK_HEADINGS = ("h1", "h2", "h3")
TEXT_BLOCKS = ("p", "td", "div")
BUTTON_STYLES = ("background-color", "background:", "padding:", "border-radius")
BUTTON_CLASSES = ("btn", "button", "cta")
NO_TEXT = "Shop Now"
PREFIXES = {"image": "image", "heading": "heading", "text": "body", "cta": "cta"}
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
FIELDS = ("type", "slot", "tag", "text", "url", "alt", "width")


def attribute(token: dict, name: str) -> str:
    """Value of a token's last attribute of that name; empty when it has none."""
    return next((a["value"] or "" for a in reversed(token["attrs"]) if a["name"] == name), "")


class Page:
    """Tokens of a page and where its texts (outside styles) stand."""

    def __init__(self, tokens: list[dict]):
        self.tokens = tokens
        self.data = [t for t in tokens if t["kind"] == "text" and "style" not in t["within"]]
        self.places = [t["pos"] for t in self.data]

    def words(self, low: int, high: int) -> str:
        """Texts after position ``low`` and before ``high``."""
        parts = self.data[bisect_left(self.places, low + 1):bisect_left(self.places, high)]
        return " ".join(t["text"].strip(SPACE) for t in parts).strip(SPACE)

    def images(self):
        for t in self.tokens:
            if t["kind"] == "open" and t["tag"] == "img":
                yield t["pos"], {"type": "image", "url": attribute(t, "src"), "alt": attribute(t, "alt"), "width": attribute(t, "width")}

    def headings_and_texts(self):
        """A heading is a start tag whose next heading tag is an end tag. A paragraph begins at a text element that stands
        neither in one nor in a heading, and lasts to the first end of a text element unless a heading begins before."""
        title, start = None, None  # heading and paragraph that are open
        after_text = False  # the last mark was the start of a text element
        for t in self.tokens:
            kind, tag = t["kind"], t["tag"]
            if tag in BLOCK_HEADINGS:
                if kind == "close" and title is not None:
                    text = self.words(title["pos"], t["pos"])
                    if len(text) > 2:
                        yield t["pos"], {"type": "heading", "tag": title["tag"], "text": text}
                title = t if kind == "open" else None
                start, after_text = None, False
            elif tag in TEXT_BLOCKS:
                if kind == "open":
                    if title is None and not after_text:
                        start = t
                    after_text = True
                else:
                    if start is not None:
                        text = self.words(start["pos"], t["pos"])
                        if len(text) > 10:
                            yield t["pos"], {"type": "text", "tag": start["tag"], "text": text}
                    start, after_text = None, False

    def buttons(self):
        """Links that look like buttons; their text is the last one before their end that no button before has taken."""
        found = [t for t in self.tokens if t["kind"] == "open" and t["tag"] == "a" and (
            any(m in attribute(t, "style").lower() for m in BUTTON_STYLES) or any(m in attribute(t, "class").lower() for m in BUTTON_CLASSES))]
        ends = sorted(t["ends"] for t in found if t["ends"] is not None)
        for number, t in enumerate(found, 1):
            if t["ends"] is None:
                continue
            before = bisect_left(ends, t["ends"])
            last = bisect_left(self.places, t["ends"]) - 1
            free = last >= 0 and (before == 0 or self.places[last] > ends[before - 1])
            text = self.data[last]["text"].strip(SPACE) if free else ""
            yield t["ends"], {"type": "cta", "tag": "a", "text": text or NO_TEXT, "url": attribute(t, "href"), "slot": f"cta_{number}"}


def page_blocks(html: str | None) -> list[dict]:
    """Blocks (type, slot, tag, text, url, alt, width) in reading order, each numbered in its kind."""
    page, numbers, out = Page(markup.tokenize(html)["tokens"]), Counter(), []
    for _, block in sorted([*page.images(), *page.headings_and_texts(), *page.buttons()], key=lambda x: x[0]):
        numbers[block["type"]] += 1
        named = {"slot": f"{PREFIXES[block['type']]}_{numbers[block['type']]}"} | block
        out.append({f: named.get(f) for f in FIELDS})
    return out
