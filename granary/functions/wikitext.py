"""Plain text of wiki markup, from the documented syntax: balanced brackets are found by their depth, links and
line marks are read one by one."""

from __future__ import annotations

import html
import re
from collections.abc import Callable

# Namespaces whose links are never prose, also as two languages name them.
MEDIA = {"file", "image", "category", "চিত্ৰ", "শ্ৰেণী"}
LIST_MARKS = "*#:;"
REFERENCE = re.compile(r"<ref\b[^<>]*?/>|<ref\b[^<>]*>.*?</ref\s*>", re.DOTALL | re.IGNORECASE)
TAG = re.compile(r"</?[A-Za-z][^<>]*>")
SITE = re.compile(r"\[(?:https?:)//([^\s\]]*)[^\S\n]*([^\]]*)\]")


def outermost(text: str, opening: str, closing: str) -> list[tuple[int, int]]:
    """Where balanced stretches begin and end that lie in no other; marks without a partner don't count."""
    open_: list[int] = []
    found: list[tuple[int, int]] = []
    for m in re.finditer(f"{re.escape(opening)}|{re.escape(closing)}", text):
        if m[0] == opening:
            open_.append(m.start())
        elif open_:
            start = open_.pop()
            while found and found[-1][0] > start:
                found.pop()
            found.append((start, m.end()))
    return found


def without(text: str, stretches: list[tuple[int, int]], filler: str) -> str:
    out, upto = [], 0
    for a, b in stretches:
        out += [text[upto:a], filler]
        upto = b
    return "".join([*out, text[upto:]])


def uncommented(text: str, filler: str = "") -> str:
    """Comments run to the first end mark and don't nest; one without an end stays."""
    found, at = [], 0
    while (start := text.find("<!--", at)) >= 0 and (end := text.find("-->", start + 4)) >= 0:
        at = end + 3
        found.append((start, at))
    return without(text, found, filler)


def linked(text: str, label: Callable[[str], str]) -> str:
    """Each [[link]] becomes the label of what it holds, inner ones first; one without an end stays as it is."""
    levels: list[list[str]] = [[]]
    for part in re.split(r"(\[\[|\]\])", text):
        if part == "[[":
            levels.append([])
        elif part == "]]" and len(levels) > 1:
            inside = "".join(levels.pop())
            levels[-1].append(label(inside))
        else:
            levels[-1].append(part)
    while len(levels) > 1:
        rest = levels.pop()
        levels[-1] += ["[[", *rest]
    return "".join(levels[0])


def prose_label(link: str) -> str:
    target, _, shown = link.partition("|")
    if target.partition(":")[0].strip().lower() in MEDIA and ":" in target:
        return ""
    return shown or target


def plain_label(link: str) -> str:
    """What stands after the first bar, or after the namespace: the last colon."""
    target, bar, shown = link.partition("|")
    return shown if bar else target.rpartition(":")[2]


def lines_without_marks(text: str, indented: bool) -> str:
    """Headings and list items without their marks; indented: marks may have white space before them, which goes too."""
    out = []
    for line in text.split("\n"):
        bare = line.strip()
        if len(bare) > 1 and bare[0] == bare[-1] == "=":
            line = bare.strip("=").strip()
        start = line.lstrip() if indented else line
        if start[:1] and start[0] in LIST_MARKS:
            line = start.lstrip(LIST_MARKS).lstrip()
        out.append(line)
    return "\n".join(out)


def prose(text: str) -> str:
    """Markup removed without a trace, entities resolved, no stray brackets, at most one blank line at a time."""
    text = REFERENCE.sub("", uncommented(text))
    text = without(text, outermost(text, "{{", "}}"), "")
    text = without(text, outermost(text, "{|", "|}"), "")
    text = SITE.sub(lambda m: m[2], linked(text, prose_label))
    text = lines_without_marks(re.sub("'{2,5}", "", text), indented=False)
    text = html.unescape(TAG.sub("", text))
    text = text.translate(dict.fromkeys(map(ord, "[]{}")))
    return re.sub("\n\n\n+", "\n\n", text).strip()


def stripped(text: str) -> str:
    """The plainer form: what goes leaves a space, entities and white space at the ends stay."""
    text = REFERENCE.sub(" ", uncommented(text, " "))
    text = without(text, outermost(text, "{{", "}}"), " ")
    text = without(text, outermost(text, "{|", "|}"), " ")
    text = SITE.sub(lambda m: m[2] or " ", linked(text, plain_label))
    text = lines_without_marks(re.sub("'{2,5}", "", text), indented=True)
    return TAG.sub(" ", text)
