"""Plain text of Markdown by its syntax: blocks by the public CommonMark rules, marks within them by the delimiter stack.

Blocks come a blank line apart. What has no text (breaks, link definitions) leaves none; code and HTML stay as they are.
"""

from __future__ import annotations

import re
from html import unescape

_FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})")
_HEADING = re.compile(r" {0,3}#{1,6}(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_UNDERLINE = re.compile(r" {0,3}(?:=+|-+)[ \t]*$")
_QUOTE = re.compile(r" {0,3}> ?")
_ITEM = re.compile(r"( {0,3})([-+*]|(\d{1,9})[.)])(?=[ ]|$)( *)")
_HTML = re.compile(r" {0,3}<(?:!--|[?!]|/?(?:script|pre|style|textarea|address|article|aside|blockquote|body|center|dd|details|div|dl|dt|figure|footer|form|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|nav|ol|p|section|summary|table|tbody|td|tfoot|th|thead|title|tr|ul)(?:[\s/>]|$))", re.I)
_DEFINED = re.compile(r" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:\s*(?:<[^<>\n]*>|[^\s<]\S*)(?:[ \t]*(?:\n[ \t]*)?(?<=\s)(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?[ \t]*(?:\n|$)")
_PUNCTUATION = re.compile(r"[!-/:-@\[-`{-~]|[^\w\s\x00-\x7f]")
_TAG = re.compile(r"<(?:/?[A-Za-z][\w-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?|!--.*?--|\?.*?\?|![A-Z].*?)>", re.S)
_AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[\w-]+(?:\.[\w-]+)*)>")
_TARGET = re.compile(r"\(\s*(?:<(?:[^<>\n\\]|\\.)*>|(?:[^\s()\\<]|\\.|\((?:[^\s()\\]|\\.)*\))(?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*)?(?:\s+(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)")
_ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);")
_TICKS, _RUN = re.compile("`+"), {c: re.compile(f"[{c}]+") for c in "*_"}
_OTHER, _TRAILING = re.compile(r"[^\\`<&*_\[\]! ]+|.", re.S), re.compile(r" +(?=\n)")
_LABEL = re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]")


# --- blocks ---


def _starts_block(line: str) -> bool:
    """Whether a line ends a paragraph that it would otherwise go on."""
    item = _ITEM.match(line)
    listed = item and line[item.end() :].strip() and item[3] in (None, "1")
    return bool(_FENCE.match(line) or _HEADING.match(line) or _RULE.match(line) or _QUOTE.match(line) or _HTML.match(line) or listed)


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


class _Blocks:
    """Leaf blocks in order, as (kind, text), and the labels of link definitions."""

    def __init__(self):
        self.leaves: list[tuple[str, str]] = []
        self.labels: set[str] = set()

    def paragraph(self, lines: list[str]) -> None:
        text = "\n".join(x.lstrip(" ") for x in lines)
        while m := _DEFINED.match(text):
            self.labels.add(_normal(m[1]))
            text = text[m.end() :]
        if text.strip():
            self.leaves.append(("text", text.rstrip()))

    def add(self, lines: list[str]) -> None:
        i, open_ = 0, []
        while i < len(lines):
            line = lines[i]
            if open_ and _UNDERLINE.match(line) or not line.strip() or not (open_ and not _starts_block(line)) and not (not open_ and _plain(line)):
                if open_:
                    self.paragraph(open_)
                    underlined = bool(_UNDERLINE.match(line))
                    open_ = []
                    if underlined:
                        i += 1
                        continue
                i = i + 1 if not line.strip() else self.other(lines, i)
            else:
                open_.append(line)
                i += 1
        if open_:
            self.paragraph(open_)

    def other(self, lines: list[str], i: int) -> int:
        """The block that is no paragraph at lines[i]; returns where the next begins."""
        line = lines[i]
        if _indent(line) >= 4:
            end = i + 1
            while end < len(lines) and (not lines[end].strip() or _indent(lines[end]) >= 4):
                end += 1
            self.leaves.append(("code", "\n".join(x[4:] for x in lines[i:end]).rstrip("\n ")))
            return end
        if m := _FENCE.match(line):
            end = i + 1
            while end < len(lines) and not re.fullmatch(rf" {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}[ \t]*", lines[end]):
                end += 1
            cut = re.compile(f" {{0,{_indent(line)}}}")
            self.leaves.append(("code", "\n".join(cut.sub("", x, count=1) for x in lines[i + 1 : end])))
            return end + 1
        if _RULE.match(line):
            return i + 1
        if m := _HEADING.match(line):
            if (m[1] or "").strip("# \t"):
                self.leaves.append(("text", m[1].strip()))
            return i + 1
        if _HTML.match(line):
            end = i + 1
            while end < len(lines) and lines[end].strip():
                end += 1
            self.leaves.append(("code", "\n".join(lines[i:end])))
            return end
        if _QUOTE.match(line):
            return self.container(lines, i, lambda x: _QUOTE.sub("", x, count=1) if _QUOTE.match(x) else None, True)
        item = _ITEM.match(line)
        spaces = len(item[4])
        width = item.end(2) + (spaces if 1 <= spaces <= 4 and line[item.end() :] else 1)
        first = line[item.end(2) :][width - item.end(2) :]
        return self.container(lines, i, lambda x: x[width:] if _indent(x) >= width or not x.strip() else None, False, first)

    def container(self, lines: list[str], i: int, inner, strict: bool, first: str | None = None) -> int:
        """A quote or list item: its lines without their marks, and those that lazily go on its last paragraph."""
        own = [inner(lines[i]) if first is None else first]
        end, fenced = i + 1, bool(_FENCE.match(own[0]))
        while end < len(lines):
            x = lines[end]
            if (kept := inner(x)) is not None and (x.strip() or not strict):
                own.append(kept)
                fenced ^= bool(_FENCE.match(kept))
            elif own[-1].strip() and x.strip() and not fenced and not _starts_block(x) and (strict or not _ITEM.match(x)) and _goes_on(own[-1]):
                own.append(x.lstrip(" "))
            else:
                break
            end += 1
        self.add(own)
        return end


def _plain(line: str) -> bool:
    """Whether a line begins a paragraph."""
    item = _ITEM.match(line)
    return _indent(line) < 4 and not item and not _starts_block(line)


def _goes_on(last: str) -> bool:
    """Whether the last of a container's lines is text of a paragraph."""
    while m := _QUOTE.match(last) or _ITEM.match(last):
        last = last[max(m.end(), 1) :]
    return bool(last.strip()) and not _HEADING.match(last) and not _RULE.match(last)


# --- marks within a block ---


def _normal(label: str) -> str:
    return " ".join(label.split()).casefold()


def _flanks(text: str, start: int, end: int) -> tuple[bool, bool]:
    """Whether a run of * or _ may open and may close emphasis."""
    before, after = text[start - 1 : start] or " ", text[end : end + 1] or " "
    space_b, space_a, mark_b, mark_a = before.isspace(), after.isspace(), bool(_PUNCTUATION.match(before)), bool(_PUNCTUATION.match(after))
    left = not space_a and (not mark_a or space_b or mark_b)
    right = not space_b and (not mark_b or space_a or mark_a)
    return (left and (not right or mark_b), right and (not left or mark_a)) if text[start] == "_" else (left, right)


def _emphasis(parts: list[str], runs: list[list], bottom: int) -> None:
    """Takes matched delimiters off parts. runs: [part, character, length, opens, closes, its length at first]."""
    i, lowest = bottom, {}
    while i < len(runs):
        closer = runs[i]
        if not closer[4] or not closer[2]:
            i += 1
            continue
        kind = (closer[1], closer[3], closer[5] % 3)
        for j in range(i - 1, max(bottom, lowest.get(kind, bottom)) - 1, -1):
            opener = runs[j]
            three = (opener[4] or closer[3]) and (opener[5] + closer[5]) % 3 == 0 and (opener[5] % 3 or closer[5] % 3)
            if opener[1] == closer[1] and opener[3] and opener[2] and not three:
                n = 2 if opener[2] > 1 and closer[2] > 1 else 1
                for run in (opener, closer):
                    run[2] -= n
                    parts[run[0]] = parts[run[0]][n:]
                del runs[j + 1 : i]  # what stands between opens and closes nothing
                i = j + 1
                if not opener[2]:
                    del runs[j]
                    i = j
                break
        else:
            lowest[kind] = i  # no opener before it: later closers of its kind need not look
            i += 1
    del runs[bottom:]


def inline(text: str, labels: set[str] = frozenset()) -> str:
    """Text of a paragraph or heading without its marks."""
    parts: list[str] = []
    runs: list[list] = []
    brackets: list[list] = []  # part, runs before it, where its text begins, whether it may be a link, whether it is an image
    i, unmatched = 0, set()
    while i < len(text):
        c = text[i]
        if c == "\\" and (text[i + 1 : i + 2] == "\n" or re.match(r"[!-/:-@\[-`{-~]", text[i + 1 : i + 2])):
            parts.append(text[i + 1])
            i += 2
        elif c == "`":
            ticks = _TICKS.match(text, i)[0]
            end = None if len(ticks) in unmatched else re.compile(rf"(?<!`){ticks}(?!`)").search(text, i + len(ticks))
            if end:
                code = text[i + len(ticks) : end.start()].replace("\n", " ")
                parts.append(code[1:-1] if code.strip() and code[0] == code[-1] == " " else code)
                i = end.end()
            else:
                unmatched.add(len(ticks))
                parts.append(ticks)
                i += len(ticks)
        elif c == "<" and (m := _AUTOLINK.match(text, i) or _TAG.match(text, i)):
            parts.append(m[1] if m.re is _AUTOLINK else m[0])
            i = m.end()
        elif c == "&" and (m := _ENTITY.match(text, i)):
            parts.append(unescape(m[0]))
            i = m.end()
        elif c in "*_":
            end = _RUN[c].match(text, i).end()
            runs.append([len(parts), c, end - i, *_flanks(text, i, end), end - i])
            parts.append(text[i:end])
            i = end
        elif c == "[" or text.startswith("![", i):
            n = 1 if c == "[" else 2
            brackets.append([len(parts), len(runs), i + n, True, n == 2])
            parts.append(text[i : i + n])
            i += n
        elif c == "]" and brackets:
            part, bottom, start, may, image = brackets.pop()
            end = None
            if may:
                if m := _TARGET.match(text, i + 1):
                    end = m.end()
                elif (m := _LABEL.match(text, i + 1)) and _normal(m[1] or text[start:i]) in labels:
                    end = m.end()
                elif not m and _normal(text[start:i]) in labels:
                    end = i + 1
            if end is None:
                parts.append("]")
                i += 1
                continue
            parts[part] = ""
            _emphasis(parts, runs, bottom)
            if not image:  # links hold no links
                for b in brackets:
                    b[3] = b[3] and b[4]
            i = end
        elif c == " " and (m := _TRAILING.match(text, i)):
            i = m.end()
        else:
            m = _OTHER.match(text, i)
            parts.append(m[0])
            i = m.end()
    _emphasis(parts, runs, 0)
    return "".join(parts)


def plain(text: str) -> str:
    """The text of a Markdown document."""
    found = _Blocks()
    found.add([re.sub(r"^[ \t]+", lambda m: m[0].expandtabs(4), x) for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n")])
    return "\n\n".join(inline(t, found.labels) if kind == "text" else t for kind, t in found.leaves)
