"""Markup in text: HTML, Markdown, wiki and LaTeX pieces, and the tree of blocks they make (no Spark)."""

from __future__ import annotations

import html
import html.entities
import re
from collections import Counter
from dataclasses import dataclass

# HTML element names that count as tags (others need a colon, as ix:nonNumeric has).
TAGS = (
    "a abbr address article aside audio b base big blockquote body br button canvas caption center cite code col colgroup dd del details dfn dir div dl dt em "
    "embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main "
    "map mark math meta nav noscript object ol optgroup option p param picture pre q s samp script section select small source span strike strong style sub "
    "summary sup svg table tbody td template textarea tfoot th thead time title tr tt u ul var video wbr ref nowiki gallery references includeonly noinclude"
).split()
# LaTeX commands without an argument in braces.
COMMANDS = (
    "alpha beta gamma delta epsilon theta lambda mu pi rho sigma tau phi chi psi omega Delta Sigma Omega sum prod int infty partial nabla cdot times div pm le ge leq geq neq approx equiv "
    "ln log exp sin cos max min lim left right quad qquad dots ldots item hline newline noindent maketitle tableofcontents centering bfseries itshape par small large Large bigskip medskip smallskip"
).split()

_ATTR = r"""(?:\s+[\w:.-]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>=]+))?)*\s*"""
_NAME = r"(?:" + "|".join(sorted(TAGS, key=len, reverse=True)) + r"|[A-Za-z][\w-]*:[A-Za-z][\w-]*)"
TAG = re.compile(rf"<(/?)({_NAME})({_ATTR})(/?)>", re.I)
COMMENT = re.compile(r"<!--.*?-->|<!DOCTYPE[^<>]*>|<!\[CDATA\[.*?\]\]>|<\?xml[^<>]*\?>", re.I | re.S)
ESCAPED = re.compile(rf"&lt;(/?)({_NAME})({_ATTR.replace('"', '(?:"|&quot;)')})(/?)&gt;|&lt;!--", re.I)
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")

#: No sign that a name, a path or a formula has stands beside either underscore; neither is any inside.
UNDERSCORED = re.compile(r"(?<![\w_\\^/.:@#$%&=+*{}-])_(?=[^\W_])([^_\n\\^$={}/]+)(?<=[^\s_])_(?![\w_\\^/:@#$%&=+*{}(\[-])(?!\.\w)")
INLINE = [
    ("md", "image", re.compile(r"!\[([^\]\n]*)\]\(([^()\s]+)\)")),
    ("md", "link", re.compile(r"(?<!\])\[([^\[\]\n]+)\]\(([^()\s]+)\)")),
    ("md", "bold", re.compile(r"(?<![\w*\\])\*\*(?=[^\s*])([^*\n]+(?:\n(?!\n)[^*\n]+)*?)(?<=[^\s*])\*\*(?![\w*])")),
    ("md", "bold", re.compile(r"(?<![\w_\\])__(?=[^\s_])([^_\n]+(?:\n(?!\n)[^_\n]+)*?)(?<=[^\s_])__(?![\w_])")),
    ("md", "strike", re.compile(r"(?<![\w~\\])~~(?=[^\s~])([^~\n]+)(?<=[^\s~])~~(?![\w~])")),
    ("md", "emphasis", re.compile(r"(?<![\w*\\])\*(?=[^\s*])([^*\n{}]+)(?<=[^\s*])\*(?![\w*{])")),
    ("md", "emphasis", UNDERSCORED),
    ("md", "code", re.compile(r"(?<![`\\\w])`(?=[^`\s])([^`\n]+)(?<=[^`\s])`(?![`\w])")),
    ("wiki", "bold", re.compile(r"(?<!')'''(?=[^\s'])((?:[^'\n]|'(?!'))+?)'''(?!')")),
    ("wiki", "emphasis", re.compile(r"(?<!')''(?=[^\s'])((?:[^'\n]|'(?!'))+?)''(?!')")),
    ("wiki", "link", re.compile(r"\[\[([^\[\]|\n]+)(?:\|([^\[\]\n]*))?\]\]")),
    ("wiki", "template", re.compile(r"\{\{([^{}\n]+)\}\}")),
    ("wiki", "weblink", re.compile(r"(?<![\[\]])\[(https?://[^\s\]]+)(?: ([^\]\n]+))?\](?!\()")),
    ("tex", "formula", re.compile(r"\$\$(?=\S)([^$]+?)\$\$")),
    ("tex", "formula", re.compile(r"(?<![\\$\w])\$(?=[^\s$\d])([^$\n]*[\\^_{}][^$\n]*)(?<=[^\s\\])\$(?![\w$])")),
    ("tex", "formula", re.compile(r"(?<![\\\w])\\\[(.+?)\\\]", re.S)),
    ("tex", "formula", re.compile(r"(?<![\\\w])\\\((.+?)\\\)", re.S)),
    ("tex", "command", re.compile(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{")),
    ("tex", "command", re.compile(r"(?<![\w\\:\xad\u200b-\u200f\u2060\ufeff])\\(?:" + "|".join(COMMANDS) + r")(?![A-Za-z\\])")),
    ("tex", "command", re.compile(r"(?:(?<=[\s(\[{])|^)\\[A-Za-z]{3,}\*?(?![A-Za-z\\:])", re.M)),
    ("tex", "escape", re.compile(r"\\[%$&#_{}](?![\\\w]*\\)")),
]
ATX = re.compile(r"(#{1,6})[ \t]+(\S.*?)(?:[ \t]+#+)?[ \t]*$")
WIKI_HEAD = re.compile(r"(={2,6})[ \t]*([^=\s].*?)[ \t]*\1[ \t]*$")
SETEXT = re.compile(r"(={3,}|-{3,})[ \t]*$")
RULE = re.compile(r"(?:\*[ \t]*){3,}$|(?:_[ \t]*){3,}$|-{3,}[ \t]*$")
BULLET = re.compile(r"[ \t]*([*+\-•]|\*{2,4})[ \t]+(\S.*)$")
NUMBER = re.compile(r"[ \t]*(\d{1,3})[.)][ \t]+(\S.*)$")
QUOTE = re.compile(r"(?:>[ \t]?)+(.*)$")
FENCE = re.compile(r"[ \t]*(```+|~~~+)[ \t]*[\w+-]*[ \t]*$")
ROW = re.compile(r"[ \t]*\|(.*)\|[ \t]*$")
ROW_RULE = re.compile(r"[ \t]*\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)+\|?[ \t]*$")
WIKI_TABLE = re.compile(r"\{\|.*$")


@dataclass
class Block:
    """A leaf of the tree: its path of elements, what it is, and its clean text."""

    path: str
    kind: str
    text: str
    level: int = 0


def entity(m: re.Match) -> bool:
    body = m[0][1:]
    return body[0] == "#" or body in html.entities.html5


def count_inline(text: str) -> int:
    return sum(1 for _, _, p in INLINE for _ in p.finditer(text))


#: Innermost elements that a path names, so that deeply nested markup stays linear.
DEPTH = 32


def path_of(stack: list[str]) -> str:
    return "/".join(stack[-DEPTH:])


class Parser:
    """Turns a text into blocks and counts its pieces of markup by the path of the element they are."""

    VOID = {"br", "hr", "img", "input", "link", "meta", "col", "wbr", "base", "embed", "source", "param"}
    BLOCK = {
        "p", "div", "section", "article", "ul", "ol", "li", "table", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "header", "footer",
        "nav", "aside", "main", "body", "html", "dl", "dt", "dd", "form", "title", "center", "thead", "tbody", "tfoot", "caption", "address",
    }
    CLOSED_BY_NEXT = {"li", "p", "td", "th", "tr", "dt", "dd", "option"}
    HIDDEN = {"script", "style", "head", "noscript", "template", "ix:header"}

    def __init__(self) -> None:
        self.marks: Counter[str] = Counter()
        self.blocks: list[Block] = []

    def mark(self, path: str, n: int = 1) -> None:
        if n:
            self.marks[path] += n

    def parse(self, text: str) -> list[Block]:
        while "&lt;" in text or "&#60;" in text:  # escaped HTML is HTML
            if not ESCAPED.search(text):
                break
            self.mark("#escaped")
            text = ESCAPED.sub(lambda m: m[0].replace("&lt;", "<").replace("&gt;", ">").replace("&quot;", '"'), text)
        text, n = COMMENT.subn(" ", text)
        self.mark("#comment", n)
        stack: list[str] = []
        at, hidden, pre, buffer = 0, 0, 0, []

        def flush() -> None:
            whole = "".join(buffer)
            buffer.clear()
            if whole.strip():
                self.lines(whole, stack)

        for m in TAG.finditer(text) if "<" in text else ():
            name = m[2].lower()
            self.mark(path_of([*stack[-DEPTH:], name]))
            if not hidden:
                buffer.append(text[at : m.start()])
            at = m.end()
            block = name in self.BLOCK or name == "code" and pre
            if m[1]:
                if name in stack:
                    if block and not hidden:
                        flush()
                    while stack:
                        top = stack.pop()
                        hidden -= top in self.HIDDEN
                        pre -= top == "pre"
                        if top == name:
                            break
            elif name == "br":
                if not hidden:
                    buffer.append("\n")
            elif not (m[4] or name in self.VOID):
                if block and not hidden:
                    flush()
                if name in self.CLOSED_BY_NEXT and stack and stack[-1] == name:
                    stack.pop()
                if block or name in self.HIDDEN or name == "code":
                    stack.append(name)
                    hidden += name in self.HIDDEN
                    pre += name == "pre"
        if not hidden:
            buffer.append(text[at:])
        flush()
        return self.blocks

    def clean(self, text: str, at: str = "") -> str:
        """Text without inline markup; formulas keep their source, links their words."""
        held: list[str] = []

        def hold(body: str) -> str:
            held.append(body)
            return f"\x00{len(held) - 1}\x00"

        if "&" in text:
            def plain(m: re.Match) -> str:
                if not entity(m):
                    return m[0]
                self.mark(at + "#entity")
                return html.unescape(m[0])

            for _ in range(3):  # &amp;nbsp; was escaped twice
                text, old = ENTITY.sub(plain, text), text
                if text == old:
                    break
        for _, kind, p in INLINE:
            def swap(m: re.Match, kind=kind) -> str:
                self.mark(at + "#" + kind)
                if kind == "formula":
                    return hold("$" + m[1].strip() + "$")
                if kind == "code":
                    return hold(m[1])
                if kind == "link":
                    groups = m.groups()
                    if m[0].startswith("[["):
                        if re.match(r"(?:Category|File|Image):", m[1]):
                            return ""
                        return groups[1] if groups[1] else m[1]
                    return m[1]
                if kind == "weblink":
                    return m[2] or ""
                if kind in ("image", "template"):
                    return m[1] if kind == "image" else ""
                if kind == "escape":
                    return m[0][1:]
                return m[1] if m.re.groups else m[0]

            if kind == "command":
                text = self.commands(text, p, at)
            else:
                text = p.sub(swap, text)
        for i, body in enumerate(held):
            text = text.replace(f"\x00{i}\x00", body)
        return re.sub(r"[ \t]{2,}", " ", text).strip()

    def commands(self, text: str, p: re.Pattern, at_path: str) -> str:
        """Commands give their argument; citations, labels and references give nothing."""
        out, at = [], 0
        for m in p.finditer(text):
            if m.start() < at:
                continue
            name = re.match(r"\\([A-Za-z]+)", m[0])[1]
            self.mark(f"{at_path}#{name}")
            head = text[at : m.start()]
            end, body = m.end(), ""
            if m[0].endswith("{"):
                depth, i = 1, m.end()
                while i < len(text) and depth:
                    depth += (text[i] == "{") - (text[i] == "}")
                    i += 1
                body, end = text[m.end() : i - 1] if not depth else text[m.end() :], i
                if name in ("cite", "citep", "citet", "ref", "label", "eqref", "footnote", "begin", "end", "vspace", "hspace", "input", "include", "usepackage", "documentclass"):
                    body, head = "", head.removesuffix("~")
            out += [head, self.commands(body, p, at_path) if "\\" in body else body]
            at = end
        return "".join([*out, text[at:]])

    def add(self, stack: list[str], kind: str, text: str, level: int = 0) -> None:
        path = path_of(stack)
        text = self.clean(text, path) if kind not in ("code", "formula") else text.strip("\n")
        if text:
            self.blocks.append(Block(path, kind, text, level))

    def lines(self, text: str, stack: list[str]) -> None:
        """Blocks of Markdown, wiki and LaTeX inside one HTML element."""
        own = stack[-1] if stack else ""
        if own in ("pre", "code") or "pre" in stack:
            self.blocks.append(Block(path_of(stack), "code", html.unescape(text).strip("\n")))
            return
        if re.fullmatch(r"h[1-6]", own):
            self.add(stack, "heading", " ".join(text.split()), int(own[1]))
            return
        here = path_of([*stack, ""])
        rows = text.split("\n")
        i, para = 0, []
        in_list = False
        fresh = True  # a block may begin here

        def end() -> None:
            if para:
                self.add(stack, "item" if own == "li" else "cell" if own in ("td", "th") else "paragraph", "\n".join(para))
                para.clear()

        while i < len(rows):
            line = rows[i]
            s = line.strip()
            if not s:
                end()
                fresh, in_list = True, False
                i += 1
                continue
            if m := FENCE.match(line):
                stop = next((j for j in range(i + 1, len(rows)) if rows[j].strip().startswith(m[1][:3])), None)
                if stop is not None:
                    end()
                    self.mark(here + "fence")
                    self.add([*stack, "fence"], "code", "\n".join(rows[i + 1 : stop]))
                    i, fresh = stop + 1, True
                    continue
            if m := re.match(r"\\begin\{(equation|align|displaymath|gather|verbatim|lstlisting)(\*?)\}", s):
                close = f"\\end{{{m[1]}{m[2]}}}"
                stop = next((j for j in range(i, len(rows)) if close in rows[j]), None)
                if stop is not None:
                    end()
                    self.mark(here + m[1])
                    body = "\n".join(rows[i : stop + 1]).split("}", 1)[1].split(close, 1)
                    code = m[1] in ("verbatim", "lstlisting")
                    self.add([*stack, m[1]], "code" if code else "formula", body[0].strip() if code else "$" + body[0].strip() + "$")
                    rows[stop] = body[1]
                    i, fresh = stop, True
                    continue
            if re.match(r"\\(?:begin|end)\{[^}]*\}(?:\[[^\]]*\]|\{[^}]*\})*\s*$", s):
                end()
                self.mark(here + "begin")
                i, fresh = i + 1, True
                continue
            if m := re.match(r"\\(part|chapter|section|subsection|subsubsection|paragraph|subparagraph|title)\*?\{(.*)\}\s*$", s):
                end()
                self.mark(here + m[1])
                level = {"part": 1, "chapter": 1, "title": 1, "section": 1, "subsection": 2, "subsubsection": 3}.get(m[1], 4)
                self.add([*stack, m[1]], "heading", m[2], level)
                i, fresh = i + 1, True
                continue
            if m := re.match(r"\\item\b\s*(?:\[[^\]]*\])?\s*(.*)$", s):
                end()
                self.mark(here + "item")
                self.add([*stack, "itemize", "item"], "item", m[1])
                i, fresh = i + 1, True
                continue
            if fresh and (m := ATX.match(s)):
                end()
                self.mark(here + f"h{len(m[1])}")
                self.add([*stack, f"h{len(m[1])}"], "heading", m[2], len(m[1]))
                i += 1
                continue
            if m := WIKI_HEAD.match(s):
                end()
                self.mark(here + f"h{len(m[1])}")
                self.add([*stack, f"h{len(m[1])}"], "heading", m[2], len(m[1]))
                i, fresh = i + 1, True
                continue
            if fresh and i + 1 < len(rows) and SETEXT.match(rows[i + 1].strip()) and not BULLET.match(line):
                end()
                self.mark(here + "head")
                level = 1 if rows[i + 1].strip()[0] == "=" else 2
                self.add([*stack, f"h{level}"], "heading", s, level)
                i += 2
                continue
            if fresh and RULE.match(s):
                end()
                self.mark(here + "rule")
                i += 1
                continue
            if fresh and WIKI_TABLE.match(s):
                stop = next((j for j in range(i + 1, len(rows)) if rows[j].strip().startswith("|}")), None)
                if stop is not None:
                    end()
                    self.mark(here + "table")
                    for r in rows[i + 1 : stop]:
                        r = r.strip()
                        if r.startswith("|-") or not r:
                            continue
                        cells = re.split(r"\|\||!!", r.lstrip("|!+"))
                        self.add([*stack, "table", "tr"], "cell", " | ".join(c.split("|")[-1].strip() for c in cells))
                    i, fresh = stop + 1, True
                    continue
            if fresh and ROW.match(s) and i + 1 < len(rows) and ROW_RULE.match(rows[i + 1]):
                end()
                self.mark(here + "table")
                while i < len(rows) and ROW.match(rows[i].strip()):
                    if not ROW_RULE.match(rows[i]):
                        self.add([*stack, "table", "tr"], "cell", " | ".join(c.strip() for c in rows[i].strip().strip("|").split("|")))
                    i += 1
                fresh = True
                continue
            if (fresh or in_list) and (m := BULLET.match(line)):
                end()
                self.mark(here + "ul")
                self.add([*stack, "ul", "li"], "item", m[2])
                i, fresh, in_list = i + 1, False, True
                continue
            if (fresh or in_list) and (m := NUMBER.match(line)) and (in_list or i + 1 < len(rows) and (k := NUMBER.match(rows[i + 1])) and int(k[1]) == int(m[1]) + 1):
                end()
                self.mark(here + "ol")
                self.add([*stack, "ol", "li"], "item", m[2])
                i, fresh, in_list = i + 1, False, True
                continue
            if fresh and (m := QUOTE.match(s)):
                end()
                self.mark(here + "blockquote")
                body = []
                while i < len(rows) and (m := QUOTE.match(rows[i].strip())):
                    body.append(m[1])
                    i += 1
                self.add([*stack, "blockquote"], "quote", "\n".join(body))
                fresh = True
                continue
            if in_list and self.blocks:  # a wrapped item goes on
                self.blocks[-1].text += "\n" + self.clean(line, self.blocks[-1].path)
                i += 1
                continue
            para.append(line)
            fresh = False
            i += 1
        end()


def tree(text: str) -> tuple[Counter[str], list[Block]]:
    """The pieces of markup by the path of their element, and the blocks of the text.

    A text that MAYBE doesn't match has no pieces, and its paragraphs are its blocks: the parser needn't run."""
    if not MAYBE.search(text):
        return Counter(), [Block("", "paragraph", x) for x in map(_plain, EMPTY_LINES.split(text)) if x]
    p = Parser()
    blocks = p.parse(text)
    return p.marks, blocks


EMPTY_LINES = re.compile(r"\n(?:[^\S\n]*\n)+")


def _plain(paragraph: str) -> str:
    return re.sub(r"[ \t]{2,}", " ", paragraph).strip()


def parse(text: str) -> tuple[int, list[Block]]:
    """The number of pieces of markup, and the blocks of the text, always by the parser."""
    p = Parser()
    blocks = p.parse(text)
    return p.marks.total(), blocks


def render(blocks: list[Block]) -> str:
    """Clean text: headings on lines of their own, items with a dash, code between fences, formulas between dollars."""
    out: list[str] = []
    before = ""
    for b in blocks:
        gap = "" if not out else "\n" if b.kind == before and b.kind in ("item", "cell") else "\n\n"
        body = {"item": "- " + b.text, "code": "```\n" + b.text + "\n```"}.get(b.kind, b.text)
        out.append(gap + body)
        before = b.kind
    return "".join(out)


#: A text without any of these holds no markup: every pattern of the parser begins with one of them. The parser strips lines
#: of any blank, so those that must begin a line may have any blank but a line break before them.
MAYBE = re.compile(r"<[A-Za-z/!?]|&[A-Za-z#]|[*`\[{|\\]|__|~~|==|---|''|\$[^\s\d]|(?m:^[^\S\n]*(?:[-+•>#]|\d{1,3}[.)]|(?:_[ \t]*){3}))|" + UNDERSCORED.pattern)
