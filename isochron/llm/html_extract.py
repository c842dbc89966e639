"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped to one line for each block of text. Lines inside menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and comment sections weigh nothing, nor do lines that are mostly links. The text
lengths of WINDOW successive lines are summed at each line; where a sum rises to SURGE or more the text surges,
after the last such sum it dives, and the lines that weigh something from the first surge to the last dive are the
main text. In a page with `article` or `main` elements only lines there weigh something, and any sum above nothing
is a surge; a page without them none of whose sums reaches SURGE takes its greatest sum for it. A main element whose
class, id or role names it a reader's comment is none and weighs nothing, unless it is the page's only one or nothing
else weighs anything. Captions and formulas are text (but for a formula's annotations, which repeat it).

Defined results: null, empty and text-free pages give an empty text; unclosed and stray tags are tolerated (a
container lasts to its end tag, its parent's end or the page's); repeated rows each get their row; columns that
clash in name with the results are ignored.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isochron.llm.words import slices

#: Lines of a window, and the least sum of characters that a surge takes in a page without main elements.
WINDOW, SURGE = 5, 40

#: What stands between a tag's name and its end. Quotes count after "=" alone; a tag without an end ends at the next
#: "<", and an open quote with the page. Nothing is given back, so each character is read once.
_INNER = r"""(?:[^<>"'=]|=\s*"[^"]*(?:"|\Z)|=\s*'[^']*(?:'|\Z)|["'=])*+"""
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(script|style|noscript|template|iframe|textarea|select|object|canvas|title|(?:svg|annotation-xml|annotation)(?![^<>]*/>))\b" + _INNER + r"(?:>|(?=<)|\Z).*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*+)(" + _INNER + r")(?:>|(?=<)|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_SPACE = re.compile(r"\s+")

#: Elements that stay inside a line.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output q rp rt ruby s samp small span strike strong sub sup svg time tt u var wbr".split()) | frozenset(
    "math maction menclose merror mfenced mfrac mglyph mi mlabeledtr mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics annotation annotation-xml".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold main text.
APART = frozenset("head nav header footer aside form button dialog menu".split())
MAIN = frozenset("article main".split())
#: Words in class, id or role that mark a part as not main text.
_MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|banner|sponsor(?:ed)?|promo(?:tion)?s?|nav|navbar|navigation|menus?|breadcrumbs?|footer|header|masthead|side-?bar|comments?|replies|reader-?comments|disqus|respond|cookies?|consent|notices?|gdpr|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommend(?:ed|ations?)|widgets?|toolbar|pagination|pager|tags?|search|skip|legal|copyright|complementary|contentinfo)(?:$|[\s_-])", re.I
)
#: Words that may stand beside a mark in a compound: inside main elements a class word is a mark only if nothing else is in
#: it, as an article may name its topics there (`legal-analysis`, `search-algorithms`).
_MARK_WORD = re.compile(_MARKED.pattern.removeprefix(r"(?:^|[\s_-])").removesuffix(r"(?:$|[\s_-])"), re.I)
_BESIDE = frozenset("area article articles bar block body bottom box btn button buttons container content entry form group header icon icons inner item items left link links list main mid module more page panel post posts reader right section site slot text title top unit user wrap wrapper".split())
#: Of a main element, which may name its topics in its class: a whole word there that says it is a reader's comment.
_COMMENT = re.compile(r"(?:(?:div|li|user|reader)[-_])?(?:comments?|repl(?:y|ies))(?:[-_](?:body|content|item|list|text|\d+))?", re.I)
#: Class words that tell what a page has, hasn't or allows, not what a part is; and those that a heading inside a main
#: element may have.
_STATE = re.compile(r"(?:no|not|has|have|with|without|is)[-_].*|.*[-_](?:open|opened|closed|enabled|disabled|on|off)", re.I)
_HEADING = re.compile(r"(?:[a-z]+[-_])?header", re.I)
_LABEL = re.compile(r"(?<![^\s\"'/])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def lines(page: str) -> tuple[list[tuple[str, int]], bool]:
    """Each block's text and weight: its characters, or 0 where it can't be main text; whether there are main elements."""
    tokens = list(_TOKEN.finditer(page))
    own = [_comment(m.group(4)) for m in tokens if (m.group(3) or "").lower() in MAIN and not m.group(2)]
    several = len(own) > 1
    out, mains, wide = [], not all(own), _wide_forms(tokens, len(page))
    for mains, comments in dict.fromkeys([(mains, several), (False, several), (False, False)]):
        out = _weighted(page, tokens, mains, comments, wide)
        if any(weight for _, weight in out):
            break
    return out, mains


def _wide_forms(tokens: list[re.Match], end: int) -> set[int]:
    """Places of forms that hold over half of the page's text: those wrap the page and aren't for filling in."""
    total, at, open_, held = 0, 0, -1, {}
    for m in tokens:
        own = m.start() - at
        total += own
        at = m.end()
        if open_ >= 0:
            held[open_] += own
        if (m.group(3) or "").lower() == "form":
            open_ = -1 if m.group(2) else m.start()
            if open_ >= 0:
                held[open_] = 0
    total += end - at
    return {place for place, own in held.items() if 2 * own > total}


def _weighted(page: str, tokens: list[re.Match], mains: bool, comments: bool, wide: set[int]) -> list[tuple[str, int]]:
    """The lines where only main elements weigh something (`mains`), those that are comments nothing (`comments`), and
    the forms at the places in `wide` are like any block."""
    out: list[tuple[str, int]] = []
    text: list[str] = []
    linked = inside = 0  # characters in links; depth of open main elements
    stack: list[tuple[str, bool, bool]] = []  # open elements that matter: name, apart, main
    apart = 0
    in_link = False

    def flush() -> None:
        nonlocal linked
        line = _SPACE.sub(" ", html.unescape("".join(text))).strip()
        if line:
            good = not apart and (inside or not mains) and (inside or 2 * linked <= len(line))
            out.append((line, len(line) if good else 0))
        text.clear()
        linked = 0

    at = 0
    for m in tokens:
        if m.start() > at:
            text.append(page[at : m.start()])
            if in_link:
                linked += m.start() - at
        at = m.end()
        name = (m.group(3) or "").lower()
        if not name:
            if (m.group(1) or "").lower() == "title":  # the others stand within a line
                flush()
            continue
        if name in INLINE:
            if name == "a":
                in_link = not m.group(2)
            continue
        flush()
        if name in VOID:
            continue
        if m.group(2):
            if any(x[0] == name for x in stack):
                while True:
                    top = stack.pop()
                    apart -= top[1]
                    inside -= top[2]
                    if top[0] == name:
                        break
            continue
        if name in ("p", "li", "tr", "td", "th", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6", "html", "body", "option"):
            marked = _marked(m.group(4), bool(inside)) if name != "body" and name != "html" else False
            if not marked:
                continue
        main = name in MAIN
        away = comments and _comment(m.group(4)) if main else name in APART and not (name == "header" and inside or m.start() in wide) or _marked(m.group(4), bool(inside))
        stack.append((name, away, mains and main and not away))
        if m.group(4).endswith("/") and name not in MAIN | APART:
            stack.pop()
            continue
        apart += stack[-1][1]
        inside += stack[-1][2]
    rest = page[at:]
    text.append(rest.split("<", 1)[0] if re.search(r"<[a-zA-Z/!]", rest) else rest)
    flush()
    return out


def _comment(attributes: str) -> bool:
    return bool(attributes) and any(_COMMENT.fullmatch(x) for a, b, c in _LABEL.findall(attributes) for x in (a or b or c).split())


def _marked(attributes: str, inside: bool) -> bool:
    """Whether a class, id or role marks a part that isn't main text; `inside` a main element a heading may."""
    if not attributes:
        return False
    words = (x for a, b, c in _LABEL.findall(attributes) for x in (a or b or c).split())
    return any((_compound(x) if inside else _MARKED.search(x)) and not _STATE.fullmatch(x) and not (inside and _HEADING.fullmatch(x)) for x in words)


def _compound(word: str) -> bool:
    """Whether a class word is a mark, or marks with nothing but words that may stand beside them."""
    if _MARK_WORD.fullmatch(word):
        return True
    parts = [x for x in re.split(r"[\s_-]+", word.lower()) if x and not x.isdigit()]
    marks = [bool(_MARK_WORD.fullmatch(x)) for x in parts]
    return any(marks) and all(mark or x in _BESIDE for mark, x in zip(marks, parts))


def main_text(page: str | None) -> str:
    found, mains = lines(page or "")
    weights = [w for _, w in found]
    sums = [sum(weights[i : i + WINDOW]) for i in range(len(found))]
    level = min(1 if mains else SURGE, max(sums, default=0)) or 1
    high = [i for i, x in enumerate(sums) if x >= level]
    if not high:
        return ""
    return "\n".join(line for line, w in found[high[0] : high[-1] + WINDOW] if w)


def extract(pages: DataFrame, keep: list[str]) -> DataFrame:
    """Columns `keep` of each page with its main text and the text's length in characters."""

    def apply(batches):
        for batch in slices(batches, "_html"):
            texts = [main_text(x) for x in batch.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*keep, "text", "n_chars"])

    schema = pages.select(*keep).schema.add("text", "string").add("n_chars", "long")
    return pages.select(*keep, F.col("html").cast("string").alias("_html")).mapInArrow(apply, schema)
