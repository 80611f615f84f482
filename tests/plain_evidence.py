"""The rules of evidence in plain Python, a chunk at a time: what the relational form must equal."""

import re

from sheaf.functions import rules
from sheaf.operators.evidence import CUT_OFF, ITEM, LINE_RULES, LIST_END, LISTS, MOST_QUOTE, PASSED_OVER, VALUES, Rule

_PASSED_OVER = re.compile(PASSED_OVER)


def fold(text: str) -> str:
    return _PASSED_OVER.sub("", text.casefold())


def _fits(rule: Rule, lines: list[str], folds: list[str], i: int) -> str | None:
    """What a rule quotes at line i; None if it doesn't fit there."""
    if not any(all(fold(t) in folds[i] for t in group) for group in rule.terms) or rule.unless and re.match(rule.unless, lines[i]):
        return None
    if rule.below is not None and not (i + 1 < len(lines) and fold(rule.below) in folds[i + 1]):
        return None
    quote = "\n".join(lines[max(0, i + rule.lines[0]) : i + rule.lines[1]])
    if rule.pattern is not None:
        where = {"line": lines[i], "next": lines[i + 1] if i + 1 < len(lines) else "", "quote": quote}[rule.place]
        if not (re.match if rule.place == "next" else re.search)(rule.pattern, where):
            return None
    return quote


def _items(lines: list[str], folds: list[str], facet: str):
    """The (1), (2), ... items below the facet's heading, up to the next numbered section; careers may be one line instead."""
    headings = [fold(h) for h in LISTS[facet]]
    top = next((i for i, line in enumerate(folds) if any(h in line for h in headings)), None)
    if top is None:
        return
    section = re.split(LIST_END, "\n".join(lines[top:]), maxsplit=1)[0]
    places = [m.start() for m in re.finditer(ITEM, section)]
    for at, stop in zip(places, [*places[1:], len(section)], strict=False):
        found = section[at:stop].strip()
        if len(found) > 5 and not re.search(CUT_OFF, found):
            yield found
    if not places and facet == "careers" and ":" in section:
        yield section


def candidates(text: str, document: str | None, facet: str) -> list[str]:
    """What the rules of a facet quote from a chunk, each once."""
    lines = text.splitlines()
    if facet == "program":
        name = rules.PROGRAMS[document][1] if document in rules.PROGRAMS else None
        found = [x for x in lines if name is not None and name in re.sub(r"\s+", "", x)]
    elif facet in LISTS:
        found = list(_items(lines, [fold(x) for x in lines], facet))
    else:
        folds = [fold(x) for x in lines]
        tried = ((_fits(r, lines, folds, i) for r in LINE_RULES.get(facet, ())) for i in range(len(lines)))
        found = [q for at_line in tried if (q := next((x for x in at_line if x is not None), None)) is not None]
    return list(dict.fromkeys(found))


def allowed(quote: str, text: str) -> bool:
    """Whether a quote is in the text, of bounded length, no refusal and without orders to the model."""
    low = quote.casefold()
    return quote in text and len(quote) <= MOST_QUOTE and rules.REFUSAL not in quote and not any(x in low for x in rules.INJECTIONS)


def quotes(text: str | None, document: str | None, facets: list[str]) -> list[tuple[str, str, str | None]]:
    """(facet, quote, value) of a chunk."""
    out = []
    for facet in facets:
        for quote in candidates(text or "", document, facet):
            if allowed(quote, text or ""):
                number = re.search(VALUES[facet], quote) if facet in VALUES else None
                out.append((facet, quote, number[1] if number else None))
    return out
