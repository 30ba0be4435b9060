"""The alignment language: a window around events, as a small immutable description.

    align  := window (',' clause)*
    window := start ':' stop ['@' zero] | '@' event | event
    event  := [name] ['(' index ')'] [('+'|'-') number] ['as' label]
    index  := n | 'end' | 'end-'n | a ':' b | ':'
    clause := ('truncateAfter'|'before') event | ('truncateBefore'|'after') event
            | ('invalidate'|'exclude'|'excluding') event | ('mark'|'indicate') event
            | 'pad' ['['] pre ':' post [']']
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

TRIAL_START, TRIAL_END = "TrialStart", "TrialEnd"

# The words that begin a clause.
CLAUSES = {
    "truncateafter": "truncate_after", "before": "truncate_after",
    "truncatebefore": "truncate_before", "after": "truncate_before",
    "invalidate": "invalidate", "exclude": "invalidate", "excluding": "invalidate",
    "mark": "mark", "indicate": "mark",
}
DEFAULT_INDEX = {"truncate_after": "1", "truncate_before": "end", "invalidate": ":", "mark": ":"}

_EVENT = re.compile(r"^(?P<name>[A-Za-z_]\w*)?\s*(?:\((?P<index>[^)]*)\))?\s*(?P<offset>[+-]?\s*\d+(?:\.\d+)?)?(?:\s+as\s+(?P<label>.+))?$")


class AlignmentError(ValueError):
    """The text is not a window of the alignment language."""


@dataclass(frozen=True)
class EventRef:
    """An occurrence (or, with a range index, several) of an event, moved by offset."""

    name: str
    index: str = "1"
    offset: float = 0.0
    label: str | None = None


@dataclass(frozen=True)
class Alignment:
    start: EventRef
    stop: EventRef
    zero: EventRef
    truncate_after: tuple[EventRef, ...] = ()
    truncate_before: tuple[EventRef, ...] = ()
    invalidate: tuple[EventRef, ...] = ()
    mark: tuple[EventRef, ...] = ()
    pre: float = 0.0
    post: float = 0.0

    def pad(self, pre: float, post: float) -> Alignment:
        return replace(self, pre=pre, post=post)


def _split(text: str, mark: str) -> list[str]:
    """Split at mark outside of parentheses and brackets."""
    out, depth = [""], 0
    for ch in text:
        depth += (ch in "([") - (ch in ")]")
        if ch == mark and not depth:
            out.append("")
        else:
            out[-1] += ch
    return [x.strip() for x in out]


def parse_event(text: str, index: str = "1") -> EventRef:
    m = _EVENT.match(text.strip())
    if not m or not text.strip():
        raise AlignmentError(f"not an event: {text!r}")
    offset = float((m["offset"] or "0").replace(" ", ""))
    where = (m["index"] or index).replace(" ", "")
    if not re.fullmatch(r"\d+|end(?:-\d+)?|(?:\d+|end(?:-\d+)?)?:(?:\d+|end(?:-\d+)?)?", where):
        raise AlignmentError(f"not an index: {where!r}")
    return EventRef(m["name"] or "", where, offset, m["label"])


def parse(text: str) -> Alignment:
    """An Alignment from its text; raises AlignmentError."""
    window, *clauses = _split(text, ",")
    span, *zero = _split(window, "@")
    sides = _split(span, ":") if span else []
    if len(zero) > 1 or len(sides) > 2:
        raise AlignmentError(f"not a window: {window!r}")
    origin = parse_event(zero[0]) if zero else None
    if not sides:
        if origin is None:
            raise AlignmentError("empty window")
        out = Alignment(EventRef(TRIAL_START), EventRef(TRIAL_END), origin)
    elif len(sides) == 1:
        single = parse_event(sides[0])
        out = Alignment(single, single, origin or single)
    else:
        start, stop = map(parse_event, sides)
        if not start.name and not stop.name:
            start, stop = replace(start, name=TRIAL_START), replace(stop, name=TRIAL_START)
        start = start if start.name else replace(start, name=stop.name, index=stop.index)
        stop = stop if stop.name else replace(stop, name=start.name, index=start.index)
        out = Alignment(start, stop, origin or replace(start, offset=0.0, label=None))
    for clause in clauses:
        word, _, rest = clause.partition(" ")
        if word.lower() == "pad":
            m = re.fullmatch(r"\[?\s*([+-]?\d+(?:\.\d+)?)\s*:\s*([+-]?\d+(?:\.\d+)?)\s*\]?", rest.strip())
            if not m:
                raise AlignmentError(f"not a pad: {clause!r}")
            out = out.pad(abs(float(m[1])), float(m[2]))
            continue
        kind = CLAUSES.get(word.lower())
        if not kind:
            raise AlignmentError(f"unknown clause: {clause!r}")
        ref = parse_event(rest, DEFAULT_INDEX[kind])
        out = replace(out, **{kind: (*getattr(out, kind), ref)})
    return out
