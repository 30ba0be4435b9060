"""Fill-in-the-middle transformation of texts held as ropes.

A rope is a balanced tree over pieces of a text. Every node caches how many units and how
many code points lie under it, so a cut at a unit's rank walks one path down, and a text is
rearranged by splitting and joining subtrees; no piece of it is copied but the two that a
cut goes through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialloom.llm.common import map_arrow

#: Code points in a leaf.
LEAF = 2048

# The sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Patterns of one unit, matched from left to right; together the matches are the whole text.
UNITS = {"char": None, "word": r"\s+\S*|\S+", "line": r"[^\n]*\n|[^\n]+"}


@dataclass(frozen=True, slots=True)
class Leaf:
    """A piece of text. ends are the code points at which its units end, None if each is a unit."""

    text: str
    ends: tuple[int, ...] | None
    units: int
    chars: int
    depth: int = 0


@dataclass(frozen=True, slots=True)
class Branch:
    left: Rope
    right: Rope
    units: int
    chars: int
    depth: int


Rope = Leaf | Branch
EMPTY = Leaf("", None, 0, 0)


def leaf(text: str, ends: tuple[int, ...] | None = None) -> Leaf:
    return Leaf(text, ends, len(text) if ends is None else len(ends), len(text))


def join(a: Rope, b: Rope) -> Rope:
    """Both one after the other: the deeper tree takes the other one in at its edge, so that no two
    siblings differ by more than one in depth."""
    if not a.chars or not b.chars:
        return b if not a.chars else a
    if a.depth > b.depth + 1:
        return _level(a.left, join(a.right, b))
    if b.depth > a.depth + 1:
        return _level(join(a, b.left), b.right)
    return _node(a, b)


def _level(a: Rope, b: Rope) -> Branch:
    """A node over two trees that may differ by two in depth: the deeper one is turned."""
    if b.depth > a.depth + 1:
        if b.left.depth > b.right.depth:
            return _node(_node(a, b.left.left), _node(b.left.right, b.right))
        return _node(_node(a, b.left), b.right)
    if a.depth > b.depth + 1:
        if a.right.depth > a.left.depth:
            return _node(_node(a.left, a.right.left), _node(a.right.right, b))
        return _node(a.left, _node(a.right, b))
    return _node(a, b)


def _node(a: Rope, b: Rope) -> Branch:
    return Branch(a, b, a.units + b.units, a.chars + b.chars, 1 + max(a.depth, b.depth))


def build(leaves: list[Leaf]) -> Rope:
    """A balanced tree over leaves, by halves."""
    if len(leaves) < 2:
        return leaves[0] if leaves else EMPTY
    middle = len(leaves) // 2
    return _node(build(leaves[:middle]), build(leaves[middle:]))


def rope(text: str, unit: str = "char", size: int = LEAF) -> Rope:
    """The rope of a text whose units are code points, words (with the blanks before) or lines."""
    if UNITS[unit] is None:
        return build([leaf(text[i : i + size]) for i in range(0, len(text), size)])
    leaves, start, ends = [], 0, []
    for m in regex.finditer(UNITS[unit], text):
        ends.append(m.end() - start)
        if ends[-1] >= size:
            leaves.append(leaf(text[start : m.end()], tuple(ends)))
            start, ends = m.end(), []
    return build([*leaves, leaf(text[start:], tuple(ends))] if ends else leaves)


def split(r: Rope, rank: int, by: str = "units") -> tuple[Rope, Rope]:
    """The first rank units (or code points, by="chars") and the rest."""
    if isinstance(r, Leaf):
        if r.ends is None:
            return leaf(r.text[:rank]), leaf(r.text[rank:])
        if by == "chars":  # units do not matter any more
            return leaf(r.text[:rank]), leaf(r.text[rank:])
        at = r.ends[rank - 1] if rank else 0
        return leaf(r.text[:at], r.ends[:rank]), leaf(r.text[at:], tuple(e - at for e in r.ends[rank:]))
    here = getattr(r.left, by)
    if rank <= here:
        a, b = split(r.left, rank, by)
        return a, join(b, r.right)
    a, b = split(r.right, rank - here, by)
    return join(r.left, a), b


def pieces(r: Rope) -> Iterator[str]:
    """The texts of the leaves in order."""
    todo = [r]
    while todo:
        at = todo.pop()
        if isinstance(at, Leaf):
            yield at.text
        else:
            todo += [at.right, at.left]


def text_of(r: Rope) -> str:
    return "".join(pieces(r))


def find(parts: Iterable[str], what: str) -> int:
    """Code points before the first occurrence of what in a text given in pieces, -1 if there is none."""
    at, tail = 0, ""
    for part in parts:
        hit = (tail + part).find(what)
        if hit >= 0:
            return at - len(tail) + hit
        at += len(part)
        tail = (tail + part)[-(len(what) - 1) :]
    return -1


def draws(doc_id: int | None) -> list[int]:
    """Four numbers below 2^32 that a document's id decides; a null id counts as an empty one."""
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]


@dataclass(frozen=True)
class Plan:
    """Where a text is cut, in units, and how its parts are put together."""

    form: str
    first: int
    second: int


def plan(text: str, units: int, h: list[int], share: int = 90, spm: int = 20) -> Plan:
    """plain for empty texts, texts that hold a sentinel and what is beyond share of a hundred; of
    the others spm of a hundred have the suffix first."""
    a, b = sorted((h[0] % (units + 1), h[1] % (units + 1)))
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= share:
        return Plan("plain", a, b)
    return Plan("spm" if h[3] % 100 < spm else "psm", a, b)


def transform(r: Rope, p: Plan) -> tuple[Rope, int | None, int | None]:
    """(rearranged rope, code points of prefix and of middle); plain ropes stay as they are."""
    if p.form == "plain":
        return r, None, None
    before, suffix = split(r, p.second)
    prefix, middle = split(before, p.first)
    marked = [(PREFIX, prefix), (SUFFIX, suffix)] if p.form == "psm" else [(SUFFIX, suffix), (PREFIX, prefix)]
    out = EMPTY
    for sentinel, part in [*marked, (MIDDLE, middle)]:
        out = join(join(out, leaf(sentinel)), part)
    return out, prefix.chars, middle.chars


def restore(r: Rope, form: str) -> Rope:
    """The rope that transform was given, from its result and form alone."""
    if form == "plain":
        return r
    second = SUFFIX if form == "psm" else PREFIX
    ahead, middle = split(r, find(pieces(r), MIDDLE), "chars")
    one, two = split(ahead, find(pieces(ahead), second), "chars")
    one, two, middle = (split(x, len(PREFIX), "chars")[1] for x in (one, two, middle))
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return join(join(prefix, middle), suffix)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "char", share: int = 90, spm: int = 20, texts: bool = True) -> DataFrame:
    """One row for each row of docs: doc_id, n (units), form, prefix_chars, middle_chars,
    output_sha256, restored_sha256 and, with texts, output.

    A document's id decides its cuts and form, so rows that share one are cut by the same draws.
    Null texts count as empty and come back as empty plain ones; null ids count as an empty id;
    repeated rows keep their rows, an empty table gives none, other columns are not read.
    Texts of any length: a cut copies one leaf, whatever the length.
    """

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        names = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", *(["output"] if texts else []))
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                whole = rope(text or "", unit)
                p = plan(text or "", whole.units, draws(doc_id), share, spm)
                out, prefix, middle = transform(whole, p)
                row = (doc_id, whole.units, p.form, prefix, middle, _sha256(out), _sha256(restore(out, p.form)))
                rows.append((*row, text_of(out)) if texts else row)
            yield dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)) if rows else {n: [] for n in names}

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return map_arrow(rows, run, schema + ", output string" * texts)


def _sha256(r: Rope) -> str:
    digest = hashlib.sha256()
    for part in pieces(r):
        digest.update(part.encode())
    return digest.hexdigest()
