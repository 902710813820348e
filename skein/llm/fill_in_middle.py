"""Fill-in-the-middle: whole texts rearranged as prefix, suffix and middle on ropes.

A rope is a balanced tree over a text. Each node caches how many units and code
points are below it, so that the tree is split at a unit rank by one walk from
the root, and pieces are put together without their characters being copied.
A text becomes a rope, is split at two unit ranks, and its three subtrees are
joined with leaves that hold the sentinels. The inverse makes a rope of the
output, finds the sentinels' code-point ranks, and splits there.

A unit is a code point, or what a pattern matches: matches are taken from left to right, and
what lies between two of them belongs to the first (before the first match: to that one).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, pieces

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
#: The order of the pieces in each form.
ORDERS = {"psm": SENTINELS, "spm": (SUFFIX, PREFIX, MIDDLE)}
#: Code points of a leaf, if its last unit is not longer.
LEAF = 4096
#: Of 100 texts, those that are rearranged, and of these, those with the suffix first.
RATE, SUFFIX_FIRST = 90, 20
#: Bytes of text that a function holds at once (a longer text is alone): outputs are as long again.
HELD_BYTES = 2 << 20


class Node:
    """A leaf with text, or the concatenation of two nodes."""

    __slots__ = ("left", "right", "text", "units", "chars", "height")

    def __init__(self, left, right, text, units: int, chars: int, height: int):
        self.left, self.right, self.text, self.units, self.chars, self.height = left, right, text, units, chars, height


def leaf(text: str, units: int) -> Node | None:
    return Node(None, None, text, units, len(text), 1) if text else None


def _over(a: Node, b: Node) -> Node:
    return Node(a, b, None, a.units + b.units, a.chars + b.chars, 1 + max(a.height, b.height))


def _balanced(a: Node, b: Node) -> Node:
    """a and b, whose heights differ by two at most, under one node of even height."""
    if a.height > b.height + 1:
        if a.left.height >= a.right.height:
            return _over(a.left, _over(a.right, b))
        return _over(_over(a.left, a.right.left), _over(a.right.right, b))
    if b.height > a.height + 1:
        if b.right.height >= b.left.height:
            return _over(_over(a, b.left), b.right)
        return _over(_over(a, b.left.left), _over(b.left.right, b.right))
    return _over(a, b)


def join(a: Node | None, b: Node | None) -> Node | None:
    """The concatenation; a walk as long as the difference of the heights."""
    if a is None or b is None:
        return b if a is None else a
    if a.height > b.height + 1:
        return _balanced(a.left, join(a.right, b))
    if b.height > a.height + 1:
        return _balanced(join(a, b.left), b.right)
    return _over(a, b)


def _unit_starts(text: str, unit: re.Pattern) -> list[int]:
    starts = [m.start() for m in unit.finditer(text)]
    return [0, *starts[1:]] if starts else []


def rope(text: str, unit: re.Pattern | None = None) -> Node | None:
    """The rope of a text; its leaves hold whole units."""
    if unit is None:
        leaves = [leaf(text[k : k + LEAF], min(LEAF, len(text) - k)) for k in range(0, len(text), LEAF)]
    else:
        starts = _unit_starts(text, unit)
        leaves, first = [], 0
        for k in range(1, len(starts)):
            if starts[k] - starts[first] >= LEAF:
                leaves.append(leaf(text[starts[first] : starts[k]], k - first))
                first = k
        leaves.append(leaf(text[starts[first] if starts else 0 :], len(starts) - first))
    level = [x for x in leaves if x is not None]
    while len(level) > 1:  # neighbours in pairs, so that the tree is as even as can be
        level = [_over(*level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0] if level else None


def split(node: Node | None, rank: int, unit: re.Pattern | None = None, chars: bool = False) -> tuple[Node | None, Node | None]:
    """The first `rank` units (or code points) and the rest."""
    if node is None:
        return None, None
    size = node.chars if chars else node.units
    if rank <= 0 or rank >= size:
        return (None, node) if rank <= 0 else (node, None)
    if node.text is not None:
        at, inside = rank, rank
        if unit is not None:
            starts = _unit_starts(node.text, unit)
            at, inside = (rank, sum(s < rank for s in starts)) if chars else (starts[rank], rank)
        return leaf(node.text[:at], inside), leaf(node.text[at:], node.units - inside)
    ahead = node.left.chars if chars else node.left.units
    if rank <= ahead:
        head, rest = split(node.left, rank, unit, chars)
        return head, join(rest, node.right)
    head, rest = split(node.right, rank - ahead, unit, chars)
    return join(node.left, head), rest


def leaves(node: Node | None) -> Iterator[str]:
    waiting = [node] if node else []
    while waiting:
        own = waiting.pop()
        if own.text is not None:
            yield own.text
        else:
            waiting += (own.right, own.left)


def text_of(node: Node | None) -> str:
    return "".join(leaves(node))


def find(node: Node | None, mark: str) -> int:
    """The code-point rank of the first mark, -1 if there is none; a mark may lie over leaves."""
    ahead, tail = 0, ""
    for own in leaves(node):
        at = (tail + own).find(mark)
        if at >= 0:
            return ahead - len(tail) + at
        ahead, tail = ahead + len(own), (tail + own)[1 - len(mark) :]
    return -1


def rearranged(text: str, first: int, second: int, form: str, unit: re.Pattern | None = None, whole: Node | None = None) -> tuple[str, int, int]:
    """(output, code points of the prefix, of the middle) of a text cut at two unit ranks."""
    whole = whole or rope(text, unit)
    head, suffix = split(whole, max(first, second), unit)
    prefix, middle = split(head, min(first, second), unit)
    parts = dict(zip(SENTINELS, (prefix, suffix, middle)))
    out = None
    for mark in ORDERS[form]:
        out = join(join(out, leaf(mark, 0)), parts[mark])
    return text_of(out), prefix.chars if prefix else 0, middle.chars if middle else 0


def restored(output: str, form: str) -> str:
    """The text that an output was made of.

    No sentinel is in a rearranged text, and as each begins with `<` and ends
    with `>`, none arises where pieces meet: the first of each kind is the one put there.
    """
    if form not in ORDERS:
        return output
    rest, parts = rope(output), {}
    order = ORDERS[form]
    for k, mark in enumerate(order):  # what precedes the mark is the piece of the mark before
        piece, rest = split(rest, find(rest, mark), chars=True)
        if k:
            parts[order[k - 1]] = piece
        rest = split(rest, len(mark), chars=True)[1]
    parts[order[-1]] = rest
    return text_of(join(join(parts[PREFIX], parts[MIDDLE]), parts[SUFFIX]))


def draws(doc_id: Column, seed: int = 1) -> list[Column]:
    """Four numbers of 32 bits drawn by the id (a null one as the empty text)."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(key, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


OUTPUT = "struct<n:long,form:string,prefix_chars:long,middle_chars:long,output:string>"


def transformer(unit: str | None = None):
    """A column function (text, four draws) -> OUTPUT."""

    @F.arrow_udf(OUTPUT)
    def transform(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        pattern = re.compile(unit) if unit else None
        for texts, *drawn in columns:
            at, made = 0, []
            for own in pieces(iter([texts]), HELD_BYTES):
                rows = []
                for text, h1, h2, h3, h4 in zip(own, *(d.slice(at, len(own)).to_pylist() for d in drawn)):
                    text = text or ""
                    whole = rope(text, pattern)
                    n = whole.units if whole else 0
                    if not text or h3 % 100 >= RATE or any(s in text for s in SENTINELS):
                        rows.append((n, "plain", None, None, text))
                    else:
                        form = "spm" if h4 % 100 < SUFFIX_FIRST else "psm"
                        output, prefix, middle = rearranged(text, h1 % (n + 1), h2 % (n + 1), form, pattern, whole)
                        rows.append((n, form, prefix, middle, output))
                at += len(own)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                made.append(pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["n", "form", "prefix_chars", "middle_chars", "output"]))
            yield pa.concat_arrays(made) if made else pa.array([], pa.struct([]))

    return transform


def restorer():
    """A column function (output, form) -> the text it was made of."""

    @F.arrow_udf("string")
    def restore(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for outputs, forms in columns:
            at, made = 0, []
            for own in pieces(iter([outputs]), HELD_BYTES):
                made.append(pa.array([restored(o or "", f) for o, f in zip(own, forms.slice(at, len(own)).to_pylist())], pa.string()))
                at += len(own)
            yield pa.concat_arrays(made) if made else pa.array([], pa.string())

    return restore


def transform_documents(docs: DataFrame, seed: int = 1, unit: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """All columns of docs and those of OUTPUT: n (units of the text), form (plain, psm or spm),
    prefix_chars, middle_chars (null if plain) and output.

    Cuts and form follow from the id alone, so repeated rows come out equal; a
    null id is drawn as the empty text. Texts that are null, empty, hold a
    sentinel, or are not drawn stay as they are (null as empty), in the form
    plain. Cuts may fall together or on either end; pieces are then empty. Texts
    are taken whole, whatever their length. An input column of one of these names
    is replaced; an empty table gives an empty result.
    """
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    at = lambda name: F.col(f"c{docs.columns.index(name)}")
    made = plain.withColumn("__fim", transformer(unit)(at(text), *draws(at(doc_id), seed)))
    names = [f.split(":")[0] for f in OUTPUT[7:-1].split(",")]
    keep = [F.col(f"c{i}").alias(n) for i, n in enumerate(docs.columns) if n.lower() not in names]
    return made.select(*keep, *(F.col(f"__fim.{n}").alias(n) for n in names))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars of every row and the sha256 of its output and of
    the text that is rebuilt from output and form."""
    made = transform_documents(pick(docs, "doc_id", "text")).drop("text")
    back = made.withColumn("restored", restorer()("output", "form"))
    return back.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


DIGEST_SQL = """with drawn as (select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
numbers as (select doc_id, text, length(text) as n, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2, cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4 from drawn),
cuts as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
 case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from numbers),
made as (select *, substring(text, 1, a) as p, substring(text, a + 1, b - a) as m, substring(text, b + 1) as s from cuts)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
 sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(text) as restored_sha256 from made"""
