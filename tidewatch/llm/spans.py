"""Spans of regular expressions as columns: where Spark's built-in functions give the matches but not their places.

The work is linear in the text and the matches, so that a long text full of matches costs no more than as many short
ones: nothing is sought from the start of the text for each match, and what is gathered grows by blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:bigint,end:bigint,match:string,part:string,near:boolean>>"
#: Code points of the text before and after a span that are its context.
NEAR = 40
#: Matches beside a span that may lie within NEAR code points of it: each has four characters at least.
BESIDE = NEAR // 4 + 1
#: Code points of a block of what blocks() cuts.
CHUNK = 1024


def none_found() -> Column:
    return F.array().cast(SPAN)


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once, however often f names it, also inside functions of elements."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def running(numbers: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each number of an array of bigint, what op, which is associative, makes of the numbers up to it.

    An array that grows by a number at a time is copied as often, so the numbers are taken in as many blocks as a block
    has numbers, and each block grows on its own.
    """

    def prefixes(xs: Column) -> Column:
        def longer(acc: Column, x: Column) -> Column:
            return F.concat(acc, F.array(F.coalesce(op(F.get(acc, F.size(acc) - 1), x), x)))

        return F.aggregate(xs, F.array().cast("array<bigint>"), longer)

    def in_blocks(xs: Column, width: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.ceil(F.size(xs) / width).cast("int") - 1), lambda k: prefixes(F.slice(xs, k * width + 1, width)))
        return once(cut, lambda bs: once(prefixes(F.transform(bs, lambda b: F.element_at(b, -1))), lambda upto: joined(bs, upto)))

    def joined(bs: Column, upto: Column) -> Column:
        return F.flatten(F.transform(bs, lambda b, k: F.when(k == 0, b).otherwise(F.transform(b, lambda v: op(F.get(upto, k - 1), v)))))

    def whole(xs: Column) -> Column:
        return F.when(F.size(xs) == 0, xs).otherwise(once(F.ceil(F.sqrt(F.size(xs))).cast("int"), lambda width: in_blocks(xs, width)))

    return once(numbers, whole)


def _beside(z: Column, i: Column, context: str) -> tuple[Column, Column]:
    """Whether a word of context stands before, and after, match i of z: (tail, head, match) of what lies between."""
    def texts(places: range, side: str) -> Column:
        def of(k: Column) -> Column:
            x = F.get(z, i + k)
            return F.concat(F.coalesce(x[side], F.lit("")), F.coalesce(x["match"], F.lit("")))

        return F.array_join(F.transform(F.array(*map(F.lit, places)), of), "")

    before = F.right(F.concat(texts(range(-BESIDE, 0), "tail"), F.get(z, i)["tail"]), F.lit(NEAR))
    after = F.left(texts(range(1, BESIDE + 1), "head"), F.lit(NEAR))
    return F.lower(before).rlike(context), F.lower(after).rlike(context)


def find(text: Column, pattern: str, group: int = 0, context: str | None = None) -> Column:
    """The leftmost non-overlapping matches of pattern in text, in order.

    Each has start and end in code points, end exclusive, the match itself, the part that group caught, and near: whether
    a word of context, an expression for lower case, stands in the NEAR code points before or after it. In a list, what
    is near before one match holds for the next one, if that starts at most NEAR code points after it. The pieces that
    split() leaves between matches give the places: a match starts where the pieces and matches before it end. pattern
    must not match the empty string, nor, with context, less than four characters. No match gives an empty array; text
    must not be null.
    """
    zipped = F.arrays_zip(
        F.split(text, pattern, -1).alias("piece"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"),
    )

    def brief(x: Column) -> Column:
        piece, match = x["piece"], x["match"]
        ends = [F.right(piece, F.lit(NEAR)).alias("tail"), F.left(piece, F.lit(NEAR)).alias("head")] if context else []
        return F.struct(F.length(piece).cast("long").alias("gap"), F.coalesce(F.length(match), F.lit(0)).cast("long").alias("size"), match.alias("match"), x["part"].alias("part"), *ends)

    def beside(z: Column) -> Column:
        def of(x: Column, i: Column) -> Column:
            before, after = _beside(z, i, context)
            return F.struct(*(x[c].alias(c) for c in ("gap", "size", "match", "part")), before.alias("before"), after.alias("after"))

        return F.transform(z, of)

    def ends(xs: Column) -> Column:
        return running(F.transform(xs, lambda x: x["gap"] + x["size"]), lambda a, b: a + b)

    def said(xs: Column) -> Column:
        """For each place, the last one up to it at which context stands before (2i + 1) or a list ends (2i), or -1."""
        of = lambda x, i: F.when(x["before"], i * 2 + 1).when(x["gap"] > NEAR, i * 2).otherwise(-1).cast("long")
        return running(F.transform(xs, of), F.greatest)

    def spans(xs: Column, upto: Column, last: Column | None = None) -> Column:
        def span(x: Column, i: Column) -> Column:
            end = F.get(upto, i)
            near = F.lit(False) if last is None else (F.pmod(F.get(last, i), F.lit(2)) == 1) & (F.get(last, i) >= 0) | x["after"]
            return F.struct((end - x["size"]).alias("start"), end.alias("end"), x["match"].alias("match"), x["part"].alias("part"), near.alias("near"))

        return F.filter(F.transform(xs, span), lambda s: s["match"].isNotNull())

    def placed(xs: Column) -> Column:
        return once(ends(xs), lambda upto: once(said(xs), lambda last: spans(xs, upto, last)) if context else spans(xs, upto))

    whole = F.transform(zipped, brief)
    return once(once(whole, beside) if context else whole, placed)


def blocks(text: Column) -> Column:
    """A text in blocks of CHUNK code points, for between()."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def between(chunks: Column, start: Column, end: Column) -> Column:
    """The code points from start to end of a text given in blocks: no more than the blocks that hold them are read."""
    first, last = (F.floor(x / CHUNK).cast("int") for x in (start, end))
    begin, stop = (start % CHUNK).cast("int"), (end % CHUNK).cast("int")
    part = lambda i: F.coalesce(F.get(chunks, i), F.lit(""))
    inner = F.substr(part(first), begin + 1, stop - begin)
    outer = F.concat(F.substr(part(first), begin + 1), F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substr(part(last), F.lit(1), stop))
    return F.when(first == last, inner).otherwise(outer)


def listed(kinds: dict[str, Column], by: str = "start") -> Column:
    """One sorted array of (start, kind_no, end, kind) from the spans of several kinds, by start or by kind first."""

    def of(no: int, kind: str, spans: Column) -> Column:
        k = F.lit(no).alias("kind_no")
        order = (lambda s: (s["start"], k)) if by == "start" else (lambda s: (k, s["start"]))
        return F.transform(spans, lambda s: F.struct(*order(s), s["end"].alias("end"), F.lit(kind).alias("kind")))

    out = [of(no, kind, spans) for no, (kind, spans) in enumerate(kinds.items())]
    return F.array_sort(F.concat(*out))


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
