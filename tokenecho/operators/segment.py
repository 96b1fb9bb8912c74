"""Span boundaries. Row-wise operators take arrays of a snapshot's lines or token counts
and return array<struct<s, e, n>>: spans [s, e) of lines with n tokens. Folds stay on
the JVM; an array grows by a span, not by a line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<s:int,e:int,n:int>>"


def _none() -> Column:
    return F.array().cast(SPANS)


def _span(s: Column, e: Column, n: Column) -> Column:
    return F.array(F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"), n.cast("int").alias("n")))


def pack(n: Column, target: int, min_tail: int | None = None, short: bool = False) -> Column:
    """Whole lines until the total reaches target; a tail under min_tail joins the span before it.

    Without min_tail every tail joins. short: what is all tail is a span of its own,
    otherwise it is none.
    """
    start = F.struct(F.lit(0).alias("acc"), F.lit(0).alias("s"), F.lit(0).alias("i"), _none().alias("out"))

    def step(a: Column, x: Column) -> Column:
        acc, i = a["acc"] + x, a["i"] + 1
        full = acc >= target
        return F.struct(
            F.when(full, 0).otherwise(acc).alias("acc"),
            F.when(full, i).otherwise(a["s"]).alias("s"),
            i.alias("i"),
            F.when(full, F.concat(a["out"], _span(a["s"], i, acc))).otherwise(a["out"]).alias("out"),
        )

    def end(a: Column) -> Column:
        last = F.element_at(a["out"], -1)
        joined = F.concat(F.slice(a["out"], 1, F.size(a["out"]) - 1), _span(last["s"], a["i"], last["n"] + a["acc"]))
        alone = F.concat(a["out"], _span(a["s"], a["i"], a["acc"]))
        out = F.when(a["s"] >= a["i"], a["out"])
        if min_tail is not None:
            out = out.when((F.size(a["out"]) > 0) & (a["acc"] >= min_tail), alone)
        return out.when(F.size(a["out"]) > 0, joined).otherwise(alone if short else a["out"])

    return F.aggregate(n, start, step, end)


def from_flags(cut: Column, n: Column) -> Column:
    """Spans that start at line 0 and wherever cut (array<boolean>, by line) is true."""
    size = F.size(n)
    at = F.filter(F.transform(cut, lambda c, i: F.when((i == 0) | F.coalesce(c, F.lit(False)), i)), lambda i: i.isNotNull())
    return F.when(size <= 0, _none()).otherwise(from_starts(at, n))


def from_starts(at: Column, n: Column) -> Column:
    """Spans from sorted starts, the first of which is 0."""
    ends = F.concat(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), F.array(F.size(n)))
    return F.zip_with(at, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e"), _sum(F.slice(n, s + 1, e - s)).alias("n")))


def _sum(n: Column) -> Column:
    return F.aggregate(n, F.lit(0), lambda a, x: a + x)


def from_bounds(bounds: Column, n: Column) -> Column:
    """Any bounds: 0 always counts, those outside the lines do not."""
    size = F.size(n)
    inside = F.filter(bounds, lambda b: (b > 0) & (b < size))
    return F.when(size <= 0, _none()).otherwise(from_starts(F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), inside))), n))


def fixed_line(n: Column, k: int) -> Column:
    return from_flags(F.transform(n, lambda _, i: i % k == 0), n)


def fold_cuts(xs: Column, first: Column, close) -> Column:
    """Starts of spans, by a fold: close(state, x, i) gives (cut before line i, next state)."""
    start = F.struct(first.alias("st"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("at"))

    def step(a: Column, x: Column) -> Column:
        cut, st = close(a["st"], x, a["i"])
        return F.struct(st.alias("st"), (a["i"] + 1).alias("i"), F.when(cut, F.concat(a["at"], F.array(a["i"]))).otherwise(a["at"]).alias("at"))

    return F.aggregate(xs, start, step, lambda a: a["at"])


def fixed_char(lines: Column, n: Column, budget: int) -> Column:
    """Cut before a line once budget characters (and a line end for each line) are reached."""

    def close(acc: Column, x: Column, i: Column):
        cut = acc >= budget
        return cut, F.when(cut, 0).otherwise(acc) + F.length(x) + 1

    return from_bounds(fold_cuts(lines, F.lit(0), close), n)


def anchor_line(numbers: Column, n: Column, k: int) -> Column:
    """Cut where a line's own number crosses a multiple of k."""
    group = F.transform(numbers, lambda x: F.floor(x / k))
    return from_flags(F.transform(group, lambda g, i: (i > 0) & (g != F.get(group, i - 1))), n)


def pack_file(first: Column, n: Column, target: int) -> Column:
    """Line numbers at which spans start when lines from number `first` on are packed."""

    def close(acc: Column, x: Column, i: Column):
        full = acc + x >= target
        return full, F.when(full, 0).otherwise(acc + x)

    after = F.transform(fold_cuts(n, F.lit(0), close), lambda i: first + i + 1)
    return F.array_distinct(F.concat(F.array(first), after))


def cdc_line(bits: Column, n: Column, target: int) -> Column:
    """Content-defined: cut behind a line whose hash has log2(target) low zero bits, between target/4 and 4 target lines."""
    least, most, mask = max(1, target // 4), target * 4, (1 << max(1, target.bit_length() - 1)) - 1

    def close(run: Column, x: Column, i: Column):
        cut = (run + 1 >= least) & ((run + 1 >= most) | (x.bitwiseAND(F.lit(mask)) == 0))
        return cut, F.when(cut, 0).otherwise(run + 1)

    return from_bounds(F.transform(fold_cuts(bits, F.lit(0), close), lambda i: i + 1), n)


def line_bits(lines: Column) -> Column:
    """28 bits of each line's md5."""
    return F.transform(lines, lambda x: F.conv(F.substring(F.md5(x.cast("binary")), 1, 7), 16, 10).cast("bigint"))


def _before(lines: Column, i: Column) -> Column:
    return F.get(lines, i - 1)


def blank(lines: Column, n: Column) -> Column:
    """At a line with content behind a blank one."""
    return from_flags(F.transform(lines, lambda x, i: (i > 0) & (F.trim(x) != "") & (F.trim(_before(lines, i)) == "")), n)


def def_line(lines: Column, n: Column) -> Column:
    """At definitions and decorators, decorators staying with what they decorate."""
    opens = r"^\s*(async\s+def\s|def\s|class\s|@)"
    return from_flags(F.transform(lines, lambda x, i: (i > 0) & x.rlike(opens) & ~F.ltrim(_before(lines, i)).startswith("@")), n)


def _closer(x: Column, words: tuple[str, ...]) -> Column:
    out = x.startswith(words[0])
    for w in words[1:]:
        out = out | x.startswith(w)
    return out


def indent0(lines: Column, n: Column) -> Column:
    """At content in column 0 that closes nothing."""
    return from_flags(F.transform(lines, lambda x, i: (i > 0) & (F.trim(F.substring(x, 1, 1)) != "") & ~_closer(x, (")", "]", "}"))), n)


def indent_min(lines: Column, n: Column) -> Column:
    """At content on the snapshot's least indentation that closes or continues nothing."""
    indent = lambda x: F.length(x) - F.length(F.ltrim(x))
    low = F.array_min(F.transform(F.filter(lines, lambda x: F.trim(x) != ""), indent))
    ends = (")", "]", "}", "elif", "else", "except", "finally")
    flags = lambda m: F.transform(lines, lambda x, i: (i > 0) & (F.trim(x) != "") & (indent(x) == m) & ~_closer(F.ltrim(x), ends))
    return from_flags(F.get(F.transform(F.array(low), flags), F.lit(0)), n)  # the minimum is bound once, not for each line


def merge(spans: Column, least: int) -> Column:
    """Neighbouring spans joined until each has `least` tokens; the remainder joins the last, or stands alone."""
    groups = pack(F.transform(spans, lambda x: x["n"]), least, None, True)
    return F.transform(groups, lambda g: F.struct(F.get(spans, g["s"])["s"].alias("s"), F.get(spans, g["e"] - 1)["e"].alias("e"), g["n"].alias("n")))
