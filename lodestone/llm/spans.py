"""Where a pattern's matches lie in a text, with DataFrame functions alone.

Spark has a text's matches and, by splitting at them, what lies between; adding up their lengths gives each
match's place in code points. The sum runs in blocks, so that a text with very many matches costs a pass over
them and no more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 256
_SPAN = "array<struct<start:int,end:int,value:string>>"


def find(df: DataFrame, text: str, patterns: dict[str, str], accept: dict[str, Callable[[Column], Column]], may: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """`df` with a column for each kind of `patterns`: the accepted matches as array<struct<start, end, value>>.

    Matches are leftmost and don't overlap within a kind; one that `accept` refuses is dropped, and the search
    goes on behind it. ``start`` counts code points from 0, ``end`` is exclusive. `may` names cheap conditions
    without which a kind's pattern can't match. Null texts have no spans.
    """
    may = may or {}
    value = F.coalesce(F.col(text), F.lit(""))
    nothing = F.array().cast("array<string>")
    own = [c for c in df.columns if c not in patterns]
    raw = {k: F.when(may[k](value), F.regexp_extract_all(value, F.lit(p), F.lit(0))).otherwise(nothing) if k in may else F.regexp_extract_all(value, F.lit(p), F.lit(0)) for k, p in patterns.items()}
    df = df.select(*own, *(v.alias(f"_m_{k}") for k, v in raw.items()))
    gaps = {k: F.when(F.size(f"_m_{k}") > 0, F.split(value, p, -1)) for k, p in patterns.items()}
    df = df.select(*df.columns, *(v.alias(f"_g_{k}") for k, v in gaps.items()))

    def steps(k: str) -> Column:
        # both lists are arguments here: named within the function they could be made anew for each match
        one = lambda m, g: F.struct(F.length(g).alias("gap"), F.length(m).alias("len"), accept[k](m).alias("ok") if k in accept else F.lit(True).alias("ok"), m.alias("value"))
        return F.filter(F.zip_with(f"_m_{k}", F.coalesce(f"_g_{k}", nothing), one), lambda x: x["value"].isNotNull())

    df = df.select(*own, *(steps(k).alias(f"_s_{k}") for k in patterns))
    return df.select(*own, *(F.expr(_placed(f"`_s_{k}`")).alias(k) for k in patterns))


def _placed(steps: str) -> str:
    none = f"cast(array() as {_SPAN})"
    span = "named_struct('start', a.pos + x.gap, 'end', a.pos + x.gap + x.len, 'value', x.value)"
    block = f"""aggregate(slice({steps}, b * {BLOCK} + 1, {BLOCK}), named_struct('pos', element_at(blocks, -1).pos, 'spans', {none}),
        (a, x) -> named_struct('pos', a.pos + x.gap + x.len, 'spans', if(x.ok, concat(a.spans, array({span})), a.spans)))"""
    return f"""if(size({steps}) = 0, {none}, flatten(transform(
        aggregate(sequence(0, cast((size({steps}) - 1) div {BLOCK} as int)), array(named_struct('pos', 0, 'spans', {none})), (blocks, b) -> concat(blocks, array({block}))),
        z -> z.spans)))"""


def listed(kinds: list[str], more: Callable[[Column, str], dict[str, Column]] | None = None, by_start: bool = False) -> Column:
    """All spans of the columns `kinds` in one array, by kind and then start, or by start and then kind."""

    def of(k: str, no: int) -> Column:
        def one(s: Column) -> Column:
            place = [s["start"].alias("start"), F.lit(no).alias("no")]
            return F.struct(*(place if by_start else place[::-1]), s["end"].alias("end"), F.lit(k).alias("kind"), s["value"].alias("value"), *(v.alias(n) for n, v in (more(s, k) if more else {}).items()))

        return F.transform(F.col(k), one)

    return F.array_sort(F.concat(*(of(k, no) for no, k in enumerate(kinds))))


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def outside(spans: str, others: str) -> str:
    """SQL for the spans of one column that overlap none of another's; both are ordered by start, and no two of `spans` overlap.

    One pass over all of them in the order of their starts, in blocks.
    """
    pending = "cast(null as struct<start:int,end:int,value:string>)"
    none = f"cast(array() as {_SPAN})"
    events = f"""array_sort(concat(transform({others}, s -> named_struct('start', s.start, 'mine', false, 'end', s.end, 'value', s.value)),
        transform({spans}, s -> named_struct('start', s.start, 'mine', true, 'end', s.end, 'value', s.value))))"""
    span = "named_struct('start', x.start, 'end', x.end, 'value', x.value)"
    step = f"""if(x.mine,
        named_struct('reach', a.reach, 'held', if(a.reach > x.start, {pending}, {span}), 'out', if(a.held is null, a.out, concat(a.out, array(a.held)))),
        named_struct('reach', greatest(a.reach, x.end), 'held', if(a.held.end > x.start, {pending}, a.held), 'out', a.out))"""
    block = f"aggregate(slice(e, b * {BLOCK} + 1, {BLOCK}), named_struct('reach', z.reach, 'held', z.held, 'out', {none}), (a, x) -> {step})"
    walked = f"""transform(array({events}), e -> aggregate(sequence(0, cast((size(e) - 1) div {BLOCK} as int)),
        named_struct('reach', 0, 'held', {pending}, 'outs', cast(array() as array<{_SPAN}>)),
        (z, b) -> transform(array({block}), y -> named_struct('reach', y.reach, 'held', y.held, 'outs', concat(z.outs, array(y.out))))[0],
        z -> concat(flatten(z.outs), if(z.held is null, {none}, array(z.held)))))[0]"""
    return f"if(size({spans}) = 0 or size({others}) = 0, {spans}, {walked})"
