"""Small building blocks over array columns.

A page is one row and its elements are one array, so everything that looks
inside a page is a narrow projection: no exchange, no Python worker.  The
helpers here keep that cheap for very large pages too; none of them compares
all pairs of elements.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache, wraps

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_application(build: Callable[..., Column]) -> Callable[..., Column]:
    """Remember a column built from hashable arguments.

    A large expression takes thousands of calls into the JVM to build; a column
    refers to names only, so one copy serves every DataFrame of an application.
    """

    @lru_cache(maxsize=256)
    def cached(application: str, *args) -> Column:
        return build(*args)

    @wraps(build)
    def call(*args) -> Column:
        return cached(SparkContext._active_spark_context.applicationId, *args)

    return call


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    A fold over nothing: the value is the start of the fold and ``body`` its
    finish.  Unlike a one-element ``transform`` this copies neither the value
    nor the result, which matters when they are whole pages.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda acc, _: acc, body)


def empty(element_type: str) -> Column:
    return F.array().cast(f"array<{element_type}>")


def fixed_map(values: dict, map_type: str) -> Column:
    """A constant map; folded once when the query is planned."""
    return F.from_json(F.lit(json.dumps(values)), map_type)


def at(arr: Column, index: Column | int) -> Column:
    """Zero-based access, null when out of range."""
    return F.get(arr, index if isinstance(index, Column) else F.lit(index))


def null_if_empty(arr: Column) -> Column:
    return F.when(F.size(arr) > 0, arr)


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later projections and filters cannot inline.

    Catalyst merges adjacent projections; an expensive expression that is used
    inside a lambda would then be evaluated once per element.  A one-row
    generator is not merged, so the value is computed exactly once per row.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def scan(
    items: Column,
    init: Column,
    step: Callable,
    out_type: str,
    finish: Callable[[Column, Column], Column],
) -> Column:
    """Left fold that also emits rows.

    ``step(state, out, item, then)`` returns ``then(next_state, next_out)``,
    possibly chosen by ``when``; ``finish(state, emitted)`` builds the result.
    """
    return scan_in_blocks(
        items,
        init,
        lambda st: st,
        lambda st, out, item, then, _: step(st, out, item, then),
        lambda _, st: st,
        out_type,
        finish,
    )


def scan_in_blocks(
    items: Column,
    init: Column,
    enter: Callable[[Column], Column],
    step: Callable,
    leave: Callable[[Column, Column], Column],
    out_type: str,
    finish: Callable[[Column, Column], Column],
) -> Column:
    """``scan`` with a state of two parts: one for the block at hand, one for all before.

    ``aggregate`` copies its accumulator at every step, so one growing array
    would be quadratic.  The fold therefore runs in blocks of blocks, each of
    about the cube root of the input: a step copies only the rows and the state
    of its own block, and what a block leaves is appended once per level.  A
    block starts with ``enter(state)``; its steps see the state before the block
    as fifth argument without copying it; ``leave(state, local)`` merges the two.
    """

    def run(src: Column, block: Column) -> Column:
        last = F.floor((F.size(src) - 1) / block).cast("int")

        def indices(start: Column, stop: Column) -> Column:
            return F.when(start <= stop, F.sequence(start, stop)).otherwise(empty("int"))

        def one_block(acc: Column, b: Column) -> Column:
            def one_item(a: Column, item: Column) -> Column:
                return step(a["st"], a["out"], item, _state, acc["st"])

            return F.aggregate(
                F.slice(src, b * block + 1, block),
                _state(enter(acc["st"]), empty(out_type)),
                one_item,
                lambda a: _state(
                    leave(acc["st"], a["st"]), F.concat(acc["out"], F.array(a["out"]))
                ),
            )

        def many_blocks(acc: Column, s: Column) -> Column:
            return F.aggregate(
                indices(s * block, F.least(s * block + block - 1, last)),
                _state(acc["st"], empty(f"array<{out_type}>")),
                one_block,
                lambda a: _state(
                    a["st"], F.concat(acc["out"], F.array(F.flatten(a["out"])))
                ),
            )

        return F.aggregate(
            indices(F.lit(0), F.floor(last / block).cast("int")),
            _state(init, empty(f"array<{out_type}>")),
            many_blocks,
            lambda a: finish(a["st"], F.flatten(a["out"])),
        )

    def sized(src: Column) -> Column:
        block = F.greatest(F.lit(16), F.cbrt(F.size(src)).cast("int"))
        return let(block, lambda b: run(src, b))

    return let(items, sized)


def _state(st: Column, out: Column) -> Column:
    return F.struct(st.alias("st"), out.alias("out"))


def splice(base: Column, patch: Column, spans: Column) -> Column:
    """``base`` with the half-open index ranges ``spans`` taken from ``patch``.

    ``spans`` is a bound, ordered array of disjoint ``struct<lo, hi>``; both
    arrays have the same length.  Linear: the result is a flatten of slices.
    """

    def run(both: Column) -> Column:
        old, new = both["old"], both["new"]

        def piece(span: Column, i: Column) -> Column:
            start = F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["hi"])
            return F.concat(
                F.slice(old, start + 1, span["lo"] - start),
                F.slice(new, span["lo"] + 1, span["hi"] - span["lo"]),
            )

        tail = F.coalesce(F.get(spans, F.size(spans) - 1)["hi"], F.lit(0))
        return F.concat(
            F.flatten(F.transform(spans, piece)),
            F.slice(old, tail + 1, F.size(old) - tail),
        )

    return let(F.struct(base.alias("old"), patch.alias("new")), run)


def outermost(intervals: Column, element_type: str, lo: str, hi: str) -> Column:
    """Drop every interval that lies inside an earlier one (input ordered by ``lo``)."""
    return scan(
        intervals,
        F.lit(-1),
        lambda reach, out, e, then: F.when(
            e[lo] > reach, then(e[hi], F.concat(out, F.array(e)))
        ).otherwise(then(reach, out)),
        element_type,
        lambda reach, out: out,
    )


def covered(spans: Column, size: Column) -> Column:
    """Boolean array of length ``size``: true inside the disjoint ordered ``spans``."""
    yes, no = F.array_repeat(F.lit(True), size), F.array_repeat(F.lit(False), size)
    return splice(no, yes, spans)


def marked(positions: Column, size: Column) -> Column:
    """Boolean array of length ``size``: true at the given positions."""
    spans = F.transform(
        F.sort_array(F.array_distinct(positions)),
        lambda p: F.struct(p.alias("lo"), (p + 1).alias("hi")),
    )
    return let(spans, lambda s: covered(s, size))
