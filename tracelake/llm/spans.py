"""Places of regular-expression matches as DataFrame expressions, and texts with places replaced."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.llm.common import bind

SPAN = "array<struct<start:int,end:int>>"


BLOCK = 256  # matches are put together in blocks, so that time grows with their number and not with its square


def match_spans(text: Column, pattern: Column, group: int = 0) -> Column:
    """Code-point places of the leftmost non-overlapping matches: array of start, end (exclusive), size of a group, word.

    The pieces between the matches and the matches themselves, put one behind the other, are the text again; so their
    lengths give the places. The pattern must not match the empty string.
    """
    words = F.regexp_extract_all(text, pattern, F.lit(0))
    parts = words if group == 0 else F.regexp_extract_all(text, pattern, F.lit(group))
    pieces = F.transform(F.split(text, pattern, F.lit(-1)), lambda p: F.char_length(p))
    none = F.array().cast("array<struct<start:int,end:int,group:int,word:string>>")

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + x["p"]
        end = start + F.char_length(x["w"])
        one = F.struct(start.alias("start"), end.alias("end"), F.char_length(x["g"]).alias("group"), x["w"].alias("word"))
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(one)).alias("out"))

    def placed(steps: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")), lambda b: F.slice(steps, b * BLOCK + 1, BLOCK))
        empty = F.struct(F.lit(0).alias("at"), F.array(none).alias("out"))

        def block(s: Column, of: Column) -> Column:
            done = F.aggregate(of, F.struct(s["at"].alias("at"), none.alias("out")), step)
            return bind(done, lambda d: F.struct(d["at"].alias("at"), F.concat(s["out"], F.array(d["out"])).alias("out")))

        return F.when(F.size(steps) == 0, none).otherwise(F.flatten(F.aggregate(blocks, empty, block, lambda s: s["out"])))

    return bind(bind(words, lambda w: F.arrays_zip(F.slice(pieces, F.lit(1), F.size(w)).alias("p"), w.alias("w"), parts.alias("g"))), placed)


def in_blocks(items: Column) -> Column:
    """An array in arrays of BLOCK; an empty one gives one that is empty."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(items) / BLOCK).cast("int")), lambda b: F.slice(items, b * BLOCK + 1, BLOCK))


def runs(spans: Column) -> Column:
    """Spans, sorted by start, with overlapping and touching ones made one: array of start, end. Put together in blocks."""
    none = F.array().cast(SPAN)
    state = lambda start, end, out: F.struct(start.alias("start"), end.alias("end"), out.alias("out"))
    closed = lambda s: F.when(s["end"] < 0, none).otherwise(F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def step(s: Column, x: Column) -> Column:
        grown = state(s["start"], F.greatest(s["end"], x["end"]), s["out"])
        return F.when(x["start"] <= s["end"], grown).otherwise(state(x["start"], x["end"], F.concat(s["out"], closed(s))))

    def block(s: Column, of: Column) -> Column:
        done = F.aggregate(of, state(s["start"], s["end"], none), step)
        return bind(done, lambda d: state(d["start"], d["end"], F.concat(s["out"], F.array(d["out"]))))

    places = F.transform(spans, lambda x: F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end")))
    empty = state(F.lit(0), F.lit(-1), F.array(none))
    return bind(places, lambda of: bind(F.aggregate(in_blocks(of), empty, block), lambda s: F.concat(F.flatten(s["out"]), closed(s))))


def replace_spans(text: Column, spans: Column, by: str) -> Column:
    """text with every run of overlapping or touching spans (sorted by start) replaced once.

    A place in a text is found by counting from its start. So BLOCK runs at a time are cut out first, and what stands
    between them is counted within that part only.
    """

    def between(gone: Column) -> Column:
        end = lambda of, i, else_: F.coalesce(F.get(of, i)["end"], else_)

        def pieces(block: Column, lo: Column) -> Column:
            part = F.substring(text, lo + 1, end(block, F.size(block) - 1, lo) - lo)
            one = lambda here, x, i: F.substring(here, end(block, i - 1, lo) - lo + 1, x["start"] - end(block, i - 1, lo))
            return bind(part, lambda here: F.transform(block, lambda x, i: one(here, x, i)))

        before = F.transform(in_blocks(gone), lambda block, b: bind(end(gone, b * BLOCK - 1, F.lit(0)), lambda lo: pieces(block, lo)))
        rest = F.substring(text, end(gone, F.size(gone) - 1, F.lit(0)) + 1, F.char_length(text))
        return F.array_join(F.concat(F.flatten(before), F.array(rest)), by)

    return bind(runs(spans), between)
