"""Text normalisation, token estimates and chunking, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"(?U)\s+"


def let(value: Column, body) -> Column:
    """body of the value, which is computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


def flat(text: Column) -> Column:
    """White-space runs to one space, trimmed."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def paragraphs(text: Column) -> Column:
    """Each blank-line paragraph flat, empty ones gone, joined by blank lines."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), flat)
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")


def tokens(text: Column) -> Column:
    """Estimated tokens: a quarter of the characters, rounded down."""
    return F.floor(F.length(text) / 4).cast("long")


def preview(text: Column, n: int, mark: str = "...") -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(mark))).otherwise(text)


def last_index(text: Column, part: str) -> Column:
    """Zero-based place of the last occurrence, or -1."""
    at = F.instr(F.reverse(text), part[::-1])
    return F.when(at > 0, F.length(text) - at - (len(part) - 1)).otherwise(F.lit(-1))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


SENTENCE_ENDS = (". ", ".\n", "! ", "? ")


def cut_length(window: Column, size: int) -> Column:
    """How much of a full window of `size` characters a chunk takes: up to a blank line past
    60 %; with no blank line, up to a sentence past 70 % or else a space past 80 %; else all."""

    def at(back: Column, part: str) -> Column:
        """Zero-based place of the last occurrence, or -1, in the window whose reverse is `back`."""
        found = F.instr(back, part[::-1])
        return F.when(found > 0, size - found - (len(part) - 1)).otherwise(F.lit(-1))

    def chosen(back: Column) -> Column:
        later = let(F.greatest(*(at(back, e) for e in SENTENCE_ENDS)), lambda sentence: F.when(sentence > size * 0.7, sentence + 2).otherwise(let(at(back, " "), lambda space: F.when(space > size * 0.8, space + 1).otherwise(size))))
        return let(at(back, "\n\n"), lambda blank: F.when(blank > size * 0.6, blank + 2).when(blank == -1, later).otherwise(size))

    return let(F.reverse(window), chosen)


def pieces_of(text: Column, size: int) -> Column:
    """The text in pieces of `size` characters, in one pass."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def part_of(pieces: Column, size: int, start: Column, n: Column) -> Column:
    """n characters, at most `size`, from a zero-based place: of two pieces, wherever it is."""
    k = F.floor(start / size).cast("int")
    return F.substring(F.concat(F.get(pieces, k), F.coalesce(F.get(pieces, k + 1), F.lit(""))), start - k * size + 1, n)


def chunks(text: Column, tokens_each: int = 500, overlap: int = 50) -> Column:
    """Chunks of the normalised text: a fold that carries the start and the cut places. No
    step reads more than two pieces of the text, nor copies what is done."""
    size, back = 4 * tokens_each, 4 * overlap
    least = max(int(size * 0.6) - back, 10)

    def folded(pieces: Column, n: Column) -> Column:
        steps = F.least(F.floor(n / size) + 100, F.floor(n / least) + 2).cast("int")

        def step(state: Column, _: Column) -> Column:
            start = state["start"]
            taken = F.when(start + size < n, cut_length(part_of(pieces, size, start, F.lit(size)), size)).otherwise(n - start)

            def moved(end: Column) -> Column:
                next_ = F.when(end >= n, n).when(end - back <= start + 10, start + max(10, size // 2)).otherwise(end - back)
                return F.struct(next_.cast("int").alias("start"), F.concat(state["cuts"], F.array(F.struct(start.alias("s"), end.alias("e")))).alias("cuts"))

            return F.when(start >= n, state).otherwise(let((start + taken).cast("int"), moved))

        empty = F.struct(F.lit(0).alias("start"), F.array().cast("array<struct<s:int,e:int>>").alias("cuts"))
        cuts = F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), empty, step, lambda state: state["cuts"])
        cut = F.transform(cuts, lambda c: strip(part_of(pieces, size, c["s"], c["e"] - c["s"])))
        return F.filter(cut, lambda c: c != "")

    return let(text, lambda t: let(F.length(t), lambda n: let(pieces_of(t, size), lambda pieces: folded(pieces, n))))


def token_chunks(tokens: Column, size: int, overlap: int) -> Column:
    """Runs of `size` tokens, each `overlap` before the last one's end; an overlap that leaves
    no progress counts as half a run. No run starts once one has reached the end."""
    ahead = size - overlap if overlap < size else max(1, size // 2)

    def cut(all_: Column) -> Column:
        last = F.greatest(F.ceil((F.size(all_) - size) / ahead), F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(all_, i * ahead + 1, F.lit(size)))

    return let(tokens, lambda all_: F.when(F.size(all_) > 0, cut(all_)).otherwise(F.array().cast("array<array<string>>")))


def break_point(text: Column, target: Column, reach: int = 200) -> Column:
    """Best place to break within `reach` of the target: blank line, sentence, space, target."""
    start = F.greatest(F.lit(0), target - reach)
    part = F.substring(text, start + 1, F.least(F.length(text), target + reach) - start)
    blank, space = last_index(part, "\n\n"), last_index(part, " ")
    sentence = F.greatest(*(last_index(part, e) for e in SENTENCE_ENDS))
    return F.when(blank >= 0, start + blank + 2).when(sentence >= 0, start + sentence + 2).when(space >= 0, start + space + 1).otherwise(target)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, SPACES), lambda w: w != ""))


def packed(text: Column, size: int = 2000) -> Column:
    """Paragraphs packed greedily to at most `size` words; a longer one goes sentence by
    sentence. The pieces carry the ends that they are joined with."""
    pieces = F.flatten(F.transform(F.split(text, "\n\n"), lambda p: F.when(word_count(p) > size, F.transform(F.split(p, r"\. "), lambda s: F.struct(F.concat(s, F.lit(". ")).alias("t"), word_count(s).alias("n")))).otherwise(F.array(F.struct(F.concat(p, F.lit("\n\n")).alias("t"), word_count(p).alias("n"))))))
    start = F.struct(F.lit("").alias("now"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("done"))

    def step(s: Column, x: Column) -> Column:
        fits = s["n"] + x["n"] <= size
        full = F.when(s["now"] != "", F.concat(s["done"], F.array(strip(s["now"])))).otherwise(s["done"])
        return F.struct(F.when(fits, F.concat(s["now"], x["t"])).otherwise(x["t"]).alias("now"), F.when(fits, s["n"] + x["n"]).otherwise(x["n"]).alias("n"), F.when(fits, s["done"]).otherwise(full).alias("done"))

    return F.aggregate(pieces, start, step, lambda s: F.when(s["now"] != "", F.concat(s["done"], F.array(strip(s["now"])))).otherwise(s["done"]))
