"""Text expressions: normalising, term patterns, sentence context, page lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that are stripped from both ends of a token (fixed value).
STRIPPED = "()[]{}<>.,;:!?"
#: Ends of sentences (fixed value).
BREAKS = (". ", "? ", "! ", "; ")


def let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize_text(c: Column) -> Column:
    """White space collapsed to single spaces, ends trimmed; Unicode spaces included."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_token(c: Column) -> Column:
    """A token without outer spaces, brackets and punctuation."""
    return F.btrim(F.trim(c), F.lit(STRIPPED))


def escape(c: Column) -> Column:
    """The column's text as a literal regular expression."""
    return F.regexp_replace(c, r"([\\.^$|?*+()\[\]{}\-])", r"\\$1")


def wildcard_pattern(term: Column) -> Column:
    """A term as a whole-word pattern that ignores case; * stands for word characters."""
    return F.concat(F.lit(r"(?iU)\b"), F.regexp_replace(escape(term), r"\\\*", r"\\w*"), F.lit(r"\b"))


def literal_pattern(term: Column) -> Column:
    """A term found anywhere, ignoring case, with any white space where it has a space."""
    return F.concat(F.lit("(?iU)"), F.regexp_replace(escape(normalize_text(term)), " ", r"\\s+"))


def match_list(text: Column, pattern: Column) -> Column:
    """All non-empty matches as array<struct<start,stop,match>>; start is 0-based.

    text and pattern must be plain columns: they are read for every match.
    """
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, pattern, -1)
    zipped = F.zip_with(found, F.slice(gaps, 1, F.greatest(F.size(found), F.lit(1))), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int,match:string>>").alias("all"))
    folded = F.aggregate(
        zipped,
        start,
        lambda a, z: F.struct(
            (a["at"] + z["g"] + F.length(z["m"])).alias("at"),
            F.concat(a["all"], F.array(F.struct((a["at"] + z["g"]).alias("start"), (a["at"] + z["g"] + F.length(z["m"])).alias("stop"), z["m"].alias("match")))).alias("all"),
        ),
        lambda a: a["all"],
    )
    return F.filter(folded, lambda m: m["stop"] > m["start"])


def sentence_context(text: Column, start: Column, stop: Column, min_context: int = 80, radius: int = 300) -> Column:
    """The sentence around text[start:stop]: from the last break within `radius` before, to the first one after; min_context
    characters on a side without break; widened evenly to min_context characters; trimmed."""

    def last_break(back):
        return F.greatest(*[F.when(F.locate(b[::-1], F.reverse(back)) > 0, F.length(back) - F.locate(b[::-1], F.reverse(back)) - 1).otherwise(-1) for b in BREAKS])

    def first_break(ahead):
        return F.least(*[F.when(F.locate(b, ahead) > 0, F.locate(b, ahead) - 1) for b in BREAKS])

    def ends(s):
        begin = F.when(s["last"] >= 0, s["low"] + s["last"] + 2).otherwise(F.greatest(F.lit(0), s["start"] - min_context))
        end = F.when(s["first"].isNotNull(), s["stop"] + s["first"] + 1).otherwise(F.least(s["size"], s["stop"] + min_context))
        return F.struct(s["size"].alias("size"), begin.alias("begin"), end.alias("end"), F.greatest(F.lit(0), F.lit(min_context) - (end - begin)).alias("lack"))

    def widened(s):
        half = F.floor(s["lack"] / 2).cast("int")
        begin, end = F.greatest(F.lit(0), s["begin"] - half), F.least(s["size"], s["end"] + (s["lack"] - half))
        return F.trim(F.substring(text, begin + 1, end - begin))

    size, low = F.length(text), F.greatest(F.lit(0), start - radius)
    last = last_break(F.substring(text, low + 1, start - low)).alias("last")
    first = first_break(F.substring(text, stop + 1, F.least(size, stop + radius) - stop)).alias("first")
    found = F.struct(size.alias("size"), low.alias("low"), start.alias("start"), stop.alias("stop"), last, first)
    return let(let(found, ends), widened)


def is_whole_word(hit: Column, term: Column) -> Column:
    """Whether the hit is the term, or holds it as a whole word."""
    plain = F.lower(normalize_text(hit)) == F.lower(normalize_text(term))
    return plain | F.regexp_like(hit, F.concat(F.lit(r"(?iU)\b"), escape(F.trim(term)), F.lit(r"\b")))


def highlight_segments(context: Column, match: Column) -> Column:
    """array<struct<segment,is_hit>>: the context cut at every occurrence of the match, ignoring case; empty segments are left out."""
    pattern = F.concat(F.lit("(?iu)"), escape(match))
    gaps, hits = F.split(context, pattern, -1), F.regexp_extract_all(context, pattern, F.lit(0))
    both = F.zip_with(gaps, hits, lambda g, h: F.array(F.struct(g.alias("segment"), F.lit(False).alias("is_hit")), F.struct(h.alias("segment"), F.lit(True).alias("is_hit"))))
    whole = F.array(F.struct(context.alias("segment"), F.lit(False).alias("is_hit")))
    return F.when(F.coalesce(F.length(match), F.lit(0)) == 0, whole).otherwise(F.filter(F.flatten(both), lambda s: F.length(s["segment"]) > 0))


def parse_page_spec(spec: Column, total_pages: Column) -> Column:
    """'1-3,7' as struct<pages array<int>, error string>: sorted distinct pages, or the reason why there are none."""
    parts = F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p != "")
    bad = F.exists(parts, lambda p: ~F.regexp_like(p, F.lit(r"^[0-9]{1,9}(\s*-\s*[0-9]{1,9})?$")))
    low = F.transform(parts, lambda p: F.regexp_extract(p, r"^([0-9]+)", 1).try_cast("int"))
    high = F.transform(parts, lambda p: F.regexp_extract(p, r"([0-9]+)$", 1).try_cast("int"))
    ends = F.arrays_zip(low.alias("low"), high.alias("high"))
    error = (
        F.when(F.coalesce(F.size(parts), F.lit(0)) <= 0, "empty")
        .when(bad, "not a page number")
        .when(F.exists(ends, lambda e: e["low"] > e["high"]), "descending range")
        .when(F.exists(ends, lambda e: (e["low"] < 1) | (e["high"] > total_pages)), "out of range")
    )
    pages = F.array_sort(F.array_distinct(F.flatten(F.transform(ends, lambda e: F.sequence(e["low"], e["high"])))))
    return F.struct(F.when(error.isNull(), pages).alias("pages"), error.alias("error"))
