"""Text pipeline as column expressions: clean, split, filter, extract and summarize posts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnquery.functions.arrays import let

# Patterns and words that decide what counts as advertising, knowledge, insight or course.
FLUFF = (
    r"like\s+and\s+share", r"follow\s+(?:me|us)\s+for\s+more", r"don't\s+forget\s+to\s+(?:like|share|follow)", r"what\s+do\s+you\s+think\?",
    r"let\s+me\s+know\s+in\s+the\s+comments", r"tag\s+someone\s+who", r"double\s+tap\s+if", r"swipe\s+left\s+for\s+more", r"link\s+in\s+(?:bio|comments)", r"dm\s+me\s+for",
)
INDICATORS = (
    r"here's\s+(?:how|why|what)", r"key\s+(?:insights?|takeaways?|learnings?)", r"important\s+to\s+(?:know|understand|remember)", r"best\s+practices?\s+(?:for|in)",
    r"tips?\s+(?:for|to)", r"strategies?\s+(?:for|to)", r"framework\s+(?:for|to)", r"methodology\s+(?:for|to)", r"approach\s+(?:to|for)",
)
INSIGHTS = ("key", "important", "crucial", "essential", "critical", "remember", "note", "tip", "strategy", "approach", "best practice", "lesson", "insight", "takeaway")
COURSES = (
    r"course\s+(?:on|about|in)\s+([^.!?]+)", r"learn\s+([^.!?]+)\s+(?:course|training|program)", r"certification\s+(?:in|for)\s+([^.!?]+)",
    r"masterclass\s+(?:on|in)\s+([^.!?]+)", r"workshop\s+(?:on|about)\s+([^.!?]+)",
)
COURSES_WIDE = (
    r"(?:course|training|program|certification|masterclass|workshop|bootcamp)\s+(?:on|about|in|for)\s+([^.!?]{3,50})",
    r"([^.!?]{3,50})\s+(?:course|training|program|certification|masterclass|workshop|bootcamp)",
    r"(?:coursera|udemy|edx|pluralsight|skillshare|udacity)\s+([^.!?]{3,50})",
    r"(?:university|college|academy|institute)\s+(?:of|for)\s+([^.!?]{3,50})", r"(?:bachelor|master|phd|doctorate)\s+(?:in|of)\s+([^.!?]{3,50})",
    r"(?:certified|certification)\s+(?:in|for)\s+([^.!?]{3,50})", r"([^.!?]{3,50})\s+(?:certified|certification)",
)
NO_COURSE = ("the", "and", "for", "with", "this", "that", "how", "what", "why")
STOP_WORDS = (
    "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was", "were", "be", "been", "have", "has", "had", "do", "does", "did",
    "will", "would", "could", "should", "may", "might", "can", "this", "that", "these", "those",
)
URL = r"https?://[^\s]+"


#: What \s matches.
BLANK = " \t\n\x0b\f\r"


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(BLANK))


def squeeze(x: Column) -> Column:
    return strip(F.regexp_replace(x, r"\s+", " "))


def clean_text(text: Column) -> Column:
    """Without tags, mentions and URLs, white space squeezed."""
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"#\w+", ""), r"@\w+", "")
    return squeeze(F.regexp_replace(x, URL, ""))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"[.!?]+"), strip), lambda s: s != "")


def word_count(x: Column) -> Column:
    """Runs of other characters than white space."""
    return F.when(strip(x) == "", 0).otherwise(F.size(F.split(strip(x), r"\s+")))


def fewer_words(x: Column, least: int) -> Column:
    """Whether x has fewer than `least` words, at least one; looks no further than that many."""
    return ~x.rlike(r"\s+".join([r"\S", *[r"\S+"] * (least - 2), r"\S"][: max(1, least)]))


def any_of(patterns: Sequence[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def is_fluff(s: Column, patterns: Sequence[str] = FLUFF, least_words: int = 4) -> Column:
    """Calls to act, very short sentences, and runs of ! or ?."""
    return F.lower(s).rlike(any_of(patterns)) | fewer_words(s, least_words) | s.rlike(r"[!?]{2,}")


def has_indicator(s: Column, patterns: Sequence[str] = INDICATORS) -> Column:
    return F.lower(s).rlike(any_of(patterns))


def knowledge_text(text: Column) -> Column:
    """Sentences that aren't fluff and are indicated or longer than 20, joined by a full stop."""
    return F.array_join(F.filter(sentences(text), lambda s: ~is_fluff(s) & (has_indicator(s) | (F.length(s) > 20))), ". ")


def knowledge_sentences(text: Column, most: int = 5) -> Column:
    keep = lambda s: (F.length(s) >= 20) & ~F.lower(s).rlike(any_of(FLUFF[:7])) & (has_indicator(s, INDICATORS[:8]) | (F.length(s) > 50))
    return F.slice(F.filter(sentences(text), keep), 1, most)


def key_insights(text: Column, most: int = 5) -> Column:
    """The longest sentences that name an insight or are long and no fluff; equal lengths in the text's order."""
    named = lambda s: F.lower(s).rlike("|".join(INSIGHTS))
    kept = F.filter(sentences(text), lambda s: (F.length(s) >= 20) & (((F.length(s) > 50) & ~is_fluff(s)) | named(s)))
    ranked = F.array_sort(F.transform(kept, lambda s, i: F.struct((-F.length(s)).alias("n"), i.alias("i"), s.alias("s"))))
    return F.transform(F.slice(ranked, 1, most), lambda r: r["s"])


def cut(x: Column, most: int) -> Column:
    """At most `most` characters, the last three of a longer text as dots."""
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.left(x, F.lit(most - 3)), F.lit("...")))


def summary(text: Column, most: int = 200) -> Column:
    # bound, as the insights would be worked out at each use
    best = F.array_join(key_insights(text, 3), ". ")
    return let(let(best, lambda b: F.when(b != "", b).otherwise(text)), lambda x: cut(x, most))


def greedy_summary(parts: Column, most: int = 200) -> Column:
    """The first up to three sentences until one would pass `most` characters; nothing after that one."""
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(a, s):
        stop = a["done"] | (a["n"] + F.length(s) > most)
        text = F.when(stop, a["text"]).when(a["text"] == "", s).otherwise(F.concat(a["text"], F.lit(". "), s))
        return F.struct(text.alias("text"), F.when(stop, a["n"]).otherwise(a["n"] + F.length(s)).alias("n"), stop.alias("done"))

    return F.aggregate(F.slice(parts, 1, 3), start, step, lambda a: F.when(a["text"] == "", "").otherwise(F.concat(a["text"], F.lit("."))))


def matches(text: Column, patterns: Sequence[str], least: int, most: int = 1 << 30) -> Column:
    """First groups of all matches in lower case, distinct and sorted, longer than least and shorter than most."""
    found = F.flatten(F.array(*[F.regexp_extract_all(F.lower(text), F.lit(p), 1) for p in patterns]))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, strip), lambda c: (F.length(c) > least) & (F.length(c) < most))))


def course_refs(text: Column) -> Column:
    return matches(text, COURSES, 3)


def up_to_last(text: Column, pattern: str) -> Column:
    """The text to the end of the last match of what a pattern ends with, from its last white space on; else empty.

    All matches of such a pattern are in there, and a long group before the word isn't tried at every place behind it.
    """
    return F.regexp_extract(text, "(?s)^.*" + pattern[pattern.rindex(r"\s+") :], 0)


def course_refs_wide(text: Column) -> Column:
    part = lambda p: up_to_last(F.lower(text), p) if p.startswith("([^") else F.lower(text)
    found = F.flatten(F.array(*[F.regexp_extract_all(part(p), F.lit(p), 1) for p in COURSES_WIDE]))
    plain = F.transform(found, lambda c: squeeze(F.regexp_replace(strip(c), r"[^\w\s&-]", "")))
    return F.array_sort(F.array_distinct(F.filter(plain, lambda c: F.length(c).between(3, 100) & ~c.rlike(r"^\d+$") & ~c.isin(*NO_COURSE))))


def parse_courses(x: Column) -> Column:
    listed = F.filter(F.transform(F.split(x, "[,;]"), strip), lambda c: (F.length(c) > 3) & (F.length(c) < 100))
    return F.when(F.coalesce(F.lower(x), F.lit("")).isin("none", "n/a", ""), F.array().cast("array<string>")).otherwise(listed)


def title_case(x: Column) -> Column:
    """A capital after every character that isn't a letter, small letters elsewhere. A first sharp s becomes Ss."""
    first = lambda w: F.upper(F.left(w, F.lit(1)))
    word = lambda w: F.concat(F.left(first(w), F.lit(1)), F.lower(F.substr(first(w), F.lit(2))), F.substr(w, F.lit(2)))
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(x), F.lit(r"\p{L}+|\P{L}+"), 0), word), "")


def title(text: Column, most: int = 100, default: str = "Post") -> Column:
    first = F.substring_index(text, ".", 1)
    return F.when(F.coalesce(text, F.lit("")) == "", default).when(F.length(first) > 10, cut(strip(first), most)).when(F.length(text) > most, cut(text, most)).otherwise(strip(text))


def engagement(text: Column) -> Column:
    """A count such as 1.2K; the suffix must stand at the number. 0 where there is none."""
    digits = F.regexp_extract(F.upper(F.regexp_replace(text, ",", "")), r"(\d+(?:\.\d+)?)\s*([KMB]?)(?:\b|$)", 1)
    unit = F.regexp_extract(F.upper(F.regexp_replace(text, ",", "")), r"(\d+(?:\.\d+)?)\s*([KMB]?)(?:\b|$)", 2)
    scale = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0)
    return F.coalesce(F.round(F.nullif(digits, F.lit("")).cast("double") * scale), F.lit(0.0)).cast("long")


def keywords(text: Column, stop: Sequence[str] = STOP_WORDS) -> Column:
    """Words of more than three letters that aren't stop words; repeats stay."""
    return F.filter(F.split(strip(F.lower(text)), r"\s+"), lambda w: (F.length(w) > 3) & ~w.isin(*stop))


def image_insight(alt: Column, index: Column) -> Column:
    """What an image's alternative text says, by its place from 1."""
    plain = squeeze(F.regexp_replace(F.regexp_replace(alt, r"(?i)No alternative text description for this image", ""), r"(?i)Image may contain:", ""))
    said = F.when((F.length(plain) > 10) & ~F.lower(plain).rlike(r"^(image|photo|picture)s?$"), plain).otherwise("")
    return F.concat(F.lit("Image "), index.cast("string"), F.lit(": "), F.when(F.length(alt) > 10, said).otherwise("Visual content (infographic/chart/diagram)"))


def reply_section(reply: Column, name: str, names: Sequence[str] = ("KNOWLEDGE", "TOPIC", "COURSES", "SUMMARY")) -> Column:
    """A section of a sectioned reply with its continuation lines, joined by spaces; empty where absent."""
    body = F.regexp_extract(reply, rf"(?s)(?:^|\n)\s*{name}:(.*?)(?=\n\s*(?:{'|'.join(names)}):|$)", 1)
    return squeeze(body)
