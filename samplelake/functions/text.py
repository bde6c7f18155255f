"""Scalar functions on text, times and sizes, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(c: str | Column) -> Column:
    """Only A to Z change; other scripts keep their case."""
    return F.translate(col(c), UPPER, LOWER)


def lower_ascii(s: str) -> str:
    return s.translate(str.maketrans(UPPER, LOWER))


def contains(c: str | Column, pattern: str) -> Column:
    """Substring, ASCII letters of either case; the empty pattern is in every text."""
    return ascii_lower(c).contains(lower_ascii(pattern))


def like_escape(c: str | Column) -> Column:
    out = col(c)
    for special in ("\\", "%", "_"):
        out = F.replace(out, F.lit(special), F.lit("\\" + special))
    return out


def parse_bpm(c: str | Column) -> Column:
    """0 to 65535 after trimming on the right; a sign + is allowed, a leading blank is not."""
    trimmed = F.regexp_replace(col(c), r"\s+$", "")
    number = F.when(trimmed.rlike(r"^\+?[0-9]+$"), F.expr("1")).isNotNull()
    value = F.try_to_number(F.regexp_replace(trimmed, r"^\+?0*(?=[0-9])", ""), F.lit("999999999999999999"))
    return F.when(number & (F.length(trimmed) <= 18) & (value <= 65535), value.cast("int"))


def ascii_clean(c: str | Column, width: int) -> Column:
    """Characters beyond ASCII become question marks; the first ``width`` stay."""
    return F.substring(F.regexp_replace(col(c), r"[^\x00-\x7F]", "?"), 1, width)


def human_size(n: str | Column) -> Column:
    value, out = col(n).cast("double"), F.concat(col(n).cast("string"), F.lit(" bytes"))
    for unit, size in (("KB", 2.0**10), ("MB", 2.0**20), ("GB", 2.0**30)):
        out = F.when(value >= size, F.concat(F.format_string("%.1f", F.bround(value / size, 1)), F.lit(f" {unit}"))).otherwise(out)
    return out


def thousands(n: str | Column) -> Column:
    return F.format_number(col(n), 0)


def utc_time(seconds: str | Column) -> Column:
    return F.concat(F.date_format(F.timestamp_seconds(col(seconds)), "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))


def duration_text(seconds: str | Column) -> Column:
    """M:SS, from an hour on H:MM:SS."""
    whole = F.round(col(seconds)).cast("long")
    hours, minutes, rest = F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60

    def two(x: Column) -> Column:
        return F.lpad(x.cast("string"), 2, "0")

    short = F.concat(minutes.cast("string"), F.lit(":"), two(rest))
    return F.when(hours > 0, F.concat(hours.cast("string"), F.lit(":"), two(minutes), F.lit(":"), two(rest))).otherwise(short)


def parse_duration(c: str | Column) -> Column:
    """Seconds of M:SS or H:MM:SS; null for anything else."""
    ok = col(c).rlike(r"^[0-9]{1,9}(:[0-9]{1,9}){1,2}$")
    parts = F.transform(F.split(F.when(ok, col(c)), ":"), lambda x: x.cast("long"))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda total, x: total * 60 + x)


def stars(c: str | Column) -> Column:
    """Stars stay; a whole number becomes as many stars, five at most; other text stays."""
    text = col(c)
    return F.when(text.rlike(r"^\*+$"), text).when(text.rlike(r"^[0-9]{1,9}$"), F.repeat(F.lit("*"), F.least(text.try_cast("int"), F.lit(5)))).otherwise(text)


def rating_of_number(c: str | Column, most: int = 5) -> Column:
    """1 to 5 become stars; anything else stays."""
    return F.when(col(c).rlike("^[1-5]$"), F.substring(F.repeat(F.lit("*"), col(c).try_cast("int")), 1, most)).otherwise(col(c))


def format_text(bits: str | Column, channels: str | Column) -> Column:
    return F.concat(col(bits).cast("string"), F.lit("-bit "), F.when(col(channels) == 1, "mono").otherwise("stereo"))


def stem(path: str | Column) -> Column:
    name = basename(path)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def basename(path: str | Column) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def parent(path: str | Column) -> Column:
    return F.regexp_replace(col(path), "/[^/]*$", "")


def extension(path: str | Column) -> Column:
    return F.lower(F.regexp_extract(col(path), r"\.([^./]+)$", 1))


def first_filled(*columns: str | Column) -> Column:
    """The first that is neither null nor empty; else the empty text."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in columns], F.lit(""))


def combine_comments(own: str | Column, other: str | Column) -> Column:
    """The one that isn't empty; of two, the one that has the other in it, else both."""
    a, b = F.coalesce(col(own), F.lit("")), F.coalesce(col(other), F.lit(""))
    return F.when(a == "", b).when(b == "", a).when(b.contains(a), b).when(a.contains(b), a).otherwise(F.concat(a, F.lit(", "), b))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(True)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


#: Keyword groups in the order in which they are tried, and their category.
KEYWORDS = (
    (("kick", "snare", "hihat", "hi-hat", "hi hat", "cymbal", "clap", "tom", "perc", "drum"), "PERC"),
    (("bass", "sub"), "BASS"),
    (("synth", "yamaha", " dx ", "dx-", "moog", "juno", "oberheim", "prophet", "chord", "pad ", "keys"), "SYNT"),
    (("loop", "groove", "beat"), "LOOP"),
    ((" sfx", "effect", "foley", "ambien", "texture"), "SFX "),
    (("vocal", "voice", " vox", "spoken", "choir"), "VOCA"),
    (("guitar", "strum", "string"), "GUIT"),
    (("atmosphere", "atmospheric", "drone", "ambient"), "ATMO"),
    (("stab", "hit", "shot"), "STAB"),
    (("lead", "melody", "melodic"), "LEAD"),
)


def tag_category(category: str | Column, *texts: str | Column) -> Column:
    """A category that is there stays; else that of the first group with a keyword in the texts."""
    corpus = F.lower(F.concat_ws(" ", *[col(t) for t in texts]))
    out = F.lit("")
    for words, tag in reversed(KEYWORDS):
        out = F.when(any_of([corpus.contains(w) for w in words]), tag).otherwise(out)
    return F.when(F.coalesce(col(category), F.lit("")) != "", col(category)).otherwise(out)
