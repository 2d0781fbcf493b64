"""Splitting, cleaning and measuring text with built-in functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "\u0001"
#: Headers, emphasis, quotes, list marks, numbered items and colons.
MARKDOWN = r"#{1,6}\s|\*\*|\*|__|_|>|- |\+ |\d+\.\s|:"
#: A token: a word or a single other symbol.
TOKEN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]"


def stripped(c: Column) -> Column:
    """Without white space at both ends (``trim`` knows spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _full(parts: Column) -> Column:
    return F.filter(F.transform(parts, stripped), lambda p: p != "")


def split_keeping(text: Column, pattern: str = r"\d+\.\d+\.\d+\s") -> Column:
    """Split at ``pattern`` and keep what it matched; stripped, no blanks."""
    return _full(F.split(F.regexp_replace(text, f"({pattern})", f"{MARK}$1{MARK}"), MARK))


def split_markdown(text: Column) -> Column:
    return _full(F.split(text, MARKDOWN))


def split_delimiters(text: Column, delimiters: tuple[str, ...] = (";", ",", "|")) -> Column:
    """Split at any of the literal delimiters; blanks stay."""
    return F.split(text, "|".join(re.escape(d) for d in delimiters))


def split_spaces(text: Column) -> Column:
    return F.split(text, r"\s{2,}")


def split_capitals(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[A-Z][a-z]*"), F.lit(0))


def split_literal(text: Column, delimiter: str) -> Column:
    return F.split(text, re.escape(delimiter))


def transcript_segments(text: Column, delimiter: str = "\n\n") -> Column:
    """Trim, split at the delimiter, trim each; blanks stay."""
    return F.transform(split_literal(stripped(text), delimiter), stripped)


def sentences(text: Column) -> Column:
    return F.split(text, r"\. ")


def title_and_body(text: Column) -> tuple[Column, Column]:
    """Before and after the first newline, both stripped; no newline, no body."""
    parts = F.split(text, "\n", 2)
    return stripped(F.get(parts, F.lit(0))), F.coalesce(stripped(F.get(parts, F.lit(1))), F.lit(""))


#: Patterns and what replaces them, in order.
CLEANING = ((r"Part\s*\d+", ""), (r"P\s*\d+", ""), ("(?i)Tapestry", "Synergy"), ("(?i)Tapestries", "Synergies"))


def clean_segment(text: Column) -> Column:
    """Part marks removed, then the two words replaced, in this order and in any case of letters."""
    for pattern, by in CLEANING:
        text = F.regexp_replace(text, pattern, by)
    return text


def capitalized(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 2**30)))


def fill_prompt(template: Column, option: Column, dynamic: Column, name: Column, description: Column | None = None) -> Column:
    """The prompt "name - text!": {option} and {dynamic_prompt} filled in, the text capitalized as one sentence, white space collapsed.

    Every place that reads as the option, in any case of letters and in the
    name too, is wrapped in asterisks as it stands. A null template takes the
    description.
    """
    filled = F.replace(F.replace(template, F.lit("{option}"), option), F.lit("{dynamic_prompt}"), dynamic)
    filled = F.coalesce(capitalized(filled), F.lit(None).cast("string") if description is None else description)
    whole = stripped(F.regexp_replace(F.concat(name, F.lit(" - "), filled), r"\s+", " "))
    parts = F.split(whole, " - ", 2)
    whole = F.concat(F.get(parts, F.lit(0)), F.lit(" - "), capitalized(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))), F.lit("!"))
    quoted = F.concat(F.lit("(?iu)\\Q"), F.replace(option, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.regexp_replace(whole, quoted, F.lit("*$0*"))


def descriptor(options: Column) -> Column:
    """An array of option names as one string for an encoder: no quotes or brackets, a newline for each comma."""
    return F.replace(F.translate(F.array_join(options, ", "), "'[]", ""), F.lit(","), F.lit("\n"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN))


def discounted_tokens(n: Column, similarity: Column, weight: float) -> Column:
    return (n * (1 - weight * similarity)).cast("int")


def words(text: Column) -> Column:
    """Words between white space, without blanks."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def novelty(message: Column, history: Column) -> Column:
    """How far a message's words are from the history's, damped by a long history and a short message; 0 if both are empty."""
    a, b = (F.array_distinct(words(F.lower(x))) for x in (message, history))
    n, m = F.size(a), F.size(b)
    overlap = F.size(F.array_intersect(a, b))
    damp = F.greatest(1 - F.size(words(history)) / 5, F.lit(0.2)) * F.greatest(n / 5, F.lit(0.2))
    value = (1 - 2 * overlap / F.greatest(n + m, F.lit(1))) * damp
    return F.when(n + m == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def truncate_sentences(text: Column, most: int = 2000) -> Column:
    """Leading sentences while what is kept and the next stay under ``most`` characters; stops at the first that does not."""

    def step(a, s):
        fits = ~a["full"] & (F.length(a["out"]) + F.length(s) < most)
        return F.struct(F.when(fits, F.concat(a["out"], s, F.lit("."))).otherwise(a["out"]).alias("out"), (~fits).alias("full"))

    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("full"))
    return F.aggregate(F.filter(F.split(text, r"\."), lambda s: stripped(s) != ""), start, step, lambda a: a["out"])


def chunks(text: Column, size: int = 200, least_cut: int = 350, least: int = 5, most: int = 10_000) -> Column:
    """Chunks of up to ``size`` tokens, as an array of strings.

    A chunk is cut back to its last ``. ? !`` or newline if that stands after
    ``least_cut`` characters; newlines become spaces, chunks of ``least``
    characters or fewer go, and so does what follows ``most`` chunks, a limit
    of the operator. Tokens here are runs of non-space with the space
    before them, so joined tokens give the text again.
    """
    # Runs of ``size`` tokens, whose texts are joined and searched once a chunk, not once a token.
    runs = F.regexp_extract_all(text, F.lit(rf"(?:\s*+\S++){{1,{size}}}"), F.lit(0))
    bound = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))  # noqa: E731  (a lambda's variable is computed once)

    def cut(a, _):
        def take(whole):
            last = F.length(F.regexp_extract(whole, r"(?s)^.*[.?!\n]", 0))
            head = F.when(last > least_cut, F.substring(whole, F.lit(1), last)).otherwise(whole)
            return bound(head, lambda h: F.struct(F.substring(a["open"], F.length(h) + 1, F.length(a["open"])).alias("open"), F.array_append(a["out"], h).alias("out"), F.lit(True).alias("more")))

        full = bound(F.regexp_extract(a["open"], rf"^(?:\s*+\S++){{{size}}}", 0), lambda w: F.when(w != "", take(w)).otherwise(F.struct(a["open"].alias("open"), a["out"].alias("out"), F.lit(False).alias("more"))))
        return F.when(a["more"], full).otherwise(a)

    def step(a, run):
        # Each cut takes over ``least_cut`` characters or ``size`` tokens, which have twice as many less one: there are no more cuts than these.
        least_taken = min(least_cut + 1, 2 * size - 1)
        return bound(F.concat(a["open"], run), lambda whole: F.aggregate(
            F.sequence(F.lit(0), F.floor(F.length(whole) / least_taken).cast("int")),
            F.struct(whole.alias("open"), a["out"].alias("out"), F.lit(True).alias("more")),
            cut,
        ))

    start = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("out"), F.lit(True).alias("more"))
    found = F.aggregate(runs, start, step, lambda a: F.array_append(a["out"], a["open"]))
    clean = F.filter(F.transform(found, lambda c: stripped(F.replace(c, F.lit("\n"), F.lit(" ")))), lambda c: F.length(c) > least)
    return F.slice(clean, 1, most)


#: Ten numerals.
ROMAN = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X")


def sequence_labels(last: Column) -> Column:
    """Labels "A-I" ... from A to the letter ``last``, ten each."""
    letters = F.transform(F.sequence(F.lit(65), F.ascii(F.upper(last))), lambda c: F.char(c))
    return F.flatten(F.transform(letters, lambda c: F.transform(F.array(*[F.lit(r) for r in ROMAN]), lambda r: F.concat(c, F.lit("-"), r))))


def part_lengths(parts: Column) -> Column:
    """Number of paragraphs of each part of a content; an empty array without parts."""
    return F.coalesce(F.transform(parts, lambda p: F.size(F.split(p, "\n\n"))), F.array().cast("array<int>"))


def epoch(s: Column, now: Column) -> Column:
    """Seconds since 1970 of an ISO-like date or time; ``now`` where it cannot be read."""
    return F.coalesce(F.unix_timestamp(F.try_to_timestamp(s)), now)


def seconds(ts: Column) -> Column:
    """Seconds since the epoch with fractions, as a double."""
    return F.unix_micros(ts) / 1e6


def stamped(df, ts: Column | None = None, name: str = "timestamp"):
    """``df`` with an ISO time stamp, by default the time of the query."""
    return df.withColumn(name, F.date_format(F.current_timestamp() if ts is None else ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def backoff(retry: Column, base: float = 1.0, most: float = 60.0, jitter: Column | None = None) -> Column:
    """Seconds to wait before a retry: ``base`` doubled for each, ``most`` at most, times a jitter in [0, 1]."""
    wait = F.least(F.lit(base) * F.pow(F.lit(2.0), retry), F.lit(most))
    return wait if jitter is None else wait * jitter


def put(meta: Column, key: str, value: Column) -> Column:
    """A map with ``key`` set."""
    return F.map_concat(F.map_filter(meta, lambda k, v: k != key), F.create_map(F.lit(key), value))


def removed(meta: Column, key: str) -> Column:
    """A map without ``key``; as it is if it has none."""
    return F.map_filter(meta, lambda k, v: k != key)


def records(keys: Column, values: Column) -> Column:
    """Arrays of keys and values as one map; the shorter decides, and a later key wins."""
    n = F.least(F.size(keys), F.size(values))
    entries = F.arrays_zip(F.slice(keys, 1, n).alias("key"), F.slice(values, 1, n).alias("value"))
    last = F.filter(entries, lambda e, i: ~F.array_contains(F.transform(F.slice(entries, i + 2, F.greatest(n - i - 1, F.lit(0))), lambda x: x["key"]), e["key"]))
    return F.map_from_entries(last)
