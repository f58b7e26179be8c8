"""Post-processing of answers: markup, sentences, length limits, grounding. JVM expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.text import SPACE, contains_any, let, lower, sentences, strip, trim

# fixed values: markup that answers are rid of, in the order of replacement, and how many rounds
# nested links take at most
_LINK, _IMAGE, _ROUNDS = r"\[([^\]]*)\]\([^)]*\)", r"!\[([^\]]*)\]\([^)]*\)", 24
LIGHT = (("[`#>]+", ""), ("\n{3,}", "\n\n"), (r"\*\*\s+", "**"), (r"\*\*([^*]+)\*\*([А-Яа-яA-Za-z«(])", r"**$1** $2"))
LINKLESS = ((r"https?://[^\s)]+", ""), (r"\s{2,}", " "), (r"\(\s*\)", ""))
PLAIN = ((r"\*\*([^*]+)\*\*", "$1"), ("__([^_]+)__", "$1"), (r"(?<!\*)\*([^*]+)\*(?!\*)", "$1"), (r"https?://[^\s\])]+", ""), (r"[*_`#>\[\]]", ""), (r"\s+", " "))


def _replaced(t: Column, table) -> Column:
    for pattern, to in table:
        t = F.regexp_replace(t, pattern, to)
    return F.trim(t)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(text: Column) -> Column:
    """Runs without white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _bare_links(t: Column) -> Column:
    """Markdown links as their text, nested ones from the inside out; then images."""
    inner = F.aggregate(F.sequence(F.lit(1), F.lit(_ROUNDS)), t, lambda a, _: F.when(F.contains(a, F.lit("](")), F.regexp_replace(a, _LINK, "$1")).otherwise(a))
    return F.regexp_replace(inner, _IMAGE, "$1")


def sanitize_markdown(text: Column | str) -> Column:
    """Light markdown: no back-ticks, hashes or quotes; bold marks hug their text."""
    return _replaced(_c(text), LIGHT)


def tagged(text: Column | str) -> tuple[Column, Column]:
    """The ``<display>`` and ``<speaker>`` parts; without the first the whole text is shown."""
    t = _c(text)
    shown = F.regexp_extract(t, r"(?s)<display>\s*(.*?)\s*</display>", 1)
    return F.when(t.rlike(r"(?s)<display>.*?</display>"), F.trim(shown)).otherwise(F.trim(t)), F.trim(F.regexp_extract(t, r"(?s)<speaker>\s*(.*?)\s*</speaker>", 1))


def strip_links(text: Column | str) -> Column:
    return _replaced(_bare_links(F.trim(_c(text))), LINKLESS)


def strip_link_soup(text: Column | str, most_links: int = 4, under: int = 800, cut_at: str = r"/pubs\?", cut_from: int = 8) -> Column:
    """Cuts at a list of starred links, and in a text of ``cut_from`` links or more at the first
    one to ``cut_at``; drops short lines that are mostly links. The text itself if nothing is
    left."""
    links = lambda x: F.regexp_count(x, F.lit(r"\[[^\]]+\]\([^)]+\)"))
    stars, listed = r"\s+\*\s+\*\s+\[", rf"\s+\[[^\]]+\]\({cut_at}"
    cut = lambda x, pattern, least: F.when(F.regexp_instr(x, F.lit(pattern)) > least, F.trim(F.regexp_replace(x, rf"(?s){pattern}.*$", ""))).otherwise(x)
    lines = lambda x: F.trim(F.array_join(F.filter(F.split(x, "\n"), lambda y: ~((links(y) >= most_links) & (F.length(y) < under))), "\n"))
    t = let(F.trim(_c(text)), lambda x: cut(x, stars, 24))
    t = let(t, lambda x: F.when(links(x) >= cut_from, cut(x, listed, 40)).otherwise(x))
    return let(t, lambda x: let(lines(x), lambda kept: F.when(kept != "", kept).otherwise(x)))


def strip_leading(text: Column | str, pattern: str) -> Column:
    """Without a leading boilerplate sentence; the text itself if that is all there is."""
    left = F.trim(F.regexp_replace(_c(text), rf"(?i)^\s*{pattern}\s*", ""))
    return F.when(left != "", left).otherwise(F.trim(_c(text)))


def strip_markdown(text: Column | str) -> Column:
    """Plain text for speech."""
    return _replaced(_bare_links(F.trim(_c(text))), PLAIN)


def distinct_sentences(text: Column | str) -> Column:
    """The first of equal sentences (case and white space don't tell them apart), in order.
    Equal ones are found side by side in the order of their keys, not by comparing all pairs."""
    key = lambda s: F.regexp_replace(lower(s), f"{SPACE}+", " ")
    keyed = F.array_sort(F.transform(sentences(text), lambda s, i: F.struct(key(s).alias("key"), i.alias("i"), s.alias("s"))))
    first = let(keyed, lambda rows: F.filter(rows, lambda r, j: F.coalesce(F.get(rows, j - 1)["key"] != r["key"], F.lit(True))))
    return F.transform(F.array_sort(F.transform(first, lambda r: F.struct(r["i"], r["s"]))), lambda r: r["s"])


def dedupe_sentences(text: Column | str) -> Column:
    """The text of its distinct sentences."""
    kept = F.array_join(distinct_sentences(text), " ")
    return let(kept, lambda k: F.when(k != "", k).otherwise(F.trim(_c(text))))


def drop_sentences(text: Column | str, banned: Sequence[str]) -> tuple[Column, Column]:
    """Without sentences that match a banned pattern, and whether any did; the text itself if
    none is left."""
    parts = sentences(text)
    bad = lambda s: lower(s).rlike("|".join(f"(?:{b})" for b in banned))
    kept = F.filter(parts, lambda s: ~bad(s))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(_c(text)), F.size(kept) < F.size(parts)


def first_sentences(text: Column | str, n: int = 2) -> Column:
    parts = sentences(text)
    return F.when(F.size(parts) > 0, F.array_join(F.slice(parts, 1, n), " ")).otherwise(trim(_c(text)))


def _whole_sentences(parts: Column, size, limit: int, gap: int) -> Column:
    """Leading sentences whose sizes (with ``gap`` between) stay within the limit."""
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.lit(True).alias("on"))

    def step(a: Column, s: Column) -> Column:
        used = a["used"] + size(s) + F.when(a["n"] > 0, gap).otherwise(0)
        on = a["on"] & (used <= limit)
        return F.struct(F.when(on, used).otherwise(a["used"]).alias("used"), (a["n"] + on.cast("int")).alias("n"), on.alias("on"))

    return F.aggregate(parts, start, step)["n"]


def _without_short_tail(words: Column, least: int = 3) -> Column:
    """Words without the short ones at the end (one stays)."""
    marks = F.transform(words, lambda w, i: F.when((F.length(F.regexp_replace(w, r"^[.,!?;:-]+|[.,!?;:-]+\z", "")) >= least) | (i == 0), i + 1).otherwise(0))
    return F.slice(words, 1, F.greatest(F.lit(1), F.array_max(marks)))


def limit_chars(text: Column | str, most: int) -> tuple[Column, Column]:
    """At most ``most`` characters: whole sentences; else to the last full stop if that is far
    enough; else whole words without a short tail. And whether anything was cut."""
    t = F.trim(_c(text))
    parts = sentences(t)
    n = _whole_sentences(parts, F.length, most, 1)
    cut = F.rtrim(F.substring(t, 1, most))
    stop = F.length(cut) - F.length(F.regexp_extract(cut, r"(?s)^.*[.!?](.*)$", 1))
    has = cut.rlike(r"[.!?]")
    words = F.array_join(_without_short_tail(F.filter(F.split(cut, r"\s+"), lambda w: w != "")), " ")
    tail = F.trim(F.regexp_replace(words, "[,;:-]+$", ""))
    short = F.when(has & (stop - 1 >= (F.length(cut) * 0.45).cast("int")), F.trim(F.substr(cut, F.lit(1), stop))).otherwise(F.when(tail != "", tail).otherwise(cut))
    over = F.length(t) > most
    return F.when(~over, t).when(n > 0, F.array_join(F.slice(parts, F.lit(1), n), " ")).otherwise(short), over


def limit_words(text: Column | str, most: int) -> tuple[Column, Column]:
    """At most ``most`` words: whole sentences, else words without a short tail."""
    words = F.filter(F.split(_c(text), f"{SPACE}+"), lambda w: w != "")
    parts = sentences(text)
    n = _whole_sentences(parts, lambda s: F.size(F.split(s, f"{SPACE}+")), most, 0)
    short = trim(F.regexp_replace(F.array_join(_without_short_tail(F.slice(words, 1, most)), " "), r"[,;:-]+\z", ""))
    over = F.size(words) > most
    return F.when(~over, _c(text)).when(n > 0, F.array_join(F.slice(parts, F.lit(1), n), " ")).otherwise(short), over


def finish(text: Column | str) -> tuple[Column, Column]:
    """A text that ends in punctuation: cut at the last sentence if at least 55 % stays, else
    without the last word and with a full stop. And whether it was changed."""
    t = strip(text)
    stop = F.length(t) - F.length(F.regexp_extract(t, r"(?s)^.*[.!?](.*)$", 1))
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    bare = F.regexp_replace(F.array_join(F.slice(words, F.lit(1), F.greatest(F.lit(0), F.size(words) - 1)), " "), "[,;:-]+$", "")
    done = (t == "") | t.rlike(r"[.!?]\z")
    out = F.when(done, t).when(t.rlike("[.!?]") & (stop - 1 >= (F.length(t) * 0.55).cast("int")), F.trim(F.substr(t, F.lit(1), stop)))
    return out.when((F.size(words) > 1) & (bare != ""), F.concat(bare, F.lit("."))).otherwise(F.concat(t, F.lit("."))), ~done


def enforce_identity(text: Column | str, wrong: Sequence[str], identity: str) -> tuple[Column, Column]:
    """Sentences with a wrong name go and the right one is put in front."""
    t = _c(text)
    bad = contains_any(F.lower(t), wrong)
    left = t
    for w in wrong:
        left = F.regexp_replace(left, rf"(?i)[^.?!]*\Q{w}\E[^.?!]*[.?!]?\s*", "")
    return F.when(bad, F.trim(F.concat(F.lit(identity + " "), F.trim(left)))).otherwise(t), bad


def low_information(text: Column | str, tokens: Column) -> Column:
    """Blank, a bare number or bullet, or fewer than four tokens."""
    t = F.trim(_c(text))
    return (t == "") | t.rlike(r"^\s*(\d+[.)]?|[-*•])\s*$") | (F.size(tokens) < 4)


def coverage(wanted: Column, given: Column) -> Column:
    """Share of distinct wanted tokens that are given; 0 without any."""
    w = F.array_distinct(wanted)
    return F.when(F.size(w) == 0, F.lit(0.0)).otherwise(F.round(F.size(F.array_intersect(w, given)) / F.size(w), 4))


def anchors(tokens: Column, low_signal: Sequence[str] = ()) -> Column:
    """Tokens of four characters or more that don't start with a stem that says nothing."""
    says = lambda t: ~F.greatest(F.lit(False), *[t.startswith(s) for s in low_signal], F.lit(False))
    return F.array_distinct(F.filter(tokens, lambda t: (F.length(t) >= 4) & says(t)))


def same_stem(a: Column, b: Column) -> Column:
    """Equal first characters: as many as the shorter has, five at most, four at least."""
    n = F.least(F.length(a), F.length(b), F.lit(5))
    return (n >= 4) & (F.substr(a, F.lit(1), n) == F.substr(b, F.lit(1), n))


def anchor_support(anchor: Column, structure: Column) -> Column:
    """Share of anchors with the stem of a structure token; 1 without anchors."""
    hit = F.filter(anchor, lambda a: F.exists(structure, lambda s: same_stem(a, s)))
    return F.when(F.size(anchor) == 0, F.lit(1.0)).otherwise(F.round(F.size(hit) / F.size(anchor), 4))


def grounded(trusted: Column, cover: Column, anchored: Column) -> Column:
    return trusted | (cover >= 0.2) | (anchored >= 0.3)


def verified(text: Column | str, context: Column, tokens_of, least: float = 0.15) -> tuple[Column, Column]:
    """Sentences that the context supports: token overlap of ``least`` or three tokens or
    fewer. The text itself if none is left; and how many were dropped."""
    parts = sentences(text)

    def supported(s: Column) -> Column:
        t = F.array_distinct(tokens_of(s))
        return (F.size(t) <= 3) | (F.size(F.array_intersect(t, context)) / F.greatest(F.lit(1), F.size(t)) >= least)

    kept = F.filter(parts, supported)
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(_c(text)), F.size(parts) - F.size(kept)
