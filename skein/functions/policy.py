"""What an intent's rules make of an answer: trust, focus, extracts, summaries, spoken
sentences. The rules are arrays beside each question, so one plan serves all intents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions import answer as A
from skein.functions import text as T
from skein.rules import Intent, Profile

# fixed values: weights of an extract's and of a spoken sentence's score, and answers' limits
FACT_WEIGHT, TRUST_WEIGHT, LONG_SENTENCE, LEAST_WORDS = 0.6, 0.18, 32, 4
EARLY_BONUS, EARLY, WORD_COST, IDEAL_WORDS = 0.1, 3, 0.03, 12
MENU_TOKENS, MOST_TOKENS = 20, 36


def rule(intent: Column, profile: Profile, value) -> Column:
    """``value(rule)`` of the intent, or of an empty rule where the intent has none."""
    out = F.when(F.lit(False), value(Intent(())))
    for name, own in profile.intents.items():
        out = out.when(intent == name, value(own))
    return out.otherwise(value(Intent(())))


def hints(intent: Column, profile: Profile, name: str) -> Column:
    """One of the intent's lists, as an array."""
    return rule(intent, profile, lambda r: T.words_in(getattr(r, name)))


def matches_any(source: Column, marks: Column) -> Column:
    """Whether the lower-case source contains one of the marks."""
    return F.exists(marks, lambda m: F.contains(F.lower(source), m))


def trusted(sources: Column, intent: Column, profile: Profile) -> Column:
    """Whether one of the sources is one that the intent trusts."""
    return T.let(hints(intent, profile, "trusted_sources"), lambda marks: F.exists(sources, lambda s: matches_any(s, marks)))


def focus(tokens: Column, facts: Column) -> Column:
    """The distinct tokens that are facts of the intent, or all if none is."""
    return T.let(F.array_intersect(tokens, facts), lambda hit: F.when(F.size(hit) > 0, hit).otherwise(F.array_distinct(tokens)))


def fact_sensitive(text: Column, profile: Profile) -> Column:
    """Whether a question asks for facts: a marker, or the start of an intent's longer facts."""
    starts = sorted({t[:5] for i in profile.intents.values() for t in i.fact_tokens if len(t) >= 4})
    return T.contains_any(F.lower(text), (*profile.fact_markers, *starts))


def facet_support(wanted: Column, given: Column, profile: Profile) -> Column:
    """Share of wanted facets that the sources have, or have a substitute for; 0 without any."""
    met = lambda f: F.array_contains(given, f) | _any((f == k) & F.arrays_overlap(T.words_in(v), given) for k, v in profile.facet_support.items())
    count = F.size(F.filter(F.array_distinct(wanted), met))
    return F.when((F.size(wanted) == 0) | (F.size(given) == 0), 0.0).otherwise(F.round(count / F.greatest(F.lit(1), F.size(F.array_distinct(wanted))), 4))


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def extract(hits: Column, tokens: Column, intent: Column, profile: Profile, most: int = 2) -> Column:
    """The best sentences of the hits (array<struct<source, text>>, in order) for a question's
    tokens: overlap, the intent's facts and trusted sources count; noisy and long sentences
    without facts go; equal sentences count once. Empty if nothing overlaps."""
    own = lambda s: F.array_distinct(T.tokenize(s, profile.stopwords))
    parts = lambda t: F.filter(F.transform(F.split(t, r"(?<=[.!?])\s+|\n+"), T.strip), lambda s: F.size(A.words(s)) >= LEAST_WORDS)

    def scored(wanted: Column, rules: Column) -> Column:
        facts = rules["facts"]
        usable = F.filter(hits, lambda h: (F.size(rules["allowed"]) == 0) | matches_any(h["source"], rules["allowed"]))
        usable = F.filter(usable, lambda h: ~matches_any(h["source"], rules["denied"]))

        def of_hit(h: Column) -> Column:
            bonus = F.when(matches_any(h["source"], rules["trusted"]), TRUST_WEIGHT).otherwise(0.0)

            def one(s: Column) -> Column:
                return T.let(own(s), lambda t: F.struct(
                    (F.size(F.array_intersect(wanted, t)) / F.greatest(F.lit(1), F.size(wanted))).alias("overlap"),
                    F.when(F.size(facts) > 0, F.size(F.array_intersect(facts, t)) / F.size(facts)).otherwise(0.0).alias("fact"),
                    bonus.alias("bonus"),
                    s.alias("s"),
                    (F.size(t) > 0).alias("said"),
                ))

            return F.transform(parts(h["text"]), one)

        found = F.flatten(F.transform(usable, of_hit))
        long = lambda x: (F.size(A.words(x["s"])) > LONG_SENTENCE) & (F.size(facts) > 0) & (x["fact"] == 0)
        found = F.filter(found, lambda x: x["said"] & ((x["overlap"] > 0) | (x["fact"] > 0)) & ~long(x) & ~matches_any(x["s"], rules["noisy"]))
        ranked = F.array_sort(F.transform(found, lambda x, i: F.struct((-(x["overlap"] + FACT_WEIGHT * x["fact"] + x["bonus"])).alias("n"), i.alias("i"), x["s"].alias("s"))))
        return F.transform(ranked, lambda x: x["s"])

    rules = F.struct(*[hints(intent, profile, a).alias(b) for a, b in (("fact_tokens", "facts"), ("allowed_sources", "allowed"), ("denied_sources", "denied"), ("trusted_sources", "trusted"), ("noisy_sentences", "noisy"))])
    key = lambda s: F.regexp_replace(F.lower(s), r"\s+", " ")
    chosen = T.let(rules, lambda r: T.let(focus(tokens, r["facts"]), lambda wanted: scored(wanted, r)))
    first = T.let(chosen, lambda c: T.let(F.transform(c, key), lambda keys: F.filter(c, lambda s, i: F.array_position(keys, F.get(keys, i)) == i + 1)))
    return F.coalesce(F.array_join(F.slice(first, 1, most), " "), F.lit(""))


def display_policy(display: Column, sources: Column, cover: Column, intent: Column, profile: Profile) -> Column:
    """The shown answer, or the intent's summary in its place: for menus, answers that say next
    to nothing or have too little evidence, and long ones that a trusted source stands for."""
    tokens = T.tokenize(display, profile.stopwords)
    summary = rule(intent, profile, lambda r: F.lit(r.display_summary))
    keeps = rule(intent, profile, lambda r: F.lower(display).rlike(r.display_keeps) if r.display_keeps else F.lit(False))
    facts = hints(intent, profile, "fact_tokens")
    weak = (cover < rule(intent, profile, lambda r: F.lit(r.min_evidence))) & (F.size(F.array_intersect(tokens, facts)) < rule(intent, profile, lambda r: F.lit(r.min_fact_hits)))
    menu = (F.size(tokens) > MENU_TOKENS) & (F.regexp_count(display, F.lit("[.!?]")) <= 1) & T.contains_any(F.lower(display), profile.menu_markers)
    long = (F.size(tokens) > MOST_TOKENS) & trusted(sources, intent, profile)
    replaced = (summary != "") & ~keeps & (menu | weak | long | A.low_information(display, tokens))
    return F.when(replaced, summary).otherwise(display)


def speaker_policy(speaker: Column, display: Column, sources: Column, intent: Column, profile: Profile) -> Column:
    """The spoken answer, or the intent's summary in its place where a trusted source stands for
    it or the answer says next to nothing."""
    summary = rule(intent, profile, lambda r: F.lit(r.speaker_summary))
    keeps = rule(intent, profile, lambda r: F.lower(display).rlike(r.speaker_keeps) if r.speaker_keeps else F.lit(False))
    low = A.low_information(speaker, T.tokenize(speaker, profile.stopwords))
    return F.when((summary != "") & ~keeps & (trusted(sources, intent, profile) | low), summary).otherwise(speaker)


def speaker_sentences(display: Column, question: Column, profile: Profile, most: int = 2) -> Column:
    """The sentences to be spoken: the best by words in common with the question, place and
    length, in the order of the text."""
    named = lambda x: F.filter(F.transform(F.regexp_extract_all(x, F.lit(T.TOKEN), 0), F.lower), lambda t: F.length(t) > 2)
    stop = T.words_in(profile.speaker_stopwords)
    plain = A.strip_markdown(display)

    def best(wanted: Column, parts: Column) -> Column:
        score = lambda s, i: F.size(F.array_intersect(wanted, named(s))) + F.when(i < EARLY, EARLY_BONUS).otherwise(0.0) - F.abs(F.size(A.words(s)) - IDEAL_WORDS) * WORD_COST
        ranked = F.array_sort(F.transform(parts, lambda s, i: F.struct(F.round(-score(s, i), 9).alias("n"), i.alias("i"), s.alias("s"))))
        return F.array_join(F.transform(F.array_sort(F.transform(F.slice(ranked, 1, most), lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s")))), lambda x: x["s"]), " ")

    wanted = F.array_distinct(F.filter(named(question), lambda t: ~F.array_contains(stop, t)))
    said = T.let(wanted, lambda w: T.let(T.sentences(plain), lambda parts: best(w, parts)))
    return F.when(said != "", said).otherwise(plain)
