"""Rule tables as data. Operators take a ``Profile``; nothing about a site or a domain is
written into them. A profile can be read from JSON, so a site keeps its rules in a file."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields

# fixed values: Russian function words that the tokenizer drops
STOPWORDS = ("и", "в", "на", "по", "с", "к", "о", "об", "у", "за", "из", "для", "что", "как", "какие", "какой", "где", "это", "есть", "ли", "или")
# fixed values: words that choosing a spoken sentence passes over, and stems that anchor nothing
SPEAKER_STOPWORDS = ("что", "как", "где", "когда", "про", "это", "есть", "для", "или", "ли")
LOW_SIGNAL_STEMS = ("расска", "подска", "подроб", "вопрос", "ответ")


@dataclass(frozen=True)
class Intent:
    """What a question is about, and which sources answer it."""

    query_hints: tuple[str, ...]
    priority: int = 0
    preferred_sources: tuple[str, ...] = ()
    allowed_sources: tuple[str, ...] = ()
    denied_sources: tuple[str, ...] = ()
    trusted_sources: tuple[str, ...] = ()
    fact_tokens: tuple[str, ...] = ()
    boost_terms: tuple[str, ...] = ()
    noisy_sentences: tuple[str, ...] = ()
    source_bonus: float = 0.18
    min_evidence: float = 0.35
    min_fact_hits: int = 2
    display_summary: str = ""
    speaker_summary: str = ""
    #: What an answer says (a pattern in its lower-case text) that no summary may replace.
    display_keeps: str = ""
    speaker_keeps: str = ""
    stale_penalty: float = 0.08
    faq_penalty: float = 0.0


@dataclass(frozen=True)
class FacetRule:
    """Score changes for hits of a facet's questions; penalties are positive numbers."""

    path_bonus: dict[str, float] = field(default_factory=dict)
    path_penalty: dict[str, float] = field(default_factory=dict)
    page_type_bonus: dict[str, float] = field(default_factory=dict)
    page_type_penalty: dict[str, float] = field(default_factory=dict)
    source_facet_bonus: dict[str, float] = field(default_factory=dict)
    source_facet_penalty: dict[str, float] = field(default_factory=dict)


@dataclass(frozen=True)
class Profile:
    """All rule tables of one site or test set."""

    stopwords: tuple[str, ...] = STOPWORDS
    expansions: dict[str, tuple[str, ...]] = field(default_factory=dict)
    facet_stems: dict[str, tuple[str, ...]] = field(default_factory=dict)
    facet_implies: tuple[tuple[str, str], ...] = ()
    #: (stays, goes, stems): where both facets hold and a token starts with a stem, one goes.
    facet_excludes: tuple[tuple[str, str, tuple[str, ...]], ...] = ()
    path_aliases: dict[str, tuple[str, ...]] = field(default_factory=dict)
    facet_rules: dict[str, FacetRule] = field(default_factory=dict)
    facet_support: dict[str, tuple[str, ...]] = field(default_factory=dict)
    intents: dict[str, Intent] = field(default_factory=dict)
    hosts: tuple[str, ...] = ()
    denied_extensions: tuple[str, ...] = ("pdf", "doc", "docx", "xls", "xlsx", "zip", "jpg", "jpeg", "png", "gif", "svg", "mp4", "mp3", "css", "js")
    domain: str = ""
    own_letters: str = "А-Яа-яЁё"
    other_letters: str = "A-Za-z"
    own_language: str = "ru"
    own_marker: str = ""
    navigation: tuple[str, ...] = ()
    boilerplate: tuple[str, ...] = ()
    low_priority_paths: tuple[str, ...] = ("/faq", "/greeting", "/sitemap", "/media")
    footer: tuple[str, ...] = ()
    early_footer: tuple[str, ...] = ()
    #: (field, substring, label) in order; field: source_type, path, title or text.
    page_types: tuple[tuple[str, str, str], ...] = ()
    default_page_type: str = "detail"
    #: (field, substring, facet)
    source_facets: tuple[tuple[str, str, str], ...] = ()
    org_unit: tuple[str, ...] = ()
    trusted_page_types: tuple[str, ...] = ()
    preserved_facets: tuple[str, ...] = ()
    banned_sentences: tuple[str, ...] = ()
    fact_markers: tuple[str, ...] = ()
    stop_phrases: tuple[str, ...] = ()
    wake_phrases: tuple[str, ...] = ()
    wrong_identity: tuple[str, ...] = ()
    identity: str = ""
    speaker_stopwords: tuple[str, ...] = SPEAKER_STOPWORDS
    low_signal_stems: tuple[str, ...] = LOW_SIGNAL_STEMS
    #: A pattern of a sentence that answers mustn't begin with, what stands in for an empty answer,
    #: and what one that isn't sure says.
    leading: str = ""
    fallback: str = ""
    uncertain: str = ""
    #: Marks of text that is a menu rather than an answer.
    menu_markers: tuple[str, ...] = ()

    @classmethod
    def from_json(cls, text: str) -> Profile:
        """A profile from JSON with this class's field names; unknown names are an error."""
        raw = json.loads(text)
        if unknown := set(raw) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown rule tables: {sorted(unknown)}")
        tuples = lambda v: tuple(map(tuples, v)) if isinstance(v, list) else v
        out = {k: {a: tuples(b) for a, b in v.items()} if isinstance(v, dict) else tuples(v) for k, v in raw.items()}
        if "intents" in out:
            out["intents"] = {k: Intent(**{a: tuples(b) for a, b in v.items()}) for k, v in out["intents"].items()}
        if "facet_rules" in out:
            out["facet_rules"] = {k: FacetRule(**v) for k, v in out["facet_rules"].items()}
        return cls(**out)


#: Rules that fire on the synthetic test tables.
SYNTHETIC = Profile(
    stopwords=("the", "of", "and", "in", "to", "is", "that", "was", "on", "for", "it"),
    expansions={"ontion": ("ention", "onat"), "reti": ("heble",), "ret": ("heble", "thonti")},
    facet_stems={"motion": ("ontion", "antion"), "place": ("inth", "onth"), "person": ("hether", "ther"), "cost": ("reti", "reed"), "payment": ("shar", "reting")},
    facet_implies=(("person", "place"), ("payment", "cost")),
    facet_excludes=(("cost", "payment", ("reti", "reed")),),
    path_aliases={"en": ("the", "and", "inon"), "fr": ("les", "une"), "de": ("der", "und"), "es": ("los", "que")},
    facet_rules={
        "motion": FacetRule({"://blog.": 0.2, "/en/": 0.1}, {"://m.": 0.15}, {"reference": 0.12}, {"catalog": 0.08}, {"english": 0.1}, {"feed": 0.05}),
        "place": FacetRule({"example.org": 0.1}, {"?page=": 0.07}, {"plan": 0.05}, {"hub": 0.04}, {"german": 0.06}, {"mobile": 0.03}),
        "cost": FacetRule({"/fr/": 0.09}, {}, {"catalog": 0.11}, {}, {"french": 0.07}, {}),
    },
    facet_support={"motion": ("english",), "place": ("german", "english"), "person": ("mobile",), "cost": ("french", "feed")},
    intents={
        "alpha": Intent(("with", "from"), 3, preferred_sources=("://blog.", "://www."), denied_sources=("spam-farm.",), trusted_sources=("example.net",), fact_tokens=("with", "from", "this"), boost_terms=("ontion", "thther"), noisy_sentences=("http",), source_bonus=0.26, stale_penalty=0.3, display_summary="The alpha pages tell.", speaker_summary="See the alpha pages.", display_keeps=r"\b\d{3,}\b", speaker_keeps=r"\b\d{4,}\b"),
        "beta": Intent(("der", "und"), 2, preferred_sources=("/de/",), allowed_sources=("example.",), fact_tokens=("der", "die"), source_bonus=0.22, min_evidence=0.2, min_fact_hits=1, display_summary="Beta weiß es."),
        "gamma": Intent(("les", "une"), 2, preferred_sources=("/fr/",), allowed_sources=("/fr/", "/en/"), fact_tokens=("les",), source_bonus=0.24, faq_penalty=0.12),
    },
    hosts=("example.com", "example.org", "example.net"),
    domain="example.net",
    own_letters="a-zA-Z",
    other_letters="À-ÖØ-öø-ÿ",
    own_language="ascii",
    own_marker="the",
    navigation=("###", "%%%", "$$$", "***"),
    boilerplate=("free", "license", "###", "all rights"),
    low_priority_paths=("/es/", "/sitemap"),
    footer=("all rights reserved", "license", "http", "free "),
    early_footer=("licensed under",),
    page_types=(("path", "/en/", "reference"), ("path", "/fr/", "catalog"), ("path", "/de/", "plan"), ("path", "/es/", "hub")),
    source_facets=(("path", "/en/", "english"), ("path", "/fr/", "french"), ("path", "/de/", "german"), ("path", "/es/", "spanish"), ("url", "://m.", "mobile"), ("url", "utm_source", "feed"), ("title", "the ", "article")),
    org_unit=("the thing", "/en/1"),
    trusted_page_types=("reference", "plan"),
    preserved_facets=("mobile", "feed"),
    banned_sentences=(r"^the[: ]", r"ontionre"),
    fact_markers=("how much", "the", "reti"),
    stop_phrases=("stop", "enough", "that"),
    wake_phrases=("hey computer",),
    wrong_identity=("thonre",),
    identity="This is the one.",
    speaker_stopwords=("the", "and", "with"),
    low_signal_stems=("thing", "anon"),
    menu_markers=("enin", "onth"),
)
