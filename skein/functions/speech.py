"""Utterances and speech text: phrase matching, plausibility, numbers in words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: Russian cardinals
UNITS = "ноль один два три четыре пять шесть семь восемь девять десять одиннадцать двенадцать тринадцать четырнадцать пятнадцать шестнадцать семнадцать восемнадцать девятнадцать".split()
TENS = "двадцать тридцать сорок пятьдесят шестьдесят семьдесят восемьдесят девяносто".split()
HUNDREDS = "сто двести триста четыреста пятьсот шестьсот семьсот восемьсот девятьсот".split()
THOUSANDS = {1: "одна тысяча", 2: "две тысячи", 3: "три тысячи", 4: "четыре тысячи"}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bare(text: Column) -> Column:
    """Lower case without punctuation."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", ""))


def fuzzy_match(a: Column, b: Column) -> Column:
    """Equal, equal without punctuation, or one within the other (both over two characters)."""
    x, y = bare(a), bare(b)
    return (F.lower(a) == F.lower(b)) | (x == y) | ((F.length(x) > 2) & (F.length(y) > 2) & (F.contains(x, y) | F.contains(y, x)))


def _like(word: str):
    return lambda x: fuzzy_match(x, F.lit(word))


def _place_of(word: str):
    return lambda x, i: F.when(fuzzy_match(x, F.lit(word)), i + 1)


def words_of(text: Column | str) -> Column:
    return F.filter(F.split(F.lower(F.trim(_c(text))), r"\s+"), lambda w: w != "")


def stop_phrase(text: Column | str, phrases: Sequence[str], most_words: int = 4) -> Column:
    """The first phrase all of whose words an utterance of at most ``most_words`` has; else null."""
    words = words_of(text)
    out = F.when(F.lit(False), F.lit(""))
    for p in phrases:
        every = F.lit(True)
        for w in p.split():
            every = every & F.exists(words, _like(w))
        out = out.when(every & (F.size(words) <= most_words) & (F.size(words) > 0), F.lit(p))
    return out


def wake_word(text: Column | str, phrase: str, share: float = 0.8) -> tuple[Column, Column]:
    """Whether enough of the phrase's words occur (each matched once, greedily in order), and
    the text after the last matched word."""
    wanted = phrase.lower().split()
    words = words_of(text)
    start = F.struct(F.lit(0).alias("hits"), F.lit(0).alias("last"), F.array().cast("array<int>").alias("used"))
    state = start
    for w in wanted:
        free = F.filter(F.transform(words, _place_of(w)), lambda i: i.isNotNull())
        at = F.array_min(F.array_except(free, state["used"]))
        state = F.struct((state["hits"] + at.isNotNull().cast("int")).alias("hits"), F.greatest(state["last"], F.coalesce(at, F.lit(0))).alias("last"), F.when(at.isNotNull(), F.array_append(state["used"], at)).otherwise(state["used"]).alias("used"))
    found = state["hits"] >= max(1, int(share * len(wanted)))
    rest = F.array_join(F.slice(words, state["last"] + 1, F.greatest(F.lit(0), F.size(words) - state["last"])), " ")
    return found, F.when(found, rest).otherwise("")


def rejected(text: Column | str, noise: Sequence[str] = (r"^[\W_]+$", r"^(.)\1{3,}$")) -> Column:
    """Why an utterance is no speech (first reason that holds), or null: fewer than two word
    characters, noise, or mostly one word repeated."""
    t = F.trim(_c(text))
    words = words_of(t)
    out = F.when(F.length(F.regexp_replace(t, r"(?U)[\W_]", "")) < 2, "short")
    for pattern in noise:
        out = out.when(F.lower(t).rlike(pattern), "noise")
    return out.when((F.size(words) >= 3) & (1 - F.size(F.array_distinct(words)) / F.size(words) > 0.6), "repeats")


def skip_text(text: Column | str, phrases: Sequence[str]) -> Column:
    """Blank, or nothing but a stop phrase."""
    return (F.trim(_c(text)) == "") | bare(_c(text)).isin(*phrases)


def number_words(n: int) -> str:
    """Russian cardinal of 0 to 9999."""
    if n < 20:
        return UNITS[n]
    if n < 100:
        return TENS[n // 10 - 2] + (f" {UNITS[n % 10]}" if n % 10 else "")
    if n < 1000:
        return HUNDREDS[n // 100 - 1] + (f" {number_words(n % 100)}" if n % 100 else "")
    head = THOUSANDS.get(n // 1000) or f"{UNITS[n // 1000]} тысяч"
    return head + (f" {number_words(n % 1000)}" if n % 1000 else "")


def number_table(spark: SparkSession, upto: int = 9999) -> DataFrame:
    """(n, words) for 0 to ``upto``: small and of fixed size, for a broadcast join."""
    return spark.createDataFrame([(i, number_words(i)) for i in range(upto + 1)], "n int, words string")


def digits_in_words(text: str) -> str:
    """A run of digits in words, outside of Spark: leading zeros one by one, then the number;
    digit by digit beyond 9999."""
    zeros = len(text) - len(text.lstrip("0"))
    if zeros == len(text) or len(text) - zeros > 4:
        return " ".join(UNITS[int(d)] for d in text)
    return " ".join([UNITS[0]] * zeros + [number_words(int(text))])


def merge_short(sentences: Column, least: int = 10) -> Column:
    """Sentences for speech: a piece shorter than ``least`` is joined with the next."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held"))

    def step(a: Column, s: Column) -> Column:
        joined = F.trim(F.concat_ws(" ", F.when(a["held"] != "", a["held"]), s))
        full = F.length(joined) >= least
        return F.struct(F.when(full, F.array_append(a["out"], joined)).otherwise(a["out"]).alias("out"), F.when(full, "").otherwise(joined).alias("held"))

    def end(a: Column) -> Column:
        n = F.size(a["out"])
        tail = F.concat(F.slice(a["out"], F.lit(1), F.greatest(F.lit(0), n - 1)), F.array(F.concat_ws(" ", F.try_element_at(a["out"], F.greatest(F.lit(1), n)), a["held"])))
        return F.when(a["held"] == "", a["out"]).otherwise(tail)

    return F.aggregate(sentences, start, step, end)


def speech_sentences(text: Column | str) -> Column:
    parts = F.filter(F.transform(F.split(_c(text), r"(?<=[.!?…])\s+"), F.trim), lambda s: s != "")
    return merge_short(parts)


# fixed values: what is written short and how it is said, in the order of replacement
ABBREVIATIONS = (
    (r"\bул\.", "улица"), (r"\bпр\.", "проспект"), (r"\bпр-т\.?", "проспект"), (r"\bд\.", "дом"), (r"\bкорп\.", "корпус"), (r"\bстр\.", "строение"), (r"\bкв\.", "квартира"), (r"\bкаб\.", "кабинет"), (r"\bауд\.", "аудитория"), (r"\bэт\.", "этаж"),
    (r"\bпроф\.", "профессор"), (r"\bдоц\.", "доцент"), (r"\bст\.\s*пр\.", "старший преподаватель"), (r"\bзав\.", "заведующий"),
    (r"\bлаб\.", "лабораторная"), (r"\bпр\.\s*зан\.", "практическое занятие"), (r"\bсем\.", "семестр"), (r"\bэкз\.", "экзамен"), (r"\bзач\.", "зачёт"),
    (r"\bг\.", "город"), (r"\bт\.е\.", "то есть"), (r"\bт\.д\.", "так далее"), (r"\bт\.п\.", "тому подобное"), (r"\bт\.к\.", "так как"), (r"\bтел\.", "телефон"), (r"\bдр\.", "другое"), (r"\bсм\.", "смотри"), (r"\bрис\.", "рисунок"), (r"\bтабл\.", "таблица"), (r"\bим\.", "имени"), (r"\bнапр\.", "например"),
)
MEASURES = ((r"\bкг\b", "килограмм"), (r"\bг\b(?=[\s,\.])", "грамм"), (r"\bкм\b", "километров"), (r"\bм\b(?=[\s,\.])", "метров"), (r"\bсм\b", "сантиметров"), (r"\bмм\b", "миллиметров"), (r"\bч\b(?=[\s,\.])", "часов"), (r"\bмин\b", "минут"), (r"\bсек\b", "секунд"), (r"\bруб\b\.?", "рублей"))


def spoken_number(n: Column) -> Column:
    """Russian cardinal of a column of 0 to 9999, in the JVM."""
    of = lambda names, i: F.get(F.array(*[F.lit(x) for x in names]), i.cast("int"))
    rest = n % 100
    low = F.when(rest < 20, of(UNITS, rest)).otherwise(F.concat_ws(" ", of(TENS, F.floor(rest / 10) - 2), F.when(rest % 10 > 0, of(UNITS, rest % 10))))
    thousand = F.floor(n / 1000)
    head = of([THOUSANDS.get(i) or f"{UNITS[i]} тысяч" for i in range(10)], thousand)
    return F.concat_ws(" ", F.when(thousand > 0, head), F.when(F.floor(n / 100) % 10 > 0, of(HUNDREDS, F.floor(n / 100) % 10 - 1)), F.when((rest > 0) | (n == 0), low))


def spoken_digits(digits: Column) -> Column:
    """A run of at most four digits in words, its leading zeros one by one."""
    bare_ = F.regexp_replace(digits, "^0+", "")
    zeros = F.array_repeat(F.lit(UNITS[0]), F.length(digits) - F.length(bare_))
    return F.array_join(F.concat(zeros, F.when(bare_ != "", F.array(spoken_number(bare_.cast("int")))).otherwise(F.array().cast("array<string>"))), " ")


def _each(text: Column, pattern: str, say) -> Column:
    """The text with every match of the pattern as ``say`` has it."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?sU)(?:{pattern})|(?:(?!{pattern}).)+"), 0)
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(rf"(?U)^(?:{pattern})\z"), say(p)).otherwise(p)), "")


def speech_text(text: Column | str, abbreviations: Sequence[tuple[str, str]] = ABBREVIATIONS, measures: Sequence[tuple[str, str]] = MEASURES) -> Column:
    """Text as it is to be spoken: markup off, dashes and brackets as pauses, abbreviations and
    measures in full, and compound numbers, times and numbers (to 9999) in words."""
    t = _c(text)
    for pattern, to in ((r"\*\*(.+?)\*\*", "$1"), (r"\*(.+?)\*", "$1"), ("`(.+?)`", "$1"), (r"#{1,6}\s*", ""), (r"(?m)^\s*[-*•]\s+", ""), (r"(?m)^\s*\d+\.\s+", ""), ("[—–]", " — "), ('[«»"]', ""), ("[()]", ", "), ("/", " или ")):
        t = F.regexp_replace(t, pattern, to)
    for pattern, to in (*abbreviations, *measures):
        t = F.regexp_replace(t, f"(?iU){pattern}", to)
    t = _each(t, r"\b\d{1,4}(?:-\d{1,4})+\b", lambda p: F.array_join(F.transform(F.split(p, "-"), spoken_digits), " "))
    hour, minute = lambda p: F.split_part(p, F.lit(":"), F.lit(1)), lambda p: F.split_part(p, F.lit(":"), F.lit(2))
    t = _each(t, r"\b\d{1,2}:\d{2}\b", lambda p: F.concat_ws(" ", spoken_number(hour(p).cast("int")), F.when(minute(p) != "00", spoken_digits(minute(p)))))
    t = _each(t, r"\b\d{1,4}\b", spoken_digits)
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"\s+([,.!?;:])", "$1"))
