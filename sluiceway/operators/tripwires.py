"""Lexical tripwires on normalised text, with their precedence."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.functions.columns import bind, let
from sluiceway.functions.text import despaced
from sluiceway.operators.regex_index import required

# The pattern lists, matched case-insensitively with ``.`` crossing lines.
SENTINEL = (r"test[\s_]*sentinel[\s_]*block[\s_]*alpha",)
MALWARE = (
    r"\b(reverse|bind)[\s\W_]*shell\b",
    r"\b(keylogger|ransomware|rootkit|botnet|credential[\s\W_]*stealer|info[\s\W_]*stealer)\b",
    r"\bc2[\s\W_]*(server|beacon|framework)\b",
    r"\b(bypass|evade|disable)[\s\W_]+(the[\s\W_]+)?(edr|antivirus|anti-virus|defender|amsi|security[\s\W_]*controls?)\b",
    r"\b(write|create|build|make)[\s\W_]+(me[\s\W_]+)?(a[\s\W_]+|some[\s\W_]+)?(malware|a[\s\W_]+virus|a[\s\W_]+worm|a[\s\W_]+trojan)\b",
)
CHILD_SAFETY = (
    r"\b(child|children|underage|minor|minors|teen|teens|infant|toddler|preteen|kid|kids)\b"
    r".{0,60}?\b(porn|pornograph\w*|sex\w*|nude|naked|erotic\w*|explicit|molest\w*|abuse\w*)\b",
    r"\b(csam|csem|pedophil\w*|paedophil\w*|loli\w*|shota\w*)\b",
)
DESPACED = (
    "testsentinelblockalpha", "csam", "pedophil", "paedophil",
    "reverseshell", "bindshell", "keylogger", "ransomware", "rootkit", "c2beacon",
)
REQUEST_LISTS = ("sentinel", "csam", "malware", "extra")
OUTPUT_LISTS = ("sentinel", "csam", "extra")
SPAN_CHARS = 200
NEEDED = 16  # strings that are searched for before a pattern is tried

BUILT_IN = {"sentinel": SENTINEL, "csam": CHILD_SAFETY, "malware": MALWARE}


def _is_literal(pattern: str) -> bool:
    return re.fullmatch(r"[^\\.^$*+?{}\[\]|()]+", pattern) is not None


def _java(pattern: str) -> str:
    """Java form of a pattern for normalised text: classes are Unicode-aware, as the patterns'
    authors expect, and so is case, looked at only where the pattern has a capital of any alphabet."""
    flags = "s"
    if re.search(r"\\[wWbBsSdD]", pattern):
        flags += "U"
    literal = re.sub(r"\\.", "", pattern)
    if literal != literal.lower():
        flags += "iu"
    return f"(?{flags}){pattern}"


def table(lists: tuple[str, ...], extra: tuple[str, ...] = ()) -> list[tuple[int, str, int, str]]:
    """(list rank, list, pattern rank, pattern) rows; the despaced list always comes last."""
    chosen = [(name, extra if name == "extra" else BUILT_IN[name]) for name in lists] + [("despaced", DESPACED)]
    return [(rank, name, i, p) for rank, (name, patterns) in enumerate(chosen) for i, p in enumerate(patterns)]


def text_hit(norm: Column, lists: tuple[str, ...], extra: tuple[str, ...] = ()) -> Column:
    """First pattern that matches a normalised text, as
    ``struct<list_rank, pattern_rank, list, pattern>``; NULL when none does.

    A clean text costs a few substring searches per list, for the strings that its patterns need; only a
    text that hits a list finds out which of its patterns came first. Patterns without regex syntax are
    plain substring searches.
    """
    branch = None
    for name in (*lists, "despaced"):
        rows = [row for row in table(lists, extra) if row[1] == name]
        if not rows:
            continue
        subject = despaced(norm) if name == "despaced" else norm
        which = None
        for list_rank, _, pattern_rank, pattern in rows:
            value = F.struct(
                F.lit(list_rank).alias("list_rank"), F.lit(pattern_rank).alias("pattern_rank"),
                F.lit(name).alias("list"), F.lit(pattern).alias("pattern"),
            )
            test = _matches(subject, pattern)
            which = F.when(test, value) if which is None else which.when(test, value)
        sought = [row[3] for row in rows]
        hit = let(subject, lambda bound: _any_of(bound, sought)) if name == "despaced" else _any_of(subject, sought)
        branch = F.when(hit, which) if branch is None else branch.when(hit, which)
    return branch


def _matches(subject: Column, pattern: str) -> Column:
    return F.contains(subject, F.lit(pattern.lower())) if _is_literal(pattern) else subject.rlike(_java(pattern))


def _needed(pattern: str) -> list[str]:
    """Strings of which a text that matches holds one; none where the pattern gives no short list of them.

    Searching for them costs a tenth of the regex, and most texts hold none. Patterns with capitals, other alphabets or special groups are left to the regex.
    """
    plain = re.sub(r"\\.", "", pattern)
    if not pattern.isascii() or plain != plain.lower() or re.search(r"\(\?(?!:)", plain):
        return []
    found = [{s for s in own if not any(o != s and o in s for o in own)} for own in required(pattern)]
    short = [own for own in found if len(own) <= NEEDED]
    return sorted(max(short, key=lambda own: (min(map(len, own)), -len(own)))) if short else []


def _any_of(subject: Column, patterns: list[str]) -> Column:
    """Whether any pattern matches. A pattern that needs one of a few strings is tried on texts that hold one; the others are one alternation, except
    for patterns that refer back to their own groups, whose numbers an alternation would shift."""
    needed = {p: _needed(p) for p in patterns if not _is_literal(p)}
    joined = [p for p, own in needed.items() if not own and not re.search(r"\\[1-9k]", p)]
    if len(joined) < 2:
        joined = []
    tests = []
    for p in dict.fromkeys(patterns):
        if p in joined:
            continue
        held = [F.contains(subject, F.lit(s)) for s in needed.get(p, [])]
        tests.append(reduce(lambda one, other: one | other, held) & _matches(subject, p) if held else _matches(subject, p))
    if joined:
        tests.append(subject.rlike(_java("|".join(f"(?:{p})" for p in joined))))
    return reduce(lambda one, other: one | other, tests)


def scan(texts: DataFrame, norm: str, lists: tuple[str, ...] = REQUEST_LISTS, extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``texts`` that hit a list, with ``hit`` and the matched ``span``.

    Within one text the best (list, pattern) pair is enough: a request's first hit is the minimum
    over its texts (see ``first_hit``). The span is extracted for hits only.
    """
    found = texts.withColumn("hit", text_hit(F.col(norm), lists, extra)).where("hit IS NOT NULL")
    subject = F.when(F.col("hit.list") == "despaced", despaced(F.col(norm))).otherwise(F.col(norm))
    span = F.regexp_substr(subject, F.concat(F.lit("(?isU)"), F.col("hit.pattern")))
    return found.withColumn("span", F.substring(span, 1, SPAN_CHARS))


def first_hit(hits: DataFrame, key: str, text_rank: str) -> DataFrame:
    """One row per request: list order decides, then text order, then pattern order.

    A minimum over structs is combined map-side, so a request with very many texts still sends
    one row per task into the shuffle.
    """
    best = F.min(F.struct(
        F.col("hit.list_rank").alias("list_rank"), F.col(text_rank).alias("text_rank"),
        F.col("hit.pattern_rank").alias("pattern_rank"), F.col("hit.list").alias("list"),
        F.col("hit.pattern").alias("pattern"), F.col("span").alias("span"),
    ))
    return hits.groupBy(key).agg(best.alias("first")).select(
        key, "first.list", "first.text_rank", "first.pattern", "first.span"
    )


def words_of(norm: Column) -> Column:
    return F.filter(F.split(norm, " "), lambda w: w != "")


def word_grams(words: Column, size: int) -> Column:
    """Distinct runs of ``size`` words. Pass a column, not an expression: it is read per run."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - size + 1, F.lit(1)))
    grams = F.transform(starts, lambda i: F.array_join(F.slice(words, i, size), " "))
    return F.when(F.size(words) >= size, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def phrase_join(texts: DataFrame, key: str, norm: str, phrases: DataFrame, phrase_key: str, phrase: str, size: int,
                fold: Callable[[Column], Column] | None = None) -> DataFrame:
    """(phrase, text) pairs where a text holds a phrase of any number of words. ``fold`` makes the normal form of ``norm``, where that is the
    text as it came: of all texts to find candidates, and of candidates again to compare them, instead of all texts twice.

    A pattern table that grows with the data must not be looped over every text. A phrase's first ``size`` words (all of a
    shorter one) are hashed and joined with the hashes of the texts' word runs of that length; candidates then fetch both texts and
    are compared in full. Only hashes are exploded and shuffled per word. Run lengths below ``size`` are made only
    if there are such phrases: at most ``size`` lengths.
    """
    wanted = bind(phrases.select(F.col(phrase_key), F.col(phrase).alias("_phrase")), "_words", words_of(F.col("_phrase"))).where(F.size("_words") > 0)
    wanted = wanted.withColumn("_size", F.least(F.size("_words"), F.lit(size)))
    wanted = wanted.withColumn("_run", F.xxhash64("_size", F.array_join(F.slice("_words", F.lit(1), F.col("_size")), " ")))
    lengths = sorted(r[0] for r in wanted.select("_size").distinct().collect())
    fold = fold or (lambda text: text)
    split = bind(texts.select(key, fold(F.col(norm)).alias("_norm")), "_words", words_of(F.col("_norm")))
    found = None
    for length in lengths:
        starts = F.sequence(F.lit(1), F.greatest(F.size("_words") - length + 1, F.lit(1)))
        runs = F.transform(starts, lambda i: F.xxhash64(F.lit(length), F.array_join(F.slice("_words", i, length), " ")))
        candidates = split.where(F.size("_words") >= length).select(key, F.explode(F.array_distinct(runs)).alias("_run")).join(wanted.where(F.col("_size") == length).select(phrase_key, "_run"), "_run")
        found = candidates if found is None else found.unionByName(candidates)
    if found is None:
        return wanted.select(phrase_key).limit(0).join(texts.select(key).limit(0))
    pairs = found.select(phrase_key, key).distinct()
    spaced = lambda words: F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    both = pairs.join(texts.select(key, norm), key).join(wanted.select(phrase_key, spaced("_words").alias("_sought")), phrase_key)
    return both.where(F.contains(spaced(words_of(fold(F.col(norm)))), F.col("_sought"))).select(phrase_key, key)
