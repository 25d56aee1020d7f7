"""Text rules as column expressions: cleaning, normalising, keyword hints, features, intents, tokens."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words as W

SPACE = r"[ \t\n\r\f\x0B]+"
NOT_WORD = r"[^\p{L}\p{N}_]"


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE, " "))


def clean_question(text: Column, both_ends: bool = False) -> Column:
    """Lower case, white space collapsed; question marks, then dots, then exclamation marks off the end
    (or any of them and spaces off both ends)."""
    out = collapse(F.lower(text))
    if both_ends:
        return F.trim(F.regexp_replace(F.regexp_replace(out, r"^[ ?.!]+", ""), r"[ ?.!]+\z", ""))
    return F.trim(reduce(lambda t, p: F.regexp_replace(t, p + r"+\z", ""), (r"\?", r"\.", "!"), out))


def normalize(text: Column) -> Column:
    """Lower case, contractions expanded in their order, everything but letters, digits and ' a space."""
    out = reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), W.CONTRACTIONS.items(), F.trim(F.lower(text)))
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}']+", " "))


def word_map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def fix_typos(text: Column, table: dict[str, str] = W.TYPOS) -> Column:
    """Known misspellings replaced word by word."""
    known = word_map(table)
    return F.array_join(F.transform(F.split(collapse(text), " "), lambda w: F.coalesce(F.try_element_at(known, F.lower(w)), w)), " ")


def has_any(text: Column, parts: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts])


def has_word(text: Column, words: Sequence[str]) -> Column:
    """Whether one of the words or phrases occurs whole."""
    return text.rlike(f"(^|{NOT_WORD})({'|'.join(words)})($|{NOT_WORD})")


def keyword_hints(text: Column, legacy: bool = False) -> Column:
    """The SQL keywords a question hints at, sorted.

    Phrases are tried from the longest; each counts at its first occurrence unless that overlaps a
    phrase with another keyword. Occurrences are whole words; with legacy, any substring.
    """
    phrases = sorted(W.KEYWORDS, key=len, reverse=True)
    table = F.array(*[F.struct(F.lit(p if legacy else f" {p} ").alias("phrase"), F.lit(W.KEYWORDS[p]).alias("keyword"), F.lit(len(p)).alias("n")) for p in phrases])
    body = F.lower(text) if legacy else F.concat(F.lit(" "), F.regexp_replace(F.lower(text), NOT_WORD, " "), F.lit(" "))
    none = F.array().cast("array<struct<begin:int,end:int,keyword:string>>")

    def take(spans: Column, p: Column, text: Column) -> Column:
        at = F.position(p["phrase"], text)
        end = at + p["n"]
        clash = F.exists(spans, lambda s: (at < s["end"]) & (end > s["begin"]) & (s["keyword"] != p["keyword"]))
        return F.when((at > 0) & ~clash, F.concat(spans, F.array(F.struct(at.alias("begin"), end.alias("end"), p["keyword"].alias("keyword"))))).otherwise(spans)

    # the text is prepared once and handed to the fold
    spans = F.element_at(F.transform(F.array(body), lambda text: F.aggregate(table, none, lambda s, p: take(s, p, text))), 1)
    return F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["keyword"])))


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\b\d+(?:\.\d+)?\b"), F.lit(0))


def features(text: Column) -> dict[str, Column]:
    """has_<kind> for each kind of feature words, and word_count."""
    low = F.lower(text)
    out = {f"has_{k}": has_word(low, ws) for k, ws in W.FEATURES.items()}
    return out | {"word_count": F.when(collapse(low) == "", 0).otherwise(F.size(F.split(collapse(low), " ")))}


def sql_intent(sql: Column, rules: str = "a") -> Column:
    """The intent of a SQL text by substrings, under rule set a, b or c."""
    up = F.upper(sql)
    has = lambda word: up.contains(word)
    aggregate = has_any(up, W.SQL_AGGREGATES)
    if rules == "c":
        twice = F.length(up) - F.length(F.replace(up, F.lit("SELECT"), F.lit(""))) >= 12
        return (
            F.when(twice, "COMPLEX").when(has("JOIN"), "SELECT_JOIN").when(has("GROUP BY"), "SELECT_GROUP").when(aggregate, "SELECT_AGGREGATE")
            .when(has("ORDER BY"), "SELECT_ORDER").when(has("WHERE"), "SELECT_WHERE").when(has("LIMIT"), "SELECT_LIMIT").otherwise("SELECT")
        )
    clauses = reduce(lambda a, b: a + b, [has(w).cast("int") for w in ("WHERE", "GROUP BY", "ORDER BY", "LIMIT", "JOIN")])
    several = (clauses >= 2) | (aggregate & has("GROUP BY"))
    if rules == "b":
        several = several | (has("GROUP BY") & has("HAVING"))
    return (
        F.when(several, "COMPLEX").when(has("JOIN"), "SELECT_JOIN").when(aggregate, "SELECT_AGGREGATE").when(has("ORDER BY"), "SELECT_ORDER")
        .when(has("LIMIT"), "SELECT_LIMIT").when(has("WHERE"), "SELECT_WHERE").otherwise("SELECT")
    )


def hint_intent(hints: Column) -> Column:
    """The intent of a set of keyword hints."""
    has = lambda w: F.array_contains(hints, w)
    aggregate = reduce(lambda a, b: a | b, [has(w) for w in W.SQL_AGGREGATES])
    return (
        F.when(has("JOIN"), "SELECT_JOIN").when(has("GROUP BY"), "SELECT_GROUP").when(aggregate, "SELECT_AGGREGATE")
        .when(has("ORDER BY") & has("LIMIT"), "SELECT_ORDER").when(has("WHERE"), "SELECT_WHERE").when(has("LIMIT"), "SELECT_LIMIT").otherwise("SELECT")
    )


def question_intent(text: Column) -> Column:
    """The intent of a question by its words, when no model answers."""
    low, out = F.lower(text), None
    for intent, parts in W.QUESTION_INTENTS:
        out = (F if out is None else out).when(has_any(low, parts), intent)
    return out.otherwise("SELECT")


def tokenize_nl(text: Column) -> Column:
    """Lower-case tokens: everything but letters, digits, _ @ $ % separates them."""
    spaced = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_@$%]+", " "))
    return F.filter(F.split(spaced, " "), lambda t: t != "")


def tokenize_sql(sql: Column) -> Column:
    """Tokens of a SQL text: strings whole, operators, brackets, commas; keywords in upper case, names in lower."""
    raw = F.regexp_extract_all(collapse(sql), F.lit(r"'[^']*'|'[^']*\z|>=|<=|!=|<>|[=><(),]|[^\s(),=><!']+|!"), F.lit(0))
    kept = F.array(*[F.lit(w) for w in W.SQL_WORDS])
    return F.transform(raw, lambda t: F.when(F.array_contains(kept, F.upper(t)), F.upper(t)).when(t.startswith("'") & t.endswith("'"), t).otherwise(F.lower(t)))


def follow_up(text: Column, first: Column) -> Column:
    """How a turn depends on the one before; first: it has none before."""
    low = F.lower(text)
    has = {k: has_any(low, ws) for k, ws in W.FOLLOW_UP.items()}
    starts = reduce(lambda a, b: a | b, [low.startswith(w) for w in W.FOLLOW_UP["starts"]])
    return (
        F.when(first, "independent").when(has["count"] & has["reference"], "aggregate").when(has["sort"] & has["reference"], "sort_add")
        .when(starts | has["additive"], "filter_add").when(has["refining"], "filter_refine")
        .when(has["reference"] & has["filter"], "filter_add").when(has["reference"], "full_reference").otherwise("independent")
    )


def error_kind(message: Column) -> Column:
    low, out = F.lower(message), None
    for part, kind in W.ERRORS:
        out = (F if out is None else out).when(low.contains(part), kind)
    return out.otherwise("unknown")
