"""Noise for questions, as column expressions.

Every draw is a hash of the seed, the record, the variant and what it is drawn for, so a record gets the
same variants on any partitioning, and no Python runs on the executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import words as W
from .corpus import choose

#: Of a hundred variants, how many are misspelt; the others are put in bad grammar.
MISSPELT = 60
#: Of a hundred words that have known misspellings, and of a hundred longer others, how many get one.
KNOWN, OTHERS = 40, 15
#: Edits of other words in a question, at most, and how they are weighted.
MOST_EDITS = 2
EDITS = {"swap": 1, "drop": 1, "double": 1, "neighbour": 1}
#: Of a hundred misspelt variants, how many are finished by one of these.
FINISHED = 30
FINISHES = {"without a small word": 1, "lower": 1, "filler": 1, "then": 1}
EDGES = r"^[.,?!;:'\"]+|[.,?!;:'\"]+$"


class Draws:
    """Numbers drawn from the hash of a key."""

    def __init__(self, *key: Column):
        self.key = key

    def __call__(self, of: int | Column, *what: str | Column) -> Column:
        """A number from 0 to of - 1 for this use."""
        return F.pmod(F.xxhash64(*self.key, *[w if isinstance(w, Column) else F.lit(w) for w in what]), of if isinstance(of, Column) else F.lit(of)).cast("int")

    def one(self, values: Column, *what: str | Column) -> Column:
        return F.get(values, self(F.greatest(F.size(values), F.lit(1)), *what))


def texts(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def table(entries: dict) -> Column:
    """A map from words to arrays of texts, in the plan."""
    return F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), texts(v))])


def by_name(name: Column, made: dict[str, Column]) -> Column:
    return reduce(lambda out, kv: (F if out is None else out).when(name == kv[0], kv[1]), made.items(), None)


def edited(word: Column, draws: Draws, i: Column) -> Column:
    """A word with one letter, not the last, swapped with the next, dropped, doubled or mistyped."""
    at = draws(F.length(word) - 1, "letter", i) + 1
    before, letter, after = F.substring(word, F.lit(1), at - 1), F.substring(word, at, F.lit(1)), F.substring(word, at + 1, F.length(word))
    key = draws.one(F.try_element_at(table(W.NEAR_KEYS), F.lower(letter)), "key", i)
    made = {
        "swap": F.concat(before, F.substring(after, F.lit(1), F.lit(1)), letter, F.substring(after, F.lit(2), F.length(word))),
        "drop": F.concat(before, after),
        "double": F.concat(before, letter, letter, after),
        "neighbour": F.coalesce(F.concat(before, F.when(letter == F.lower(letter), key).otherwise(F.upper(key)), after), word),
    }
    return by_name(choose(draws(sum(EDITS.values()), "edit", i), EDITS), made)


def misspelt(question: Column, draws: Draws) -> Column:
    """The question's words with known misspellings and edits, perhaps finished."""
    words = F.filter(F.split(question, r"[ \t\n\r\f\x0B]+"), lambda w: w != "")
    bare = lambda w: F.regexp_replace(w, EDGES, "")
    known = lambda w: F.try_element_at(table(W.MISSPELLINGS), bare(w))
    hit = lambda w, i: F.coalesce(F.size(known(w)) > 0, F.lit(False)) & (draws(100, "known", i) < KNOWN)
    may = F.transform(words, lambda w, i: F.when(~hit(w, i) & (F.length(bare(w)) > 3) & (draws(100, "other", i) < OTHERS), i))
    places = F.slice(F.array_compact(may), 1, MOST_EDITS)
    changed = F.transform(words, lambda w, i: F.when(hit(w, i), F.replace(w, bare(w), draws.one(known(w), "spelling", i))).when(F.array_contains(places, i), edited(w, draws, i)).otherwise(w))
    return F.when(draws(100, "finish") < FINISHED, finished(changed, draws)).otherwise(F.array_join(changed, " "))


def finished(words: Column, draws: Draws) -> Column:
    line = F.array_join(words, " ")
    small = F.array_compact(F.transform(words, lambda w, i: F.when(F.lower(w).isin(*W.DROPPABLE), i)))
    made = {
        "without a small word": F.when((F.size(words) > 3) & (F.size(small) > 0), F.array_join(F.filter(words, lambda _, i: i != draws.one(small, "small")), " ")).otherwise(line),
        "lower": F.lower(line),
        "filler": F.concat_ws(" ", draws.one(texts(W.FILLERS), "filler"), line),
        "then": F.replace(F.replace(line, F.lit("than"), F.lit("then")), F.lit("Than"), F.lit("Then")),
    }
    return by_name(choose(draws(sum(FINISHES.values()), "way"), FINISHES), made)


def in_bad_grammar(question: Column, draws: Draws) -> Column:
    """One of the rewrites: a phrase for another, or the question in lower case, without some words, between a beginning and an end."""
    made = [F.replace(question, F.lit(a), F.lit(b)) for a, b in W.REWRITES]
    for before, after, without in W.AFFIXES:
        made.append(F.concat(F.lit(before), reduce(lambda q, w: F.replace(q, F.lit(w), F.lit("")), without, F.lower(question)), F.lit(after)))
    which = draws(len(made), "rewrite")
    return by_name(which, dict(enumerate(made)))


def augment(rows: DataFrame, key: str, question: str, seed: int = 0) -> DataFrame:
    """key, variant, question: two or three noisy variants of each row's question.

    A variant is left out if it equals, without case, the question or an earlier variant. Null and empty
    questions have none. Each row's draws come from the seed and its key alone.
    """
    text, base = F.col(question), (F.lit(seed), F.col(key).cast("string"))

    def variant(n: Column) -> Column:
        draws = Draws(*base, n)
        return F.when(draws(100, "kind") < MISSPELT, misspelt(text, draws)).otherwise(in_bad_grammar(text, draws))

    made = F.transform(F.sequence(F.lit(1), 2 + Draws(*base)(2, "variants")), variant)
    found = rows.where(F.length(text) > 0).select(F.col(key).alias(key), F.col(question).alias(question), made.alias("_made"))
    apart = F.filter("_made", lambda v, i: (F.lower(v) != F.lower(text)) & ~F.exists(F.slice("_made", F.lit(1), i), lambda w: F.lower(w) == F.lower(v)))
    return found.select(key, F.posexplode(apart).alias("variant", question))
