"""Fuzzy matching of values and words, TF-IDF linking, containment of passages."""

from __future__ import annotations

from bisect import insort
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import words as W
from ..functions.text import SPACE, collapse
from ..sources.shared import written

#: Sides of up to so many rows are broadcast.
BROADCAST_ROWS = 100_000


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one row of bits."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> int:
    """Similarity from 0 to 100: twice the common subsequence over the summed lengths."""
    return round(200 * common_length(a, b) / (len(a) + len(b))) if a or b else 100


def partial_ratio(a: str, b: str) -> int:
    """The best ratio of the shorter with a window of its length in the longer."""
    a, b = sorted((a, b), key=len)
    return max(ratio(a, b[i : i + len(a)]) for i in range(len(b) - len(a) + 1)) if a else 100


def edit_score(a: Column, b: Column) -> Column:
    """100 (1 - edits / longer length), cut to an integer."""
    return F.floor((F.greatest(F.length(a), F.length(b)) - F.levenshtein(a, b)) * 100 / F.greatest(F.length(a), F.length(b), F.lit(1))).cast("int")


def edits(a: str, b: str) -> int:
    """Letters to insert, leave out or change to make one of the other, with one row of bits."""
    if not a or not b:
        return len(a) or len(b)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << len(a) - 1
    more, less, n = full, 0, len(a)
    for c in b:
        hit = places.get(c, 0)
        level = (((hit & more) + more) ^ more) | hit | less
        up, down = less | ~(level | more) & full, more & level
        n += bool(up & last) - bool(down & last)
        up = up << 1 | 1
        more, less = (down << 1 | ~(level | up)) & full, up & level
    return n


@dataclass(frozen=True)
class Score:
    """A score of two values, and the most it can be, given how many letters they have in common at most, and the lengths of both."""

    exact: Callable[[str, str], int]
    most: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    #: Whether repeated letters of a value count once.
    once: bool = False
    #: A closer bound of two values, cheaper than the score.
    closer: Callable[[str, str], int] | None = None


def _most_ratio(common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    short = np.maximum(np.minimum(a, b), 1)
    return np.maximum(np.rint(200 * common / np.maximum(a + b, 1)), np.floor(np.rint(200 * np.minimum(common, short) / (2 * short)) * 0.9 + 1e-9))


def _closer_ratio(a: str, b: str) -> int:
    """No window has more of a subsequence in common than the whole value."""
    found, short = common_length(a, b), min(len(a), len(b))
    return max(round(200 * found / (len(a) + len(b))), int(round(200 * found / (2 * short)) * 0.9)) if short else 100


def _overlap(a: str, b: str) -> int:
    x, y = set(a), set(b)
    return len(x & y) * 100 // len(x | y) if x or y else 0


#: The larger of the ratio and nine tenths of the partial ratio; 100 (1 - edits / longer length); 100 x the Jaccard similarity of the sets of letters. All are cut to integers.
FUZZY = Score(lambda a, b: max(ratio(a, b), int(partial_ratio(a, b) * 0.9)), _most_ratio, closer=_closer_ratio)
EDITS = Score(lambda a, b: (max(len(a), len(b)) - edits(a, b)) * 100 // max(len(a), len(b), 1), lambda c, a, b: np.floor(100 * c / np.maximum(np.maximum(a, b), 1) + 1e-9))
OVERLAP = Score(_overlap, lambda c, a, b: np.floor(100 * c / np.maximum(a + b - c, 1) + 1e-9), once=True)
#: Classes of letters whose counts bound what two values have in common, values and typed values of a block, and typed values that are broadcast at once.
CLASSES, BLOCK, TYPED_BLOCK, TYPED_ROWS = 32, 2000, 200, 20_000


def started_alike(a: str, b: str) -> bool:
    """Whether the first letters (three at most) agree, of two or more each."""
    n = min(len(a), len(b))
    return n >= 2 and a[: min(n, 3)] == b[: min(n, 3)]


def boosted(score: int, a: str, b: str) -> int:
    """At least 70 where one value contains the other, at least 60 where they start alike."""
    return max(score, 70 if a in b or b in a else 60 if started_alike(a, b) else 0)


def letter_counts(values: Sequence[str], once: bool) -> np.ndarray:
    """How many letters of each value are in each class."""
    out = np.zeros((len(values), CLASSES), np.uint8)
    for i, v in enumerate(values):
        for c in set(v) if once else v[:255]:
            out[i, ord(c) % CLASSES] += 1
    return out


class Suggestions:
    """The best values for typed ones, among the blocks of values that are shown one after another.

    Of a block a typed value is compared with those values only whose letters leave them a place among its best so
    far, the likeliest first. tried counts these values, and compared those that a closer bound leaves, whose score is computed.
    """

    def __init__(self, typed: Sequence[str], score: Score, least: int, top: int):
        self.typed, self.score, self.least, self.top = typed, score, least, top
        self.counts, self.sizes = letter_counts(typed, score.once), self._sizes(typed)
        self.starts = [t[:3] for t in typed]
        self.best: list[list[tuple[int, str]]] = [[] for _ in typed]  # (-score, value), the best first
        self.tried = self.compared = 0

    def _sizes(self, values: Sequence[str]) -> np.ndarray:
        return np.array([len(set(v)) if self.score.once else len(v) for v in values], np.int64)

    def show(self, values: Sequence[str], lower: Sequence[str]) -> None:
        """values, and the same in lower case."""
        counts, sizes = letter_counts(lower, self.score.once), self._sizes(lower)
        long = np.array([len(v) > 255 for v in lower])  # their counts aren't whole
        alike: dict[str, list[int]] = {}
        for k, v in enumerate(lower):
            for n in (2, 3):
                alike.setdefault(v[:n], []).append(k)
        letters = np.array([len(v) for v in lower], np.int64)
        for i in range(0, len(self.typed), TYPED_BLOCK):
            part = slice(i, i + TYPED_BLOCK)
            common = np.minimum(self.counts[part, None, :], counts[None, :, :]).sum(axis=2, dtype=np.int64)
            a, b = self.sizes[part, None], sizes[None, :]
            bound = self.score.most(common, a, b)
            bound = np.where((common >= np.minimum(a, b)) | long[None, :], 100, bound)  # one may contain the other
            for k, t in enumerate(self.typed[part]):
                self._meet(i + k, t, bound[k], values, lower, alike, letters)

    def _meet(self, at: int, t: str, bound: np.ndarray, values, lower, alike, letters) -> None:
        if len(t) > 255:
            bound = np.full(len(bound), 100)
        for start in {t[:2], t[:3]}:
            near = alike.get(start, [])
            bound[near] = np.maximum(bound[near], 60)
        best = self.best[at]
        floor = self.least if len(best) < self.top else max(self.least, -best[-1][0])
        some = np.flatnonzero(bound >= floor)
        for k in some[np.argsort(-bound[some], kind="stable")].tolist():
            if len(best) >= self.top and bound[k] < -best[-1][0]:
                break
            self.tried += 1
            if self.score.closer:
                nearer, floor = boosted(self.score.closer(t, lower[k]), t, lower[k]), self.least if len(best) < self.top else -best[-1][0]
                if nearer < max(floor, self.least):
                    continue
            self.compared += 1
            found = boosted(self.score.exact(t, lower[k]), t, lower[k])
            if found >= self.least:
                insort(best, (-found, values[k]))
                del best[self.top :]


def did_you_mean(typed: DataFrame, values: DataFrame, score: Score = FUZZY, least: int = 50, top: int = 3) -> DataFrame:
    """typed, value, score, rank: up to `top` values for each typed one that is no value itself (without case), ties by value.

    Both frames have one column; nulls are left out. Values are read in blocks, each of which meets the typed values by bounds on
    their letters (Suggestions); no pair becomes a row but the best of each task. TYPED_ROWS typed values are broadcast at once.
    """
    t = typed.select(F.col(typed.columns[0]).cast("string").alias("typed")).where("typed is not null").distinct().withColumn("a", F.lower("typed"))
    v = values.select(F.col(values.columns[0]).cast("string").alias("value")).where("value is not null").distinct().withColumn("b", F.lower("value"))
    v = written(v, "known-values")
    t = written(t.join(v.select(F.col("b").alias("a")), "a", "left_anti").select("typed", "a"), "typed-values")
    parts = -(-t.count() // TYPED_ROWS) or 1
    found = None
    for i in range(parts):
        part = t.where(F.pmod(F.xxhash64("typed"), F.lit(parts)) == i) if parts > 1 else t
        shared = typed.sparkSession.sparkContext.broadcast([(r["typed"], r["a"]) for r in part.collect()])

        def run(batches, shared=shared):
            met = Suggestions([a for _, a in shared.value], score, least, top)
            for pdf in batches:
                for i in range(0, len(pdf), BLOCK):
                    met.show(pdf["value"].tolist()[i : i + BLOCK], pdf["b"].tolist()[i : i + BLOCK])
            out = [(t, value, -s) for (t, _), best in zip(shared.value, met.best) for s, value in best]
            yield pd.DataFrame(out, columns=["typed", "value", "score"])

        one = v.mapInPandas(run, "typed string, value string, score int")
        found = one if found is None else found.unionByName(one)
    order = Window.partitionBy("typed").orderBy(F.desc("score"), "value")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("typed", "value", "score", "rank")


def apply_corrections(df: DataFrame, column: str, corrections: DataFrame) -> DataFrame:
    """df with the column's wrong values replaced; corrections has typed, value."""
    table = corrections.select(F.col("typed").alias("_typed"), F.col("value").alias("_value"))
    return df.join(table, F.col(column) == F.col("_typed"), "left").withColumn(column, F.coalesce("_value", column)).drop("_typed", "_value")


def lexicon_correct(rows: DataFrame, key: str, text: str, lexicon: Sequence[str], least: int = 85) -> DataFrame:
    """key, corrected: words of more than four letters become the best lexicon word that scores `least` or more (ties: first by name).

    Scores are made for distinct words only, against the lexicon, which goes into the plan.
    """
    flat = rows.select(key, F.posexplode(F.split(collapse(F.col(text)), " ")).alias("pos", "word"))
    entries = F.array(*[F.lit(w) for w in sorted(lexicon)])
    words = flat.select("word").distinct().where(F.length("word") > 4)
    scored = words.select("word", F.explode(entries).alias("entry")).withColumn("score", edit_score(F.lower("word"), F.col("entry"))).where(F.col("score") >= least)
    best = scored.groupBy("word").agg(F.min_by("entry", F.struct(-F.col("score"), F.col("entry"))).alias("entry"))
    fixed = flat.join(best, "word", "left").select(key, "pos", F.coalesce("entry", "word").alias("word"))
    return fixed.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("corrected"))


def terms(text: Column, stop: Sequence[str] = ()) -> Column:
    """One- and two-grams of the lower-case words of two characters or more that aren't stop words."""
    words = F.filter(F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " ")), " "), lambda w: (F.length(w) >= 2) & ~w.isin(*(stop or [""])))
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(1))), lambda x, y: F.concat(x, F.lit(" "), y))
    return F.concat(words, F.filter(pairs, lambda p: p.isNotNull()))


def idf_of(tf: DataFrame, items: DataFrame) -> DataFrame:
    """term, idf: smooth idf of counted terms of items."""
    n = items.agg(F.count(F.lit(1)).alias("n"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.join(F.broadcast(n)).select("term", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))  # one row


def target_weights(targets: DataFrame, name: str, text: str, stop: Sequence[str], idf: DataFrame | None = None) -> DataFrame:
    """term, <name>, weight, idf of the terms of targets, each target's weights a vector of length one; idf is counted over targets unless given."""
    tf = written(targets.select(name, F.explode(terms(F.col(text), stop)).alias("term")).groupBy(name, "term").agg(F.count(F.lit(1)).alias("tf")), "link-targets")
    right = tf.join(idf_of(tf, targets) if idf is None else idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    lengths = right.groupBy(name).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return written(right.join(lengths, name).select("term", name, (F.col("w") / F.col("length")).alias("weight"), "idf"), "link-weights")


class TermIndex:
    """Inverted lists of weighted terms, with the most that each can add to a score.

    A text's terms are taken by what they can add at most. As soon as the rest together can't lift a new target
    among the best, they only complete the targets met so far; so the long list of a frequent term isn't read.
    """

    def __init__(self, rows):
        self.lists: dict[str, dict] = {}
        self.idf: dict[str, float] = {}
        for term, name, weight, idf in rows:
            self.lists.setdefault(term, {})[name] = weight
            self.idf[term] = idf
        self.most = {t: max(found.values()) for t, found in self.lists.items()}

    def weighted(self, found: Sequence[str]) -> dict[str, float]:
        """Weights of a text's known terms."""
        out: dict[str, float] = {}
        for t in found:
            if t in self.idf:
                out[t] = out.get(t, 0.0) + self.idf[t]
        return out

    def best(self, weights: dict[str, float], top: int) -> list[tuple[float, object]]:
        """The top targets (ties, to six digits: by name) with their products with the weights, not divided by the text's length."""
        order = sorted(weights, key=lambda t: -weights[t] * self.most.get(t, 0.0))
        left = [0.0]
        for t in reversed(order):
            left.append(left[-1] + weights[t] * self.most.get(t, 0.0))
        left.reverse()
        sums: dict = {}
        for i, t in enumerate(order):
            w, found = weights[t], self.lists.get(t, {})
            if len(sums) >= top and len(found) > len(sums) and left[i] < (1 - 1e-5) * sorted(sums.values(), reverse=True)[top - 1]:
                for name in sums:
                    if name in found:
                        sums[name] += w * found[name]
            else:
                for name, weight in found.items():
                    sums[name] = sums.get(name, 0.0) + w * weight
        return [(s, n) for n, s in sums.items()]


#: Weighted terms of an index that one broadcast holds; targets beyond are dealt out to as many indexes as it takes, each of which reads the texts.
INDEX_ROWS = 200_000


def dealt(weights: DataFrame, by: str) -> list[DataFrame]:
    """weights in parts of about INDEX_ROWS rows, whole targets (or what by names) in each."""
    parts = -(-weights.count() // INDEX_ROWS)
    return [weights.where(F.pmod(F.xxhash64(by), F.lit(parts)) == i) for i in range(parts)] if parts > 1 else [weights]


def tfidf_link(questions: DataFrame, key: str, text: str, targets: DataFrame, name: str, target_text: str, top: int = 3, stop: Sequence[str] = (), idf: DataFrame | None = None) -> DataFrame:
    """key, target, score, rank: the targets with the highest cosine to each question (those above zero; ties by name).

    Questions meet an inverted index of the targets where they are read, so their terms are neither exploded
    nor shuffled, and no frequent term makes all pairs; an index holds INDEX_ROWS terms, about.
    """
    weights = target_weights(targets, name, target_text, stop, idf)
    known = weights.select("term", "idf").distinct()
    whole = weights.count() <= INDEX_ROWS
    kinds = dict([*questions.dtypes, *[(f"target {c}", t) for c, t in targets.dtypes]])
    asked = questions.select(F.col(key).alias("_key"), terms(F.col(text), stop).alias("_terms"))
    if not whole:  # lengths need the terms of all indexes
        spread = asked.select("_key", F.explode("_terms").alias("term")).join(known, "term").groupBy("_key", "term").agg((F.count(F.lit(1)) * F.first("idf")).alias("w"))
        norms = spread.groupBy("_key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    found = None
    for part in dealt(weights, name):
        index = questions.sparkSession.sparkContext.broadcast([(r["term"], r[name], r["weight"], r["idf"]) for r in part.collect()])

        def run(batches, index=index):
            own = TermIndex(index.value)
            for pdf in batches:
                out = []
                for k, found in zip(pdf["_key"], pdf["_terms"]):
                    w = own.weighted(() if found is None else found)
                    norm = sum(x * x for x in w.values()) ** 0.5
                    scored = [(round(s / norm, 6) if whole else s, n) for s, n in own.best(w, top)]
                    scored = sorted(scored, key=lambda x: (-x[0], x[1]))[:top] if whole else scored
                    out += [(k, n, s) for s, n in scored]
                yield pd.DataFrame(out, columns=["_key", "target", "score"])

        one = asked.mapInPandas(run, f"_key {kinds[key]}, target {kinds['target ' + name]}, score double")
        found = one if found is None else found.unionByName(one)
    if not whole:
        found = found.join(norms, "_key").select("_key", "target", F.round(F.col("score") / F.col("norm"), 6).alias("score"))
    order = Window.partitionBy("_key").orderBy(F.desc("score"), "target")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select(F.col("_key").alias(key), "target", "score", "rank")


def link_schema(questions: DataFrame, key: str, text: str, schema: DataFrame, top: int = 3, stop: Sequence[str] = W.STOP_WORDS) -> DataFrame:
    """key, table, table_score, table_rank, confidence, column, column_score, column_rank: each question's tables, and the columns of each.

    schema has table, column. Terms are weighed over all distinct names (without case). A question has the top tables
    and, in each, the top columns, those of score zero by name at the end; confidence is the mean score of a
    table's columns here. Names alone have terms, so all is counted on the schema; questions are read twice.
    """
    names = schema.select(F.explode(F.array("table", "column")).alias("name")).where("name is not null").groupBy(F.lower("name").alias("_low")).agg(F.min("name").alias("name")).select("name")
    tf = names.select(F.explode(terms(F.col("name"), stop)).alias("term"), "name").groupBy("name", "term").agg(F.count(F.lit(1)).alias("tf"))
    idf = written(idf_of(tf, names), "link-idf")
    tables = schema.select("table").where("table is not null").distinct()
    return _linked_columns(questions, key, text, schema, tables, idf, top, stop)


def _linked_columns(questions: DataFrame, key: str, text: str, schema: DataFrame, tables: DataFrame, idf: DataFrame, top: int, stop: Sequence[str]) -> DataFrame:
    asked = questions.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    scored = written(tfidf_terms(asked, idf, stop), "link-questions")  # of all words only those of names are left
    weigh = lambda df, name: target_weights(df.select(name), name, name, stop, idf).select("term", name, "weight")
    table_sums = scored.join(weigh(tables, "table"), "term").groupBy("_key", "table").agg(F.sum(F.col("w") * F.col("weight")).alias("score"))
    columns = schema.where("table is not null and column is not null").distinct()
    column_names = columns.select("column").distinct()
    column_sums = scored.join(weigh(column_names, "column"), "term").groupBy("_key", "column").agg(F.sum(F.col("w") * F.col("weight")).alias("score"))
    first = [F.lit(r["table"]) for r in tables.orderBy("table").limit(top).collect()]  # what score zero falls back on
    keys = asked.select("_key").distinct()
    some = table_sums.unionByName(keys.select("_key", F.explode(F.array(*first).cast("array<string>")).alias("table"), F.lit(0.0).alias("score")))
    some = some.groupBy("_key", "table").agg(F.round(F.max("score"), 6).alias("table_score"))
    best = Window.partitionBy("_key").orderBy(F.desc("table_score"), "table")
    linked = some.withColumn("table_rank", F.row_number().over(best)).where(F.col("table_rank") <= top)
    each = linked.join(columns, "table").join(column_sums.withColumnRenamed("score", "_s"), ["_key", "column"], "left")
    each = each.withColumn("column_score", F.round(F.coalesce("_s", F.lit(0.0)), 6))
    inside = Window.partitionBy("_key", "table").orderBy(F.desc("column_score"), "column")
    ranked = each.withColumn("column_rank", F.row_number().over(inside)).where(F.col("column_rank") <= top)
    ranked = ranked.withColumn("confidence", F.round(F.avg("column_score").over(Window.partitionBy("_key", "table")), 6))
    return ranked.select(F.col("_key").alias(key), "table", "table_score", "table_rank", "confidence", "column", "column_score", "column_rank")


def tfidf_terms(asked: DataFrame, idf: DataFrame, stop: Sequence[str]) -> DataFrame:
    """_key, term, w: the weights of the known terms of asked (_key, _text), each text's a vector of length one."""
    counted = asked.select("_key", F.explode(terms(F.col("_text"), stop)).alias("term")).join(idf, "term").groupBy("_key", "term").agg((F.count(F.lit(1)) * F.first("idf")).alias("w"))
    counted = written(counted, "link-terms")
    norms = counted.groupBy("_key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return counted.join(norms, "_key").select("_key", "term", (F.col("w") / F.col("norm")).alias("w"))


def match_columns(tokens: DataFrame, token: str, columns: Sequence[str]) -> DataFrame:
    """token, column, kind for each distinct token: exact, else singular or plural, else substring (both of two letters or more); first column by position."""
    t = F.lower(F.trim(F.col("token")))
    bare = lambda c: F.regexp_replace(c, r"s+\z", "")
    plural = F.when(t.endswith("s"), t).otherwise(F.concat(t, F.lit("s")))
    table = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column")) for i, c in enumerate(columns)])
    pairs = tokens.select(F.col(token).alias("token")).where("token is not null").distinct().select("token", F.explode(table).alias("_c")).select("token", "_c.*")
    low = F.lower("column")
    kind = (
        F.when(low == t, 1).when((bare(t) == low) | (plural == low) | (t == bare(low)), 2)
        .when((low.contains(t) | t.contains(low)) & (F.length(t) >= 2) & (F.length(low) >= 2), 3)
    )
    best = pairs.withColumn("kind", kind).where("kind is not null").groupBy("token").agg(F.min(F.struct("kind", "position", "column")).alias("_m"))
    return best.select("token", F.col("_m.column").alias("column"), F.element_at(F.array(F.lit("exact"), F.lit("number"), F.lit("substring")), F.col("_m.kind")).alias("kind"))


#: Characters of the texts that one automaton finds, about; items beyond are dealt out to as many as it takes, each of which reads the documents.
AUTOMATON_CHARS = 1_000_000


def contained_in(items: DataFrame, key: str, text: str, documents: DataFrame, doc_text: str) -> DataFrame:
    """key, contained: whether any document contains the item's text. An empty text is in every document, a null one in none.

    An Aho-Corasick automaton of all the items' texts runs once over each document where it is read; documents are
    neither joined nor shuffled. Memory is bounded by AUTOMATON_CHARS, or by one longer item.
    """
    import ahocorasick

    named = items.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    wanted = named.where("_text IS NOT NULL").select("_text").distinct()
    parts = -(-(wanted.agg(F.sum(F.length("_text"))).first()[0] or 0) // AUTOMATON_CHARS) or 1
    docs = documents.select(F.col(doc_text).alias("_doc")).where("_doc IS NOT NULL")
    found = None
    for i in range(parts):
        part = wanted.where(F.pmod(F.xxhash64("_text"), F.lit(parts)) == i) if parts > 1 else wanted
        shared = items.sparkSession.sparkContext.broadcast([r["_text"] for r in part.collect()])

        def run(batches, shared=shared):
            automaton, seen = ahocorasick.Automaton(), set()
            for t in shared.value:
                if t:
                    automaton.add_word(t, t)
            automaton.make_automaton()
            for pdf in batches:
                for doc in pdf["_doc"]:
                    met = {t for _, t in automaton.iter(doc)} if len(automaton) else set()
                    met |= {t for t in shared.value if not t}
                    if not met <= seen:
                        yield pd.DataFrame({"_text": sorted(met - seen)})
                        seen |= met

        one = docs.mapInPandas(run, "_text string")
        found = one if found is None else found.unionByName(one)
    found = found.distinct().withColumn("contained", F.lit(True))
    return named.join(found, "_text", "left").select(F.col("_key").alias(key), F.coalesce("contained", F.lit(False)).alias("contained"))
