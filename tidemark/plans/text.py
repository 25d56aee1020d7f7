"""Registered queries: text cleaning and rule features, tokens, vocabularies, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import words as W
from ..operators import vocab as V
from .base import Tables, query

SPACE = "[ \\t\\n\\r\\f\\x0B]+"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_sql(column: str, parts) -> str:
    return "(" + " OR ".join(f"contains({column}, {quoted(p)})" for p in parts) + ")"


def word_sql(column: str, words) -> str:
    return f"regexp_matches({column}, '(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(words)})($|[^\\p{{L}}\\p{{N}}_])')"


CLEAN = f"trim(regexp_replace(lower(text), '{SPACE}', ' ', 'g'))"
CLEANED = f"trim(regexp_replace(regexp_replace(regexp_replace({CLEAN}, '\\?+\\z', ''), '\\.+\\z', ''), '!+\\z', ''))"


@query(f"SELECT doc_id, {CLEANED} AS cleaned, trim(regexp_replace(regexp_replace({CLEAN}, '^[ ?.!]+', ''), '[ ?.!]+\\z', '')) AS stripped FROM documents")
def i1_clean_question(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.clean_question(F.col("text")).alias("cleaned"), X.clean_question(F.col("text"), both_ends=True).alias("stripped"))


def normalize_sql(text: str) -> str:
    out = f"trim(lower({text}))"
    for a, b in W.CONTRACTIONS.items():
        out = f"replace({out}, {quoted(a)}, {quoted(b)})"
    return f"trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}'']+', ' ', 'g'))"


@query(f"SELECT conv_id, turn, {normalize_sql(chr(39) + 'What' + chr(39) * 2 + 's this? I can' + chr(39) * 2 + 't say: ' + chr(39) + ' || coalesce(text, ' + chr(39) * 2 + ')')} AS normal FROM conversations")
def i2_normalize(t: Tables) -> DataFrame:
    text = F.concat(F.lit("What's this? I can't say: "), F.coalesce("text", F.lit("")))
    return t.conversations.select("conv_id", "turn", X.normalize(text).alias("normal"))


TYPO_TEXT = "'Shwo all emplyees form Recods ' || coalesce(text, '')"
TYPO_MAP = "MAP {" + ", ".join(f"{quoted(a)}: {quoted(b)}" for a, b in W.TYPOS.items()) + "}"


@query(f"SELECT doc_id, array_to_string(list_transform(string_split(trim(regexp_replace({TYPO_TEXT}, '{SPACE}', ' ', 'g')), ' '), lambda w: coalesce(m[lower(w)], w)), ' ') AS fixed FROM documents, (SELECT {TYPO_MAP} AS m)")
def i3_fix_typos(t: Tables) -> DataFrame:
    text = F.concat(F.lit("Shwo all emplyees form Recods "), F.coalesce("text", F.lit("")))
    return t.documents.select("doc_id", X.fix_typos(text).alias("fixed"))


#: Questions over the part table, the same text in both engines.
QUESTION = """concat(CASE p_partkey % 6 WHEN 0 THEN 'Show all parts of ' WHEN 1 THEN 'How many parts per brand with their orders for ' WHEN 2 THEN 'Total rows and average price above 10 of '
 WHEN 3 THEN 'Top 5 products ranked by price of ' WHEN 4 THEN 'List only the first items where size is at least 7 in ' ELSE 'Which of them cost less than 20, not more than 3 for each ' END, p_name, '?')"""


PHRASES = sorted(W.KEYWORDS, key=len, reverse=True)


def hints_sql(name: str, legacy: bool = False) -> str:
    """Tables of <name>(p_partkey, hints): the fold over phrases, one after another, as a recursion."""
    pad = "" if legacy else " "
    body = "lower(q)" if legacy else "' ' || regexp_replace(lower(q), '[^\\p{L}\\p{N}_]', ' ', 'g') || ' '"
    table = ", ".join(f"({i}, {quoted(pad + p + pad)}, {len(p)}, {quoted(W.KEYWORDS[p])})" for i, p in enumerate(PHRASES, 1))
    return f"""{name}_p(i, phrase, n, keyword) AS (VALUES {table}), {name}_b AS (SELECT p_partkey, {body} AS body FROM (SELECT p_partkey, {QUESTION} AS q FROM part)),
{name}_f(p_partkey, i, body, spans) AS (SELECT p_partkey, 0, body, CAST([] AS STRUCT(b BIGINT, e BIGINT, k VARCHAR)[]) FROM {name}_b
 UNION ALL SELECT p_partkey, x.i, body, CASE WHEN spot > 0 AND len(list_filter(spans, lambda s: spot < s.e AND spot + n > s.b AND s.k <> keyword)) = 0 THEN list_append(spans, {{'b': spot, 'e': spot + n, 'k': keyword}}) ELSE spans END
 FROM (SELECT f.p_partkey, p.i, body, spans, n, keyword, strpos(body, phrase) AS spot FROM {name}_f f JOIN {name}_p p ON p.i = f.i + 1) x),
{name} AS (SELECT p_partkey, list_sort(list_distinct(list_transform(spans, lambda s: s.k))) AS hints FROM {name}_f WHERE i = {len(PHRASES)})"""


@query(f"WITH RECURSIVE {hints_sql('h')}, {hints_sql('g', True)} SELECT p_partkey, array_to_string(h.hints, ',') AS hints, array_to_string(g.hints, ',') AS legacy_hints FROM h JOIN g USING (p_partkey)")
def i4_keyword_hints(t: Tables) -> DataFrame:
    asked = t.part.select("p_partkey", F.expr(QUESTION).alias("question"))
    return asked.select("p_partkey", F.array_join(X.keyword_hints(F.col("question")), ",").alias("hints"), F.array_join(X.keyword_hints(F.col("question"), legacy=True), ",").alias("legacy_hints"))


@query("SELECT doc_id, len(regexp_extract_all(text, '\\b\\d+(?:\\.\\d+)?\\b')) AS n, array_to_string(regexp_extract_all(text, '\\b\\d+(?:\\.\\d+)?\\b'), ' ') AS found FROM documents WHERE text IS NOT NULL")
def i5_numbers(t: Tables) -> DataFrame:
    found = X.numbers(F.col("text"))
    return t.documents.where("text is not null").select("doc_id", F.size(found).cast("bigint").alias("n"), F.array_join(found, " ").alias("found"))


@query("SELECT doc_id, " + ", ".join(f"{word_sql('lower(text)', ws)} AS has_{k}" for k, ws in W.FEATURES.items()) + f", CASE WHEN {CLEAN} = '' THEN 0 ELSE len(string_split({CLEAN}, ' ')) END AS word_count FROM documents")
def i6_hand_features(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", *[c.alias(k) for k, c in X.features(F.col("text")).items()])


#: SQL texts over the part table, the same in both engines.
QUERY = """CASE p_partkey % 10 WHEN 0 THEN 'SELECT * FROM part' WHEN 1 THEN concat('SELECT p_name FROM part WHERE p_size >= ', CAST(p_size AS STRING))
 WHEN 2 THEN 'SELECT COUNT(*) FROM part' WHEN 3 THEN concat('SELECT p_brand, SUM(p_size) FROM part WHERE p_brand = ''', p_brand, ''' GROUP BY p_brand')
 WHEN 4 THEN 'SELECT part.p_name FROM lineitem JOIN part ON lineitem.l_partkey = part.p_partkey' WHEN 5 THEN 'SELECT p_name FROM part ORDER BY p_size DESC'
 WHEN 6 THEN concat('SELECT p_name FROM part LIMIT ', CAST(p_size AS STRING)) WHEN 7 THEN 'SELECT p_name FROM part WHERE p_size > (SELECT AVG(p_size) FROM part)'
 WHEN 8 THEN concat('SELECT part.p_colour FROM parts WHERE part.p_name != ''', p_name, '''') ELSE 'SELECT p_brand FROM part GROUP BY p_brand' END"""


def intent_sql(rules: str) -> str:
    up = "upper(q)"
    has = lambda w: f"contains({up}, '{w}')"
    agg = any_sql(up, W.SQL_AGGREGATES)
    if rules == "c":
        return f"CASE WHEN len(regexp_extract_all({up}, 'SELECT')) >= 2 THEN 'COMPLEX' WHEN {has('JOIN')} THEN 'SELECT_JOIN' WHEN {has('GROUP BY')} THEN 'SELECT_GROUP' WHEN {agg} THEN 'SELECT_AGGREGATE' WHEN {has('ORDER BY')} THEN 'SELECT_ORDER' WHEN {has('WHERE')} THEN 'SELECT_WHERE' WHEN {has('LIMIT')} THEN 'SELECT_LIMIT' ELSE 'SELECT' END"
    several = " + ".join(f"CAST({has(w)} AS INT)" for w in ("WHERE", "GROUP BY", "ORDER BY", "LIMIT", "JOIN"))
    more = f" OR ({has('GROUP BY')} AND {has('HAVING')})" if rules == "b" else ""
    return f"CASE WHEN {several} >= 2 OR ({agg} AND {has('GROUP BY')}){more} THEN 'COMPLEX' WHEN {has('JOIN')} THEN 'SELECT_JOIN' WHEN {agg} THEN 'SELECT_AGGREGATE' WHEN {has('ORDER BY')} THEN 'SELECT_ORDER' WHEN {has('LIMIT')} THEN 'SELECT_LIMIT' WHEN {has('WHERE')} THEN 'SELECT_WHERE' ELSE 'SELECT' END"


@query("SELECT p_partkey, " + ", ".join(f"{intent_sql(r)} AS intent_{r}" for r in "abc") + f" FROM (SELECT p_partkey, {QUERY} AS q FROM part)")
def i7_sql_intent(t: Tables) -> DataFrame:
    q = t.part.select("p_partkey", F.expr(QUERY).alias("q"))
    return q.select("p_partkey", *[X.sql_intent(F.col("q"), r).alias(f"intent_{r}") for r in "abc"])


def hint_intent_sql() -> str:
    has = lambda w: f"list_contains(hints, '{w}')"
    agg = " OR ".join(map(has, W.SQL_AGGREGATES))
    return f"CASE WHEN {has('JOIN')} THEN 'SELECT_JOIN' WHEN {has('GROUP BY')} THEN 'SELECT_GROUP' WHEN {agg} THEN 'SELECT_AGGREGATE' WHEN {has('ORDER BY')} AND {has('LIMIT')} THEN 'SELECT_ORDER' WHEN {has('WHERE')} THEN 'SELECT_WHERE' WHEN {has('LIMIT')} THEN 'SELECT_LIMIT' ELSE 'SELECT' END"


@query(f"WITH RECURSIVE {hints_sql('h')} SELECT p_partkey, {hint_intent_sql()} AS intent FROM h")
def i8_hint_intent(t: Tables) -> DataFrame:
    hints = t.part.select("p_partkey", X.keyword_hints(F.expr(QUESTION)).alias("hints"))
    return hints.select("p_partkey", X.hint_intent(F.col("hints")).alias("intent"))


def question_intent_sql(text: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_sql(f'lower({text})', ws)} THEN '{i}'" for i, ws in W.QUESTION_INTENTS) + " ELSE 'SELECT' END"


@query(f"SELECT 'c' || conv_id || '/' || turn AS id, {question_intent_sql('text')} AS intent, 0.6 AS confidence FROM conversations UNION ALL SELECT 'p' || p_partkey, {question_intent_sql('q')}, 0.6 FROM (SELECT p_partkey, {QUESTION} AS q FROM part)")
def i9_question_intent(t: Tables) -> DataFrame:
    said = t.conversations.select(F.concat(F.lit("c"), "conv_id", F.lit("/"), "turn").alias("id"), "text")
    asked = t.part.select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.expr(QUESTION).alias("text"))
    return said.unionByName(asked).select("id", X.question_intent(F.col("text")).alias("intent"), F.lit(0.6).alias("confidence"))


# --- J: tokens, vocabulary, encoding

TOKENS = "list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_@$%]+', ' ', 'g')), ' '), lambda x: x <> '')"


def documents_tokens(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.tokenize_nl(F.coalesce("text", F.lit(""))).alias("tokens"))


@query(f"SELECT doc_id, len({TOKENS}) AS n, array_to_string({TOKENS}, ' ') AS tokens FROM documents")
def j1_tokenize_nl(t: Tables) -> DataFrame:
    return documents_tokens(t).select("doc_id", F.size("tokens").cast("bigint").alias("n"), F.array_join("tokens", " ").alias("tokens"))


SQL_TOKENS = "regexp_extract_all(trim(regexp_replace(q, '[ \\t\\n]+', ' ', 'g')), '''[^'']*''|>=|<=|!=|<>|[=><(),]|[^\\s(),=><!'']+|!')"


@query(f"SELECT p_partkey, array_to_string(list_transform({SQL_TOKENS}, lambda x: CASE WHEN upper(x) IN ({', '.join(map(quoted, W.SQL_WORDS))}) THEN upper(x) WHEN x LIKE '''%''' THEN x ELSE lower(x) END), ' ') AS tokens FROM (SELECT p_partkey, {QUERY} AS q FROM part)")
def j2_tokenize_sql(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_join(X.tokenize_sql(F.expr(QUERY)), " ").alias("tokens"))


FORCE = ("select", "from", "@num")
VOCAB_SQL = f"""tokens AS (SELECT doc_id, {TOKENS} AS tokens FROM documents), counts AS (SELECT token, count(*) AS freq FROM (SELECT unnest(tokens) AS token FROM tokens) GROUP BY token),
fixed(token, idx) AS (VALUES ('<pad>', 0), ('<sos>', 1), ('<eos>', 2), ('<unk>', 3), ('@num', 4), ('from', 5), ('select', 6)),
vocab AS (SELECT token, CAST(idx AS BIGINT) AS idx, coalesce(freq, 0) AS freq FROM fixed LEFT JOIN counts USING (token)
 UNION ALL SELECT token, 6 + row_number() OVER (ORDER BY freq DESC, token), freq FROM counts WHERE freq >= 2 AND token NOT IN (SELECT token FROM fixed))"""


def documents_vocab(t: Tables) -> DataFrame:
    return V.build_vocab(documents_tokens(t), "tokens", 2, FORCE)


@query(f"WITH {VOCAB_SQL} SELECT * FROM vocab")
def j3_build_vocab(t: Tables) -> DataFrame:
    return documents_vocab(t)


ENCODED_SQL = f"""{VOCAB_SQL}, flat AS (SELECT doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM tokens),
encoded AS (SELECT doc_id, list(coalesce(idx, 3) ORDER BY pos) FILTER (pos IS NOT NULL) AS ids FROM tokens LEFT JOIN flat USING (doc_id) LEFT JOIN vocab USING (token) GROUP BY doc_id)"""


@query(f"WITH {ENCODED_SQL} SELECT doc_id, coalesce(array_to_string(ids, ' '), '') AS ids FROM encoded")
def j4_encode(t: Tables) -> DataFrame:
    return V.encode(documents_tokens(t), documents_vocab(t), "doc_id").select("doc_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query(f"WITH {ENCODED_SQL}, back AS (SELECT doc_id, list(CASE WHEN idx IS NULL THEN '<unk>' ELSE token END ORDER BY pos) FILTER (pos IS NOT NULL) AS words FROM tokens LEFT JOIN flat USING (doc_id) LEFT JOIN vocab USING (token) GROUP BY doc_id) SELECT doc_id, coalesce(array_to_string(words, ' '), '') AS words FROM back")
def j4_decode(t: Tables) -> DataFrame:
    """Documents' tokens after encoding and decoding: those that the vocabulary lacks are <unk>."""
    vocab = documents_vocab(t)
    coded = V.encode(documents_tokens(t), vocab, "doc_id")
    return V.decode(coded, vocab, "doc_id").select("doc_id", F.array_join("tokens", " ").alias("words"))


PADDED = "list_concat(x, list_transform(range(128 - len(x)), lambda i: CAST(0 AS BIGINT)))"


@query(f"""WITH {ENCODED_SQL}, cut AS (SELECT doc_id, coalesce(ids, [])[:128] AS s, list_concat(list_concat([CAST(1 AS BIGINT)], coalesce(ids, [])[:126]), [CAST(2 AS BIGINT)]) AS g FROM encoded)
SELECT doc_id, array_to_string({PADDED.replace('x', 's', 1).replace('len(x)', 'len(s)')}, ' ') AS source, len(s) AS source_length, array_to_string({PADDED.replace('x', 'g', 1).replace('len(x)', 'len(g)')}, ' ') AS target, len(g) AS target_length FROM cut""")
def j5_pad(t: Tables) -> DataFrame:
    coded = V.encode(documents_tokens(t), documents_vocab(t), "doc_id")
    (s, sn), (g, gn) = V.padded_source(F.col("ids")), V.padded_target(F.col("ids"))
    text = lambda c: F.array_join(c.cast("array<string>"), " ")
    return coded.select("doc_id", text(s).alias("source"), sn.cast("bigint").alias("source_length"), text(g).alias("target"), gn.cast("bigint").alias("target_length"))


@query(f"WITH {ENCODED_SQL} SELECT doc_id, len(ids) AS n FROM encoded WHERE len(ids) > 0")
def j6_drop_empty(t: Tables) -> DataFrame:
    coded = V.encode(documents_tokens(t), documents_vocab(t), "doc_id")
    return V.not_empty(coded, "ids").select("doc_id", F.size("ids").cast("bigint").alias("n"))
