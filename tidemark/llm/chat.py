"""Chat formatting with typed content parts.

A turn's content is a list of parts: text, image, audio or document. Visiting the parts in order gives
one flat text in which every attachment is a placeholder, a list of attachment references (ordinal in
the conversation, kind, reference) and the number of tokens that the placeholders stand for. Turns are
marked by control strings; control strings inside texts are escaped so that reading the output back
gives the same turns. DataFrame operations only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, PLACE = "<|turn:", "<|end|>\n", "<|part:"
#: Strings that other templates use as controls; each is escaped in texts by a backslash after its first character.
CONTROLS = ("<|", "|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Tokens that an attachment expands to: so many for one, and so many for each unit (image tile, second of audio, page).
EXPANSION = {"image": (85, 170), "audio": (0, 25), "document": (0, 400)}
PART = "struct<type:string,text:string,ref:string,units:bigint>"


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(c[0] + "\\" + c[1:])), CONTROLS, out)


def unescape(text: Column) -> Column:
    out = reduce(lambda t, c: F.replace(t, F.lit(c[0] + "\\" + c[1:]), F.lit(c)), reversed(CONTROLS), text)
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def text_parts(text: Column) -> Column:
    """A plain text as content of one part."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("bigint").alias("units"))).cast(f"array<{PART}>")


def whole_parts(parts: Column) -> Column:
    """parts without nulls where they have a meaning: no parts, a text, an empty text."""
    return F.transform(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: F.struct(_kind(p).alias("type"), F.coalesce(p["text"], F.lit("")).alias("text"), p["ref"].alias("ref"), p["units"].alias("units")))


def _kind(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text"))


def flat(parts: Column) -> Column:
    """The parts in order: texts escaped, attachments as placeholders that name their kind."""
    return F.array_join(F.transform(parts, lambda p: F.when(_kind(p) == "text", escape(p["text"])).otherwise(F.concat(F.lit(PLACE), escape(_kind(p)), F.lit("|>")))), "")


def attachments(parts: Column) -> Column:
    kept = F.filter(parts, lambda p: _kind(p) != "text")
    return F.transform(kept, lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), tokens_of(p).alias("tokens")))


def tokens_of(part: Column) -> Column:
    """Tokens that a placeholder expands to; unknown kinds count one."""
    units = F.coalesce(part["units"], F.lit(1))
    rule = F.lit(1).cast("bigint")
    for kind, (base, each) in EXPANSION.items():
        rule = F.when(part["type"] == kind, F.lit(base) + F.lit(each) * units).otherwise(rule)
    return rule


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", parts: Column | None = None, text_col: str = "text", learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss (spans start, length in code points of
    formatted), attachments (ordinal, type, ref, tokens), expanded_tokens.

    parts is a column of array<struct<type,text,ref,units>>; without it text_col is the only part. Turns go by
    order_col, then role and content (its parts' types and texts, as they are before escaping; repeated rows all
    appear and come out alike whatever their order); a
    null order comes first. Null text and null role count as empty, null parts as none; null conv_id is a conversation of its own.
    Empty table: no rows. The loss mask covers the content of the roles in learn, without marks. One
    conversation is one output row, so it has to fit into a row; other columns are not read.
    """
    content = parts if parts is not None else text_parts(F.col(f"`{text_col}`"))
    rows = turns.select(
        F.col(f"`{conv_col}`").alias("conv_id"),
        F.struct(F.col(f"`{order_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"), whole_parts(content).alias("parts")).alias("said"),
    )
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("said"))

    def made(t: Column) -> Column:
        head = F.concat(F.lit(OPEN), escape(t["role"]), F.lit("|>\n"))
        return F.struct(t["role"].alias("role"), head.alias("head"), flat(t["parts"]).alias("body"), attachments(t["parts"]).alias("attached"))

    sized = lambda t: t.withField("size", F.length(t["head"]) + F.length(t["body"]) + F.lit(len(CLOSE)))
    grouped = ordered.select("conv_id", F.transform("said", made).alias("turns")).select("conv_id", F.transform("turns", sized).alias("turns"))
    # (total so far, spans so far) over the turns
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    walked = F.aggregate(
        "turns",
        start,
        lambda acc, t: F.struct(
            (acc["at"] + t["size"]).alias("at"),
            F.when(t["role"].isin(*learn), F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(t["head"])).alias("start"), F.length(t["body"]).alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    refs = F.flatten(F.transform("turns", lambda t: t["attached"]))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "").alias("formatted"),
        walked["spans"].alias("loss"),
        F.transform(refs, lambda r, i: F.struct(i.alias("ordinal"), r["type"].alias("type"), r["ref"].alias("ref"), r["tokens"].alias("tokens"))).alias("attachments"),
        F.aggregate(refs, F.lit(0).cast("bigint"), lambda n, r: n + r["tokens"]).alias("expanded_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation; placeholders stay in their texts as they are."""
    pieces = F.filter(F.split(formatted, r"<\|turn:"), lambda _, i: i > 0)

    def turn(piece: Column) -> Column:
        cut = F.locate("|>\n", piece)
        # text lies between the role's mark and the closing one
        body = F.substring(piece, cut + F.lit(3), F.length(piece) - cut - F.lit(2 + len(CLOSE)))
        return F.struct(unescape(F.substring(piece, F.lit(1), cut - F.lit(1))).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def read_parts(formatted: Column, attached: Column) -> Column:
    """The turns (role, parts) of a formatted conversation: parts (type, text, ref) in order, attachments with their references.

    Texts that stand together come back as one, and empty ones not at all; a text that looks like a placeholder stays a text.
    """
    part = "struct<type:string,text:string,ref:string>"
    pieces = F.filter(F.split(formatted, r"<\|turn:"), lambda _, i: i > 0)

    def said(text: Column) -> Column:
        return F.struct(F.lit("text").alias("type"), unescape(text).alias("text"), F.lit(None).cast("string").alias("ref"))

    def split(piece: Column) -> Column:
        cut = F.locate("|>\n", piece)
        body = F.substring(piece, cut + F.lit(3), F.length(piece) - cut - F.lit(2 + len(CLOSE)))
        return F.struct(unescape(F.substring(piece, F.lit(1), cut - F.lit(1))).alias("role"), F.split(body, r"<\|part:").alias("chunks"))

    def parts_of(chunks: Column, before: Column) -> Column:
        def chunk(c: Column, i: Column) -> Column:
            end = F.locate("|>", c)
            held = F.struct(unescape(F.substring(c, F.lit(1), end - F.lit(1))).alias("type"), F.lit("").alias("text"), F.get(attached, before + i - F.lit(1))["ref"].alias("ref"))
            return F.when(i == 0, F.array(said(c))).otherwise(F.array(held, said(F.substring(c, end + F.lit(2), F.length(c)))))

        return F.filter(F.flatten(F.transform(chunks, chunk)), lambda p: (p["type"] != "text") | (p["text"] != "")).cast(f"array<{part}>")

    start = F.struct(F.lit(0).alias("n"), F.array().cast(f"array<struct<role:string,parts:array<{part}>>>").alias("turns"))
    step = lambda acc, t: F.struct(
        (acc["n"] + F.size(t["chunks"]) - F.lit(1)).alias("n"), F.concat(acc["turns"], F.array(F.struct(t["role"].alias("role"), parts_of(t["chunks"], acc["n"]).alias("parts")))).alias("turns")
    )
    return F.aggregate(F.transform(pieces, split), start, step)["turns"]


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")
