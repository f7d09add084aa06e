"""Chat formatting of conversations with typed content parts.

A turn's content is an ordered list of parts.  A visitor walks them: text is escaped and put in
as it is, an image, audio or document becomes a numbered placeholder, and its reference and the
number of tokens it will expand to are recorded.  The formatted conversation carries a loss mask
over the assistant's texts, and can be read back into its turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from branchlore.llm.common import whole

# The turn marks of the ChatML format.
START, END = "<|im_start|>", "<|im_end|>"
# A text's own "<|" gets another bar, so nothing in a text looks like a mark or placeholder.
OPEN, ESCAPED = "<|", "<||"
LINE_END_IN_ROLE = "<|line_end|>"
LEARNED = "assistant"
MEDIA_TOKENS = {"image": 256, "audio": 128, "document": 512}  # where a part does not say
PARTS = "array<struct<type:string,text:string,ref:string,tokens:int>>"


def escape(text: Column) -> Column:
    return F.replace(text, F.lit(OPEN), F.lit(ESCAPED))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit(ESCAPED), F.lit(OPEN))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(LINE_END_IN_ROLE))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(LINE_END_IN_ROLE), F.lit("\n")))


def text_part(text: Column) -> Column:
    """A text as the only part of a turn."""
    empty = F.lit(None).cast("string")
    part = F.struct(F.lit("text").alias("type"), whole(text).alias("text"), empty.alias("ref"), F.lit(None).cast("int").alias("tokens"))
    return F.array(part).cast(PARTS)


def _is_media(part: Column) -> Column:
    return F.coalesce(part["type"].isin(*MEDIA_TOKENS), F.lit(False))


def attachments(parts: Column, turn: Column) -> Column:
    """The parts that are not text, in order: ``turn``, ``number``, ``type``, ``ref``, ``tokens`` (expanded)."""
    tokens = lambda p: F.coalesce(
        p["tokens"], *[F.when(p["type"] == kind, n) for kind, n in MEDIA_TOKENS.items()]
    )
    return F.transform(
        F.filter(F.coalesce(parts, F.array().cast(PARTS)), _is_media),
        lambda p, i: F.struct(
            turn.alias("turn"), i.alias("number"), p["type"].alias("type"), p["ref"].alias("ref"), tokens(p).alias("tokens")
        ),
    )


def flattened(parts: Column) -> Column:
    """The turn's content: escaped texts and numbered placeholders, in order.

    Texts that follow each other are escaped as the one text they make, so that no mark is spelled
    where two meet.  Parts of no known type count as text; missing texts are empty.
    """
    state = F.struct(F.lit(0).alias("n"), F.lit(False).alias("half"), F.array().cast("array<string>").alias("out"))

    def visit(s: Column, p: Column) -> Column:
        media, text = _is_media(p), whole(p["text"])
        mark = F.concat(F.lit(OPEN), p["type"], F.lit(":"), s["n"].cast("string"), F.lit("|>"))
        # the first half of a mark's opening stands at the end of what was said, the second begins this text
        bar = F.when(s["half"] & F.startswith(text, F.lit(OPEN[1])), F.lit(ESCAPED[2:])).otherwise(F.lit(""))
        half = F.when(media, False).when(text == "", s["half"]).otherwise(F.endswith(text, F.lit(OPEN[0])))
        piece = F.when(media, mark).otherwise(F.concat(bar, escape(text)))
        return F.struct((s["n"] + media.cast("int")).alias("n"), half.alias("half"), F.array_append(s["out"], piece).alias("out"))

    return F.aggregate(F.coalesce(parts, F.array().cast(PARTS)), state, visit, lambda s: F.array_join(s["out"], ""))


def format_conversations(turns: DataFrame, parts: str = "parts") -> DataFrame:
    """One row per conversation of rows (``conv_id``, ``turn``, ``role``, ``parts``).

    ``formatted``: the turns in order of ``turn``, equal ones by role and content; ``loss``: start
    and end, in code points, of the texts to learn; ``attachments`` and ``expanded_tokens``.  A
    missing role is empty, a missing list of parts an empty text; a missing turn number comes
    first; rows without a conversation id are one conversation; repeated rows are repeated turns;
    an empty table gives none; other columns are not looked at.
    """
    content = flattened(F.col(parts))
    rows = turns.select("conv_id", "turn", whole("role").alias("role"), content.alias("content"), attachments(F.col(parts), F.col("turn")).alias("media"))
    talks = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "content", "media"))).alias("turns"))
    head = F.transform("turns", lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")))
    pieces = F.transform(
        F.arrays_zip(F.col("turns").alias("turn"), head.alias("head")),
        lambda z: F.struct(
            z["head"].alias("head"), z["turn"]["content"].alias("content"), (z["turn"]["role"] == LEARNED).alias("learned")
        ),
    )
    spans = "array<struct<start:int,end:int>>"
    state = F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("loss"))

    def measure(s: Column, p: Column) -> Column:
        start = s["at"] + F.char_length(p["head"])
        end = start + F.char_length(p["content"])
        longer = F.array_append(s["loss"], F.struct(start.alias("start"), end.alias("end")))
        loss = F.when(p["learned"], longer).otherwise(s["loss"]).cast(spans)
        return F.struct((end + len(END) + 1).alias("at"), loss.alias("loss"))

    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["content"], F.lit(END + "\n"))), "")
    media = F.flatten(F.col("turns.media"))
    return talks.withColumn("pieces", pieces).select(
        "conv_id",
        text.alias("formatted"),
        F.aggregate("pieces", state, measure, lambda s: s["loss"]).alias("loss"),
        media.alias("attachments"),
        F.aggregate(media, F.lit(0).cast("long"), lambda n, m: n + m["tokens"]).alias("expanded_tokens"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: ``role`` and ``text``; placeholders stay in the text."""
    blocks = F.split(formatted, r"<\|im_end\|>\n", -1)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def turn(block: Column) -> Column:
        line_end = F.locate("\n", block)
        role = F.substring(block, F.lit(len(START) + 1), line_end - 1 - len(START))
        return F.struct(
            unescape_role(role).alias("role"), unescape(F.substring(block, line_end + 1, F.char_length(block))).alias("text")
        )

    return F.transform(blocks, turn)


def learned_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    part = lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))
    return F.array_join(F.transform(loss, part), "")


def chats(conversations: DataFrame) -> DataFrame:
    """The digest per conversation of a table of texts, read back from the formatted output."""
    turns = conversations.select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts"))
    made = format_conversations(turns).withColumns(
        {"said": read_back(F.col("formatted")), "learned": learned_text(F.col("formatted"), F.col("loss"))}
    )
    spoken = F.array_join(F.transform("said", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select(
        "conv_id",
        F.size("said").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "expanded_tokens",
    )
