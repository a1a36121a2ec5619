"""Chat formatting of turns with typed content parts, with built-in functions only.

A turn has a role and a list of parts: text, image, audio or document. Every part is visited once, in order, and becomes a
piece of the output; other parts than text leave an ordered placeholder, an attachment record (number in the conversation,
kind, reference, turn) and a count of the tokens it expands to. Running sums over the pieces give the places of the
loss mask: the text parts of the assistant's turns.

Template (fixed): ``<|turn|>`` role ``<|body|>`` pieces ``<|end|>`` per turn; ``<|part|>`` stands between two text parts that
touch, ``<|image 3|>`` for the attachment numbered 3. Inside roles and texts ``<`` and ``|`` with n backslashes between them get one
backslash more, so no text holds ``<|`` and taking one away restores it.

A conversation is one output value, so its turns meet in one task; conversations are spread by hash. Spans are kept in
characters and in UTF-8 bytes, so that reading them back is linear.

Defined cases: null text, kind or list of parts count as empty text, a null role as empty, null sizes as 0; an unknown kind is a
document; a null conv_id is a conversation of its own; turns are ordered by turn (null first), then role, then parts, so repeated rows
stay, each as a turn; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.llm.tables import quoted

PARTS = "array<struct<kind: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>>"
#: Expansion: image patches of this many pixels a side, audio tokens a second, tokens a document page.
PATCH, PER_SECOND, PER_PAGE = 28, 25, 512
TURN, BODY, PART, END = "<|turn|>", "<|body|>", "<|part|>", "<|end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def text_parts(text: Column) -> Column:
    """One text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"),
                            F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
                            F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages")))


def expanded_tokens(part: Column) -> Column:
    """Tokens that a part other than text stands for."""
    def patches(size: str) -> Column:
        return F.ceil(F.coalesce(part[size], F.lit(0)) / PATCH)
    return (F.when(part["kind"] == "image", patches("width") * patches("height"))
            .when(part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * PER_SECOND))
            .otherwise(F.coalesce(part["pages"], F.lit(0)) * PER_PAGE).cast("long"))


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", learner: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans (start, length), loss_bytes (start, length), attachments, expanded_tokens."""
    rows = turns.select(F.col(quoted(conv_id)).alias("conv"), F.col(quoted(turn)).alias("turn"), F.coalesce(F.col(quoted(role)), F.lit("")).alias("role"),
                        F.col(quoted(parts)).cast(PARTS).alias("parts"))
    rows = rows.select("*", F.row_number().over(Window.partitionBy("conv").orderBy("turn", "role", "parts")).alias("seq"))
    pieces = rows.select("conv", "seq", "role", F.size("parts").alias("n"), F.posexplode_outer("parts").alias("at", "part"))
    is_text = F.coalesce(F.col("part.kind"), F.lit("text")) == "text"
    pieces = pieces.select("conv", "seq", "role", "part", F.coalesce("at", F.lit(0)).alias("at"), F.greatest("n", F.lit(1)).alias("n"), is_text.alias("is_text"))
    by_place = Window.partitionBy("conv").orderBy("seq", "at")
    sofar = by_place.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = pieces.select(
        "*", F.sum(F.when(F.col("is_text"), 0).otherwise(1)).over(sofar).alias("number"),
        F.coalesce(F.lag("is_text").over(by_place), F.lit(False)).alias("after_text"),
        F.when(F.col("part.kind").isin("image", "audio"), F.col("part.kind")).otherwise("document").alias("kind"))
    head = F.when(F.col("at") == 0, F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY))).when(F.col("is_text") & F.col("after_text"), PART).otherwise("")
    content = F.when(F.col("is_text"), escape(F.coalesce("part.text", F.lit("")))).otherwise(
        F.concat(F.lit("<|"), F.col("kind"), F.lit(" "), F.col("number").cast("string"), F.lit("|>")))
    tail = F.when(F.col("at") == F.col("n") - 1, END).otherwise("")
    pieces = pieces.select("*", head.alias("head"), content.alias("content"), tail.alias("tail"))
    pieces = pieces.select("*", F.concat("head", "content", "tail").alias("piece"))

    def span(size) -> Column:
        before = F.sum(size(F.col("piece"))).over(sofar) - size(F.col("piece")) + size(F.col("head"))
        return F.when(F.col("is_text") & (F.col("role") == learner), F.struct(before.cast("long").alias("start"), size(F.col("content")).cast("long").alias("length")))
    attached = F.when(~F.col("is_text"), F.struct(F.col("number").cast("int").alias("number"), F.col("kind"), F.col("part.ref").alias("ref"),
                                                  (F.col("seq") - 1).alias("turn_index"), expanded_tokens(F.col("part")).alias("tokens")))
    pieces = pieces.select("conv", F.struct("seq", "at", "piece", span(F.length).alias("span"), span(F.octet_length).alias("bytes"), attached.alias("attached")).alias("x"))
    whole = pieces.groupBy("conv").agg(F.sort_array(F.collect_list("x")).alias("x"))

    def listed(field: str) -> Column:
        return F.filter(F.transform("x", lambda p: p[field]), lambda v: v.isNotNull())
    return whole.select(
        F.col("conv").alias(conv_id), F.get("x", F.size("x") - 1)["seq"].cast("long").alias("n_turns"),
        F.array_join(F.transform("x", lambda p: p["piece"]), "").alias("formatted"), listed("span").alias("loss_spans"), listed("bytes").alias("loss_bytes"),
        listed("attached").alias("attachments"),
        F.aggregate(listed("attached"), F.lit(0).cast("long"), lambda a, v: a + v["tokens"]).alias("expanded_tokens"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, texts>> read back from a formatted conversation; ``texts`` has the text parts between other parts and marks."""
    segments = F.filter(F.split(formatted, r"<\|turn\|>"), lambda _, i: i > 0)

    def turn(segment: Column) -> Column:
        body = F.get(F.split(F.replace(segment, F.lit(END), F.lit("")), r"<\|body\|>"), F.lit(1))
        texts = F.transform(F.split(body, r"<\|part\|>|<\|(?:image|audio|document) [0-9]+\|>"), unescape)
        return F.struct(unescape(F.substring_index(segment, BODY, 1)).alias("role"), texts.alias("texts"))
    return F.transform(segments, turn)


def digests(chats: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read from the formatted text and its loss mask."""
    seen = chats.select(conv_id, "formatted", "loss_bytes", read_turns(F.col("formatted")).alias("turns"), F.encode("formatted", "UTF-8").alias("raw"))
    masked = F.transform("loss_bytes", lambda s: unescape(F.decode(F.substring(F.col("raw"), (s["start"] + 1).cast("int"), s["length"].cast("int")), "UTF-8")))
    seen = seen.select(conv_id, "formatted", "turns", F.length("raw").alias("formatted_bytes"), F.array_join(masked, "").alias("loss"))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), F.array_join(t["texts"], ""), F.lit("\n")))
    return seen.select(
        conv_id, F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
