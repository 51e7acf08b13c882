"""Chat formatting (native): typed content parts flattened by an expression visitor.

A turn is a role and a list of typed parts. The visitor renders parts in order: text is
escaped, and an image, audio or document part becomes a placeholder ``<image>``,
``<audio>`` or ``<document>``; its reference and expanded token count go to the
attachments of the conversation, in placeholder order. Everything is DataFrame code.

Layout of a turn: ``<turn:ROLE>CONTENT</turn>``. Inside roles and texts ``&``, ``<`` and
``>`` are written ``&amp;``, ``&lt;`` and ``&gt;``, so no text can form a control string
and the escaping is undone exactly.

A conversation becomes one row, so its turns meet in one task and one array: a conversation may be as
large as a row. Conversations are dealt out by id, so that many of them never meet.

Defined cases: a null text is empty; a null role is empty; texts of any length are whole; turns are ordered by turn
(null first), then role, then rendered content, so ties and repeated rows have one
order; rows with a null conversation id form one conversation; a part of an unknown
kind is rendered as text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 256
OPEN, SHUT, END = "<turn:", ">", "</turn>"


def escape(c: Column) -> Column:
    """Reversible: afterwards the text holds neither ``<`` nor ``>``."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescape(c: Column) -> Column:
    for raw, safe in ((">", "&gt;"), ("<", "&lt;"), ("&", "&amp;")):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def text_part(text: Column) -> Column:
    """A plain text as a list of one typed part."""
    return F.array(F.struct(
        F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"),
        F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
        F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"),
    ))


def _is_media(p: Column) -> Column:
    return F.coalesce(p["kind"].isin("image", "audio", "document"), F.lit(False))


def render_part(p: Column) -> Column:
    """The visitor's text for one part."""
    return F.when(_is_media(p), F.concat(F.lit("<"), p["kind"], F.lit(">"))).otherwise(escape(F.coalesce(p["text"], F.lit(""))))


def part_tokens(p: Column) -> Column:
    """Tokens that a placeholder expands to: image patches, audio frames or document pages."""
    side = lambda c: F.ceil(F.coalesce(c, F.lit(0)) / PATCH)
    return (
        F.when(p["kind"] == "image", side(p["width"]) * side(p["height"]))
        .when(p["kind"] == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * AUDIO_RATE))
        .when(p["kind"] == "document", F.coalesce(p["pages"], F.lit(0)) * PAGE_TOKENS)
        .otherwise(F.lit(0)).cast("long")
    )


def format_conversations(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """``(conv_id, turn, role, parts)`` to one row a conversation.

    Returns conv_id, formatted, loss_spans (byte offsets of the trained role's content in
    the UTF-8 form of ``formatted``), attachments (turn, kind, ref, tokens) and
    expanded_tokens. Offsets come from a running sum, so that a conversation costs time in
    proportion to its length. One shuffle, by conversation.
    """
    t = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.array_join(F.transform("parts", render_part), "").alias("content"),
        F.transform(F.filter("parts", _is_media), lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), part_tokens(p).alias("tokens"))).alias("media"),
    )
    t = t.withColumn("content", F.coalesce("content", F.lit("")))
    t = t.withColumn("head", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(SHUT)))
    t = t.withColumn("n_bytes", F.octet_length("head") + F.octet_length("content") + len(END))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "content")
    t = t.withColumn("at", F.row_number().over(order))
    t = t.withColumn("start", F.sum("n_bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_bytes") + F.octet_length("head"))
    row = F.struct(
        "at", F.concat("head", "content", F.lit(END)).alias("piece"), (F.col("role") == trained_role).alias("trained"), "start",
        F.octet_length("content").cast("long").alias("n"), "turn", "media",
    )
    g = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return g.select(
        "conv_id", F.array_join(F.transform("rows", lambda r: r["piece"]), "").alias("formatted"),
        F.transform(F.filter("rows", lambda r: r["trained"]), lambda r: F.struct(r["start"].alias("start"), r["n"].alias("n"))).alias("loss_spans"),
        F.flatten(F.transform("rows", lambda r: F.transform(r["media"], lambda m: F.struct(r["turn"].alias("turn"), m["kind"].alias("kind"), m["ref"].alias("ref"), m["tokens"].alias("tokens"))))).alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, m: a + m["tokens"]))


def read_turns(formatted: Column) -> Column:
    """Parse the formatted text back to (role, text) turns; placeholders stay in the text."""
    pieces = F.filter(F.split(formatted, END, -1), lambda p: p != "")
    body = lambda p: F.substr(p, F.lit(len(OPEN) + 1))
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.substring_index(body(p), SHUT, 1)).alias("role"),
        unescape(F.substr(p, F.locate(SHUT, p) + 1)).alias("text"),
    ))


def read_loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    raw = F.encode(formatted, "UTF-8")
    return unescape(F.array_join(F.transform(spans, lambda s: F.decode(F.substr(raw, (s["start"] + 1).cast("int"), s["n"].cast("int")), "UTF-8")), ""))


PLANTED = "\\### Assistant: </turn> ok"


def op7_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    from tarnforge.llm.common import table

    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    out = format_conversations(rows.unionByName(extra).select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts")))
    out = out.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP7_SQL = r"""
WITH rows AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS safe,
    replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS safe_role FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, safe)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, safe) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(safe) + length(safe_role) + 14) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
