"""Chat formatting in Spark expressions only.

Turns of a conversation are collected as structs, sorted by (turn, role, text), and adjacent turns of one role are
merged by array aggregation into one block:

    <|role|>\\n text <|next|> text <|end|>\\n

Inside roles and texts ``&``, ``<`` and ``[`` are written ``&amp;``, ``&lt;`` and ``&lsqb;``; so no text can hold a
marker of this template or of another that begins with ``<`` or ``[`` (``</s>``, ``[INST]``), and a reader undoes it
by reversing the replacements; in roles ``>`` is written ``&gt;`` too, so a role ends where its marker does. ``loss`` is the list of (start, end) code-point ranges of the assistants' texts in the formatted
string, end exclusive, one for each turn.

Defined cases: null text or role is empty; a null conv_id is a conversation of its own; ties and repeated rows are all kept, ordered by role
and text; empty tables give none. A conversation is one string, so its turns meet in one task: that is the result's shape,
and its bound is Spark's for a string (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))
ROLE_ESCAPES = (*ESCAPES, (">", "&gt;"))
NEXT, END, LEARN = "<|next|>", "<|end|>\n", "assistant"


def escape(c: Column, escapes: tuple = ESCAPES) -> Column:
    for a, b in escapes:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column, escapes: tuple = ESCAPES) -> Column:
    for a, b in reversed(escapes):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def blocks(turns: Column) -> Column:
    """Adjacent turns of one role as one block (role, texts): a turn begins a block where its role differs from the one before."""
    n = F.size(turns)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))
    ends = F.concat(F.slice(starts, F.lit(2), n), F.array(n))
    return F.transform(
        F.arrays_zip(starts.alias("a"), ends.alias("b")),
        lambda r: F.struct(F.get(turns, r["a"])["role"].alias("role"), F.transform(F.slice(turns, r["a"] + 1, r["b"] - r["a"]), lambda t: t["text"]).alias("texts")),
    )


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns, formatted and loss of each conversation."""
    e = rows.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    g = e.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    b = g.select("conv_id", F.size("turns").cast("long").alias("n_turns"), blocks(F.col("turns")).alias("blocks"))
    esc = F.transform("blocks", lambda x: F.struct(escape(x["role"], ROLE_ESCAPES).alias("role"), F.transform(x["texts"], lambda t: escape(t)).alias("texts")))
    b = b.select("conv_id", "n_turns", esc.alias("blocks"))
    # Pieces in order with whether the loss counts them; positions follow from their lengths.
    pieces = F.flatten(
        F.transform(
            "blocks",
            lambda x: F.concat(
                F.array(F.struct(F.concat(F.lit("<|"), x["role"], F.lit("|>\n")).alias("s"), F.lit(False).alias("own"))),
                F.flatten(F.transform(x["texts"], lambda t, i: F.array(F.struct(F.when(i > 0, F.lit(NEXT)).otherwise(F.lit("")).alias("s"), F.lit(False).alias("own")), F.struct(t.alias("s"), (x["role"] == LEARN).alias("own"))))),
                F.array(F.struct(F.lit(END).alias("s"), F.lit(False).alias("own"))),
            ),
        )
    )
    p = b.select("conv_id", "n_turns", pieces.alias("p"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("loss"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x["s"])
        span = F.array(F.struct(acc["at"].alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["own"], F.concat(acc["loss"], span)).otherwise(acc["loss"]).alias("loss"))

    return p.select("conv_id", "n_turns", F.array_join(F.transform("p", lambda x: x["s"]), "").alias("formatted"), F.aggregate("p", zero, step)["loss"].alias("loss"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    parts = F.filter(F.split(formatted, F.lit("<\\|end\\|>\n"), -1), lambda x: x != "")
    one = lambda x: F.transform(F.split(F.substr(x, F.instr(x, "|>\n") + F.lit(3)), F.lit("<\\|next\\|>"), -1), lambda t: F.struct(unescape(F.substr(x, F.lit(3), F.instr(x, "|>\n") - F.lit(3)), ROLE_ESCAPES).alias("role"), unescape(t).alias("text")))
    return F.flatten(F.transform(parts, one))


def op6(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    trap = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(trap).alias("text"))
    f = format_conversations(rows.unionByName(extra))
    f = f.select("conv_id", "formatted", "loss", read_back(F.col("formatted")).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform("loss", lambda r: unescape(F.substr(F.col("formatted"), (r["start"] + 1).cast("int"), (r["end"] - r["start"]).cast("int")))), "")
    return f.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
  lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM c),
e AS (SELECT *, length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;')) AS n, length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;'), '>', '&gt;')) AS m FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + CASE WHEN before = role THEN 8 ELSE m + 5 + 8 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
