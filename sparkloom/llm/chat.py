"""Chat formatting with typed content parts [native].

A turn is a list of parts of type text, image, audio or document. A visitor, one expression
for each type, flattens them in order: text is escaped, an attachment becomes a placeholder
``<|type:k|>`` that carries its number in the turn; its reference goes to ``attachments``, and
the number of tokens that a model expands it to is added up. A turn is written as

    <|turn|>role<|says|>flattened text<|end|>

In texts and roles a backslash is set after the first character of anything that reads as a
control string, ``<|``, ``<s>``, ``</s>``, ``[INST]`` or ``[/INST]``, with any number of
backslashes in it already; taking one away again restores the text. So no text can forge a
mark, and everything is read back from the formatted string alone.

Null texts and roles are empty, turns of a conversation stand by turn, then role, then text
(ties and repeated rows stay); a null conv_id is a conversation of its own; an empty table
gives an empty result; extra columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import table

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
CONTROL = r"\||s>|/s>|INST\]|/INST\]"
PART = "struct<type:string,text:string,ref:string,size:bigint>"
#: Tokens that one attachment expands to: fixed, and for each unit of its size (pixels of a
#: side squared, milliseconds, bytes).
EXPANDS = {"image": (85, 1 / 784), "audio": (2, 1 / 40), "document": (16, 1 / 4)}
TRAINED, PAGE = "assistant", 4096


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({CONTROL})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({CONTROL})", "$1$2$3")


def visit(part: Column, number: Column) -> Column:
    """What a part becomes: text, attachment reference or null, expanded tokens. Unknown types are read as text."""
    text, ref = escape(F.coalesce(part["text"], F.lit(""))), F.lit(None).cast("struct<number:int,type:string,ref:string>")
    tokens = F.lit(0).cast("bigint")
    for kind, (fixed, each) in EXPANDS.items():
        here = part["type"] == kind
        text = F.when(here, F.concat(F.lit(f"<|{kind}:"), number.cast("string"), F.lit("|>"))).otherwise(text)
        ref = F.when(here, F.struct(number.cast("int").alias("number"), F.lit(kind).alias("type"), part["ref"].alias("ref"))).otherwise(ref)
        tokens = F.when(here, (fixed + F.ceil(F.coalesce(part["size"], F.lit(0)) * each)).cast("bigint")).otherwise(tokens)
    return F.struct(text.alias("text"), ref.alias("ref"), tokens.alias("tokens"))


def chat_format(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", trained: str = TRAINED) -> DataFrame:
    """conv_id, formatted, loss_spans (code points of formatted, end exclusive), attachments, expanded_tokens."""
    flat = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("_turn"), F.coalesce(F.col(role_col), F.lit("")).alias("_role"),
        F.transform(F.coalesce(parts_col, F.array().cast(f"array<{PART}>")), visit).alias("_parts"),
    ).withColumn("_text", F.array_join(F.transform("_parts", lambda p: p["text"]), ""))
    flat = flat.withColumn("_head", F.concat(F.lit(TURN), escape(F.col("_role")), F.lit(SAYS))).withColumn("_piece", F.concat("_head", "_text", F.lit(END)))
    flat = flat.withColumn("_refs", F.filter(F.transform("_parts", lambda p: p["ref"]), lambda r: r.isNotNull()))
    flat = flat.withColumn("_tokens", F.aggregate(F.transform("_parts", lambda p: p["tokens"]), F.lit(0).cast("bigint"), lambda a, x: a + x))
    # Where a turn begins in the whole string: a running sum over the sorted turns, which streams and spills.
    order = Window.partitionBy("conv_id").orderBy("_turn", "_role", "_piece")
    flat = flat.withColumn("_nth", F.row_number().over(order)).withColumn("_at", F.sum(F.length("_piece").cast("bigint")).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    flat = flat.withColumn("_at", F.coalesce("_at", F.lit(0).cast("bigint")) + F.length("_head"))
    span = F.when(F.col("_role") == trained, F.struct(F.col("_at").alias("start"), (F.col("_at") + F.length("_text")).alias("end"), F.col("_nth").alias("turn")))
    grouped = flat.withColumn("_span", span).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("_nth", "_piece", "_refs"))).alias("_pieces"), F.array_sort(F.collect_list("_span")).alias("loss_spans"), F.sum("_tokens").alias("expanded_tokens")
    )
    return grouped.select(
        "conv_id", F.array_join(F.transform("_pieces", lambda p: p["_piece"]), "").alias("formatted"), "loss_spans",
        F.flatten(F.transform("_pieces", lambda p: F.transform(p["_refs"], lambda r: F.struct(p["_nth"].alias("turn"), r["number"].alias("number"), r["type"].alias("type"), r["ref"].alias("ref"))))).alias("attachments"),
        "expanded_tokens",
    )


def chat_read(formatted: DataFrame) -> DataFrame:
    """The output of chat_format with ``turns`` (role, text) and ``loss`` (the unescaped text of each masked span) read back from it."""
    pieces = F.split("formatted", END.replace("|", r"\|"))
    out = formatted.withColumn("_pieces", F.slice(pieces, 1, F.size(pieces) - 1))
    head = F.lit(len(TURN))

    def turn(p: Column) -> Column:
        said = F.locate(SAYS, p)
        return F.struct(unescape(F.substring(p, head + 1, said - 1 - head)).alias("role"), unescape(F.substring(p, said + len(SAYS), F.length(p))).alias("text"))

    out = out.withColumn("turns", F.transform("_pieces", turn))
    # Spans are cut out of the whole string by their offsets. Pages of it, so that a cut looks at its own pages and not at all that stands before.
    out = out.withColumn("_pages", F.regexp_extract_all("formatted", F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0)))

    def cut(s: Column) -> Column:
        first = (s["start"] / PAGE).cast("int")
        last = (s["end"] / PAGE).cast("int")
        pages = F.array_join(F.slice("_pages", first + 1, last - first + 1), "")
        return F.substring(pages, (s["start"] - first * PAGE + 1).cast("int"), (s["end"] - s["start"]).cast("int"))

    return out.withColumn("loss", F.transform("loss_spans", lambda s: unescape(cut(s)))).drop("_pieces", "_pages")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{said}'), (-1L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    part = F.struct(F.lit("text").alias("type"), F.col("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("size"))
    read = chat_read(chat_format(rows.withColumn("parts", F.array(part))))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    loss = F.array_join("loss", "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        sha(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), sha(loss).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"), "expanded_tokens",
    )
