"""Chat formatting in budgeted windows, with DataFrame functions only.

Turns of a conversation are ordered by (turn, role, text). Each window repeats the conversation's system turn (its first
row, if a system row) and up to `history` turns before it that fit `history_tokens`. Repeated turns carry the mark
<|past|> instead of <|turn|> and are outside the loss mask, so that each assistant text is a target exactly once.

What is repeated is charged first: the room of a window is the budget less the system turn and `history_tokens`. A turn that
costs more than half the room stands alone; the turns between two such are dealt by prefix sums of their costs: a turn
belongs to the half room in which its last token falls, so that a window's turns cost less than two halves. Windows
are aligned to turns, and no turn is cut or dropped. A window passes the budget only if it holds a single turn (beside
what is repeated) that costs more than the room, or if the system turn and the history leave none.

Turn: mark, role, <|text|>, text, <|end|>. In roles and texts a backslash is doubled, and a backslash is put after the
first character of every control string (<|, <s>, </s>, [INST], [/INST]); taking away a backslash before any
character reverses both. Token cost: UTF-8 bytes / 4, rounded up, plus 4 for the marks.

Null roles and texts count as empty, null conv_ids as one conversation; equal rows stay as separate turns; an empty
table gives no row. Extra columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TURN, PAST, TEXT, END = "<|turn|>", "<|past|>", "<|text|>", "<|end|>"
_CONTROL = r"<(?=/?s>|\|)|\[(?=/?INST\])"


def escaped(col: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(col, r"\\", r"\\\\"), _CONTROL, r"$0\\")


def unescaped(col: Column) -> Column:
    return F.regexp_replace(col, r"(?s)\\(.)", "$1")


def windows(rows: DataFrame, budget: int = 1024, history: int = 2, history_tokens: int = 256) -> DataFrame:
    """conv_id, window, formatted, mask (array of start and length in code points of the window's targets).

    One shuffle by conv_id; all windows and groups after it reuse that partitioning. A conversation is sorted on its
    own, and a row of the output holds one window, never a whole conversation.
    """
    turns = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = turns.select("*", F.row_number().over(by).alias("at"), (F.ceil(F.octet_length("text") / 4) + 4).alias("cost"))
    system = (F.col("at") == 1) & (F.col("role") == "system")
    so_far = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    charged = F.max(F.when(system, F.col("cost"))).over(so_far)
    half = F.floor((budget - history_tokens - F.coalesce(charged, F.lit(0))) / 2)
    turns = turns.withColumns({"to": F.sum("cost").over(so_far), "half": F.greatest(half, F.lit(1))})
    alone = (F.col("cost") > F.col("half")) & ~system
    part = 2 * F.sum(alone.cast("int")).over(so_far) - alone.cast("int")
    turns = turns.withColumn("part", part)
    inside = Window.partitionBy("conv_id", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bin_ = F.floor((F.sum(F.when(system, F.lit(0)).otherwise(F.col("cost"))).over(inside) - 1) / F.col("half"))
    turns = turns.withColumn("bin", F.greatest(bin_, F.lit(0)))
    before = Window.partitionBy("conv_id").orderBy("at")
    begins = F.coalesce((F.lag("part").over(before) != F.col("part")) | (F.lag("bin").over(before) != F.col("bin")), F.lit(False))
    turns = turns.withColumn("begins", begins.cast("bigint"))
    turns = turns.withColumn("window", F.sum("begins").over(so_far)).drop("half", "part", "bin", "begins")
    # a turn is history of the window that begins k turns later, for k up to `history`
    first = Window.partitionBy("conv_id").orderBy("at")
    later = [F.when((F.lead("window", k).over(first) != (F.lead("window", k - 1).over(first) if k > 1 else F.col("window"))) & (F.lead("to", k - 1).over(first) - F.col("to") + F.col("cost") <= history_tokens if k > 1 else F.col("cost") <= history_tokens), F.lead("window", k).over(first)) for k in range(1, history + 1)]
    whole = Window.partitionBy("conv_id")
    turns = turns.select("*", F.array_compact(F.array(*later)).alias("later"), F.max("window").over(whole).alias("most"))
    past = F.when(system, F.when(F.col("most") > F.col("window"), F.sequence(F.col("window") + 1, F.col("most"))).otherwise(F.array().cast("array<bigint>"))).otherwise(F.array_distinct("later"))
    place = F.concat(F.array(F.struct(F.col("window").alias("window"), F.lit(False).alias("past"))), F.transform(past, lambda w: F.struct(w.alias("window"), F.lit(True).alias("past"))))
    parts = turns.select("conv_id", "at", "role", "text", F.explode(place).alias("place")).select("conv_id", "at", "role", "text", "place.*")
    head = F.concat(F.when(F.col("past"), PAST).otherwise(TURN), escaped(F.col("role")), F.lit(TEXT))
    body = escaped(F.col("text"))
    parts = parts.select("conv_id", F.col("window"), "at", head.alias("head"), body.alias("body"), ((F.col("role") == "assistant") & ~F.col("past")).alias("target"))
    size = F.char_length("head") + F.char_length("body") + len(END)
    end = F.sum(size).over(Window.partitionBy("conv_id", "window").orderBy("at"))
    parts = parts.withColumn("body_at", end - len(END) - F.char_length("body"))
    piece = F.struct("at", F.concat("head", "body", F.lit(END)).alias("piece"), "target", "body_at", F.char_length("body").alias("length"))
    packed = parts.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    mask = F.transform(F.filter("pieces", lambda x: x["target"]), lambda x: F.struct(x["body_at"].alias("start"), x["length"].alias("length")))
    return packed.select("conv_id", "window", F.array_join(F.transform("pieces", lambda x: x["piece"]), "").alias("formatted"), mask.alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text: the unrepeated turns in order), targets (the unmasked texts, in order)."""
    segments = F.split("formatted", r"(?=<\|(?:turn|past)\|>)")
    fresh = F.filter(segments, lambda x: x.startswith(TURN))
    inner = F.transform(fresh, lambda x: F.substring_index(F.substring(x, len(TURN) + 1, 1 << 30), END, 1))
    turns = F.transform(inner, lambda x: F.struct(unescaped(F.substring_index(x, TEXT, 1)).alias("role"), unescaped(F.substring_index(x, TEXT, -1)).alias("text")))
    targets = F.transform("mask", lambda m: unescaped(F.substring(F.col("formatted"), m["start"] + 1, m["length"])))
    parts = formatted.select("conv_id", "window", turns.alias("turns"), targets.alias("targets"), F.char_length("formatted").alias("chars"))
    row = F.array_sort(F.collect_list(F.struct("window", "turns", "targets")))
    return parts.groupBy("conv_id").agg(row.alias("rows"), F.sum("chars").alias("formatted_chars")).select(
        "conv_id", F.flatten(F.transform("rows", lambda r: r["turns"])).alias("turns"), F.flatten(F.transform("rows", lambda r: r["targets"])).alias("targets"), "formatted_chars"
    )


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts are control strings of another template."""
    text = "</s>[INST] ok [/INST]"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    return spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(text).alias("text"))


def chat_digest(rows: DataFrame, **limits: int) -> DataFrame:
    """The contract's digest per conversation, read back from the windows."""
    back = read_back(windows(rows, **limits))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("targets", "")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.col("formatted_chars").cast("bigint").alias("formatted_chars"),
    )
