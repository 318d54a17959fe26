"""Chat formatting: every participant's view of a dialogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortwise.llm.common import written

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
PART_BYTES = 4 << 20
MARK_BYTES = 32  # what a turn's marks and head are counted as


def render_perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                        role_col: str = "role", text_col: str = "text",
                        system_roles: tuple[str, ...] = ("system",), part_bytes: int = PART_BYTES
                        ) -> DataFrame:
    """Render each dialogue once for each participant, who then speaks as the assistant.

    The others become users with their role as name, ``user name=...``; system turns stay system
    turns.  A segment reads ``<|im_start|>HEAD\\nTEXT<|im_end|>\\n``; a loss is taken on the TEXT
    and closing mark of the assistant's segments alone.  Returns one row per dialogue, part and
    participant:

    * conv_id, part, perspective (the participant's role name), n_turns;
    * text: the rendered dialogue;
    * masks: array of (start, length) in characters of ``text`` that are trained on;
    * masked_chars: their total.

    A dialogue is one part, however many turns it has, unless it is too large for a row: a turn counts as
    the bytes of role and text and 32 more, and belongs to the part that its first byte falls in, of
    ``part_bytes`` each.  Part numbers leave out parts in which no turn begins (behind a turn that is
    larger than a part).  Every participant of the dialogue has a view of each of its parts, also
    of those in which they are silent.  All system turns before the first other turn are said again at
    the head of each later part, unless they are themselves too large for a row: then those
    of the first part are.  n_turns counts them as well.
    Turns are ordered by number, then role, then text; repeated rows are said again.  A
    null text is an empty one, a null role is the participant ``unknown``.  A null turn number
    counts as 0.  Rows without conversation id belong to no dialogue and are left out.
    A dialogue with system turns only has no participant and no row.  An empty table gives an empty
    result.  Other columns are not looked at.
    """
    system = F.col("role").isin(*system_roles)
    user_head = F.when(system, F.lit("system")).otherwise(F.concat(F.lit("user name="), "role"))
    # Rows that are said again are counted, so that no key is larger than a row.
    said = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("conv"), F.coalesce(F.col(turn_col), F.lit(0)).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("said"),
    ).groupBy("conv", "turn", "role", "said").agg(F.count("*").alias("times"))
    sized = said.withColumn(
        "bytes", (F.octet_length("role") + F.octet_length("said") + MARK_BYTES).cast("long")
    ).withColumn("chars", (F.char_length(user_head) + F.char_length("said")
                           + len(OPEN) + 1 + len(CLOSE)).cast("long"))
    # A dialogue's turns are placed in pieces of ranges, each of which starts where those before end.
    pieces = written(sized.repartitionByRange(
        "conv", "turn", "role", F.substring("said", 1, 64)).withColumn("piece", F.spark_partition_id()))
    amounts = {"rank": F.col("times"), "byte": F.col("times") * F.col("bytes"),
               "char": F.col("times") * F.col("chars")}
    before = (Window.unboundedPreceding, -1)
    of_piece = Window.partitionBy("conv").orderBy("piece").rowsBetween(*before)
    in_piece = Window.partitionBy("conv", "piece").orderBy("turn", "role", "said").rowsBetween(*before)
    starts = pieces.groupBy("conv", "piece").agg(
        *[F.sum(x).alias(name) for name, x in amounts.items()]).select(
        "conv", "piece", *[F.coalesce(F.sum(name).over(of_piece), F.lit(0)).alias(f"{name}_start")
                           for name in amounts])
    placed = written(
        pieces.select("*", *[F.coalesce(F.sum(x).over(in_piece), F.lit(0)).alias(name)
                             for name, x in amounts.items()])
        .join(starts, ["conv", "piece"])
        .select("conv", "role", "said", "times", "bytes", "chars",
                *[(F.col(name) + F.col(f"{name}_start")).alias(name) for name in amounts]))
    # Of rows that are said again, those copies are of a part that begin in it.
    dealt = placed.selectExpr(
        "*", f"explode(sequence(byte div {part_bytes}, (byte + (times - 1) * bytes) div {part_bytes})) part")
    dealt = dealt.selectExpr(
        "*", f"greatest(0L, (part * {part_bytes} - byte + bytes - 1) div bytes) first",
        f"least(times, ((part + 1) * {part_bytes} - byte + bytes - 1) div bytes) last"
    ).where("first < last").select("conv", "part", F.struct(
        (F.col("rank") + F.col("first")).alias("rank"),
        (F.col("char") + F.col("first") * F.col("chars")).alias("at"),
        (F.col("last") - F.col("first")).alias("times"), "chars", "role", "said").alias("t"))

    def in_order(collected: Column) -> Column:
        """Turns in order, with their first character where all speakers are users."""
        return F.flatten(F.transform(F.sort_array(collected), lambda t: F.transform(
            F.sequence(F.lit(0).cast("long"), t["times"] - 1), lambda i: F.named_struct(
                F.lit("at"), t["at"] + i * t["chars"], F.lit("role"), t["role"],
                F.lit("said"), t["said"]))))

    dialogues = dealt.groupBy("conv", "part").agg(
        in_order(F.collect_list("t")).alias("turns"), F.min("t.at").alias("from"))
    speakers = placed.groupBy("conv").agg(
        F.array_sort(F.collect_set(F.when(~system, F.col("role")))).alias("speakers"),
        F.min(F.when(~system, F.col("rank"))).alias("opening")).where("opening IS NOT NULL")
    leading = dealt.where(F.col("part") == 0).join(speakers.select("conv", "opening"), "conv").where(
        F.col("t.rank") < F.col("opening")).groupBy("conv").agg(
        in_order(F.collect_list("t")).alias("leading"),
        F.sum(F.col("t.times") * F.col("t.chars")).alias("ahead"))
    heads = speakers.join(leading, "conv", "left").select("conv", "speakers", "leading", "ahead")
    carries = (F.col("part") > 0) & F.col("leading").isNotNull()
    # Characters from a turn's place in the dialogue to its place in the part.
    shift = F.when(carries, F.col("ahead")).otherwise(F.lit(0)) - F.col("from")
    moved = F.transform("turns", lambda t: F.named_struct(
        F.lit("at"), t["at"] + shift, F.lit("role"), t["role"], F.lit("said"), t["said"]))
    views = dialogues.join(heads, "conv").select(
        "conv", "part", F.when(carries, F.concat("leading", moved)).otherwise(moved).alias("turns"),
        F.explode("speakers").alias("perspective"))

    def head(role: Column) -> Column:
        return (F.when(role == F.col("perspective"), F.lit("assistant"))
                .when(role.isin(*system_roles), F.lit("system"))
                .otherwise(F.concat(F.lit("user name="), role)))

    # Each own turn is shorter by this than it would be as a user's.
    shorter = F.char_length("perspective") + len("user name=") - len("assistant")
    own = F.filter("turns", lambda t: t["role"] == F.col("perspective"))
    spans = F.transform(own, lambda t, i: F.named_struct(
        F.lit("start"), (t["at"] - i * shorter + len(OPEN) + len("assistant") + 1).cast("int"),
        F.lit("length"), F.char_length(t["said"]) + len(CLOSE)))
    return (
        views.select(
            F.col("conv").alias(conv_col), "part", "perspective",
            F.size("turns").cast("long").alias("n_turns"),
            F.array_join(F.transform("turns", lambda t: F.concat(
                F.lit(OPEN), head(t["role"]), F.lit("\n"), t["said"], F.lit(CLOSE))), "").alias("text"),
            spans.alias("masks"))
        .withColumn("masked_chars", F.aggregate(
            "masks", F.lit(0).cast("long"), lambda a, m: a + m["length"]))
    )
