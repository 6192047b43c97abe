"""Chat formatting with a grammar that is read back.

A turn is written ``<s>[INST]role[/INST]text</s>``. The parser is deterministic: it
cuts at ``</s>``, takes the role up to the first ``[/INST]``, and accepts no control
string inside a role or a text. Each turn is rendered and parsed again; one that does not
come back as it was is escaped, until it does: a backslash goes behind the bracket
of whatever looks like a control string, and the parser takes one away, so texts that hold
escaped control strings themselves come back too. Whole conversations are parsed once more.

DataFrame functions only; a conversation is one row of its own, which its hash needs anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<s>[INST]", "[/INST]", "</s>"
#: What may stand behind a bracket of a control string, with any number of backslashes before it.
LIKE = r"([<\[])(\\*/?(?:s>|INST\]))"
ESCAPED = r"([<\[])\\(\\*/?(?:s>|INST\]))"
CONTROL = r"[<\[]/?(?:s>|INST\])"
#: Role whose texts a model learns to write.
LEARNED = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, LIKE, r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE), text, F.lit(CLOSE))


def _turn(piece: Column) -> Column:
    """(role, text) of one turn without its end, null if it is none."""
    rest = F.substr(piece, F.lit(len(OPEN) + 1))
    role = F.substring_index(rest, MIDDLE, 1)
    text = F.substr(rest, F.char_length(role) + len(MIDDLE) + 1)
    well = piece.startswith(OPEN) & rest.contains(MIDDLE) & ~role.rlike(CONTROL) & ~text.rlike(CONTROL)
    return F.when(well, F.struct(unescaped(role).alias("role"), unescaped(text).alias("text")))


def pieces(formatted: Column) -> Column:
    """The turns of a formatted conversation, each without its end; the last one stands for what is behind the last end."""
    return F.split(formatted, CLOSE)


def parsed(formatted: Column) -> Column:
    """[(role, text)] of a formatted conversation; null for a turn that is none, and for all if something follows the last one."""
    found = pieces(formatted)
    return F.when(F.element_at(found, -1) == "", F.transform(F.slice(found, F.lit(1), F.size(found) - 1), _turn))


def format_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, mask) of each conversation; ``mask`` has (turn_start, loss_start, loss_end) for each turn.

    Positions count code points from 0, ends are exclusive; the positions of a loss are null for turns of other roles
    than the assistant. Null roles and texts are empty. Turns go by number, null first, ties by
    role and text; repeated rows are turns of their own; rows without an id are one conversation. An empty table
    gives no rows. A text may be of any length; a conversation has to fit into one string.
    """
    rows = turns.select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    same = lambda marked: parsed(marked).eqNullSafe(F.array(F.struct("role", "text")))
    plain, safe = rendered(F.col("role"), F.col("text")), rendered(escaped(F.col("role")), escaped(F.col("text")))
    marked = F.when(same(plain), plain).when(same(safe), safe).otherwise(F.raise_error(F.lit("a turn does not come back from its escaped form")))
    before = W.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("marked", marked).withColumn("start", F.coalesce(F.sum(F.char_length("marked")).over(before), F.lit(0)).cast("long"))
    behind = F.col("start") + F.char_length("marked") - len(CLOSE)
    inside = behind - F.char_length(F.element_at(F.split("marked", r"\[/INST\]"), 2)) + len(CLOSE)
    placed = placed.select("conv_id", "start", "role", "text", "marked", inside.alias("inside"), behind.alias("behind"))
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("start", "role", "text", "marked", "inside", "behind"))).alias("all"))
    formatted = F.array_join(F.col("all.marked"), "")
    learned = lambda t, field: F.when(t["role"] == LEARNED, t[field])
    mask = F.transform("all", lambda t: F.struct(t["start"].alias("turn_start"), learned(t, "inside").alias("loss_start"), learned(t, "behind").alias("loss_end")))
    source = F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    whole = whole.select("conv_id", formatted.alias("formatted"), mask.alias("mask"), source.alias("source"))
    checked = F.when(parsed(F.col("formatted")).eqNullSafe(F.col("source")), F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not come back from its formatted text")))
    return whole.select("conv_id", checked.alias("formatted"), "mask")


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss, formatted): the turns by the parser, and the text under the mask, unescaped, each turn's as one string."""
    under = F.zip_with(
        F.slice(pieces(F.col("formatted")), F.lit(1), F.size("mask")), "mask",
        lambda p, m: F.substr(p, (m["loss_start"] - m["turn_start"] + 1).cast("int"), (m["loss_end"] - m["loss_start"]).cast("int")),
    )
    loss = F.transform(F.filter(under, lambda t: t.isNotNull()), unescaped)
    return formatted.select("conv_id", parsed(F.col("formatted")).alias("turns"), loss.alias("loss"), "formatted")


def digests(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of formatted conversations, from what is read back."""
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join("loss", "")
    return read_back(formatted).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def digests_sql(turns: str) -> str:
    """DuckDB SQL for the rows of ``digests`` over a table of turns."""
    escape = lambda c: f"regexp_replace({c}, '{LIKE}', '\\1\\\\\\2', 'g')"
    order = "ORDER BY turn NULLS FIRST, role, text"
    joined = lambda c, only="": f"coalesce(string_agg({c}, '' {order}){only}, '')"
    learned = joined("text", f" FILTER (WHERE role = '{LEARNED}')")
    per_turn = len(OPEN + MIDDLE + CLOSE)
    return f"""WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM {turns})
SELECT conv_id, count(*) AS n_turns, sha256({joined("role || chr(10) || text || chr(10)")}) AS turns_sha256,
length({learned})::BIGINT AS loss_chars, sha256({learned}) AS loss_sha256,
sum({per_turn} + length({escape("role")}) + length({escape("text")}))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id"""
