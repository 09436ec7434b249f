r"""Chat formatting with a grammar round trip, with DataFrame operations only.

Grammar of a formatted conversation, turn after turn:

    other     := "[INST]" role "\n" text "[/INST]"
    assistant := "<s>" role "\n" text "</s>"

The loss mask covers the texts of assistant turns. A parser reads the formatted string back: it splits it into turns by
the control strings alone, so a text that holds one would come back changed. Each turn is formatted plainly first and
parsed; a turn that does not come back as it was is in conflict, and its text is escaped. Escaping puts a backslash
after the bracket of whatever looks like a control string or an escaped one ([INST] to [\INST], [\INST] to [\\INST]); the
parser always takes one away, so escaped texts come back identical and plain ones do unless they hold such a string.
Roles are percent-encoded in their line. The whole conversation is then parsed again and compared to the source: if a
turn came back changed, the query would fail rather than return it.

Defined results: null text and null role are empty; turns are in order of turn (null first), then role and text; rows
that repeat a turn are turns of their own; rows with a null conv_id are one conversation; an empty table gives an empty
table; other columns are ignored.

A conversation's digest needs all its turns in one value, so turns are gathered by conversation, with a partial
gathering before the shuffle; formatting and parsing work on that one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ASSISTANT = "assistant"
_CONTROL = r"([<\[])(\\*)(/?INST\]|/?s>)"
_ESCAPED = r"([<\[])\\(\\*)(/?INST\]|/?s>)"
_TURN = r"(?s)(?:\[INST\][^\n]*\n.*?\[/INST\]|<s>[^\n]*\n.*?</s>)"
_ROLE_CODES = (("%", "%25"), ("\n", "%0A"), ("[", "%5B"), ("<", "%3C"))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _role_line(role: Column) -> Column:
    for plain, code in _ROLE_CODES:
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def _role_of(line: Column) -> Column:
    for plain, code in reversed(_ROLE_CODES):
        line = F.replace(line, F.lit(code), F.lit(plain))
    return line


def _rendered(turn: Column, text: Column) -> Column:
    ours = turn["role"] == ASSISTANT
    return F.concat(F.when(ours, F.lit("<s>")).otherwise(F.lit("[INST]")), _role_line(turn["role"]), F.lit("\n"), text, F.when(ours, F.lit("</s>")).otherwise(F.lit("[/INST]")))


def parsed(formatted: Column) -> Column:
    """The turns (role, text, loss) of a formatted conversation."""

    def one(part: Column) -> Column:
        ours = part.startswith("<s>")
        line_end = F.instr(part, "\n")
        head, tail = F.when(ours, F.lit(3)).otherwise(F.lit(6)), F.when(ours, F.lit(4)).otherwise(F.lit(7))
        role = part.substr(head + 1, line_end - head - 1)
        text = part.substr(line_end + 1, F.length(part) - line_end - tail)
        return F.struct(_role_of(role).alias("role"), unescaped(text).alias("text"), ours.alias("loss"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0)), one)


def _plain_turns(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def _conflicts(role: Column, text: Column) -> Column:
    """Whether the turn, formatted plainly, does not parse to itself alone."""
    turn = F.struct(role.alias("role"), text.alias("text"))
    return F.transform(F.array(turn), lambda t: _plain_turns(parsed(_rendered(t, t["text"]))) != F.array(t))[0]


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, turns (role, text; the source), formatted and escaped (whether a turn had to be) of rows (conv_id, turn, role, text).

    A conversation whose formatted form did not parse to its turns would raise.
    """
    said = rows.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    judged = said.select("conv_id", F.struct("turn", "role", "text", _conflicts(F.col("role"), F.col("text")).alias("escaped")).alias("said"))
    whole = judged.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("said"))
    forms = F.transform("said", lambda t: _rendered(t, F.when(t["escaped"], escaped(t["text"])).otherwise(t["text"])))
    made = whole.select("conv_id", _plain_turns(F.col("said")).alias("turns"), F.array_join(forms, "").alias("formatted"), F.exists("said", lambda t: t["escaped"]).alias("escaped"))
    return made.select("conv_id", "turns", verified(F.col("formatted"), F.col("turns")).alias("formatted"), "escaped")


def verified(formatted: Column, turns: Column) -> Column:
    """formatted, if it parses to the turns (role, text); else an error."""
    return F.when(_plain_turns(parsed(formatted)) == turns, formatted).otherwise(F.raise_error(F.lit("a formatted conversation does not parse to its turns")).cast("string"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (role, text, loss) and loss_text of formatted conversations, from the strings alone."""
    turns = formatted.select("conv_id", "formatted", parsed(F.col("formatted")).alias("turns"))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return turns.withColumn("loss_text", loss)


def planted(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose two texts are made of control strings."""
    role = F.when(F.col("id") == 0, "user").otherwise(ASSISTANT)
    return spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    back = read_back(format_conversations(rows.unionByName(planted(spark))))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP7_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), judged AS (
  SELECT *, regexp_matches(text, '[<\[]\\+(/?INST\]|/?s>)')
    OR CASE WHEN role = 'assistant' THEN contains(text, '</s>') ELSE contains(text, '[/INST]') END AS escape FROM said
), sized AS (
  SELECT *, length(role) + 1 + CASE WHEN role = 'assistant' THEN 7 ELSE 13 END
    + length(CASE WHEN escape THEN regexp_replace(text, '([<\[])(\\*)(/?INST\]|/?s>)', '\1\\\2\3', 'g') ELSE text END) AS n FROM judged
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
