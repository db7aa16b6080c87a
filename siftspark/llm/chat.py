"""Chat formatting in DataFrame functions alone, with a grammar round trip.

Grammar: `<chat raw>\\n` or `<chat escaped>\\n`, then for each turn `### role: text</turn>\\n`. The
parser ends a role at the first `: ` and a text at the first `</turn>`. A conversation is first
rendered raw, reparsed and compared; if a turn comes back otherwise, or a control string stands
anywhere but at its place, it is rendered escaped, reparsed and compared again, and anything but
the source is an error. Escapes are pairs that begin with a backslash: `\\\\` a backslash,
`\\h` the `#` of `### `, `\\l` the `<` of `</turn>`, `\\c` a colon of a role.

A conversation is one row here, as its digest is of all its turns; its size bounds the task.
Edge cases: null roles and texts are empty; null turns come first; rows that repeat a turn are
ordered by role and text; a null conv_id is a conversation of its own. Extra columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fingerprint import bound

OPEN, CLOSE = "### ", "</turn>"
TURN = r"(?s)### (.*?): (.*?)</turn>\n"


def escape(text: Column, role: bool = False) -> Column:
    """text with no control string in it; `unescape` gives the text back."""
    out = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(OPEN), F.lit("\\h## ")), F.lit(CLOSE), F.lit("\\l/turn>"))
    return F.replace(out, F.lit(":"), F.lit("\\c")) if role else out


def unescape(text: Column) -> Column:
    """Pairs are read from the left, so what stands between double backslashes has whole pairs only."""
    plain = lambda x: F.replace(F.replace(F.replace(x, F.lit("\\h"), F.lit("#")), F.lit("\\l"), F.lit("<")), F.lit("\\c"), F.lit(":"))
    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def _count(text: Column, what: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))) / len(what)


def _given(field: str) -> Column:
    return F.transform("turns", lambda t: t[field])


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and turns, the array of (turn, role, text) in order."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))


def formatted(turns: DataFrame) -> DataFrame:
    """Per conversation: conv_id, turns, formatted (the rendered text), roles and texts (as reparsed from it)."""
    df = conversations(turns)

    def render(kind: str, one) -> Column:
        return F.concat(F.lit(f"<chat {kind}>\n"), F.array_join(F.transform("turns", one), ""))

    def part(t: Column, safe) -> Column:
        return F.concat(F.lit(OPEN), safe(t["role"], True), F.lit(": "), safe(t["text"], False), F.lit(CLOSE + "\n"))

    df = bound(df, "__raw", render("raw", lambda t: part(t, lambda x, _: x)))
    ends = F.size("turns")
    fine = (_count(F.col("__raw"), OPEN) == ends) & (_count(F.col("__raw"), CLOSE) == ends)
    df = bound(df, "__same", fine & (F.regexp_extract_all("__raw", F.lit(TURN), F.lit(1)) == _given("role")) & (F.regexp_extract_all("__raw", F.lit(TURN), F.lit(2)) == _given("text")))
    df = bound(df, "formatted", F.when(F.col("__same"), F.col("__raw")).otherwise(render("escaped", lambda t: part(t, escape)))).drop("__raw")
    return reparsed(df.drop("__same"))


def reparsed(df: DataFrame) -> DataFrame:
    """df (conv_id, turns, formatted) with roles and texts read back from `formatted`; an error if they are not the source's."""
    read = lambda k: F.when(F.startswith("formatted", F.lit("<chat raw>\n")), F.regexp_extract_all("formatted", F.lit(TURN), F.lit(k))).otherwise(F.transform(F.regexp_extract_all("formatted", F.lit(TURN), F.lit(k)), unescape))
    df = bound(bound(df, "roles", read(1)), "texts", read(2))
    right = (F.col("roles") == _given("role")) & (F.col("texts") == _given("text"))
    return df.withColumn("texts", F.when(right, F.col("texts")).otherwise(F.raise_error(F.lit("a conversation does not survive its round trip")).cast("array<string>")))


def masked(df: DataFrame) -> DataFrame:
    """df with `mask`: of each turn of `formatted`, in order, its rendered text and the part of it under the loss (start from 1, and length, 0 where there is none)."""
    role, text = (lambda t, k=k: F.regexp_extract(t, TURN, k) for k in (1, 2))
    under = lambda t: F.struct(t.alias("turn"), (F.length(role(t)) + len(OPEN) + 3).alias("start"), F.when(role(t) == "assistant", F.length(text(t))).otherwise(0).alias("length"))
    return bound(df, "mask", F.transform(F.regexp_extract_all("formatted", F.lit(TURN), F.lit(0)), under))


def loss_text() -> Column:
    """All text under `mask`, unescaped."""
    part = F.transform(F.filter("mask", lambda m: m["length"] > 0), lambda m: F.substring(m["turn"], m["start"], m["length"]))
    return F.array_join(F.when(F.startswith("formatted", F.lit("<chat raw>\n")), part).otherwise(F.transform(part, unescape)), "")


def loss_spans(df: DataFrame) -> DataFrame:
    """Per part of `formatted` under the loss: conv_id, position of its turn, start (from 0) and length in the rendered text."""
    df = masked(df).select("conv_id", F.length(F.regexp_extract("formatted", r"^<chat \w+>\n", 0)).alias("__head"), F.posexplode("mask").alias("position", "__m"))
    before = "__head + coalesce(sum(length(__m.turn)) over (partition by conv_id order by position rows between unbounded preceding and 1 preceding), 0)"
    return df.select("conv_id", "position", F.expr(f"{before} + __m.start - 1").alias("start"), F.col("__m.length").alias("length")).where("length > 0")


def conversation_digests(turns: DataFrame) -> DataFrame:
    """What is read back from each formatted conversation, as digests."""
    df = masked(formatted(turns))
    pairs = F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n")))
    df = bound(df, "__loss", loss_text())
    return df.select(
        "conv_id", F.size("texts").cast("bigint").alias("n_turns"), F.sha2(F.array_join(pairs, ""), 256).alias("turns_sha256"),
        F.length("__loss").cast("bigint").alias("loss_chars"), F.sha2("__loss", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def with_conflict(turns: DataFrame) -> DataFrame:
    """The rows of conversations and conversation -7, whose texts hold the template's own control strings."""
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    own = turns.sparkSession.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(r"\### Assistant: </turn> ok").alias("text"))
    return turns.select("conv_id", "turn", "role", "text").unionByName(own)


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(replace(role, '\', '\\'), '### ', '\h## '), '</turn>', '\l/turn>'), ':', '\c') AS safe_role,
  replace(replace(replace(text, '\', '\\'), '### ', '\h## '), '</turn>', '\l/turn>') AS safe_text,
  contains(text, '### ') OR contains(text, '</turn>') OR contains(role, '### ') OR contains(role, '</turn>') OR contains(role, ':') AS conflict FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, bool_or(conflict) AS escaped, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
  sum(length(role) + length(text) + 14) AS raw_chars, sum(length(safe_role) + length(safe_text) + 14) AS safe_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
  (CASE WHEN escaped THEN 15 + safe_chars ELSE 11 + raw_chars END)::BIGINT AS formatted_chars FROM g
"""
