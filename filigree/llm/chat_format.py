"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation becomes one text: per turn ``### `` role ``: `` text ``</turn>`` and a line feed. The parser
is deterministic: it cuts at the end mark, takes the role up to the first colon and space, and always
unescapes both. A turn is first rendered as it is and read back alone; if that gives anything but its
source, its role and text are escaped. Then the whole conversation is read back and compared with its
source; if it still differs, all its turns are escaped. Escaping doubles backslashes and breaks each
control string with a single one, so no mark can occur inside an escaped text and reading back is exact.

The loss mask of a conversation covers what the assistant says: spans (start, length) in code points of
the formatted text.

Null roles and texts count as empty; turns are ordered by turn (nulls first), role and text, so repeated
turns stay and ties have one order; a null conv_id is a conversation of its own. Other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"
#: What is broken up, and how; backslashes are doubled before.
BROKEN = [("###", "#\\##"), ("</turn>", "<\\/turn>"), (": ", ":\\ ")]
ASSISTANT = "assistant"


def _put(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escape(c: Column, role: bool = False) -> Column:
    c = _put(c, "\\", "\\\\")
    for old, new in BROKEN[: 3 if role else 2]:
        c = _put(c, old, new)
    return c


def unescape(c: Column, role: bool = False) -> Column:
    for old, new in BROKEN[: 3 if role else 2]:
        c = _put(c, new, old)
    return _put(c, "\\\\", "\\")


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(COLON), text, F.lit(CLOSE))


def parse(formatted: Column) -> Column:
    """An array of (role, text, start, size) from a formatted text: start and size span the text as it stands."""
    pieces = F.split(formatted, CLOSE, -1)
    whole = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def read(piece: Column) -> Column:
        body = F.substring(piece, F.lit(len(OPEN) + 1), F.length(piece))
        cut = F.instr(body, COLON)
        raw = F.substring(body, cut + len(COLON), F.length(body))
        return F.struct(
            unescape(F.substring(body, F.lit(1), cut - 1), True).alias("role"), unescape(raw).alias("text"),
            (len(OPEN) + cut - 1 + len(COLON)).cast("long").alias("before"), F.length(raw).cast("long").alias("size"),
            F.length(piece).cast("long").alias("all"),
        )

    return F.transform(whole, read)


def _same(parsed: Column, source: Column) -> Column:
    bare = lambda xs: F.transform(xs, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return bare(parsed) == bare(source)


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, source, formatted): source is the array of (turn, role, text), formatted its exact rendering."""
    role, text = (F.coalesce(F.col(k), F.lit("")) for k in ("role", "text"))
    one = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    raw = render_turn(F.col("role"), F.col("text"))
    alone = F.array(F.struct(F.col("role").alias("role"), F.col("text").alias("text")))
    full = render_turn(escape(F.col("role"), True), escape(F.col("text")))
    one = one.withColumn("escaped", full).withColumn("shown", F.when(_same(parse(raw), alone), raw).otherwise(full))
    grouped = one.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "shown", "escaped"))).alias("source"))
    joined = grouped.withColumn("formatted", F.array_join(F.col("source.shown"), ""))
    exact = _same(parse(F.col("formatted")), F.col("source"))
    safe = F.when(exact, F.col("formatted")).otherwise(F.array_join(F.col("source.escaped"), ""))
    keep = F.transform("source", lambda x: F.struct(x["turn"].alias("turn"), x["role"].alias("role"), x["text"].alias("text")))
    return joined.select("conv_id", keep.alias("source"), safe.alias("formatted"))


def with_loss_mask(formatted: DataFrame) -> DataFrame:
    """Adds turns (as read back) and loss_mask: the spans (start, size) of the assistant's texts, start from 0."""
    parsed = formatted.withColumn("turns", parse(F.col("formatted")))
    start = F.aggregate(
        "turns", F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["all"] + len(CLOSE)))
    )
    spans = F.zip_with("turns", start, lambda t, s: F.struct(t["role"].alias("role"), (s + t["before"]).alias("start"), t["size"].alias("size")))
    mask = F.transform(F.filter(spans, lambda s: s["role"] == ASSISTANT), lambda s: F.struct(s["start"].alias("start"), s["size"].alias("size")))
    return parsed.withColumn("loss_mask", mask)


def digests(masked: DataFrame) -> DataFrame:
    """Counts and digests of what the formatted text gives back, turns and text under the loss mask."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    under = F.transform("loss_mask", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["size"].cast("int"))))
    loss = F.array_join(under, "")
    return masked.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
