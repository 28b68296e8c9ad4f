"""Conversations rebuilt from event logs, rendered with a loss mask, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Marks of the template, in the ChatML form.
START, END = "<|im_start|>", "<|im_end|>"
#: Characters that open a control string of this or another template, and their stand-ins.
#: The ampersand comes first when escaping and last when reading back.
_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lbrack;"))


def escape(text: Column) -> Column:
    for plain, safe in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for plain, safe in reversed(_ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def turn_events(conversations: DataFrame) -> DataFrame:
    """A ``message`` event for each row ``conv_id, turn, role, text`` of a conversation.

    Rows are numbered by turn, role and text, so that rows which share a turn stay apart.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return conversations.select(
        "conv_id",
        F.row_number().over(order).cast("long").alias("turn"),
        F.lit(0).cast("long").alias("seq"),
        F.lit("message").alias("kind"),
        "role",
        "text",
    )


def streamed_events(conversations: DataFrame, width: int = 64, most: int = 8) -> DataFrame:
    """The log of a chat service for rows ``conv_id, turn, role, text``, newest events first.

    A turn's hash tells how its text comes about: streamed in deltas; streamed again, in place
    of a draft, by a ``regenerate``; sent as a draft and set right by an ``edit``; or sent whole
    as a ``message``, as are null texts. Deltas have ``width`` code points, more where a text
    would take above ``most`` of them. Only the first event of a turn names the role. Turns
    are numbered as by ``turn_events``, and ``seq`` counts the events of a conversation.
    """
    size = F.char_length("text")
    step = F.greatest(F.lit(width), F.ceil(size / most).cast("int"))
    texts = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(size / F.col("step")).cast("int") - 1, F.lit(0))),
        lambda k: F.substr("text", k * F.col("step") + 1, F.col("step")),
    )

    def event(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"))

    draft = F.concat(F.lit("draft: "), F.reverse(F.substr("text", F.lit(1), F.lit(width))))
    deltas = F.transform(texts, lambda t: event("delta", t))
    way = F.pmod(F.xxhash64("conv_id", "turn", "text"), F.lit(4))
    events = (
        F.when(F.col("text").isNull() | (way == 0), F.array(event("message", F.col("text"))))
        .when(way == 1, deltas)
        .when(way == 2, F.concat(F.array(event("delta", draft), event("regenerate", F.lit(None).cast("string"))), deltas))
        .otherwise(F.array(event("message", draft), event("edit", F.col("text"))))
    )
    log = turn_events(conversations).withColumn("step", step).select(
        "conv_id", "turn", "role", F.posexplode(F.reverse(events)).alias("left", "e"), F.size(events).alias("n")
    )
    nth = F.col("n") - 1 - F.col("left")
    return log.select(
        "conv_id",
        "turn",
        (F.col("turn") * (most + 3) + nth).cast("long").alias("seq"),
        F.col("e.kind").alias("kind"),
        F.when(nth == 0, F.col("role")).alias("role"),
        F.col("e.text").alias("text"),
    )


def reconstruct(events: DataFrame) -> DataFrame:
    """Final messages ``conv_id, turn, role, text`` of an event log.

    ``events`` has ``conv_id, turn, seq, kind, role, text``. In order of ``seq``, a
    ``message`` or ``edit`` sets the text of its turn, a ``delta`` extends it, and
    ``regenerate`` empties it for the deltas that follow; an unknown kind changes nothing.
    Events of equal ``seq`` are ordered by kind and text; events that repeat an earlier
    one in all six columns count once. The role is that of the last event that names one.
    Null text is empty, a null role is an empty one, null ids and turns are groups of
    their own. The fold is per turn, so a long conversation is spread over its turns, and
    linear in a turn's events and text.
    """
    log = events.select(
        "conv_id",
        "turn",
        F.struct(
            "seq",
            F.coalesce("kind", F.lit("message")).alias("kind"),
            F.coalesce("text", F.lit("")).alias("text"),
            "role",
        ).alias("e"),
    )
    turns = log.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_set("e")).alias("es"))

    # what counts is the last event that sets the text anew, and what extends it
    anew = F.transform("es", lambda e, i: F.when(e["kind"].isin("message", "edit", "regenerate"), i))
    turns = turns.select("*", F.coalesce(F.array_max(anew), F.lit(0)).alias("at"))
    last = F.filter(
        "es", lambda e, i: (i >= F.col("at")) & e["kind"].isin("message", "edit", "delta")
    )
    named = F.filter("es", lambda e: e["role"].isNotNull())
    return turns.select(
        "conv_id",
        "turn",
        F.coalesce(F.try_element_at(named, F.lit(-1))["role"], F.lit("")).alias("role"),
        F.array_join(F.transform(last, lambda e: e["text"]), "").alias("text"),
    )


def _escape_role(role: Column) -> Column:
    # a line end would close the role early
    return F.replace(escape(role), F.lit("\n"), F.lit("&nl;"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def render(messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_spans``.

    A turn is ``<|im_start|>role\\ntext<|im_end|>\\n`` with control characters of role and
    text escaped. ``loss_spans`` holds start and length, in code points of ``formatted``,
    of the escaped text of every turn whose role is ``learn``. Turns are in order of
    ``turn``, null first; turns that share a number are ordered by role and text. Null role
    and text are empty. Turns are rendered one by one and placed by a running sum, so the
    work is linear; only the finished text of a conversation meets in one row.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    turns = messages.select(
        "conv_id",
        "turn",
        role.alias("role"),
        text.alias("text"),
        F.concat(F.lit(START), _escape_role(role), F.lit("\n")).alias("head"),
        escape(text).alias("body"),
    ).select(
        "*",
        F.char_length("head").cast("long").alias("before"),
        F.char_length("body").cast("long").alias("length"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = turns.select(
        "conv_id",
        F.struct(
            F.row_number().over(order).alias("n"),
            F.concat("head", "body", F.lit(END + "\n")).alias("out"),
            F.when(
                F.col("role") == learn,
                F.struct(
                    (
                        F.sum(F.col("before") + F.col("length") + len(END) + 1).over(
                            order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
                        )
                        - F.col("length")
                        - len(END)
                        - 1
                    ).alias("start"),
                    F.col("length"),
                ),
            ).alias("span"),
        ).alias("m"),
    )
    rows = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    return rows.select(
        "conv_id",
        F.array_join(F.transform("ms", lambda m: m["out"]), "").alias("formatted"),
        F.filter(F.transform("ms", lambda m: m["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
    )


#: Pieces whose running sum is an array that grows one by one.
_BLOCK = 256


def _running(values: Column) -> Column:
    """The running sums of a short array of whole numbers."""
    sums = F.aggregate(
        values,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("sums")),
        lambda s, v: F.struct(
            (s["at"] + F.coalesce(v, F.lit(0))).alias("at"),
            F.concat(s["sums"], F.array(s["at"] + F.coalesce(v, F.lit(0)))).alias("sums"),
        ),
    )
    return sums["sums"]


def read_back(rendered: DataFrame) -> DataFrame:
    """Turns and learned texts of rendered conversations: ``conv_id, turns, learned,
    formatted_chars``.

    ``turns`` is an array of role and text, ``learned`` the unescaped texts under the loss
    mask; both come from ``formatted`` and ``loss_spans`` alone. The output is cut at the
    end marks once; a turn's text is under the mask if a span starts where it does.
    """
    tail = len(END) + 1
    # the pattern of split() is a regular expression, hence the quotation
    pieces = F.filter(F.split("formatted", r"\Q" + END + r"\E\n"), lambda p: p != "")
    cut = rendered.select(
        "conv_id",
        "loss_spans",
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        pieces.alias("ps"),
    ).select(
        "conv_id",
        "loss_spans",
        "formatted_chars",
        F.transform(
            "ps",
            lambda p: F.struct(
                F.substr(F.substring_index(p, "\n", 1), F.lit(len(START) + 1)).alias("role"),
                F.substr(p, F.locate("\n", p) + 1).alias("body"),
                F.char_length(p).cast("long").alias("size"),
            ),
        ).alias("ps"),
    )
    # where each piece begins: running sums within blocks of pieces, and over the blocks
    sizes = F.transform("ps", lambda p: p["size"] + tail)
    cut = cut.select("*", sizes.alias("sizes")).select(
        "*",
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.size("ps"), F.lit(1)), F.lit(_BLOCK)),
            lambda at: _running(F.slice("sizes", at, _BLOCK)),
        ).alias("within"),
    )
    before = _running(F.transform("within", lambda b: F.try_element_at(b, F.lit(-1))))
    ends = F.flatten(
        F.zip_with(
            "within",
            F.concat(F.array(F.lit(0).cast("long")), F.slice(before, 1, F.size("within") - 1)),
            lambda block, at: F.transform(block, lambda end: end + at),
        )
    )
    bodies = F.zip_with(
        "ps", ends, lambda p, end: end - tail - F.char_length(p["body"])
    )
    # spans and bodies in one order; a body under the mask follows the span that starts with it
    both = F.concat(
        F.transform(bodies, lambda at, i: F.struct(at.alias("at"), i.alias("i"))),
        F.transform("loss_spans", lambda s: F.struct(s["start"].alias("at"), F.lit(-1).alias("i"))),
    )
    cut = cut.select("*", F.array_sort(both).alias("both"))
    hits = F.filter(
        F.transform(
            "both",
            lambda x, n: F.when(
                (x["i"] >= 0)
                & (F.get("both", n - 1)["i"] < 0)
                & (F.get("both", n - 1)["at"] == x["at"]),
                x["i"],
            ),
        ),
        lambda i: i.isNotNull(),
    )
    masked = F.transform(hits, lambda i: F.get("ps", i)["body"])
    return cut.select(
        "conv_id",
        F.transform(
            "ps",
            lambda p: F.struct(
                _unescape_role(p["role"]).alias("role"), unescape(p["body"]).alias("text")
            ),
        ).alias("turns"),
        F.transform(masked, unescape).alias("learned"),
        "formatted_chars",
    )
