"""Chat formatting: a state machine over roles walks the turns and emits segments with loss flags, by a declarative template."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How turns are written. ``head`` and ``tail`` of a turn are marks; {role} stands for the role's title.

    ``roles``: title of each role and whether its texts count for the loss; other
    roles, null too, are written under their own escaped name without loss.
    ``moves``: the roles that may follow a role ("" is the start); ``ends``: where a
    conversation may stop.
    """

    mark: str = "### "
    colon: str = ":\n"
    tail: str = "</turn>\n"
    roles: dict[str, tuple[str, bool]] = field(default_factory=lambda: {"system": ("System", False), "user": ("User", False), "assistant": ("Assistant", True)})
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        """ValueError for marks by which texts could not be told apart again."""
        for text in (self.colon, self.tail):
            if not text or any(text.startswith(text[k:]) for k in range(1, len(text))):
                raise ValueError(f"{text!r} is empty or ends as it begins")
        for core in [*self.escapes][1:]:
            if "\\" in core or core[0] in "bhec":
                raise ValueError(f"{core!r} could arise from escapes")

    @property
    def escapes(self) -> dict[str, str]:
        """Code behind a backslash of each string that texts may not show, from the template's own marks; the backslash comes first."""
        core = lambda x: x.strip() if len(x.strip()) > 1 else x
        out = {"\\": "b"}
        for text, code in ((self.mark, "h"), (self.tail, "e"), (self.colon, "c")):
            if text:
                out.setdefault(core(text), code)
        return out


def escaped(c: Column, template: Template) -> Column:
    """Reversible: afterwards each backslash stands before a code, and no control string is left."""
    for text, code in template.escapes.items():
        c = F.replace(c, F.lit(text), F.lit("\\" + code))
    return c


def unescaped(c: Column, template: Template) -> Column:
    for text, code in reversed(template.escapes.items()):
        c = F.replace(c, F.lit("\\" + code), F.lit(text))
    return c


def format_chats(df: DataFrame, template: Template | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: conv, n_turns, segments, formatted, loss_spans, state, valid.

    The machine starts in state "", takes the role of each turn and goes on as ``moves`` allow; after a turn out of order it
    stays in "!". ``segments``: array<struct<text, loss, state>> that it emits, three a turn, with the state that it then is in; their texts joined are ``formatted``;
    ``loss_spans``: array<struct<start, end>> in code points, end exclusive. ``state`` is the last one and ``valid`` whether a
    conversation may stop there. Turns out of order are written like others. Turns are in the
    order of ``turn``, ties by role and text, nulls first; repeated rows are turns each; a null text is empty, a
    null role is written as an empty name and is never valid. Rows with a null
    conversation id make one conversation. Texts of any length are taken whole. Other columns aren't read. A conversation, like a document, is one row.
    """
    t = template or Template()
    say = F.coalesce(F.col(text), F.lit(""))
    who = F.coalesce(F.col(role), F.lit(""))
    title = F.coalesce(*[F.when(who == k, F.lit(v)) for k, (v, _) in t.roles.items()], F.concat(F.lit("@"), escaped(who, t)))
    loss = F.coalesce(*[F.when(who == k, F.lit(v)) for k, (_, v) in t.roles.items()], F.lit(False))
    turns = df.select(F.col(conv).alias("conv"), F.struct(F.col(turn).alias("turn"), who.alias("role"), say.alias("text"), title.alias("title"), loss.alias("loss")).alias("t"))
    chats = turns.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    moves = F.create_map(*[F.lit(x) for a, bs in t.moves.items() for b in bs for x in (f"{a}>{b}", b)])
    step = lambda s, x: F.when(s == "!", s).otherwise(F.coalesce(F.try_element_at(moves, F.concat(s, F.lit(">"), x["role"])), F.lit("!")))
    walked = F.aggregate("turns", F.array(F.lit("")), lambda seen, x: F.concat(seen, F.array(step(F.element_at(seen, -1), x))))
    emit = lambda x, s: F.array(
        F.struct(F.concat(F.lit(t.mark), x["title"], F.lit(t.colon)).alias("text"), F.lit(False).alias("loss"), s.alias("state")),
        F.struct(escaped(x["text"], t).alias("text"), x["loss"].alias("loss"), s.alias("state")),
        F.struct(F.lit(t.tail).alias("text"), F.lit(False).alias("loss"), s.alias("state")),
    )
    spans = F.aggregate(
        "segments",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["text"])).alias("at"),
            F.when(x["loss"], F.concat(a["spans"], F.array(F.struct(a["at"].alias("start"), (a["at"] + F.length(x["text"])).alias("end"))))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return (
        chats.withColumn("states", walked)
        .select("conv", F.size("turns").cast("long").alias("n_turns"), F.flatten(F.zip_with("turns", F.slice("states", F.lit(2), F.size("turns")), emit)).alias("segments"))
        .withColumn("formatted", F.array_join(F.col("segments.text"), ""))
        .withColumn("loss_spans", spans)
        .withColumn("state", F.element_at("segments", -1)["state"])
        .withColumn("valid", F.col("state").isin(*t.ends))
        .select(F.col("conv").alias(conv), "n_turns", "segments", "formatted", "loss_spans", "state", "valid")
    )


def read_back(df: DataFrame, template: Template | None = None, formatted: str = "formatted") -> DataFrame:
    """Adds ``read_turns``, array<struct<role, text>>, parsed from the formatted text alone."""
    t = template or Template()
    names = F.create_map(*[F.lit(x) for k, (v, _) in t.roles.items() for x in (v, k)])

    def turn(x: Column) -> Column:
        head = F.substring_index(x, t.colon, 1)
        title = F.substr(head, F.lit(len(t.mark) + 1))
        return F.struct(
            F.coalesce(F.try_element_at(names, title), unescaped(F.substr(title, F.lit(2)), t)).alias("role"),
            unescaped(F.substr(x, F.length(head) + len(t.colon) + 1), t).alias("text"),
        )

    parts = F.split(F.col(formatted), F.lit("\\Q" + t.tail.replace("\n", "\\E\n\\Q") + "\\E"))
    return df.withColumn("read_turns", F.transform(F.filter(parts, lambda x: x != ""), turn))


def loss_text(template: Template | None = None, formatted: str = "formatted", spans: str = "loss_spans") -> Column:
    """What lies under the loss mask of a formatted text, unescaped, nothing between."""
    t = template or Template()
    return F.array_join(F.transform(spans, lambda x: unescaped(F.substr(F.col(formatted), (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int")), t)), "")
