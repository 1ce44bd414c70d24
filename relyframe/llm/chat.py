"""Conversations as training text: a role machine, a template, and loss flags per segment.

DataFrame functions only. Control strings inside a text are escaped, so the
formatted text can be read back turn by turn without loss.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How turns are written. A turn is open + name + colon, the text, close; ``learned`` roles carry loss on their text.

    ``open`` and ``close`` have two characters at least and no backslash, the
    first two of ``close`` differ; names do not start with @ and hold neither a
    backslash nor the first character of ``colon``.
    """

    open: str = "### "
    colon: str = ": "
    close: str = "</turn>\n"
    names: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    learned: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        if min(len(self.open), len(self.close)) < 2 or not self.colon or "\\" in self.open + self.colon + self.close or self.close[0] == self.close[1]:
            raise ValueError("control strings that cannot be told from escaped texts")
        if any(n.startswith("@") or "\\" in n or self.colon[0] in n for n in self.names.values()):
            raise ValueError("a name that cannot be told from what follows it")


#: The machine: state -> role -> next state. A conversation is valid if every
#: turn has a transition and the last state is an accepting one.
TRANSITIONS = {
    "start": {"system": "told", "user": "asked"},
    "told": {"user": "asked"},
    "asked": {"assistant": "answered"},
    "answered": {"user": "asked"},
}
ACCEPTING = ("answered",)
BROKEN = "broken"


def escape(text: Column, template: Template, more: str = "") -> Column:
    """A backslash before every backslash and inside every control string, so that none appears in what results.

    It comes between the first two characters of a control string, and before
    each of them where they are the same; and before the characters ``more``.
    """
    controls = (template.open, template.close)
    single = "".join(re.escape(c) for c in dict.fromkeys("\\" + "".join(c[0] for c in controls if c[0] == c[1]) + more))
    pairs = [f"(?<={re.escape(c[0])}){re.escape(c[1])}" for c in dict.fromkeys(controls) if c[0] != c[1]]
    return F.regexp_replace(text, "(" + "|".join([f"[{single}]", *pairs]) + ")", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _next_state(state: Column, role: Column) -> Column:
    out = F.lit(BROKEN)
    for s, moves in TRANSITIONS.items():
        for r, t in moves.items():
            out = F.when((state == s) & (role == r), F.lit(t)).otherwise(out)
    return out


def format_conversations(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conv_id: conv_id, n_turns, valid, broken_at, formatted, segments.

    Rows are turns, in order of turn, then role, then text; repeated rows are
    turns of their own, a null turn comes first, a null text is empty, a null
    role has an empty name. Roles outside the template keep their own name
    after an @, escaped. ``segments`` are (text, loss) and concatenate to
    ``formatted``. Conversations that break the turn order are formatted as
    well; ``valid`` says so and ``broken_at`` is the first turn, from 0, without a
    transition. A conversation is one output string and is gathered as such.
    """
    t = template or Template()
    name = F.concat(F.lit("@"), escape(F.col("role"), t, t.colon[0]))
    for role, shown in t.names.items():
        name = F.when(F.col("role") == role, F.lit(shown)).otherwise(name)
    turns = rows.select(
        "conv_id", F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).select("conv_id", F.struct("turn", "role", "text", name.alias("name"), escape(F.col("text"), t).alias("safe")).alias("x"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("turns"))
    learned = lambda x: x["role"].isin(*t.learned)
    segments = F.flatten(F.transform("turns", lambda x: F.array(
        F.struct(F.concat(F.lit(t.open), x["name"], F.lit(t.colon)).alias("text"), F.lit(False).alias("loss")),
        F.struct(x["safe"].alias("text"), learned(x).alias("loss")),
        F.struct(F.lit(t.close).alias("text"), F.lit(False).alias("loss")),
    )))
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("broken"))

    def step(acc: Column, x: Column) -> Column:
        state = _next_state(acc["state"], x["role"])
        return F.struct(state.alias("state"), (acc["at"] + 1).alias("at"), F.when(acc["broken"].isNull() & (state == BROKEN), acc["at"]).otherwise(acc["broken"]).alias("broken"))

    return (
        whole.select("conv_id", "turns", segments.alias("segments"), F.aggregate("turns", start, step).alias("end"))
        .select(
            "conv_id", F.size("turns").cast("long").alias("n_turns"), F.col("end.state").isin(*ACCEPTING).alias("valid"), F.col("end.broken").alias("broken_at"),
            F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments",
        )
    )


def quoted(control: str) -> str:
    return r"\Q" + control + r"\E"


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """Turns (role, text) of a formatted conversation."""
    t = template or Template()
    pieces = F.filter(F.split(formatted, quoted(t.close)), lambda p: p != "")
    head = "(?s)^" + quoted(t.open) + r"((?:[^\\" + re.escape(t.colon[0]) + r"]++|\\.)*+)" + quoted(t.colon)

    def turn(p: Column) -> Column:
        name = F.regexp_extract(p, head, 1)
        role = unescape(F.substring(name, 2, 1 << 30))
        for r, shown in t.names.items():
            role = F.when(name == shown, F.lit(r)).otherwise(role)
        return F.struct(role.alias("role"), unescape(F.regexp_replace(p, head, "")).alias("text"))

    return F.transform(pieces, turn)


def digests(out: DataFrame, template: Template | None = None) -> DataFrame:
    """What the formatted text and the loss mask hold, read back from them; broken_at is -1 where no turn breaks the order."""
    turns = read_back(F.col("formatted"), template)
    lines = F.transform(turns, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return out.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid",
        F.coalesce("broken_at", F.lit(-1)).alias("broken_at"),
    )
