"""Conversations as training text: turn order, control marks, loss flags, and the way back.

A declarative template names, per role, the marks around a turn and whether its text
carries loss. A finite-state machine over roles (a table of allowed steps) says whether
the turns of a conversation follow each other properly. Control marks inside texts are
escaped, so the formatted text can always be split back into the same turns.

Defined results for odd input: NULL text and NULL role count as empty; a NULL conv_id is a
conversation of its own; NULL turns come first; turns with the same number are ordered by
role, then text; repeated rows are repeated turns; an empty table gives an empty result.
Columns other than the four named ones are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


@dataclass(frozen=True)
class Template:
    """Marks, per-role loss, and the allowed steps of the role machine."""

    opening: str = START
    after_role: str = "\n"
    closing: str = END + "\n"
    loss: dict[str, bool] = field(default_factory=lambda: {"assistant": True})
    #: state -> roles that may follow; a state is the last role, "" before the first turn
    steps: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    #: states in which a conversation may end
    ends: tuple[str, ...] = ("assistant",)


DEFAULT = Template()


def escape(text: Column) -> Column:
    r"""`\` becomes `\b` and `<|` becomes `<\p`: no control mark is left, and nothing is lost."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("<\\p"))


def unescape(text: Column) -> Column:
    """The inverse of `escape`; every backslash in escaped text begins an escape."""
    return F.replace(F.replace(text, F.lit("\\p"), F.lit("|")), F.lit("\\b"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\l"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\l"), F.lit("\n")))


def turn_order_ok(roles: Column, template: Template = DEFAULT) -> Column:
    """Run the role machine over an array of roles: true if every step and the end is allowed.

    The state is the last role, or NULL once a step was not allowed.
    """
    def step(state: Column, role: Column) -> Column:
        ok = F.lit(False)
        for source, followers in template.steps.items():
            ok = ok | ((state == source) & role.isin(*followers))
        return F.when(ok, role)

    return F.aggregate(
        roles, F.lit(""), step, lambda state: F.coalesce(state.isin(*template.ends), F.lit(False)))


def format_conversations(conversations: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """conv_id, segments array<struct<text, loss>>, valid.

    The segments of a conversation, put together in order, are its formatted text; `loss`
    says which of them a model is trained on. `valid` is the verdict of the role machine;
    conversations out of order are formatted all the same, so the caller decides.
    """
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ordered = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(
        F.array_sort(F.collect_list("t")).alias("turns"))

    def segments(t: Column) -> Column:
        carries = F.lit(False)
        for role, flag in template.loss.items():
            if flag:
                carries = carries | (t["role"] == role)
        head = F.concat(F.lit(template.opening), _escape_role(t["role"]), F.lit(template.after_role))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("text"), carries.alias("loss")),
            F.struct(F.lit(template.closing).alias("text"), F.lit(False).alias("loss")))

    return ordered.select(
        "conv_id",
        F.flatten(F.transform("turns", segments)).alias("segments"),
        turn_order_ok(F.transform("turns", lambda t: t["role"]), template).alias("valid"))


def formatted_text(segments: Column) -> Column:
    """The whole formatted text of a conversation."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(
        F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def read_turns(formatted: Column, template: Template = DEFAULT) -> Column:
    """The turns array<struct<role, text>> of a formatted text."""
    pieces = F.filter(
        F.split(formatted, r"\Q" + template.opening + r"\E"), lambda p: F.length(p) > 0)

    def one(piece: Column) -> Column:
        at = F.instr(piece, template.after_role)
        body_from = at + len(template.after_role)
        body = F.substring(piece, body_from, F.length(piece) - body_from + 1 - len(template.closing))
        return F.struct(
            _unescape_role(F.substring(piece, F.lit(1), at - 1)).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, one)
