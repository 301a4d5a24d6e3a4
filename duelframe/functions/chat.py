"""Chat messages and their rendering to one string."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from duelframe.functions.tokens import EOS_TEXT


@dataclass(frozen=True)
class ChatTemplate:
    """How a list of messages becomes text.

    Every message is ``prefix + role + separator + content + suffix``; ``eos``
    ends the string. ``generation_prompt`` is added before ``eos`` on request.
    ``with_role=False`` leaves out role and separator. ``role_names`` renames
    roles.
    """

    prefix: str = ""
    separator: str = ": "
    suffix: str = "\n\n"
    eos: str = EOS_TEXT
    generation_prompt: str = ""
    with_role: bool = True
    role_names: dict[str, str] = field(default_factory=dict)

    def role(self, role: Column) -> Column:
        shown = role
        for name, other in self.role_names.items():
            shown = F.when(role == name, F.lit(other)).otherwise(shown)
        return shown

    def message(self, role: Column, content: Column) -> Column:
        parts = [F.lit(self.prefix)]
        if self.with_role:
            parts += [self.role(role), F.lit(self.separator)]
        return F.concat(*parts, content, F.lit(self.suffix))


ROLE_LINES = ChatTemplate()


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def messages(user: Column | None = None, assistant: Column | None = None) -> Column:
    """A list of the given messages, user first."""
    turns = []
    if user is not None:
        turns.append(message("user", user))
    if assistant is not None:
        turns.append(message("assistant", assistant))
    if not turns:
        raise ValueError("a chat needs at least one message")
    return F.array(*turns)


def render_chat(
    chat: Column,
    template: ChatTemplate = ROLE_LINES,
    add_generation_prompt: bool = False,
) -> Column:
    """Render ``ARRAY<STRUCT<role, content>>`` to a string.

    A message without role or content is an error (joining would drop it).
    """
    shown = F.transform(
        chat,
        lambda m: F.coalesce(
            template.message(m["role"], m["content"]),
            F.raise_error(F.lit("chat message without role or content")),
        ),
    )
    ending = (template.generation_prompt if add_generation_prompt else "") + template.eos
    return F.concat(F.array_join(shown, ""), F.lit(ending))
