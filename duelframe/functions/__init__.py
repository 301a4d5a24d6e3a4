"""Column expressions; none of them shuffles or leaves the JVM."""

from duelframe.functions.chat import (
    ROLE_LINES,
    ChatTemplate,
    message,
    messages,
    render_chat,
)
from duelframe.functions.naming import level_text, run_key
from duelframe.functions.pairs import chosen_text, post_text, rejected_text
from duelframe.functions.scores import activate, as_score, full_text
from duelframe.functions.tokens import (
    EOS_ID,
    EOS_TEXT,
    PAD_ID,
    PAD_TEXT,
    UNK_ID,
    UNK_TEXT,
    attention_mask,
    cut,
    ngrams,
    normalised,
    truncate_pad,
    words,
)

__all__ = [
    "EOS_ID",
    "EOS_TEXT",
    "PAD_ID",
    "PAD_TEXT",
    "ROLE_LINES",
    "UNK_ID",
    "UNK_TEXT",
    "ChatTemplate",
    "activate",
    "as_score",
    "attention_mask",
    "chosen_text",
    "cut",
    "full_text",
    "level_text",
    "message",
    "messages",
    "ngrams",
    "normalised",
    "post_text",
    "rejected_text",
    "render_chat",
    "run_key",
    "truncate_pad",
    "words",
]
