"""Chat prompts as arrays of (role, content), and their rendering to one string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill import fixed_values as fixed
from tracemill.functions.text import fill


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def assistant_prompt(code: Column, answer: Column | None = None) -> Column:
    """System text, two worked examples, the code, and the answer to continue.

    A missing answer falls back to the code itself; an empty one stays empty.
    """
    final = code if answer is None else F.coalesce(answer, code)

    def user(text: Column) -> Column:
        return message("user", fill(fixed.ASSISTANT_USER, code=text))

    def reply(text: Column) -> Column:
        return message("assistant", fill(fixed.ASSISTANT_ANSWER, code=text))

    return F.array(
        message("system", F.lit(fixed.ASSISTANT_SYSTEM)),
        user(F.lit(fixed.EXAMPLE_ONE_CODE)),
        reply(F.lit(fixed.EXAMPLE_ONE_ANSWER)),
        user(F.lit(fixed.EXAMPLE_TWO_CODE)),
        reply(F.lit(fixed.EXAMPLE_TWO_ANSWER)),
        user(code),
        reply(final),
    )


def question_text(question: Column, starter: Column) -> Column:
    layout = F.when(
        F.coalesce(starter, F.lit("")) != "", fill(fixed.QUESTION_WITH_STARTER, starter=starter)
    ).otherwise(fixed.QUESTION_WITHOUT_STARTER)
    return F.concat(fill(fixed.QUESTION_HEAD, question=question), layout, F.lit(fixed.QUESTION_TAIL))


def generation_prompt(question: Column, starter: Column, code: Column | None = None) -> Column:
    """System text and question; with ``code``, also the turn to be continued."""
    turns = [
        message("system", F.lit(fixed.GENERATION_SYSTEM)),
        message("user", question_text(question, starter)),
    ]
    if code is not None:
        turns.append(message("assistant", fill(fixed.GENERATION_CONTINUED, code=code)))
    return F.array(*turns)


def blind_prompt(code: Column, continued: Column | None = None) -> Column:
    """Prompt that shows code but no question; ``continued`` adds the open turn."""
    turns = [
        message("system", F.lit(fixed.BLIND_SYSTEM)),
        message("user", fill(fixed.BLIND_USER, code=code)),
    ]
    if continued is not None:
        turns.append(message("assistant", fill(fixed.BLIND_CONTINUED, code=continued)))
    return F.array(*turns)


def change_summary(added: Column, removed: Column) -> Column:
    return fill(fixed.CHANGE_SUMMARY, added=added.cast("string"), removed=removed.cast("string"))


def acceptor_prompt(
    question: Column,
    starter: Column,
    code: Column,
    suggestion: Column,
    change: Column,
    reasoning: Column | None = None,
) -> Column:
    """Ask for thoughts on a suggestion; with ``reasoning``, also for the action.

    A missing suggestion is an error rather than an empty prompt.
    """
    shown = F.when(suggestion.isNull(), F.raise_error(F.lit("acceptor needs a suggestion"))).otherwise(suggestion)
    turns = [
        message("system", F.lit(fixed.ACCEPTOR_SYSTEM)),
        message("user", question_text(question, starter)),
        message("assistant", fill(fixed.ACCEPTOR_CODE, code=code)),
        message("user", fill(fixed.ACCEPTOR_VIEW, code=code, suggestion=shown, change=change)),
    ]
    if reasoning is not None:
        turns += [
            message("assistant", reasoning),
            message("user", F.lit(fixed.ACCEPTOR_FOLLOW_UP)),
            message("assistant", F.lit(fixed.ACCEPTOR_CONTINUED)),
        ]
    return F.array(*turns)


def render_chat(messages: Column, open_turn: str = "none") -> Column:
    """One string per chat.

    ``open_turn``: ``none`` closes every turn, ``continue`` leaves the last
    turn open, ``generate`` adds an empty assistant turn.
    """
    if open_turn not in ("none", "continue", "generate"):
        raise ValueError(f"unknown open_turn {open_turn!r}")
    turns = F.transform(
        messages,
        lambda m: F.concat(
            F.lit(fixed.CHAT_HEADER_OPEN),
            m["role"],
            F.lit(fixed.CHAT_HEADER_CLOSE),
            m["content"],
        ),
    )
    text = F.concat(F.lit(fixed.CHAT_BEGIN), F.array_join(turns, fixed.CHAT_END_OF_TURN))
    if open_turn == "continue":
        return text
    closed = F.concat(text, F.lit(fixed.CHAT_END_OF_TURN))
    if open_turn == "none":
        return closed
    opening = fixed.CHAT_HEADER_OPEN + "assistant" + fixed.CHAT_HEADER_CLOSE
    return F.concat(closed, F.lit(opening))
