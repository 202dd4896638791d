"""A chat template that can be read back, one turn after the other.

``<s>`` opens a conversation; a turn is ``[SYS]text[/SYS]``, ``[INST]text[/INST]``,
``[OUT]text</s>`` or, for any other role, ``[TURN]role[TEXT]text[/TURN]``. A control string
inside a text or role gets one more backslash behind its bracket, so that no control string is
left there and taking one backslash away gives the text again.
"""

from __future__ import annotations

import re

BEGIN = "<s>"
OPEN = {"system": "[SYS]", "user": "[INST]", "assistant": "[OUT]"}
CLOSE = {"system": "[/SYS]", "user": "[/INST]", "assistant": "</s>"}
ROLES = {v: k for k, v in OPEN.items()}
NAMES = r"(/?(?:s>|(?:SYS|INST|OUT|TURN|TEXT)\]))"
CONTROL = re.compile(r"([<\[])(\\*)" + NAMES)
ESCAPED = re.compile(r"([<\[])\\(\\*)" + NAMES)
TURN = re.compile(r"(\[SYS\]|\[INST\]|\[OUT\])(.*?)(\[/SYS\]|\[/INST\]|</s>)|\[TURN\](.*?)\[TEXT\](.*?)\[/TURN\]", re.DOTALL)


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def render(role: str | None, text: str | None) -> tuple[str, int, int]:
    """The marked turn, and the bounds of the escaped text in it. Null role and text are empty."""
    role, body = role or "", escape(text or "")
    if role in OPEN:
        head, tail = OPEN[role], CLOSE[role]
    else:
        head, tail = f"[TURN]{escape(role)}[TEXT]", "[/TURN]"
    return head + body + tail, len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn; anything else between turns is an error."""
    at = len(BEGIN) if formatted.startswith(BEGIN) else 0
    turns = []
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        role, text = (ROLES[m[1]], m[2]) if m[1] else (unescape(m[4]), m[5])
        turns.append((role, unescape(text)))
        at = m.end()
    return turns
