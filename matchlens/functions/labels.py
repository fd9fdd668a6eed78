"""Python-side normalisation of caller arguments (one value, not data)."""

from __future__ import annotations

CLASS_WORDS = (("fresh", "Fr"), ("soph", "So"), ("junior", "Jr"), ("senior", "Sr"), ("grad", "Gr"))


def class_code(asked: str) -> str:
    """Class code of an argument such as 'freshman', 'Fr' or 'R-So'; empty when unknown."""
    text = (asked or "").strip().lower()
    for word, code in CLASS_WORDS:
        if word in text or text.split("-")[-1].split(" ")[-1] == code.lower():
            return f"R-{code}" if text.startswith(("r-", "redshirt")) and code != "Gr" else code
    return ""
