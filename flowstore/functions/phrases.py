"""The grammar of a search phrase: `space:path/to:page:2 :llm say it shortly`."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Phrase:
    """What is sought: the words; the category path if they are one (names joined by `/`); the page from 1;
    the instruction to a language model, which a search ignores.
    """

    text: str
    path: str | None = None
    page: int = 1
    instruction: str = ""


def _split_mark(text: str, word: str) -> tuple[str, str] | None:
    """Text before and after the first `: word` that stands after some text and ends at a word's end; case does not matter."""
    low, at = text.lower(), 1
    while (at := low.find(":", at)) > 0:
        rest = low[at + 1 :].lstrip()
        if rest.startswith(word) and not (rest[len(word) :][:1].isalnum() or rest[len(word) :][:1] == "_"):
            after = len(text) - len(rest) + len(word)
            return text[:at].rstrip(), text[after:].strip()
        at += 1
    return None


def parse_phrase(text: str, space: str = "") -> Phrase:
    """The parts of a phrase. Quotes and blanks around it do not count, nor does the name of the space before a `:`.

    The page is the number at the end after `:page:` or `/page/`, in any mixture; without a
    number from 1 on it is part of the words. Words with `/`, `\\` or `:` between two names or more
    are a path.
    """
    rest, instruction, page = text.strip().strip("\"'`").strip(), "", 1
    if found := _split_mark(rest, "llm"):
        rest, instruction = found
    parts = rest.replace("/", ":").rsplit(":", 2)
    if len(parts) == 3 and parts[0].strip() and parts[1].strip().lower() == "page" and parts[2].strip().isdecimal() and int(parts[2]) > 0:
        page, rest = int(parts[2]), rest[: len(parts[0])].rstrip()
    head, mark, tail = rest.partition(":")
    if space and head.strip().lower() == space.lower():
        rest = tail.strip() if mark else ""
    names = [n.strip() for n in rest.replace(":", "/").replace("\\", "/").split("/") if n.strip()]
    return Phrase(rest, "/".join(names) if len(names) > 1 else None, page, instruction)
