"""Words of LaTeX sources, for the operators that read texts inside tasks."""

from __future__ import annotations

import re
import unicodedata

#: Commands whose braces hold keys or file names, not words. Fixed value: LaTeX's own command names.
KEYED = re.compile(
    r"\\(?:[a-z]*cite[a-z]*|[a-z]*ref|label|bibitem|input|include|includegraphics|includeonly|subfile|import|graphicspath"
    r"|bibliography|bibliographystyle|addbibresource|usepackage|documentclass|begin|end|url|path|hypertarget|hyperlink)\*?"
    r"[ \t]*(?:\[[^\]]*\][ \t]*)*\{[^{}]*\}",
    re.IGNORECASE,
)
_JOINED = re.compile(r"\\[-/@'\"`^~=.]|\{\}")
_COMMAND = re.compile(r"\\(?:[a-zA-Z]+\*?|.)", re.DOTALL)
_BETWEEN = re.compile(r"\}\s*\{")
_WORD = re.compile(r"[^\W_]+")


_FOLDS: dict[int, str] = {}


def folding(text: str) -> dict[int, str]:
    """A translation of the text's characters beyond ASCII to their bases without accents."""
    for c in set(text):
        if c > "\x7f" and ord(c) not in _FOLDS:
            _FOLDS[ord(c)] = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
    return _FOLDS


def plain(text: str) -> str:
    """The text in lower case without command names, braces and keys; a word that markup cuts is whole again."""
    if "\\" in text:
        text = KEYED.sub(" ", text)
        text = _JOINED.sub("", text)
        text = _COMMAND.sub(" ", text)
    if "{" in text or "}" in text:
        text = _BETWEEN.sub(" ", text).replace("{", "").replace("}", "")
    text = text.lower()
    return text if text.isascii() else text.translate(folding(text))


def words(text: str) -> list[str]:
    """Runs of letters or digits, without case and accents; words in comments and definitions are words."""
    return _WORD.findall(plain(text))
