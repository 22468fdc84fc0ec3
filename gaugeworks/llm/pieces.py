"""Texts cut at blanks that no word of a byte-level pattern reaches across.

The patterns of byte-level vocabularies keep a blank with what follows it, and look past a word only
at runs of white space. So a blank between two characters that are not white space starts a new word,
and what lies between two such blanks can be coded alone.
"""

from __future__ import annotations

import sys

_SPACES = tuple(chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace() and c != 32)


def regular(text: str) -> bool:
    """True if every blank stands between two characters that are not white space."""
    if text[0] == " " or text[-1] == " " or "  " in text:
        return False
    if text.isprintable():  # no white space but blanks
        return True
    return not any(c in text and (" " + c in text or c + " " in text) for c in _SPACES)
