"""Plain words of a text: markup, layout, case, punctuation and look-alike characters removed."""

from __future__ import annotations

import html
import re
import unicodedata

from lamina.llm.people import LOOKALIKE_FROM, LOOKALIKE_TO

_BLOCK_TAG = re.compile(r"<\s*/?\s*(?:p|br|div|li|ul|ol|tr|td|th|table|h[1-6]|hr|pre|blockquote)\b[^<>]*>", re.I)
#: a tag is a name with attributes of any length; a sign in a sentence ("< 5 and > 3") is none
_TAG = re.compile(r"""<\s*/?\s*[a-zA-Z][\w:.-]*(?:\s+[^\s<>="'/]+(?:\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>]+))?)*\s*/?\s*>|<!--.*?-->""", re.S)
_BREAK = re.compile(r"-[ \t]*\r?\n[ \t]*")
#: invisible characters: soft hyphen, zero-width and direction marks, byte order mark, variation selectors (fixed values)
_INVISIBLE = {0x00AD, 0x034F, 0x061C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF}
_SAME = dict(zip(map(ord, LOOKALIKE_FROM), LOOKALIKE_TO.lower(), strict=True)) | {ord("ѵ"): "v", ord("ԁ"): "d", ord("ɡ"): "g", ord("ı"): "i", ord("ℓ"): "l", ord("ո"): "n", ord("ν"): "v", ord("ɑ"): "a", ord("һ"): "h", ord("ԛ"): "q", ord("ԝ"): "w", ord("ɩ"): "i", ord("ʟ"): "l", ord("œ"): "oe", ord("æ"): "ae", ord("’"): "'", ord("‘"): "'", ord("‐"): "-", ord("‑"): "-"}
_FOLD = _SAME | dict.fromkeys(_INVISIBLE)
_KEEP = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256))


def fold(text: str) -> str:
    """ASCII lower case where possible; invisible characters dropped, look-alikes and accents replaced."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.translate(_FOLD)).translate(_FOLD)
        if not text.isascii():
            text = "".join(c for c in text if not unicodedata.combining(c))
    return text.lower()


def strip_markup(text: str, joined: bool = True) -> str:
    """Without tags and entities; words broken at a line end are joined if asked for."""
    if "<" in text:
        text = _TAG.sub("", _BLOCK_TAG.sub(" ", text))
    if "&" in text:
        text = html.unescape(text)
    if joined and "-" in text and "\n" in text:
        text = _BREAK.sub("", text)
    return text


def plain_words(text: str | None) -> list[bytes]:
    """Words of letters and digits; hyphens and apostrophes join. Null gives no words."""
    if not text:
        return []
    low = fold(strip_markup(text))
    return low.encode("ascii", "replace").translate(_KEEP, b"-'").split()

