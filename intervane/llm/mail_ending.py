"""How one stored message ends: a small per-row helper of the truncation operator."""

from __future__ import annotations

import base64
import binascii
import quopri
import re

_BOUNDARY = re.compile(r'boundary="?([^"\s;]+)', re.IGNORECASE)
_HEADER = re.compile(r"[\w-]+:")
_BASE64 = re.compile(r"[A-Za-z0-9+/\s]*={0,2}\s*")
_TAG = re.compile(r"<[^<>\n]{0,200}>")

CLOSED, BROKEN, TEXT, EMPTY = "closed", "broken", "text", "empty"


def message_ending(text: str | None) -> tuple[str, str]:
    """``(state, line)`` of the end of a message.

    ``closed``: the message shows its own end (closing boundary, end of the
    HTML document, a quotation its author shortened). ``broken``: the encoding
    or structure is cut in the middle (headers without a body, half a boundary,
    a base64 or quoted-printable unit, or a character, that lacks a part). ``text``: plain
    words end it; ``line`` is then the decoded last line and the caller decides.
    ``empty``: null or blank text.
    """
    if text is None or not text.strip():
        return EMPTY, ""
    text = text.replace("\r\n", "\n")
    stripped = text.rstrip()
    last = stripped[stripped.rfind("\n") + 1 :]
    if stripped.endswith("\ufffd"):
        return BROKEN, last
    head, blank, body = text.partition("\n\n")
    if not blank:
        return (BROKEN if _HEADER.match(text) else TEXT), last
    part, headers = body, head
    for mark in dict.fromkeys(_BOUNDARY.findall(text)):
        fence = f"--{mark}"
        if last == f"{fence}--":
            return CLOSED, last
        if len(last) > 4 and f"{fence}--".startswith(last):
            return BROKEN, last
        at = body.rfind(f"{fence}\n")
        if at >= 0 and f"{fence}--" not in body[at:]:
            inner_head, inner_blank, inner = body[at + len(fence) + 1 :].partition("\n\n")
            if not inner_blank:
                return BROKEN, last
            if len(inner) < len(part):
                part, headers = inner, inner_head
    headers = headers.lower()
    if "base64" in headers and _BASE64.fullmatch(part):
        packed = "".join(part.split())
        if len(packed) % 4:
            return BROKEN, last
        if "text/" not in headers and part is not body:
            widths = [len(x) for x in part.split()]
            full = len(widths) > 1 and widths[-1] == widths[0] and not packed.endswith("=")
            return (BROKEN if full or not packed else TEXT), last
        try:
            part = base64.b64decode(packed).decode("utf-8")
        except (binascii.Error, UnicodeDecodeError):
            return BROKEN, last
    elif "quoted-printable" in headers:
        if re.search(r"=[0-9A-Fa-f]?$", stripped):
            return BROKEN, last
        part = quopri.decodestring(part.encode()).decode("utf-8", "replace")
        if part.rstrip().endswith("\ufffd"):
            return BROKEN, last
    part = part.rstrip()
    if part.endswith(("</html>", "</HTML>")) or part.endswith("[...]"):
        return CLOSED, last
    if re.search(r"<[^<>\n]{0,200}$", part) and "<html" in part.lower():
        return BROKEN, last
    line = part[part.rfind("\n") + 1 :]
    plain = _TAG.sub("", line).replace("&gt;", ">").replace("&lt;", "<").replace("&amp;", "&")
    return (CLOSED if plain.rstrip().endswith("[...]") else TEXT), plain
