"""Readable text of raw e-mails: parts, transfer encodings, charsets, HTML. Lenient, linear, over the whole source.

Defined results: null and blank sources have no parts; a source whose first lines are no header is all body;
a multipart body without its header is recognised by a boundary line before a Content- header; cut-off
encodings are decoded as far as they go; unknown charsets are read as UTF-8, else as ISO-8859-1.
"""

from __future__ import annotations

import binascii
import html
import re
from typing import NamedTuple


class Part(NamedTuple):
    html: bool
    attached: bool
    alternative: int  # parts of one multipart/alternative share a number above 0
    text: str


HEADER = re.compile(r"(?i)(?:from|to|cc|bcc|subject|date|message-id|in-reply-to|references|received|reply-to|sender|return-path|delivered-to|mime-version|content-[a-z-]+|x-[\w-]+|list-[\w-]+)[ \t]*:")
FOLD = re.compile(r"\n[ \t]+")
TYPE = re.compile(r"(?im)^content-type[ \t]*:[ \t]*([^;\s]*)([^\n]*)")
ENCODING = re.compile(r"(?im)^content-transfer-encoding[ \t]*:[ \t]*([\w-]+)")
ATTACHED = re.compile(r"(?im)^content-disposition[ \t]*:[ \t]*attachment")
BOUNDARY = re.compile(r"(?i)boundary[ \t]*=[ \t]*(?:\"([^\"]*)\"|([^\s;]+))")
CHARSET = re.compile(r"(?i)charset[ \t]*=[ \t]*\"?([\w.:-]+)")
LOST = re.compile(r"(?im)^--([^\s-][^\n]*|-[^\n]*)\ncontent-[a-z-]+[ \t]*:")
NOT64 = re.compile(r"[^A-Za-z0-9+/]")


def _decoded(raw: bytes, charset: str) -> str:
    try:
        return raw.decode(charset)
    except (LookupError, UnicodeDecodeError):
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError as e:
            if e.start >= len(raw) - 3:  # a character cut off at the end
                return raw[: e.start].decode("utf-8")
            return raw.decode("latin-1")


def _undone(body: str, encoding: str, charset: str) -> str:
    if encoding == "base64":
        letters = NOT64.sub("", body)
        letters = letters[: len(letters) - (len(letters) % 4 == 1)]
        return _decoded(binascii.a2b_base64(letters + "=" * (-len(letters) % 4)), charset)
    if encoding == "quoted-printable":
        return _decoded(binascii.a2b_qp(body.encode("utf-8", "replace")), charset)
    return body


def _entity(source: str, alternative: int, out: list[Part], depth: int) -> None:
    if source.startswith("\n"):
        head, body = "", source[1:]
    else:
        head, _, body = source.partition("\n\n")
        first = head.split("\n", 1)[0]
        if not HEADER.match(first) and not (depth == 0 and TYPE.search(head) and not LOST.search(head)):
            head, body = "", source
    head = FOLD.sub(" ", head)
    found = TYPE.search(head)
    kind, rest = (found[1].lower(), found[2]) if found else ("text/plain", "")
    boundary = ""
    if kind.startswith("multipart/"):
        b = BOUNDARY.search(rest)
        boundary = (b[1] or b[2] or "") if b else ""
    if not boundary and (kind.startswith("multipart/") or (not head and depth == 0)):
        lost = LOST.search(body)
        boundary = lost[1].rstrip() if lost else ""
        if boundary and not kind.startswith("multipart/"):
            kind = "multipart/alternative" if boundary.startswith("=_") else "multipart/mixed"
    if boundary and depth < 20:
        pieces = ("\n" + body).split("\n--" + boundary)
        group = len(out) + 1 if kind == "multipart/alternative" else 0
        for piece in pieces[1:]:
            if piece.startswith("--"):
                break
            _entity(piece.partition("\n")[2], group or alternative, out, depth + 1)
        return
    if kind.startswith("text/"):
        c, e = CHARSET.search(rest), ENCODING.search(head)
        out.append(Part(kind == "text/html", bool(ATTACHED.search(head)), alternative, _undone(body, e[1].lower() if e else "", c[1].lower() if c else "utf-8")))


def parts(source: str | None) -> list[Part]:
    """The text parts of a mail, decoded."""
    if not source or source.isspace():
        return []
    out: list[Part] = []
    _entity(source.replace("\r\n", "\n").replace("\r", "\n"), 0, out, 0)
    return out


HIDDEN = re.compile(r"(?is)<!--.*?-->|<(style|script|head)\b.*?</\1\s*>")
BLOCK = re.compile(r"(?i)</?(?:p|div|li|ul|ol|tr|td|th|table|h[1-6]|blockquote|body|html|section|article|pre|dd|dt|dl|center|form)\b[^>]*>")
BREAK = re.compile(r"(?i)<br\b[^>]*>")
RULE = re.compile(r"(?i)<hr\b[^>]*>")
TAG = re.compile(r"</?[A-Za-z!][^>]*>")
QUOTE_TAG = re.compile(r"(?i)<(/?)blockquote\b[^>]*>")


def html_text(source: str) -> str:
    """Tags and entities resolved; blocks end a paragraph, inline tags leave no gap."""
    x = HIDDEN.sub(" ", source)
    x = RULE.sub("\n\n", BREAK.sub("\n", BLOCK.sub("\n\n", x)))
    return html.unescape(TAG.sub("", x))


def readable(source: str | None) -> list[str]:
    """Every text part as plain text."""
    return [html_text(p.text) if p.html else p.text for p in parts(source)]


ORIGINAL = re.compile(r"(?m)^[ \t>]*-{3,}[ \t]*[^\W\d_][^\n]{4,40}?-{3,}[ \t]*$")
SIGNATURE = re.compile(r"(?m)^-- ?$")
DISCLAIMER = re.compile(r"(?m)^[ \t]*_{5,}[ \t]*$")
QUOTED = re.compile(r"(?m)^[ \t]*>.*$")
ATTRIBUTION = re.compile(r"(?m)^[^\n>]{6,160}:[ \t]*\n(?:[ \t]*\n)*(?=[ \t]*(?:>|\x00))")
PARAGRAPH = re.compile(r"\n\s*\n")


def _unquoted(source: str) -> str:
    """HTML without its blockquotes, a mark in place of each."""
    out, depth, last = [], 0, 0
    for m in QUOTE_TAG.finditer(source):
        if not depth:
            out.append(source[last : m.start()])
        depth = max(0, depth + (-1 if m[1] else 1))
        if not depth:
            out.append("<p>\x00</p>")
        last = m.end()
    if not depth:
        out.append(source[last:])
    return "".join(out)


def _own(part: Part) -> str:
    if part.html:
        x = HIDDEN.sub(" ", part.text)
        rule = RULE.search(x)
        x = html_text(_unquoted(x[: rule.start()] if rule else x))
    else:
        x = part.text
    for cut in (ORIGINAL, SIGNATURE, DISCLAIMER):
        if m := cut.search(x):
            x = x[: m.start()]
    return QUOTED.sub("", ATTRIBUTION.sub("\n", x)).replace("\x00", "\n\n")


def own_paragraphs(source: str | None) -> list[str]:
    """The sender's own text as paragraphs: no headers, quotes, attachments, signature or disclaimer; of alternatives one, the plain one where it has text."""
    chosen: list[Part] = []
    for p in parts(source):
        if p.attached:
            continue
        if p.alternative and chosen and chosen[-1].alternative == p.alternative:
            if chosen[-1].text.strip() and not (chosen[-1].html and not p.html and p.text.strip()):
                continue
            chosen.pop()
        chosen.append(p)
    return [x for p in chosen for x in (y.strip() for y in PARAGRAPH.split(_own(p))) if x]
