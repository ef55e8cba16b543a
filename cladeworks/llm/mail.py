"""The text of a raw mail as a reader sees it."""

from __future__ import annotations

import binascii
import html
import re

_fold = re.compile(r"\n[ \t]+")
_header = re.compile(r"[!-9;-~]+[ \t]*:")
_type = re.compile(r"^content-type[ \t]*:[ \t]*([^\n;]*)", re.I | re.M)
_boundary = re.compile(r'boundary[ \t]*=[ \t]*(?:"([^"\n]*)"|([^\s;"]+))', re.I)
_charset = re.compile(r'charset[ \t]*=[ \t]*"?([\w.:-]+)', re.I)
_encoding = re.compile(r"^content-transfer-encoding[ \t]*:[ \t]*\"?([\w-]+)", re.I | re.M)
_word = re.compile(r"=\?([^?\s]+)\?([bBqQ])\?([^?]*)\?=(?:\s+(?==\?))?")
_not_base64 = re.compile(r"[^A-Za-z0-9+/]+")
_block_tag = re.compile(r"<(?:!--.*?--|/?(?:p|br|div|td|tr|th|table|li|ul|ol|h[1-6]|html|body|head|hr|blockquote|pre)\b[^>]*)>", re.I | re.S)
_style = re.compile(r"<(style|script)\b.*?</\1\s*>", re.I | re.S)
_tag = re.compile(r"</?[a-z][^<>]*>", re.I)


def _decode(data: bytes, charset: str) -> str:
    for name in (charset, "utf-8"):
        try:
            return data.decode(name)
        except (LookupError, UnicodeDecodeError, ValueError):
            pass
    return data.decode("latin-1")


def _base64(text: str) -> bytes:
    clean = _not_base64.sub("", text.partition("=\n\n")[0] if "=\n\n" in text else text)
    if len(clean) % 4 == 1:
        clean = clean[:-1]
    return binascii.a2b_base64(clean + "=" * (-len(clean) % 4))


def _encoded_word(m: re.Match) -> str:
    charset, how, data = m.groups()
    try:
        raw = _base64(data) if how in "bB" else binascii.a2b_qp(data.encode("utf-8", "replace"), header=True)
    except binascii.Error:
        return m.group()
    return _decode(raw, charset.partition("*")[0])


def _part(text: str, outer: bool, out: list[str]) -> list[tuple[str, bool]]:
    """Append the visible segments of one entity (headers, blank line, body); the entities inside it, if any."""
    if text.startswith("\n"):
        head, body = "", text[1:]
    else:
        head, _, body = text.partition("\n\n")
        if outer and not _header.match(head) and not head.startswith("From "):
            head, body = "", text
    head = _fold.sub(" ", head)
    if outer and head:
        out.append(_word.sub(_encoded_word, head) if "=?" in head else head)
    kind = m.group(1).strip().lower() if (m := _type.search(head)) else "text/plain"
    if kind.startswith("multipart/") and (m := _boundary.search(head)):
        line = "--" + (m.group(1) or m.group(2) or "").strip()
        pieces = re.split(rf"(?:^|\n){re.escape(line)}(--)?[ \t]*(?=\n|$)", body)
        # [preamble, end mark, part, end mark, part, ...]
        if len(pieces) > 1:
            inside = []
            for ended, piece in zip(pieces[1::2], pieces[2::2]):
                if ended:
                    break
                inside.append((piece[1:] if piece.startswith("\n") else piece, False))
            return inside
    elif not (kind.startswith("text/") or "/" not in kind):
        return [(body, True)] if kind == "message/rfc822" else []
    how = m.group(1).lower() if (m := _encoding.search(head)) else ""
    if how in ("base64", "quoted-printable"):
        charset = m.group(1) if (m := _charset.search(head)) else "utf-8"
        try:
            raw = _base64(body) if how == "base64" else binascii.a2b_qp(body.encode("utf-8", "replace"))
            body = _decode(raw, charset)
        except binascii.Error:
            pass
    if kind == "text/html":
        body = html.unescape(_tag.sub("", _block_tag.sub("\n", _style.sub("\n", body))))
    out.append(body)
    return []


def visible_segments(raw: str | None) -> list[str]:
    """Unfolded headers, then every text part with its transfer encoding undone; other parts are not text.

    Null and empty mails have no segments. A mail without headers is all body; a part cut short or wrongly
    encoded gives what can be decoded, or stands as it is.
    """
    if not raw:
        return []
    text = raw.replace("\r\n", "\n").replace("\r", "\n") if "\r" in raw else raw
    out: list[str] = []
    # a stack, not recursion: parts may be nested to any depth
    left = [(text, True)]
    while left:
        left += reversed(_part(*left.pop(), out))
    return out
