"""The parts of archived mails, with their places in the stored text."""

from __future__ import annotations

import re

# Names of header lines; X- names count too.
_HEADER = re.compile(
    r"(?i)(?:from|to|cc|bcc|reply-to|sender|subject|date|message-id|in-reply-to|references|received|return-path|"
    r"mime-version|content-[a-z-]+|delivered-to|list-[a-z-]+|user-agent|importance|priority|x-[a-z0-9-]+):"
)
_LINE = re.compile(r"[^\n]*(?:\n|\Z)")
_BOUNDARY = re.compile(r"(?i)\bboundary\s*=\s*(?:\"([^\"]*)\"|([^\s;]+))")
_DELIMITER = re.compile(r"(?m)^--(\S[^\n]*?)[ \t]*\r?$(?=\n(?i:content-[a-z-]+:))")
_BLANK_LINE = re.compile(r"\n[ \t]*\r?(?=\n)")


def header_end(text: str, at: int = 0, end: int | None = None) -> int:
    """Where the body begins: after the blank line that ends the header lines at `at`; `at` where there are none."""
    end = len(text) if end is None else end
    if not _HEADER.match(text, at, end):
        return at
    m = _BLANK_LINE.search(text, at, end)
    if m is None:
        stop = text.find("\n\n", at, end)
        return end if stop < 0 else stop + 2
    return m.end() + 1


def parts(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, encoding, start, end) of every leaf part, in lower case; text/plain and '' where nothing is said.

    A mail whose multipart header is lost is divided at the delimiter lines that part headers follow.
    """
    body = header_end(text)
    head = text[:body].lower()
    m = _BOUNDARY.search(text, 0, body)
    mark = (m[1] if m[1] is not None else m[2]) if m else None
    if mark is None and "multipart/" not in head and (d := _DELIMITER.search(text, body)):
        mark = d[1]
    if mark is None:
        return [(*_kind(head), body, len(text))]
    out = []
    start = None
    lines = re.compile(rf"(?m)^--{re.escape(mark)}(--)?[ \t]*\r?$")
    for d in lines.finditer(text, body):
        if start is not None:
            out += _leaf(text, start, d.start())
        start = None if d[1] else d.end() + 1
    if start is not None:
        out += _leaf(text, start, len(text))
    if not out and mark and not any(True for _ in lines.finditer(text, body)):
        out = [("text/plain", "", body, len(text))]
    return out


def _leaf(text: str, start: int, end: int) -> list[tuple[str, str, int, int]]:
    if start >= end:
        return []
    if text[start] == "\n" or text.startswith("\r\n", start):
        return [("text/plain", "", start, end)]
    body = header_end(text, start, end)
    head = text[start:body]
    if m := _BOUNDARY.search(head):
        inner = parts(text[start:end])
        return [(k, e, a + start, b + start) for k, e, a, b in inner] if (m[1] or m[2]) else []
    return [(*_kind(head.lower()), body, end)]


_TYPE = re.compile(r"(?m)^content-type:\s*([^\s;]+)")
_CODING = re.compile(r"(?m)^content-transfer-encoding:\s*([^\s;]+)")


def _kind(head: str) -> tuple[str, str]:
    t, c = _TYPE.search(head), _CODING.search(head)
    return (t[1].strip('"') if t else "text/plain"), (c[1].strip('"') if c else "")


def _attribution(line: str) -> bool:
    """Whether a line announces a quotation: it ends with a colon and holds a date or an address."""
    line = line.rstrip()
    return line[-1:] in (":", "：") and re.search("[0-9@<]", line) is not None


def own_blocks(text: str) -> list[tuple[int, int]]:
    """(start, end) of the runs of lines that are the sender's own prose; a blank or omitted line ends a run."""
    out = []
    for kind, coding, at, end in parts(text):
        if kind != "text/plain" or coding in ("quoted-printable", "base64"):
            continue
        run = before = None  # start of the run; start of the line before if it may be an attribution
        while at < end:
            m = _LINE.match(text, at, end)
            stop = m.end()
            first = text[at]
            if first == ">":
                if run is not None:
                    cut = before if before is not None and _attribution(text[before:at]) else at
                    if cut > run:
                        out.append((run, cut))
                    run = None
                before = None
            elif first == "-" and (text.startswith("-----Original Message-----", at) or text[at:stop].rstrip("\r\n") == "-- "):
                break
            elif m[0].isspace() or not m[0]:
                if run is not None:
                    out.append((run, at))
                run = before = None
            else:
                if run is None:
                    run = at
                before = at
            if stop == at:
                break
            at = stop
        if run is not None:
            out.append((run, min(at, end)))
    return out
