"""Markdown as structured plain text with its table of contents."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})\s*(.*?)\s*$")
_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_BREAK = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ITEM = re.compile(r"^([ \t]*)([-*+]|\d{1,9}[.)])(?:[ \t]+(.*)|$)")
_TASK = re.compile(r"^\[([ xX])\][ \t]+(.*)$")
_RULE = re.compile(r"^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$")
_HTML = re.compile(r"^ {0,3}</?[A-Za-z!][^>]*>?")
_NOTE = re.compile(r"^ {0,3}\[\^[^\]]+\]:")
_INLINE = re.compile(
    r"(?P<code>(?P<tick>`+)(?P<in>.+?)(?P=tick))|!\[(?P<alt>[^\]]*)\]\([^)]*\)|\[\^[^\]]+\]|\[(?P<text>[^\]]*)\]\([^)]*\)|<(?P<auto>https?://[^>\s]+)>|(?P<html></?[A-Za-z][^>]*>)",
    re.S,
)
_EMPHASIS = (re.compile(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1", re.S), re.compile(r"(?<![\w*])([*_])(?=[^\s*_])(.+?)(?<=[^\s*_])\1(?![\w*])", re.S), re.compile(r"(~~)(?=\S)(.+?)(?<=\S)\1", re.S))


def inline(text: str) -> str:
    """Text without markup; soft breaks are blanks, images keep their description."""
    held: list[str] = []

    def keep(value: str) -> str:
        held.append(value)
        return f"\x00{len(held) - 1}\x00"

    def one(m: re.Match[str]) -> str:
        if m["code"]:
            return keep(m["in"].strip() if m["in"].strip() else m["in"])
        if m["alt"] is not None:
            return keep(f"[图: {inline(m['alt'])}]" if m["alt"] else "[图]")
        if m["text"] is not None:
            return inline(m["text"])
        return keep(m["auto"]) if m["auto"] else ""

    text = _INLINE.sub(one, text)
    for pattern in _EMPHASIS:
        text = pattern.sub(lambda m: m[2], text)
    text = re.sub(r"(?: {2,}|\\)\n", "\x01", text)
    text = re.sub(r"[ \t]*\n[ \t]*", " ", text).replace("\x01", "\n")
    return re.sub("\x00(\\d+)\x00", lambda m: held[int(m[1])], text)


class _Reader:
    """Walks the blocks of a document once."""

    def __init__(self) -> None:
        self.toc: list[tuple[int, str, str]] = []
        self.path: list[str] = []

    def heading(self, level: int, text: str) -> str:
        del self.path[level - 1 :]
        self.path.append(text)
        self.toc.append((level, text, " > ".join(self.path)))
        return f"{'#' * level} {text}"

    def blocks(self, lines: list[str]) -> list[str]:
        out: list[str] = []
        k = 0
        while k < len(lines):
            line = lines[k]
            if not line.strip():
                k += 1
            elif m := _FENCE.match(line):
                end = next((j for j in range(k + 1, len(lines)) if lines[j].strip().startswith(m[1]) and not lines[j].strip().strip(m[1][0])), len(lines))
                out.append(f"[代码块{' ' + m[2] if m[2] else ''}]\n" + "\n".join(lines[k + 1 : end]).rstrip("\n") + "\n[/代码块]")
                k = end + 1
            elif m := _HEADING.match(line):
                out.append(self.heading(len(m[1]), inline(m[2] or "")))
                k += 1
            elif _BREAK.match(line):
                out.append("---")
                k += 1
            elif line.lstrip().startswith(">"):
                end = next((j for j in range(k, len(lines)) if not lines[j].strip()), len(lines))
                inner = self.blocks([re.sub(r"^\s*> ?", "", x) for x in lines[k:end]])
                out += [f"> {x}" for x in "\n".join(inner).split("\n") if x.strip()]
                k = end
            elif _ITEM.match(line):
                end = self._list_end(lines, k)
                out += self.items(lines[k:end], 0)
                k = end
            elif k + 1 < len(lines) and "|" in line and _RULE.match(lines[k + 1]) and "-" in lines[k + 1]:
                end = next((j for j in range(k + 2, len(lines)) if "|" not in lines[j]), len(lines))
                rows = [self._cells(x) for x in [line, *lines[k + 2 : end]]]
                head = "| " + " | ".join(rows[0]) + " |"
                out.append("\n".join([head, "|" + " --- |" * len(rows[0]), *["| " + " | ".join((r + [""] * len(rows[0]))[: len(rows[0])]) + " |" for r in rows[1:]]]))
                k = end
            elif line.startswith("    ") or line.startswith("\t"):
                end = next((j for j in range(k, len(lines)) if lines[j].strip() and not lines[j].startswith(("    ", "\t"))), len(lines))
                out.append("[代码块]\n" + "\n".join(re.sub(r"^(?: {4}|\t)", "", x) for x in lines[k:end]).rstrip("\n") + "\n[/代码块]")
                k = end
            elif _HTML.match(line) or _NOTE.match(line):
                k = next((j for j in range(k, len(lines)) if not lines[j].strip()), len(lines))
            else:
                end = k + 1
                while end < len(lines) and lines[end].strip() and not self._starts(lines[end]):
                    if re.match(r"^ {0,3}(=+|-+)\s*$", lines[end]):
                        break
                    end += 1
                text = inline("\n".join(x.lstrip() for x in lines[k:end]).rstrip())
                if end < len(lines) and (m := re.match(r"^ {0,3}(=+|-+)\s*$", lines[end])):
                    out.append(self.heading(1 if m[1][0] == "=" else 2, text))
                    end += 1
                elif text.strip():
                    out.append(text)
                k = end
        return out

    @staticmethod
    def _starts(line: str) -> bool:
        return bool(_FENCE.match(line) or _HEADING.match(line) or line.lstrip().startswith(">") or _ITEM.match(line) or (_BREAK.match(line) and "-" not in line))

    @staticmethod
    def _list_end(lines: list[str], k: int) -> int:
        end, first = k + 1, _ITEM.match(lines[k])
        while end < len(lines):
            own = _ITEM.match(lines[end])
            if own and len(own[1]) <= len(first[1]) and own[2][-1] != first[2][-1]:  # another mark begins another list
                return end
            if not lines[end].strip():
                after = next((j for j in range(end, len(lines)) if lines[j].strip()), len(lines))
                if after == len(lines) or not (lines[after].startswith((" ", "\t")) or _ITEM.match(lines[after])):
                    return end
                end = after
                continue
            elif not _ITEM.match(lines[end]) and not lines[end].startswith((" ", "\t")) and (_HEADING.match(lines[end]) or _FENCE.match(lines[end]) or _BREAK.match(lines[end])):
                return end
            end += 1
        return end

    @staticmethod
    def _cells(line: str) -> list[str]:
        line = line.strip().removeprefix("|")
        parts = re.split(r"(?<!\\)\|", line)
        if parts and not parts[-1].strip():
            parts = parts[:-1]
        return [inline(c.strip().replace("\\|", "|")).replace("|", "\\|").replace("\n", " ") for c in parts]

    def items(self, lines: list[str], depth: int) -> list[str]:
        """Lines of a list; deeper lists stand below their item."""
        out: list[str] = []
        width = lambda x: len(x[: len(x) - len(x.lstrip())].expandtabs(4))
        base, count, k = width(lines[0]), 0, 0
        while k < len(lines):
            m = _ITEM.match(lines[k])
            if not m or width(lines[k]) > base + 1:
                k += 1
                continue
            end = next((j for j in range(k + 1, len(lines)) if _ITEM.match(lines[j]) and width(lines[j]) <= base + 1), len(lines))
            body = lines[k + 1 : end]
            nested = next((j for j, x in enumerate(body) if _ITEM.match(x)), len(body))
            text, count = m[3] or "", count + 1
            mark = f"{count}." if m[2][0].isdigit() else "•"
            if t := _TASK.match(text):
                mark, text = ("☐" if t[1] == " " else "☑"), t[2]
            own = inline("\n".join([text, *[x.strip() for x in body[:nested] if x.strip()]])).strip()
            out.append(f"{'    ' * depth}{mark} {own}")
            if nested < len(body):
                out += self.items(body[nested:], depth + 1)
            k = end
        return out


def parse_markdown(text: str) -> tuple[str, list[tuple[int, str, str]]]:
    """(plain text, [(level, text, path)])."""
    reader = _Reader()
    blocks = reader.blocks(text.replace("\r\n", "\n").split("\n"))
    return "\n\n".join(blocks), reader.toc


_HEADINGS = T.ArrayType(T.StructType([T.StructField("level", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("path", T.StringType())]))
_PARSED = T.StructType([T.StructField("text", T.StringType()), T.StructField("toc", _HEADINGS)])


@F.pandas_udf(_PARSED)
def markdown(texts: pd.Series) -> pd.DataFrame:
    parsed = [parse_markdown(t or "") for t in texts]
    return pd.DataFrame({"text": [p[0] for p in parsed], "toc": [[{"level": a, "text": b, "path": c} for a, b, c in p[1]] for p in parsed]})
