"""Runs: pieces of a paragraph with one style, and the paragraph, table and image blocks that hold them."""

from __future__ import annotations

import re
from typing import Any

Block = dict[str, Any]
#: Fields of a run and their plain values.
PLAIN = {"text": "", "bold": False, "italic": False, "underline": False, "strike": False, "script": "", "colour": "", "highlight": "", "size": 0.0, "font": "", "href": ""}
RUNS = "array<struct<text:string,bold:boolean,italic:boolean,underline:boolean,strike:boolean,script:string,colour:string,highlight:string,size:double,font:string,href:string>>"


def run(text: str, **style: Any) -> dict[str, Any]:
    return PLAIN | {"text": text} | style


def merged(runs: list[dict]) -> list[dict]:
    """Neighbours of one style as one run; empty ones go."""
    out: list[dict] = []
    for r in runs:
        if not r["text"]:
            continue
        if out and all(out[-1][k] == r[k] for k in PLAIN if k != "text"):
            out[-1] = out[-1] | {"text": out[-1]["text"] + r["text"]}
        else:
            out.append(r)
    return out


def block(kind: str = "paragraph", text: str = "", heading: int = 0, list_kind: str = "none", level: int = 0, cells: list | None = None, runs: list[dict] | None = None, align: str = "left", image: bytes = b"") -> Block:
    """A block; a paragraph's text is that of its runs. Runs without style are not kept."""
    runs = merged(runs or [])
    if runs:
        text = "".join(r["text"] for r in runs)
        if all(r == run(r["text"]) for r in runs):
            runs = []
    return {"kind": kind, "text": text, "heading": heading, "list_kind": list_kind, "level": level, "cells": cells or [], "runs": runs, "align": align, "image": image}


def runs_of(b: Block) -> list[dict]:
    return b.get("runs") or ([run(b["text"])] if b["text"] else [])


def picture_kind(data: bytes) -> str:
    """By the first bytes; png where they say nothing."""
    return "jpeg" if data[:2] == b"\xff\xd8" else "gif" if data[:4] == b"GIF8" else "bmp" if data[:2] == b"BM" else "png"


_INLINE = re.compile(r"\[(?P<label>[^\]]+)\]\((?P<href>[^)\s]+)\)|\*\*(?P<b1>[^*]+)\*\*|__(?P<b2>[^_]+)__|(?<![\w*])\*(?P<i1>[^*\n]+)\*(?![\w*])|(?<![\w_])_(?P<i2>[^_\n]+)_(?![\w_])|~~(?P<s>[^~]+)~~|`(?P<code>[^`]+)`")


def markdown_runs(text: str) -> list[dict]:
    """Links, strong, emphasis, strike and code of one level; a link needs a target."""
    out, at = [], 0
    for m in _INLINE.finditer(text):
        out.append(run(text[at : m.start()]))
        kind = m.lastgroup
        inner = m["label"] if kind == "href" else m[kind]
        style = {"href": {"href": m["href"]}, "b1": {"bold": True}, "b2": {"bold": True}, "i1": {"italic": True}, "i2": {"italic": True}, "s": {"strike": True}, "code": {"font": "Consolas"}}[kind]
        out.append(run(inner, **style))
        at = m.end()
    return merged([*out, run(text[at:])])
