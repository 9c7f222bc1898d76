"""Message content: from JSON to searchable text and blocks, and from blocks to readable text.

Blocks nest without a bound, which no Spark schema can express, so both directions are plain functions over
parsed JSON; the readers call them inside one Arrow pass.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from .batches import pieces


def text_at(value: Any, key: str) -> str | None:
    """A string under this key; anything else is missing."""
    found = value.get(key) if isinstance(value, dict) else None
    return found if isinstance(found, str) else None


def string_leaves(value: Any) -> list[str]:
    """All strings in a JSON value, objects in the order of their sorted keys; numbers and booleans don't count."""
    out, stack = [], [value]
    while stack:
        v = stack.pop()
        if isinstance(v, str):
            out.append(v)
        elif isinstance(v, list):
            stack += reversed(v)
        elif isinstance(v, dict):
            stack += [v[k] for k in sorted(v, reverse=True)]
    return out


def _block(item: Any) -> tuple[str, dict] | None:
    kind = text_at(item, "type")
    if kind == "text":
        t = text_at(item, "text") or ""
        return t, {"kind": kind, "text": t}
    if kind == "thinking":
        return "", {"kind": kind, "text": text_at(item, "thinking" if "thinking" in item else "text") or ""}
    if kind == "tool_use":
        name, given = text_at(item, "name") or "", item.get("input")
        words = " ".join(string_leaves(given))
        return f"{name} {words}" if words else name, {"kind": kind, "id": text_at(item, "id") or "", "name": name, "input": given}
    if kind == "tool_result":
        t, inner = flatten(item.get("content"))
        return t, {"kind": kind, "tool_use_id": text_at(item, "tool_use_id") or "", "is_error": item.get("is_error") is True, "content": inner}
    if kind == "image":
        source = item.get("source")
        return "", {"kind": kind, "media_type": text_at(source, "media_type") or "", "byte_len": len((text_at(source, "data") or "").encode()) * 3 // 4}
    if kind == "tool_reference":
        name = text_at(item, "tool_name") or ""
        return name, {"kind": kind, "tool_name": name}
    return None


def flatten(content: Any) -> tuple[str, list[dict]]:
    """Searchable text (non-empty parts, one a line) and the blocks of a message's content."""
    if isinstance(content, str):
        return content, [{"kind": "text", "text": content}] if content else []
    if not isinstance(content, list):
        return "", []
    found = [b for item in content if (b := _block(item))]
    return "\n".join(t for t, _ in found if t), [b for _, b in found]


def attachment(value: Any) -> tuple[str, list[dict]]:
    """A file's content, even empty; else a non-empty string content; else a snippet."""
    content = value.get("content") if isinstance(value, dict) else None
    file_text = text_at(content.get("file"), "content") if isinstance(content, dict) else None
    if file_text is not None:
        return file_text, [{"kind": "text", "text": file_text}]
    if isinstance(content, str) and content:
        return content, [{"kind": "text", "text": content}]
    snippet = text_at(value, "snippet")
    return (snippet, [{"kind": "text", "text": snippet}]) if snippet is not None else ("", [])


def compact_json(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def _short(text: str, size: int) -> str:
    t = text.strip()
    return t if len(t) <= size else t[:size] + "…"


def render(blocks: list[dict]) -> str:
    """Blocks as lines of a readable transcript."""
    out = []
    for b in blocks:
        kind = b.get("kind")
        if kind == "text":
            out.append(b["text"].rstrip())
        elif kind == "thinking" and (t := _short(b["text"], 200)):
            out.append(f"  💭 {t}")
        elif kind == "tool_use":
            given = b.get("input")
            out.append(f"  → {b['name']}({'' if given is None else _short(compact_json(given), 120)})")
        elif kind == "tool_result":
            out.append("  ← [error]" if b["is_error"] else "  ← [result]")
            out += ["    " + line for c in b["content"] for line in render([c]).splitlines()]
        elif kind == "image":
            out.append(f"  [image {b['media_type']} ~{b['byte_len']}B]")
        elif kind == "tool_reference":
            out.append(f"  [tool: {b['tool_name']}]")
    return "".join(f"{x}\n" for x in out)


def _each(texts: pa.Array, one: Callable[[str | None], str]) -> pa.Array:
    """one() of each text, in pieces of bounded bytes."""
    parts = pieces(pa.RecordBatch.from_arrays([texts], ["t"]), 0)
    done = [pa.array([one(x) for x in p.column(0).to_pylist()], pa.string()) for p in parts]
    return pa.concat_arrays(done) if done else pa.array([], pa.string())


@arrow_udf(StringType())
def render_blocks(blocks_json: pa.Array) -> pa.Array:
    """Stored blocks as readable text; what isn't a list of blocks renders as nothing."""

    def one(raw: str | None) -> str:
        try:
            return render(json.loads(raw or "[]"))
        except (ValueError, KeyError, AttributeError, TypeError):
            return ""

    return _each(blocks_json, one)


@arrow_udf(StringType())
def leaves_of(raw: pa.Array) -> pa.Array:
    """string_leaves() of JSON texts, joined by spaces; what isn't JSON has none."""

    def one(x: str | None) -> str:
        try:
            return " ".join(string_leaves(json.loads(x or "null")))
        except ValueError:
            return ""

    return _each(raw, one)
