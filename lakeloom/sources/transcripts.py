"""JSONL transcripts: discovery, line reading, and routing of lines to typed records.

A file is one session; its line numbers, from 1 and over all lines, are its order. Lines that aren't valid
UTF-8 or strict JSON are kept as skipped lines with their number; blank ones only count. Fields of a wrong
type are missing. Reading and routing are one Arrow pass over the files, without a shuffle.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import datetime
from itertools import chain
from typing import Any

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import PIECE, freeing, pieces
from ..functions.blocks import attachment, compact_json, flatten, text_at
from ..functions.text import basename, words

# Fixed values of the format: line types without a record of their own.
SKIPPED_TYPES = frozenset("agent-name last-prompt permission-mode mode pr-link file-history-snapshot queue-operation agent-setting".split())
RFC3339 = re.compile(r"\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)")

RECORD = (
    "session_key string, mtime_us long, size long, line_no int, kind string, reason string, uuid string, parent_uuid string, rec_type string, subtype string, role string, ts long, cwd string, "
    "is_sidechain boolean, is_compact_summary boolean, blocks_json string, first_kind string, text_for_fts string, logical_parent_uuid string, trigger string, pre_tokens long, post_tokens long, "
    "original_cwd string, worktree_path string, worktree_name string, branch string, original_branch string, original_head string, continues_session_id string, evidence string, last_sequence long, title string, n_tokens int"
)
COLUMNS = [x.split()[0] for x in RECORD.split(", ")]
#: Bytes, about, of a record without its texts.
ROW = 1000
MESSAGE = ["uuid", "parent_uuid", "rec_type", "subtype", "role", "ts", "cwd", "is_sidechain", "is_compact_summary", "blocks_json", "first_kind", "text_for_fts"]
BOUNDARY = ["uuid", "parent_uuid", "logical_parent_uuid", "trigger", "pre_tokens", "post_tokens", "ts"]
WORKTREE = ["original_cwd", "worktree_path", "worktree_name", "branch", "original_branch", "original_head", "continues_session_id"]


def epoch_ms(value: Any) -> int | None:
    """An RFC 3339 time as milliseconds since 1970; anything else is missing."""
    if not isinstance(value, str) or not (m := RFC3339.fullmatch(value)):
        return None
    try:
        at = datetime.fromisoformat(value[:19].upper().replace(" ", "T") + (m[2].upper().replace("Z", "+00:00")))
    except ValueError:
        return None
    return int(at.timestamp()) * 1000 + int(((m[1] or ".0")[1:] + "00")[:3])


def _whole(value: Any) -> int | None:
    return value if type(value) is int and -(1 << 63) <= value < 1 << 63 else None


def _dict(value: Any, key: str) -> dict:
    found = value.get(key) if isinstance(value, dict) else None
    return found if isinstance(found, dict) else {}


def _message(line: dict, kind: str, body: tuple[str, list[dict]]) -> dict:
    text, blocks = body
    return {
        "kind": "message", "uuid": text_at(line, "uuid"), "parent_uuid": text_at(line, "parentUuid"), "rec_type": kind, "subtype": text_at(line, "subtype"), "role": text_at(_dict(line, "message"), "role"),
        "ts": epoch_ms(line.get("timestamp")), "cwd": text_at(line, "cwd"), "is_sidechain": line.get("isSidechain") is True, "is_compact_summary": line.get("isCompactSummary") is True,
        "blocks_json": compact_json(blocks), "first_kind": blocks[0]["kind"] if blocks else None, "text_for_fts": text, "n_tokens": len(words(text)),
    }


def route(value: Any) -> dict | None:
    """The record of one parsed line; None where the format has none for it."""
    line = value if isinstance(value, dict) else {}
    kind = text_at(line, "type") or ""
    if kind in SKIPPED_TYPES:
        return None
    if kind in ("ai-title", "custom-title"):
        title = text_at(line, "aiTitle" if kind == "ai-title" else "customTitle")
        return {"kind": kind, "title": title} if title is not None else None
    if kind == "worktree-state":
        w = _dict(line, "worktreeSession")
        names = ("originalCwd", "worktreePath", "worktreeName", "worktreeBranch", "originalBranch", "originalHeadCommit", "sessionId")
        return {"kind": "worktree"} | {c: text_at(w, n) for c, n in zip(WORKTREE, names, strict=True)}
    if kind == "bridge-session":
        return {"kind": "bridge", "evidence": text_at(line, "bridgeSessionId"), "last_sequence": _whole(line.get("lastSequenceNum"))}
    if kind == "system" and text_at(line, "subtype") == "compact_boundary":
        c = _dict(line, "compactMetadata")
        return {"kind": "boundary", "uuid": text_at(line, "uuid"), "parent_uuid": text_at(line, "parentUuid"), "logical_parent_uuid": text_at(line, "logicalParentUuid"), "trigger": text_at(c, "trigger"), "pre_tokens": _whole(c.get("preTokens")), "post_tokens": _whole(c.get("postTokens")), "ts": epoch_ms(line.get("timestamp"))}
    if kind in ("user", "assistant"):
        return _message(line, kind, flatten(_dict(line, "message").get("content")))
    if kind == "attachment":
        return _message(line, kind, attachment(line.get("attachment")))
    return _message(line, kind, ("", []))


SURROGATE = re.compile(r"\\u[dD][89a-fA-F]")


def _strict(raw: str) -> Any:
    """The value of a line; an error for constants that aren't JSON, and for halves of a surrogate pair, which no text can hold."""

    def refuse(x: str) -> None:
        raise ValueError(f"{x} isn't JSON")

    value = json.loads(raw, parse_constant=refuse)
    if SURROGATE.search(raw):
        json.dumps(value, ensure_ascii=False).encode()
    return value


def _split(content: bytes) -> Iterator[bytes]:
    """content.split() by lines, one at a time."""
    at = 0
    while (end := content.find(b"\n", at)) >= 0:
        yield content[at:end]
        at = end + 1
    yield content[at:]


def parse_lines(content: bytes) -> Iterator[dict]:
    """The records and skipped lines of a file, in order."""
    for n, raw in enumerate(_split(content), 1):
        try:
            text = raw.decode()
            if not text.strip():
                continue
            record = route(_strict(text))
        except (ValueError, RecursionError) as e:  # bad UTF-8 is a ValueError too
            record = {"kind": "skipped", "reason": str(e)}
        if record is not None:
            yield {"line_no": n} | record


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(path, modificationTime, length) of the files exactly one folder below root that end in .jsonl."""
    try:
        files = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/*/*.jsonl")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "session_key string, mtime_us long, size long, content binary")
    return files.select(F.col("path").alias("session_key"), F.unix_micros("modificationTime").alias("mtime_us"), F.col("length").alias("size"), "content")


def read_records(files: DataFrame) -> DataFrame:
    """All records of these files; a file without any gives one row of kind `empty`.

    Files are taken, and records sent, in pieces of bounded bytes; a file of more bytes is taken by itself.
    """
    kinds = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[t]) for n, t in (x.split() for x in RECORD.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for part in (p for b in batches for p in pieces(b, 3)):
            for key, mtime, size, content in zip(*part.columns, strict=True):
                base = {"session_key": key.as_py(), "mtime_us": mtime.as_py(), "size": size.as_py()}
                for r in chain(parse_lines(content.as_py()), [{"kind": "empty", "line_no": 0}]):
                    rows.append(base | r)
                    held += ROW + len(r.get("blocks_json") or "") + len(r.get("text_for_fts") or "")
                    if held >= PIECE:
                        yield pa.RecordBatch.from_pylist(rows, kinds)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kinds)

    return files.select("session_key", "mtime_us", "size", "content").mapInArrow(freeing(run), RECORD)


def session_id_of(path):
    return F.regexp_extract(path, r"([^/]+)\.jsonl$", 1)


def sessions_of(records: DataFrame) -> DataFrame:
    """One row for each file: the aggregates of its records. Partial aggregation before the shuffle by file."""
    message, boundary = F.col("kind") == "message", F.col("kind") == "boundary"
    pick = lambda cond, value, by=F.max_by: by(F.when(cond, value), F.when(cond, F.col("line_no")))
    cwd = message & F.col("cwd").isNotNull()
    out = records.groupBy("session_key").agg(
        F.max("mtime_us").alias("mtime_us"),
        F.max("size").alias("size"),
        F.min(F.when(message | boundary, F.col("ts"))).alias("first_ts"),
        F.max(F.when(message | boundary, F.col("ts"))).alias("last_ts"),
        pick(cwd, F.col("cwd"), F.min_by).alias("project_path"),
        pick(F.col("kind") == "ai-title", F.col("title")).alias("ai_title"),
        pick(F.col("kind") == "custom-title", F.col("title")).alias("file_title"),
        F.count_if(message).alias("message_count"),
        (F.count_if(boundary) > 0).alias("has_compaction"),
        F.count_if(F.col("kind") == "skipped").alias("skipped_lines"),
        F.count_if(message & (F.col("text_for_fts") != "")).alias("indexed_messages"),
        F.coalesce(F.sum(F.when(message, F.col("n_tokens"))), F.lit(0)).alias("indexed_tokens"),
    )
    folder = F.element_at(F.split("session_key", "/"), -2)
    return out.withColumns({"session_id": session_id_of(F.col("session_key")), "project_name": F.coalesce(basename(F.col("project_path")), folder)})
