"""Sessions as sequences and trees: prompts and prose, transcripts, recovery, windows, topology."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import render_blocks
from ..functions.text import basename, has_id_prefix, is_blank, shell_quoted, short_id, title_or, trim_end
from .search import with_position

# Fixed values of the format: where worktrees lie below a repository, and what resumes a session.
WORKTREES = "/.claude/worktrees/"
RESUME = "claude --resume"
HIDDEN = "  ⟨pre-compaction · hidden by UI⟩"
CAP = 200


def typed_prompts(messages: DataFrame) -> Column:
    """Messages that a person typed: user lines whose first block is text, without tags and slash commands."""
    t = F.col("text_for_fts")
    return (t != "") & (F.col("rec_type") == "user") & (F.col("first_kind") == "text") & ~t.startswith("<") & ~t.startswith("/")


def prose(messages: DataFrame, sessions: DataFrame, role: str = "user", limit: int | None = None, keys: bool = False) -> DataFrame:
    """(session_id, project, title, ts, text, first_ts, session_key, line_no): the prose of one role, by session start, session and line.

    keys: without the order, for what orders by the keys itself.
    """
    t = F.col("text_for_fts")
    own = messages.filter((F.col("role") == role) & (t != "") & ~F.col("is_sidechain") & (F.col("first_kind") == "text") & ~t.startswith("<") & ~t.startswith("/") & ~t.startswith("["))
    rows = own.join(sessions.select("session_key", "session_id", F.col("project_name").alias("project"), "title", "first_ts"), "session_key")
    order = [F.col("first_ts").asc_nulls_first(), F.col("session_key"), F.col("line_no")]
    out = rows.select("session_id", "project", "title", "ts", t.alias("text"), "first_ts", "session_key", "line_no")
    out = out if keys else out.orderBy(*order)
    return out if limit is None else out.limit(limit)


def find_sessions(sessions: DataFrame, prefix: str, limit: int = 25, session_id: str = "session_id", last_ts: str = "last_ts") -> DataFrame:
    """Sessions whose id begins so, the latest first."""
    return with_position(sessions.filter(has_id_prefix(F.col(session_id), prefix)), limit, F.col(last_ts).desc_nulls_last(), F.col(session_id))


def resolve(sessions: DataFrame, prefix: str) -> str:
    """The key of the one session that a prefix means: the only match, or the one of exactly this id."""
    found = find_sessions(sessions, prefix).select("session_key", "session_id").collect()
    exact = [r for r in found if r.session_id == prefix]
    if len(found) == 1 or len(exact) == 1:
        return (found if len(found) == 1 else exact)[0].session_key
    raise LookupError(f"no session begins with {prefix!r}" if not found else f"{prefix!r} is ambiguous: " + ", ".join(r.session_id for r in found))


def recover(messages: DataFrame, boundaries: DataFrame, session: str = "session_key", line: str = "line_no") -> DataFrame:
    """Messages and boundaries of each session in one sequence: (…, item, item_rank, pre_compaction).

    A boundary comes before a message of the same line. Messages before the last boundary are pre-compaction.
    The last boundary is found by a partial aggregate and joined, so no session's rows need to meet in a window.
    """
    last = boundaries.groupBy(session).agg(F.max(line).alias("_last"))
    m = messages.join(last, session, "left").withColumn("pre_compaction", F.coalesce(F.col(line) < F.col("_last"), F.lit(False))).drop("_last").withColumns({"item": F.lit("message"), "item_rank": F.lit(1)})
    b = boundaries.withColumns({"pre_compaction": F.lit(False), "item": F.lit("boundary"), "item_rank": F.lit(0)})
    return m.unionByName(b, allowMissingColumns=True)


def recovery_counts(messages: DataFrame, boundaries: DataFrame, session: str = "session_key", line: str = "line_no") -> DataFrame:
    """(session, boundary_count, recovered_count) of the sessions that have a boundary."""
    last = boundaries.groupBy(session).agg(F.max(line).alias("_last"), F.count("*").alias("boundary_count"))
    pre = messages.join(last, session).filter(F.col(line) < F.col("_last")).groupBy(session).agg(F.count("*").alias("recovered_count"))
    return last.join(pre, session, "left").select(session, "boundary_count", F.coalesce("recovered_count", F.lit(0)).cast("long").alias("recovered_count"))


def cross_file(boundaries: DataFrame, messages: DataFrame, session: str = "session_key", parent: str = "logical_parent_uuid", uuid: str = "uuid") -> DataFrame:
    """Boundaries whose logical parent isn't a message of their own session."""
    known = messages.select(session, F.col(uuid).alias(parent)).filter(F.col(parent).isNotNull()).distinct()
    return boundaries.filter(F.col(parent).isNotNull()).join(known, [session, parent], "left_anti")


def rendered(sequence: DataFrame) -> DataFrame:
    """Append `chunk`, readable text; messages without a visible body are dropped."""
    body = render_blocks("blocks_json")
    tag = F.when(F.col("pre_compaction"), HIDDEN).otherwise("")
    message = F.concat(F.lit("## "), F.coalesce("role", "rec_type"), tag, F.lit("\n"), trim_end(F.col("_body")))
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    boundary = F.concat(F.lit("─── ⟪ compaction boundary · "), F.coalesce("trigger", F.lit("?")), F.lit(" · "), number("pre_tokens"), F.lit("→"), number("post_tokens"), F.lit(" tokens ⟫ ───"))
    out = sequence.withColumn("_body", body).filter((F.col("item") == "boundary") | ~is_blank(F.col("_body")))
    return out.withColumn("chunk", F.when(F.col("item") == "boundary", boundary).otherwise(message)).drop("_body")


def parse_range(text: str) -> tuple[int, int]:
    """`A:B` or `A-B`, from 1, both ends included."""
    for mark in (":", "-"):
        a, found, b = text.partition(mark)
        if found:
            x, y = int(a.strip()), int(b.strip())
            if x < 1 or y < x:
                raise ValueError(f"{text!r} isn't a range")
            return x, y
    raise ValueError(f"{text!r} isn't a range")


def window(rows: DataFrame, session: str, *order: Column, range_: str | None = None, head: int | None = None, tail: int | None = None, from_start: bool = False, cap: int = CAP) -> DataFrame:
    """Each session's rows numbered in `i` with their `total`, cut to a range, a head, a tail, or the cap."""
    w = Window.partitionBy(session)
    out = rows.withColumns({"i": F.row_number().over(w.orderBy(*order)).cast("long"), "total": F.count("*").over(w)})
    i, total = F.col("i"), F.col("total")
    if range_ is not None:
        a, b = parse_range(range_)
        return out.filter(i.between(a, b))
    if head is not None:
        return out.filter(i <= head)
    if tail is not None:
        return out.filter(i > total - tail)
    return out.filter((total <= cap) | (i <= cap if from_start else i > total - cap))


def change_markers(rows: DataFrame, session: str, *order: Column) -> Column:
    """True where a row's session differs from that of the row before, in this order of the whole table."""
    before = F.lag(session).over(Window.orderBy(*order))
    return before.isNull() | (before != F.col(session))


def first_of_session(rows: DataFrame, session: str, *order: Column) -> DataFrame:
    """Append `is_first`: where the order begins with the session, its first row is where the session changes.

    A window by session, so no task sees the whole table.
    """
    return rows.withColumn("is_first", F.row_number().over(Window.partitionBy(session).orderBy(*order)) == 1)


def classify(sessions: DataFrame, worktrees: DataFrame) -> DataFrame:
    """Append repo, worktree, branch and confidence to each session; of a session's worktree records the last counts."""
    last = worktrees.groupBy("session_key").agg(F.max_by(F.struct("original_cwd", "worktree_name", "branch"), "line_no").alias("w"))
    cwd = F.coalesce("project_path", F.lit("(unknown)"))
    at = F.instr(cwd, WORKTREES)
    explicit = F.col("w.original_cwd").isNotNull()
    repo = F.when(explicit, F.col("w.original_cwd")).when(at > 0, F.substring(cwd, F.lit(1), at - 1)).otherwise(cwd)
    name = F.when(explicit, F.coalesce("w.worktree_name", basename(cwd), cwd)).when(at > 0, F.split_part(F.substring(cwd, at + len(WORKTREES), F.length(cwd)), F.lit("/"), F.lit(1)))
    confidence = F.when(explicit, "explicit").when(at > 0, "inferred")
    return sessions.join(last, "session_key", "left").withColumns({"repo": repo, "worktree": name, "branch": F.when(explicit, F.col("w.branch")), "confidence": confidence}).drop("w")


def _mentions(part: str) -> Column:
    return F.contains(F.lower(F.concat_ws(" ", "repo", F.coalesce("project_name", F.lit("")), F.coalesce("title", F.lit("")))), F.lit(part.lower()))


def topology(sessions: DataFrame, worktrees: DataFrame, contains: str | None = None) -> DataFrame:
    """(repo, worktree, branch, confidence, session_count, message_count, session_ids): the tree, a row for each group.

    worktree is null for a repository's main sessions. The filter is a case-blind substring of repository,
    project and title. Sessions in a group are the latest first; branch is the first that any of them has.
    """
    rows = classify(sessions, worktrees)
    if contains is not None:
        rows = rows.filter(_mentions(contains))
    late = F.struct(F.coalesce(-F.col("last_ts"), F.lit(1 << 62)).alias("o"), F.col("session_id"), F.col("branch"))
    sorted_ = F.array_sort(F.collect_list(late))
    return rows.groupBy("repo", "worktree").agg(
        F.get(F.filter(F.transform(sorted_, lambda x: x.branch), lambda b: b.isNotNull()), F.lit(0)).alias("branch"),
        F.min("confidence").alias("confidence"),
        F.count("*").alias("session_count"),
        F.sum("message_count").alias("message_count"),
        F.transform(sorted_, lambda x: x.session_id).alias("session_ids"),
    )


def tree_lines(sessions: DataFrame, worktrees: DataFrame, contains: str | None = None) -> DataFrame:
    """(repo, worktree, rank, line): the tree's lines, a row for each, to be ordered by the first three; nothing is gathered."""
    rows = classify(sessions, worktrees)
    if contains is not None:
        rows = rows.filter(_mentions(contains))
    count = rows.groupBy("repo").agg(F.count("*").alias("n"))
    head = count.select("repo", F.lit(None).cast("string").alias("worktree"), F.lit(-2).cast("long").alias("rank"), F.concat(F.lit("\n"), "repo", F.lit("  ("), F.col("n").cast("string"), F.lit(" session(s))")).alias("line"))
    trees = rows.filter("worktree is not null").groupBy("repo", "worktree").agg(F.min_by("branch", F.when(F.col("branch").isNotNull(), F.struct(F.coalesce(-F.col("last_ts"), F.lit(1 << 62)), F.col("session_id")))).alias("branch"), F.min("confidence").alias("confidence"))
    middle = trees.select("repo", "worktree", F.lit(-1).cast("long").alias("rank"), F.concat(F.lit("  ├─ ⌥ worktree: "), "worktree", F.lit(" (branch "), F.coalesce("branch", F.lit("?")), F.lit(") ["), "confidence", F.lit("]")).alias("line"))
    mark = F.when(F.col("worktree").isNull(), "├─").otherwise("│    └─")
    late = Window.partitionBy("repo", "worktree").orderBy(F.coalesce(-F.col("last_ts"), F.lit(1 << 62)), "session_id")
    leaves = rows.select("repo", "worktree", F.row_number().over(late).cast("long").alias("rank"), F.concat(F.lit("  "), mark, F.lit(" "), short_id(F.col("session_id")), F.lit("  "), title_or(F.col("title")), F.lit("  · "), F.col("message_count").cast("string"), F.lit(" msgs")).alias("line"))
    return head.union(middle).union(leaves)


def tree_text(lines: DataFrame) -> Iterator[str]:
    """The tree's lines in order, streamed partition by partition."""
    for r in lines.orderBy("repo", F.col("worktree").asc_nulls_first(), "rank").toLocalIterator():
        yield r.line


def resume_command(sessions: DataFrame, command: str = RESUME) -> DataFrame:
    """(session_id, command): what takes a shell back into each session."""
    go = F.concat(F.lit(f"{command} "), F.col("session_id"))
    return sessions.select("session_id", F.when(F.col("project_path").isNull(), go).otherwise(F.concat(F.lit("cd "), shell_quoted(F.col("project_path")), F.lit(" && "), go)).alias("command"))


def labelled(sessions: DataFrame) -> DataFrame:
    return sessions.withColumn("label", F.concat(F.lit("["), "project_name", F.lit("] "), title_or(F.col("title")), F.lit(" · "), "session_id"))
