"""Corpus mining: noise filters, cropping, budgeted shards, prevalence of rules, keep and rescue."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import crop, is_blank, trim

# What tools, not people, write at the start of a message.
NOISE = r"(?i)^(base directory for this skill|implement the following|<!--|# commit skill|## preamble|_upd=|source <)"
BUDGET = 400_000
RESCUE_PROJECTS, RESCUE_SESSIONS = 6, 25


def is_noise(text: Column) -> Column:
    return is_blank(text) | trim(text).rlike(NOISE)


def shards(rows: DataFrame, size: str, order: list[str], by: list[str] | None = None, budget: int = BUDGET) -> DataFrame:
    """Append `shard`: rows in order fill a shard until its sizes reach the budget; the row that does still belongs to it.

    by: each group of these columns has shards of its own, in parallel. Without it there is one order over the
    whole table, and one task walks it; only the columns of rows are moved, so pass keys and sizes, not texts,
    and join. Rows are streamed, none are held.
    """
    keys = by or []

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, shard, filled = None, 0, 0
        for b in batches:
            out = []
            groups = list(zip(*(b.column(k).to_pylist() for k in keys), strict=True)) if keys else [()] * b.num_rows
            for g, n in zip(groups, b.column(size).to_pylist(), strict=True):
                if g != group:
                    group, shard, filled = g, 0, 0
                out.append(shard)
                filled += n or 0
                if filled >= budget:
                    shard, filled = shard + 1, 0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], [*b.schema.names, "shard"])

    dealt = rows.repartition(*keys) if keys else rows.repartition(1)
    return dealt.sortWithinPartitions(*keys, *order).mapInArrow(walk, rows.withColumn("shard", F.lit(0).cast("long")).schema)


def id_list(rows: DataFrame, column: str, session: str = "session_id") -> DataFrame:
    """(session_id): a list of ids as it is written, trimmed, without blanks and repeats; an error if nothing is left."""
    ids = rows.select(trim(F.col(column)).alias(session)).filter(~is_blank(F.col(session))).distinct()
    if ids.isEmpty():
        raise ValueError("the list of sessions is empty")
    return ids


def per_shard(lines: DataFrame, order: list[str], run: Callable[[int, str], list[dict]], schema: str) -> DataFrame:
    """What run(shard, its text) says of each shard, as rows of the schema: the hook for a reader of shards, a model or a rule.

    A shard is one group of at most its budget and a line.
    """

    names = StructType.fromDDL(schema).names

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(run(int(key[0]), "".join(part.sort_values(order)["line"])), columns=names)

    return lines.select("shard", *order, "line").groupBy("shard").applyInPandas(one, schema)


def read_dump(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """A prose dump (session_id, project, title, ts, text): JSON lines as write_json() writes them, else one array."""
    return spark.read.schema("session_id string, project string, title string, ts long, text string").option("multiLine", not lines).json(path)


def prose_lines(prose: DataFrame, order: list[str], session: str = "session_id", project: str = "project", text: str = "text", budget: int = BUDGET) -> DataFrame:
    """Append `line` and `shard` to prose without noise: a cropped line each, a header where the session begins.

    prose must be ordered session by session in `order`; a session that goes on in the next shard has no second header.
    """
    kept = prose.filter(~is_noise(F.col(text)))
    first = F.row_number().over(Window.partitionBy(session).orderBy(*order)) == 1
    header = F.when(first, F.concat(F.lit("\n--- session ["), F.col(project), F.lit("] ---\n"))).otherwise("")
    lines = kept.withColumn("line", F.concat(header, F.lit("• "), crop(F.col(text)), F.lit("\n")))
    sizes = shards(lines.select(*order, F.length("line").alias("size")), "size", order, budget=budget)
    return lines.join(sizes.drop("size"), order)


def topic_lines(prose: DataFrame, topic: DataFrame, order: list[str], session: str = "session_id", project: str = "project", title: str = "title", text: str = "text", budget: int = BUDGET) -> DataFrame:
    """The whole prose of the sessions of a topic; shards close between sessions only.

    topic: a table of session ids, repeats allowed. Sessions are in the order of their id.
    """
    related = prose.join(topic.select(session).distinct(), session, "left_semi")
    first = F.row_number().over(Window.partitionBy(session).orderBy(*order)) == 1
    header = F.when(first, F.concat(F.lit("\n===== session ["), F.col(project), F.lit("] "), F.left(title, F.lit(60)), F.lit(" =====\n"))).otherwise("")
    lines = related.withColumn("line", F.concat(header, F.lit("• "), crop(F.col(text)), F.lit("\n")))
    sizes = shards(lines.groupBy(session).agg(F.sum(F.length("line")).alias("size")), "size", [session], budget=budget)
    return lines.join(sizes.drop("size"), session)


def write_shards(lines: DataFrame, order: list[str], path: str) -> None:
    """One folder of text for each shard."""
    lines.select("shard", *order, F.regexp_replace("line", "\n$", "").alias("value")).repartition("shard").sortWithinPartitions("shard", *order).select("shard", "value").write.mode("overwrite").partitionBy("shard").text(path)


def prevalence(rows: DataFrame, rules: dict[str, str], session: str, project: str, text: str = "text") -> DataFrame:
    """(rule, session_hits, projects_seen, sessions, projects): where each pattern occurs, against all there are.

    One pass. Each session's flags are combined before distinct sessions are counted, so rows of a session
    shrink to one in each task before the shuffle.
    """
    flags = [F.max(F.col(text).rlike(p).cast("int")).alias(f"r{i}") for i, p in enumerate(rules.values())]
    pairs = rows.groupBy(F.col(session).alias("s"), F.col(project).alias("p")).agg(*flags)
    n = range(len(rules))
    # each pair counts for its session and for its project, in one exchange of the pairs
    sides = pairs.select(F.explode(F.array(F.struct(F.lit(0).alias("side"), F.xxhash64("s").alias("key"), F.col("s").isNull().alias("none")), F.struct(F.lit(1).alias("side"), F.xxhash64("p").alias("key"), F.col("p").isNull().alias("none")))).alias("k"), *(f"r{i}" for i in n))
    once = sides.groupBy("k").agg(*(F.max(f"r{i}").alias(f"r{i}") for i in n))
    of = lambda side, x: F.coalesce(F.sum(F.when(F.col("k.side") == side, x)), F.lit(0))
    row = once.agg(of(0, F.lit(1)).alias("sessions"), of(1, F.lit(1)).alias("projects"), *(of(side, F.col(f"r{i}")).alias(f"{name}{i}") for side, name in ((0, "sessions"), (1, "projects")) for i in n))
    each = F.array(*(F.struct(F.lit(k).alias("rule"), F.col(f"sessions{i}").alias("session_hits"), F.col(f"projects{i}").alias("projects_seen")) for i, k in enumerate(rules)))
    return row.select("sessions", "projects", F.explode(each).alias("e")).select("e.rule", "e.session_hits", "e.projects_seen", "sessions", "projects")


def keep_or_rescue(verified: DataFrame) -> DataFrame:
    """Kept rules by session hits, then those rescued for their breadth by projects: (pos, rule, …, tier), of any number."""
    rescue = (F.col("projects_seen") >= RESCUE_PROJECTS) | (F.col("session_hits") >= RESCUE_SESSIONS)
    rows = verified.withColumn("tier", F.when(F.col("keep"), 0).when(rescue, 1)).filter("tier is not null")
    by = F.when(F.col("tier") == 0, F.col("session_hits")).otherwise(F.col("projects_seen"))
    return rows.withColumn("pos", F.row_number().over(Window.orderBy(F.col("tier"), by.desc(), F.col("rule"))).cast("long"))


def consolidate(findings: DataFrame, text: str = "rule", most: int = 16) -> DataFrame:
    """Findings that are equal but for case, marks and spaces, as one: (pos, rule, votes), the most frequent first."""
    from .search import with_position

    norm = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    rows = findings.withColumn("_n", norm).groupBy("_n").agg(F.min(text).alias("rule"), F.count("*").alias("votes")).drop("_n")
    return with_position(rows, most, F.col("votes").desc(), F.col("rule"))
