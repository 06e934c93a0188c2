"""Chat formatting of reply trees: the best branches of each tree as conversations.

Messages form trees (tree, node, parent, score). Pointer doubling, a self-join per round, sums
scores and lengths from every node up to its root in log2(depth) rounds; the leaves of a tree are
ranked by the mean score of their branch; the same ancestor tables then enumerate the paths of the
chosen leaves, again one self-join per round. Only ids move in these joins, the texts are joined
once at the end. A conversation is one output row and so is put together in one task.

Template of a turn: ``### role: text</turn>`` and a line end. Inside a text ``\\``, ``###`` and
``</turn>`` get a ``\\`` in front (inside a role ``:`` too), so a text can't end its turn, and taking
one ``\\`` away everywhere restores it.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillflow.llm.common import stored

MAX_ROUNDS = 40
NO_KEY = -(1 << 63)
FORMATTED = "formatted string, loss_spans array<struct<start:long,end:long>>"
READ = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_CONTROL = re.compile(r"\\|###|</turn>")
_ROLE_CONTROL = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(
    r"### ([^\\:]*(?:\\.[^\\:]*)*): ([^\\<]*(?:(?:\\.|<(?!/turn>))[^\\<]*)*)</turn>\n", re.DOTALL)


def escape(text: str, control: re.Pattern = _CONTROL) -> str:
    return control.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turns(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The conversation as text, and the spans (code points) of all texts of the role ``learn``."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"### {escape(role, _ROLE_CONTROL)}: ", escape(text)
        at += len(head)
        if role == learn:
            spans.append((at, at + len(body)))
        at += len(body) + len("</turn>\n")
        parts += (head, body, "</turn>\n")
    return "".join(parts), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation, as they were."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m.group(1)), unescape(m.group(2))))
        at = m.end()
    return turns


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, rank, node, up) of the ``branches`` best root-to-leaf paths of each tree.

    ``messages``: tree, node (long, no nulls), parent (null or unknown: a root), score (null: 0).
    Rows that repeat a node count once (the one with the least parent and score). ``up`` counts
    from the leaf (0) to the root. Equal mean scores are ranked by the lesser leaf. A cycle of
    parents is an error. An empty table gives an empty result.
    """
    base = stored(
        messages.groupBy("tree", "node").agg(F.min(F.struct(
            "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))).alias("m"))
        .select("tree", "node", "m.parent", "m.score"), "messages")
    up = base.select("tree", F.col("node").alias("parent"), F.col("node").alias("anc"))
    state = stored(base.join(up, ["tree", "parent"], "left").select(
        "tree", "node", "anc", F.col("score").alias("total"), F.lit(1).cast("long").alias("size")), "jump")
    jumps = []
    while state.where("anc IS NOT NULL").limit(1).count():
        if len(jumps) > MAX_ROUNDS:
            raise ValueError("the parents of some message form a cycle")
        jumps.append(state.where("anc IS NOT NULL").select("tree", "node", "anc"))
        above = state.select("tree", F.col("node").alias("anc"), F.col("anc").alias("anc_2"),
                             F.col("total").alias("total_2"), F.col("size").alias("size_2"))
        # Nodes that have reached their root are done and stay out of the join.
        moved = state.where("anc IS NOT NULL").join(above, ["tree", "anc"]).select(
            "tree", "node", F.col("anc_2").alias("anc"), (F.col("total") + F.col("total_2")).alias("total"),
            (F.col("size") + F.col("size_2")).alias("size"))
        state = stored(moved.unionByName(state.where("anc IS NULL")), "jump")
    inner = base.select("tree", F.col("parent").alias("node")).where("node IS NOT NULL")
    ranked = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("size")), "node")
    chosen = state.join(inner, ["tree", "node"], "left_anti").withColumn(
        "rank", F.row_number().over(ranked)).where(F.col("rank") <= branches)
    paths = stored(chosen.select("tree", F.col("node").alias("leaf"), "rank", "node",
                                 F.lit(0).cast("long").alias("up")), "paths")
    for k, jump in enumerate(jumps):
        further = paths.join(jump, ["tree", "node"]).select(
            "tree", "leaf", "rank", F.col("anc").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        paths = stored(paths.union(further), "paths")
    return paths


def _formatted(turns: pd.Series) -> pd.DataFrame:
    rows = [format_turns([(t["role"] or "", t["text"] or "") for t in ts]) for ts in turns]
    return pd.DataFrame({"formatted": [r[0] for r in rows],
                         "loss_spans": [[{"start": a, "end": b} for a, b in r[1]] for r in rows]})


def format_paths(paths: DataFrame, texts: DataFrame) -> DataFrame:
    """(tree, leaf, rank, formatted, loss_spans) from ``best_paths`` and ``texts`` (tree, node, role, text)."""
    turn = F.struct((-F.col("up")).alias("at"), "role", "text")
    return paths.join(texts, ["tree", "node"]).groupBy("tree", "leaf", "rank").agg(
        F.array_sort(F.collect_list(turn)).alias("turns")).select(
        "tree", "leaf", "rank", F.pandas_udf(_formatted, FORMATTED)("turns").alias("out")).select("tree", "leaf", "rank", "out.*")


def linear_messages(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as messages: each answers the one before it by (turn, role, text).

    Null roles and texts count as empty, a null turn comes first, rows without conv_id are one
    conversation (tree ``NO_KEY``). Repeated rows are turns of their own.
    """
    plain = rows.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_KEY)).alias("tree"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    node = plain.withColumn("node", F.row_number().over(order).cast("long"))
    return node.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
                       F.lit(0.0).alias("score"), "role", "text")


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans): every conversation of ``rows`` as one formatted text.

    Takes (conv_id, turn, role, text), ignores other columns; an empty table gives an empty result.
    """
    messages = stored(linear_messages(rows), "turns")
    out = format_paths(best_paths(messages), messages.select("tree", "node", "role", "text"))
    return out.select(F.nullif("tree", F.lit(NO_KEY)).alias("conv_id"), "formatted", "loss_spans")


def read_back(formatted: str = "formatted", loss_spans: str = "loss_spans") -> Column:
    """Counts and digests of what a formatted conversation holds, parsed from the text itself."""
    return F.pandas_udf(_read, READ)(formatted, loss_spans)


def _read(formatted: pd.Series, spans: pd.Series) -> pd.DataFrame:
    rows = []
    for text, marks in zip(formatted, spans):
        turns = parse_turns(text)
        whole = "".join(f"{role}\n{body}\n" for role, body in turns)
        loss = "".join(unescape(text[m["start"]:m["end"]]) for m in marks)
        rows.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss),
                     hashlib.sha256(loss.encode()).hexdigest(), len(text)))
    return pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
