"""Chat formatting from reply trees.

Messages form trees by parent links. Self-joins by pointer doubling give every message its root,
depth and path score in as many rounds as the depth has binary digits; a message that reached its
root leaves the later rounds. Leaves are ranked within their tree by path score, and the chosen
leaves' paths are enumerated by walking the doubled pointers back, one self-join a digit. Each path
is one conversation, written as one fragment a turn, so that no conversation has to fit a row.

A fragment is ``### role: text</turn>`` and a newline. Inside texts and roles a backslash becomes
two, a ``#`` that two more follow ``\\h``, the ``<`` of ``</turn>`` ``\\l`` (and ``:`` in a role ``\\c``),
so control strings never occur in them and parsing reverses it exactly.

Defined results: a null text or role counts as empty. A message whose parent is unknown is a root.
Repeated (tree, message) ids keep one row, the least by role and text; in ``conversation_turns``
repeated turns follow one another instead, by role and text. A cycle has no root and yields no path.
Other columns of either table are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.scratch import Scratch

OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"
ASSISTANT = "assistant"
_BACK = {"\\": "\\", "h": "#", "l": "<", "c": ":"}


def escaped(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("</turn>"), F.lit("\\l/turn>"))
    out = F.regexp_replace(out, "#(?=##)", r"\\h")
    return F.replace(out, F.lit(":"), F.lit("\\c")) if role else out


def _back(found: re.Match) -> str:
    if found[1] not in _BACK:
        raise ValueError("unknown escape")
    return _BACK[found[1]]


def unescaped(text: str) -> str:
    return re.sub(r"(?s)\\(.?)", _back, text) if "\\" in text else text


def parse_turn(fragment: str) -> tuple[str, str]:
    """Role and text of one fragment, checking that it is one whole turn."""
    if not fragment.startswith(OPEN) or not fragment.endswith(CLOSE) or fragment.count(CLOSE[:-1]) != 1 or fragment.count("###") != 1:
        raise ValueError("not a single formatted turn")
    role, colon, text = fragment[len(OPEN) : -len(CLOSE)].partition(COLON)
    if not colon:
        raise ValueError("no role")
    return unescaped(role), unescaped(text)


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """Messages of linear trees: (tree, node, parent, role, text, score), a row replying to the row before."""
    turn = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("__role"), F.col("__key"))
    clean = conversations.select(
        "conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("__role"), F.coalesce(F.col("text"), F.lit("")).alias("__text")
    ).withColumn("__key", F.sha2("__text", 256))
    placed = clean.withColumn("node", F.row_number().over(turn).cast("bigint"))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return placed.select(F.col("conv_id").alias("tree"), "node", parent.alias("parent"), F.col("__role").alias("role"), F.col("__text").alias("text"), F.lit(0.0).alias("score"))


def choose_paths(messages: DataFrame, scratch: Scratch, best: int = 1) -> DataFrame:
    """(tree, path, depth, node, pathScore) rows of the ``best`` leaves' paths of each tree.

    A path's score is the mean of its messages' scores; ties go to the deeper leaf, then to the
    smaller id. ``path`` counts from 1.
    """
    slim = messages.groupBy("tree", "node").agg(F.min(F.struct(F.col("parent"), F.col("score"))).alias("m")).select("tree", "node", "m.parent", "m.score")
    slim = scratch.write(slim, "slim")
    known = slim.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    linked = slim.join(known, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("n")), "left")
    # one table a round: each message's pointer, its length, and the score of the messages it skips, itself included
    pointers = [scratch.write(linked.select("tree", "node", F.col("n").alias("up"), F.lit(1).cast("bigint").alias("steps"), F.coalesce("score", F.lit(0.0)).alias("sum")), "up0")]
    roots: list[DataFrame] = []
    # a pointer longer than the largest tree runs in a cycle
    largest = slim.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    while len(pointers) < largest.bit_length() + 2:
        now = pointers[-1]
        open_ = now.filter(F.col("up").isNotNull())
        roots.append(now.filter(F.col("up").isNull()).select("tree", "node", F.col("steps").alias("depth"), "sum"))
        if open_.isEmpty():
            break
        # where a message's pointer leads: to a message still open in this round, or to one that is done
        done = roots[0]
        for more in roots[1:]:
            done = done.unionByName(more)
        other = open_.select("tree", "node", "up", "steps", "sum").unionByName(done.select("tree", "node", F.lit(None).cast("bigint").alias("up"), F.col("depth").alias("steps"), "sum"))
        other = other.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.col("sum").alias("sum2"))
        joined = open_.join(other, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("n")))
        pointers.append(scratch.write(joined.select("tree", "node", F.col("up2").alias("up"), (F.col("steps") + F.col("steps2")).alias("steps"), (F.col("sum") + F.col("sum2")).alias("sum")), f"up{len(pointers)}"))
    totals = roots[0]
    for more in roots[1:]:
        totals = totals.unionByName(more)
    replied = linked.filter(F.col("n").isNotNull()).select(F.col("tree").alias("t"), F.col("n").alias("n")).distinct()
    leaves = totals.join(replied, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")), "left_anti")
    by_score = Window.partitionBy("tree").orderBy((F.col("sum") / F.col("depth")).desc(), F.col("depth").desc(), "node")
    ranked = leaves.withColumn("path", F.row_number().over(by_score)).filter(F.col("path") <= best)
    walk = ranked.select("tree", "path", "node", "depth", (F.col("sum") / F.col("depth")).alias("pathScore"))
    # every ancestor is reached by the pointers of the binary digits of its distance
    for k in range(len(pointers) - 1, -1, -1):
        step = pointers[k].filter(F.col("up").isNotNull()).select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        moved = walk.join(step, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).select("tree", "path", F.col("up").alias("node"), (F.col("depth") - F.lit(2**k)).alias("depth"), "pathScore")
        walk = walk.unionByName(moved)
        if k and k % 2 == 0 or k == 0:
            walk = scratch.write(walk, f"walk{k}")
    return walk


def format_paths(messages: DataFrame, paths: DataFrame) -> DataFrame:
    """(tree, path, turn, fragment, loss_start, loss_end) in sorted partitions of whole conversations.

    The loss mask of a turn is the span of an assistant's escaped text within its fragment.
    """
    one = messages.groupBy("tree", "node").agg(F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("m"))
    chosen = paths.select(F.col("tree").alias("t"), F.col("node").alias("n"), "path", "depth")
    rows = one.join(chosen, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
    rows = rows.select("tree", "path", F.col("depth").alias("turn"), F.col("m.role").alias("role"), escaped(F.col("m.text")).alias("body"), F.concat(F.lit(OPEN), escaped(F.col("m.role"), role=True), F.lit(COLON)).alias("head"))
    learns = F.col("role") == ASSISTANT
    rows = rows.select(
        "tree", "path", "turn", F.concat("head", "body", F.lit(CLOSE)).alias("fragment"),
        F.when(learns, F.length("head")).alias("loss_start"), F.when(learns, F.length("head") + F.length("body")).alias("loss_end"),
    )
    return rows.repartition("tree", "path").sortWithinPartitions("tree", "path", "turn")


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation: digests of its turns and of all text under the loss mask, read from the output.

    Hash states run over the sorted fragments, so memory doesn't grow with a conversation.
    """
    kind = formatted.schema["tree"].dataType.simpleString()
    names = ["tree", "path", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names)
        close = lambda: done.append((*key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
        for batch in batches:
            kinds[0] = batch.column("tree").type
            cols = [batch.column(n).to_pylist() for n in ("tree", "path", "fragment", "loss_start", "loss_end")]
            for tree, path, fragment, start, end in zip(*cols, strict=True):
                if key != (tree, path):
                    if key:
                        close()
                    key, state = (tree, path), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse_turn(fragment)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    learned = unescaped(fragment[start:end])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(fragment)
            if len(done) >= 1000:
                yield batch_of()
                done.clear()
        if key:
            close()
        if done:
            yield batch_of()

    # fmt: off
    return formatted.mapInArrow(run, f"tree {kind}, path long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    # fmt: on
