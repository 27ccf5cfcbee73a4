"""Chat formatting as a prefix tree, emitted depth-first.

Conversations are sorted by their turns, so those that share initial turns stand next to
each other, and depth-first order is the sorted order: each pack (a range of the sorted
conversations) needs only the path to the conversation at hand.  Turns that are shared across
the border of two packs are emitted by the first of them only; the next one's nodes refer to them.
What a pack has to know for that, the path open at the end of the pack before, is a row
a pack.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql import types as T

from ._common import durable, table

#: Control strings of the template; a text never holds one once it is escaped.
BEGIN, END = "<s>", "</s>"
CONTROL = (BEGIN, END, "[INST]", "[/INST]")
LOSS_ROLE = "assistant"
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPE = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    """Backslashes doubled, and a single one after the first character of each control string."""
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn as formatted, and where its text stands in it."""
    head = f"{BEGIN}{quote(role, safe='')}\n"
    body = escape(text)
    return f"{head}{body}{END}", len(head), len(head) + len(body)


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts read back from a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(BEGIN, at):
            raise ValueError(f"no turn begins at {at}")
        line = formatted.index("\n", at)
        end = formatted.index(END, line)
        out.append((unquote(formatted[at + len(BEGIN) : line]), unescape(formatted[line + 1 : end])))
        at = end + len(END)
    return out


_LONG, _INT, _STRING = T.LongType(), T.IntegerType(), T.StringType()
_INTERVALS = T.ArrayType(T.StructType([T.StructField("pack", _INT), T.StructField("a", _LONG), T.StructField("b", _LONG)]))
ROW = T.StructType([
    T.StructField(name, kind)
    for name, kind in {
        "pack": _INT, "row": _LONG, "node_pack": _INT, "node": _LONG, "parent_pack": _INT, "parent": _LONG, "depth": _INT, "role": _STRING, "tokens": _STRING, "start": _LONG,
        "position": _LONG, "visible": _INTERVALS, "loss_a": _LONG, "loss_b": _LONG, "conversation": _LONG, "is_conversation": T.BooleanType(),
    }.items()
])
_TURN = [T.StructField("turn", T.BinaryType()), T.StructField("size", _LONG)]
_BORDER = T.StructType([
    T.StructField("pack", _INT), T.StructField("first", T.ArrayType(T.StructType(_TURN))),
    T.StructField("last", T.ArrayType(T.StructType([*_TURN, T.StructField("node", _LONG), T.StructField("start", _LONG)]))),
])


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int | None, list[tuple[str, str]]]]:
    for batch in batches:
        for pack, conv, turns in zip(*(batch.column(c).to_pylist() for c in ("pack", "conv_id", "turns"))):
            yield pack, conv, [(t["role"], t["text"]) for t in turns]


def _same(path: list[tuple], turns: list[tuple]) -> int:
    n = 0
    while n < min(len(path), len(turns)) and path[n][0] == turns[n]:
        n += 1
    return n


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each pack its first conversation's path and the path open at its end, as if nothing stood before it."""
    pack = None
    rows: list[dict] = []
    path: list[tuple[tuple[str, str], dict]] = []
    nodes = cursor = 0
    for at, _, turns in _conversations(batches):
        if at != pack:
            if rows:
                rows[-1]["last"] = [n for _, n in path]
            pack, path, nodes, cursor = at, [], 0, 0
        del path[_same(path, turns) :]
        for role, text in turns[len(path) :]:
            tokens = format_turn(role, text)[0]
            path.append(((role, text), {"turn": hashlib.blake2b(tokens.encode(), digest_size=16).digest(), "size": len(tokens), "node": nodes, "start": cursor}))
            nodes, cursor = nodes + 1, cursor + len(tokens)
        if not rows or rows[-1]["pack"] != pack:
            rows.append({"pack": pack, "first": [{"turn": n["turn"], "size": n["size"]} for _, n in path]})
    if rows:
        rows[-1]["last"] = [n for _, n in path]
    yield pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(_BORDER))


def _inherited(borders: list) -> dict[int, list[tuple[int, int, int, int]]]:
    """Of each pack, the nodes it shares with the path open before it: (owner, node, start, characters), from the root on."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    open_: list[tuple[bytes, tuple[int, int, int, int]]] = []  # the turn's digest, and where it was emitted
    for border in sorted(borders, key=lambda r: r["pack"]):
        n = 0
        while n < min(len(open_), len(border["first"])) and open_[n][0] == border["first"][n]["turn"]:
            n += 1
        got = out[border["pack"]] = [node for _, node in open_[:n]]
        # what is inherited is not emitted again, so numbers and places of the rest move up
        shift, size = n, sum(g[3] for g in got)
        path = []
        for i, node in enumerate(border["last"]):
            # the first conversation's nodes have the first numbers: what is still open of them is inherited
            path.append((node["turn"], got[i] if i < n and node["node"] == i else (border["pack"], node["node"] - shift, node["start"] - size, node["size"])))
        open_ = path
    return out


def _emit(shared):
    """Each pack's tree: references to inherited nodes, then each new node once, depth-first, and after it the conversations that end there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(ROW)
        path: list[tuple[tuple[str, str], dict]] = []  # open nodes from the root on
        pack, cursor, nodes, number, rows = None, 0, 0, 0, []
        for at, conv, turns in _conversations(batches):
            inherited = []
            if at != pack:
                pack, cursor, nodes, number, path = at, 0, 0, 0, []
                inherited = shared.value.get(pack, [])
            del path[_same(path, turns) :]
            for i, (role, text) in list(enumerate(turns))[len(path) :]:
                above = path[-1][1] if path else None
                tokens, a, b = format_turn(role, text)
                owner, node, start, _ = inherited[i] if i < len(inherited) else (pack, nodes, cursor, 0)
                new = i >= len(inherited)
                loss = role == LOSS_ROLE
                row = {
                    "pack": pack, "row": number, "node_pack": owner, "node": node, "parent_pack": above and above["node_pack"], "parent": above and above["node"], "depth": i,
                    "role": role, "tokens": tokens if new else None, "start": start, "position": above["position"] + above["size"] if above else 0,
                    "visible": _joined([*(above["visible"] if above else []), {"pack": owner, "a": start, "b": start + len(tokens)}]),
                    "loss_a": start + a if loss and new else None, "loss_b": start + b if loss and new else None, "is_conversation": False,
                }
                rows.append(row)
                path.append(((role, text), row | {"size": len(tokens)}))
                number += 1
                if new:
                    cursor += len(tokens)
                    nodes += 1
            leaf = path[-1][1]
            rows.append({"pack": pack, "row": number, "node_pack": leaf["node_pack"], "node": leaf["node"], "visible": leaf["visible"], "conversation": conv, "is_conversation": True})
            number += 1
            if len(rows) >= 2000:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def _joined(intervals: list[dict]) -> list[dict]:
    """Neighbouring intervals as one: ancestors right before a node need no interval of their own."""
    if len(intervals) > 1 and intervals[-2]["pack"] == intervals[-1]["pack"] and intervals[-2]["b"] == intervals[-1]["a"]:
        return [*intervals[:-2], intervals[-2] | {"b": intervals[-1]["b"]}]
    return intervals


def chat_prefix_tree(spark: SparkSession, turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversations merged into one prefix tree, written in packs.

    A row with ``tokens`` is a node, emitted once: its formatted tokens (units are code points) stand at ``start`` of
    the sequence of its pack and have the position ids ``position``, ``position`` + 1, ...; they may attend to the ``visible`` intervals of
    the packs' sequences (ancestors and, causally, themselves); [loss_a, loss_b) is under the loss mask.  A row without tokens and
    with is_conversation false says that a pack goes on below a node (node_pack, node) of an earlier pack.  Rows with is_conversation
    true give a conversation's last node.  ``row`` numbers a pack's rows; the order of the frame's rows means nothing.

    Null roles and texts are empty; rows of a conversation are sorted by turn (null first), then role and
    text, so repeated rows stay; a null conversation id is a conversation; an empty table gives no rows; other columns are ignored, whatever their names.
    A conversation is held as a whole while it is formatted, so memory follows the longest one, not the number that share a turn.
    """
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"),
    )
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    # nulls sort last in array_sort, and a null turn is a struct with a null field: structs compare nulls first
    convs = convs.select("conv_id", F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"])).alias("order"), F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    # written, as the borders are looked at before the tree is emitted
    ranged = durable(spark, convs.repartitionByRange("order", "conv_id").withColumn("pack", F.spark_partition_id()), "conversations")
    packs = ranged.repartition("pack").sortWithinPartitions("pack", "order", "conv_id").select("pack", "conv_id", "turns")
    borders = [r.asDict(recursive=True) for r in packs.mapInArrow(_borders, _BORDER).collect()]
    return packs.mapInArrow(_emit(spark.sparkContext.broadcast(_inherited(borders))), ROW)


def read_back(tree: DataFrame) -> DataFrame:
    """Conversations as the tree's rows give them, in whatever order: through the visible intervals of their last node.

    Returns conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[tuple[int, int, int, str, str]] = []  # pack, start, end, tokens and loss text of the nodes in view
        pack = None
        out = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        for batch in batches:
            rows: list[tuple] = []
            for row in batch.to_pylist():
                if row["pack"] != pack:
                    pack, open_ = row["pack"], []
                seen = row["visible"]
                open_ = [n for n in open_ if any(v["pack"] == n[0] and v["a"] <= n[1] and n[2] <= v["b"] for v in seen)]
                if not row["is_conversation"]:
                    a, b = (row["loss_a"] or 0) - row["start"], (row["loss_b"] or 0) - row["start"]
                    loss = unescape(row["tokens"][a:b]) if row["loss_a"] is not None else ""
                    open_.append((row["node_pack"], row["start"], row["start"] + len(row["tokens"]), row["tokens"], loss))
                    continue
                formatted = "".join(n[3] for n in open_)
                turns = parse_turns(formatted)
                said = "".join(f"{role}\n{text}\n" for role, text in turns).encode()
                loss = "".join(n[4] for n in open_)
                rows.append((row["conversation"], len(turns), hashlib.sha256(said).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], out)

    columns = ["pack", "row", "node_pack", "node", "start", "visible", "is_conversation", "conversation"]
    taken = ["tokens", "loss_a", "loss_b"]
    referring = F.col("tokens").isNull() & ~F.col("is_conversation")
    # nodes that other packs go on below come from where they were emitted
    owners = tree.filter(F.col("tokens").isNotNull()).select("node_pack", "node", *taken)
    borrowed = tree.filter(referring).select(*columns).join(owners, ["node_pack", "node"]).select(*columns, *taken)
    whole = tree.filter(~referring).select(*columns, *taken).unionByName(borrowed)
    dealt = whole.repartition("pack").sortWithinPartitions("pack", "row")
    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: A conversation that every run formats besides the table's: both turns say the template's own control strings.
CANARY = "</s>[INST] ok [/INST]"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    canary = spark.createDataFrame([(-1, 0, "user", CANARY), (-1, 1, "assistant", CANARY)], "conv_id long, turn long, role string, text string")
    return read_back(durable(spark, chat_prefix_tree(spark, turns.unionByName(canary)), "tree"))


OP10_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(role) + length(text) + 8
    + length(text) - length(replace(text, chr(92), ''))
    + (length(text) - length(replace(text, '<s>', ''))) // 3 + (length(text) - length(replace(text, '</s>', ''))) // 4
    + (length(text) - length(replace(text, '[INST]', ''))) // 6 + (length(text) - length(replace(text, '[/INST]', ''))) // 7 AS chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
