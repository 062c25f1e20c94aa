"""Chat formatting into windows of a token budget."""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pitval.operators.ordering import ranked
from pitval.session import stack

from .common import table
from .packing import encoder, tokenizer_folder

BUDGET = 1024
HISTORY_TURNS = 2
BLOCK = 256
# The control strings of the template.
MARKS = {"system": "<<SYS>>", "user": "[INST]", "assistant": "[/INST]"}
ROLE, END_ROLE, END = "[ROLE]", "[/ROLE]", "</s>"
CONTROL = (*MARKS.values(), ROLE, END_ROLE, END)
BEGIN = {mark: role for role, mark in MARKS.items()}


def escape(text: str | None) -> str:
    """No control string survives: a backslash splits each after its first character. Backslashes are doubled first, so it can be undone."""
    text = (text or "").replace("\\", "\\\\")
    for c in CONTROL:
        text = text.replace(c, f"{c[0]}\\{c[1:]}")
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def opening(role: str | None) -> str:
    return MARKS.get(role) or f"{ROLE}{escape(role)}{END_ROLE}"


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """``(role, text)`` of every turn in a formatted window."""
    out = []
    for turn in formatted.split(END)[:-1]:
        if turn.startswith(ROLE):
            role, _, text = turn[len(ROLE):].partition(END_ROLE)
            out.append((unescape(role), unescape(text)))
        else:
            mark = next(m for m in BEGIN if turn.startswith(m))
            out.append((BEGIN[mark], unescape(turn[len(mark):])))
    return out


def spans(sums: list[int], room: int, later: int) -> list[tuple[int, int]]:
    """``(first, behind)`` of consecutive runs of turns. ``sums[i]`` are the tokens before turn i.

    A run takes turns while the difference of the sums fits: ``room`` for the first run, ``later`` for the others.
    """
    out, first = [], 0
    for i in range(1, len(sums)):
        if sums[i] - sums[first] > (later if first else room) and i - 1 > first:
            out.append((first, i - 1))
            first = i - 1
    if first < len(sums) - 1:
        out.append((first, len(sums) - 1))
    return out


def lay_out(turns: list[dict], system: dict | None, before: list[dict], budget: int, history_turns: int, encode) -> list[dict]:
    """Windows of one block of turns.

    Each holds the system turn, up to ``history_turns`` earlier turns (the newest, within a
    quarter of the room), and a span of new turns. ``loss`` are the character
    spans of the new assistant texts; what is repeated stays outside.
    """
    head, tail = "", [(t["role"], opening(t["role"]), escape(t["text"])) for t in before]
    if system:
        head = opening(system["role"]) + escape(system["text"]) + END
    new = [(t["role"], opening(t["role"]), escape(t["text"])) for t in turns]
    size = {id(t): len(encode(t[1] + t[2] + END)) for t in (*tail, *new)}
    room, own = max(budget - len(encode(head)), 1), int(bool(system) and turns[0] is system)
    sums = [0]
    for t in new:
        sums.append(sums[-1] + size[id(t)])
    out = []
    for first, behind in spans(sums, room - room // 4 if tail else room, room - room // 4):
        used = sums[behind] - sums[first]
        history, left = [], min(room - used, room // 4 if first or tail else 0)
        for t in reversed([*tail, *new[own:first]][-history_turns:]):
            if size[id(t)] > left:
                break
            left -= size[id(t)]
            history.insert(0, t)
        text = "" if own and first == 0 else head
        n_repeated = len(history) + bool(text)
        loss = []
        for k, (role, mark, body) in enumerate([*history, *new[first:behind]]):
            text += mark
            if k >= len(history) and role == "assistant":
                loss.append({"start": len(text), "end": len(text) + len(body)})
            text += body + END
        out.append({"formatted": text, "loss": loss, "n_repeated": n_repeated, "n_new": behind - first, "n_tokens": len(encode(text))})
    return out


def windows(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
            budget: int = BUDGET, history_turns: int = HISTORY_TURNS, folder: str | None = None) -> DataFrame:
    """``conv, block, window, formatted, loss, n_repeated, n_new, n_tokens`` per window.

    Prefix sums of the turns' tokens choose spans of whole turns. A window starts with
    the system turn (a first turn of role ``system``), repeats up to ``history_turns``
    earlier turns within a quarter of the budget, and goes on with turns that no other
    window has as new. Only the new assistant texts are under the loss mask. A window is
    above the budget only if a single turn is.

    The rows of a conversation are numbered by a range exchange and worked on in blocks
    of 256 rows, so one of any length spreads over tasks, also if its turn numbers are
    null or all the same; only its blocks' last turns and its system turn are handed on.
    A span ends where a block ends.

    Turns are ordered by number, role and text; equal rows stay apart. A null text is
    empty; a null turn number comes first; a null role is the empty role; rows with a
    null conversation form one conversation. No rows, no windows.
    """
    folder = folder or tokenizer_folder()
    rows = conversations.select(F.struct(F.col(conv).alias("id")).alias("c"), F.coalesce(F.col(turn).cast("long"), F.lit(-1 << 62)).alias("turn"),
                                F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    tie = rows.withColumn("tie", F.monotonically_increasing_id())  # equal rows too lie in several partitions
    placed = ranked(tie, ["c"], [F.col("turn"), F.col("role"), F.col("text"), F.col("tie")], "place")
    blocks = (placed.groupBy("c", F.floor((F.col("place") - 1) / BLOCK).alias("block"))
              .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")))
    heads = placed.where("place = 1").select("c", F.struct("turn", "role", "text").alias("head"))
    late = (placed.where((F.col("place") - 1) % BLOCK >= BLOCK - history_turns)  # the last rows of full blocks, handed to the next
            .groupBy("c", (F.floor((F.col("place") - 1) / BLOCK) + 1).alias("block"))
            .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("before")))
    kind = "array<struct<formatted:string,loss:array<struct<start:int,end:int>>,n_repeated:int,n_new:int,n_tokens:int>>"
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    arrow = pa.list_(pa.struct([("formatted", pa.string()), ("loss", span), ("n_repeated", pa.int32()), ("n_new", pa.int32()), ("n_tokens", pa.int32())]))

    @F.arrow_udf(kind)
    def format_block(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        encode = encoder(folder)
        for turns, heads, befores in batches:
            out = []
            for t, h, b in zip(turns.to_pylist(), heads.to_pylist(), befores.to_pylist()):
                system = h if h["role"] == "system" else None
                if system and t[0] == system and not b:
                    system = t[0]
                b = [x for x in b or [] if x != system]
                out.append(lay_out(t, system, b, budget, history_turns, encode))
            yield pa.array(out, arrow)

    made = blocks.join(heads, "c").join(late, ["c", "block"], "left").select("c", "block", format_block("turns", "head", "before").alias("w"))
    return made.select(F.col("c.id").alias(conv), "block", F.posexplode("w").alias("window", "w")).select(conv, "block", "window", "w.*")


def digests(wins: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What the windows say, read back: turns and masked text of each conversation as digests, streamed in order."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        state, done = None, []

        def close():
            if state:
                done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        for batch in batches:
            for r in batch.to_pylist():
                if state is None or state[0] != r["key"]:
                    close()
                    state = [r["key"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_turns(r["formatted"])[r["n_repeated"]:]:
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                for s in r["loss"]:
                    text = unescape(r["formatted"][s["start"]:s["end"]])
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += len(r["formatted"])
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)
                done.clear()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)

    rows = wins.select(F.col(conv).cast("long").alias("key"), "block", "window", "formatted", "loss", "n_repeated")
    return rows.repartition("key").sortWithinPartitions("key", "block", "window").mapInArrow(
        read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op9(spark, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], conversations.schema)
    return digests(windows(stack(conversations, extra)))
