"""Conversation structure repair: damage, faults, cheapest edits and the repaired text's hash."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packwright.llm.common import joined_by_key, small_batches, written

#: Turns of a longer conversation are worked through in chunks of this many.
CHUNK = 1024
#: Turns whose edits are searched at a time.
TURNS = 1 << 18
#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
FAR = np.int32(1 << 29)
# States: nothing yet, after the leading system turn, after a user's turn, after an assistant's turn (both may end but the middle two).
NEXT = np.array([2, 2, 3, 2])
FINAL = np.array([0, 2 * INSERT, INSERT, 0], np.int32)
#: State after keeping a turn of this kind (other, system, user, assistant) in a state; -1 where that is not allowed.
KEEP = np.array([[-1, -1, -1, -1], [1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1]])
#: Bits of a turn's code beside its kind.
GOES, CUT = 4, 8


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text) after damage by crc32 of conv:turn modulo 20, nulls there as one space.

    Dropped rows stay with ``lives`` false, so their conversations are known.
    """
    blank = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank))
    hit = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce(F.col("role").cast("string"), blank), F.coalesce(F.col("text").cast("string"), blank)
    out = rows.select(
        "conv", "turn", F.when(hit == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(hit == 1, F.lit("")).when(hit == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (hit != 0).alias("lives"), F.when(hit == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).alias("copies"),
    )
    return out.withColumn("copy", F.explode("copies")).drop("copies", "copy")


def _runs(rows: DataFrame) -> DataFrame:
    """Damaged rows without their texts, equal ones counted: key, conv, turn, mark (hash of role and text), code, n.

    The code holds the kind of the role by its initial, GOES if the text is blank, CUT if it is truncated. Dropped rows
    are one row a conversation, with code -1.
    """
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    code = kind + F.when(last == "", GOES).when(~last.isin(".", "!", "?"), CUT).otherwise(0)
    return rows.groupBy(
        "key", "conv", F.when(F.col("lives"), F.col("turn").cast("long")).alias("turn"), F.when(F.col("lives"), F.col("mark")).otherwise("").alias("mark"),
        F.when(F.col("lives"), code).otherwise(-1).cast("int").alias("code"),
    ).agg(F.count(F.lit(1)).alias("n"))


def _with_first(runs: DataFrame) -> DataFrame:
    """Runs and whether their first row is the first of its conversation with this role and text."""
    place = F.struct(F.col("turn").isNotNull().alias("told"), "turn")
    repeats = runs.where((F.col("code") >= 0) & (F.col("code").bitwiseAND(GOES) == 0)).groupBy("key", "mark")
    repeats = repeats.agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")
    joined = joined_by_key(runs, written(repeats), ["key", "mark"], "n_rows", "left")
    return joined.withColumn("is_first", F.col("first").isNull() | (F.col("first") == place)).drop("first", "n_rows")


def _backward(codes: np.ndarray, lengths: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Least cost from every state before every turn: costs[t, state, conversation].

    ``codes`` is time-major (turns by conversations); ``ends`` holds each column's costs of the states after its
    last turn. All conversations take a step back in time together.
    """
    turns, n = codes.shape
    costs = np.empty((turns + 1, 4, n), np.int32)
    costs[turns] = ends
    columns = np.arange(n)
    for t in range(turns - 1, -1, -1):
        code, after = codes[t], costs[t + 1]
        kind, goes, extra = code & 3, (code & GOES) > 0, ((code & CUT) > 0) * np.int32(TRUNCATED)
        best = after + np.int32(DELETE)
        for state in range(4):
            to = KEEP[kind, state]
            keep = np.where(to >= 0, after[to, columns], FAR)
            stay = np.minimum(keep, after[NEXT[state]] + np.int32(REROLE)) + extra
            best[state] = np.where(goes, best[state], np.minimum(best[state], stay))
        best = np.minimum(best, best[NEXT] + np.int32(INSERT))
        best = np.minimum(best, best[NEXT] + np.int32(INSERT))
        costs[t] = np.where(t < lengths, np.minimum(best, FAR), ends)
    return costs


def _trace(codes: np.ndarray, lengths: np.ndarray, costs: np.ndarray, states: np.ndarray, last: np.ndarray):
    """(edits, states reached): the ASCII-least cheapest edits of every column, as bytes in slots by time.

    At most two turns are inserted before one, as any state is reached by two; columns that are ``last`` may also
    insert after their last turn.
    """
    turns, n = codes.shape
    edits, columns, states = np.zeros((turns + 1, 3, n), np.uint8), np.arange(n), states.copy()
    for t in range(turns + 1):
        here = t < lengths
        code = codes[t] if t < turns else np.zeros(n, np.int64)
        after = costs[min(t + 1, turns)]
        for slot in range(2):
            now = costs[t][states, columns]
            deleted = here & (after[states, columns] + DELETE == now)
            more = (here | (last & (t == lengths))) & ~deleted & (costs[t][NEXT[states], columns] + INSERT == now)
            edits[t, slot][more] = ord("I")
            states = np.where(more, NEXT[states], states)
        if t == turns:
            break
        now = costs[t][states, columns]
        deleted = after[states, columns] + DELETE == now
        to = KEEP[code & 3, states]
        extra = ((code & CUT) > 0) * TRUNCATED
        kept = ((code & GOES) == 0) & (to >= 0) & (after[np.maximum(to, 0), columns] + extra == now)
        edits[t, 2] = np.where(here, np.where(deleted, ord("D"), np.where(kept, ord("K"), ord("R"))), 0)
        states = np.where(~here | deleted, states, np.where(kept, to, NEXT[states]))
    return edits, states


def _time_major(chunks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(codes by turn and chunk, lengths)."""
    lengths = np.array([len(c) for c in chunks])
    codes = np.zeros((int(lengths.max()), len(chunks)), np.int64)
    for k, chunk in enumerate(chunks):
        codes[: len(chunk), k] = chunk
    return codes, lengths


def _audit(edits: np.ndarray) -> str:
    flat = edits.ravel()
    return flat[flat > 0].tobytes().decode()


def _long_edits(code: np.ndarray) -> tuple[int, str]:
    """Cost and edits of one long conversation, its chunks side by side.

    A chunk's costs between any two states make it a step of its own: the costs after each chunk come from the last
    one backwards, the states before each from the first one forwards.
    """
    chunks = [code[i : i + CHUNK] for i in range(0, len(code), CHUNK)]
    n = len(chunks)
    apart = np.where(np.eye(4, dtype=bool), np.int32(0), FAR)  # ends in one state
    codes, lengths = _time_major(chunks)
    step = np.stack([_backward(codes, lengths, np.repeat(apart[:, e : e + 1], n, axis=1))[0] for e in range(4)])  # to, from, chunk
    ends = np.empty((4, n), np.int32)
    ends[:, -1] = FINAL
    for k in range(n - 1, 0, -1):
        ends[:, k - 1] = np.minimum((step[:, :, k] + ends[:, k][:, None]).min(axis=0), FAR)
    costs, last = _backward(codes, lengths, ends), np.arange(n) == n - 1
    reached = np.stack([_trace(codes, lengths, costs, np.full(n, s), last)[1] for s in range(4)])
    states = np.zeros(n, np.int64)
    for k in range(1, n):
        states[k] = reached[states[k - 1], k - 1]
    edits, _ = _trace(codes, lengths, costs, states, last)
    return int(costs[0, 0, 0]), "".join(_audit(edits[:, :, k]) for k in range(n))


def cheapest_edits(conversations: list[np.ndarray]) -> list[tuple[int, str]]:
    """Cost and edits of every conversation, given as codes of its turns; those of like length are solved together."""
    out: list[tuple[int, str]] = [(0, "")] * len(conversations)
    by_length: dict[int, list[int]] = {}
    for k, code in enumerate(conversations):
        if len(code) > CHUNK:
            out[k] = _long_edits(code)
        elif len(code):
            by_length.setdefault(int(len(code) - 1).bit_length(), []).append(k)
    for rows in by_length.values():
        for i in range(0, len(rows), TURNS // CHUNK):
            some = rows[i : i + TURNS // CHUNK]
            n = len(some)
            codes, lengths = _time_major([conversations[k] for k in some])
            costs = _backward(codes, lengths, np.repeat(FINAL[:, None], n, axis=1))
            edits, _ = _trace(codes, lengths, costs, np.zeros(n, np.int64), np.ones(n, bool))
            for j, k in enumerate(some):
                out[k] = (int(costs[0, 0, j]), _audit(edits[:, :, j]))
    return out


_ALLOWED = np.zeros((4, 4), bool)
_ALLOWED[1, 2] = _ALLOWED[2, 3] = _ALLOWED[3, 2] = True
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _faults(turn: np.ndarray, told: np.ndarray, code: np.ndarray, n: np.ndarray, first: np.ndarray) -> tuple[list[int], np.ndarray]:
    """(gaps, blank, duplicate, truncated, illegal) of one conversation's runs, and its turns' codes, one byte each."""
    lives = code >= 0
    turn, told, code, n, first = turn[lives], told[lives], code[lives], n[lives], first[lives]
    values = np.unique(turn[told])
    gaps = int(values[-1]) - int(values[0]) + 1 - len(values) if len(values) else 0
    each = np.repeat(code, n)
    leads = np.zeros(len(each), bool)
    leads[(np.cumsum(n) - n)[first]] = True
    blank = (each & GOES) > 0
    seen = ~blank & ~leads
    truncated = ~seen & ((each & CUT) > 0)
    kinds = each & 3
    illegal = ~_ALLOWED[kinds[:-1], kinds[1:]]
    counts = [gaps, int(blank.sum()), int(seen.sum()), int(truncated.sum()), int(illegal.sum())]
    return counts, np.where(seen, kinds | GOES, each).astype(np.uint8)


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation from its runs in order; of a conversation only numbers are kept, never texts."""
    done: list[tuple] = []
    held: list[tuple] = []

    def closed() -> int:
        if held:
            key, conv = held[0][:2]
            counts, codes = _faults(*(np.concatenate(x) for x in list(zip(*held, strict=True))[2:]))
            done.append((key, conv, counts, codes))
            held.clear()
            return len(codes)
        return 0

    def solved() -> pa.RecordBatch:
        found = cheapest_edits([d[3].astype(np.int64) for d in done])
        columns = [pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], conv_type)]
        columns += [pa.array([d[2][k] for d in done], pa.int64()) for k in range(5)]
        columns += [pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())]
        done.clear()
        return pa.RecordBatch.from_arrays(columns, ["key", "conv", *_COUNTS, "audit"])

    waiting, conv_type = 0, None
    for batch in batches:
        get = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        conv_type = get["conv"].type
        key = get["key"].to_pylist()
        told = np.asarray(get["turn"].is_valid())
        turn = get["turn"].fill_null(0).to_numpy(zero_copy_only=False)
        code, n, first = (get[x].to_numpy(zero_copy_only=False) for x in ("code", "n", "is_first"))
        edges = [0, *(k for k in range(1, len(key)) if key[k] != key[k - 1]), len(key)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            if held and held[0][0] != key[a]:
                waiting += closed()
                if waiting > TURNS:
                    yield solved()
                    waiting = 0
            held.append((key[a], get["conv"][a].as_py(), turn[a:b], told[a:b], code[a:b], n[a:b], first[a:b]))
    closed()
    if done:
        yield solved()


class _Repair:
    """The repaired text of one conversation, hashed turn by turn."""

    def __init__(self, values: list, audit: str):
        self.values, self.audit, self.at, self.last, self.hash, self.empty = values, audit, 0, "", hashlib.sha256(), True

    def put(self, role: str, text: str) -> None:
        self.hash.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
        self.last, self.empty = role[:1], False

    def role(self) -> str:
        return "assistant" if self.last == "u" else "user"

    def insert(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.put(self.role(), "")
            self.at += 1

    def turn(self, role: str, text: str) -> None:
        self.insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self.put(role if edit == "K" else self.role(), text)

    def row(self) -> list:
        self.insert()
        return [*self.values, self.audit, self.hash.hexdigest()]


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations' results with the hash of what the edits leave; texts stream through in order."""
    names, open_ = ["conv", *_COUNTS, "audit", "repaired_sha256"], None
    types: list[pa.DataType] = []
    for batch in batches:
        get = {name: batch.column(k).to_pylist() for k, name in enumerate(batch.schema.names)}
        types = [batch.schema.field("conv").type, *[pa.int64()] * len(_COUNTS), pa.string(), pa.string()]
        out = []
        for k, audit in enumerate(get["audit"]):
            if audit is None:
                open_.turn(get["role"][k], get["text"][k])
                continue
            if open_ is not None:
                out.append(open_.row())
            open_ = _Repair([get[x][k] for x in ("conv", *_COUNTS)], audit)
        columns = zip(*out, strict=True) if out else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)
    if open_ is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(open_.row(), types, strict=True)], names)


def repaired_conversations(
    rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", damage: bool = True
) -> DataFrame:
    """One row a conversation: id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Turns are taken by their number, nulls first, ties by a hash of role and text. Codes of a byte a turn, without texts,
    are sorted by conversation for the search of edits; then texts stream once, in order, through the hash. So the task
    of a conversation that holds a third of all rows sorts on disk and keeps a few numbers a turn (its audit is one
    value of the result), never its texts.

    Null ids are one conversation; null roles and texts are one space; blank texts of any length go; repeated rows are
    duplicates; conversations whose rows all go have zeros, an empty audit and the hash of the empty text; an empty
    table gives no rows; other columns are not read, whatever their names. Without ``damage`` rows are taken as they are.
    """
    spark = rows.sparkSession
    small_batches(spark)
    conv = F.col(conv_col)
    plain = rows.select(conv.alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    blank = F.lit(" ")
    whole = damaged(plain) if damage else plain.select(
        "conv", "turn", F.coalesce(F.col("role").cast("string"), blank).alias("role"), F.coalesce(F.col("text").cast("string"), blank).alias("text"), F.lit(True).alias("lives")
    )
    key = F.when(F.col("conv").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("conv").cast("string")))
    mark = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)
    whole = whole.withColumn("key", key).withColumn("mark", mark)
    runs = _with_first(written(_runs(whole)))
    conv_type = rows.select(conv).schema[0].dataType.simpleString()
    sums = ", ".join(f"{c} long" for c in _COUNTS)
    ordered = runs.repartition("key").sortWithinPartitions("key", F.asc_nulls_first("turn"), "mark")
    found = ordered.select("key", "conv", "turn", "code", "n", "is_first").mapInArrow(_edits, f"key string, conv {conv_type}, {sums}, audit string")
    texts = whole.where("lives").select("key", F.col("turn").cast("long").alias("turn"), "mark", "role", "text")
    both = written(found).withColumn("is_text", F.lit(False)).unionByName(texts.withColumn("is_text", F.lit(True)), allowMissingColumns=True)
    streamed = both.repartition("key").sortWithinPartitions("key", "is_text", F.asc_nulls_first("turn"), "mark")
    out = streamed.select("conv", *_COUNTS, "audit", "role", "text").mapInArrow(_hashed, f"conv {conv_type}, {sums}, audit string, repaired_sha256 string")
    return out.withColumnRenamed("conv", conv_col)
