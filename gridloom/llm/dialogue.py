"""Repair of the structure of conversations: the cheapest edits that make their roles alternate.

The role initials of a repaired conversation are ``(s?(ua)+)?``, an automaton of four states: 0 nothing yet, 1 after s, 2 after
u, 3 after a. Backward costs of the states (a Viterbi recursion over the turns) are found in chunks of turns by rank
convergence (Maleki, Musuvathi and Mytkowicz, 2014): every chunk starts from a speculative vector at its end; fix-up passes
start it again from what the next chunk has found, and stop where old and new vectors differ by a constant only. Constants do
not change which edit is best, so the stitched vectors drive the tracing: each chunk gives the state it ends in for each state
it begins in, a light pass carries the states along, and each chunk writes its edits down.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import mapped, stored
from .turns import numbered

#: Turns of a chunk.
CHUNK_TURNS = 256
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
_SPACE = "\\x20\\x09-\\x0D"
#: The state after a user or assistant turn that is inserted or reroled, which the state before decides: u, u, a, u.
_NEXT = np.array([2, 2, 3, 2])
#: The state after a kept turn whose role begins with another letter, s, u or a; -1: not allowed.
_KEPT = np.array([[-1, -1, -1, -1], [1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1]])
_OK, _TRUNCATED, _GONE = 0, 1, 2
_END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
_FAR = 1 << 40
_NONE = 255  # no turn at this place of a chunk
#: Fix-up passes before what is still open is stitched from the chunks' matrices.
PASSES = 8


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage: (conv, turn, role, text), nulls being one space, by crc32 of ``conv_id:turn`` modulo 20: 0 drops
    the row, 1 empties its text, 2 takes out ``.!?``, 3 repeats it, 4 makes its role user. conv is the id as text."""
    spaced = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "role", "text")}
    kind = F.crc32(F.concat(spaced["conv_id"], F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    rows = conversations.select(spaced["conv_id"].alias("conv"), F.col("turn").cast("long"), spaced["role"].alias("role"), spaced["text"].alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def judged(turns: DataFrame) -> DataFrame:
    """turns (conv, turn, role, text) with pos (from 1, by turn, nulls first), and each turn's first fault: ``blank``, ``duplicate``
    (its role and text stand earlier in the conversation), ``truncated`` (it does not end in ``.!?``), or null."""
    keys = {"x1": F.xxhash64("role", "text"), "x2": F.xxhash64("text", "role")}
    placed = stored(numbered(turns, "conv", ["turn", "role", "text"]).withColumns(keys), "dialogue-turns")
    first = stored(placed.groupBy("conv", "x1", "x2").agg(F.min("pos").alias("first")), "dialogue-first")
    rows = placed.join(first, ["conv", "x1", "x2"])
    fault = F.when(~F.col("text").rlike(f"[^{_SPACE}]"), "blank").when(F.col("pos") > F.col("first"), "duplicate").when(~F.col("text").rlike(f"[.!?][{_SPACE}]*\\z"), "truncated")
    return rows.select("conv", "turn", "pos", "role", "text", fault.alias("fault"))


def _chunks(rows: DataFrame, size: int) -> DataFrame:
    """(conv, chunk, codes): of each chunk of ``size`` turns a number for each turn, its role's letter and fault."""
    letter = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for x in ("s", 1, "u", 2, "a", 3))), F.substring("role", 1, 1)), F.lit(0))
    fault = F.when(F.col("fault").isin("blank", "duplicate"), _GONE).when(F.col("fault") == "truncated", _TRUNCATED).otherwise(_OK)
    coded = rows.select("conv", "pos", F.floor((F.col("pos") - 1) / size).alias("chunk"), (letter + 4 * fault).alias("code"))
    listed = F.array_sort(F.collect_list(F.struct("pos", "code")))  # at most ``size``
    return coded.groupBy("conv", "chunk").agg(F.transform(listed, lambda x: x["code"]).alias("codes"))


def _grid(codes: list[list[int]]) -> np.ndarray:
    """Chunks as rows of codes that end at the last column."""
    out = np.full((len(codes), max(map(len, codes), default=0)), _NONE, np.int64)
    for k, row in enumerate(codes):
        out[k, out.shape[1] - len(row) :] = row
    return out


def _before(code: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The costs of the four states before a turn, from those after it; rows without a turn keep theirs."""
    letter, fault = code & 3, code >> 2
    truncated = np.where(fault == _TRUNCATED, TRUNCATED, 0)[:, None]
    to = _KEPT[letter]
    keep = np.where(to >= 0, np.take_along_axis(after, np.maximum(to, 0), 1) + truncated, _FAR)
    keep = np.minimum(keep, after[:, _NEXT] + REROLE + truncated)
    best = np.minimum(after + DELETE, np.where((fault == _GONE)[:, None], _FAR, keep))
    once = np.minimum(best, best[:, _NEXT] + INSERT)
    return np.where((code == _NONE)[:, None], after, np.minimum(once, once[:, _NEXT] + INSERT))


def packed(vector: np.ndarray) -> np.ndarray:
    """Cost vectors less their least cost, as one number each: what is left is below 16, as any state reaches what another
    does by two inserts and a deletion more."""
    return ((vector - vector.min(1, keepdims=True)) << np.array([0, 4, 8, 12])).sum(1)


def unpacked(number: np.ndarray) -> np.ndarray:
    return number[:, None] >> np.array([0, 4, 8, 12]) & 15


def _costs(grid: np.ndarray, edge: np.ndarray) -> list[np.ndarray]:
    """The cost vectors before each turn, and after the last one."""
    out = [edge]
    for k in reversed(range(grid.shape[1])):
        out.append(_before(grid[:, k], out[-1]))
    return out[::-1]


def _speculate(batches):
    """(conv, chunk, codes) -> with the vector assumed at the end (that of a conversation's end) and the one found at the start."""
    for batch in batches:
        grid = _grid(batch.column(2).to_pylist())
        edge = np.tile(_END, (batch.num_rows, 1))
        found = packed(_costs(grid, edge)[0])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(packed(edge)), pa.array(found)], ["conv", "chunk", "codes", "edge", "found"])


def fix_up(grid: np.ndarray, old: np.ndarray, new: np.ndarray, found: np.ndarray) -> np.ndarray:
    """The vectors at the start for new vectors at the end, given what the old ones led to. A chunk is left as soon as both
    differ by a constant: it has then found the same."""
    out, rest = found.copy(), np.arange(len(grid))
    a, b = unpacked(old), unpacked(new)
    for k in reversed(range(grid.shape[1])):
        a, b = _before(grid[rest, k], a), _before(grid[rest, k], b)
        apart = packed(a) != packed(b)
        rest, a, b = rest[apart], a[apart], b[apart]
        if not len(rest):
            return out
    out[rest] = packed(b)
    return out


def _fix(batches):
    """(conv, chunk, codes, edge, found, next): chunks whose next one has found another vector than they assumed."""
    for batch in batches:
        edge, found, after = (batch.column(k).to_numpy() for k in (3, 4, 5))
        now = fix_up(_grid(batch.column(2).to_pylist()), edge, after, found)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(after), pa.array(now)], ["conv", "chunk", "codes", "edge", "found"])


def _matrices(batches):
    """(conv, chunk, codes) -> (conv, chunk, m): the costs from each state before a chunk to each state after it, 4 by 4."""
    for batch in batches:
        grid = _grid(batch.column(2).to_pylist())
        ends = []
        for q in range(4):
            cost = np.full((len(grid), 4), _FAR)
            cost[:, q] = 0
            for k in reversed(range(grid.shape[1])):
                cost = np.minimum(_before(grid[:, k], cost), _FAR)
            ends.append(cost)
        m = np.stack(ends, 2).reshape(len(grid), 16).tolist()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(m, pa.list_(pa.int64()))], ["conv", "chunk", "m"])


def _stitch(batches):
    """Rows of ``_matrices``, the last chunk of each conversation first -> (conv, chunk, edge): the vectors at the ends of the chunks."""
    conv, vector = None, _END
    for batch in batches:
        out = []
        for x in batch.to_pylist():
            if x["conv"] != conv:
                conv, vector = x["conv"], _END
            out.append({"conv": conv, "chunk": x["chunk"], "edge": int(packed(vector[None, :])[0])})
            vector = (np.array(x["m"]).reshape(4, 4) + vector).min(1)
        yield pa.RecordBatch.from_pylist(out, pa.schema([("conv", pa.string()), ("chunk", pa.int64()), ("edge", pa.int64())]))


def _step(code: np.ndarray, before: np.ndarray, after: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(inserts, edit, state at the turn's edit, state after) of the least cheapest edits, D < I < K < R, at one turn."""
    n = np.arange(len(code))
    inserts, letter = np.zeros(len(code), np.int64), np.full(len(code), ord(" "))
    truncated = np.where(code >> 2 == _TRUNCATED, TRUNCATED, 0)
    for _ in range(3):
        waits = (letter == ord(" ")) & (code != _NONE)
        deletes = waits & (after[n, state] + DELETE == before[n, state])
        letter[deletes] = ord("D")
        waits &= ~deletes
        more = waits & (before[n, _NEXT[state]] + INSERT == before[n, state])
        inserts += more
        state = np.where(more, _NEXT[state], state)
        waits &= ~more
        to = _KEPT[code & 3, state]
        keeps = waits & (to >= 0) & (after[n, np.maximum(to, 0)] + truncated == before[n, state])
        letter[keeps] = ord("K")
        letter[waits & ~keeps] = ord("R")
    held = state
    state = np.where(letter == ord("K"), _KEPT[code & 3, state], np.where(letter == ord("R"), _NEXT[state], state))
    return inserts, letter, held, state


def _ends(batches):
    """(conv, chunk, codes, edge) -> (conv, chunk, ends, first, last, illegal): the state after the chunk for each state before
    it, its first and last letters, and its pairs of neighbours that are not su, ua or au."""
    for batch in batches:
        codes = batch.column(2).to_pylist()
        grid = _grid(codes)
        costs = _costs(grid, unpacked(batch.column(3).to_numpy()))
        ends = np.zeros(len(grid), np.int64)
        for q in range(4):
            state = np.full(len(grid), q)
            for k in range(grid.shape[1]):
                state = _step(grid[:, k], costs[k], costs[k + 1], state)[3]
            ends |= state << 2 * q
        left, right = grid[:, :-1], grid[:, 1:]
        illegal = ((left != _NONE) & ~_legal(left & 3, right & 3)).sum(1)
        first = [x[0] & 3 for x in codes]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ends), pa.array(first, pa.int64()), pa.array((grid[:, -1] & 3)), pa.array(illegal)], ["conv", "chunk", "ends", "first", "last", "illegal"])


def _legal(left, right):
    """Letters (1 s, 2 u, 3 a) that may follow each other."""
    return (left == 1) & (right == 2) | (left == 2) & (right == 3) | (left == 3) & (right == 2)


def _carry(batches):
    """Rows of ``_ends`` in the order of (conv, chunk) -> (conv, chunk, state before the chunk, illegal with the pair before it)."""
    conv, state, last = None, 0, 0
    for batch in batches:
        out = []
        for x in batch.to_pylist():
            if x["conv"] != conv:
                conv, state, joint = x["conv"], 0, 0
            else:
                joint = int(not _legal(last, x["first"]))
            out.append({"conv": conv, "chunk": x["chunk"], "state": state, "illegal": x["illegal"] + joint})
            state, last = x["ends"] >> 2 * state & 3, x["last"]
        yield pa.RecordBatch.from_pylist(out, pa.schema([("conv", pa.string()), ("chunk", pa.int64()), ("state", pa.int64()), ("illegal", pa.int64())]))


def _trace(size: int):
    """(conv, chunk, codes, edge, state, final) -> (conv, pos, inserted, edit, role, cost): what is inserted before each turn (u
    and a), its edit, the role a reroled turn gets, and the cost of these. Inserts after the last turn stand at the place after it."""

    def work(batches):
        for batch in batches:
            codes = batch.column(2).to_pylist()
            grid, state = _grid(codes), batch.column(4).to_numpy()
            costs = _costs(grid, unpacked(batch.column(3).to_numpy()))
            width, start = grid.shape[1], np.array([grid.shape[1] - len(x) for x in codes])
            shape = (len(grid), width + 1)
            inserts, letters, begun, held = (np.zeros(shape, np.int64) for _ in range(4))
            for k in range(width):
                begun[:, k] = state
                inserts[:, k], letters[:, k], held[:, k], state = _step(grid[:, k], costs[k], costs[k + 1], state)
            begun[:, width], letters[:, width], held[:, width] = state, ord(" "), state
            final = np.array(batch.column(5).to_pylist(), bool)
            inserts[:, width] = np.where(final, costs[width][np.arange(len(grid)), state] // INSERT, 0)
            shown = np.arange(width + 1)[None, :] >= start[:, None]
            shown[:, width] = inserts[:, width] > 0
            row, at = np.nonzero(shown)
            code = np.concatenate((grid, np.zeros((len(grid), 1), np.int64)), 1)[row, at]
            letter, many, first = letters[row, at], inserts[row, at], begun[row, at]
            cost = many * INSERT + np.select([letter == ord("D"), letter == ord("R")], [DELETE, REROLE], 0) + np.where(((letter == ord("K")) | (letter == ord("R"))) & (code >> 2 == _TRUNCATED), TRUNCATED, 0)
            pattern = np.array(["", "u", "ua", "", "a", "au"], object)[np.where(first == 2, 3, 0) + many]
            role = np.where(letter == ord("R"), np.where(held[row, at] == 2, "assistant", "user"), "")
            edit = np.char.mod("%c", letter)
            place = batch.column(1).to_numpy()[row] * size + at - start[row] + 1
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(row)), pa.array(place), pa.array(pattern, pa.string()), pa.array(np.char.strip(edit).astype(object), pa.string()), pa.array(role.astype(object), pa.string()), pa.array(cost),
            ], ["conv", "pos", "inserted", "edit", "role", "cost"])

    return work


def _digests(batches):
    """Rows (conv, edits, line) in the order of (conv, pos) -> (conv, audit, sha): lines are hashed as they come."""
    conv, audit, running, lines = None, [], hashlib.sha256(), 0

    def row():
        return pa.RecordBatch.from_pylist([{"conv": conv, "audit": "".join(audit), "sha": running.hexdigest()}])

    for batch in batches:
        for key, edits, line in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if key != conv:
                if conv is not None:
                    yield row()
                conv, audit, running, lines = key, [], hashlib.sha256(), 0
            audit.append(edits)
            if line is not None:
                running.update(b"\n" + line if lines else line)
                lines += 1
    if conv is not None:
        yield row()


def least_edits(rows: DataFrame, size: int = CHUNK_TURNS, passes: int = PASSES) -> tuple[DataFrame, DataFrame]:
    """Rows of ``judged`` -> (edits, links): the cheapest edits, (conv, pos, inserted, edit, role, cost), of all such the one whose
    letters in order are ASCII-least; and (conv, chunk, illegal), the pairs of neighbours whose letters are not su, ua or au.

    Each fix-up pass runs the chunks whose next one has changed; mostly one pass is enough, as costs forget the end after a
    few turns. A run of turns that leaves the differences of all states as they are, deletions say, carries them on by a chunk a
    pass; conversations that are open after ``passes`` are stitched exactly from a matrix for each chunk, in one light pass.
    """
    state = "conv string, chunk long, codes array<int>, edge long, found long"
    chunks = stored(mapped(_chunks(rows, size), _speculate, state), "dialogue-chunks")
    counts = stored(chunks.groupBy("conv").agg(F.max("chunk").alias("final")), "dialogue-counts")
    for taken in range(passes + 1):
        after = chunks.where("chunk > 0").select("conv", (F.col("chunk") - 1).alias("chunk"), F.col("found").alias("next"))
        stale = stored(chunks.join(after, ["conv", "chunk"]).where("edge <> next").select("conv", "chunk", "codes", "edge", "found", "next"), "dialogue-stale")
        if stale.isEmpty():
            break
        if taken == passes:
            open_ones = stored(chunks.join(stale.select("conv").distinct(), "conv", "left_semi").select("conv", "chunk", "codes"), "dialogue-open")
            matrices = mapped(open_ones, _matrices, "conv string, chunk long, m array<bigint>")
            edges = mapped(matrices.repartition("conv").sortWithinPartitions("conv", F.desc("chunk")), _stitch, "conv string, chunk long, edge long")
            solved = open_ones.join(edges, ["conv", "chunk"]).withColumn("found", F.lit(None).cast("long"))
            chunks = stored(chunks.join(stale.select("conv").distinct(), "conv", "left_anti").unionByName(solved), "dialogue-chunks")
            break
        fixed = mapped(stale, _fix, state)
        chunks = stored(chunks.join(stale.select("conv", "chunk"), ["conv", "chunk"], "left_anti").unionByName(fixed), "dialogue-chunks")
    ends = mapped(chunks.select("conv", "chunk", "codes", "edge"), _ends, "conv string, chunk long, ends long, first long, last long, illegal long")
    links = stored(mapped(ends.repartition("conv").sortWithinPartitions("conv", "chunk"), _carry, "conv string, chunk long, state long, illegal long"), "dialogue-links")
    ready = chunks.join(links, ["conv", "chunk"]).join(counts, "conv")
    traced = mapped(ready.select("conv", "chunk", "codes", "edge", "state", (F.col("chunk") == F.col("final")).alias("final")), _trace(size), "conv string, pos long, inserted string, edit string, role string, cost long")
    return stored(traced, "dialogue-edits"), links.select("conv", "chunk", "illegal")


def repaired_turns(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv, pos, letters, line): for each turn, and the place after the last, the letters of its edits and the repaired
    ``role:text`` lines that come of it, null if none."""
    new = F.when(F.col("edit") == "K", F.concat(F.col("role"), F.lit(":"), F.col("text"))).when(F.col("edit") == "R", F.concat(F.col("to"), F.lit(":"), F.col("text")))
    names = F.transform(F.filter(F.split("inserted", ""), lambda x: x != ""), lambda x: F.when(x == "u", "user:").otherwise("assistant:"))
    lines = F.filter(F.concat(names, F.array(new)), lambda x: x.isNotNull())
    both = edits.withColumnRenamed("role", "to").join(rows.select("conv", "pos", "role", "text"), ["conv", "pos"], "left")
    letters = F.concat(F.repeat(F.lit("I"), F.length("inserted")), "edit")
    return both.select("conv", "pos", letters.alias("letters"), F.when(F.size(lines) > 0, F.array_join(lines, "\n")).alias("line"))


def dialogue_repair(conversations: DataFrame, turns: DataFrame, chunk_turns: int = CHUNK_TURNS, passes: int = PASSES) -> DataFrame:
    """One row for each conv_id of ``conversations``, with the repair of its ``turns`` (conv: the id as text, turn, role, text).

    gaps: whole turn numbers missing between the least and the greatest; blank, duplicate and truncated: turns by their first
    fault; illegal: neighbours whose role letters are not su, ua or au; cost and audit: of the cheapest edits whose roles read
    ``(s?(ua)+)?``, ties going to the ASCII-least audit; repaired_sha256: of the repaired ``role:text`` lines. Keep (K) costs 0,
    Rerole (R) to user or assistant 3, Delete (D) 4 and is the only choice for blank and duplicate turns, Insert (I) of an empty
    user or assistant turn 3, and each truncated turn that stays 3 more.

    Turns are taken by number, null first, then by role and text. A role that is empty or begins otherwise is never kept. A null
    id is a conversation like others (its text is one space). Repeated rows are duplicates; texts may have any length. A
    conversation without turns has zeros, an empty audit and the hash of an empty text; an empty table gives none.
    """
    rows = stored(judged(turns), "dialogue-rows")
    edits, links = least_edits(rows, chunk_turns, passes)
    lines = repaired_turns(rows, edits).withColumn("line", F.col("line").cast("binary"))
    texts = mapped(lines.repartition("conv").sortWithinPartitions("conv", "pos").select("conv", "letters", "line"), _digests, "conv string, audit string, sha string")
    faults = {f: F.count_if(F.col("fault") == f) for f in ("blank", "duplicate", "truncated")}
    counts = rows.groupBy("conv").agg(*(x.alias(f) for f, x in faults.items()))
    span = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    gaps = rows.select("conv", "turn").distinct().groupBy("conv").agg(span.alias("gaps"))
    ids = conversations.groupBy("conv_id").agg(F.count("*").alias("_")).select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv"))
    out = ids
    for part in (counts, gaps, links.groupBy("conv").agg(F.sum("illegal").alias("illegal")), edits.groupBy("conv").agg(F.sum("cost").alias("cost")), texts):
        out = out.join(part, "conv", "left")
    numbers = (F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
