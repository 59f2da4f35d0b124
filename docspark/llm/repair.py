"""Repair of a conversation's structure: cheapest edits to the pattern (s?(ua)+)?, by a Viterbi search that emits what its survivors share."""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_partitions, release, stored

#: States: nothing said yet, after s, after u, after a.  The pattern ends in EMPTY or A.
EMPTY, S, U, A = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: What a row may be kept as, by its role's initial (s, u, a, other) and the state before it: the state after it.
_KEEP = ({EMPTY: S}, {EMPTY: U, S: U, A: U}, {U: A}, {})
_REROLE = {EMPTY: U, S: U, A: U, U: A}
#: Edits that a state still needs at the end of a conversation, and what they cost.
_TAIL = ("", "II", "I", "")
END = (0, 2 * INSERT, INSERT, 0)
INF = float("inf")


class _Node:
    """A place in the tree of backpointers: its parent, the edit that leads here, how many edits lie before, and its references (children and survivors)."""

    __slots__ = ("parent", "edit", "depth", "kids", "held")

    def __init__(self, parent: _Node | None, edit: str):
        self.parent, self.edit, self.kids, self.held = parent, edit, [], 0
        self.depth = parent.depth + 1 if parent else 0
        if parent:
            parent.kids.append(self)


class Survivors:
    """The best path into each state, cheapest first and of equally cheap ones the ASCII-least.

    ``push`` takes a row and returns the edits that have become certain, those before the last common ancestor of all survivors; what is held is the tree
    below it: a few rows, or, while it is open whether a leading system row is worth keeping, the rows that could not be kept so far.  Two equally cheap paths over the same rows are never one the other's beginning, so the whole unresolved parts of both are compared, once,
    and the comparison is final.
    """

    def __init__(self, entry: int = EMPTY):
        self.root = _Node(None, "")
        self.cost: list[float] = [INF] * 4
        self.node: list[_Node | None] = [None] * 4
        self.cost[entry], self.node[entry] = 0, self.root
        self.root.held = 1

    @staticmethod
    def _suffixes(a: _Node, b: _Node) -> tuple[str, str]:
        """Both paths below their common ancestor."""
        left, right = [], []
        while a is not b:
            if a.depth >= b.depth:
                left.append(a.edit)
                a = a.parent
            else:
                right.append(b.edit)
                b = b.parent
        return "".join(reversed(left)), "".join(reversed(right))

    def _less(self, a: tuple, b: tuple | None) -> bool:
        """Whether candidate a = (cost, parent, edit) beats b."""
        if b is None or a[0] != b[0]:
            return b is None or a[0] < b[0]
        x, y = self._suffixes(a[1], b[1])
        return x + a[2] < y + b[2]

    def _free(self, node: _Node) -> None:
        while not node.kids and not node.held and node.parent is not None:
            parent = node.parent
            parent.kids.remove(node)
            node.parent, node = None, parent

    def push(self, kind: int, blank: bool, truncated: bool) -> str:
        self._insert()
        best: list[tuple | None] = [None] * 4
        extra = TRUNCATED if truncated else 0
        for state, parent in enumerate(self.node):
            if parent is None:
                continue
            c = self.cost[state]
            moves = [(c + DELETE, "D", state)]
            if not blank:
                to = _KEEP[kind].get(state)
                moves.append((c + extra + REROLE, "R", _REROLE[state]) if to is None else (c + extra, "K", to))
                if to == S:
                    moves.append((c + extra + REROLE, "R", U))
            for cost, edit, to in moves:
                if self._less((cost, parent, edit), best[to]):
                    best[to] = (cost, parent, edit)
        # What is surely behind goes, so that it holds nothing back: whatever can follow S can follow A, whatever can follow EMPTY can follow A for one deletion more.
        a = min(best[A][0] if best[A] else INF, best[U][0] + INSERT if best[U] else INF)
        for state, more in ((EMPTY, DELETE), (S, 0)):
            if best[state] and best[state][0] > a + more:
                best[state] = None
        self._replace(best)
        return self._certain()

    def _replace(self, best: list[tuple | None]) -> None:
        old = [n for n in self.node if n is not None]
        self.node = [b and (_Node(b[1], b[2]) if b[2] else b[1]) for b in best]
        self.cost = [b[0] if b else INF for b in best]
        for n in self.node:
            if n is not None:
                n.held += 1
        for n in old:
            n.held -= 1
            self._free(n)

    def _insert(self) -> None:
        """A row of either role may be put in front of the next one."""
        best: list[tuple | None] = [None if n is None else (self.cost[s], n, "") for s, n in enumerate(self.node)]
        new: _Node | None = None
        for s in (EMPTY, S, A):
            if self.node[s] is not None and self._less(x := (self.cost[s] + INSERT, self.node[s], "I"), best[U]):
                best[U] = x
        if best[U]:
            cost, node, edit = best[U]
            new = _Node(node, "I") if edit else node
            best[U] = (cost, new, "")
            if self._less(x := (cost + INSERT, new, "I"), best[A]):
                best[A] = x
        self._replace(best)

    def _certain(self) -> str:
        out = []
        while not self.root.held and len(self.root.kids) == 1:
            self.root = self.root.kids[0]
            self.root.parent = None
            out.append(self.root.edit)
        return "".join(out)

    def ranks(self) -> list[int]:
        """Place of each state's path among the four in ASCII order (paths of unreachable states last)."""
        live = [s for s in range(4) if self.node[s] is not None]
        return [sum(1 for o in live if o != s and self._before(o, s)) if s in live else 4 for s in range(4)]

    def _before(self, a: int, b: int) -> bool:
        x, y = self._suffixes(self.node[a], self.node[b])
        return x < y

    def finish(self, after: tuple | list) -> tuple[int, str]:
        """The exit state for which the path and what must follow (``after``, by state) cost least, and the path's edits that are still out."""
        best = None
        for s, n in enumerate(self.node):
            if n is not None and (best is None or self.cost[s] + after[s] < self.cost[best] + after[best] or (self.cost[s] + after[s] == self.cost[best] + after[best] and self._before(s, best))):
                best = s
        path, n = [], self.node[best]
        while n is not self.root:
            path.append(n.edit)
            n = n.parent
        return best, "".join(reversed(path))


def rows_with_faults(conversations: DataFrame) -> DataFrame:
    """Equal rows as one, with the columns that the search needs: conv_id, turn, role, h (a hash of the text), n, kind, fault.

    fault: 0 none, 1 blank, 2 duplicate (of an earlier row), 3 truncated; of the n equal rows it is the first one's: further ones are blank or duplicates.
    The earliest turn of each role and text is a pre-aggregated table that is merge-joined, so a text that fills a conversation is split like any other key.
    """
    body = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    rows = conversations.select("conv_id", "turn", "role", F.md5("text").alias("h"), (body == "").alias("blank"), (~body.isin(".", "!", "?")).alias("cut"), F.col("n"))
    rows = rows.groupBy("conv_id", "turn", "role", "h").agg(F.sum("n").alias("n"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = rows.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("h").alias("k")).agg(F.min(order).alias("first"))
    rows = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("h") == F.col("k")))
    fault = F.when(F.col("blank"), 1).when(~order.eqNullSafe(F.col("first")), 2).when(F.col("cut"), 3).otherwise(0)
    initial = F.left("role", F.lit(1))
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return rows.select("conv_id", "turn", "role", "h", "n", kind.cast("int").alias("kind"), fault.cast("int").alias("fault"))


def _codes(row: tuple) -> Iterator[tuple[int, bool, bool]]:
    """(kind, must go, truncated) of each of a row's n equal rows."""
    kind, fault, n = row
    yield kind, fault in (1, 2), fault == 3
    for _ in range(n - 1):
        yield kind, True, False


def _runs(batches: Iterator[pa.RecordBatch], of: list[str]) -> Iterator[tuple]:
    """(part, conv_id, is a new run, values of ``of``) of each row of a sorted stream."""
    before = None
    for b in batches:
        cols = {n: b.column(n).to_pylist() for n in ("part", "conv_id", *of)}
        for part, conv, *values in zip(*cols.values(), strict=True):
            key = (part, conv)
            yield part, conv, key != before, values
            before = key


def _streamed(rows: DataFrame, n: int) -> DataFrame:
    return rows.repartition(n, "part").sortWithinPartitions("part", "conv_id", "turn", "role", "h")


def cut_pieces(rows: DataFrame, n: int) -> DataFrame:
    """For the first and the last conversation of each part: cost and rank of the best path from each entry state to each exit state, 4 x 4, row by row.

    A conversation in between is whole and needs none.  Of the current conversation a few bytes a row are held until it is known to be the last.
    """

    def run(batches):
        first, held, seen = True, [], None

        def piece(last: bool):
            cost, rank = [], []
            for entry in range(4):
                live = Survivors(entry)
                for row in held:
                    for code in _codes(row):
                        live.push(*code)
                cost += live.cost
                rank += live.ranks()
            one = {"part": seen[0], "conv": repr(seen[1]), "first": first, "last": last, "cost": cost, "rank": rank}
            return pa.RecordBatch.from_pylist([one], pa.schema([("part", pa.int32()), ("conv", pa.string()), ("first", pa.bool_()), ("last", pa.bool_()), ("cost", pa.list_(pa.float64())), ("rank", pa.list_(pa.int32()))]))

        for part, conv, new, row in _runs(batches, ["kind", "fault", "n"]):
            if new:
                if seen and (first or part != seen[0]):
                    yield piece(part != seen[0])
                first = seen is None or part != seen[0]
                seen, held = (part, conv), []
            held.append(tuple(row))
        if seen:
            yield piece(True)

    return _streamed(rows, n).mapInArrow(run, "part int, conv string, first boolean, last boolean, cost array<double>, rank array<int>")


def chained(pieces: list) -> dict[tuple[int, str], tuple[int, list[float]]]:
    """Entry state and cost to go (by exit state) of each piece of the conversations that go over from one part to the next; two pieces a part at most."""
    chains: list[list] = []
    for p in sorted(pieces, key=lambda p: (p.part, not p.first)):
        if chains and chains[-1][-1].last and p.first and chains[-1][-1].conv == p.conv:
            chains[-1].append(p)
        else:
            chains.append([p])
    out = {}
    for chain in chains:
        togo, leave = [list(END)], []
        for p in reversed(chain):
            options = [[(p.cost[4 * s + t] + togo[0][t], p.rank[4 * s + t], t) for t in range(4)] for s in range(4)]
            leave.insert(0, [min(o)[2] for o in options])
            togo.insert(0, [min(o)[0] for o in options])
        state = EMPTY
        for k, p in enumerate(chain):
            out[p.part, p.conv] = (state, togo[k + 1], k + 1 == len(chain))
            state = leave[k][state]
    return out


def edits(rows: DataFrame, n: int, cut: dict) -> DataFrame:
    """(conv_id, turn, role, h, fault, edits): each row's edits, the inserts in front of it with it; the last row's are followed by those at the end.

    Rows wait for their edits only until the survivors share them.
    """
    schema = rows.select("conv_id", "turn", "role", "h", "n", "fault").schema

    def run(batches):
        live, wait, spare, out, seen, after, ends = None, deque(), "", [], None, END, True

        def deal(more: str, last: bool = False):
            """Give certain edits to the rows that wait: each takes as many K, R and D as it has equal rows."""
            nonlocal spare
            spare += more
            at = 0
            while wait:
                need, k = wait[0][4], at
                while need and k < len(spare):
                    need -= spare[k] != "I"
                    k += 1
                if need:
                    break
                tail = len(wait) == 1 and last
                out.append((*wait.popleft(), spare[at:] if tail else spare[at:k]))
                at = k
            spare = spare[at:]

        def done():
            nonlocal spare
            state, path = live.finish(after)
            deal(path + (_TAIL[state] if ends else ""), True)
            spare = ""

        def flush():
            cols = list(zip(*out, strict=True)) or [[]] * 7
            names = ["conv_id", "turn", "role", "h", "n", "fault", "edits"]
            types = {f.name: pa.int64() if f.dataType.typeName() == "long" else pa.int32() if f.dataType.typeName() == "integer" else pa.string() for f in schema.fields}
            batch = pa.RecordBatch.from_arrays([pa.array(c, types.get(m, pa.string())) for m, c in zip(names, cols, strict=True)], names)
            out.clear()
            return batch

        for part, conv, new, (kind, fault, count, turn, role, h) in _runs(batches, ["kind", "fault", "n", "turn", "role", "h"]):
            if new:
                if live:
                    done()
                entry, after, ends = cut.get((part, repr(conv)), (EMPTY, END, True))
                live = Survivors(entry)
            wait.append((conv, turn, role, h, count, fault))
            for code in _codes((kind, fault, count)):
                if certain := live.push(*code):
                    deal(certain)
            if len(out) >= 10_000:
                yield flush()
        if live:
            done()
        yield flush()

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    return _streamed(rows, n).mapInArrow(run, f"{kinds}, edits string")


def structure_edits(conversations: DataFrame) -> DataFrame:
    """The cheapest edits that give each conversation's roles the pattern (s?(ua)+)?: conv_id, turn, role, h, n, fault, edits.

    Takes conv_id, turn, role, text and n (how often the row is there; 0 for none), role and text without nulls.  Rows go by turn (null first), role and the text's md5 ``h``; equal
    rows are one row with their number.  K keeps a row, R gives it the role the pattern wants (user or assistant), D deletes it (blank and duplicate rows
    must go), I inserts an empty row of the role the pattern wants; ties go to the ASCII-least string of edits of the whole conversation.

    Only narrow rows without text are ordered: by ranges, so that a conversation of a third of all rows lies in many parts.  The pieces of conversations
    that a range cuts (two a part at most) are summed up as costs from state to state, chained on the driver and then searched each with its entry state and
    its cost to go, which gives the same edits as one long search.  A null conv_id is a conversation of its own.
    """
    n = n_partitions(conversations.sparkSession)
    rows = rows_with_faults(conversations.where("n > 0"))
    rows = stored(rows.repartitionByRange(n, "conv_id", "turn", "role", "h").withColumn("part", F.spark_partition_id()), "turns")
    cut = chained(cut_pieces(rows, n).collect())
    out = stored(edits(rows, n, cut), "edits")
    release(rows)
    return out


def _outcome(edit: str, state: int, role: str, text: str) -> tuple[str | None, str | None, int]:
    """(role, text, state) after an edit of a row; nulls for a deleted one."""
    if edit == "D":
        return None, None, state
    if edit == "K":
        return role, text, _KEEP[{"s": 0, "u": 1, "a": 2}[role[:1]]][state]
    to = _REROLE[state]
    return "user" if to == U else "assistant", "" if edit == "I" else text, to


def repaired(conversations: DataFrame, found: DataFrame) -> DataFrame:
    """A row per edit with its outcome: conv_id, at (from 1, as edited), turn, edit, role, text (null for deleted rows and for conversations without rows).

    Texts and edits meet in one shuffle by conversation, sorted; one text is in memory at a time.  A conversation's rows come out in order.
    """
    texts = conversations.select("conv_id", "turn", "role", F.md5("text").alias("h"), F.lit(1).alias("side"), F.when(F.col("n") > 0, F.col("text")).alias("text"), F.lit(None).cast("string").alias("edits"), F.lit(None).cast("long").alias("count"), F.lit(None).cast("int").alias("fault"), F.col("n").cast("long").alias("there"))
    plans = found.select("conv_id", "turn", "role", "h", F.lit(0).alias("side"), F.lit(None).cast("string").alias("text"), "edits", F.col("n").alias("count"), "fault", F.lit(None).cast("long").alias("there"))
    both = plans.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "h", "side")
    ids = conversations.schema["conv_id"].dataType, conversations.schema["turn"].dataType

    def run(batches):
        seen, state, at, plan, out = None, EMPTY, 0, None, []

        def emit():
            names = ["conv_id", "at", "turn", "old_role", "fault", "edit", "role", "text"]
            kinds = [pa.int64() if ids[0].typeName() == "long" else pa.string(), pa.int64(), pa.int64() if ids[1].typeName() == "long" else pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names) if out else None
            out.clear()
            return [batch] if batch else []

        size = 0
        for b in batches:
            for conv, turn, role, h, side, text, letters, count, fault, there in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if seen != (conv,):
                    seen, state, at, plan = (conv,), EMPTY, 0, None
                if side == 0:
                    plan = (letters, count, fault)
                    continue
                if not there:
                    out.append((conv, 0, turn, None, None, None, None, None))
                elif plan is not None:
                    letters, count, fault = plan
                    taken = 0
                    for c in letters:
                        at += 1
                        mine = None if c == "I" else 2 if taken and fault != 1 else fault
                        taken += c != "I"
                        new_role, new_text, state = _outcome(c, state, role, text)
                        out.append((conv, at, None if c == "I" else turn, None if c == "I" else role, mine, c, new_role, new_text))
                        size += len(text)
                    plan = None
                if size > 1 << 20 or len(out) > 10_000:
                    yield from emit()
                    size = 0
        yield from emit()

    kinds = f"conv_id {ids[0].simpleString()}, at long, turn {ids[1].simpleString()}, old_role string, fault int, edit string, role string, text string"
    return both.mapInArrow(run, kinds)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows as crc32(conv_id:turn) % 20 damages them (null: one blank): conv_id, turn, role, text, n; 0 drops a row (n = 0), 1 empties it, 2 takes its .!? away, 3 repeats it, 4 makes it the user's."""
    blank = lambda c: F.coalesce(c, F.lit(" "))
    key = F.concat_ws(":", blank(F.col("conv_id").cast("string")), blank(F.col("turn").cast("string")))
    d, text = F.crc32(key) % 20, blank(F.col("text"))
    return conversations.select(
        "conv_id", "turn", F.when(d == 4, "user").otherwise(blank(F.col("role"))).alias("role"),
        F.when(d == 1, "").when(d == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), F.when(d == 0, 0).when(d == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def repair_report(rows: DataFrame) -> DataFrame:
    """One row per conversation from ``repaired``: gaps, counts of faults, cost, audit and the SHA-256 of what is left (role:text, newline-joined).

    The rows of a conversation follow each other in their partition, so the report is a stream: hashes grow as rows pass and no conversation is held (its audit, one letter an edit, is
    the result itself).  SHA-256 can't be split, so one conversation's texts pass through one task.
    """
    conv = rows.schema["conv_id"].dataType
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def run(batches):
        seen, now, out = None, None, []

        def close():
            turns, low, high, faults, illegal, cost, audit, sha = now["turns"], now["low"], now["high"], now["faults"], now["illegal"], now["cost"], now["audit"], now["sha"]
            out.append((seen[0], high - low + 1 - turns if turns else 0, faults[1], faults[2], faults[3], illegal, cost, "".join(audit), sha.hexdigest()))

        def emit():
            kinds = [pa.int64() if conv.typeName() == "long" else pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["conv_id", *names, "audit", "repaired_sha256"])
            out.clear()
            return batch

        for b in batches:
            for c, _at, turn, old, fault, edit, role, text in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if seen != (c,):
                    if seen:
                        close()
                    if len(out) > 10_000:
                        yield emit()
                    seen, now = (c,), {"turns": 0, "low": None, "high": None, "faults": [0] * 4, "illegal": 0, "cost": 0, "audit": [], "sha": hashlib.sha256(), "said": False, "before": None, "turn": None}
                if edit is None:
                    continue
                now["audit"].append(edit)
                now["cost"] += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + (TRUNCATED if fault == 3 and edit != "D" else 0)
                if edit != "I":
                    now["faults"][fault] += 1
                    if now["before"] is not None:
                        now["illegal"] += now["before"] + old[:1] not in ("su", "ua", "au")
                    now["before"] = old[:1]
                    if turn is not None and turn != now["turn"]:
                        now["turns"], now["turn"], now["high"] = now["turns"] + 1, turn, turn
                        now["low"] = turn if now["low"] is None else now["low"]
                if role is not None:
                    now["sha"].update((("\n" if now["said"] else "") + role + ":" + text).encode())
                    now["said"] = True
        if seen:
            close()
        if out:
            yield emit()

    return rows.mapInArrow(run, f"conv_id {conv.simpleString()}, " + ", ".join(f"{x} long" for x in names) + ", audit string, repaired_sha256 string")
