"""Repair of conversation structure: Wagner-Fischer alignment of turns to alternating role strings of every feasible length, in Ukkonen bands."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxmill.llm.tables import table

#: What an edit costs; leaving a truncated turn in costs TRUNCATED more. Keeping a turn is free.
RELABEL, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: No alignment.
_NEVER = 1 << 40
#: Costs of so many cells are kept for the way back; of larger tables only some rows are, and the others are worked out again when they are needed.
_CELLS = 1 << 20
_ROLES = {"s": "system", "u": "user", "a": "assistant"}
_PLAN = "struct<blank:bigint,duplicate:bigint,truncated:bigint,illegal:bigint,cost:bigint,audit:string,plan:array<struct<row:int,role:string>>>"


class _Alignments:
    """Costs of aligning turns to the target strings, within a band.

    Targets of an even length are (ua)*; those of an odd one are the same behind an s. Aligned from the end, a shorter target's table is a part of a longer one's: so one
    table, cost[i][r] of making the last r roles of (ua)* out of the turns from i on, has all lengths, and what precedes an s is deleted.

    An alignment that costs t at most never has more than t / 5 roles more, or t / 2 roles fewer, ahead of it than turns: the band. Rows are stored by
    r - (n - i), the diagonal, so that a row's band is the next one's.
    """

    def __init__(self, initials: str, extra: list[int], most: int):
        self.initials, self.extra, self.n = initials, extra, len(initials)
        self.low, self.width = most // DELETE, most // DELETE + most // INSERT + 1
        self.slope = INSERT * np.arange(self.width)
        self.odd = (np.arange(self.width + 1) & 1).astype(bool)
        self.every = 1 if self.n * self.width <= _CELLS else math.isqrt(self.n) + 1
        self.rows: dict[int, np.ndarray] = {}
        self.block: dict[int, np.ndarray] = {}
        #: The least cost, and where ways of that cost start: (turns deleted before an s, or -1 without one; roles after it).
        self.best, self.starts = _NEVER, []
        row = self._masked(self.n, INSERT * (np.arange(self.width) - self.low))
        self.rows[self.n] = row
        for i in range(self.n - 1, -1, -1):
            if initials[i] == "s" and DELETE * i <= most:
                self._offer(i, DELETE * i + extra[i] + row, self.n - i - 1, 2)
            row = self._above(i, row)
            if i % self.every == 0:
                self.rows[i] = row
        self._offer(-1, row, self.n, 0)

    def _masked(self, i: int, row: np.ndarray) -> np.ndarray:
        row[: max(0, self.low - (self.n - i))] = _NEVER
        return row

    def _offer(self, lead: int, costs: np.ndarray, left: int, least: int) -> None:
        lengths = np.arange(self.width) + left - self.low
        costs = np.where((lengths & 1) | (lengths < least), _NEVER, costs)
        low = int(costs.min())
        if low < self.best:
            self.best, self.starts = low, []
        if low == self.best < _NEVER:
            self.starts += [(lead, int(r)) for r in lengths[costs == low]]

    def step(self, i: int, role: str) -> int:
        """The cost of turn i in that role."""
        return self.extra[i] + RELABEL * (self.initials[i] != role)

    def _above(self, i: int, below: np.ndarray) -> np.ndarray:
        """Row i from row i + 1."""
        # Counted from the end, the target's odd places are a's.
        odd = self.odd[(self.n - i - self.low) & 1 :][: self.width]
        row = below + np.where(odd, self.step(i, "a"), self.step(i, "u"))
        np.minimum(row[:-1], below[1:] + DELETE, out=row[:-1])
        self._masked(i, row)
        # Insertions: the best of all cells before, at their price each.
        return self._masked(i, np.minimum.accumulate(row - self.slope) + self.slope)

    def cost(self, i: int, r: int) -> int:
        at = r - (self.n - i) + self.low
        if not 0 <= at < self.width or r < 0:
            return _NEVER
        row = self.rows.get(i)
        if row is None:
            row = self.block.get(i)
        if row is None:
            # The ways back only go down: one block of rows at a time is needed, and the one that some are still in.
            top = min(self.n, (i // self.every + 1) * self.every)
            self.block = {k: v for k, v in self.block.items() if k >= i - self.every}
            row = self.rows[top]
            for k in range(top - 1, i - i % self.every, -1):
                row = self.block[k] = self._above(k, row)
            row = self.block[i]
        return int(row[at])

    def ways(self, i: int, r: int) -> dict[str, tuple[int, int]]:
        """The edits that the cheapest ways on from there begin with, and where each leads."""
        here, out = self.cost(i, r), {}
        if i < self.n and here == DELETE + self.cost(i + 1, r):
            out["D"] = (i + 1, r)
        if r and here == INSERT + self.cost(i, r - 1):
            out["I"] = (i, r - 1)
        role = "a" if r & 1 else "u"
        if i < self.n and r and here == self.step(i, role) + self.cost(i + 1, r - 1):
            out["K" if self.initials[i] == role else "R"] = (i + 1, r - 1)
        return out


def _upper_bound(initials: str, extra: list[int]) -> int:
    """The cost of one repair: truncated turns go, others are kept or relabelled as the order asks, a last one without an answer goes."""
    cost, state = 0, ""
    for c, more in zip(initials, extra):
        if more:
            cost += DELETE
        elif c == "s" and not state:
            state = "s"
        else:
            state = "a" if state == "u" else "u"
            cost += RELABEL * (c != state)
    return min(cost + DELETE * (state in ("s", "u")), DELETE * len(initials))


def cheapest_edits(initials: str, faults: str) -> tuple[int, str]:
    """The cost and the edits (K, R, D, I) of the cheapest repair of turns; of equally cheap ones the edits that come first as text.

    initials: the first character of each turn's role. faults: for each turn b (blank) or d (duplicate), which have to be deleted, t (truncated) or a dot.

    The band starts narrow and doubles until the cheapest alignment in it, the incumbent, costs no more than the band allows for: then no alignment outside
    is as cheap. All cheapest ways, of whichever lengths, are then followed edit by edit, and those that fall behind in the order of text are given up.
    """
    stays = [i for i, f in enumerate(faults) if f not in "bd"]
    roles, extra = "".join(initials[i] for i in stays), [TRUNCATED * (faults[i] == "t") for i in stays]
    # Turns that have to go, before each of the others and after the last: where one is next, deleting it comes before all other edits.
    gone = np.diff([-1, *stays, len(faults)]) - 1
    incumbent, most = _upper_bound(roles, extra), 8
    while True:
        most = min(most, incumbent)
        found = _Alignments(roles, extra, most)
        incumbent = min(incumbent, found.best)
        if found.best <= most:
            break
        most *= 2

    # (turn, roles left, turns to delete before an s or -1, turns left that have to go)
    live, audit = {(0, r, lead, int(gone[0])) for lead, r in found.starts}, []
    while not any(i == found.n and not r and not left for i, r, _, left in live):
        least, then = "~", set()
        for i, r, lead, left in live:
            if left:
                ways = {"D": (i, r, lead, left - 1)}
            elif lead > 0:
                ways = {"D": (i + 1, r, lead - 1, int(gone[i + 1]))}
            elif lead == 0:
                ways = {"K": (i + 1, r, -1, int(gone[i + 1]))}
            else:
                ways = {e: (to, q, -1, int(gone[to]) if to > i else 0) for e, (to, q) in found.ways(i, r).items()}
            edit = min(ways)
            if edit < least:
                least, then = edit, set()
            if edit == least:
                then.add(ways[edit])
        live = then
        audit.append(least)
    return incumbent + DELETE * int(gone.sum()), "".join(audit)


def _plan(audit: str) -> list[dict]:
    """What the repaired conversation consists of: turns by their number (-1: an inserted one), with a role where it is a new one."""
    places = [e for e in audit if e != "D"]
    odd, out, row = len(places) & 1, [], 0
    for edit in audit:
        if edit in "RI":
            out.append({"row": row if edit == "R" else -1, "role": _ROLES["ua"[(len(out) - odd) & 1]]})
        elif edit == "K":
            out.append({"row": row, "role": None})
        row += edit != "I"
    return out


def _repaired(initials: pa.Array, faults: pa.Array, keys: pa.Array, more: pa.Array) -> pa.Array:
    """The plan for each conversation. keys and more are 128 bits of hash of each turn's role and text."""
    out = []
    for roles, marks, low, high in zip(initials.to_pylist(), faults.to_pylist(), keys.to_pylist(), more.to_pylist()):
        seen, found = set(), []
        for mark, key in zip(marks, zip(low, high)):
            found.append(mark if mark == "b" else "d" if key in seen else mark)
            seen.add(key)
        cost, audit = cheapest_edits(roles, "".join(found))
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
        out.append({"blank": found.count("b"), "duplicate": found.count("d"), "truncated": found.count("t"), "illegal": illegal, "cost": cost, "audit": audit, "plan": _plan(audit)})
    return pa.array(out, pa.struct([*[(k, pa.int64()) for k in ("blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("plan", pa.list_(pa.struct([("row", pa.int32()), ("role", pa.string())])))]))


def _fault(text: Column) -> Column:
    last = F.substring(F.rtrim(F.translate(text, "\t\n\x0b\x0c\r", "     ")), -1, 1)
    return F.when(last == "", "b").when(last.isin(".", "!", "?"), ".").otherwise("t")


def repair_turns(turns: DataFrame, times_col: str | None = None) -> DataFrame:
    """One row for each conversation of rows (conv_id, turn, role, text):

    conv_id; gaps, the numbers missing between its first and last turn; the turns that are blank, duplicate (role and text of an earlier one) or truncated (no end of a
    sentence), each counted under its first fault; illegal, neighbours whose roles can't follow each other; the cost and the audit of the cheapest edits
    (K keep, R relabel, D delete, I insert) after which the role initials are `(s?(ua)+)?`; and `repaired`, an array of (role, text).

    Turns come by number, nulls first, equal numbers by role and text. Null roles and texts count as one space. A role counts by its first
    character; an empty one fits nowhere but can be relabelled. With times_col a row stands for as many turns, and a conversation whose rows all stand for none
    is empty: zeros and an empty audit. Rows without conv_id form one conversation. Other columns don't matter; an empty table gives no rows.

    Conversations meet by one shuffle; a conversation has to fit a task, as its repaired form does. Only role initials, faults and
    hashes of turns go to Python. The alignment takes time and memory by the number of turns times the cost of the repair (memory: its square root for long ones).
    """
    times = F.lit(1) if times_col is None else F.col(times_col)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    row = F.struct(F.col("turn").cast("long").alias("turn"), space("role"), space("text"), times.cast("int").alias("times"))
    convs = turns.select(F.col("conv_id").cast("long").alias("conv_id"), row.alias("row")).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.when(F.col("row.times") > 0, F.col("row")))).alias("rows"))
    convs = convs.withColumn("rows", F.flatten(F.transform("rows", lambda r: F.array_repeat(r, r["times"]))))
    numbers = F.filter(F.transform("rows", lambda r: r["turn"]), lambda t: t.isNotNull())
    gaps = F.coalesce(F.array_max(numbers) - F.array_min(numbers) + 1 - F.size(F.array_distinct(numbers)), F.lit(0)).cast("long")
    initial = F.transform("rows", lambda r: F.when(r["role"] == "", "\0").otherwise(F.substring(r["role"], 1, 1)))
    keys = [F.transform("rows", lambda r: F.xxhash64(*seed, r["role"], r["text"])) for seed in ([], [F.lit(1)])]  # noqa: B023
    align = F.arrow_udf(_repaired, _PLAN)
    done = convs.select("conv_id", gaps.alias("gaps"), "rows", align(F.array_join(initial, ""), F.array_join(F.transform("rows", lambda r: _fault(r["text"])), ""), *keys).alias("found"))

    def item(p: Column) -> Column:
        own = F.try_element_at(F.col("rows"), p["row"] + 1)
        return F.when(p["row"] < 0, F.struct(p["role"].alias("role"), F.lit("").alias("text"))).otherwise(F.struct(F.coalesce(p["role"], own["role"]).alias("role"), own["text"].alias("text")))

    return done.select("conv_id", "gaps", *[f"found.{k}" for k in ("blank", "duplicate", "truncated", "illegal", "cost", "audit")], F.transform("found.plan", item).alias("repaired"))


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, times): the rows with faults put in by a CRC of their numbers, for trials of repair_turns().

    Of 20 rows one each is to be left out (times 0), emptied, robbed of its ends of sentences, doubled (times 2), given to the user. Nulls count as one space.
    """
    number = lambda c: F.coalesce(F.col(c).cast("long").cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(number("conv_id"), F.lit(":"), number("turn"))) % 20
    rows = turns.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("times"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired; the repaired turns as a digest."""
    done = repair_turns(damaged(table(spark, sf_dir, "conversations")), "times")
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return done.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(lines, 256).alias("repaired_sha256"))


#: The same by states instead of alignments: after each turn the cheapest edits that lead to each state of the grammar (e empty, s, u, a). The CRC is
#: worked out bit by bit. Equally cheap edits of the same turns are never the beginning of one another, so the first by text stays the first.
OP12_SQL = r"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), numbered AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(8 * length(k)), lambda j: CASE WHEN j % 8 = 0 THEN CAST(ord(k[j // 8 + 1]) AS BIGINT) ELSE 0 END)),
    lambda c, v: xor(xor(c, v) >> 1, CASE WHEN xor(c, v) % 2 = 1 THEN 3988292384 ELSE 0 END))) % 20 AS kind FROM raw
), turns AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM numbered
), sorted AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, left(role, 1) AS c, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare FROM turns
), faulty AS (
  SELECT *, coalesce(lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c NOT IN ('su', 'ua', 'au'), false) AS illegal,
    CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM sorted
), totals AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
    count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE illegal) AS illegal FROM faulty GROUP BY conv_id
), inserted(x, y, edits, lines, price) AS (
  VALUES ('e', 'e', '', [], 0), ('s', 's', '', [], 0), ('u', 'u', '', [], 0), ('a', 'a', '', [], 0), ('e', 'u', 'I', ['user:'], 5), ('s', 'u', 'I', ['user:'], 5), ('a', 'u', 'I', ['user:'], 5),
    ('u', 'a', 'I', ['assistant:'], 5), ('e', 'a', 'II', ['user:', 'assistant:'], 10), ('s', 'a', 'II', ['user:', 'assistant:'], 10)
), edits(x, y, edit) AS (
  VALUES ('e', 'e', 'D'), ('s', 's', 'D'), ('u', 'u', 'D'), ('a', 'a', 'D'), ('e', 's', 'K'), ('e', 'u', 'K'), ('s', 'u', 'K'), ('a', 'u', 'K'), ('u', 'a', 'K'), ('e', 'u', 'R'), ('s', 'u', 'R'), ('a', 'u', 'R'), ('u', 'a', 'R')
), ways AS (
  SELECT p.x, e.y, p.edits || e.edit AS edits, e.edit, p.lines, p.price + CASE e.edit WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END AS price FROM inserted p JOIN edits e ON p.y = e.x
), walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, 'e' AS state, '000000000' AS way, CAST([] AS VARCHAR[]) AS lines FROM totals
  UNION ALL
  SELECT conv_id, i, state, min(way), arg_min(lines, way) FROM (
    SELECT w.conv_id, f.i, m.y AS state,
      lpad(CAST(CAST(left(w.way, 9) AS BIGINT) + m.price + CASE WHEN m.edit <> 'D' AND f.fault = 't' THEN 5 ELSE 0 END AS VARCHAR), 9, '0') || substr(w.way, 10) || m.edits AS way,
      w.lines || m.lines || CASE m.edit WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [CASE m.y WHEN 'u' THEN 'user:' ELSE 'assistant:' END || f.text] END AS lines
    FROM walk w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 JOIN ways m ON m.x = w.state
    WHERE m.edit = 'D' OR f.fault NOT IN ('b', 'd') AND CASE m.edit WHEN 'K' THEN f.c = m.y ELSE f.c <> m.y END
  ) GROUP BY conv_id, i, state
), ended AS (
  SELECT w.conv_id, min(lpad(CAST(CAST(left(way, 9) AS BIGINT) + price AS VARCHAR), 9, '0') || substr(way, 10) || edits) AS way,
    arg_min(w.lines || p.lines, lpad(CAST(CAST(left(way, 9) AS BIGINT) + price AS VARCHAR), 9, '0') || substr(way, 10) || edits) AS lines
  FROM walk w JOIN totals t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = t.n JOIN inserted p ON p.x = w.state AND (p.y = 'a' OR p.y = 'e') GROUP BY w.conv_id
), ids AS (SELECT DISTINCT conv_id FROM raw)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(left(way, 9), '0') AS BIGINT) AS cost, coalesce(substr(way, 10), '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN totals ON totals.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM ids.conv_id
"""
