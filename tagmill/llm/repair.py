"""Repair of the turn structure of conversations at least cost, by a recursive query over grammar states.

A conversation's roles should read ``(s?(ua)+)?`` by their initials: at most one system turn, then user and assistant in
turn. Edits: keep (0), rerole to user or assistant (3), delete (4; the only one for blank and duplicate turns), insert an
empty turn of user or assistant (3); a truncated turn that stays costs 3 more. In each of the four states of the grammar
one of user and assistant is legal, so the string of edits (the audit) tells the repair.

Turns get their number by one distributed sort. Every PIECE turns that follow each other are a unit of work, whatever
conversations they belong to; units are dealt by hash into batches, and a batch is one recursive query in DuckDB: each
recursion advances one turn for all conversations of the batch and keeps the least cost, then the least audit, for each
state it may have begun in and each that it is in. (Of two audits of the same turns and equal cost neither begins with the
other, so least parts make least wholes.) What a conversation has in several units is put together by the same query,
FAN parts at a time, until it is one. So a conversation with a third of all turns is dealt like any other; only its
hash, which the definition makes one SHA-256 over all its text, is streamed through one task, a batch of rows at a time.

Cases: a null role or text is one space (so the text is blank and the role can't be kept); null turns come first, turns of
equal number by role and text; a null conv_id is one conversation; rows that repeat are duplicates of the first; a role
without initial, or with another than s, u, a, can't be kept; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import duckdb
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .common import cut, table

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Turns in a unit, units that are put together at once, turns or parts in a batch (on average), a batch's memory.
PIECE, FAN, BATCH, MEMORY = 64, 64, 1 << 14, "256MB"
#: States: nothing yet, after system, after user, after assistant. What user or assistant leads to from each; what may end.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT, ENDS = (USER, USER, ASSISTANT, USER), (START, ASSISTANT)
_INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
FINE, CUT_OFF, UNWANTED = range(3)
_WORD = r"[^\x20\x09-\x0D]"


def _inserted(state: int) -> list[tuple[int, int, str]]:
    """State, cost and audit after none, one or two inserted turns; more would only come back."""
    one, two = NEXT[state], NEXT[NEXT[state]]
    return [(state, 0, ""), (one, INSERT, "I"), (two, 2 * INSERT, "II")]


def moves(initial: str, fault: int) -> dict[tuple[int, int], tuple[int, str]]:
    """The least cost and audit of one turn (with insertions before it) for each state before and after."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for begin in range(4):
        for state, cost, audit in _inserted(begin):
            ways = [(state, DELETE, "D")]
            if fault != UNWANTED:
                more = TRUNCATED if fault == CUT_OFF else 0
                ways.append((NEXT[state], REROLE + more, "R"))
                to = _INITIALS.get(initial)
                if to is not None and (to == NEXT[state] or (to == SYSTEM and state == START)):
                    ways.append((to, more, "K"))
            for to, price, letter in ways:
                new = (cost + price, audit + letter)
                best[begin, to] = min(best.get((begin, to), new), new)
    return best


def endings() -> list[tuple[int, int, str]]:
    """State, cost and audit of what must be inserted at the end."""
    return [(s, *min((c, a) for to, c, a in _inserted(s) if to in ENDS)) for s in range(4)]


_KINDS = [i + str(f) for i in ("s", "u", "a", "") for f in (FINE, CUT_OFF, UNWANTED)]
_MOVES = pd.DataFrame([(k, b, to, *x) for k in _KINDS for (b, to), x in moves(k[:-1], int(k[-1])).items()], columns=["kind", "before", "after", "price", "letters"])

_ADVANCE = """
WITH RECURSIVE sizes AS (SELECT part, max(k) AS n FROM steps GROUP BY part),
best AS (
  SELECT part, 0::BIGINT AS k, s::INTEGER AS begun, s::INTEGER AS state, 0::BIGINT AS cost, '' AS audit FROM sizes, range(4) AS t(s)
  UNION ALL
  SELECT part, k, begun, state, least.cost, least.audit FROM (
    SELECT b.part, b.k + 1 AS k, b.begun, s.after AS state, min({'cost': b.cost + s.price, 'audit': b.audit || s.letters}) AS least
    FROM best b JOIN steps s ON s.part = b.part AND s.k = b.k + 1 AND s.before = b.state GROUP BY ALL))
SELECT part, begun, state, cost, audit FROM best JOIN sizes USING (part) WHERE k = n ORDER BY part, begun, state"""


def _advance(rows: pd.DataFrame, steps: str) -> pd.DataFrame:
    """The least (cost, audit) over each part of ``rows`` for each state before and after; ``steps``: SQL for part, k (from 1), before, after, price, letters."""
    con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
    try:
        con.register("rows", rows)
        con.register("moves", _MOVES)
        con.execute(f"CREATE TABLE steps AS {steps}")
        return con.execute(_ADVANCE).df()
    finally:
        con.close()


_PARTS = "conv_id long, place long, first string, last string, illegal long, ways array<struct<begun int, state int, cost long, audit string>>"


def _legal(one: str | None, two: str | None) -> bool:
    return f"{one}{two}" in ("su", "ua", "au")


def _gathered(keys: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    """One row a part, with its ways."""
    ways = {p: list(zip(g["begun"].tolist(), g["state"].tolist(), g["cost"].tolist(), g["audit"].tolist(), strict=True)) for p, g in found.groupby("part")}
    return keys.assign(ways=[ways[p] for p in keys.index])


def _turns(pdf: pd.DataFrame) -> pd.DataFrame:
    """A batch of units, turn by turn."""
    pdf = pdf.sort_values("index")
    pdf["part"] = pdf.groupby(["conv_id", "place"], dropna=False, sort=False).ngroup()
    pdf["k"] = pdf.groupby("part").cumcount() + 1
    pdf["kind"] = pdf["initial"].where(pdf["initial"].isin(list(_INITIALS)), "") + pdf["fault"].astype(str)
    found = _advance(pdf[["part", "k", "kind"]], "SELECT r.part, r.k, m.before, m.after, m.price, m.letters FROM rows r JOIN moves m USING (kind)")
    before = pdf.groupby("part")["initial"].shift()
    pdf["illegal"] = [int(not pd.isna(b) and not _legal(b, i)) for b, i in zip(before, pdf["initial"], strict=True)]
    grouped = pdf.groupby("part")
    keys = grouped.agg(conv_id=("conv_id", lambda v: v.iloc[0]), place=("place", "first"), first=("initial", "first"), last=("initial", "last"), illegal=("illegal", "sum"))
    return _gathered(keys.astype({"conv_id": "Int64"}), found)


def _joined(pdf: pd.DataFrame) -> pd.DataFrame:
    """A batch of conversations' groups of parts, part by part."""
    pdf = pdf.sort_values("place")
    pdf["part"] = pdf.groupby(["conv_id", "group"], dropna=False, sort=False).ngroup()
    pdf["k"] = pdf.groupby("part").cumcount() + 1
    long = pdf[["part", "k", "ways"]].explode("ways", ignore_index=True)
    long = pd.concat([long[["part", "k"]], pd.DataFrame([tuple(w.values()) if isinstance(w, dict) else tuple(w) for w in long["ways"]], columns=["before", "after", "price", "letters"])], axis=1)
    found = _advance(long, "SELECT * FROM rows")
    before = pdf.groupby("part")["last"].shift()
    pdf["illegal"] += [int(not pd.isna(b) and not _legal(b, i)) for b, i in zip(before, pdf["first"], strict=True)]
    keys = pdf.groupby("part").agg(conv_id=("conv_id", lambda v: v.iloc[0]), place=("group", "first"), first=("first", "first"), last=("last", "last"), illegal=("illegal", "sum"))
    return _gathered(keys.astype({"conv_id": "Int64"}), found)


def cheapest(turns: DataFrame) -> DataFrame:
    """conv_id, illegal, cost, audit of each conversation in ``turns`` (conv_id, index over the whole table, initial, fault)."""
    batches = 1 + turns.count() // BATCH
    units = turns.withColumn("place", F.floor(F.col("index") / PIECE)).withColumn("batch", F.pmod(F.xxhash64("place"), F.lit(batches)))
    parts = cut(units.repartition(batches, "batch").groupBy("batch").applyInPandas(_turns, _PARTS))
    whole: list[DataFrame] = []
    while True:
        firsts = parts.groupBy(F.col("conv_id").alias("_conv")).agg(F.min("place").alias("_low"), F.count(F.lit(1)).alias("_n"))
        placed = cut(parts.join(firsts, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv"))
        whole.append(placed.where("_n = 1").select(parts.columns))
        left = placed.where("_n > 1").withColumn("group", F.floor((F.col("place") - F.col("_low")) / FAN)).drop("_low", "_n")
        m = left.count()
        if not m:
            break
        batches = 1 + m * 16 // BATCH  # a part has up to 16 ways
        dealt = left.withColumn("batch", F.pmod(F.xxhash64("conv_id", "group"), F.lit(batches)))
        parts = cut(dealt.repartition(batches, "batch").groupBy("batch").applyInPandas(_joined, _PARTS))
    ends = F.array(*[F.struct(F.lit(c).cast("long").alias("cost"), F.lit(a).alias("audit")) for _, c, a in endings()])
    begun = F.filter("ways", lambda w: w["begun"] == START)

    def ended(w: Column) -> Column:
        end = F.get(ends, w["state"])
        return F.struct((w["cost"] + end["cost"]).alias("cost"), F.concat(w["audit"], end["audit"]).alias("audit"))

    least = F.array_min(F.transform(begun, ended))
    return reduce(DataFrame.unionByName, whole).withColumn("least", least).select("conv_id", "illegal", "least.cost", "least.audit")


def _hashes(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """conv_id, repaired_sha256 from rows that follow each other: a conversation's audit, then its turns in order."""
    held: _Repaired | None = None
    for pdf in parts:
        out = []
        for conv, audit, role, text in zip(pdf["conv_id"], pdf["audit"], pdf["role"], pdf["text"], strict=True):
            if audit is not None:
                if held:
                    out.append(held.done())
                held = _Repaired(conv, audit)
            else:
                held.turn(role, text)
        yield pd.DataFrame(out, columns=["conv_id", "repaired_sha256"]).astype({"conv_id": "Int64"})
    if held:
        yield pd.DataFrame([held.done()], columns=["conv_id", "repaired_sha256"]).astype({"conv_id": "Int64"})


class _Repaired:
    """The hash of a conversation whose turns come one by one."""

    def __init__(self, conv, audit: str):
        self.conv, self.audit, self.at, self.state, self.hash, self.some = conv, audit, 0, START, hashlib.sha256(), False

    def _say(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.some else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.some = True

    def _change(self, text: str) -> None:
        self.state = NEXT[self.state]
        self._say("user" if self.state == USER else "assistant", text)

    def _insert(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self._change("")

    def turn(self, role: str, text: str) -> None:
        self._insert()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "R":
            self._change(text)
        elif letter == "K":
            self.state = _INITIALS[role[0]]
            self._say(role, text)

    def done(self) -> tuple:
        self._insert()
        return self.conv, self.hash.hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that each row's crc32 decides."""
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key) % 20).alias("_d")).where("_d <> 0")
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("_d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("_d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("_t")).drop("_t")


def repair(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation in ``turns``
    (conv_id long, turn long, role string, text string)."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    same = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    marks = rows.withColumns({"same": same, "initial": F.substring("role", 1, 1), "blank": ~F.col("text").rlike(_WORD), "open": ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")})
    placed = numbered(marks, "conv_id", "turn", "role", "text", name="index", drop=("role", "text"))
    firsts = placed.groupBy("conv_id", "same").agg(F.min("index").alias("index")).select("index", F.lit(True).alias("new"))
    told = placed.join(firsts, "index", "left")  # numbers are unique: a hot conversation is no hot key here
    kind = F.when(F.col("blank"), "blank").when(F.col("new").isNull(), "duplicate").when(F.col("open"), "truncated").otherwise("")
    told = cut(told.select("conv_id", "turn", "index", "initial", kind.alias("kind")))
    counts = [F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in ("blank", "duplicate", "truncated")]
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps")
    facts = told.groupBy("conv_id").agg(gaps, *counts)
    fault = F.when(F.col("kind") == "", FINE).when(F.col("kind") == "truncated", CUT_OFF).otherwise(UNWANTED)
    best = cut(cheapest(told.select("conv_id", "index", "initial", fault.alias("fault"))))

    audits = best.select("conv_id", "audit", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    texts = rows.select("conv_id", F.lit(None).cast("string").alias("audit"), "turn", "role", "text")
    streamed = audits.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), "turn", "role", "text")
    hashes = streamed.select("conv_id", "audit", "role", "text").mapInPandas(_hashes, "conv_id long, repaired_sha256 string")
    named = best.join(facts.withColumnRenamed("conv_id", "_f"), F.col("conv_id").eqNullSafe(F.col("_f"))).drop("_f")
    named = named.join(hashes.withColumnRenamed("conv_id", "_h"), F.col("conv_id").eqNullSafe(F.col("_h"))).drop("_h")
    return named.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """What ``repair`` says of the damaged rows, for every conv_id there is."""
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found = repair(damaged(conversations)).withColumnRenamed("conv_id", "_c")
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c")
    longs = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *longs, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return damaged_and_repaired(table(spark, sf_dir, "conversations"))


#: One recursion a turn over every conversation, with the repaired lines carried along.
REPAIR_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
summed AS (
  SELECT *, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::BIGINT) ELSE r >> 1 END))) % 20 AS d FROM keyed),
hurt AS (
  SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role,
    CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE d WHEN 3 THEN 2 ELSE 1 END))
  FROM summed WHERE d <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) AS nth
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, substr(role, 1, 1) AS i FROM hurt)),
told AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS kind,
    lag(i) OVER (PARTITION BY conv_id ORDER BY k) || i NOT IN ('su', 'ua', 'au') AS bad FROM placed),
facts AS (
  SELECT conv_id, max(k) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (kind = 'blank') AS blank,
    count(*) FILTER (kind = 'duplicate') AS duplicate, count(*) FILTER (kind = 'truncated') AS truncated, count(*) FILTER (bad) AS illegal FROM told GROUP BY conv_id),
ins AS (SELECT * FROM (VALUES (0, 0, 0, '', []), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
  (0, 2, 3, 'I', ['user:']), (1, 2, 3, 'I', ['user:']), (2, 3, 3, 'I', ['assistant:']), (3, 2, 3, 'I', ['user:']),
  (0, 3, 6, 'II', ['user:', 'assistant:']), (1, 3, 6, 'II', ['user:', 'assistant:'])) t(q, p, c, a, l)),
fit AS (SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) t(q, i, p)),
best AS (
  SELECT conv_id, 0::BIGINT AS k, 0 AS q, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS lines FROM facts
  UNION ALL
  SELECT conv_id, k, q, b.cost, b.audit, b.lines FROM (
    SELECT x.conv_id, t.k, e.q, min({'cost': x.cost + n.c + e.c, 'audit': x.audit || n.a || e.a, 'lines': x.lines || n.l || e.l}) AS b
    FROM best x JOIN told t ON t.conv_id IS NOT DISTINCT FROM x.conv_id AND t.k = x.k + 1 JOIN ins n ON n.q = x.q,
    LATERAL (
      SELECT n.p AS q, 4 AS c, 'D' AS a, []::VARCHAR[] AS l
      UNION ALL SELECT f.p, CASE t.kind WHEN 'truncated' THEN 3 ELSE 0 END, 'K', [t.role || ':' || t.text] FROM fit f WHERE f.q = n.p AND f.i = t.i AND t.kind NOT IN ('blank', 'duplicate')
      UNION ALL SELECT f.p, CASE t.kind WHEN 'truncated' THEN 6 ELSE 3 END, 'R', [CASE f.i WHEN 'u' THEN 'user:' ELSE 'assistant:' END || t.text]
        FROM fit f WHERE f.q = n.p AND f.i <> 's' AND t.kind NOT IN ('blank', 'duplicate')) e
    GROUP BY ALL)),
ended AS (
  SELECT x.conv_id, min({'cost': x.cost + n.c, 'audit': x.audit || n.a, 'lines': x.lines || n.l}) AS b
  FROM best x JOIN facts f ON f.conv_id IS NOT DISTINCT FROM x.conv_id AND f.n = x.k JOIN ins n ON n.q = x.q WHERE n.p IN (0, 3) GROUP BY x.conv_id)
SELECT o.conv_id, coalesce(f.gaps, 0) AS gaps, coalesce(f.blank, 0) AS blank, coalesce(f.duplicate, 0) AS duplicate, coalesce(f.truncated, 0) AS truncated,
  coalesce(f.illegal, 0) AS illegal, coalesce(e.b.cost, 0) AS cost, coalesce(e.b.audit, '') AS audit, sha256(coalesce(array_to_string(e.b.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id"""

QUERIES = {"op12_conversation_repair": op12_conversation_repair}
ORACLE = {"op12_conversation_repair": REPAIR_SQL}
