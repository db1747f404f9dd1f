"""Repair of conversation structure by a dynamic program over retained turns.

A turn is kept, reroled or deleted, and turns without text may be inserted, so
that the role initials of what is left read ``(s?(ua)+)?`` at the least cost.
The program runs over retained turns only: a turn retained in a role follows an
earlier retained turn (or none); what lies between is deleted, at a price that
is a difference of prefix sums, so each role needs one running minimum of (cost
so far - deletions so far); the pair of roles says which turns are inserted.
Audits (the initials of the edits) break ties.

Conversations are partitioned by id and sorted inside partitions, and a task
streams through its rows: per conversation it holds four running minima with a
running SHA-256 each and the links of their audits, never the rows. One
conversation is one pass, as the digest of its repaired text is one chain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Turns to insert between two retained roles ("": the start). A system turn stands first only.
BETWEEN = {("", "s"): "", ("", "u"): "", ("", "a"): "u", ("s", "u"): "", ("s", "a"): "u", ("u", "a"): "", ("u", "u"): "a", ("a", "u"): "", ("a", "a"): "u"}
AFTER = {"": "", "s": "ua", "u": "a", "a": ""}
FAULTS = ("blank", "duplicate", "truncated")
RESULT = "conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by crc32(`conv_id:turn`) % 20: 0 drops a row, 1 empties its text, 2 removes
    its ``.!?``, 3 doubles it, 4 makes it the user's. Nulls of role and text, and of the ids in the hashed text, are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    marked = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("_kind")).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    return marked.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def _seen(order: list[Column]) -> Column:
    """Whether role and text stood in the conversation before, by a digest in place of the text."""
    alike = Window.partitionBy("conv_id", "_digest").orderBy(*order)
    return F.row_number().over(alike) > 1


def faulted(rows: DataFrame) -> DataFrame:
    """The rows in order within partitions of whole conversations, each with ``fault``: blank, duplicate, truncated or none.

    One shuffle, by conversation: the window over equal turns and the order of turns are sorts inside the partitions.
    Rows of one turn go by role, then text; of equal ones the first is the original.
    """
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    digest = F.sha2(F.concat_ws("\0", F.length("role").cast("string"), "role", "text").cast("binary"), 256)
    dealt = rows.repartition(F.col("conv_id")).withColumn("_digest", digest)
    last = F.right(F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     ")), F.lit(1))
    fault = F.when(~F.rlike("text", F.lit("[^\\x20\\x09-\\x0D]")), "blank").when(_seen(order), "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    # of equal rows the duplicates come last
    return dealt.withColumn("fault", fault).drop("_digest").sortWithinPartitions(F.asc_nulls_first("conv_id"), *order, F.coalesce(F.col("fault") == "duplicate", F.lit(False)))


class Best:
    """The cheapest way to a state: its cost, its place in the order of the audits of all states, its audit (a chain of
    parts, last first) and the running digest of the repaired text."""

    __slots__ = ("cost", "rank", "audit", "digest", "empty")

    def __init__(self, cost, rank, audit, digest, empty):
        self.cost, self.rank, self.audit, self.digest, self.empty = cost, rank, audit, digest, empty


class Repair:
    """One conversation's program, fed turn by turn.

    ``states`` maps the role retained last ("": none yet) to the cheapest way there, with all turns since deleted. Costs
    are kept less the prefix sum of deletions (4 a turn so far), so that a further deletion changes no state. Audits of two
    states are never beginnings of each other (each holds one letter a turn and ends in one), so the order of two audits
    stays when both grow by deletions, and ``rank`` is enough to compare what starts from different states.
    """

    def __init__(self):
        self.states = {"": Best(0, 0, None, hashlib.sha256(), True)}
        self.turns = 0

    def _ways(self, role: str, own: int, letter: str):
        """All ways to retain this turn in a role: cost, then what orders audits, then where it comes from."""
        for before, way in self.states.items():
            inserts = BETWEEN.get((before, role))
            if inserts is not None:
                yield way.cost + INSERT * len(inserts) + own, way.rank, "I" * len(inserts) + letter, before, inserts

    def add(self, role: str, text: str, fault: str | None) -> None:
        at, initial = self.turns, role[:1]
        new = {}
        if fault in (None, "truncated"):
            extra = TRUNCATED if fault else 0
            for to in ("s", "u", "a"):
                ways = list(self._ways(to, extra, "K")) if initial == to else []
                if to in ROLES and initial != to:
                    ways = list(self._ways(to, extra + REROLE, "R"))
                if ways:
                    cost, rank, letters, before, inserts = min(ways)
                    way = self.states[before]
                    digest = way.digest.copy()
                    spoken = [f"{ROLES[i]}:" for i in inserts] + [f"{role if letters[-1] == 'K' else ROLES[to]}:{text}"]
                    digest.update(("" if way.empty else "\n").encode() + "\n".join(spoken).encode("utf-8", "surrogatepass"))
                    # turns since the way's last letter were deleted; their letters are told by their count
                    new[to] = (cost - DELETE, rank, letters, Best(0, 0, (way.audit, at, letters), digest, False))
        # each state now either takes the new way or deletes this turn: what is shared up to here is ordered by rank, then by the letters since
        options = {to: [(way.cost, way.rank, "D", way)] for to, way in self.states.items()}
        for to, (cost, rank, letters, way) in new.items():
            options.setdefault(to, []).append((cost, rank, letters, way))
        chosen = {to: min(ways, key=lambda w: w[:3]) for to, ways in options.items()}
        order = {key: i for i, key in enumerate(sorted({(rank, letters) for _, rank, letters, _ in chosen.values()}))}
        self.states = {to: Best(cost, order[rank, letters], way.audit, way.digest, way.empty) for to, (cost, rank, letters, way) in chosen.items()}
        self.turns += 1

    def result(self) -> tuple[int, str, str]:
        """Cost, audit and digest of the cheapest repair; of equal ones that with the least audit."""
        cost, _, inserts, role = min((way.cost + INSERT * len(AFTER[role]), way.rank, "I" * len(AFTER[role]), role) for role, way in self.states.items())
        way = self.states[role]
        if inserts:
            way.digest.update("".join(f"\n{ROLES[i]}:" for i in AFTER[role]).encode())
        parts, link, end = [inserts], way.audit, self.turns
        while link is not None:
            before, at, letters = link
            parts += ["D" * (end - at - 1), letters]
            link, end = before, at
        parts.append("D" * end)
        return cost + DELETE * self.turns, "".join(reversed(parts)), way.digest.hexdigest()


class _Tally:
    """What one conversation's rows come to."""

    def __init__(self):
        self.low = self.high = self.last = self.initial = None
        self.distinct = self.illegal = 0
        self.faults = dict.fromkeys(FAULTS, 0)
        self.repair = Repair()

    def add(self, turn, role, text, fault) -> None:
        if turn is not None and turn != self.last:
            self.low = turn if self.low is None else self.low
            self.high = self.last = turn
            self.distinct += 1
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        if fault:
            self.faults[fault] += 1
        self.repair.add(role, text, fault)

    def row(self, conv_id) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return conv_id, gaps, *self.faults.values(), self.illegal, *self.repair.result()


def repair(rows: DataFrame) -> DataFrame:
    """A row per conversation of (conv_id, turn, role, text, fault), as ``faulted`` lays them: faults, cost, audit, digest."""
    schema = RESULT.format(kind=rows.schema["conv_id"].dataType.simpleString())
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tally, kind = None, None, None
        done: list[tuple] = []
        flush = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], kind if i == 0 else pa.string() if i > 6 else pa.int64()) for i in range(len(names))], names=names)
        for batch in batches:
            kind = batch["conv_id"].type
            for conv_id, *turn in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "fault"))):
                if tally is None or conv_id != now:
                    if tally is not None:
                        done.append(tally.row(now))
                    now, tally = conv_id, _Tally()
                tally.add(*turn)
            if done:
                yield flush()
                done.clear()
        if tally is not None:
            done.append(tally.row(now))
            yield flush()

    return rows.select("conv_id", "turn", "role", "text", "fault").mapInArrow(run, schema)


def op12_conversation_repair(rows: DataFrame) -> DataFrame:
    """A row per original conv_id (null too): the damaged rows' faults and their cheapest repair.

    Nulls are one space, null turns come first, rows of one turn go by role and text; repeated rows are duplicates; a
    conversation that lost all rows, as any without rows, has zeros, an empty audit and the empty text's digest. An empty
    table gives an empty one; other columns are not read. A long conversation streams through.
    """
    rows = rows.select("conv_id", "turn", "role", "text")
    found = repair(faulted(damage(rows)))
    # one row a conversation on either side; a null id equals a null id
    everyone = rows.select("conv_id").distinct()
    mended = found.withColumnRenamed("conv_id", "_conv")
    zero = {c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    empty = hashlib.sha256(b"").hexdigest()
    return everyone.join(mended, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select(
        "conv_id", *[v.alias(k) for k, v in zero.items()], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256")
    )


#: Moves of the SQL twin: a turn at a time over states (cost, audit, text), every edit a move of its own.
def _oracle() -> str:
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ord(c)::BIGINT)), lambda h, b: list_reduce([xor(h, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 20"
    said = {"s": "role", "u": "'user'", "a": "'assistant'"}
    best = lambda options: f"list_sort(list_filter([{', '.join(options)}], lambda o: o.c < 1000000000))[1]"
    far = "{'c': 1000000000::BIGINT, 'a': '', 't': ''}"
    way = lambda state, cost, letter, text: f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {state}.t || {text}}}"
    own = "(CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END)"

    def step(to: str) -> str:
        ways = [way(f"d.{to}", 4, "D", "''")]
        for before, name in (("n", ""), ("s", "s"), ("u", "u"), ("a", "a")):
            if (inserts := BETWEEN.get((name, to))) is not None:
                put = "".join(f"chr(10) || '{ROLES[i]}:' || " for i in inserts)
                cost = lambda more: f"{INSERT * len(inserts)} + {own} + {more}"  # noqa: B023, E731
                ways.append(f"CASE WHEN open AND initial = '{to}' THEN {way(f'd.{before}', cost(0), 'I' * len(inserts) + 'K', put + 'chr(10) || role || chr(58) || text')} ELSE {far} END")
                if to != "s":
                    ways.append(f"CASE WHEN open THEN {way(f'd.{before}', cost(REROLE), 'I' * len(inserts) + 'R', put + f'chr(10) || {said[to]} || chr(58) || text')} ELSE {far} END")
        return f"coalesce({best(ways)}, {far})"

    ends = [way(f"d.{k}", INSERT * len(AFTER[name]), "I" * len(AFTER[name]), " || ".join([f"chr(10) || '{ROLES[i]}:'" for i in AFTER[name]] or ["''"])) for k, name in (("n", ""), ("s", "s"), ("u", "u"), ("a", "a"))]
    trimmed = "regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '')"
    return f"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} AS kind FROM conversations
), d0 AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT * FROM k WHERE kind <> 0 UNION ALL SELECT * FROM k WHERE kind = 3)
), d1 AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM d0)
), r AS (
  SELECT *, substr(role, 1, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right({trimmed}, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM d1
), e AS (
  SELECT *, fault IN ('', 'truncated') AS open, lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS pair FROM r
), g AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM e GROUP BY 1
), dp AS (
  SELECT conv_id, 0::BIGINT AS pos, {{'c': 0::BIGINT, 'a': '', 't': ''}} AS n, {far} AS s, {far} AS u, {far} AS a FROM g
  UNION ALL
  SELECT d.conv_id, e.pos, {way('d.n', 4, 'D', "''")}, {step('s')}, {step('u')}, {step('a')} FROM dp d JOIN e ON e.conv_id IS NOT DISTINCT FROM d.conv_id AND e.pos = d.pos + 1
), z AS (
  SELECT d.conv_id, {best(ends)} AS b FROM dp d JOIN g ON g.conv_id IS NOT DISTINCT FROM d.conv_id AND g.n = d.pos
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(z.b.c, 0) AS cost, coalesce(z.b.a, '') AS audit, sha256(substr(coalesce(z.b.t, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM o.conv_id
"""


ORACLE_SQL = _oracle()
