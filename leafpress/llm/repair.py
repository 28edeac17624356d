r"""Conversation structure repair (operator 12): the cheapest edits that leave an optional system turn and then user-assistant pairs.

Faults of a row, the first one counts: blank (no character but U+0020 and U+0009 to U+000D), duplicate (its role and text stand earlier in
the conversation), truncated (the last character that isn't such a space is none of ``.!?``). Edits: Keep costs 0, Rerole to user or
assistant 1, Delete 2 (a must for blank and duplicate rows), Insert of an empty user or assistant turn 5; a truncated row that stays costs 5 more.

The search runs over the retained rows alone. Backwards, ``best[r]`` is the running minimum, for a next retained row of final role r, of what
follows it plus the deletions before it, as a prefix sum; a gap's price is the difference of two such sums, and the pair of roles beside it
says what is inserted there. Of equal prices the ASCII-least audit wins: in a gap deletions stand before insertions, so that is the
later next row, then the one behind an insertion, then the kept one. No audit is ever compared.

A long conversation is many blocks (``turns``). What a block costs from each last role to each last role is a 4 x 4 matrix; from the
last block back these give every block the prices of what follows it, and from the first block on the role it is entered with. Each block is
then solved for itself, and the rows of many blocks are never together in one task; only those matrices of one conversation are.

Defined results: rows stand by turn, nulls first; those of one turn by role, then text. A null text is blank; a null or empty role, and
one with an initial other than s, u and a, can't be kept. Repeated rows are duplicates. A null conversation id is a conversation, an empty table gives no rows, a text of any
length is read whole. Gaps are null if no long holds them. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafpress.llm.common import ASCII_SPACE, fitted, stored, table
from leafpress.llm.turns import BLOCK_BYTES, BLOCK_ROWS, Cutter, folded, in_order

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Last retained roles: none yet, system, user, assistant.
STATES = "^sua"
#: What must stand between two retained roles, and before the end.
BETWEEN = {"^s": "", "^u": "", "^a": "u", "su": "", "sa": "u", "uu": "a", "ua": "", "au": "", "aa": "u"}
ENDING = {"^": "", "s": "ua", "u": "a", "a": ""}
END = tuple(INSERT * len(ENDING[r]) for r in STATES)
ROLES = {"u": "user", "a": "assistant"}
_NEVER = 1 << 60
#: For each last role the next ones, by insertions (more first: an I comes before K and R).
_NEXT = {r: [(x, len(BETWEEN[r + x])) for x in "sua" if r + x in BETWEEN] for r in STATES}


def search(initials: str, kinds: str, after: tuple[int, ...]) -> tuple[dict, list[dict]]:
    """Choices of a block: for each role it may be entered with, and for each row and final role of it.

    A choice is (price of all that follows, -next retained row, -insertions, K or R, its final role); no next row in the block is row n.
    ``after`` has the prices beyond the block by the last retained role.
    """
    n = len(initials)
    beyond = dict(zip(STATES, after))
    best: dict[str, tuple[int, int, str]] = {}  # final role -> (price + deletions up to it, row, K or R)

    def follow(i: int, role: str) -> tuple:
        found = (DELETE * (n - 1 - i) + beyond[role], -n, 0, "", "")
        for x, inserts in _NEXT[role]:
            if x in best:
                price, k, letter = best[x]
                option = (price - DELETE * (i + 1) + INSERT * inserts, -k, -inserts, letter, x)
                if option < found:
                    found = option
        return found

    rows: list[dict] = [{} for _ in range(n)]
    for i in range(n - 1, -1, -1):
        if kinds[i] in "bd":
            continue
        stay = TRUNCATED if kinds[i] == "t" else 0
        for x in "sua" if initials[i] == "s" else "ua":
            rows[i][x] = follow(i, x)
        for x, choice in rows[i].items():
            price = choice[0] + stay + (0 if initials[i] == x else REROLE) + DELETE * i
            if x not in best or price < best[x][0]:
                best[x] = (price, i, "K" if initials[i] == x else "R")
    return {r: follow(-1, r) for r in STATES}, rows


def walk(entry: str, entries: dict, rows: list[dict]) -> Iterator[tuple[int, str, str, str]]:
    """(row, what is inserted before it, K or R, final role) of the retained rows."""
    role, choice = entry, entries[entry]
    while choice[3]:
        k, letter, x = -choice[1], choice[3], choice[4]
        yield k, BETWEEN[role + x], letter, x
        role, choice = x, rows[k][x]


def matrix(initials: str, kinds: str) -> list[int]:
    """Prices of a block from each role that it is entered with to each role that it is left with."""
    columns = []
    for x in STATES:
        entries, _ = search(initials, kinds, tuple(0 if r == x else _NEVER for r in STATES))
        columns.append([min(entries[r][0], _NEVER) for r in STATES])
    return [columns[j][i] for i in range(4) for j in range(4)]


def leaves(initials: str, kinds: str, after: tuple[int, ...]) -> list[int]:
    """The role that the block is left with, by the role it is entered with."""
    entries, rows = search(initials, kinds, after)
    out = []
    for r in STATES:
        last = r
        for *_, last in walk(r, entries, rows):
            pass
        out.append(STATES.index(last))
    return out


def solve(initials: str, kinds: str, entry: str, after: tuple[int, ...], last: bool) -> tuple[int, str, str, str, str]:
    """Cost, audit, and per row D, K or the initial of its new role in capitals, what is inserted before it, and after the last one."""
    entries, rows = search(initials, kinds, after)
    n, audit, actions, before, at, role, cost = len(initials), [], ["D"] * len(initials), ["-"] * len(initials), 0, entry, 0
    for k, inserted, letter, role in walk(entry, entries, rows):
        audit += ["D" * (k - at), "I" * len(inserted), letter]
        actions[k] = "K" if letter == "K" else role.upper()
        before[k] = inserted or "-"
        cost += DELETE * (k - at) + INSERT * len(inserted) + (letter == "R") * REROLE + (kinds[k] == "t") * TRUNCATED
        at = k + 1
    ending = ENDING[role] if last else ""
    audit += ["D" * (n - at), "I" * len(ending)]
    return cost + DELETE * (n - at) + INSERT * len(ending), "".join(audit), "".join(actions), "".join(before), ending


def numbered(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, block_rows: int, block_bytes: int) -> DataFrame:
    """(conv, turn, role, text, block, pos), stored."""
    dealt = in_order(rows, id_col, turn_col, role_col, text_col)
    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Cutter(block_rows, block_bytes)
        for b in batches:
            blocks, places = cut(b["conv"].to_pylist(), pc.fill_null(pc.binary_length(b["text"]), 0).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(blocks, pa.int64()), pa.array(places, pa.int32())], [*b.schema.names, "block", "pos"])

    return stored(dealt.mapInArrow(run, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", block long, pos int"))


def judged_blocks(rows: DataFrame) -> DataFrame:
    """A row a block: conv, block, initials, kinds (b, d, t or -: a letter a row), turns, and its place in the conversation; stored."""
    trimmed = F.rtrim(F.coalesce("text", F.lit("")), F.lit(ASCII_SPACE))
    initial = F.substring("role", 1, 1)
    kind = F.when(trimmed == "", "b").when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), "t").otherwise("-")
    code = F.struct("pos", F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"), kind.alias("kind"))
    own = rows.select("conv", "block", "turn", code.alias("code"))
    joined = lambda c: F.array_join(F.transform("codes", lambda x: x[c]), "").alias(c)
    blocks = own.groupBy("conv", "block").agg(F.array_sort(F.collect_list("code")).alias("codes"), F.min("turn").alias("low"), F.max("turn").alias("high"), F.size(F.collect_set("turn")).alias("turns"))
    blocks = blocks.select("conv", "block", "low", "high", "turns", joined("initial").alias("initials"), joined("kind").alias("kinds"))
    # The first row of each role and text: a partial aggregation, so a text that fills a conversation is no hot group.
    same = (F.col("role").isNull(), F.col("text").isNull(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    firsts = rows.select("conv", F.xxhash64(*same).alias("h1"), F.xxhash64(F.lit("turn"), *same).alias("h2"), F.struct("block", "pos").alias("at"))
    firsts = firsts.groupBy("conv", "h1", "h2").agg(F.min("at").alias("at")).groupBy(F.col("at.block").alias("block")).agg(F.array_sort(F.collect_list("at.pos")).alias("firsts"))
    blocks = blocks.join(firsts, "block", "left")

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = []
            for k, first in zip(b["kinds"].to_pylist(), b["firsts"].to_pylist()):
                new = set(first or ())
                kinds.append("".join(x if x == "b" or i in new else "d" for i, x in enumerate(k)))
            yield b.drop_columns(["kinds", "firsts"]).append_column("kinds", pa.array(kinds, pa.string()))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema if f.name not in ("kinds", "firsts")) + ", kinds string"
    within = Window.partitionBy("conv").orderBy("block")
    return stored(
        blocks.mapInArrow(marked, schema).select(
            "*", F.count("*").over(Window.partitionBy("conv")).alias("of"), F.row_number().over(within).alias("k"),
            F.lag(F.substring("initials", -1, 1)).over(within).alias("before"), F.lag("high").over(within).alias("high_before"),
        )
    )


def entered(blocks: DataFrame) -> DataFrame:
    """(block, entry, after): the role that a block is entered with and the prices of what follows it; for conversations of several blocks."""

    def prices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [matrix(i, k) for i, k in zip(b["initials"].to_pylist(), b["kinds"].to_pylist())]
            yield pa.RecordBatch.from_arrays([b["conv"], b["block"], b["k"], b["of"], pa.array(found, pa.list_(pa.int64()))], ["conv", "block", "k", "of", "matrix"])

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after = list(END)
        for b in batches:
            out = []
            for k, of, m in zip(b["k"].to_pylist(), b["of"].to_pylist(), b["matrix"].to_pylist()):
                after = list(END) if k == of else after
                out.append(after)
                after = [min(m[4 * i + j] + after[j] for j in range(4)) for i in range(4)]
            yield pa.RecordBatch.from_arrays([b["block"], pa.array(out, pa.list_(pa.int64()))], ["block", "after"])

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [leaves(i, k, tuple(x)) for i, k, x in zip(b["initials"].to_pylist(), b["kinds"].to_pylist(), b["after"].to_pylist())]
            yield pa.RecordBatch.from_arrays([b["conv"], b["block"], b["k"], b["after"], pa.array(found, pa.list_(pa.int32()))], ["conv", "block", "k", "after", "exits"])

    def on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        role = 0
        for b in batches:
            out = []
            for k, moves in zip(b["k"].to_pylist(), b["exits"].to_pylist()):
                role = 0 if k == 1 else role
                out.append(STATES[role])
                role = moves[role]
            yield pa.RecordBatch.from_arrays([b["block"], pa.array(out, pa.string()), b["after"]], ["block", "entry", "after"])

    kind = blocks.schema["conv"].dataType.simpleString()
    some = blocks.select("conv", "block", "k", "of", "initials", "kinds")
    priced = some.mapInArrow(prices, f"conv {kind}, block long, k int, of long, matrix array<long>").repartition("conv").sortWithinPartitions("conv", F.desc("k"))
    after = some.join(priced.mapInArrow(back, "block long, after array<long>"), "block")
    left = after.mapInArrow(exits, f"conv {kind}, block long, k int, after array<long>, exits array<int>").repartition("conv").sortWithinPartitions("conv", "k")
    return left.mapInArrow(on, "block long, entry string, after array<long>")


def solved_blocks(blocks: DataFrame) -> DataFrame:
    """blocks plus cost, audit, actions, inserted and ending; stored."""
    alone = blocks.where("of = 1").withColumns({"entry": F.lit("^"), "after": F.array(*map(F.lit, END)).cast("array<long>")})
    several = blocks.where("of > 1")
    fed = alone.unionByName(several.join(entered(several), "block")) if several.limit(1).count() else alone

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = (b[c].to_pylist() for c in ("initials", "kinds", "entry", "after", "k", "of"))
            found = zip(*(solve(i, x, e, tuple(a), k == of) for i, x, e, a, k, of in zip(*cols)))
            made = dict(zip(("cost", "audit", "actions", "inserted", "ending"), found)) or {}
            out = b.drop_columns(["entry", "after"])
            for name in ("cost", "audit", "actions", "inserted", "ending"):
                out = out.append_column(name, pa.array(made.get(name, ()), pa.int64() if name == "cost" else pa.string()))
            yield out

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fed.schema if f.name not in ("entry", "after"))
    return stored(fed.mapInArrow(run, f"{schema}, cost long, audit string, actions string, inserted string, ending string"))


def reports(solved: DataFrame) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost and audit of each conversation."""
    of_kind = lambda x: F.sum(F.char_length("kinds") - F.char_length(F.replace("kinds", F.lit(x)))).alias
    line = F.concat(F.coalesce("before", F.lit("")), "initials")
    legal = F.expr("size(filter(sequence(1, char_length(_line)), i -> substring(_line, i, 2) IN ('su', 'ua', 'au')))")
    rows = solved.withColumn("_line", line).withColumn("_bad", F.char_length("_line") - 1 - legal).withColumn("_new", F.col("turns") - F.coalesce((F.col("high_before") == F.col("low")).cast("int"), F.lit(0)))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    out = rows.groupBy("conv").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("_new").alias("turns"), of_kind("b")("blank"), of_kind("d")("duplicate"), of_kind("t")("truncated"),
        F.sum("_bad").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "").alias("audit"),
    )
    gaps = F.coalesce((wide("high") - wide("low") + 1 - wide("turns")), F.lit(0).cast("decimal(22,0)")).try_cast("long")
    return out.select("conv", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def _spoken(initial: Column, text: Column) -> Column:
    return F.concat(F.when(initial == "u", ROLES["u"]).when(initial == "a", ROLES["a"]), F.lit(":"), text)


def repaired_turns(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """(conv, block, pos, lines): per row ``role:text`` of what is inserted before it, of itself, and of what ends the conversation."""
    marks = solved.select(F.col("block"), "actions", "inserted", "ending", F.char_length("actions").alias("_n"))
    at = lambda c: F.substring(c, F.col("pos") + 1, F.lit(1))
    act, none = at(F.col("actions")), F.lit("")
    own = F.when(act == "K", F.concat("role", F.lit(":"), "text")).when(act != "D", _spoken(F.lower(act), F.col("text")))
    ended = F.when(F.col("pos") == F.col("_n") - 1, F.when(F.col("ending") == "ua", "user:\nassistant:").when(F.col("ending") == "a", "assistant:"))
    lines = F.nullif(F.concat_ws("\n", _spoken(at(F.col("inserted")), none), own, ended), none)
    return rows.join(fitted(marks), "block").select("conv", "block", "pos", lines.alias("lines"))


def repair_conversations(
    rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES
) -> tuple[DataFrame, DataFrame]:
    """The report of each conversation, and its repaired turns (see ``repaired_turns``)."""
    cut = numbered(rows, id_col, turn_col, role_col, text_col, block_rows, block_bytes)
    solved = solved_blocks(judged_blocks(cut))
    return reports(solved), repaired_turns(cut, solved)


def with_digest(report: DataFrame, turns: DataFrame) -> DataFrame:
    """report plus repaired_sha256: of the repaired turns, joined by newlines."""
    joined = F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "lines"))), lambda x: x["lines"]), "\n"), F.lit(""))
    blocks = turns.groupBy("conv", "block").agg(joined.alias("repaired_sha256"))
    ids = turns.select("conv", "block").distinct()
    several = ids.select("block", F.count("*").over(Window.partitionBy("conv")).alias("_of")).where("_of > 1").select("block")
    hashes = folded(blocks, several, (), ("repaired_sha256",), "\n").withColumnRenamed("conv", "_conv")
    return report.join(hashes, F.col("conv").eqNullSafe(F.col("_conv"))).drop("_conv")


def damaged(rows: DataFrame) -> DataFrame:
    """The rows of conversations after the damage that the query states; nulls count as one space."""
    space = F.lit(" ")
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    fault = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))) % 20
    hit = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault.alias("_fault")).where("_fault > 0")
    f = F.col("_fault")
    text = F.when(f == 1, "").when(f == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    out = hit.select("conv_id", "turn", F.when(f == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(f == 3, 2).otherwise(1))))
    return out.drop("col")


_EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # of no bytes


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = with_digest(*repair_conversations(damaged(rows)))
    every = rows.select("conv_id").distinct()
    none = {c: F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left").select("conv_id", *none.values(), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(_EMPTY)).alias("repaired_sha256"))


_WS = r"[^\x20\x09-\x0D]"
#: The damage, the faults, and a step a row over the four last roles; each keeps its cheapest and ASCII-least audit.
ORACLE_SQL = rf"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_concat([4294967295::BIGINT],
    [ascii(x)::BIGINT FOR x IN string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')]),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 20 AS f FROM conversations),
hit AS (SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role,
    CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE f WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM keyed WHERE f > 0),
lines AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, left(role, 1) AS r FROM hit),
marked AS MATERIALIZED (SELECT *, CASE WHEN NOT regexp_matches(text, '{_WS}') THEN 'b' WHEN nth > 1 THEN 'd' WHEN regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN '-' ELSE 't' END AS kind,
    lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS r0, count(*) OVER (PARTITION BY conv_id) AS n FROM lines),
moves(a, b, ins) AS (VALUES ('^', 's', ''), ('^', 'u', ''), ('^', 'a', 'u'), ('s', 'u', ''), ('s', 'a', 'u'), ('u', 'a', ''), ('u', 'u', 'a'), ('a', 'u', ''), ('a', 'a', 'u')),
steps AS MATERIALIZED (SELECT conv_id, i, n, a, b, 5 * length(ins) + (r <> b)::INT + CASE kind WHEN 't' THEN 5 ELSE 0 END AS cost, repeat('I', length(ins)) || CASE WHEN r = b THEN 'K' ELSE 'R' END AS audit,
    CASE ins WHEN 'u' THEN chr(10) || 'user:' WHEN 'a' THEN chr(10) || 'assistant:' ELSE '' END || chr(10) || CASE WHEN r = b THEN role WHEN b = 'u' THEN 'user' ELSE 'assistant' END || ':' || text AS said
  FROM marked, moves WHERE kind NOT IN ('b', 'd') AND (b <> 's' OR r = 's')
  UNION ALL SELECT conv_id, i, n, s, s, 2, 'D', '' FROM marked, (VALUES ('^'), ('s'), ('u'), ('a')) v(s)),
best(conv_id, i, s, p) AS (SELECT DISTINCT conv_id, 0::BIGINT, '^', {{'cost': 0::BIGINT, 'audit': '', 'said': ''}} FROM marked
  UNION ALL SELECT t.conv_id, t.i, t.b, min({{'cost': p.cost + t.cost, 'audit': p.audit || t.audit, 'said': p.said || t.said}})
  FROM best JOIN steps t ON t.conv_id IS NOT DISTINCT FROM best.conv_id AND t.i = best.i + 1 AND t.a = best.s GROUP BY t.conv_id, t.i, t.b),
ended AS (SELECT best.conv_id, min({{'cost': p.cost + CASE s WHEN 's' THEN 10 WHEN 'u' THEN 5 ELSE 0 END, 'audit': p.audit || CASE s WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END,
    'said': p.said || CASE s WHEN 's' THEN chr(10) || 'user:' || chr(10) || 'assistant:' WHEN 'u' THEN chr(10) || 'assistant:' ELSE '' END}}) AS p
  FROM best JOIN (SELECT conv_id, max(n) AS n FROM marked GROUP BY conv_id) m ON m.conv_id IS NOT DISTINCT FROM best.conv_id AND m.n = best.i GROUP BY best.conv_id),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE kind = 'b') AS blank, count(*) FILTER (WHERE kind = 'd') AS duplicate,
    count(*) FILTER (WHERE kind = 't') AS truncated, count(*) FILTER (WHERE i > 1 AND r0 || r NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(p.cost, 0)::BIGINT AS cost, coalesce(p.audit, '') AS audit, sha256(coalesce(substr(p.said, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM o.conv_id
"""
