"""Repair of conversation structure by depth-first branch-and-bound.

A conversation is to read system? (user assistant)+, or to be empty. Rows may
be kept, rerolled (to user or assistant) or deleted, and rows without text may
be inserted; the cheapest edits win, and among equals the audit (the edits'
initials in order) that is least in ASCII. The search has an explicit stack.
Its nodes are (rows done, state, cost, audit), a state being what stands last:
nothing, system, user or assistant. It prunes

* by a lower bound of every suffix, the cost of a relaxed problem in which a
  conversation may end anywhere (after system, or after an unanswered user);
* by the incumbent (cost, audit): a node whose cost and bound exceed its cost,
  or equal it while the audit so far is greater, cannot lead to a better one;
* by a dominance table: a prefix is dropped if a better (cost, audit) has
  reached the same rows and state. Equal costs there mean that no audit is a
  beginning of the other (more insertions cost more), so what follows cannot
  change their order.

Children are visited cheapest bound first, so the first leaf is mostly the
optimum; the search ends when the stack is empty, which proves it.

A conversation of any length is cut into segments of ``SEGMENT`` rows, in
tasks of their own: for each state that a segment may begin in, and each that
it may end in, the search finds the best edits, and the segments' answers are
joined in order. Rows are range-sorted, so that a conversation with a third
of all rows is sorted in many tasks. What one row of the result holds of a
conversation is its audit, a byte for each row.

Edge cases: in a row, a null role or text counts as one space. Rows are taken
by turn (nulls first), rows of equal turn by role and text. A role's first
character decides; rows with an empty role, or one that begins otherwise than
s, u or a, cannot be kept as they are. A row is blank, else a duplicate (role
and text stood earlier in its conversation), else truncated; repeated rows
are duplicates of each other. Rows with a null conversation id are one
conversation. An empty table gives an empty result. Columns that are not
named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, ship, slices, stage

#: Rows searched at once.
SEGMENT = 128
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
START, SYSTEM, USER, ASSISTANT = range(4)
#: A row as one character: the role's initial (x: none of them), upper case if truncated, a digit if it must go.
CLEAN, CUT, GONE = "suax", "SUAX", "1234"
ANSWER = "array<struct<entry:int,exit:int,cost:bigint,audit:string>>"
PIECE = "array<struct<row:int,role:string>>"


def after(state: int, initial: str) -> int | None:
    """The state after one more row, if the pattern allows it."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if state == USER and initial == "a" else None


def next_role(state: int) -> str:
    """The only one of user and assistant that may follow."""
    return "a" if state == USER else "u"


def suffix_bounds(rows: str) -> list[list[int]]:
    """[row][state]: what the rows from there on cost at least."""
    bounds = [[0] * 4]
    for c in reversed(rows):
        later, must_go = bounds[-1], c in GONE
        extra = TRUNCATED if c in CUT else 0
        best = []
        for state in range(4):
            cost = DELETE + later[state]
            if not must_go:
                cost = min(cost, REROLE + extra + later[after(state, next_role(state))])
                kept = after(state, c.lower())
                if kept is not None:
                    cost = min(cost, KEEP + extra + later[kept])
            best.append(cost)
        bounds.append([min(best[s], INSERT + best[after(s, next_role(s))]) for s in range(4)])
    return bounds[::-1]


def search(rows: str, entry: int, exits: tuple[int, ...]) -> tuple[int, str, int] | None:
    """The least (cost, audit) that leads from ``entry`` to one of ``exits``, and that exit."""
    n, bounds = len(rows), suffix_bounds(rows)
    best: tuple[int, str, int] | None = None
    reached: dict[tuple[int, int], tuple[int, str]] = {(0, entry): (0, "")}
    stack = [(0, entry, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        if reached[i, state] != (cost, audit):  # a better prefix came since
            continue
        if best is not None:
            least = cost + bounds[i][state]
            if least > best[0] or least == best[0] and audit > best[1][:len(audit)]:
                continue
        if i == n and state in exits and (best is None or (cost, audit) < best[:2]):
            best = cost, audit, state
        children = [(i, after(state, next_role(state)), cost + INSERT, audit + "I")]
        if i < n:
            c = rows[i]
            children.append((i + 1, state, cost + DELETE, audit + "D"))
            if c not in GONE:
                extra = TRUNCATED if c in CUT else 0
                children.append((i + 1, after(state, next_role(state)), cost + REROLE + extra, audit + "R"))
                kept = after(state, c.lower())
                if kept is not None:
                    children.append((i + 1, kept, cost + KEEP + extra, audit + "K"))
        elif state not in exits and audit.endswith("II"):
            children = []  # two insertions lead from a state back to it
        # The last one pushed is visited first: the least bound, then the least audit
        children.sort(key=lambda x: (x[2] + bounds[x[0]][x[1]], x[3]), reverse=True)
        for child in children:
            known = reached.get(child[:2])
            if known is None or child[2:] < known:
                reached[child[:2]] = child[2:]
                stack.append(child)
    return best


@lru_cache(maxsize=20_000)
def answers(rows: str, first: bool, last: bool) -> list[tuple[int, int, int, str]]:
    """(entry, exit, cost, audit) of a segment, for each way it may stand among others."""
    found = []
    for entry in [START] if first else range(4):
        for wanted in [(START, ASSISTANT)] if last else [(s,) for s in range(4)]:
            best = search(rows, entry, wanted)
            if best:
                found.append((entry, best[2], best[0], best[1]))
    return found


def chain(segments: list[list[dict]]) -> tuple[int, list[tuple[int, str]]]:
    """The cost and each segment's (entry, audit) of the least (cost, whole audit) through all segments' answers."""
    reached = {START: (0, "", ())}
    for segment in segments:
        ahead: dict[int, tuple] = {}
        for x in segment:
            if x["entry"] in reached:
                cost, audit, way = reached[x["entry"]]
                new = (cost + x["cost"], audit + x["audit"], (way, (x["entry"], x["audit"])))
                if x["exit"] not in ahead or new[:2] < ahead[x["exit"]][:2]:
                    ahead[x["exit"]] = new
        reached = ahead
    cost, _, way = min((reached[s] for s in (START, ASSISTANT) if s in reached), key=lambda x: x[:2])
    steps = []
    while way:
        way, step = way
        steps.append(step)
    return cost, steps[::-1]


def pieces(audit: str, rows: str, state: int) -> list[tuple[int | None, str | None]]:
    """The repaired rows of a segment: (row number or None for a new one, new role or None)."""
    out, i = [], 0
    for edit in audit:
        if edit == "K":
            out.append((i, None))
            state = after(state, rows[i].lower())
        elif edit != "D":
            role = next_role(state)
            out.append((None if edit == "I" else i, "user" if role == "u" else "assistant"))
            state = after(state, role)
        i += edit != "I"
    return out


def illegal_pairs(rows: str) -> int:
    initials = rows.lower().translate(str.maketrans(GONE, CLEAN))
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def judged(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text), staged in order, with ``mark`` (one character), ``fault``, ``part``, ``segment`` and ``row``."""
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    # Copies in one conversation are numbered by turn, a group for each text; only the first is none
    copy = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn")))
    body = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(body == "", "blank").when(F.col("copy") > 1, "duplicate").when(~F.right(body, F.lit(1)).isin(".", "!", "?"), "truncated")
    kind = F.substring("role", 1, 1)
    kind = F.when(kind.isin("s", "u", "a"), kind).otherwise("x")
    mark = F.when(F.col("fault").isin("blank", "duplicate"), F.translate(kind, CLEAN, GONE)).when(F.col("fault") == "truncated", F.upper(kind)).otherwise(kind)
    order = ["conv_id", "turn", "role", "text", "copy"]
    placed = clean.withColumn("copy", copy).withColumn("fault", fault).withColumn("mark", mark).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage(placed.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id()), "turns")
    starts = placed.groupBy(F.col("conv_id").alias("c"), F.col("part").alias("p")).agg(F.min("at").alias("from"))
    row = F.col("at") - F.col("from")
    return placed.join(starts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))) \
        .select("conv_id", "turn", "role", "text", "fault", "mark", "part", F.floor(row / SEGMENT).alias("segment"), (row % SEGMENT).cast("int").alias("row"))


def segments(marked: DataFrame) -> DataFrame:
    """(conv_id, part, segment, rows, first, last): each segment's marks in order, at most ``SEGMENT`` of them."""
    marks = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "mark"))), lambda x: x["mark"]), "")
    rows = marked.groupBy("conv_id", "part", "segment").agg(marks.alias("rows"))
    own = Window.partitionBy("conv_id")  # a row for each segment
    ahead, back = own.orderBy("part", "segment"), own.orderBy(F.desc("part"), F.desc("segment"))
    return rows.withColumn("first", F.row_number().over(ahead) == 1).withColumn("last", F.row_number().over(back) == 1)


def solved(parts: DataFrame) -> DataFrame:
    """Segments with their answers, each searched in the task that holds it."""
    kind = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [[dict(zip(("entry", "exit", "cost", "audit"), a)) for a in answers(*x)]
                     for x in zip(*(batch.column(c).to_pylist() for c in ("rows", "first", "last")))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, "answers"])

    return parts.mapInArrow(run, f"{_ddl(parts)}, answers {ANSWER}")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def plans(parts: DataFrame) -> DataFrame:
    """(conv_id, illegal, cost, audit, plan) of each conversation; ``plan``: (part, segment, pieces) of its segments."""
    ordered = F.array_sort(F.collect_list(F.struct("part", "segment", "rows", "answers")))
    whole = solved(parts).groupBy("conv_id").agg(ordered.alias("s"))
    piece = pa.list_(pa.struct([("row", pa.int32()), ("role", pa.string())]))
    plan = pa.list_(pa.struct([("part", pa.int32()), ("segment", pa.int64()), ("pieces", piece)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            illegal, costs, audits, made = [], [], [], []
            for s in batch.column("s").to_pylist():
                cost, steps = chain([x["answers"] for x in s])
                illegal.append(illegal_pairs("".join(x["rows"] for x in s)))
                costs.append(cost)
                audits.append("".join(a for _, a in steps))
                made.append([{"part": x["part"], "segment": x["segment"], "pieces": [{"row": r, "role": role} for r, role in pieces(a, x["rows"], e)]}
                             for x, (e, a) in zip(s, steps)])
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(illegal, pa.int64()), pa.array(costs, pa.int64()), pa.array(audits, pa.string()),
                                              pa.array(made, plan)], names=["conv_id", "illegal", "cost", "audit", "plan"])

    kind = whole.schema["conv_id"].dataType.simpleString()
    return whole.mapInArrow(run, f"conv_id {kind}, illegal long, cost long, audit string, plan array<struct<part:int,segment:bigint,pieces:{PIECE}>>")


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From turns (conv_id, turn, role, text): (report, repaired).

    report: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    a row for each conversation. repaired: conv_id, turn, role, text, and
    part, segment, place, which order a conversation's rows; a new row has no
    turn.
    """
    ship(turns.sparkSession)
    marked = stage(judged(turns), "judged")
    planned = stage(plans(segments(marked)), "plans")
    count = lambda f: F.count_if(F.col("fault") == f).alias(f)
    span = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    counts = marked.groupBy(F.col("conv_id").alias("c")).agg(F.coalesce(span, F.lit(0)).cast("long").alias("gaps"), count("blank"), count("duplicate"), count("truncated"))
    report = planned.join(counts, F.col("conv_id").eqNullSafe(F.col("c"))) \
        .select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    wanted = planned.select(F.col("conv_id").alias("c"), F.explode("plan").alias("s")) \
        .select("c", F.col("s.part").alias("p"), F.col("s.segment").alias("g"), F.posexplode("s.pieces").alias("place", "x")) \
        .select("c", "p", "g", "place", F.col("x.row").alias("r"), F.col("x.role").alias("new_role"))
    same = F.col("c").eqNullSafe(F.col("conv_id")) & (F.col("p") == F.col("part")) & (F.col("g") == F.col("segment")) & (F.col("r") == F.col("row"))
    repaired = wanted.join(marked, same, "left").select(
        F.col("c").alias("conv_id"), "turn", F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.col("p").alias("part"), F.col("g").alias("segment"), "place")
    return report, repaired


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256). A hash is sequential, so a conversation's sorted rows stream past one task; none is held."""
    order = ["conv_id", "part", "segment", "place"]
    sent = repaired.select(*order, F.concat_ws(":", "role", "text").alias("line")).repartition("conv_id").sortWithinPartitions(*order)
    kind = repaired.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_id, sha, typ = None, None, None
        for batch in slices(batches):
            done: list[tuple] = []
            typ = batch.schema.field("conv_id").type
            for conv, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist()):
                if sha is None or conv != open_id:
                    if sha is not None:
                        done.append((open_id, sha.hexdigest()))
                    open_id, sha = conv, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(line.encode())
            yield _pairs(done, typ)
        if sha is not None:
            yield _pairs([(open_id, sha.hexdigest())], typ)

    return sent.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def _pairs(rows: list[tuple], typ: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], typ), pa.array([r[1] for r in rows], pa.string())], names=["conv_id", "repaired_sha256"])


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage, by a checksum of conversation and turn."""
    space = F.lit(" ")
    of = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), of.alias("d")).where("d <> 0")
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.explode(F.array_repeat(F.lit(0), F.when(F.col("d") == 3, 2).otherwise(1))).alias("copy"))
    return rows.select("conv_id", "turn", "role", "text")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations")
    report, repaired = repair(damaged(conversations))
    hashed = digests(stage(repaired, "repaired"))
    ids = conversations.select(F.col("conv_id").alias("id")).distinct()
    full = ids.join(report, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id") \
        .join(hashed, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return full.select(F.col("id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                       F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
