"""Repair of conversation structure by signature deduplication.

A conversation's rows, in order, are encoded as one compact string with a sign for each row: its role's
initial (s, u, a or another) and its first fault (none, blank, duplicate, truncated). Conversations with equal
strings have equal repairs, so only the distinct strings are solved, each once, by a memoised recursion over
(place, state of the grammar ``(s?(ua)+)?``). The audits, the cheapest edits' initials in order, are joined back
to the conversations and replayed over their rows.

Edits: Keep (0), Rerole to user or assistant (3), Delete (4, required for blank and duplicate rows), Insert an
empty user or assistant turn (3); a truncated row that is not deleted costs 3 more. Of equally cheap audits the
one least in ASCII wins. In every state of the grammar one role alone may be given or inserted, so the initials
tell the whole edit.

Rows are put in order by a sort over the whole table (conversation, turn with nulls first, role, text), so a
conversation of any length is spread over many tasks; duplicates are found by a map-side aggregate over hashes of
role and text; a signature is put together from stretches of at most 4,096 rows and has a byte for each row. The
replay streams a conversation's rows through one task in order, with its audit as the first row; it holds one
row and the audit.

Null roles and texts count as one space. Null turns come first, and are no gap; a null conversation id is a
conversation of its own. Rows of one turn are ordered by role and text; repeated rows are duplicates. Texts of
any length are whole. Other columns, whatever their names, are ignored. An empty table gives an empty result;
conversations without rows have none in ``audits``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import NOT_SPACE, SPACES, finished, table, work_dir, written

#: Signs are put together by stretches of two to this power.
BLOCK_BITS = 12
#: The costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
OK, BLANK, DUPLICATE, CUT = range(4)
#: States of the grammar: 0 nothing yet, 1 after s, 2 after u, 3 after ua. Each state's role to give or insert, and where it leads.
GIVEN, NEXT = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
LEGAL = frozenset(("su", "ua", "au"))


def keeps(role: str, state: int) -> int | None:
    """The state after a kept row with this initial, or None where it may not stand."""
    if role == "s":
        return 1 if state == 0 else None
    return NEXT[state] if role == GIVEN[state][0] else None


def signs(signature: str) -> list[tuple[str, int]]:
    """(role's initial, fault) of each row; other initials are "-"."""
    return [("sua-"[x >> 2], x & 3) for x in (int(c, 16) for c in signature)]


def solve(signature: str) -> tuple[int, str]:
    """Cost and audit of the cheapest repair; of equals, the audit least in ASCII."""
    rows = signs(signature)
    n, memo = len(rows), {}

    def taken(i: int, state: int) -> list[tuple[str, int, int]]:
        """The edits that take row ``i``: initial, cost, state behind it."""
        role, fault = rows[i]
        out = [("D", DELETE, state)]
        if fault not in (BLANK, DUPLICATE):
            stays = TRUNCATED * (fault == CUT)
            if (after := keeps(role, state)) is not None:
                out.append(("K", stays, after))
            out.append(("R", REROLE + stays, NEXT[state]))
        return out

    def least(i: int, state: int, inserts: int = 2) -> float:
        """The cost from row ``i`` on; more than two inserts in a row lead back to a state at a cost."""
        if (key := (i, state, inserts)) not in memo:
            if i == n:
                best = 0 if state in (0, 3) else float("inf")
            else:
                best = min(cost + least(i + 1, after) for _, cost, after in taken(i, state))
            memo[key] = min(best, INSERT + least(i, NEXT[state], inserts - 1)) if inserts else best
        return memo[key]

    for i in range(n, -1, -1):  # from the end, so that no call goes deep
        for state in range(4):
            least(i, state)
    cost, audit, i, state = least(0, 0), [], 0, 0
    while i < n or state not in (0, 3):
        # each initial stands for one edit, so the least initial on a cheapest way begins the least audit
        ways = [(letter, c, i + 1, s) for letter, c, s in (taken(i, state) if i < n else ())] + [("I", INSERT, i, NEXT[state])]
        letter, _, i, state = min(w for w in ways if w[1] + least(w[2], w[3]) == least(i, state))
        audit.append(letter)
    return int(cost), "".join(audit)


def report(signature: str) -> tuple:
    rows = signs(signature)
    faults = [f for _, f in rows]
    illegal = sum(a + b not in LEGAL for (a, _), (b, _) in zip(rows, rows[1:]))
    return faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), illegal, *solve(signature)


REPORT = "blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def solved(signatures: DataFrame) -> DataFrame:
    """``(signature, blank, duplicate, truncated, illegal, cost, audit)``, each distinct signature once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            cols = list(zip(*map(report, own))) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:5]], pa.array(cols[5], pa.string())], names=["signature", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    return signatures.select("signature").distinct().mapInArrow(run, f"signature string, {REPORT}")


def ordered(rows: DataFrame, work: str) -> DataFrame:
    """``rows(conv, turn, role, text)`` as a table, with ids that ascend in the order of each conversation."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text"))
    said = rows.select("conv", "turn", role, text).orderBy("conv", F.asc_nulls_first("turn"), "role", "text")
    bare = F.btrim("text", F.lit(SPACES))
    own = F.when(~F.col("text").rlike(NOT_SPACE), BLANK).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(OK)
    hashes = [F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit("turn"), "role", "text").alias("h2")]
    initial = F.coalesce(F.nullif(F.instr(F.lit("sua"), F.when(F.col("role") != "", F.left("role", F.lit(1))).otherwise("-")), F.lit(0)), F.lit(4)) - 1
    return written(said.select("conv", F.monotonically_increasing_id().alias("id"), "turn", "role", "text", initial.alias("initial"), own.alias("fault"), *hashes), f"{work}/ordered")


def signatures(rows: DataFrame) -> DataFrame:
    """``(conv, signature)`` of ordered rows."""
    firsts = rows.groupBy("conv", "h1", "h2").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    marked = rows.select("conv", "id", "initial", "fault", "h1", "h2").join(firsts, ["conv", "h1", "h2"], "left")
    fault = F.when(F.col("fault") == BLANK, BLANK).when(F.col("id") > F.col("first"), DUPLICATE).otherwise(F.col("fault"))
    sign = marked.select("conv", "id", F.lower(F.hex(F.col("initial") * 4 + fault)).alias("sign"))
    joined = lambda order, c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, c))), lambda x: x[c]), "").alias(c)
    pieces = sign.groupBy("conv", F.shiftright("id", BLOCK_BITS).alias("block")).agg(joined("id", "sign"))
    return pieces.groupBy("conv").agg(joined("block", "sign")).withColumnRenamed("sign", "signature")


def audits(rows: DataFrame, work: str) -> DataFrame:
    """``(conv, blank, duplicate, truncated, illegal, cost, audit)`` of ordered rows."""
    own = written(signatures(rows), f"{work}/signatures")
    return written(own.join(solved(own), "signature").drop("signature"), f"{work}/audits")


def replayed(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The repaired turns ``(conv, place, edit, role, text)``: the audits of ``plans`` replayed over ordered rows.
    A conversation's turns are in one partition, in order and together."""
    head = plans.select("conv", F.lit(-1).cast("long").alias("id"), "audit", F.lit("").alias("role"), F.lit("").alias("text"))
    body = rows.select("conv", "id", F.lit("").alias("audit"), "role", "text")
    both = head.unionByName(body).repartition("conv").sortWithinPartitions("conv", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, place, state, out = None, "", 0, 0, 0, []

        def put(edit: str, role: str, text: str) -> None:
            nonlocal place, state
            out.append((conv, place, edit, role, text))
            place += 1
            state = 1 if state == 0 and role[:1] == "s" else NEXT[state]

        def inserts() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                put("I", GIVEN[state], "")
                at += 1

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()))], names=["conv", "place", "edit", "role", "text"])

        for batch in batches:
            for c, i, edits, role, text in zip(*(x.to_pylist() for x in batch.columns)):
                if i < 0:
                    inserts()  # at the end of the conversation before
                    conv, audit, at, place, state = c, edits, 0, 0, 0
                    continue
                inserts()
                edit = audit[at]
                at += 1
                if edit != "D":
                    put(edit, GIVEN[state] if edit == "R" else role, text)
            yield batch_of(out)
            out.clear()
        inserts()
        yield batch_of(out)

    return both.mapInArrow(run, "conv string, place long, edit string, role string, text string")


def digests(turns: DataFrame) -> DataFrame:
    """``(conv, sha256)`` over ``role:text`` of replayed turns, joined by line feeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha, done = None, None, []
        for batch in batches:
            for c, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv", "role", "text"))):
                if c != conv:
                    done += [(conv, sha.hexdigest())] if sha else []
                    conv, sha = c, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            cols = list(zip(*done)) or [(), ()]
            done = []
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in cols], names=["conv", "sha256"])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([sha.hexdigest()])], names=["conv", "sha256"])

    return turns.mapInArrow(run, "conv string, sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """``rows(conv, turn, role, text)`` with the faults that crc32(``conv:turn``) plants; nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.crc32(F.encode(F.concat(F.when(F.col("conv") == "", " ").otherwise(F.col("conv")), F.lit(":"), space("turn")), "UTF-8")) % 20
    rows = rows.select("conv", "turn", space("role").alias("role"), space("text").alias("text"), key.alias("k")).where("k <> 0")
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.sequence(F.lit(1), F.when(F.col("k") == 3, 2).otherwise(1))
    return rows.select("conv", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def keyed(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv, turn, role, text)``; the id's decimal text, empty for null, names a conversation."""
    conv: Column = F.coalesce(F.col(conv_col).cast("long").cast("string"), F.lit(""))
    return conversations.select(conv.alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    work = work_dir(spark)
    whole = keyed(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    rows = ordered(damaged(whole), work)
    found = audits(rows, work)
    sha = digests(replayed(rows, found))
    gaps = rows.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    out = whole.select("conv").distinct().join(found, "conv", "left").join(gaps, "conv", "left").join(sha, "conv", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256().hexdigest()
    out = out.select(F.nullif("conv", F.lit("")).cast("long").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(nothing)).alias("repaired_sha256"))
    return finished(out, work)


def _sql() -> str:
    """The repair as a recursion over the rows from the last to the first, with the best rest for each state."""
    way = lambda letter, cost, line, rest: f"{{'c': ({rest}).c + {cost}, 'a': '{letter}' || ({rest}).a, 't': {line} || ({rest}).t}}"
    never = "{'c': 1000000000, 'a': '', 't': ''}"
    line = "chr(10) || {} || ':' || text"
    base, full, ends = [], [], []
    for s in range(4):
        stays = "(case when fault = 'cut' then 3 else 0 end)"
        kept = f"case when fault in ('', 'cut') and left(role, 1) = '{GIVEN[s][0]}' then {way('K', stays, line.format('role'), f'f{NEXT[s]}')} else {never} end"
        first = f"case when fault in ('', 'cut') and left(role, 1) = 's' then {way('K', stays, line.format('role'), 'f1')} else {never} end" if s == 0 else never
        given = f"case when fault in ('', 'cut') then {way('R', f'3 + {stays}', line.format(repr(GIVEN[s])), f'f{NEXT[s]}')} else {never} end"
        base.append(f"list_min([{way('D', 4, repr(''), f'f{s}')}, {kept}, {first}, {given}]) as b{s}")
        once = way("I", 3, f"chr(10) || '{GIVEN[s]}:'", f"b{NEXT[s]}")
        twice = way("I", 3, f"chr(10) || '{GIVEN[s]}:'", way("I", 3, f"chr(10) || '{GIVEN[NEXT[s]]}:'", f"b{NEXT[NEXT[s]]}"))
        full.append(f"list_min([b{s}, {once}, {twice}]) as f{s}")
        ends.append(f"{{'c': 0, 'a': '', 't': ''}} as b{s}" if s in (0, 3) else f"{never} as b{s}")
    states = ", ".join(f"f{s}" for s in range(4))
    return f"""
with recursive k as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
  xor(list_reduce([4294967295] || list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda c: ascii(c)::bigint),
    lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)), 4294967295) % 20 as k from conversations),
d as (select conv_id, turn, case when k = 4 then 'user' else role end as role, case k when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text from k, (select unnest([1, 2]) as copy) where k <> 0 and (copy = 1 or k = 3)),
p as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i,
  lag(left(role, 1)) over (partition by conv_id order by turn nulls first, role, text) || left(role, 1) as pair from d),
r as (select *, case when not regexp_matches(text, '[^\\x20\\x09-\\x0D]') then 'blank' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate' when not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') then 'cut' else '' end as fault from p),
m as (select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'cut') as truncated,
  count(*) filter (pair not in ('su', 'ua', 'au')) as illegal from r group by conv_id),
w as (
  select conv_id, n as i, {', '.join(full)} from (select conv_id, n, {', '.join(ends)} from m)
  union all
  select conv_id, i, {', '.join(full)} from (select w.conv_id, w.i - 1 as i, {', '.join(base)} from w join r on w.conv_id is not distinct from r.conv_id and r.i = w.i)
)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
       coalesce(f0.c, 0)::bigint as cost, coalesce(f0.a, '') as audit, sha256(coalesce(f0.t[2:], '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join m on c.conv_id is not distinct from m.conv_id left join (select conv_id, f0 from w where i = 0) z on c.conv_id is not distinct from z.conv_id
"""


SQL = _sql()
