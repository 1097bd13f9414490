"""Conversation structure repair (operator 11): the cheapest edits after which the roles read system?(user assistant)+ or nothing.

A row of a conversation becomes one symbol: its role's initial and its fault. Blank and repeated rows must go; a truncated row may
stay at a cost of 1. Cost and choice of the remaining edits depend on the symbols that follow and on the state of the grammar alone, so
conversations share them from the end: signatures are sorted by their reverse, and a walk over the sorted ones is a walk over the automaton of
all suffixes, whose nodes hold, for each grammar state, the cost to go, the best next edit and where it leads. Each node is
worked out once, for all conversations that end alike, and a signature's best audit is read off its nodes.

1. Rows that are equal count once, with their number; a row is a duplicate if its role and text have an earlier turn.
2. Rows are range partitioned by conversation and turn, so that a very long conversation is cut over several tasks: a fragment is what one task holds of it.
3. The distinct signatures of fragments give the costs from each state before to each state after them, and a
   conversation's fragments, walked from the last to the first, the costs to go behind each.
4. The distinct (signature, costs to go behind it) give audits by the automaton; fragments walked forward give the conversation's.
5. The edits meet the texts in the order of the rows; texts are shuffled once, for their digest.

Step 5 needs a conversation's rows in one task, one after the other, as SHA-256 can't be computed in parts; it holds the audit (a letter
a row) and one batch of rows. All other steps split a conversation.

Defined results: NULLs count as one space, also in the ids of damage; a NULL conv_id is a conversation of its own. Rows of one turn
are ordered by role, then by the SHA-256 of the text. An empty role has no initial and can't be kept. Other columns of the input play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, save, table

SPACE = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: Grammar states: at the start, after system, after user, after assistant. Only the first and the last may end.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
#: What a user or assistant put in, or made of another role, leads to.
GIVEN = (USER, USER, ASSISTANT, USER)
GIVEN_ROLE = ("user", "user", "assistant", "user")
#: Where a kept row of an initial leads.
KEPT = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}
#: Costs to go at the end of a conversation: what is missing is put in.
END = (0, 2 * INSERT, INSERT, 0)
NEVER = 1 << 40
#: Symbol of a row that must go; others are the initial (o: any other role), in capitals if truncated.
GONE = "x"


class Node:
    """A suffix of signatures: per grammar state the cost to go, the best edit's letter and the state it leads to."""

    __slots__ = ("cost", "letter", "to")

    def __init__(self, symbol: str, after: tuple[int, ...] | list[int]):
        initial, fault = symbol.lower(), TRUNCATED if symbol.isupper() else 0
        edits = []
        for state in STATES:
            found = [(DELETE + after[state], "D", state)]
            if symbol != GONE:
                kept = KEPT[initial][state] if initial in KEPT else None
                if kept is not None:
                    found.append((fault + after[kept], "K", kept))
                if (GIVEN[state], initial) not in ((USER, "u"), (ASSISTANT, "a")):
                    found.append((REROLE + fault + after[GIVEN[state]], "R", GIVEN[state]))
            edits.append(found)
        cost = [min(found)[0] for found in edits]
        for _ in range(3):
            cost = [min(cost[state], INSERT + cost[GIVEN[state]]) for state in STATES]
        self.cost, self.letter, self.to = cost, [], []
        for state in STATES:
            options = [(letter, to) for price, letter, to in edits[state] if price == cost[state]]
            if INSERT + cost[GIVEN[state]] == cost[state]:
                options.append(("I", GIVEN[state]))
            letter, to = min(options)
            self.letter.append(letter)
            self.to.append(to)


def _suffixes(signatures: Iterator[tuple[str, tuple[int, ...]]]) -> Iterator[list[Node]]:
    """The nodes of each signature from its end, for (reversed signature, costs behind it) sorted by costs, then signature."""
    path: list[Node] = []
    before, behind = "", None
    for backwards, costs in signatures:
        if costs != behind:
            path, before, behind = [], "", costs
        common = 0
        for a, b in zip(before, backwards):
            if a != b:
                break
            common += 1
        del path[common:]
        for symbol in backwards[common:]:
            path.append(Node(symbol, path[-1].cost if path else costs))
        before = backwards
        yield path


def read_off(path: list[Node], state: int) -> tuple[str, int]:
    """Best audit from `state` over all nodes, and the state it ends in."""
    at, letters = len(path) - 1, []
    while at >= 0:
        letter = path[at].letter[state]
        letters.append(letter)
        state = path[at].to[state]
        at -= letter != "I"
    return "".join(letters), state


def _rows(frames: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for frame in frames:
        yield from zip(*(frame.column(name).to_pylist() for name in names))


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 2048, letters: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches of `most` rows, or fewer where strings are long."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(value) for value in row if isinstance(value, str))
        if len(held) >= most or size >= letters:
            yield pa.record_batch([pa.array(values, field.type) for values, field in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(values, field.type) for values, field in zip(zip(*held), schema)], schema=schema)


def _fragments(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation and task: its signature, its first and last initial and its pairs of adjacent roles that are not allowed."""

    def found():
        key, symbols, first, last, illegal = None, [], "", "", 0
        for of, role, blank, truncated, fresh, n, part in _rows(frames, "key", "role", "blank", "truncated", "fresh", "n", "part"):
            initial = role[:1]
            if of != key:
                if key is not None:
                    yield key, where, "".join(symbols), first, last, illegal
                key, where, symbols, first, illegal = of, part, [], initial, 0
            else:
                illegal += last + initial not in ("su", "ua", "au")
            illegal += n - 1
            last = initial
            if blank or not fresh:
                symbols.append(GONE * n)
            else:
                symbol = initial if initial in KEPT else "o"
                symbols.append((symbol.upper() if truncated else symbol) + GONE * (n - 1))
        if key is not None:
            yield key, where, "".join(symbols), first, last, illegal

    schema = pa.schema([("key", pa.string()), ("part", pa.int32()), ("signature", pa.string()), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64())])
    yield from _batches(found(), schema)


def _transfers(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each signature the cheapest costs from each state before it (rows) to each state after it."""

    def found():
        paths: list[list[Node]] = [[] for _ in STATES]
        before = ""
        for (backwards,) in _rows(frames, "backwards"):
            common = 0
            for a, b in zip(before, backwards):
                if a != b:
                    break
                common += 1
            for end, path in zip(STATES, paths):
                del path[common:]
                for symbol in backwards[common:]:
                    path.append(Node(symbol, path[-1].cost if path else [0 if state == end else NEVER for state in STATES]))
            before = backwards
            yield backwards, [path[-1].cost[state] for state in STATES for path in paths]

    yield from _batches(found(), pa.schema([("backwards", pa.string()), ("transfer", pa.list_(pa.int64()))]))


def _behind(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks a conversation's fragments from the last to the first: the costs to go behind each, above the least of them."""

    def found():
        key, costs = None, END
        for of, part, backwards, transfer, first, last, illegal, leads in _rows(frames, "key", "part", "backwards", "transfer", "first", "last", "illegal", "leads"):
            ends = of != key
            if ends:
                key, costs = of, END
            yield of, part, backwards, first, last, illegal, list(costs), ends, leads
            costs = [min(transfer[4 * state + to] + costs[to] for to in STATES) for state in STATES]
            least = min(costs)
            costs = tuple(cost - least for cost in costs)

    schema = [("key", pa.string()), ("part", pa.int32()), ("backwards", pa.string()), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64())]
    yield from _batches(found(), pa.schema([*schema, ("costs", pa.list_(pa.int64())), ("ends", pa.bool_()), ("leads", pa.bool_())]))


def _audits(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best audit, its cost and the state after it for each signature, costs behind it and state before it."""

    def found():
        kept: list[tuple] = []

        def asked():
            for backwards, costs, ends, leads in _rows(frames, "backwards", "costs", "ends", "leads"):
                kept.append((backwards, costs, ends, leads))
                yield backwards, tuple(costs)

        for path in _suffixes(asked()):
            backwards, costs, ends, leads = kept.pop()
            for state in (START,) if leads else STATES:
                audit, after = read_off(path, state)
                cost = path[-1].cost[state] - (0 if ends else costs[after])
                yield backwards, costs, ends, leads, state, audit + ("I" * (END[after] // INSERT) if ends else ""), cost, after

    schema = [("backwards", pa.string()), ("costs", pa.list_(pa.int64())), ("ends", pa.bool_()), ("leads", pa.bool_())]
    yield from _batches(found(), pa.schema([*schema, ("state", pa.int64()), ("audit", pa.string()), ("cost", pa.int64()), ("after", pa.int64())]))


def _whole(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks a conversation's fragments forward: its audit, cost and pairs of roles that are not allowed."""

    def found():
        key, state, pieces, cost, illegal, last, part = None, START, [], 0, 0, "", None
        for of, at, enters, audit, price, after, first, ended, wrong in _rows(frames, "key", "part", "state", "audit", "cost", "after", "first", "last", "illegal"):
            if of != key:
                if key is not None:
                    yield key, "".join(pieces), cost, illegal
                key, state, pieces, cost, illegal, part = of, START, [], 0, 0, None
            if at == part or enters != state:
                continue
            if part is not None:
                illegal += last + first not in ("su", "ua", "au")
            pieces.append(audit)
            cost, illegal, last, state, part = cost + price, illegal + wrong, ended, after, at
        if key is not None:
            yield key, "".join(pieces), cost, illegal

    yield from _batches(found(), pa.schema([("key", pa.string()), ("audit", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64())]))


class _Repaired:
    """The digest of a repaired conversation, fed with its rows in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.digest, self.any = audit, 0, START, hashlib.sha256(), False

    def _add(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.any else "") + f"{role}:{text}").encode())
        self.any = True

    def inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._add(GIVEN_ROLE[self.state], "")
            self.state, self.at = GIVEN[self.state], self.at + 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self._add(role, text)
            self.state = KEPT[role[0]][self.state]
        elif letter == "R":
            self._add(GIVEN_ROLE[self.state], text)
            self.state = GIVEN[self.state]

    def result(self) -> str:
        self.inserts()
        return self.digest.hexdigest()


def _digests(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's row without text brings its audit, the others follow in order."""

    def found():
        key, repaired = None, None
        for of, role, text, audit, cost, illegal in _rows(frames, "key", "role", "text", "audit", "cost", "illegal"):
            if of != key:
                if key is not None:
                    yield *head, repaired.result()
                key, head, repaired = of, (of, audit, cost, illegal), _Repaired(audit)
            else:
                repaired.row(role, text)
        if key is not None:
            yield *head, repaired.result()

    schema = pa.schema([("key", pa.string()), ("audit", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64()), ("repaired_sha256", pa.string())])
    yield from _batches(found(), schema)


def key_of(conv_id: Column) -> Column:
    """The id as text that is never NULL."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def _placed(rows: DataFrame) -> DataFrame:
    """key, turn and its order, role, text and the text's digest of every row."""
    return rows.select(
        key_of(F.col("conv_id")).alias("key"), F.col("turn").isNotNull().alias("counted"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    ).withColumn("digest", F.unhex(F.sha2("text", 256)))


ORDER = ("counted", "turn", "role", "digest")


def faults(rows: DataFrame) -> DataFrame:
    """The different rows of each conversation without their texts: n equal ones, whether blank or truncated, and whether the first of them is `fresh` (seen in no earlier turn)."""
    end = F.rtrim("text", F.lit(SPACE))
    seen = _placed(rows).select("key", *ORDER, (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    once = seen.groupBy("key", *ORDER, "blank", "truncated").agg(F.count(F.lit(1)).alias("n"))
    first = once.groupBy("key", "role", "digest").agg(F.min(F.struct("counted", "turn")).alias("since"))
    met = once.join(first, ["key", "role", "digest"])
    return met.withColumn("fresh", F.struct("counted", "turn").eqNullSafe(F.col("since"))).drop("since")


def fault_counts(found: DataFrame) -> DataFrame:
    """gaps, blank, duplicate and truncated rows per conversation."""
    by_turn = found.groupBy("key", "counted", "turn").agg(
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(F.col("n") - F.col("fresh").cast("long"))).alias("duplicate"),
        F.sum((~F.col("blank") & F.col("fresh") & F.col("truncated")).cast("long")).alias("truncated"),
    )
    wide = F.col("high").cast("decimal(38,0)") - F.col("low").cast("decimal(38,0)") + 1 - F.col("turns")
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")]
    return (
        by_turn.groupBy("key").agg(*sums, F.min("turn").alias("low"), F.max("turn").alias("high"), F.count("turn").alias("turns"))
        .select("key", "blank", "duplicate", "truncated", F.coalesce(wide.try_cast("long"), F.lit(0)).alias("gaps"))
    )


def repair(rows: DataFrame) -> DataFrame:
    """key, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation of `rows` (conv_id, turn, role, text)."""
    found = save(faults(rows), "dialog-rows")
    dealt = found.repartitionByRange("key", *ORDER).sortWithinPartitions("key", *ORDER).withColumn("part", F.spark_partition_id())
    fragments = save(
        dealt.select("key", "role", "blank", "truncated", "fresh", "n", "part").mapInArrow(_fragments, "key string, part int, signature string, first string, last string, illegal long")
        .withColumn("backwards", F.reverse("signature")).drop("signature"),
        "dialog-fragments",
    )
    sorted_ones = fragments.select("backwards").distinct().repartitionByRange("backwards").sortWithinPartitions("backwards")
    transfers = save(sorted_ones.mapInArrow(_transfers, "backwards string, transfer array<long>"), "dialog-transfers")
    starts = fragments.groupBy("key").agg(F.min("part").alias("start"))
    chained = fragments.join(transfers, "backwards").join(starts, "key").withColumn("leads", F.col("part") == F.col("start"))
    behind = save(
        chained.repartition("key").sortWithinPartitions("key", F.desc("part"))
        .select("key", "part", "backwards", "transfer", "first", "last", "illegal", "leads")
        .mapInArrow(_behind, "key string, part int, backwards string, first string, last string, illegal long, costs array<long>, ends boolean, leads boolean"),
        "dialog-behind",
    )
    asked = ["costs", "ends", "leads", "backwards"]
    distinct = behind.select(*asked).distinct().repartitionByRange(*asked).sortWithinPartitions(*asked)
    audits = save(distinct.mapInArrow(_audits, "backwards string, costs array<long>, ends boolean, leads boolean, state long, audit string, cost long, after long"), "dialog-audits")
    whole = (
        behind.join(audits, asked).repartition("key").sortWithinPartitions("key", "part")
        .select("key", "part", "state", "audit", "cost", "after", "first", "last", "illegal")
        .mapInArrow(_whole, "key string, audit string, cost long, illegal long")
    )
    texts = _placed(rows).select("key", F.lit(True).alias("text_row"), *ORDER, "text")
    met = whole.withColumn("text_row", F.lit(False)).unionByName(texts, allowMissingColumns=True)
    digests = (
        met.repartition("key").sortWithinPartitions("key", "text_row", *ORDER)
        .select("key", "role", "text", "audit", "cost", "illegal")
        .mapInArrow(_digests, "key string, audit string, cost long, illegal long, repaired_sha256 string")
    )
    return fault_counts(found).join(digests, "key")


def damage(conversations: DataFrame) -> DataFrame:
    """Rows damaged by crc32 of `conv_id:turn`, in one of five ways for a quarter of them; NULLs become one space, in conv_id and turn for the key only."""
    spaced = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    way = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(way == 1, "").when(way == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    return conversations.where(way != 0).select(
        "conv_id", "turn", F.when(way == 4, "user").otherwise(spaced("role")).alias("role"), text.alias("text"),
        F.explode(F.when(way == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def op11_suffix_dawg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(prepare(spark), sf_dir, "conversations")
    all_ids = rows.select("conv_id").distinct().withColumn("key", key_of(F.col("conv_id")))
    found = all_ids.join(repair(damage(rows)), "key", "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
