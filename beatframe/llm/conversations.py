"""Conversation structure repair: the cheapest edits into turns of system, user and assistant, by Four-Russians block tables."""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beatframe.llm.common import cut
from beatframe.llm.ordered import numbered

SPACE = " \t\n\x0b\x0c\r"
BLOCK = 4  # symbols of a block: each table has a row for each vector and a column for each of 9 ** BLOCK blocks
CHUNK = 4096  # rows of a conversation that one step handles; a multiple of BLOCK
GROUP = 65_536  # rows of a task's group, on average

# States: nothing said yet, after system, after user, after assistant. Symbols: 2 * (0 system, 1 user, 2 assistant, 3 other) + truncated, and 8 for rows
# that must go.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES, SYMBOLS, GONE = 4, 9, 8
FORCED = (USER, USER, ASSISTANT, USER)  # what an inserted or reroled turn becomes after each state
KEPT = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (ASSISTANT, 1): USER, (USER, 2): ASSISTANT}
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
LETTERS = b"DIKR"
ROLES = {USER: "user", ASSISTANT: "assistant"}


def _edits(after: tuple[int, ...], symbol: int, state: int) -> list[tuple[int, int, int]]:
    """(cost to the end, letter, next state) of the edits that use up a row of this symbol in this state."""
    out = [(DELETE + after[state], 0, state)]
    if symbol != GONE:
        own, kept = symbol % 2 * TRUNCATED, KEPT.get((state, symbol // 2))
        if kept is not None:
            out.append((own + after[kept], 2, kept))
        out.append((REROLE + own + after[FORCED[state]], 3, FORCED[state]))
    return out


def _before(after: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """The costs from each state to the end, one row earlier; insertions before the row included."""
    own = [min(_edits(after, symbol, s))[0] for s in range(STATES)]
    for _ in range(2):  # a third insertion in a row only returns to where one led
        own = [min(c, INSERT + own[FORCED[s]]) for s, c in enumerate(own)]
    return tuple(own)


class Tables:
    """Transitions of cost vectors for every block of `block` symbols.

    A cost vector has the least cost from each state to the end. Insertions bind its entries together, so vectors less their least entry are few;
    every one that can occur gets a number. to[v, b] is the vector before block b if v is the one behind it, and add[v, b] what is added to
    all its costs. letter and next tell, for the vector behind a row, its symbol and the state before it, the ASCII-least edit among the cheapest."""

    def __init__(self, block: int = BLOCK) -> None:
        self.block = block
        last = (0, 2 * INSERT, INSERT, 0)
        self.vectors, number = [last], {last: 0}
        one, more = [], []
        for v in self.vectors:
            made = [_before(v, x) for x in range(SYMBOLS)]
            for w in made:
                base = tuple(c - min(w) for c in w)
                if base not in number:
                    number[base] = len(self.vectors)
                    self.vectors.append(base)
            one.append([number[tuple(c - min(w) for c in w)] for w in made])
            more.append([min(w) for w in made])
        self.one, self.more = np.array(one), np.array(more)
        self.to, self.add = self.one, self.more
        for _ in range(block - 1):  # a block is its first symbol before a shorter block
            inner, cost = self.to, self.add
            self.to = self.one[inner].transpose(0, 2, 1).reshape(len(self.vectors), -1)
            self.add = (self.more[inner] + cost[:, :, None]).transpose(0, 2, 1).reshape(len(self.vectors), -1)
        self.weights = SYMBOLS ** np.arange(block - 1, -1, -1)
        self.letter, self.next = (np.zeros((len(self.vectors), SYMBOLS, STATES), np.int64) for _ in range(2))
        for (i, v), x, s in itertools.product(enumerate(self.vectors), range(SYMBOLS), range(STATES)):
            insert = (INSERT + _before(v, x)[FORCED[s]], 1, FORCED[s])
            _, self.letter[i, x, s], self.next[i, x, s] = min([*_edits(v, x, s), insert])
        self.steps = (self.one.tolist(), self.letter.tolist(), self.next.tolist())

    def blocks(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the whole blocks of a row of symbols, and the symbols behind them."""
        whole = len(symbols) - len(symbols) % self.block
        return symbols[:whole].reshape(-1, self.block) @ self.weights, symbols[whole:]

    def through(self, symbols: np.ndarray, behind: np.ndarray) -> np.ndarray:
        """The vectors before the symbols for each of the vectors behind them."""
        codes, rest = self.blocks(symbols)
        for x in rest[::-1]:
            behind = self.one[behind, x]
        for code in codes[::-1]:
            behind = self.to[behind, code]
        return behind

    def trace(self, symbols: np.ndarray, behind: int, state: int, last: bool) -> tuple[int, bytes]:
        """The state behind the symbols and the letters of the cheapest edits, ASCII-least among equals, from a state before them."""
        one, letter, nexts = self.steps
        codes, rest = self.blocks(symbols)
        at = behind
        for x in rest[::-1]:
            at = one[at][x]
        bounds = [at]
        for code in codes[::-1].tolist():
            bounds.append(int(self.to[bounds[-1], code]))
        bounds.reverse()
        out = bytearray()
        own = symbols.tolist()
        for i in range(0, len(own), self.block):
            part = own[i : i + self.block]
            k = i // self.block
            vectors = [bounds[k + 1] if k < len(codes) else behind]  # vectors behind each row of the block, expanded backward
            for x in part[:0:-1]:
                vectors.append(one[vectors[-1]][x])
            for x, v in zip(part, reversed(vectors), strict=True):
                while True:
                    edit = letter[v][x][state]
                    out.append(LETTERS[edit])
                    state = nexts[v][x][state]
                    if edit != 1:
                        break
        while last and state in (SYSTEM, USER):
            out.append(LETTERS[1])
            state = FORCED[state]
        return state, bytes(out)


@functools.cache
def tables() -> Tables:
    return Tables()


def cost_of(letters: bytes, symbols: np.ndarray) -> int:
    used = np.frombuffer(letters, np.uint8)
    rows = used[used != LETTERS[1]]
    kept = (rows != LETTERS[0]) & (symbols % 2 == 1) & (symbols != GONE)
    return int(INSERT * (len(used) - len(rows)) + DELETE * (rows == LETTERS[0]).sum() + REROLE * (rows == LETTERS[3]).sum() + TRUNCATED * kept.sum())


def damage(rows: DataFrame) -> DataFrame:
    """rows: c, conv_id, turn, role, text. Rows whose crc32 of `conv_id:turn` leaves 0 of 20 go, those of 1 lose their text, 2 their `.!?`, 3 come twice,
    and 4 are said by the user. A null role, text, conversation or turn counts as one space there; null turns stay null."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    dealt = rows.withColumn("__kind", F.crc32(F.concat(named[0], F.lit(":"), named[1]).cast("binary")) % 20).where("__kind <> 0")
    text = F.coalesce(F.col("text"), F.lit(" "))
    text = F.when(F.col("__kind") == 1, F.lit("")).when(F.col("__kind") == 2, F.translate(text, ".!?", "")).otherwise(text)
    role = F.when(F.col("__kind") == 4, F.lit("user")).otherwise(F.coalesce(F.col("role"), F.lit(" ")))
    twice = F.explode(F.sequence(F.lit(0), (F.col("__kind") == 3).cast("int")))
    return dealt.select("c", "turn", role.alias("role"), text.alias("text"), twice.alias("copy")).drop("copy")


def _kind(initial: Column) -> Column:
    return F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)


def marked(placed: DataFrame) -> DataFrame:
    """placed: c, turn, role, text, said (digest of the text), pos, size. One row each, without the text: its fault and symbol."""
    again = placed.groupBy("c", "role", "said").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    bare = F.rtrim("text", F.lit(SPACE))
    rows = placed.select("c", "role", "said", "pos", "size", (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut_off"))
    rows = rows.join(again, ["c", "role", "said"], "left")
    initial = F.substring("role", 1, 1)
    fault = F.when(F.col("blank"), 1).when(F.col("pos") > F.col("first"), 2).when(F.col("cut_off"), 3).otherwise(0)
    rows = rows.select("c", "pos", "size", _kind(initial).cast("long").alias("kind"), fault.cast("long").alias("fault"))
    symbol = F.when(F.col("fault").isin(1, 2), GONE).otherwise(2 * F.col("kind") + (F.col("fault") == 3).cast("long"))
    return rows.select("c", F.expr(f"pos div {CHUNK}").alias("chunk"), "pos", "size", "kind", "fault", symbol.alias("symbol"))


def _chunks(table: pa.Table) -> Iterator[tuple[str, int, int, dict[str, np.ndarray]]]:
    """(c, chunk, size, columns) of each chunk of a group of rows, in order of place."""
    table = table.sort_by([("c", "ascending"), ("pos", "ascending")])
    names = table.column("c").combine_chunks().dictionary_encode()
    codes = names.indices.to_numpy(zero_copy_only=False)
    columns = {x: table.column(x).to_numpy() for x in table.column_names if x not in ("c", "__group")}
    edges = np.flatnonzero((np.diff(codes) != 0) | (np.diff(columns["chunk"]) != 0)) + 1
    for a, b in itertools.pairwise([0, *edges.tolist(), len(codes)]):
        yield names.dictionary[codes[a]].as_py(), int(columns["chunk"][a]), int(columns["size"][a]), {k: v[a:b] for k, v in columns.items()}


_LEGAL = np.zeros((4, 4), bool)
_LEGAL[[0, 1, 2], [1, 2, 1]] = True


def summaries(rows: DataFrame, groups: int) -> DataFrame:
    """One row for each chunk of each conversation: counts of faults and of illegal neighbours, its first and last role, and, in conversations of several
    chunks, the vector before it for every vector behind it."""

    def run(table: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for c, chunk, size, x in _chunks(table):
            ahead = None
            if size > CHUNK:
                ahead = tables().through(x["symbol"], np.arange(len(tables().vectors))).astype("<u2").tobytes()
            kinds = x["kind"]
            illegal = int((~_LEGAL[kinds[:-1], kinds[1:]]).sum())
            out.append((c, chunk, size, *[int((x["fault"] == f).sum()) for f in (1, 2, 3)], illegal, int(kinds[0]), int(kinds[-1]), ahead))
        names = ["c", "chunk", "size", "blank", "duplicate", "truncated", "illegal", "first", "last", "ahead"]
        kinds = [pa.string(), *[pa.int64()] * 8, pa.binary()]
        return pa.table({n: pa.array([r[i] for r in out], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})

    schema = "c string, chunk long, size long, blank long, duplicate long, truncated long, illegal long, first long, last long, ahead binary"
    return _grouped(rows, groups).applyInArrow(run, schema)


def _grouped(rows: DataFrame, groups: int):
    return rows.withColumn("__group", F.pmod(F.xxhash64("c", "chunk"), F.lit(groups))).groupBy("__group")


def behind(chunks: DataFrame) -> DataFrame:
    """(c, chunk, behind): the vector behind each chunk of the conversations of several, by composing the maps from the last chunk back.

    One row for each CHUNK rows of a conversation meets here."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("chunk", "descending")])
        at, out = 0, []
        for ahead in table.column("ahead"):
            out.append(at)
            at = int(np.frombuffer(ahead.as_py(), "<u2")[at])
        return pa.table({"c": table.column("c"), "chunk": table.column("chunk"), "behind": pa.array(out, pa.int64())})

    return chunks.where("ahead is not null").select("c", "chunk", "ahead").groupBy("c").applyInArrow(run, "c string, chunk long, behind long")


def traced(rows: DataFrame, groups: int) -> DataFrame:
    """(c, chunk, entry, exit, cost, audit) of each chunk, for each state in which it may be entered. rows: those of marked, and behind (null: the end)."""

    def run(table: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for c, chunk, size, x in _chunks(table):
            vector, last = int(x["behind"][0]), (chunk + 1) * CHUNK >= size
            for entry in range(STATES) if chunk else (START,):
                leaves, letters = tables().trace(x["symbol"], vector, entry, last)
                out.append((c, chunk, entry, leaves, cost_of(letters, x["symbol"]), letters.decode()))
        names = ["c", "chunk", "entry", "exit", "cost", "audit"]
        kinds = [pa.string(), *[pa.int64()] * 4, pa.string()]
        return pa.table({n: pa.array([r[i] for r in out], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))})

    return _grouped(rows, groups).applyInArrow(run, "c string, chunk long, entry long, exit long, cost long, audit string")


def entered(ways: DataFrame) -> DataFrame:
    """(c, chunk, entry): the state in which each chunk is really entered. ways: c, chunk, entry, exit of conversations of several chunks."""

    def run(table: pa.Table) -> pa.Table:
        chunk, entry, leaves = (table.column(x).to_pylist() for x in ("chunk", "entry", "exit"))
        to = dict(zip(zip(chunk, entry, strict=True), leaves, strict=True))
        chunks, entries = range(max(chunk) + 1), [START]
        for i in chunks[:-1]:
            entries.append(to[i, entries[-1]])
        return pa.table({"c": [table.column("c")[0].as_py()] * len(chunks), "chunk": pa.array(chunks, pa.int64()), "entry": pa.array(entries, pa.int64())})

    return ways.groupBy("c").applyInArrow(run, "c string, chunk long, entry long")


_DIGEST = "c string, audit string, cost long, repaired_sha256 string"


def digests(placed: DataFrame, edits: DataFrame) -> DataFrame:
    """(c, audit, cost, repaired_sha256) of each conversation. Rows stream past in order, each chunk's edits just before its rows, so a task holds one
    batch and the letters of one conversation; a digest of a whole conversation cannot be split."""
    none = F.lit(None)
    stream = placed.select("c", "pos", F.lit(1).alias("what"), "role", "text", none.cast("long").alias("cost"))
    stream = stream.union(edits.select("c", F.col("chunk") * CHUNK, F.lit(0), none.cast("string"), "audit", "cost"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, START
        letters, at, audits, cost, sha, first = b"", 0, [], 0, None, True
        done: list[tuple] = []

        def say(role: str, text: str) -> None:
            nonlocal first
            sha.update(f"{'' if first else chr(10)}{role}:{text}".encode())
            first = False

        def inserted() -> None:
            nonlocal at, state
            while at < len(letters) and letters[at] == LETTERS[1]:
                state = FORCED[state]
                say(ROLES[state], "")
                at += 1

        def end() -> None:
            if name is not None:
                inserted()
                done.append((name, "".join(audits), cost, sha.hexdigest()))

        for batch in batches:
            for c, what, role, text, more in zip(*(batch.column(x).to_pylist() for x in ("c", "what", "role", "text", "cost")), strict=True):
                if c != name:
                    end()
                    name, state, audits, cost, sha, first, letters, at = c, START, [], 0, hashlib.sha256(), True, b"", 0
                if what == 0:
                    letters, at = text.encode(), 0
                    audits.append(text)
                    cost += more
                    continue
                inserted()
                edit = letters[at]
                at += 1
                if edit == LETTERS[2]:
                    state = KEPT[state, "sua".index(role[:1])]
                    say(role, text)
                elif edit == LETTERS[3]:
                    state = FORCED[state]
                    say(ROLES[state], text)
            if len(done) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["c", "audit", "cost", "repaired_sha256"])
                done = []
        end()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["c", "audit", "cost", "repaired_sha256"])

    return stream.repartition("c").sortWithinPartitions("c", "pos", "what").mapInArrow(run, _DIGEST)


def repair(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", damaged: bool = True) -> DataFrame:
    """key, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation.

    With damaged, rows are damaged first (see damage); null roles and texts count as one space in either case. Rows of a conversation go by turn (nulls
    first), then role and digest of the text; rows equal in all are interchangeable. A role's first character decides: roles that do not begin with s, u or
    a, the empty one included, cannot be kept. A null key is a conversation of its own. Conversations without rows after the damage have zeros, an
    empty audit and the digest of the empty text. An empty table gives an empty one; other columns are left out.

    Conversations are cut into chunks: block tables turn each into a map of cost vectors, the maps of a conversation are composed from its end, and the
    chunks traced from the vector behind them, so no task needs a conversation's rows together; only its digest reads them as one stream."""
    name = F.coalesce(F.concat(F.lit("="), conversations[key].cast("string")), F.lit(""))
    rows = conversations.select(name.alias("c"), conversations[key].alias("conv_id"), conversations[turn].alias("turn"), conversations[role].alias("role"), conversations[text].alias("text"))
    ids = rows.groupBy("c").agg(F.first("conv_id").alias("conv_id"))
    if damaged:
        rows = damage(rows)
    else:
        rows = rows.select("c", "turn", *[F.coalesce(x, F.lit(" ")).alias(x) for x in ("role", "text")])
    rows = rows.select("*", F.sha2("text", 256).alias("said"))
    placed = cut(numbered(rows, "c", ["turn", "role", "said"]))
    groups = max(1, -(-placed.count() // GROUP))
    marks = cut(marked(placed))
    chunks = cut(summaries(marks, groups))
    ways = cut(traced(marks.join(behind(chunks), ["c", "chunk"], "left").withColumn("behind", F.coalesce("behind", F.lit(0))), groups))
    real = entered(ways.join(chunks.where("ahead is not null and chunk = 0").select("c"), "c", "left_semi").select("c", "chunk", "entry", "exit"))
    several = ways.join(real, ["c", "chunk", "entry"])
    single = ways.join(chunks.where("ahead is null").select("c", "chunk"), ["c", "chunk"], "left_semi")
    edits = single.unionByName(several).select("c", "chunk", "cost", "audit")
    told = digests(placed, edits)
    lag = F.lag("last").over(Window.partitionBy("c").orderBy("chunk"))
    legal = F.concat(lag.cast("string"), F.col("first").cast("string")).isin("01", "12", "21")
    counts = chunks.select("c", "blank", "duplicate", "truncated", (F.col("illegal") + F.coalesce((~legal).cast("long"), F.lit(0))).alias("illegal"))
    counts = counts.groupBy("c").agg(*[F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated", "illegal")])
    turns = placed.where("turn is not null").groupBy("c", "turn").count().groupBy("c").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    out = ids.join(told, "c", "left").join(counts, "c", "left").join(turns, "c", "left")
    zero = [F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.sha2(F.lit(""), 256)
    return out.select(F.col("conv_id").alias(key), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
