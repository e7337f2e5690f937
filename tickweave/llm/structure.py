"""Repair of conversations whose turns are damaged, by a dynamic program over compressed sequences.

A conversation is a word over nine letters: a turn's role initial (s, u, a, o for any other; capitals: cut off) or d (has to go). Repairing it - keep, rerole, delete, insert -
is a walk through an automaton of four states that accepts (s?(ua)+)?, so each letter is a matrix over (min, +) with the cheapest edits from state to state, and a word is
their product. Words are written in the symbols of a Re-Pair grammar, learnt in rounds of Spark jobs over all words: a rule stands for the pair of symbols that is most frequent. A rule's matrix
is the product of its two parts', made once, bottom-up, and shared by all conversations; the edits in it are ropes, which share their parts too.

Layout: rows are thinned to (conversation, turn, role, digest of the text), equal ones combined, first occurrences found by an aggregation and a join; the thin rows are range-sorted, so
a conversation of any length is cut into segments of bounded length over as many tasks as it needs, each with a matrix of its own. Segments of a conversation are folded in order, a
vector of four costs and ropes at a time. Texts move once, by conversation and in order, and are edited and hashed as they stream by: a digest of a whole conversation is sequential by
its nature, so a conversation that holds a third of all rows takes one task that long, with memory for its edits (a byte a turn) only.

Among equally cheap edits the one whose initials (D, I, K, R) come first counts. Two equally cheap sequences for the same rows can't be each other's beginning (they would differ by inserts
alone, which cost), so the least one is the product of least ones.

Cases: null conversation, turn, role or text count as one space in what is hashed, compared and repaired; a null id is a conversation of its own; rows of the same turn
come by role, then by digest of the text; equal rows count one by one; a role whose initial is none of s, u, a (or that is empty) can't be kept; conversations without rows after damage cost nothing.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.llm.common import checkpointed, partitions_for, small_batches, table

# the automaton: at its beginning, after a system, a user and an assistant turn
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: ("u", USER), SYSTEM: ("u", USER), USER: ("a", ASSISTANT), ASSISTANT: ("u", USER)}  # what may follow besides a system turn
ENDS = (START, ASSISTANT)
ROLE = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5  # what edits cost; a cut off turn that stays costs more
LETTERS = "sSuUaAoOd"
SEGMENT = 65_536  # letters of a segment, at most
RULES = 200  # rules of the grammar, at most: what they don't shorten is multiplied out
WORDS_A_TASK = 100_000
LEAST_PAIRS, LEAST_SHARE = 4, 0.005  # a pair seen less often, or of less of all pairs, gets no rule
ROWS_A_TASK = 200_000
SPACES = "\t\n\x0b\x0c\r "


# ---- ropes and matrices


class Rope:
    """Edits' initials, put together without copying; compared from the left, leaf by leaf."""

    __slots__ = ("left", "right", "leaf")

    def __init__(self, left: Rope | None = None, right: Rope | None = None, leaf: str = ""):
        self.left, self.right, self.leaf = left, right, leaf

    def __add__(self, other: Rope) -> Rope:
        if self.left is None and not self.leaf:
            return other
        if other.left is None and not other.leaf:
            return self
        return Rope(self, other)

    def leaves(self) -> Iterator[str]:
        stack = [self]
        while stack:
            node = stack.pop()
            while node.left is not None:
                stack.append(node.right)
                node = node.left
            yield node.leaf

    def __str__(self) -> str:
        return "".join(self.leaves())

    def __lt__(self, other: Rope) -> bool:
        mine, theirs, a, b = self.leaves(), other.leaves(), "", ""
        while True:
            a, b = a or next(mine, ""), b or next(theirs, "")
            if not a or not b:
                return bool(b)
            n = min(len(a), len(b))
            if a[:n] != b[:n]:
                return a[:n] < b[:n]
            a, b = a[n:], b[n:]


NOTHING = Rope()
Best = tuple[int, Rope]
Vector = dict[int, Best]  # by state, of those that can be reached
Matrix = dict[int, Vector]


def better(one: Best, other: Best | None) -> bool:
    return other is None or one[0] < other[0] or one[0] == other[0] and one[1] < other[1]


def step(vector: Vector, matrix: Matrix) -> Vector:
    out: Vector = {}
    for state, (cost, rope) in vector.items():
        for to, (more, then) in matrix.get(state, {}).items():
            known = out.get(to)
            if known is None or cost + more <= known[0]:
                found = (cost + more, rope + then)
                if better(found, known):
                    out[to] = found
    return out


def product(a: Matrix, b: Matrix) -> Matrix:
    return {state: step(row, b) for state, row in a.items()}


def inserts() -> Matrix:
    """What inserted turns alone can do, none included; walking in a circle never pays."""
    out: Matrix = {}
    for begin in range(4):
        row, state, rope, cost = {begin: (0, NOTHING)}, begin, NOTHING, 0
        while (state := NEXT[state][1]) not in row:
            rope, cost = rope + Rope(leaf="I"), cost + INSERT
            row[state] = (cost, rope)
        out[begin] = row
    return out


INSERTS = inserts()


def letter_matrix(letter: str) -> Matrix:
    """The edit of one turn, and what may be inserted after it."""
    role, extra = letter.lower(), CUT_OFF if letter.isupper() else 0
    out: Matrix = {}
    for state in range(4):
        row: Vector = {state: (DELETE, Rope(leaf="D"))}
        if letter != "d":
            wanted, to = NEXT[state]
            moves = [(to, (KEEP if role == wanted else REROLE) + extra, "K" if role == wanted else "R")]
            if role == "s" and state == START:
                moves.append((SYSTEM, KEEP + extra, "K"))
            for to, cost, edit in moves:
                if better(found := (cost, Rope(leaf=edit)), row.get(to)):
                    row[to] = found
        out[state] = row
    return product(out, INSERTS)


def best_end(vector: Vector) -> Best:
    best = None
    for state in ENDS:
        if state in vector and better(vector[state], best):
            best = vector[state]
    assert best is not None  # deleting all always gets there
    return best


# ---- the grammar

Rules = list[tuple[str, str]]  # (pair, symbol) in the order they apply


def symbol(k: int) -> str:
    return chr(0x100 + k)


def encode(words: str, rules: Rules) -> str:
    for pair, own in rules:
        words = words.replace(pair, own)
    return words


def pair_counts(words: str) -> Counter:
    """Pairs in lines of words; of a pair of equal symbols those that don't overlap."""
    found = Counter(map(str.__add__, words, words[1:]))
    return Counter({p: words.count(p) if p[0] == p[1] else n for p, n in found.items() if "\n" not in p})


def learn_rules(segments: DataFrame, column: str = "word", rules: int = RULES, least: int = LEAST_PAIRS) -> Rules:
    """Re-Pair over all distinct words. Each round counts the pairs of all words and replaces the most frequent ones, as many as share no symbol with one another."""
    words = segments.select(column).distinct()
    words = checkpointed(words.repartition(partitions_for(words.count(), WORDS_A_TASK)))
    found: Rules = []
    while len(found) < rules:

        def counted(batches: Iterator[pa.RecordBatch], known: Rules = found) -> Iterator[pa.RecordBatch]:
            total: Counter = Counter()  # as many as there are pairs of symbols
            for batch in batches:
                total.update(pair_counts(encode("\n".join(batch.column(0).to_pylist()), known)))
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["pair", "n"])

        counts = small_batches(words).mapInArrow(counted, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        taken: set[str] = set()
        chosen: Rules = []
        pairs = sorted(((-r["n"], r["pair"]) for r in counts.collect()))  # of symbols: at most (9 + rules)^2
        enough = max(least, LEAST_SHARE * -sum(n for n, _ in pairs))
        for n, pair in pairs:
            if -n >= enough and len(found) + len(chosen) < rules and not taken & set(pair):
                taken |= set(pair)
                chosen.append((pair, symbol(len(found) + len(chosen))))
        if not chosen:
            break
        found = [*found, *chosen]
    return found


class Grammar:
    """The matrices of all symbols, bottom-up."""

    def __init__(self, rules: Rules):
        self.rules = rules
        self.matrices = {c: letter_matrix(c) for c in LETTERS}
        for pair, own in rules:
            self.matrices[own] = product(self.matrices[pair[0]], self.matrices[pair[1]])

    def row(self, word: str, begin: int, opens: bool = False) -> Vector:
        """Of the word's matrix the row of `begin`; opens: with what may be inserted before the word."""
        vector: Vector = INSERTS[begin] if opens else {begin: (0, NOTHING)}
        for c in encode(word, self.rules):
            vector = step(vector, self.matrices[c])
        return vector


_here: dict[tuple, Grammar] = {}


def grammar_here(rules: Rules) -> Grammar:
    """A worker's copy, made once from the rules."""
    key = tuple(rules)
    if key not in _here:
        _here.clear()
        _here[key] = Grammar(rules)
    return _here[key]


# ---- rows


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) after the damage that crc32 of `conv_id:turn` picks; copies: 0 if the row is dropped, 2 if it is repeated."""
    at = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), at("role").alias("role"), at("text").alias("text"), (F.crc32(F.concat(at("conv_id"), F.lit(":"), at("turn")).cast("binary")) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copies"))


def as_they_are(conversations: DataFrame) -> DataFrame:
    """The same without damage."""
    at = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), at("role").alias("role"), at("text").alias("text"), F.lit(1).alias("copies"))


def in_order() -> list[Column]:
    """A conversation's rows by turn; what has the same turn by role and digest."""
    return [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc()]


def thin_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, n, letter, more): equal rows as one, n of them; letter of the first, more of the others; no texts.

    Dropped rows stay with n = 0, so that every conversation is there.
    """
    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    state = F.when(last == "", "blank").when(last.isin(".", "!", "?"), "whole").otherwise("cut")
    rows = rows.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), state.alias("state"), "copies")
    rows = rows.groupBy("conv_id", "turn", "role", "digest", "state").agg(F.sum("copies").alias("n"))
    rows = checkpointed(rows)
    when = F.struct(F.col("turn").isNotNull(), "turn")
    first = rows.filter("n > 0").groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d")).agg(F.min(when).alias("_first"))
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d"))
    rows = rows.join(first, same, "left")
    new = F.col("_first") == when
    initial = F.substring("role", 1, 1)
    kept = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    own = F.when((F.col("state") == "blank") | ~new, "d").when(F.col("state") == "cut", F.upper(kept)).otherwise(kept)
    return rows.select("conv_id", "turn", "role", "digest", "state", "n", new.alias("new"), own.alias("letter"), initial.alias("initial"))


def counts_of(thin: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated) of all conversations."""
    blank = F.when(F.col("state") == "blank", F.col("n")).otherwise(0)
    first = F.when(F.col("new") & (F.col("n") > 0), 1).otherwise(0)
    doubled = F.when(F.col("state") != "blank", F.col("n") - first).otherwise(0)
    cut = F.when(F.col("state") == "cut", first).otherwise(0)
    turn = F.when(F.col("n") > 0, F.col("turn"))
    turns = thin.groupBy("conv_id", turn.alias("turn")).agg(F.sum(blank).alias("blank"), F.sum(doubled).alias("duplicate"), F.sum(cut).alias("truncated"))
    gaps = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    return turns.groupBy("conv_id").agg(F.coalesce(gaps, F.lit(0)).alias("gaps"), *[F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")])


LEGAL = ("su", "ua", "au")
_ENTRIES = pa.list_(pa.struct([("begin", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def segments_of(thin: DataFrame, segment: int = SEGMENT, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """(conv_id, part, k, word, opens, illegal, first, last): words of at most `segment` letters, in the order of (part, k).

    opens: whether the conversation is known to begin with it. illegal counts its neighbours that may not follow each other; first and last are the initials at its ends.
    """
    thin = thin.filter("n > 0").select("conv_id", "turn", "role", "digest", "n", "letter", "initial")
    by = [F.col("conv_id").asc_nulls_first(), *in_order()]
    ranged = thin.repartitionByRange(partitions_for(thin.count(), rows_a_task), *by).sortWithinPartitions(*by)
    names = ["conv_id", "part", "k", "word", "opens", "illegal", "first", "last"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, done, kinds = TaskContext.get().partitionId(), [], []
        now, opens, k, word, size, illegal, first, last = None, None, 0, [], 0, 0, None, None

        def end() -> None:
            if size:
                done.append((now, part, k, "".join(word), bool(opens and not k), illegal, first, last))

        def finished() -> Iterator[pa.RecordBatch]:
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names)
                done.clear()

        for batch in batches:
            kinds = [batch.column(0).type, pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.string()]
            for conv, n, letter, initial in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "n", "letter", "initial"))):
                if opens is None or conv != now:
                    end()
                    # the first of a task may have begun in the one before
                    now, opens, k, word, size, illegal, first, last = conv, opens is not None, 0, [], 0, 0, initial, None
                while n:
                    if size >= segment:
                        end()
                        k, word, size, illegal, first, last = k + 1, [], 0, 0, initial, None
                    here = min(n, segment - size)  # the first of equal rows has its letter, the others have to go
                    word.append(letter + "d" * (here - 1))
                    illegal += (last is not None and last + initial not in LEGAL) + (here - 1) * (initial + initial not in LEGAL)
                    size, n, letter, last = size + here, n - here, "d", initial
            yield from finished()
        end()
        yield from finished()

    kind = thin.schema["conv_id"].dataType.simpleString()
    return ranged.mapInArrow(cut, f"conv_id {kind}, part int, k int, word string, opens boolean, illegal long, first string, last string")


def plans_of(segments: DataFrame, rules: Rules) -> DataFrame:
    """(conv_id, illegal, cost, audit) of the conversations that have rows: the segments' matrices, then their product in order."""
    kind = segments.schema["conv_id"].dataType.simpleString()

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, memory = grammar_here(rules), {}
        for batch in batches:
            out = []
            for word, opens in zip(batch.column("word").to_pylist(), batch.column("opens").to_pylist()):
                if (word, opens) not in memory:
                    if len(memory) >= 20_000 or len(word) > 1000:
                        memory.clear()  # a bound on what a task remembers
                    rows = {begin: grammar.row(word, begin, opens) for begin in ([START] if opens else range(4))}
                    memory[word, opens] = [{"begin": b, "state": s, "cost": c, "audit": str(r)} for b, row in rows.items() for s, (c, r) in row.items()]
                out.append(memory[word, opens])
            own = [batch.column(c) for c in ("conv_id", "part", "k", "opens", "illegal", "first", "last")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(out, _ENTRIES)], ["conv_id", "part", "k", "opens", "illegal", "first", "last", "entries"])

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, kinds = [], []
        now, begun, vector, illegal, last = None, False, {}, 0, None

        def end() -> None:
            if begun:
                cost, rope = best_end(vector)
                done.append((now, illegal, cost, str(rope)))

        def finished() -> Iterator[pa.RecordBatch]:
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], ["conv_id", "illegal", "cost", "audit"])
                done.clear()

        for batch in batches:
            kinds = [batch.column(0).type, pa.int64(), pa.int64(), pa.string()]
            for conv, opens, wrong, first, end_of, entries in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "opens", "illegal", "first", "last", "entries"))):
                if not begun or conv != now:
                    end()
                    now, begun, illegal, last = conv, True, 0, None
                    vector = {START: (0, NOTHING)} if opens else INSERTS[START]
                matrix: Matrix = {}
                for e in entries:
                    matrix.setdefault(e["begin"], {})[e["state"]] = (e["cost"], Rope(leaf=e["audit"]))
                vector = step(vector, matrix)
                illegal, last = illegal + wrong + (last is not None and last + first not in LEGAL), end_of
            yield from finished()
        end()
        yield from finished()

    entries = "array<struct<begin: int, state: int, cost: long, audit: string>>"
    parts = small_batches(segments).mapInArrow(multiplied, f"conv_id {kind}, part int, k int, opens boolean, illegal long, first string, last string, entries {entries}")
    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "k")
    return ordered.mapInArrow(folded, f"conv_id {kind}, illegal long, cost long, audit string")


HEAD = "gaps blank duplicate truncated illegal cost audit".split()


def repair_plans(rows: DataFrame, segment: int = SEGMENT, rules: int = RULES, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit): every conversation with its faults and its cheapest edits. rows: as from damaged()."""
    thin = checkpointed(thin_rows(rows))
    segments = checkpointed(segments_of(thin, segment, rows_a_task))
    plans = plans_of(segments, learn_rules(segments, rules=rules))
    counts = counts_of(thin).withColumnRenamed("conv_id", "_of")
    joined = counts.join(plans, F.col("_of").eqNullSafe(F.col("conv_id")), "left")
    return joined.select(F.col("_of").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"))


# ---- applying the edits


def _streamed(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Each conversation's plan, then its rows in order, side by side in one task; nothing of it is held but what goes by."""
    heads = plans.select("conv_id", F.lit(0).alias("kind"), *HEAD)
    turns = rows.filter("copies > 0").select("conv_id", F.lit(1).alias("kind"), "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), "text", "copies")
    both = heads.unionByName(turns, allowMissingColumns=True)
    return small_batches(both).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *in_order())


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(plan, None) for each conversation after its turns, and (plan, (edit, role, text)) for each turn of its repaired form."""
    head, at, state = None, 0, START

    def inserted() -> Iterator[tuple]:
        nonlocal at, state
        while head["audit"][at : at + 1] == "I":
            wanted, state = NEXT[state]
            at += 1
            yield head, ("I", ROLE[wanted], "")

    for batch in batches:
        for row in _rows(batch):
            if row["kind"] == 0:
                if head is not None:
                    yield from inserted()
                    yield head, None
                head, at, state = row, 0, START
                continue
            for _ in range(row["copies"]):
                yield from inserted()
                edit, at = head["audit"][at], at + 1
                if edit == "K":
                    state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[row["role"][:1]]
                    yield head, ("K", row["role"], row["text"])
                elif edit == "R":
                    wanted, state = NEXT[state]
                    yield head, ("R", ROLE[wanted], row["text"])
    if head is not None:
        yield from inserted()
        yield head, None


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    names = ["conv_id", "kind", *HEAD, "role", "text", "copies"]
    for values in zip(*(batch.column(c).to_pylist() for c in names)):
        yield dict(zip(names, values))


TURNS_AT_ONCE = 2_000


def repaired_turns(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, position, edit, role, text): the repaired conversations; position counts from 0, edit is K, R or I."""
    kind = plans.schema["conv_id"].dataType.simpleString()

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, position, conv_type = [], 0, []

        def seen() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                conv_type[:] = [batch.column(0).type]
                yield batch

        def made() -> pa.RecordBatch:
            kinds = [conv_type[0], pa.int64(), pa.string(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["conv_id", "position", "edit", "role", "text"])

        for head, turn in _walk(seen()):
            if turn is None:
                position = 0
                continue
            out.append((head["conv_id"], position, *turn))
            position += 1
            if len(out) >= TURNS_AT_ONCE:
                yield made()
                out = []
        if out:
            yield made()

    return _streamed(rows, plans).mapInArrow(turns, f"conv_id {kind}, position long, edit string, role string, text string")


def repaired_digests(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The plans with repaired_sha256: of the repaired `role:text`, newline-joined."""
    kind = plans.schema["conv_id"].dataType.simpleString()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, digest, begun, conv_type = [], hashlib.sha256(), False, []

        def seen() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                conv_type[:] = [batch.column(0).type]
                yield batch

        def made() -> pa.RecordBatch:
            kinds = [conv_type[0], *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["conv_id", *HEAD, "repaired_sha256"])

        for head, turn in _walk(seen()):
            if turn is not None:
                digest.update(f"{chr(10) if begun else ''}{turn[1]}:{turn[2]}".encode())
                begun = True
                continue
            out.append((head["conv_id"], *(head[c] for c in HEAD), digest.hexdigest()))
            digest, begun = hashlib.sha256(), False
            if len(out) >= TURNS_AT_ONCE:
                yield made()
                out = []
        if out:
            yield made()

    numbers = ", ".join(f"{c} long" for c in HEAD[:-1])
    return _streamed(rows, plans).mapInArrow(digests, f"conv_id {kind}, {numbers}, audit string, repaired_sha256 string")


def op12_structure_repair(spark, sf_dir: str) -> DataFrame:
    rows = damaged(table(spark, sf_dir, "conversations"))
    return repaired_digests(rows, repair_plans(rows))


#: The same as a walk over rows, a step at a time, without grammar or matrices.
OP12_SQL = r"""
WITH RECURSIVE
crcs AS (
  SELECT list(v ORDER BY b) AS t
  FROM (SELECT b, list_reduce(list_prepend(CAST(b AS UBIGINT), CAST(range(8) AS UBIGINT[])), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END) AS v FROM range(256) r(b))
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), hashed AS (
  SELECT keyed.*, xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS UBIGINT))),
    lambda c, x: xor(c >> 8, t[CAST(xor(c & 255, x) AS INT) + 1])), CAST(4294967295 AS UBIGINT)) % 20 AS fault FROM keyed, crcs
), hurt AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy FROM hashed WHERE fault <> 0
), numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM hurt),
seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS ending, left(role, 1) AS initial,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) NOT IN ('su', 'ua', 'au') AS wrong FROM numbered
), told AS (SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' END AS fault, CASE WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'o' END AS kind FROM seen),
rows AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'd' WHEN fault = 'truncated' THEN upper(kind) ELSE kind END AS letter FROM told),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (wrong) AS illegal, max(i) AS n FROM rows GROUP BY 1
), states(p, want, nxt) AS (VALUES (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
inserts(p, q, more, e) AS (VALUES (0, 0, 0, ''), (0, 2, 5, 'I'), (0, 3, 10, 'II'), (1, 1, 0, ''), (1, 2, 5, 'I'), (1, 3, 10, 'II'), (2, 2, 0, ''), (2, 3, 5, 'I'), (3, 3, 0, ''), (3, 2, 5, 'I')),
letters AS (SELECT unnest(['s', 'S', 'u', 'U', 'a', 'A', 'o', 'O', 'd']) AS letter),
edits AS (
  SELECT letter, p AS src, p AS dst, 2 AS cost, 'D' AS e FROM letters, states
  UNION ALL SELECT letter, p, nxt, CASE WHEN letter = upper(letter) THEN 5 ELSE 0 END + CASE WHEN lower(letter) = want THEN 0 ELSE 1 END, CASE WHEN lower(letter) = want THEN 'K' ELSE 'R' END FROM letters, states WHERE letter <> 'd'
  UNION ALL SELECT letter, 0, 1, CASE WHEN letter = 'S' THEN 5 ELSE 0 END, 'K' FROM letters WHERE letter IN ('s', 'S')
), moves AS (SELECT letter, src, q AS dst, cost + more AS cost, edits.e || inserts.e AS e FROM edits JOIN inserts ON dst = p),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, q AS state, {'cost': CAST(more AS BIGINT), 'audit': e} AS best FROM counts, inserts WHERE p = 0
  UNION ALL
  SELECT w.conv_id, w.i + 1, m.dst, min({'cost': w.best.cost + m.cost, 'audit': w.best.audit || m.e})
  FROM walk w JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1 JOIN moves m ON m.letter = r.letter AND m.src = w.state GROUP BY w.conv_id, w.i + 1, m.dst
), found AS (SELECT c.conv_id, min(best) AS best FROM counts c JOIN walk w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = c.n WHERE state IN (0, 3) GROUP BY 1),
steps AS (SELECT conv_id, unnest(string_split(best.audit, '')) AS e, generate_subscripts(string_split(best.audit, ''), 1) AS k FROM found),
placed AS (SELECT *, count(*) FILTER (e <> 'I') OVER (PARTITION BY conv_id ORDER BY k) AS i FROM steps),
kept AS (
  SELECT p.conv_id, p.k, p.e, r.role, CASE WHEN p.e = 'I' THEN '' ELSE r.text END AS text, p.e = 'K' AND left(r.role, 1) = 's' AS first
  FROM placed p LEFT JOIN rows r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i AND p.e <> 'I' WHERE p.e <> 'D'
), spoken AS (SELECT *, count(*) FILTER (NOT first) OVER (PARTITION BY conv_id ORDER BY k) AS place FROM kept),
repaired AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k) AS text FROM spoken GROUP BY 1)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(r.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN found f ON f.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM a.conv_id
"""
