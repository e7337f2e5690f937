"""Secret scans: every rule at once by one deterministic automaton over the bytes.

A rule is a head and a run: the head is a regular expression with a telling end, the run a class of bytes that a span goes on in as far as it can.
The heads are compiled together (automata.py: subset construction, minimisation, transition arrays). Each Arrow batch
of whole texts is laid out as one byte array, cut after bytes that lead every state back to the first one (so that no head
can lie across a cut), and all pieces run through the automaton in step, in one pass, which tells where heads end. From there the
rule's backward automaton finds where the head begins, and the run where the span ends. (The runs are not in the automaton: counting several long ones at once multiplies its states.)

Spans of a rule are leftmost and do not overlap. A rule that consumes drops a match whose run is too short and goes on behind it; any other looks for the next head.

Cases: null texts count as empty; texts of any length are scanned whole; repeated rows give repeated results; an empty
table gives an empty result; a column named like a result column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.llm.automata import Automaton
from tickweave.llm.common import byte_runs, small_batches, span_text, table, text_or_empty


@dataclass(frozen=True)
class Rule:
    """head: a regular expression, of which the last `counted` bytes (0: all) are the first of those that must be `least` at least; run: the class that follows."""

    kind: str
    head: str
    run: str = ""
    counted: int = 0
    least: int = 0
    ignore_case: bool = False
    consumes: bool = True


VALUE = r"[A-Za-z0-9+/_.=-]"
BASE_RULES = [
    Rule("assign", r"(password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?" + VALUE, VALUE, 1, 6, True),
    Rule("access", r"AKIA[A-Z0-9]", r"[A-Z0-9]", 0, 20),
    Rule("hex", r"[0-9a-f]{24}", r"[0-9a-f]", 0, 24),
]
MORE_RULES = [
    Rule("private_key", r"-----BEGIN ((RSA|EC|DSA|OPENSSH) )?PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]", r"[A-Za-z0-9]", 1, 36, consumes=False),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]", r"[A-Za-z0-9-]", 1, 10, consumes=False),
]
AT_ONCE = 4_000_000  # characters laid out together; a longer text is laid out alone
PIECE = 256  # bytes; pieces are cut at the first possible place after this many
SPANS = "array<struct<kind:string,start:long,end:long>>"


class Scanner:
    def __init__(self, rules: list[Rule]):
        self.rules = rules
        self.automaton = Automaton.compile([(r.head, r.ignore_case) for r in rules])
        self.backward = [Automaton.backward(r.head, r.ignore_case) for r in rules]
        self.runs = [Automaton.compile([(r.run, False)]) if r.run else None for r in rules]
        self.goes_on = [run.found[run.moves[0]][run.classes].astype(bool).tobytes() if run else bytes(256) for run in self.runs]

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """For each text (kind, start, end) in code points, by start, then in the order of the rules."""
        return [found for run in byte_runs([len(t) for t in texts], AT_ONCE) for found in self._spans(texts[run.start : run.stop])]

    def _spans(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        raw = [t.encode() for t in texts]
        joined = b"\xff".join(raw) + b"\xff"  # this byte is in no text and in no rule
        data = np.frombuffer(joined, np.uint8)
        first = np.cumsum([0, *(len(r) + 1 for r in raw)])
        cuts = np.flatnonzero(self.automaton.resets[data]) + 1
        wanted = np.searchsorted(cuts, np.arange(0, len(data), PIECE) + 1)
        begin = np.union1d(first[:-1], cuts[np.minimum(wanted, len(cuts) - 1)]) if len(cuts) else first[:-1]
        begin = begin[begin < len(data)]
        place, bits = self.automaton.ends(data, begin, np.append(begin[1:], len(data)))
        found: dict[int, list[tuple[int, int, int]]] = {}
        for r in range(len(self.rules)):
            for row, start, end in self._of_rule(r, joined, place[bits >> np.uint64(r) & np.uint64(1) > 0] + 1, first):
                found.setdefault(row, []).append((start, r, end))
        out: list[list] = [[] for _ in texts]
        for row, own in found.items():
            low = int(first[row])
            points = np.concatenate([[0], np.cumsum(data[low : low + len(raw[row])] & 0xC0 != 0x80)])
            out[row] = [(self.rules[r].kind, int(points[s - low]), int(points[e - low])) for s, r, e in sorted(own)]
        return out

    def _of_rule(self, r: int, data: bytes, heads: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, start, end) of a rule's spans, from where its heads end."""
        rule, goes_on, done, k = self.rules[r], self.goes_on[r], 0, 0
        rows = np.searchsorted(first, heads - 1, side="right") - 1
        while k < len(heads):
            head, row = int(heads[k]), int(rows[k])
            start = self.backward[r].start_of(data, max(done, int(first[row])), head)
            end = head
            if start is not None:
                while goes_on[data[end]]:
                    end += 1
                enough = end - (head - rule.counted if rule.counted else start) >= rule.least
                if enough:
                    yield row, start, end
                if enough or rule.consumes:
                    done = end
            k = max(k + 1, int(np.searchsorted(heads, done, side="right")))


def find_secrets(docs: DataFrame, text_col: str = "text", rules: list[Rule] | None = None, out: str = "secrets") -> DataFrame:
    """Add `out`, an array of (kind, start, end). No shuffle."""
    scanner = Scanner(BASE_RULES + MORE_RULES if rules is None else rules)

    @F.pandas_udf(SPANS)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            spans = scanner.spans(texts.tolist())
            yield pd.Series([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in spans])

    # declared nondeterministic so that no plan has it twice, for a filter and for its result
    return small_batches(docs).withColumn(out, scan.asNondeterministic()(text_or_empty(text_col)))


def redact(docs: DataFrame, text_col: str = "text", spans_col: str = "secrets") -> DataFrame:
    """Put [kind] in place of every span; spans that overlap count as one, named after the first. spans_col is by start; texts without spans stay as they are."""
    text = text_or_empty(text_col)
    part = lambda low, high: text.substr((low + 1).cast("int"), (high - low).cast("int"))

    def step(done: Column, s: Column) -> Column:
        new = F.concat(done["out"], part(done["at"], s["start"]), F.lit("["), s["kind"], F.lit("]"))
        return F.struct(F.when(s["start"] >= done["at"], new).otherwise(done["out"]).alias("out"), F.greatest(done["at"], s["end"]).alias("at"))

    begin = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    new = F.aggregate(spans_col, begin, step, lambda done: F.concat(done["out"], part(done["at"], F.length(text).cast("long"))))
    return docs.withColumn(text_col, F.when(F.size(spans_col) > 0, new).otherwise(F.col(text_col)))


def op9_secret_scans(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    base = [r.kind for r in BASE_RULES]
    found = find_secrets(docs)
    of = lambda kinds: F.filter("secrets", lambda s: s["kind"].isin(kinds))
    return found.select(
        "doc_id",
        *[F.size(of([k])).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(span_text(of(base)), 256).alias("base_sha256"),
        span_text(F.col("secrets")).alias("spans"),
    )
