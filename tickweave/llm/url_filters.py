"""URL filters: all glob rules at once by a bit-parallel wildcard automaton.

Every rule is a glob over the canonical URL "." + host + path. `*` stands for any run without "/",
`**` for any run, `?` for one character other than "/"; everything else is literal. The rules are packed side by side
into 64-bit words, one bit for each state (a state is the number of literals matched so far), and
one Shift-And step for each character moves the states of all rules:

    D = ((D << 1) & B[c]) | (D & S[c])

B[c] has the states that are entered by reading c, S[c] the states whose wildcard may swallow c.
numpy does that step for a whole Arrow batch of URLs, so the cost for a URL is its length times the
number of words, whatever the number of rules.

Cases: null urls and urls without "://" have empty host and path, match no host rule and get the default verdict;
empty hosts match no host rule; rows may repeat; an empty table gives an empty result; further columns stay as they are unless
they are named like a result column, which then replaces them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.llm.common import small_batches, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path)
HOST_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: (verdict, glob), used where no host rule fits; the first that fits wins.
GLOB_RULES = [
    ("block", "*.spam-*/**"),
    ("block", "**/*.exe"),
    ("block", "*.ads.*/**"),
]
DEFAULT_VERDICT = "allow"


def host_column(url: Column) -> Column:
    at = F.locate("://", url)
    host = F.regexp_extract(url.substr(at + 3, F.length(url)), r"^([^/?#]*)", 1)
    return F.when(at > 0, F.translate(host, UPPER, LOWER)).otherwise(F.lit(""))


def path_column(url: Column) -> Column:
    at = F.locate("://", url)
    path = F.regexp_extract(url.substr(at + 3, F.length(url)), r"^[^/?#]*([^?#]*)", 1)
    return F.when(at > 0, path).otherwise(F.lit(""))


def host_rule_glob(host: str, path: str) -> str:
    """The glob of a rule for a host with all its subdomains and a path prefix."""
    escape = lambda s: "".join("\\" + c if c in "*?\\" else c for c in s)
    return f"*.{escape(host)}{escape(path)}**" if host else "\\\0"


def _tokens(glob: str) -> list[tuple[str, str]]:
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "\\" and i + 1 < len(glob):
            out.append(("lit", glob[i + 1]))
            i += 2
        elif glob.startswith("**", i):
            out.append(("any", ""))
            i += 2
        elif c in "*?":
            out.append(("run" if c == "*" else "one", ""))
            i += 1
        else:
            out.append(("lit", c))
            i += 1
    return out


@dataclass
class ShiftAnd:
    """Packed masks of several globs; the rows of `enter` and `stay` are the classes of characters."""

    alphabet: np.ndarray  # sorted code points that have a class of their own (1 + place)
    enter: np.ndarray  # classes x words
    stay: np.ndarray
    start: np.ndarray  # words
    final_word: np.ndarray  # for each glob
    final_bit: np.ndarray

    @classmethod
    def compile(cls, globs: list[str]) -> ShiftAnd:
        parsed = [_tokens(g) for g in globs]
        literals = sorted({ord(c) for p in parsed for kind, c in p if kind == "lit"} | {ord("/")})
        classes = len(literals) + 1  # class 0: any other character
        states = sum(1 + sum(kind in ("lit", "one") for kind, _ in p) for p in parsed)
        enter = np.zeros((classes, states), bool)
        stay = np.zeros((classes, states), bool)
        start, final = np.zeros(states, bool), []
        slash, at = literals.index(ord("/")) + 1, 0
        for p in parsed:
            start[at] = True
            for kind, c in p:
                if kind == "lit":
                    at += 1
                    enter[literals.index(ord(c)) + 1, at] = True
                elif kind == "one":
                    at += 1
                    enter[:, at] = True
                    enter[slash, at] = False
                else:
                    stay[:, at] |= True if kind == "any" else np.arange(classes) != slash
            final.append(at)
            at += 1
        words = -(-max(states, 1) // 64)

        def pack(bits: np.ndarray) -> np.ndarray:
            full = np.zeros((*bits.shape[:-1], words * 64), np.uint64)
            full[..., :states] = bits
            return (full.reshape(*bits.shape[:-1], words, 64) << np.arange(64, dtype=np.uint64)).sum(-1, dtype=np.uint64)

        final = np.array(final, dtype=np.int64)
        return cls(np.array(literals, np.uint32), pack(enter), pack(stay), pack(start), final // 64, (final % 64).astype(np.uint64))

    def fits(self, urls: list[str]) -> np.ndarray:
        """A row for each url and a column for each glob: whether the whole url fits it."""
        out = np.zeros((len(urls), len(self.final_word)), bool)
        lengths = np.array([len(u) for u in urls], np.int64)
        codes = np.frombuffer("".join(urls).encode("utf-32-le", "surrogatepass"), np.uint32)
        place = np.searchsorted(self.alphabet, codes)
        known = self.alphabet[np.minimum(place, len(self.alphabet) - 1)] == codes
        kinds = np.where(known, place + 1, 0)
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(urls) else lengths
        order = np.argsort(-lengths, kind="stable")  # the urls still being read are always a prefix
        lengths, begin = lengths[order], begin[order]
        state = np.tile(self.start, (len(urls), 1))
        one, top = np.uint64(1), np.uint64(63)
        alive = len(urls)
        for t in range(int(lengths[0]) if len(urls) else 0):
            while lengths[alive - 1] <= t:
                alive -= 1
            kind = kinds[begin[:alive] + t]
            now = state[:alive]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:alive] = (moved & self.enter[kind]) | (now & self.stay[kind])
        out[order] = (state[:, self.final_word] >> self.final_bit) & one != 0
        return out


def judge_urls(
    pages: DataFrame,
    url_col: str = "url",
    host_rules: list[tuple[str, str, str]] = HOST_RULES,
    glob_rules: list[tuple[str, str]] = GLOB_RULES,
    default: str = DEFAULT_VERDICT,
) -> DataFrame:
    """Add host, path, rule (the longest host rule that fits, else null), glob_rule (the first glob that fits where no
    host rule does, else null) and verdict. Rules of equal length rank in the order given. No shuffle."""
    ranked = sorted(host_rules, key=lambda r: -len(r[1] + r[2]))
    automaton = ShiftAnd.compile([host_rule_glob(h, p) for _, h, p in ranked] + [g for _, g in glob_rules])
    names = [h + p for _, h, p in ranked] + [g for _, g in glob_rules]
    verdicts = [v for v, *_ in ranked] + [v for v, _ in glob_rules]
    hosts = len(ranked)

    @F.pandas_udf("rule string, glob_rule string, verdict string")
    def decide(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for urls in batches:
            fits = automaton.fits(urls.tolist())
            first = np.where(fits.any(1), fits.argmax(1), -1).tolist() if names else [-1] * len(urls)
            yield pd.DataFrame(
                {
                    "rule": pd.Series([names[k] if 0 <= k < hosts else None for k in first], dtype=object),
                    "glob_rule": pd.Series([names[k] if k >= hosts else None for k in first], dtype=object),
                    "verdict": pd.Series([verdicts[k] if k >= 0 else default for k in first], dtype=object),
                }
            )

    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "glob_rule", "verdict")]
    split = small_batches(pages).select(*kept, host_column(url).alias("host"), path_column(url).alias("path"))
    judged = split.withColumn("_judged", decide(F.concat(F.lit("."), "host", "path")))
    return judged.select(*kept, "host", "path", *[F.col(f"_judged.{c}").alias(c) for c in ("rule", "glob_rule", "verdict")])


def op1_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "glob_rule", "verdict")


OP1_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), judged AS (
  SELECT *, CASE
    WHEN ends_with('.' || host, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN ends_with('.' || host, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM parts
), globs AS (
  SELECT *, CASE WHEN rule IS NOT NULL THEN NULL
    WHEN contains('.' || host, '.spam-') AND path <> '' THEN '*.spam-*/**'
    WHEN ends_with(path, '.exe') THEN '**/*.exe'
    WHEN contains('.' || host, '.ads.') AND path <> '' THEN '*.ads.*/**' END AS glob_rule FROM judged
)
SELECT page_id, host, path, rule, glob_rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL OR glob_rule IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM globs
"""
