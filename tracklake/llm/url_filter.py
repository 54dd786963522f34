"""URL filter: glob rules packed into multiword Shift-And masks.

All globs run at once over each canonical URL (`.` + host + path, UTF-8 bytes). Every
glob symbol is one bit; a step is S = ((S << 1 | first) & B[byte]) | (S & loop[byte]).
The bits are laid end to end over 64-bit words with a carry between words, so one
vectorised step over a batch of URLs advances every rule of every URL.

Glob syntax: `*` is any run without `/`, `**` any run, `?` one character but `/`.

Nulls: a null URL, or one without `://`, has empty host and path and matches no rule.
Empty, very long, tied and repeated rows need no care: rows are judged one by one, some
STEP_BYTES at a time, so memory follows these. Of equally long matching
rules, block wins, then the smaller rule. Extra columns pass unless a result column has
that name, which replaces it. An empty rule list gives every row the default verdict.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

DEFAULT_VERDICT = "allow"
#: Bytes of URLs that run together, a URL at least.
STEP_BYTES = 1 << 22


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"

    @property
    def glob(self) -> str:
        return f"*.{self.host}{self.path}**"


class ShiftAnd:
    """The automaton of a list of globs."""

    def __init__(self, globs: list[str]):
        symbols: list[tuple[set[int], set[int]]] = []  # bytes that enter the bit, bytes that keep it
        self.first, self.last, empty = [], [], []
        every = set(range(256))
        for g in globs:
            bits: list[tuple[set[int], set[int]]] = []
            lead: set[int] = set()  # what a leading star may read
            raw, i = g.encode(), 0
            while i < len(raw):
                if raw[i] == 42:
                    double = raw[i + 1 : i + 2] == b"*"
                    run = every if double else every - {47}
                    if bits:
                        bits[-1] = (bits[-1][0], bits[-1][1] | run)
                    else:
                        lead |= run
                    i += 2 if double else 1
                else:
                    bits.append((every - {47} if raw[i] == 63 else {raw[i]}, set()))
                    i += 1
            # Bit 0 of a rule is "nothing read yet but a leading star's run".
            self.first.append(len(symbols))
            symbols.append((set(), lead))
            symbols += bits
            self.last.append(len(symbols) - 1)
        n = max(1, len(symbols))
        self.words = -(-n // 64)
        self.enter = np.zeros((256, self.words), np.uint64)
        self.loop = np.zeros((256, self.words), np.uint64)
        start = np.zeros(self.words, np.uint64)
        for k, (enter, keep) in enumerate(symbols):
            bit = np.uint64(1) << np.uint64(k % 64)
            for b in enter:
                self.enter[b, k // 64] |= bit
            for b in keep:
                self.loop[b, k // 64] |= bit
        for k in self.first:
            start[k // 64] |= np.uint64(1) << np.uint64(k % 64)
        self.start = start

    def matches(self, texts: list[bytes]) -> np.ndarray:
        """(len(texts), number of globs) booleans."""
        out = np.zeros((len(texts), len(self.last)), bool)
        if not texts or not self.last:
            return out
        sizes = np.array([len(t) for t in texts])
        order = np.argsort(-sizes, kind="stable")
        flat = np.frombuffer(b"".join(texts), np.uint8)
        begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))[order]
        sizes = sizes[order]
        state = np.repeat(self.start[None, :], len(texts), axis=0)
        alive = len(texts)
        one, top = np.uint64(1), np.uint64(63)
        for at in range(int(sizes[0])):
            while sizes[alive - 1] <= at:
                alive -= 1
            s = state[:alive]
            byte = flat[begin[:alive] + at]
            moved = s << one
            if self.words > 1:
                moved[:, 1:] |= s[:, :-1] >> top
            state[:alive] = (moved & self.enter[byte]) | (s & self.loop[byte])
        last = np.array(self.last)
        out[order] = (state[:, last // 64] >> (last % 64).astype(np.uint64)) & one != 0
        return out


def filter_urls(df: DataFrame, rules: list[Rule], url: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """Adds host, path, rule and verdict to each row. The automaton's size is that of
    the rule list, a parameter; it goes to the tasks with the function."""
    shared.bounded_batches(df.sparkSession)
    ranked = sorted(range(len(rules)), key=lambda k: (-len(rules[k].name.encode()), rules[k].verdict != "block", rules[k].name))
    ranked_rules = [rules[k] for k in ranked]
    automaton = ShiftAnd([r.glob for r in ranked_rules])

    rest = F.regexp_extract(F.col(url), r"^(?s:.*?)://([^/?#]*)([^?#]*)", 1)
    has = F.coalesce(F.instr(F.col(url), "://") > 0, F.lit(False))
    keep = [c for c in df.columns if c not in {"host", "path", "rule", "verdict"}]
    host = F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(F.col(url), r"^(?s:.*?)://([^/?#]*)([^?#]*)", 2)
    parted = df.select(*keep, F.when(has, host).otherwise(F.lit("")).alias("host"), F.when(has, path).otherwise(F.lit("")).alias("path"))
    schema = parted.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("")}).schema

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([r.name for r in ranked_rules] + [None], dtype=object)
        verdicts = np.array([r.verdict for r in ranked_rules] + [default], dtype=object)
        for b in batches:
            urls = [f".{h}{p}".encode() for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True)]
            ends = np.cumsum([len(u) for u in urls])
            cuts = [0, *(np.flatnonzero(np.diff(ends // STEP_BYTES)) + 1).tolist(), len(urls)]
            hit = np.concatenate([automaton.matches(urls[lo:hi]) for lo, hi in itertools.pairwise(cuts)])
            best = np.where(hit.any(axis=1), hit.argmax(axis=1), len(ranked_rules)) if ranked_rules else np.zeros(len(urls), int)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(names[best].tolist(), pa.string()), pa.array(verdicts[best].tolist(), pa.string())],
                names=[*b.schema.names, "rule", "verdict"],
            )

    return parted.mapInArrow(judge, schema)
