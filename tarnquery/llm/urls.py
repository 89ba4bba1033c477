"""URL filters: glob rules as one bit-parallel Shift-And automaton over canonical URLs.

All rules are laid out one after another as bits of several 64-bit words: a bit for each literal character of a rule.
A step shifts all rules at once, keeps the bits whose character was read and lets stars hold their position. A star
in the host part doesn't cross "/", one in the path part matches anything.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnquery.llm.hashing import U, string_parts


@dataclass(frozen=True)
class UrlRule:
    """verdict for a host and all its subdomains, below a path. globs adds patterns of its own for the canonical URL."""

    verdict: str
    rule: str
    globs: tuple[str, ...] = ()

    def patterns(self) -> tuple[str, ...]:
        return self.globs or (f"{self.rule}*", f"*.{self.rule}*")


def parse_rule(line: str) -> UrlRule:
    """`allow com/`: a verdict and a host with a path."""
    verdict, rule = line.split(" ", 1)
    if verdict not in ("allow", "block") or "/" not in rule:
        raise ValueError(f"not a rule: {line}")
    host, path = rule.split("/", 1)
    return UrlRule(verdict, f"{host.lower()}/{path}")


class Automaton:
    """Multiword Shift-And over bytes. Patterns are anchored at both ends; `*` matches any run of bytes.

    Bit 0 of each pattern is its start state; literal k of a pattern leads from bit k to bit k + 1.
    """

    def __init__(self, patterns: Sequence[str]):
        layout, at = [], 0
        for p in patterns:
            size = len(p.replace("*", "").encode()) + 1
            layout.append(at)
            at += size
        self.words = max(1, -(-at // 64))
        self.step = np.zeros((256, self.words), U)
        self.hold = np.zeros((256, self.words), U)
        self.init = np.zeros(self.words, U)
        self.final: list[tuple[int, int]] = []

        def put(row: np.ndarray, bit: int) -> None:
            row[bit // 64] |= U(1 << (bit % 64))

        slash = ord("/")
        for p, base in zip(patterns, layout, strict=True):
            bit, in_host = base, True
            put(self.init, bit)
            for c in p.encode():
                if c == ord("*"):
                    for b in range(256):
                        if b != slash or not in_host:
                            put(self.hold[b], bit)
                else:
                    in_host &= c != slash
                    bit += 1
                    put(self.step[c], bit)
            self.final.append((bit // 64, bit % 64))

    def matches(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """For each string and pattern, whether it fits. All strings advance together, the longest ones longest."""
        size = np.diff(offs)
        order = np.argsort(-size, kind="stable")
        start, size = offs[:-1][order], size[order]
        state = np.broadcast_to(self.init, (len(order), self.words)).copy()
        live = len(order)
        for k in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size[:live], -k, "left"))
            c, s = data[start[:live] + k], state[:live]
            moved = s << U(1)
            moved[:, 1:] |= s[:, :-1] >> U(63)
            state[:live] = (moved & self.step[c]) | (s & self.hold[c])
        out = np.empty((len(order), len(self.final)), bool)
        for j, (w, b) in enumerate(self.final):
            out[order, j] = (state[:, w] >> U(b)) & U(1) != 0
        return out


def _judge(batches, rules: tuple[UrlRule, ...], default: str):
    """The longest rule that fits decides; among equals the first."""
    order = sorted(range(len(rules)), key=lambda k: (-len(rules[k].rule.encode()), k))
    pairs = [(p, r) for r in order for p in rules[r].patterns()]
    machine, owner = Automaton(tuple(p for p, _ in pairs)) if pairs else None, np.array([r for _, r in pairs], int)
    names = np.array([None if r.globs else r.rule for r in rules] + [None], object)
    verdicts = np.array([r.verdict for r in rules] + [default], object)
    for batch in batches:
        data, offs = string_parts(batch.column(batch.num_columns - 1))
        out = np.full(batch.num_rows, len(rules))
        for a in range(0, batch.num_rows if machine else 0, 4096):
            part = machine.matches(data, offs[a : a + 4097])
            out[a : a + 4096] = np.where(part.any(1), owner[part.argmax(1)], len(rules))
        columns = [batch.column(k) for k in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(names[out], pa.string()), pa.array(verdicts[out], pa.string())], [*batch.schema.names[:-1], "rule", "verdict"])


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host between the first :// and the next /, ? or #, A-Z lower-cased; path up to ? or #. Both empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substr({0}, instr({0}, '://') + 3)".format("`__url`"))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def filter_urls(pages: DataFrame, rules: Sequence[UrlRule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Per row: id, host, path, rule (null if none of the named rules decided), verdict.

    A null URL or one without :// has an empty host and path and gets the default verdict, as does a URL that no rule
    fits; without rules all URLs get it. Equal rows are judged alike; other columns are dropped.
    """
    host, path = host_and_path(F.col("__url"))
    parts = pages.select(F.col(id_col), F.col(url_col).alias("__url")).select(id_col, host.alias("host"), path.alias("path"))
    schema = f"{id_col} {dict(pages.dtypes)[id_col]}, host string, path string, rule string, verdict string"
    return parts.withColumn("__canonical", F.concat("host", "path")).mapInArrow(partial(_judge, rules=tuple(rules), default=default), schema)
