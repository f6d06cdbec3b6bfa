"""URL filters: all glob rules simulated at once by a bit-parallel automaton over each canonical URL.

A glob is a row of items, each one character or any character (`?`), with `*` between them. Its states
0..m lie side by side in the bits of a multiword mask, all rules after each other; one Shift-And step
moves every rule over one character: D' = ((D << 1) & B[c]) | (D & S), where B[c] has the bit of state
i + 1 where item i takes c, and S the bits of states that a `*` lets stay. Batches of URLs step together.

Rules are host suffixes with a path prefix, in both of which `*` and `?` may stand; they become globs over
`.host`, a byte that no UTF-8 text has, and the path, so that a rule can only match its own part. The longest
rule that matches wins (of equals the last); without any, the globs of the method judge the canonical URL:
host without user, port and final dots, percent signs decoded, lower case, slashes single. What they don't
block is allowed.

Bytes that aren't UTF-8 count as U+FFFD. A null URL or one without `://` has an empty host and path, no rule, and is allowed. Repeated rows give
repeated results; an empty table gives an empty result; URLs may be of any length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import readable

SEP = b"\xff"
STAR, ANY = -1, -2
# The rules (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
# Globs over .host\xffpath that block what no rule decides.
BLOCKED = ("*spam*\xff*", "*cheap-pills*\xff*", "*casino*\xff*", "*viagra*\xff*", "*porn*\xff*", "*malware*\xff*", "*phish*\xff*")
SCHEMA = "page_id long, host string, path string, rule string, verdict string"


def parse(url: str | None) -> tuple[str, str]:
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    cut = min((i for i in (rest.find(c) for c in "?#") if i >= 0), default=len(rest))
    rest = rest[:cut]
    host, slash, path = rest.partition("/")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path


def items(glob: str) -> list[int]:
    """Bytes of a glob; \xff stands for the separator."""
    out: list[int] = []
    for c in glob:
        if c == "*":
            if not out or out[-1] != STAR:
                out.append(STAR)
        elif c == "?":
            out.append(ANY)
        else:
            out += SEP if c == "\xff" else c.encode()
    return out


class ShiftAnd:
    """Masks of all globs; memory is 256 x ceil(states / 64) longs, so rules of any number and length fit as long as that does."""

    def __init__(self, globs: Sequence[str]):
        states = sum(sum(i != STAR for i in items(g)) + 1 for g in globs)
        self.words = max(1, -(-states // 64))
        bits = {k: np.zeros(self.words * 64, bool) for k in ("start", "stay")}
        table, self.final, at = np.zeros((256, self.words * 64), bool), [], 0
        for g in globs:
            bits["start"][at] = True
            for i in items(g):
                if i == STAR:
                    bits["stay"][at] = True
                    continue
                at += 1
                table[slice(None) if i == ANY else i, at] = True
            self.final.append((at // 64, np.uint64(1 << at % 64)))
            at += 1
        pack = lambda b: np.packbits(b.reshape(*b.shape[:-1], -1, 8)[..., ::-1]).view("<u8").reshape(*b.shape[:-1], self.words)
        self.start, self.stay, self.table = pack(bits["start"]), pack(bits["stay"]), pack(table)

    def run(self, texts: Sequence[bytes], cells: int = 1 << 22) -> np.ndarray:
        """A row of booleans (glob matches the whole text) for each text. Texts step in blocks of like length, at most `cells` bytes each."""
        out = np.zeros((len(texts), len(self.final)), bool)
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        while order:
            longest = len(texts[order[-1]])
            n = max(1, min(len(order), cells // (longest + 1)))
            block, order = order[-n:], order[:-n]
            out[block] = self._block([texts[i] for i in block], longest)
        return out

    def _block(self, texts: list[bytes], longest: int) -> np.ndarray:
        """Texts by rising length: those that have ended are a growing prefix, and keep their state."""
        d = np.repeat(self.start[None], len(texts), 0)
        grid = np.frombuffer(b"".join(t.ljust(longest, b"\0") for t in texts), np.uint8).reshape(len(texts), longest)
        size, one = np.array([len(t) for t in texts]), np.uint64(1)
        for k in range(longest):
            live = int(np.searchsorted(size, k, side="right"))
            now = d[live:]
            step = now << one
            step[:, 1:] |= now[:, :-1] >> np.uint64(63)
            d[live:] = (step & self.table[grid[live:, k]]) | (now & self.stay)
        return np.stack([(d[:, w] & bit) != 0 for w, bit in self.final], 1) if self.final else np.zeros((len(texts), 0), bool)


def canonical(host: str, path: str) -> tuple[str, str]:
    """The form that different spellings of a URL have in common."""
    host = re.sub(r":[0-9]*$", "", host.rpartition("@")[2])
    return unquote(host).lower().rstrip("."), re.sub("/+", "/", unquote(path)) or "/"


def compile_rules(rules=RULES, blocked: Sequence[str] = BLOCKED) -> tuple[ShiftAnd, ShiftAnd]:
    """The automata of the rules and of the method's globs."""
    return ShiftAnd([f"*.{h}\xff{p}*" for _, h, p in rules]), ShiftAnd(blocked)


def judge_pages(pages: DataFrame, rules=RULES, blocked: Sequence[str] = BLOCKED) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    (ruled, methods), size = compile_rules(rules, blocked), [len(h + p) for _, h, p in rules]
    names, by_length = [h + p for _, h, p in rules], sorted(range(len(rules)), key=lambda i: size[i])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = lambda h, p: b"." + h.encode() + SEP + p.encode()
        for b in batches:
            parts = [parse(u) for u in readable(b.column(1)).to_pylist()]
            hit = ruled.run([form(h, p) for h, p in parts])
            best = np.full(len(parts), -1)
            for i in by_length:
                best[hit[:, i]] = i
            left = np.flatnonzero(best < 0)
            stop = np.zeros(len(parts), bool)
            stop[left] = methods.run([form(*canonical(*parts[i])) for i in left]).any(1)
            verdict = [rules[i][0] if i >= 0 else "block" if v else "allow" for i, v in zip(best, stop)]
            cols = [b.column(0).cast(pa.int64()), *(pa.array(x, pa.string()) for x in ([h for h, _ in parts], [p for _, p in parts], [names[i] if i >= 0 else None for i in best], verdict))]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "host", "path", "rule", "verdict"])

    return pages.select("page_id", "url").mapInArrow(judge, SCHEMA)
