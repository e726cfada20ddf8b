"""URL rules as globs, matched all at once by a bit-parallel automaton (multiword Shift-And).

A glob has literals, ``?`` (any byte), ``*`` (any bytes but "/") and ``**``
(any bytes). All globs are laid side by side in one row of bits, over as many
64-bit words as they need. A bit stands for "this much of the glob has been
read". For each byte of the URL

    state = ((state << 1) & accepts[byte]) | (state & loops[byte])

where ``accepts`` has the positions whose symbol takes the byte, and ``loops``
the positions after which a star takes it. The shift carries between words. A
batch of URLs is advanced together, one byte position at a time.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm._common import map_rows, source_columns, text_bytes

_ONE = np.uint64(1)
#: Bytes of the URLs that are advanced together.
AREA_BYTES = 1 << 20


@dataclass(frozen=True)
class Automaton:
    """Masks of the globs; ``accepts`` and ``loops`` are [byte, word]."""

    accepts: np.ndarray
    loops: np.ndarray
    start: np.ndarray
    final: list[tuple[int, np.uint64]]  # word and bit of each glob's end

    def matches(self, urls: list[bytes]) -> np.ndarray:
        """[url, glob]: whether the glob matches the whole URL."""
        order = np.argsort([-len(u) for u in urls], kind="stable")
        done = np.zeros((len(urls), len(self.final)), bool)
        low = 0
        while low < len(urls):  # URLs of about equal length together, so that a long one costs no more than itself
            high = low + max(1, AREA_BYTES // max(1, len(urls[order[low]])))
            self._advance(urls, order[low:high], done)
            low = high
        return done

    def _advance(self, urls: list[bytes], order: np.ndarray, done: np.ndarray) -> None:
        sizes = np.array([len(urls[i]) for i in order], np.int64)
        state = np.repeat(self.start[None, :], len(order), axis=0)
        data = np.zeros((len(order), int(sizes[0])), np.uint8)
        for row, i in enumerate(order):
            data[row, : len(urls[i])] = np.frombuffer(urls[i], np.uint8)
        for at in range(int(sizes[0])):
            live = int(np.searchsorted(-sizes, -at, side="left"))  # URLs longer than at come first
            s, byte = state[:live], data[:live, at]
            moved = s << _ONE
            moved[:, 1:] |= s[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.accepts[byte]) | (s & self.loops[byte])
        for k, (word, bit) in enumerate(self.final):
            done[order, k] = (state[:, word] & bit) != 0


def symbols(glob: str) -> list[tuple[str, str]]:
    """Tokens of a glob: (kind, character); kinds are lit, any, star, globstar."""
    out, k = [], 0
    while k < len(glob):
        if glob.startswith("**", k):
            out.append(("globstar", ""))
            k += 2
            continue
        out.append({"*": ("star", ""), "?": ("any", "")}.get(glob[k], ("lit", glob[k])))
        k += 1
    return out


def compile_globs(globs: list[str]) -> Automaton:
    """Pack the globs into masks. A glob takes one bit, and one for each byte it reads."""
    patterns = []
    for glob in globs:
        steps: list[np.ndarray] = []  # bytes that each position accepts
        loops = [np.zeros(256, bool)]  # bytes that keep each position, the start included
        for kind, char in symbols(glob):
            if kind in ("star", "globstar"):
                taken = np.ones(256, bool)
                if kind == "star":
                    taken[ord("/")] = False
                loops[-1] = loops[-1] | taken
            elif kind == "any":
                steps.append(np.ones(256, bool))
                loops.append(np.zeros(256, bool))
            else:
                for byte in char.encode():
                    one = np.zeros(256, bool)
                    one[byte] = True
                    steps.append(one)
                    loops.append(np.zeros(256, bool))
        patterns.append((steps, loops))
    bits = sum(len(loops) for _, loops in patterns)
    words = max(1, -(-bits // 64))
    accepts, stays = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64)
    start, final, at = np.zeros(words, np.uint64), [], 0
    for steps, loops in patterns:
        start[at // 64] |= _ONE << np.uint64(at % 64)
        for k, taken in enumerate(loops):
            stays[taken, (at + k) // 64] |= _ONE << np.uint64((at + k) % 64)
        for k, taken in enumerate(steps, 1):  # bit 0 of a glob accepts nothing, so its left neighbour can't enter
            accepts[taken, (at + k) // 64] |= _ONE << np.uint64((at + k) % 64)
        at += len(loops)
        final.append(((at - 1) // 64, _ONE << np.uint64((at - 1) % 64)))
    return Automaton(accepts, stays, start, final)


def split_url(url: bytes) -> tuple[bytes, bytes]:
    """Host (A-Z lowered) and path; both empty without ``://``."""
    _, sep, rest = url.partition(b"://")
    if not sep:
        return b"", b""
    end = min((i for i in map(rest.find, (b"?", b"#")) if i >= 0), default=len(rest))
    rest = rest[:end]
    slash = rest.find(b"/")
    slash = len(rest) if slash < 0 else slash
    return rest[:slash].lower(), rest[slash:]


def rule_globs(host: str, path: str) -> list[str]:
    """Globs over ``host + path`` for a host, all its subdomains, and a path's start.

    No host holds a "/", and ``*`` takes none, so that a path can't pass for a host.
    """
    return [f"{host}{path}**", f"*.{host}{path}**"]


@lru_cache(maxsize=8)
def _machine(rules: tuple, globs: tuple) -> tuple[Automaton, np.ndarray]:
    patterns, owner = [], []
    for k, (_, host, path) in enumerate(rules):
        for glob in rule_globs(host, path):
            patterns.append(glob)
            owner.append(k)
    for k, (_, glob) in enumerate(globs):
        patterns.append(glob)
        owner.append(len(rules) + k)
    return compile_globs(patterns), np.array(owner, np.int64)


def judge_urls(
    df: DataFrame,
    rules: list[tuple[str, str, str]],
    globs: list[tuple[str, str]],
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every URL.

    ``rules``: (verdict, host, path). A rule fits its host and all subdomains
    where the path starts with the rule's; of those that fit, the longest host
    and path wins (the first of equals). Where none fits, ``rule`` is null and
    the first fitting one of ``globs`` (verdict, glob) decides, else ``default``.
    Rules and globs match the canonical URL: host and path, without query.

    * Null URLs and those without ``://``: host and path empty, no rule.
    * Empty and very long URLs, repeated rows and null ids are judged alike.
    * An empty table gives no rows. Further columns are not read.
    """
    rules, globs = [tuple(r) for r in rules], [tuple(g) for g in globs]

    def run(batch: pa.RecordBatch):
        machine, owner = _machine(tuple(rules), tuple(globs))
        pages, raw = batch.column("id").to_pylist(), text_bytes(batch.column("url"))
        rank = sorted(range(len(rules)), key=lambda k: (-len(rules[k][1] + rules[k][2]), k))
        for low in range(0, len(raw), 4096):
            parts = [split_url(u) for u in raw[low : low + 4096]]
            hit = machine.matches([h + p for h, p in parts])
            fits = np.zeros((len(parts), len(rules) + len(globs)), bool)
            for column, k in enumerate(owner.tolist()):
                fits[:, k] |= hit[:, column]
            for page, (host, path), row in zip(pages[low : low + 4096], parts, fits, strict=True):
                best = next((k for k in rank if row[k]), None)
                if best is not None:
                    verdict, name = rules[best][0], rules[best][1] + rules[best][2]
                else:
                    name = None
                    verdict = next((v for k, (v, _) in enumerate(globs) if row[len(rules) + k]), default)
                yield (page, host.decode("utf-8", "replace"), path.decode("utf-8", "replace"), name, verdict), 200

    return map_rows(source_columns(df, id=id_col, url=url_col), run, f"{id_col} long, host string, path string, rule string, verdict string")
