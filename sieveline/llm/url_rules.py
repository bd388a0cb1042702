"""URL filters: a bit-parallel automaton runs all wildcard rules over each canonical URL at once.

Every place in every rule is one bit of a row of 64-bit words. One step reads one byte of all URLs of a batch: the bits are
shifted (Shift-And), kept where the byte is the one the place asks for, and those of a ``*`` also stay where they are. The
work per byte is the number of words of the masks, whatever the rules look like.
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Between host and path of a canonical URL; no wildcard matches it.
EDGE = "\n"
#: Stands for the same character inside a host or path.
NONE = "\0"


@dataclass(frozen=True)
class UrlRule:
    """``host`` and ``path`` are globs (``*`` any run, ``?`` any byte). With ``site`` the host includes its subdomains and
    the path may go on; ``name`` and the length of ``host + path`` tell who wins."""

    verdict: str
    host: str
    path: str = "*"
    site: bool = False

    @property
    def name(self) -> str:
        return self.host + self.path

    def globs(self) -> list[str]:
        if not self.site:
            return [f"{self.host}{EDGE}{self.path}"]
        return [f"{self.host}{EDGE}{self.path}*", f"*.{self.host}{EDGE}{self.path}*"]


SITES = (UrlRule("block", "net", "/", True), UrlRule("allow", "example.net", "/en/", True),
         UrlRule("block", "example.com", "/de/", True), UrlRule("allow", "org", "/fr/", True))
GLOBS = tuple(UrlRule("block", h, p) for h, p in (
    ("*spam-*", "*"), ("*cheap-pills*", "*"), ("*casino*", "*"), ("*free-*download*", "*"), ("*", "*/wp-login.*"), ("*", "*.exe"), ("*", "*.zip")))


class Automaton:
    """Masks of all rules: ``take[byte]`` for bits that a byte moves on, ``stay[byte]`` for those it leaves where they are."""

    def __init__(self, rules: Sequence[UrlRule]):
        places: list[tuple[int, bytes | None, bool]] = []  # bit, byte that leads there (None: any), stays on any byte
        ends: list[tuple[int, int]] = []
        bits = 0
        for r, rule in enumerate(rules):
            for glob in rule.globs():
                start, loops = bits, set()
                for ch in glob.encode():
                    if ch == ord("*"):
                        loops.add(bits)
                        continue
                    bits += 1
                    places.append((bits, None if ch == ord("?") else bytes([ch]), False))
                places += [(b, b"", True) for b in loops]
                ends.append((bits, r))
                places.append((start, b"", False))
                bits += 1
        self.words = bits // 64 + 1
        self.start, self.take, self.stay = (np.zeros(s, np.uint64) for s in (self.words, (256, self.words), (256, self.words)))
        for bit, byte, stays in places:
            word, mask = bit // 64, np.uint64(1 << bit % 64)
            if stays:
                self.stay[:, word] |= mask
            elif byte is None:
                self.take[:, word] |= mask
            elif byte:
                self.take[byte[0], word] |= mask
            else:
                self.start[word] |= mask
        # A star or question mark never reads the edge between host and path.
        self.stay[ord(EDGE)] = 0
        for bit, byte, stays in places:
            if byte is None and not stays:
                self.take[ord(EDGE), bit // 64] &= ~np.uint64(1 << bit % 64)
        self.ends, self.n = ends, len(rules)

    def match(self, urls: Sequence[bytes]) -> np.ndarray:
        """``urls x rules``, true where the rule fits."""
        order = np.argsort([-len(u) for u in urls], kind="stable")
        lengths = np.array([len(urls[i]) for i in order], np.int64)
        data = np.frombuffer(b"".join(urls[i] for i in order) or b"\0", np.uint8)
        at = np.cumsum(lengths) - lengths
        state = np.tile(self.start, (len(urls), 1))
        active = len(urls)
        for t in range(int(lengths[0]) if len(lengths) else 0):
            active = int(np.searchsorted(-lengths[:active], -t))
            now, byte = state[:active], data[at[:active] + t]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:active] = (moved & self.take[byte]) | (now & self.stay[byte])
        out = np.zeros((len(urls), self.n), bool)
        for bit, r in self.ends:
            out[order, r] |= (state[:, bit // 64] >> np.uint64(bit % 64) & np.uint64(1)).astype(bool)
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path, both empty without ``://`` (or for null)."""
    there = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(there > 0, F.substr(url, there + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", sites: Sequence[UrlRule] = SITES,
               globs: Sequence[UrlRule] = GLOBS, default: str = "allow") -> DataFrame:
    """``id_col, host, path, rule, verdict, glob`` for every row of ``pages``.

    The longest fitting rule of ``sites`` decides (``rule`` is its name; between equally long ones the first), else the
    longest fitting one of ``globs`` (``glob``), else ``default``. A null URL or one without ``://`` has an empty host and path.
    Repeated rows give repeated rows, an empty table none; other columns are not read.
    """
    rules = [*sites, *globs]
    kind = pages.schema[id_col].dataType.simpleString()
    rank = sorted(range(len(rules)), key=lambda r: (r >= len(sites), -len(rules[r].name), r))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = Automaton(rules)
        for batch in batches:
            fits = auto.match([f"{h.replace(EDGE, NONE)}{EDGE}{p.replace(EDGE, NONE)}".encode() for h, p in zip(
                *(batch.column(i).to_pylist() for i in (1, 2)), strict=True)])[:, rank]
            best = [rank[int(row.argmax())] if row.any() else None for row in fits]
            rule = [rules[b].name if b is not None and b < len(sites) else None for b in best]
            glob = [rules[b].name if b is not None and b >= len(sites) else None for b in best]
            verdict = [default if b is None else rules[b].verdict for b in best]
            yield pa.record_batch([*batch.columns, *(pa.array(c, pa.string()) for c in (rule, verdict, glob))],
                                  [id_col, "host", "path", "rule", "verdict", "glob"])

    host, path = host_and_path(F.col(url_col))
    source = pages.select(F.col(id_col).alias("_id"), host.alias("_host"), path.alias("_path"))
    return source.mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string, glob string")
