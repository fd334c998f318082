"""URL filters by a bit-parallel wildcard automaton (Shift-And).

All glob rules are packed side by side into one row of 64-bit words: a bit for each state of each rule.  A step takes
one byte of the canonical URL and moves all states of all rules at once: shift by one, mask with the states that this byte
enters, and keep those that a wildcard holds in place.  The batches' URLs step together as NumPy columns; very long URLs
run through the same masks one by one as Python integers.

Globs: `*` stands for bytes other than `/`, `**` for any bytes.  A host/path rule `example.net/en/` becomes the globs
`*.example.net/en/**` over the canonical URL `.host/path`, so it fits the host and all subdomains.

Defined results: a null URL or one without `://` has an empty host and path and matches no host rule.  Repeated rows stay, one result each.
Columns besides id and url are ignored, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower

#: Longer URLs do not step with the others.
LONG_URL = 2_048


@dataclass(frozen=True)
class Rule:
    """verdict: allow or block.  text: `host/path`, or any glob over `.host/path` if glob is true."""

    verdict: str
    text: str
    glob: bool = False

    def globs(self) -> list[str]:
        if self.glob:
            return [self.text]
        host, slash, path = self.text.partition("/")
        return [f"*.{host}/{path}**"] if slash else [f"*.{host}", f"*.{host}/**"]


class Automaton:
    """Shift-And masks of many globs in words of 64 bits."""

    def __init__(self, globs: list[str]):
        start = accept = 0
        enter, stay = [0] * 256, [0] * 256
        bit, self.accept_of = 0, []
        for glob in globs:
            start |= 1 << bit
            raw, i = glob.encode(), 0
            while i < len(raw):
                if raw[i : i + 1] == b"*":
                    deep = raw[i : i + 2] == b"**"
                    for c in range(256):
                        if deep or c != 0x2F:
                            stay[c] |= 1 << bit
                    i += 2 if deep else 1
                else:
                    bit += 1
                    enter[raw[i]] |= 1 << bit
                    i += 1
            self.accept_of.append(bit)
            accept |= 1 << bit
            bit += 1
        self.start, self.enter, self.stay, self.n_words = start, enter, stay, bit // 64 + 1
        self.start_words = self._words(start)
        self.enter_words = np.array([self._words(x) for x in enter])
        self.stay_words = np.array([self._words(x) for x in stay])

    def _words(self, mask: int) -> np.ndarray:
        return np.array([(mask >> 64 * k) & 0xFFFFFFFFFFFFFFFF for k in range(self.n_words)], dtype=np.uint64)

    def match_one(self, url: bytes) -> list[bool]:
        state = self.start
        for c in url:
            state = (state << 1) & self.enter[c] | state & self.stay[c]
        return [bool(state >> b & 1) for b in self.accept_of]

    def match(self, urls: list[bytes]) -> np.ndarray:
        """Boolean (url, glob)."""
        out = np.zeros((len(urls), len(self.accept_of)), dtype=bool)
        long = [i for i, u in enumerate(urls) if len(u) > LONG_URL]
        for i in long:
            out[i] = self.match_one(urls[i])
        short = np.array([i for i, u in enumerate(urls) if len(u) <= LONG_URL], dtype=np.int64)
        if not len(short):
            return out
        size = np.array([len(urls[i]) for i in short])
        order = np.argsort(-size, kind="stable")
        short, size = short[order], size[order]
        at = np.concatenate(([0], np.cumsum(size)[:-1]))
        data = np.frombuffer(b"".join(urls[i] for i in short), dtype=np.uint8)
        state = np.tile(self.start_words, (len(short), 1))
        one, top = np.uint64(1), np.uint64(63)
        for step in range(int(size[0])):
            live = int(np.searchsorted(-size, -step, side="left"))  # rows longer than step stand first
            c, now = data[at[:live] + step], state[:live]
            shifted = now << one
            shifted[:, 1:] |= now[:, :-1] >> top
            state[:live] = shifted & self.enter_words[c] | now & self.stay_words[c]
        for k, b in enumerate(self.accept_of):
            out[short, k] = (state[:, b // 64] >> np.uint64(b % 64)) & one
        return out


@functools.cache
def _automaton(globs: tuple[str, ...]) -> Automaton:
    return Automaton(list(globs))


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, A-Z lower-cased) and path (up to ? or #); empty where there is no ://."""
    url = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return ascii_lower(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def filter_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict, glob) for each row.

    Of the host/path rules that fit, the longest text wins (of equal ones, the first given); `rule` is its text.  If none fits,
    the first glob rule that fits gives verdict and `glob`; else verdict is default.
    """
    ordered = [r for r in sorted(rules, key=lambda r: -len(r.text)) if not r.glob] + [r for r in rules if r.glob]
    globs = tuple(g for r in ordered for g in r.globs())
    owner = [k for k, r in enumerate(ordered) for _ in r.globs()]
    url = F.col(url_col).cast("string")
    host, path = host_path(url)

    @F.pandas_udf("int")
    def first_fit(canonical: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = _automaton(globs)
        for part in canonical:
            hit = automaton.match([u.encode() for u in part]) if len(part) else np.zeros((0, len(globs)), dtype=bool)
            first = np.where(hit.any(axis=1), np.array([*owner, -1])[hit.argmax(axis=1)], -1) if globs else np.full(len(part), -1)
            yield pd.Series(first.astype(np.int32))

    fit = pages.select(F.col(id_col), host.alias("host"), path.alias("path")).withColumn("fit", first_fit(F.concat(F.lit("."), "host", "path")))
    pick = lambda values: F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), F.col("fit") + 1)
    some = F.col("fit") >= 0
    return fit.select(
        F.col(id_col), "host", "path",
        F.when(some, pick([None if r.glob else r.text for r in ordered])).alias("rule"),
        F.when(some, pick([r.verdict for r in ordered])).otherwise(default).alias("verdict"),
        F.when(some, pick([r.text if r.glob else None for r in ordered])).alias("glob"),
    )


# The contract's rules, and the method's own.
BASE_RULES = [Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/")]
OWN_RULES = [Rule("block", "*cheap-pills*/**", True), Rule("block", "*spam-farm*/**", True), Rule("block", "*casino*/**", True), Rule("block", "**/wp-login**", True)]
