"""URL filters over a sorted digest array.

A rule is a host and a path prefix, written together (`example.com/en/`, `net/`). Rules are kept as one file: a
sorted array of the 64-bit xxhash keys, offsets, and the rule strings in that order. Executors memory-map the file, hash the
possible rules of each url (every suffix of its host at a label boundary, with every path prefix of a
length that occurs among the rules), probe the array with one vectorised binary search a batch, and compare the stored string
before a hit counts, so that colliding digests never decide.
"""

from __future__ import annotations

import hashlib
import io

import numpy as np
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from .common import map_batches, shared_dir

#: Bytes of rules that a filter may hold; each executor fetches the file once.
MAX_FILTER_BYTES = 1 << 30

_UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null and for a url without `://`."""
    rest = "" if url is None else url.partition("://")[2]
    ends = [i for i in map(rest.find, "/?#") if i >= 0]
    at = min(ends, default=len(rest))
    ends = [i for i in (rest.find(c, at) for c in "?#") if i >= 0]
    return rest[:at].translate(_UPPER), rest[at : min(ends, default=len(rest))]


def digest_array(rules: dict[str, str]) -> bytes:
    """The filter's file: two counts, the lengths of path prefixes that occur, sorted keys, string offsets, then for each rule its verdict's letter and its UTF-8 text."""
    rows = sorted((xxhash.xxh64_intdigest(rule.encode()), verdict[0].encode() + rule.encode()) for rule, verdict in rules.items())
    keys = np.array([k for k, _ in rows], np.uint64)
    lengths = sorted({len(rule) - len(rule.partition("/")[0]) for rule in rules})
    ends = np.cumsum([0, *(len(t) for _, t in rows)], dtype=np.int64)
    out = io.BytesIO()
    longest = max((len(rule.partition("/")[0]) for rule in rules), default=0)
    for part in (np.array([len(rows), longest, len(lengths), *lengths], np.int64), keys, ends):
        out.write(part.tobytes())
    out.write(b"".join(t for _, t in rows))
    if out.tell() > MAX_FILTER_BYTES:
        raise ValueError(f"the rules take {out.tell()} bytes; a filter may hold {MAX_FILTER_BYTES}")
    return out.getvalue()


class DigestArray:
    """A memory-mapped filter file."""

    def __init__(self, path: str) -> None:
        self.data = np.memmap(path, np.uint8, "r")
        n, self.longest, m = self.data[:24].view(np.int64).tolist()
        at = 24 + 8 * m
        self.lengths = self.data[24:at].view(np.int64).tolist()
        self.keys = self.data[at : at + 8 * n].view(np.uint64)
        self.ends = self.data[at + 8 * n : at + 16 * n + 8].view(np.int64)
        self.text = self.data[at + 16 * n + 8 :]

    def rule(self, i: int) -> tuple[str, str]:
        kept = self.text[self.ends[i] : self.ends[i + 1]].tobytes().decode()
        return {"a": "allow", "b": "block"}[kept[0]], kept[1:]

    def probe(self, candidates: list[str]) -> list[int]:
        """The index of each candidate's rule, or -1. All candidates are searched at once; equal keys are walked and the strings compared."""
        keys = np.fromiter((xxhash.xxh64_intdigest(c.encode()) for c in candidates), np.uint64, len(candidates))
        at = np.searchsorted(self.keys, keys)
        found = np.full(len(candidates), -1)
        for j in np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == keys)) if len(self.keys) else ():
            i = int(at[j])
            while i < len(self.keys) and self.keys[i] == keys[j]:
                if self.rule(i)[1] == candidates[j]:
                    found[j] = i
                    break
                i += 1
        return found.tolist()

    def judge(self, urls: list[str | None], default: str) -> dict[str, list]:
        parts = [split_url(u) for u in urls]
        candidates, owner = [], []
        for k, (host, path) in enumerate(parts):
            # Only ends of the host that are no longer than the longest host of a rule, however many labels it has.
            if len(host) > self.longest:
                host = host[len(host) - self.longest - 1 :].partition(".")[2]
            while host:
                for n in self.lengths:
                    if n <= len(path):
                        candidates.append(host + path[:n])
                        owner.append(k)
                host = host.partition(".")[2]
        best: list[str | None] = [None] * len(urls)
        verdict = [default] * len(urls)
        for k, i in zip(owner, self.probe(candidates), strict=True):
            if i >= 0:
                v, rule = self.rule(i)
                if best[k] is None or len(rule) > len(best[k]):
                    best[k], verdict[k] = rule, v
        return {"host": [h for h, _ in parts], "path": [p for _, p in parts], "rule": best, "verdict": verdict}


def publish(spark: SparkSession, data: bytes) -> str:
    """The filter in the shared folder, registered for executors to fetch; returns its name for SparkFiles.get."""
    name = f"urls-{hashlib.sha256(data).hexdigest()[:24]}.bin"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        with_open = fs.create(path, True)
        for at in range(0, len(data), 1 << 23):
            with_open.write(bytearray(data[at : at + (1 << 23)]))
        with_open.close()
    spark.sparkContext.addFile(fs.makeQualified(path).toString())
    return name


def filter_urls(pages: DataFrame, rules: dict[str, str], default: str = "allow", id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """A row for each page: its id, host, path, the longest rule that fits (else null) and the verdict (allow or block; the default without a rule).

    A rule fits its host and all subdomains, if the path starts with the rule's path; of two of one length, the one with the longer host wins. Null urls and urls without
    `://` have an empty host and path, fit nothing and get the default; repeated rows stay; other columns are not read.
    """
    name = publish(pages.sparkSession, digest_array(rules))
    kind = dict(pages.dtypes)[id_column]

    def judge(cols: dict, array: DigestArray) -> dict:
        return {id_column: cols[id_column], **array.judge(cols[url_column], default)}

    return map_batches(pages.select(id_column, url_column), judge, f"{id_column} {kind}, host string, path string, rule string, verdict string", lambda: DigestArray(SparkFiles.get(name)))
