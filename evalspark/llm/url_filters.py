"""URL filters on a sorted digest array.

A list of strings becomes one file: the sorted 64-bit xxhash keys, the strings'
offsets and the strings themselves. Workers memory-map it, probe all keys of a
batch with one vectorised binary search, and compare the stored string of every
hit, so that a collision of keys can neither add nor hide a match.

An entry is ``host/path``: it fits the host and its subdomains where the URL's
path starts with the entry's path.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepared, put_bytes

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The rules of the query.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
# The block list of the query: hosts (with their subdomains) of advertising, spam, gambling, adult and phishing sites.
BLOCK_LIST = ("ads-track.example.com/", "spam-farm.example.org/", "casino-win.example.net/", "cheap-pills.example.net/",
              "cheap-pills.example.com/", "adult-x.example.com/", "free-bets.example.net/")


def digest_file(strings: Iterable[str]) -> bytes:
    """The digest array of the distinct ``strings``: count, keys, offsets, strings."""
    rows = sorted((xxhash.xxh64_intdigest(s), s) for s in {x.encode() for x in strings})
    keys = np.array([k for k, _ in rows], "<u8")
    offsets = np.concatenate([[0], np.cumsum([len(s) for _, s in rows], dtype=np.int64)]).astype("<u8")
    return np.array([len(rows)], "<u8").tobytes() + keys.tobytes() + offsets.tobytes() + b"".join(s for _, s in rows)


class DigestArray:
    """A digest file, memory-mapped."""

    def __init__(self, path: str):
        n = int(np.fromfile(path, "<u8", 1)[0])
        self.keys = np.memmap(path, "<u8", "r", 8, (n,)) if n else np.zeros(0, "<u8")
        self.offsets = np.memmap(path, "<u8", "r", 8 * (n + 1), (n + 1,))
        size = int(self.offsets[-1])
        self.strings = np.memmap(path, "u1", "r", 8 * (2 * n + 2), (size,)) if size else np.zeros(0, "u1")

    def string(self, i: int) -> bytes:
        return self.strings[int(self.offsets[i]):int(self.offsets[i + 1])].tobytes()

    def contains(self, probes: list[bytes], digest=xxhash.xxh64_intdigest) -> np.ndarray:
        """Whether each probe is one of the strings."""
        keys = np.fromiter(map(digest, probes), np.uint64, len(probes))
        found = np.zeros(len(probes), bool)
        at = np.searchsorted(self.keys, keys, side="left")
        pending = np.arange(len(probes))
        while len(pending):  # more than once only for keys that several strings share
            slot = at[pending]
            inside = slot < len(self.keys)
            pending, slot = pending[inside], slot[inside]
            same = self.keys[slot] == keys[pending] if len(slot) else np.zeros(0, bool)
            pending, slot = pending[same], slot[same]
            equal = np.array([self.string(i) == probes[p] for i, p in zip(slot.tolist(), pending.tolist())], bool)
            found[pending[equal]] = True
            pending = pending[~equal]
            at[pending] += 1
        return found


def url_parts(url: str = "url"):
    """(host, path) columns of a URL column; both empty for null or without ``://``."""
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _suffixes(host: str) -> list[str]:
    """The host and every parent domain, longest first."""
    labels = host.split(".")
    return [".".join(labels[i:]) for i in range(len(labels))]


def judge(pages: DataFrame, rules: dict[str, str] = RULES, block_list: Iterable[str] = BLOCK_LIST, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict of every page.

    The longest fitting rule gives ``rule`` and its verdict; without one the verdict
    is ``block`` if an entry of ``block_list`` fits, else ``allow``. A null URL and a
    URL without ``://`` have empty host and path and are allowed. Repeated rows are
    judged one by one; other columns are ignored.
    """
    spark = prepared(pages.sparkSession)
    files = {}
    for name, strings in (("rules", rules), ("block", block_list)):
        path = put_bytes(spark, f"digest-{name}", digest_file(strings))
        spark.sparkContext.addFile(path)
        files[name] = path.rsplit("/", 1)[1]
    starts = {name: sorted({len(x) - x.index("/") for x in strings}, reverse=True) for name, strings in (("rules", rules), ("block", block_list))}
    verdicts = dict(rules)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import SparkFiles

        arrays = {name: DigestArray(SparkFiles.get(file)) for name, file in files.items()}
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            best: dict[str, list] = {}
            for name, array in arrays.items():
                probes, owner = [], []
                for i, (host, path) in enumerate(zip(hosts, paths)):
                    for suffix in _suffixes(host) if path else ():
                        for n in starts[name]:
                            if n <= len(path):
                                probes.append(suffix + path[:n])
                                owner.append(i)
                hit = np.nonzero(array.contains([p.encode() for p in probes]))[0]
                best[name] = [None] * len(hosts)
                for k in hit.tolist():
                    if best[name][owner[k]] is None or len(probes[k]) > len(best[name][owner[k]]):
                        best[name][owner[k]] = probes[k]
            verdict = [verdicts[r] if r is not None else "allow" if b is None else "block" for r, b in zip(best["rules"], best["block"])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(best["rules"], pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    host, path = url_parts(url_col)
    return pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path")).mapInArrow(probe, "page_id long, host string, path string, rule string, verdict string")


def oracle(pages: str = "pages", rules: dict[str, str] = RULES, block_list: Iterable[str] = BLOCK_LIST) -> str:
    """The same in DuckDB's SQL, entries compared one by one."""
    entries = ", ".join(f"('{r}', '{v}', true)" for r, v in rules.items()) + ", " + ", ".join(f"('{b}', 'block', false)" for b in block_list)
    return f"""
with entries(entry, verdict, is_rule) as (values {entries}),
cut as (select *, entry[:instr(entry, '/') - 1] as h, entry[instr(entry, '/'):] as p from entries),
parts as (select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') as host,
                 coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path, row_number() over () as n from {pages}),
fits as (select n, max((is_rule, len(entry), entry, c.verdict)) as best from parts join cut c on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by n)
select page_id, host, path, case when best[1] then best[3] end as rule, coalesce(best[4], 'allow') as verdict from parts left join fits using (n)"""
