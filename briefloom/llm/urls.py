"""URL filters: a sorted array of 64-bit digests, memory-mapped, probed by binary search, confirmed by the strings.

Every rule is one entry (host and path prefix, or a single word of a host name). The index is one file: the sorted
xxhash64 keys, then a table of string offsets, then the strings. Spark copies it once to every executor, where all
workers map the same pages. A probe is one vectorised binary search over the candidates of a whole batch; a key that is
found counts only when the stored string is equal, so a collision of digests never decides.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from briefloom.llm.shared import in_batches, ship_file

MAX_INDEX_BYTES = 1 << 30  # a list beyond this is refused, because it is made in the driver
_MAPPED: dict = {}

# Words of host names that mark gambling and similar spam.
SPAM_WORDS = ("bets", "betting", "casino", "gambling", "jackpot", "lottery", "poker", "porn", "slots", "viagra", "xxx")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one or for null."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def build_index(rules: Iterable[tuple[str, str]], words: Iterable[str] = ()) -> bytes:
    """The index file of rules (``host/path``, verdict) and of blocked host words.

    The same rule given twice with different verdicts is refused. An empty list gives an index that matches nothing.
    """
    entries: dict[str, bool] = {}
    for rule, verdict in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"verdict {verdict!r} of rule {rule!r}")
        if entries.setdefault(f"r{rule}", verdict == "block") != (verdict == "block"):
            raise ValueError(f"rule {rule!r} has two verdicts")
    entries |= {f"w{w}": True for w in words}
    texts = [k.encode() for k in entries]
    keys = np.array([xxhash.xxh64_intdigest(t) for t in texts], dtype="<u8")
    order = np.argsort(keys, kind="stable")
    blob = b"".join(bytes([list(entries.values())[i]]) + texts[i] for i in order)
    ends = np.cumsum([0, *(len(texts[i]) + 1 for i in order)], dtype="<u8")
    lengths = np.array(sorted({len(r[0].partition("/")[2]) + 1 for r in rules if "/" in r[0]}), dtype="<u8")
    data = np.array([len(keys), len(lengths)], dtype="<u8").tobytes() + keys[order].tobytes() + ends.tobytes() + lengths.tobytes() + blob
    if len(data) > MAX_INDEX_BYTES:
        raise ValueError(f"the list takes {len(data)} bytes; split it into several calls")
    return data


class Index:
    """The mapped file."""

    def __init__(self, path: str):
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        n, k = (int(x) for x in raw[:16].view("<u8"))
        at = 16
        self.keys = raw[at:at + 8 * n].view("<u8")
        at += 8 * n
        self.ends = raw[at:at + 8 * (n + 1)].view("<u8")
        at += 8 * (n + 1)
        self.lengths = [int(x) for x in raw[at:at + 8 * k].view("<u8")]
        self.blob = raw[at + 8 * k:]

    def find(self, texts: list[bytes]) -> list[bool | None]:
        """Per text: None when it is no entry, else whether it blocks."""
        if not texts or not len(self.keys):
            return [None] * len(texts)
        probes = np.array([xxhash.xxh64_intdigest(t) for t in texts], dtype="<u8")
        first = np.searchsorted(self.keys, probes, "left")
        last = np.searchsorted(self.keys, probes, "right")
        out: list[bool | None] = [None] * len(texts)
        for i in np.flatnonzero(last > first):
            for j in range(first[i], last[i]):
                entry = self.blob[int(self.ends[j]):int(self.ends[j + 1])].tobytes()
                if entry[1:] == texts[i]:
                    out[i] = bool(entry[0])
        return out


def mapped(name: str) -> Index:
    if name not in _MAPPED:
        _MAPPED[name] = Index(SparkFiles.get(name))
    return _MAPPED[name]


def candidates(host: str, path: str, lengths: list[int]) -> Iterator[str]:
    """Every rule that could fit: the host and its parent domains, each with the path prefixes of lengths in use."""
    if not host:
        return
    at = 0
    while True:
        tail = host[at:]
        yield tail
        for n in lengths:
            if n <= len(path):
                yield tail + path[:n]
        dot = host.find(".", at)
        if dot < 0:
            return
        at = dot + 1


def judge(pages: DataFrame, rules: Iterable[tuple[str, str]], words: Iterable[str] = SPAM_WORDS, key: str = "page_id",
          url: str = "url") -> DataFrame:
    """Per row: host, path, the longest fitting rule or null, and a verdict.

    A rule ``host/path`` fits its host and all subdomains when the path of the url starts with the rule's. The longest
    fitting rule decides; without one, a host with a blocked word (between dots, dashes and underscores) is blocked and
    all else is allowed. A null url, or one without ``://``, has an empty host and path, fits no rule and is allowed.
    Ties cannot occur, as two fitting rules of equal length are the same string.
    """
    spark = pages.sparkSession
    name = ship_file(spark, "url-rules", build_index(list(rules), words))
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = mapped(name)
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            texts: list[bytes] = []
            owner: list[int] = []
            for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
                for c in candidates(host, path, index.lengths):
                    texts.append(b"r" + c.encode())
                    owner.append(i)
                for w in {*host.replace("-", ".").replace("_", ".").split(".")} - {""}:
                    texts.append(b"w" + w.encode())
                    owner.append(i)
            rule: list[str | None] = [None] * len(hosts)
            verdict = ["allow"] * len(hosts)
            for i, text, blocks in zip(owner, texts, index.find(texts), strict=True):
                if blocks is None:
                    continue
                if text[:1] == b"w":
                    if rule[i] is None:
                        verdict[i] = "block"
                elif rule[i] is None or len(text) - 1 > len(rule[i].encode()):
                    rule[i] = text[1:].decode()
                    verdict[i] = "block" if blocks else "allow"
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                                             names=[key, "host", "path", "rule", "verdict"])

    return (pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
            .transform(in_batches, run, f"`{key}` {kind}, host string, path string, rule string, verdict string"))
