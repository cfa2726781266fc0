"""URL rules in a sorted digest array: memory-mapped 64-bit xxhash keys, binary search over whole batches of probes, and
comparison of the stored strings, so that equal digests of different strings cannot match."""

from __future__ import annotations

import functools
import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sigframe.llm.common import LOWER, UPPER, whole
from sigframe.session import shared_dir

#: A list above this many bytes of rules is not shipped to every executor but joined.
MAX_ARRAY_BYTES = 256 << 20


def host_of(url: str | Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.regexp_extract(whole(url), "://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: str | Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(whole(url), "://[^/?#]*([^?#]*)", 1)


def digests(strings: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) for s in strings), np.uint64, len(strings))


def build(rules: list[tuple[str, str, str]]) -> bytes:
    """(host, path, verdict) as one file: an npz-free layout of sorted keys, string offsets, strings and verdicts.

    Of a rule listed twice with both verdicts ``block`` stays. A path begins with ``/`` or is empty, which is ``/``.
    """
    kept: dict[str, str] = {}
    for host, path, verdict in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"{host}{path}: a verdict is allow or block, not {verdict!r}")
        if path and not path.startswith("/") or "/" in host:
            raise ValueError(f"{host} {path}: a host has no slash and a path begins with one")
        name = f"{host.translate(str.maketrans(UPPER, LOWER))}{path or '/'}"
        kept[name] = "block" if "block" in (verdict, kept.get(name)) else "allow"
    names = list(kept)
    keys = digests(names)
    order = np.argsort(keys, kind="stable")
    texts = [names[i].encode() for i in order]
    ends = np.cumsum([0] + [len(t) for t in texts]).astype(np.int64)
    paths = np.unique(np.array([len(n) - n.index("/") for n in names], np.int64))
    flags = np.array([kept[names[i]] == "block" for i in order], np.uint8)
    head = np.array([len(names), len(paths), ends[-1]], np.int64)
    out = io.BytesIO()
    for a in (head, keys[order], ends, paths, flags):
        out.write(a.tobytes())
    out.write(b"".join(texts))
    return out.getvalue()


class DigestArray:
    """A file of ``build`` mapped into memory; its pages are shared by the Python workers of a machine."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n, lengths, size = (int(x) for x in raw[:24].view(np.int64))
        at = 24
        self.keys = raw[at:(at := at + 8 * n)].view(np.uint64)
        self.ends = raw[at:(at := at + 8 * (n + 1))].view(np.int64)
        self.path_lengths = raw[at:(at := at + 8 * lengths)].view(np.int64).tolist()
        self.block = raw[at:(at := at + n)]
        self.text = raw[at:at + size]

    def find(self, probes: list[str]) -> np.ndarray:
        """The place of each string, or -1."""
        out = np.full(len(probes), -1, np.int64)
        if not len(self.keys) or not probes:
            return out
        keys = digests(probes)
        at = np.searchsorted(self.keys, keys)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys):
            want, j = probes[i].encode("utf-8", "surrogatepass"), int(at[i])
            while j < len(self.keys) and self.keys[j] == keys[i]:  # equal digests stand side by side
                if self.text[self.ends[j]:self.ends[j + 1]].tobytes() == want:
                    out[i] = j
                    break
                j += 1
        return out

    def name(self, at: int) -> str:
        return self.text[self.ends[at]:self.ends[at + 1]].tobytes().decode()


def probes_of(host: str, path: str, path_lengths: list[int]) -> list[str]:
    """Each rule that could fit, longest first; of equally long ones that with the longer host."""
    if not path.startswith("/"):
        return []
    labels = host.split(".")
    hosts = [".".join(labels[i:]) for i in range(len(labels))]
    fits = [(h, path[:n]) for h in hosts for n in path_lengths if n <= len(path)]
    return [h + p for h, p in sorted(fits, key=lambda x: (-len(x[0]) - len(x[1]), -len(x[0])))]


@functools.lru_cache(maxsize=4)
def _opened(name: str) -> DigestArray:
    return DigestArray(SparkFiles.get(name))


def ship(spark: SparkSession, content: bytes) -> str:
    """Write the array to the shared folder, have Spark copy it to each executor, and return its name there."""
    name = f"digests-{uuid.uuid4().hex}.bin"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
    try:
        for i in range(0, len(content), 1 << 20):
            out.write(bytearray(content[i:i + (1 << 20)]))
    finally:
        out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def judge(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", otherwise: str = "allow") -> DataFrame:
    """page_id, host, path, rule (host and path of the rule that decides, else NULL) and verdict of every url.

    ``rules`` has host, path and verdict (``allow`` or ``block``). A rule fits its host and every subdomain, if the url's path
    starts with the rule's; the longest wins. Without a rule the verdict is ``otherwise``. A NULL url and one without
    ``://`` have an empty host and path and fit no rule. Repeated rows are judged each. Rows of ``rules`` with a NULL are
    no rules. A list of over MAX_ARRAY_BYTES is refused: split it by top-level domain then.
    """
    spark = pages.sparkSession
    rules = rules.select("host", "path", "verdict").na.drop().distinct()
    size = rules.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 40), F.lit(0))).first()[0]
    if size > MAX_ARRAY_BYTES:
        raise ValueError(f"the rules take {size} bytes; an array may have {MAX_ARRAY_BYTES}")
    name = ship(spark, build([(r.host, r.path, r.verdict) for r in rules.collect()]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = _opened(name)
        for batch in batches:
            hosts, paths = batch["host"].to_pylist(), batch["path"].to_pylist()
            probes, owner = [], []
            for i, (h, p) in enumerate(zip(hosts, paths)):
                own = probes_of(h, p, array.path_lengths)
                probes += own
                owner += [i] * len(own)
            found = array.find(probes)
            best = np.full(len(hosts), -1, np.int64)
            hits = np.flatnonzero(found >= 0)[::-1]  # the first probe of a url is written last
            best[np.array(owner, np.int64)[hits]] = found[hits]
            names = [array.name(j) if j >= 0 else None for j in best]
            verdicts = [otherwise if j < 0 else "block" if array.block[j] else "allow" for j in best]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["host"], batch["path"], pa.array(names, pa.string()),
                                              pa.array(verdicts, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    parts = pages.select(F.col(page_id).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    kind = parts.schema["page_id"].dataType.simpleString()
    return parts.mapInArrow(each, f"page_id {kind}, host string, path string, rule string, verdict string")
