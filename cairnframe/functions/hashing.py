"""Content hashes: the full SHA-256, and the fingerprint of both ends."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of either end in a fingerprint; bytes read at a time.
SAMPLE, CHUNK = 64 << 10, 1 << 20


def fingerprint(content: Column) -> Column:
    """SHA-256 of the first 64 KiB, the last 64 KiB and the size as eight little-endian bytes, in lower-case hex."""
    big_endian = F.lpad(F.hex(F.octet_length(content).cast("bigint")), 16, "0")
    little = F.unhex(F.array_join(F.reverse(F.regexp_extract_all(big_endian, F.lit(".."), F.lit(0))), ""))
    first = F.substring(content, 1, SAMPLE)
    last = F.substring(content, F.greatest(F.octet_length(content) - SAMPLE + 1, F.lit(1)), F.lit(SAMPLE))
    return F.sha2(F.concat(first, last, little), 256)


def hash_file(path: str, size: int, mtime_ns: int) -> tuple[str, str | None, str | None, str | None]:
    """(state, fingerprint, sha256, err) of a file in one pass.

    ok; unstable (changed while being read, or not as expected: its hashes come along); vanished; error.
    """
    try:
        before = os.stat(path)
        full, first, last, read = hashlib.sha256(), b"", b"", 0
        with open(path, "rb", buffering=0) as f:
            while chunk := f.read(CHUNK):
                full.update(chunk)
                if len(first) < SAMPLE:
                    first += chunk[: SAMPLE - len(first)]
                last = (last + chunk)[-SAMPLE:]
                read += len(chunk)
        after = os.stat(path)
    except FileNotFoundError as e:
        return "vanished", None, None, str(e)
    except OSError as e:
        return "error", None, None, str(e)
    ends = hashlib.sha256(first + last + before.st_size.to_bytes(8, "little")).hexdigest()
    facts = {(s.st_size, s.st_mtime_ns) for s in (before, after)} | {(size, mtime_ns)}
    if len(facts) > 1:
        return "unstable", ends, full.hexdigest(), "file changed during read"
    return "ok", ends, full.hexdigest(), None


def hash_twice(path: str, size: int, mtime_ns: int) -> tuple[str, str | None, str | None, str | None, int, int]:
    """hash_file, once more if the file was unstable, against what it is now; with the size and mtime that hold."""
    found = hash_file(path, size, mtime_ns)
    if found[0] == "unstable":
        try:
            now = os.stat(path)
        except OSError:
            return *found, size, mtime_ns
        size, mtime_ns = now.st_size, now.st_mtime_ns
        found = hash_file(path, size, mtime_ns)
    return *found, size, mtime_ns
