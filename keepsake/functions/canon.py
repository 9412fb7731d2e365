"""Canonical bytes and digests as columns."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefix of the labels that separate digests of different kinds.
LABEL_PREFIX = "keepsake"


def canonical_json_bytes(value: object) -> bytes:
    """Sorted keys, no spaces, ASCII-escaped."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False).encode()


def canonical_json(raw: Column) -> Column:
    """JSON text in canonical form; null where it is not JSON. Row by row, as a batch of thousands of long texts fills a worker."""

    def one(x):
        try:
            return None if x is None else canonical_json_bytes(json.loads(x)).decode()
        except ValueError:
            return None

    return F.udf(one, "string", useArrow=False)(raw)


def digest_column(label: str, *columns: Column, version: int = 1) -> Column:
    """sha256 of the label and the columns' texts, each framed by its length, so that no two lists share bytes."""
    parts = [F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat_ws("|", F.lit(f"{LABEL_PREFIX}/{label}/v{version}"), *parts), 256)


class FramedDigest:
    """sha256 over a header and rows, each led by its length in eight big-endian bytes; rows come one at a time."""

    def __init__(self, label: str, **header: object):
        self._sum = hashlib.sha256()
        self.add(canonical_json_bytes({"label": f"{LABEL_PREFIX}/{label}", "v": 1, **header}))

    def add(self, data: bytes) -> None:
        self._sum.update(len(data).to_bytes(8, "big"))
        self._sum.update(data)

    def framed(self, data: bytes) -> None:
        """Rows that are already led by their lengths."""
        self._sum.update(data)

    def hex(self) -> str:
        return self._sum.hexdigest()


def evidence_digest(*columns: Column) -> Column:
    """sha256 of texts joined by the unit separator."""
    return F.sha2(F.concat_ws("\x1f", *columns), 256)


def sum_digest(label: str, member: Column) -> Column:
    """An aggregate: the digest of a multiset of sha256 digests, whatever their order.

    It covers the number of members and the exact sums of four separate parts of 60 bits each, which partial
    aggregation computes without a list of all members in one row.
    """
    return digest_column(label, F.count(member), *[F.sum(number_of(F.substring(member, 15 * k + 1, 15), 15)) for k in range(4)])


def number_of(hex_digest: Column, digits: int = 16) -> Column:
    """The leading hexadecimal digits as an exact whole number."""
    return F.conv(F.substring(hex_digest, 1, digits), 16, 10).cast("decimal(20,0)")
