"""Packed shuffles: many small (key, owner) records sent as a few binary rows.

A record costs its key and a share of its owner's id instead of a Spark row. Keys are split over buckets by
hash, so a bucket is a vertical slice of the key space; records of one key that meet in one map task are
pre-aggregated before they are sent, and the number of buckets follows the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SCHEMA = "bucket int, kind int, owners binary, runs binary, keys binary, extras binary"
_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("owners", pa.binary()), ("runs", pa.binary()), ("keys", pa.binary()), ("extras", pa.binary())])


#: Records that a task gathers before it packs them.
TOGETHER = 500_000


class Packer:
    """Gathers the records of a task's slices and packs many at a time, so that a row holds many records of its bucket.

    narrow keeps 32 bits of a key beside its bucket (a superset filter), else all 64. extras, if given, is a
    64-bit value of each record.
    """

    def __init__(self, buckets: int, narrow: bool) -> None:
        self.buckets, self.narrow = buckets, narrow
        self.held: list[tuple] = []
        self.n = 0

    def add(self, keys: np.ndarray, owners: np.ndarray, kinds: np.ndarray | int, extras: np.ndarray | None = None, by_owner: bool = False) -> None:
        """Records for the buckets of their keys, or (by_owner) of their owners."""
        if len(keys):
            where = ((owners.view(np.uint64) if by_owner else keys) % np.uint64(self.buckets)).astype(np.int32)
            kinds = np.full(len(keys), kinds, np.int8) if np.isscalar(kinds) else kinds
            self.held.append((where, keys, owners, kinds, extras))
            self.n += len(keys)

    def full(self) -> Iterator[pa.RecordBatch]:
        if self.n >= TOGETHER:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            where, keys, owners, kinds, extras = (None if x[0] is None else np.concatenate(x) for x in zip(*self.held))
            self.held, self.n = [], 0
            yield from pack_at(where, keys, owners, kinds, self.narrow, extras)


def pack_at(where: np.ndarray, keys: np.ndarray, owners: np.ndarray, kinds: np.ndarray, narrow: bool, extras: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of SCHEMA from records and the bucket of each."""
    if not len(keys):
        return
    order = np.lexsort((owners, kinds, where))
    where, keys, owners, kinds = where[order], keys[order], owners[order], kinds[order]
    keys = (keys >> np.uint64(32)).astype(np.uint32) if narrow else keys
    extras = None if extras is None else extras[order]
    group = np.flatnonzero(np.concatenate(([True], (where[1:] != where[:-1]) | (kinds[1:] != kinds[:-1]))))
    run = np.flatnonzero(np.concatenate(([True], (where[1:] != where[:-1]) | (kinds[1:] != kinds[:-1]) | (owners[1:] != owners[:-1]))))
    size = np.diff(np.append(run, len(keys))).astype(np.uint32)
    cut = np.append(np.searchsorted(run, group), len(run))
    end = np.append(group, len(keys))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(where[group], pa.int32()),
            pa.array(kinds[group], pa.int32()),
            pa.array([owners[run[a:b]].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
            pa.array([size[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()),
            pa.array([keys[a:b].tobytes() for a, b in zip(end[:-1], end[1:])], pa.binary()),
            pa.array([b"" if extras is None else extras[a:b].tobytes() for a, b in zip(end[:-1], end[1:])], pa.binary()),
        ],
        schema=_ARROW,
    )


def unpack(rows: pa.Table, narrow: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, owner, kind) arrays of a group of packed rows."""
    kind = rows["kind"].to_numpy()
    keys = [np.frombuffer(x.as_buffer(), np.uint32 if narrow else np.uint64) for x in rows["keys"]]
    owners = [np.repeat(np.frombuffer(o.as_buffer(), np.int64), np.frombuffer(r.as_buffer(), np.uint32)) for o, r in zip(rows["owners"], rows["runs"])]
    return np.concatenate(keys), np.concatenate(owners), np.repeat(kind, [len(k) for k in keys])


def unpack_extras(rows: pa.Table) -> np.ndarray:
    """The records' extras, in the order of unpack."""
    return np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in rows["extras"]])


def first_of(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts."""
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))) if len(sorted_keys) else np.zeros(0, np.int64)


def by_owner(owners: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[list[bytes]]]:
    """Distinct owners and, for each array of values, the bytes of each owner's values."""
    order = np.argsort(owners, kind="stable")
    owners = owners[order]
    begin = first_of(owners)
    end = np.append(begin, len(owners))
    return owners[begin], [[v[order][a:b].tobytes() for a, b in zip(end[:-1], end[1:])] for v in values]


def answers(owners: np.ndarray, values: np.ndarray, kinds: np.ndarray, buckets: int) -> pa.Table:
    """Packed rows that take values back to their owners' buckets, as many as there are buckets at most."""
    where = (owners.view(np.uint64) % np.uint64(buckets)).astype(np.int32)
    return pa.Table.from_batches(list(pack_at(where, values, owners, kinds, False)), schema=_ARROW)
