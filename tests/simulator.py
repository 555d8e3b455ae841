"""A plain sequential store: what the operators are compared with."""

from __future__ import annotations

import random

from loomlog.functions.hashing import shard_of


class Store:
    def __init__(self, shards: int = 8) -> None:
        self.shards, self.entries, self.next_id, self.log, self.replies = shards, {}, {}, [], {}

    def apply(self, seq, op, key, value):
        shard = shard_of(key, self.shards)
        old = self.entries.get(key)
        if op == "GET":
            live = old is not None and not old["tombstone"]
            self.replies[seq] = ("OK", old["value"]) if live else ("NOT_FOUND", None)
            return
        if op == "PUT":
            size, vsize = len(key.encode()), len((value or "").encode())
            status = "EMPTY_KEY" if not size else "KEY_TOO_LARGE" if size > 1024 else "VALUE_TOO_LARGE" if vsize > 1 << 20 else "OK"
            self.replies[seq] = (status, None)
            if status != "OK":
                return
        else:
            if old is None or old["tombstone"]:
                self.replies[seq] = ("NOT_FOUND", None)
                return
            self.replies[seq] = ("OK", None)
        version = (old["version"] if old else 0) + 1
        write_id = self.next_id.get(shard, 1)
        self.next_id[shard] = write_id + 1
        kept = (value or "") if op == "PUT" else None
        self.entries[key] = {"value": kept, "version": version, "write_id": write_id, "tombstone": op == "DELETE", "shard": shard}
        self.log.append((shard, write_id, version, op, key, kept, seq))


def random_ops(seed: int, n: int, keys: int) -> list[tuple]:
    rng = random.Random(seed)
    pool = [f"k{i}" for i in range(keys)] + ["", "é" * 3, "x" * 1025]
    return [(seq * rng.choice([1]), rng.choice(["PUT", "PUT", "GET", "DELETE"]), rng.choice(pool), rng.choice(["", "v", "w" * 50, None])) for seq in range(n)]
