"""Filling containers of fixed capacities with documents measured in tokens.

Documents are dealt at random into groups of bounded size, and each group is packed by
variable-capacity best fit: pieces in decreasing order go to the open container with the
least room that still takes them; where none does, a container of the permitted size is
opened whose cost per token it can hope to hold is least. When all pieces are placed,
every container is downsized to the smallest permitted capacity that holds its contents.
Containers that stay poorly filled in a group are unpacked and packed again across
groups, round by round, while that saves room. A document is cut only if it alone
exceeds the largest permitted capacity.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholiast.llm.encoding import VOCABULARY, with_token_count
from scholiast.runtime import materialize, spread, table

# Pieces of one group; a group is packed by one task.
GROUP = 20_000
# A container below this fill is packed again.
POOR = 0.97


def best_fit(sizes: list[int], capacities: list[int], overhead: float = 0.0) -> tuple[list[int], list[int]]:
    """(container of each piece, capacity of each container) for pieces no larger than the largest capacity.

    `overhead` is the cost of a container beside its capacity. Ties go to the container
    opened first, so the packing is the same however the pieces are ordered, up to equal pieces.
    """
    permitted = sorted(set(capacities))
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    left = sum(sizes)
    where = [0] * len(sizes)
    opened: list[int] = []
    used: list[int] = []
    rooms: list[int] = []  # rooms of open containers in increasing order, and their containers
    holders: dict[int, list[int]] = {}
    for i in order:
        s = sizes[i]
        at = bisect.bisect_left(rooms, s)
        if at < len(rooms):
            room = rooms[at]
            c = holders[room].pop()
            if not holders[room]:
                del holders[room]
                rooms.pop(at)
        else:
            # what is left can fill the rest of a larger container, but never more than there is
            c = len(opened)
            size = min((p for p in permitted if p >= s), key=lambda p: ((p + overhead) / min(p, left), -p))
            opened.append(size)
            used.append(0)
            room = size
        where[i] = c
        used[c] += s
        left -= s
        rest = room - s
        if rest:
            if rest not in holders:
                bisect.insort(rooms, rest)
                holders[rest] = []
            holders[rest].append(c)
    return where, [permitted[bisect.bisect_left(permitted, u)] if u else permitted[0] for u in used]


def plan(sizes: list[int], capacities: list[int]) -> tuple[list[int], list[int]]:
    """The cheapest of the best-fit packings that permit all sizes, or one of them alone or from it downwards."""
    permitted = sorted(set(capacities))
    largest = max(sizes, default=0)
    fitting = [k for k in range(len(permitted)) if permitted[k] >= largest]
    tries = [best_fit(sizes, some) for k in fitting for some in (permitted[: k + 1], permitted[k : k + 1])]
    return min(
        (([*w], [permitted[bisect.bisect_left(permitted, u)] for u in _loads(sizes, w)]) for w, _ in tries),
        key=lambda t: (sum(t[1]), len(t[1])),
    )


def _loads(sizes: Iterable[int], where: list[int]) -> list[int]:
    loads = [0] * (max(where, default=-1) + 1)
    for s, c in zip(sizes, where):
        loads[c] += s
    return loads


def pieces(docs: DataFrame, largest: int, size: str = "n_tokens") -> DataFrame:
    """doc_id, piece_no, token_start, tokens: documents whole, or cut at the largest capacity if they exceed it."""
    n = F.col(size)
    cuts = F.when(n <= largest, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1, F.lit(largest)))
    return (
        docs.where(n > 0)
        .select("doc_id", n.alias("n"), F.posexplode(cuts).alias("p", "token_start"))
        .select("doc_id", (F.col("p") + 1).alias("piece_no"), "token_start", F.least(F.lit(largest), F.col("n") - F.col("token_start")).alias("tokens"))
    )


_PACKED = "doc_id long, piece_no int, token_start int, tokens int, container string, capacity int, used int"


def _packer(r: int, capacities: list[int]) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["tokens", "doc_id", "piece_no"], ascending=[False, True, True], ignore_index=True)
        where, sizes = plan(df["tokens"].tolist(), capacities)
        used = _loads(df["tokens"], where)
        return df[["doc_id", "piece_no", "token_start", "tokens"]].assign(
            container=[f"{r}-{key[0]}-{c}" for c in where], capacity=[sizes[c] for c in where], used=[used[c] for c in where]
        )

    return run


def pack(items: DataFrame, capacities: list[int], rounds: int = 3) -> DataFrame:
    """Items (doc_id, piece_no, token_start, tokens) with their container, its capacity and contents.

    Each round packs groups of about GROUP items; containers filled to POOR or more, and
    all containers of the last round, are final. Only the rest is packed again.
    """
    left, done = items, None
    for r in range(1, rounds + 1):
        count = left.count()
        if count == 0 and done is not None:
            break
        groups = max(1, -(-count // GROUP))
        final = r == rounds or groups == 1

        dealt = left.select("doc_id", "piece_no", "token_start", "tokens", F.pmod(F.xxhash64("doc_id", "piece_no", F.lit(r)), F.lit(groups)).alias("g"))
        packed = materialize(dealt.repartition(min(groups, 4096), "g").groupBy("g").applyInPandas(_packer(r, capacities), _PACKED))
        kept = packed if final else packed.where(F.col("used") >= POOR * F.col("capacity"))
        done = kept if done is None else done.unionByName(kept)
        if final:
            break
        left = packed.where(F.col("used") < POOR * F.col("capacity"))
    return done


def pack_windows(sized: DataFrame, windows: list[tuple[str, list[int]]]) -> DataFrame:
    """One full packing per window: (window_name, permitted capacities)."""
    out = None
    for name, capacities in windows:
        part = pack(pieces(sized, max(capacities)), capacities).select(F.lit(name).alias("window_name"), "container", "capacity", "used", "doc_id", "piece_no", "token_start", "tokens")
        out = part if out is None else out.unionByName(part)
    return out


def token_sizes(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens of every document; null and empty texts have 0 tokens and take no room."""
    return with_token_count(spread(documents.select("doc_id", "text")), "text", ["doc_id"], "n_tokens", path)


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into containers of each capacity by itself, and into all capacities jointly."""
    caps = [(r["window_name"], r["capacity"]) for r in table(spark, sf_dir, "token_windows").orderBy("capacity").collect() if r["capacity"]]
    sized = materialize(token_sizes(table(spark, sf_dir, "documents")))
    return pack_windows(sized, [(n, [c]) for n, c in caps] + [("joint", [c for _, c in caps])])


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, capacity and contents per window and capacity."""
    bins = p8_packed(spark, sf_dir).groupBy("window_name", "container").agg(F.first("capacity").alias("capacity"), F.sum("tokens").alias("used"))
    return bins.groupBy("window_name", "capacity").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("used").alias("tokens"), (F.sum("used") / F.sum(F.col("capacity"))).alias("fill"))
