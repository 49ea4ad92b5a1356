"""Incremental read labelling and sample abundance with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.sequence import kmer_keys


def label_stream(reads: DataFrame, kmer_index: DataFrame, k: int, *keep: str, ts: str | None = None, late: str = "10 minutes") -> DataFrame:
    """keep..., id of arriving reads: a stream-static join, so labels are appended as reads come.

    With an event-time column each (read, node) pair is passed on once while the
    watermark keeps it; without one a pair may come once per shared k-mer.
    """
    found = kmer_keys(reads, "seq", k, *keep, *([ts] if ts else [])).join(kmer_index, "kmer")
    if ts is None:
        return found.select(*keep, "id")
    return found.withWatermark(ts, late).select(*keep, ts, "id").dropDuplicates([*keep, ts, "id"])


def abundance_stream(reads: DataFrame, kmer_index: DataFrame, k: int) -> DataFrame:
    """id, abund: running number of occurrences of each node's k-mers (complete or update mode; the state is one count per node)."""
    return kmer_keys(reads, "seq", k).join(kmer_index, "kmer").groupBy("id").agg(F.count("*").alias("abund"))


def pair_stream(labels: DataFrame, name: str, ids: str, ts: str, late: str = "10 minutes") -> DataFrame:
    """name, id of arriving reads, where mates share their labels though one comes later than the other.

    labels (name, ids: array of node ids, ts).  Names of mates have one stem with /1 and
    /2.  The first of two is held as state of its stem until the second one comes, then
    both get the labels of both; one whose mate doesn't come before the watermark is
    ``late`` beyond it gets its own.  Reads without such a name are passed on at once.
    State is one read per stem.  A third read of a stem starts anew.
    """
    seconds = int(labels.sparkSession.range(1).select(F.expr(f"unix_seconds(timestamp '1970-01-01 00:00:00 UTC' + interval {late})")).first()[0])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple[str, int]] = []
        held: tuple[str, list[int]] | None = state.get if state.exists else None
        if key[0].startswith("\0"):  # no mate's name
            out = [(n, int(i)) for b in batches for n, x in zip(b["name"], b["ids"], strict=True) for i in x]
        elif state.hasTimedOut:
            if held is not None:
                out = [(held[0], i) for i in held[1]]
            state.remove()
        else:
            rows = sorted(((t.value, n, sorted({int(i) for i in x})) for b in batches for n, x, t in zip(b["name"], b["ids"], b["ts"], strict=True)))
            last = 0
            for at, own, mine in rows:
                last = max(last, at // 1_000_000)
                if held is None:
                    held = (own, mine)
                elif held[0] == own:  # the same read again
                    held = (own, sorted({*held[1], *mine}))
                else:
                    both = sorted({*held[1], *mine})
                    out += [(n, i) for n in (held[0], own) for i in both]
                    held = None
            if held is None:
                if state.exists:
                    state.remove()
            else:
                state.update((held[0], list(held[1])))
                state.setTimeoutTimestamp(max(last + 1000 * seconds, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["name", "id"])

    mate = F.coalesce(F.col(name).rlike(".+/[12]$"), F.lit(False))
    # all reads take one way, so that those without mates move the watermark too; they are spread by what they hold
    spread = F.concat(F.lit("\0"), F.xxhash64(name, ids, ts).cast("string"))
    stem = F.when(mate, F.substring(name, F.lit(1), F.length(name) - 2)).otherwise(spread)
    keyed = labels.select(F.col(name).alias("name"), F.coalesce(F.col(ids), F.array()).cast("array<long>").alias("ids"), F.col(ts).alias("ts"), stem.alias("stem")).withWatermark("ts", late)
    return keyed.groupBy("stem").applyInPandasWithState(step, "name string, id long", "name string, ids array<long>", "append", GroupStateTimeout.EventTimeTimeout)
