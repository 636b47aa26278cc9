"""Comparing sequences and speaker turns."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from difflib import SequenceMatcher
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def diff_steps(a: Column, b: Column) -> Column:
    """What turns text a into b: array of (kind, a_from, a_to, b_from, b_to) over words."""

    @F.pandas_udf("array<struct<kind: string, a_from: int, a_to: int, b_from: int, b_to: int>>")
    def steps(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([[list(op) for op in SequenceMatcher(None, (p or "").split(), (q or "").split(), autojunk=False).get_opcodes() if op[0] != "equal"] for p, q in zip(x, y)])

    return steps(a, b)


def matched_speakers(shared: dict[tuple[str, str], float]) -> dict[str, str]:
    """The one-to-one mapping of hypothesis to reference speakers that shares most time. Exact for up to eight speakers,
    beyond by the largest pair first."""
    ref, hyp = sorted({r for r, _ in shared}), sorted({h for _, h in shared})
    if max(len(ref), len(hyp)) <= 8:
        small, large, flip = (hyp, ref, False) if len(hyp) <= len(ref) else (ref, hyp, True)
        best = max(permutations(large, len(small)), key=lambda p: sum(shared.get((y, x) if not flip else (x, y), 0.0) for x, y in zip(small, p)))
        return {(y if flip else x): (x if flip else y) for x, y in zip(small, best)}
    out: dict[str, str] = {}
    for (r, h), _ in sorted(shared.items(), key=lambda x: (-x[1], x[0])):
        if h not in out and r not in out.values():
            out[h] = r
    return out


def speech_errors(turns: Iterable[tuple[str, str | None, float, float]]) -> tuple[float, float, float, float]:
    """Missed, false alarm, confusion and total speech of one recording's turns (side, speaker, lo, hi), by one sweep over
    their ends. A turn that doesn't end after it starts has no speech."""
    steps: dict[float, list[tuple[str, str | None, int]]] = {}
    for side, speaker, lo, hi in turns:
        if lo < hi:
            steps.setdefault(lo, []).append((side, speaker, 1))
            steps.setdefault(hi, []).append((side, speaker, -1))
    open_turns: dict[str, dict[str | None, int]] = {"ref": {}, "hyp": {}}
    slices, shared, before = [], {}, None
    for at in sorted(steps):
        ref, hyp = open_turns["ref"], open_turns["hyp"]
        if ref or hyp:
            slices.append((at - before, set(ref), set(hyp)))
            for r in ref:
                for h in hyp:
                    shared[r, h] = shared.get((r, h), 0.0) + at - before
        for side, speaker, change in steps[at]:
            now = open_turns.setdefault(side, {})
            now[speaker] = now.get(speaker, 0) + change
            if not now[speaker]:
                del now[speaker]
        before = at
    mapping = matched_speakers(shared)
    missed = sum(d * max(0, len(r) - len(h)) for d, r, h in slices)
    false = sum(d * max(0, len(h) - len(r)) for d, r, h in slices)
    wrong = sum(d * (min(len(r), len(h)) - len(r & {mapping.get(x) for x in h})) for d, r, h in slices)
    return float(missed), float(false), float(wrong), float(sum(d * len(r) for d, r, _ in slices))


def diarisation_errors(turns: DataFrame) -> DataFrame:
    """turns: recording, side ('ref' or 'hyp'), speaker, lo, hi. missed, false alarm, confusion and total speech of each
    recording; a recording's turns are one task's work, those of many recordings come in one batch."""
    parts = ["side", "speaker", "lo", "hi"]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(i, *speech_errors(zip(*(x.tolist() for x in columns)))) for i, *columns in zip(batch["recording"], *(batch[c] for c in parts))]
            yield pd.DataFrame(found, columns=["recording", "missed", "false_alarm", "confusion", "total"])

    whole = turns.groupBy("recording").agg(F.collect_list(F.struct("side", "speaker", F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"))).alias("t"))
    whole = whole.select(F.col("recording").cast("string").alias("recording"), *[F.col(f"t.{c}").alias(c) for c in parts])
    return whole.mapInPandas(score, "recording string, missed double, false_alarm double, confusion double, total double")
