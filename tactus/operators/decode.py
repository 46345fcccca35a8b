"""Least-cost assignment of sung units to notes: a dynamic program for every phrase, run as a grouped Arrow function.

Units come in order, each with an onset or none; notes come in order of time. A unit is omitted at a cost or takes a run of
consecutive notes; notes in between are left over at a cost. A note that the onset of the next unit cuts may be shared.
Equal totals are decided by the trace of actions, so results do not depend on the order of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Costs:
    """Weights. Fixed values."""

    onset: float = 0.11258317857582528
    pitch: float = 0.30469269715364344
    split: float = 0.2971988578273897
    omission: float = 0.7357166836930735
    rest: float = 0.60
    rest_duration: float = 0.6299605249474366
    inner_rest: float = 1.0
    inner_rest_duration: float = 2.0
    note_only: float = 1.50
    note_only_duration: float = 0.75
    scale: float = 0.10
    gap: float = 0.04


Note = tuple[float, float, int]


def run_cost(onset: float | None, notes: list[Note], previous: Note | None, shared: bool, c: Costs) -> float:
    """Cost of one unit sung on a run of notes."""
    start = onset if shared and onset is not None else notes[0][0]
    total = 0.0 if onset is None else c.onset * abs(onset - start) / c.scale
    for a, b in zip(notes, notes[1:], strict=False):
        total += c.pitch * (a[2] != b[2])
        if b[0] - a[1] > c.gap:
            total += c.inner_rest + c.inner_rest_duration * (b[0] - a[1])
    if shared:
        total += c.split
    elif previous is not None and notes[0][0] - previous[1] > c.gap:
        total += c.rest + c.rest_duration * (notes[0][0] - previous[1])
    return total


def left_over(notes: list[Note], c: Costs) -> float:
    return c.note_only + c.note_only_duration * sum(e - s for s, e, _ in notes) if notes else 0.0


def decode(onsets: list[float | None], notes: list[Note], c: Costs = Costs()) -> tuple[float, list[tuple[str, int, int, int]]]:
    """(cost, actions): actions are (assign, unit, first note, last note), (omit, unit, -1, -1) and (skip, -1, first, last).

    A state is (next unit, next note, last note used); units without an onset are omitted.
    """
    states: dict[tuple[int, int], tuple[float, tuple]] = {(0, -1): (0.0, ())}
    for u, onset in enumerate(onsets):
        new: dict[tuple[int, int], tuple[float, tuple]] = {}

        def offer(key, total, trace):
            if key not in new or (round(total, 12), trace) < (round(new[key][0], 12), new[key][1]):
                new[key] = total, trace

        for (cursor, last), (total, trace) in states.items():
            offer((cursor, last), total + c.omission, (*trace, ("omit", u, -1, -1)))
            if onset is None:
                continue
            firsts = list(range(cursor, len(notes)))
            if cursor and last == cursor - 1 and notes[last][0] < onset < notes[last][1]:
                firsts.insert(0, last)
            for a in firsts:
                shared = a < cursor
                skipped = [] if shared else notes[cursor:a]
                skip = (("skip", -1, cursor, a - 1),) if skipped else ()
                for b in range(a, len(notes)):
                    cost = total + left_over(skipped, c) + run_cost(onset, notes[a : b + 1], notes[last] if last >= 0 else None, shared, c)
                    offer((b + 1, b), cost, (*trace, *skip, ("assign", u, a, b)))
        states = new
    ends = []
    for (cursor, _), (total, trace) in states.items():
        rest = notes[cursor:]
        ends.append((round(total + left_over(rest, c), 12), (*trace, *((("skip", -1, cursor, len(notes) - 1),) if rest else ()))))
    cost, trace = min(ends)
    return cost, list(trace)


SCHEMA = "doc_id string, phrase_id long, step int, action string, unit int, first_note int, last_note int, total_cost double"


def decode_phrases(units: DataFrame, notes: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """Actions of every phrase. units: (doc_id, phrase_id, pos, onset); notes: (doc_id, phrase_id, pos, start_sec, end_sec, pitch).

    A phrase is a line of a song, so a group is small however long the song is.
    """

    def run(key, u: pd.DataFrame, n: pd.DataFrame) -> pd.DataFrame:
        u, n = u.sort_values("pos"), n.sort_values(["start_sec", "pos"])
        onsets = [None if pd.isna(x) else float(x) for x in u["onset"]]
        rows = [(float(s), float(e), int(p)) for s, e, p in zip(n["start_sec"], n["end_sec"], n["pitch"], strict=True)]
        cost, actions = decode(onsets, rows, costs)
        return pd.DataFrame([(key[0], key[1], i, *a, cost) for i, a in enumerate(actions)], columns=["doc_id", "phrase_id", "step", "action", "unit", "first_note", "last_note", "total_cost"])

    keys = ["doc_id", "phrase_id"]
    return units.groupBy(*keys).cogroup(notes.groupBy(*keys)).applyInPandas(run, SCHEMA)


def align_lines(recognized: list[str], supplied: list[str], similar, most: int = 4) -> list[tuple[list[int], list[int]]]:
    """Groups of consecutive lines on both sides that say the same: the alignment with the largest weight, fewer groups on a tie.

    The weight of a pair of groups is (sum of lengths) * (2 * similarity - 1); lines in no group stay alone.
    """
    n, m = len(recognized), len(supplied)
    best: dict[tuple[int, int], tuple[float, int, tuple]] = {(0, 0): (0.0, 0, ())}
    for i in range(n + 1):
        for j in range(m + 1):
            if (i, j) not in best:
                continue
            w, g, t = best[i, j]
            moves = []
            if i < n:
                moves.append((i + 1, j, 0.0, ((i, i + 1, j, j),)))
            if j < m:
                moves.append((i, j + 1, 0.0, ((i, i, j, j + 1),)))
            for a in range(1, min(most, n - i) + 1):
                for b in range(1, min(most, m - j) + 1):
                    x, y = "".join(recognized[i : i + a]), "".join(supplied[j : j + b])
                    if x and y and 2 * min(len(x), len(y)) >= max(len(x), len(y)):
                        r = similar(x, y)
                        if r > 0.5:
                            moves.append((i + a, j + b, (len(x) + len(y)) * (2 * r - 1), ((i, i + a, j, j + b),)))
            for p, q, gain, step in moves:
                new = (w + gain, g + 1, (*t, *step))
                if (p, q) not in best or (-round(new[0], 9), new[1], new[2]) < (-round(best[p, q][0], 9), best[p, q][1], best[p, q][2]):
                    best[p, q] = new
    return [(list(range(a, b)), list(range(c, d))) for a, b, c, d in best[n, m][2]]
