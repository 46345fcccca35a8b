"""Choice of readings by what several views heard, and search for repeated phrases in a stream of moras."""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.kana import sounds
from ..functions.sequences import edit_cost, prefix_costs

_SOUND = sounds()
CLOSE, GAIN = 1e-9, 0.25


def select_reading(candidates: list[str], distances: list[dict[str, float]], inferred: frozenset[str] = frozenset()) -> tuple[int, str]:
    """(index, reason) of the chosen candidate; the first is the dictionary's.

    Another one wins if its distances have the least sum, no view is worse off, and the views together gain 0.25 or one hears it
    exactly. Equal sums leave the dictionary's, but a guess (`inferred`) loses ties to other candidates.
    """
    views = list(distances[0]) if distances else []
    if not views:
        return 0, "no-acoustic-evidence"
    sums = [sum(d[v] for v in views) for d in distances]
    least = [i for i, s in enumerate(sums) if s - min(sums) <= CLOSE]
    ties = [i for i in least if candidates[i] not in inferred] or least
    best = ties[0]
    gains = [distances[0][v] - distances[best][v] for v in views]
    harms = min(gains) < -CLOSE
    if best and candidates[0] in inferred:
        return (0, "conflicting-evidence") if harms else (best, "acoustic-over-inferred")
    if len(ties) > 1:
        return 0, "ambiguous-evidence"
    if not best:
        return 0, "dictionary-supported"
    if harms:
        return 0, "conflicting-evidence"
    heard = any(distances[best][v] == 0 for v in views)
    return (best, "acoustic-agreement") if heard or sum(gains) >= GAIN else (0, "weak-evidence")


SELECTED = "doc_id string, line_index long, kana string, reason string, n_candidates long, n_views long"


def select_readings(candidates: DataFrame, transcripts: DataFrame) -> DataFrame:
    """One reading for each line: candidates (doc_id, line_index, pos, moras, inferred), transcripts (doc_id, line_index, view, moras).

    Distances are weighted, with free ends on the transcript's side. A line's few candidates and views are one group.
    """

    def run(key, c: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        c = c.sort_values("pos")
        if not len(c):
            return pd.DataFrame([], columns=["doc_id", "line_index", "kana", "reason", "n_candidates", "n_views"])
        heard = {v: list(m) for v, m in zip(t["view"], t["moras"], strict=True) if m is not None and len(m)}
        readings = [list(m) for m in c["moras"]]
        rows = [{v: edit_cost(r, m, 1.0, 1.0, free_ends=True) for v, m in heard.items()} for r in readings]
        names = ["".join(r) for r in readings]
        best, reason = select_reading(names, rows, frozenset(n for n, i in zip(names, c["inferred"], strict=True) if i))
        return pd.DataFrame([(key[0], key[1], names[best], reason, len(names), len(heard))], columns=["doc_id", "line_index", "kana", "reason", "n_candidates", "n_views"])

    keys = ["doc_id", "line_index"]
    return candidates.groupBy(*keys).cogroup(transcripts.groupBy(*keys)).applyInPandas(run, SELECTED)


@dataclass(frozen=True)
class Occurrence:
    start: float
    end: float
    distance: float
    exact: int
    kana: str
    support: float


def _vowel(mora: str) -> str:
    return _SOUND.get(mora, ("", ""))[1]


def stretches(kana: list[str], starts: np.ndarray, ends: np.ndarray, n: int, slack: int, gap: float) -> Iterator[np.ndarray]:
    """Places of the moras of each stretch that begins at some event: up to n + slack of them within 3 * n + slack events.

    A bare vowel that goes on with the vowel before it belongs to the mora before, except where a stretch begins with it; a
    stretch ends before an event that follows its last mora by more than `gap`.
    """
    vowels = [_vowel(k) for k in kana]
    own = np.array([i == 0 or not (k in "アイウエオ" and vowels[i] == vowels[i - 1]) for i, k in enumerate(kana)])
    before = np.concatenate([[0], np.maximum.accumulate(np.where(own, np.arange(len(kana)), 0))[:-1]]) if len(kana) else own
    for first in range(len(kana)):
        later = np.arange(first + 1, min(len(kana), first + 3 * n + slack))
        far = np.flatnonzero(starts[later] - ends[np.maximum(before[later], first)] > gap)
        later = later[: far[0]] if len(far) else later
        yield np.concatenate([[first], later[own[later]]])[: n + slack]


def candidates(target: list[str], events: list[tuple[str, float, float]], notes: list[tuple[float, float]], gap: float) -> Iterator[Occurrence]:
    """Stretches that are near enough to a phrase, of every length that its cost allows."""
    events = [e for e in events if e[0] != "ー"]
    kana, starts, ends = [e[0] for e in events], np.array([e[1] for e in events]), np.array([e[2] for e in events])
    n, slack = len(target), max(1, len(target) // 5)
    begins, stops = np.array([s for s, _ in notes]), np.array([e for _, e in notes])
    noted = np.array([bool(((begins - 0.12 <= t) & (t <= stops + 0.12)).any()) for t in starts]) if len(notes) else np.zeros(len(events), bool)
    for places in stretches(kana, starts, ends, n, slack, gap):
        score = np.array(prefix_costs(target, [kana[i] for i in places]))[1:]
        size = np.arange(1, len(places) + 1)
        last, support = np.maximum.accumulate(places), np.cumsum(noted[places]) / size
        fits = (size >= max(3, n - slack)) & (5 * score[:, 0] <= n) & (score[:, 1] >= max(3, -(-7 * n // 10)))
        fits &= (ends[last] - starts[places[0]] >= 0.25) & ((score[:, 0] == 0) | (support >= 0.8))
        for k in np.flatnonzero(fits):
            yield Occurrence(float(starts[places[0]]), float(ends[places[k]]), score[k, 0] / n, int(score[k, 1]), "".join(kana[i] for i in places[: k + 1]), float(support[k]))


def occurrences(target: list[str], events: list[tuple[str, float, float]], notes: list[tuple[float, float]], gap: float = 1.0) -> list[Occurrence]:
    """Places without overlap where a phrase of moras is sung again: events are (kana, start, end) in order.

    A stretch may cost a fifth of the phrase's length and has seven tenths of its moras exactly, three at least; its events are
    at most `gap` apart and last 0.25 s; unless it is exact, four fifths of its events begin within 0.12 s of a note. Of
    overlapping stretches the closest, then the one with more exact moras, then the earlier stays.
    """
    kept: list[Occurrence] = []  # by start; they do not overlap, so only the neighbours of a new one matter
    for o in sorted(candidates(target, events, notes, gap), key=lambda o: (o.distance, -o.exact, o.start, o.end)):
        at = bisect.bisect_left(kept, o.end, key=lambda k: k.start)
        if not at or kept[at - 1].end <= o.start:
            kept.insert(at, o)
    return kept


FOUND = "doc_id string, line_index long, start double, end double, distance double, exact_moras long, kana string, note_support double"


def repeated_phrases(phrases: DataFrame, events: DataFrame, notes: DataFrame) -> DataFrame:
    """occurrences() of every line's phrase in its own song: phrases (doc_id, line_index, moras), events (doc_id, kana, start_sec, end_sec)."""
    packed = events.groupBy("doc_id").agg(_sorted("events", "start_sec", "end_sec", "kana"))
    packed = packed.join(notes.groupBy("doc_id").agg(_sorted("notes", "start_sec", "end_sec")), "doc_id", "left")

    def run(batches):
        for df in batches:
            rows = []
            for r in df.itertuples():
                e = [(x["kana"], x["start_sec"], x["end_sec"]) for x in r.events]
                m = [(x["start_sec"], x["end_sec"]) for x in (r.notes if r.notes is not None else [])]
                rows += [(r.doc_id, r.line_index, o.start, o.end, o.distance, o.exact, o.kana, o.support) for o in occurrences(list(r.moras), e, m)]
            yield pd.DataFrame(rows, columns=["doc_id", "line_index", "start", "end", "distance", "exact_moras", "kana", "note_support"])

    return phrases.join(packed, "doc_id").mapInPandas(run, FOUND)


def _sorted(name: str, *columns: str):
    from pyspark.sql import functions as F

    return F.sort_array(F.collect_list(F.struct(*columns))).alias(name)
