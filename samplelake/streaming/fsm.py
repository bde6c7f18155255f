"""State machines of an interactive session, as folds over ordered event tables.

A transition takes a state (a dictionary), an input and its payload, and returns the new
state with what it asks for. Events of a session are folded in the order of ``seq``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

State = dict[str, Any]
Step = tuple[State, list[str]]

NONE = 0xFFFFFFFF
#: Inputs that do nothing while markers are hidden.
EDITS = {
    "SetMarker1", "SetMarker2", "SetMarker3", "SetSelectedMarker", "ClearNearest", "ClearBank", "NudgeForward", "NudgeBackward", "MarkerReset",
    "IncrementRep", "DecrementRep", "ToggleInfiniteLoop",
}


def search_start() -> State:
    return {"transport": "Idle", "mode": "Remote", "query": "", "dirty": False}


def search_step(s: State, event: str, payload: Any) -> Step:
    s, out = dict(s), []
    if event == "QueryChanged":
        s |= {"query": payload or "", "dirty": True}
    elif event == "QueryCleared":
        s |= {"query": "", "dirty": True}
    elif event == "DebounceTick" and s["dirty"]:
        s["dirty"] = False
        if s["mode"] == "Remote":
            s["transport"] = "Pending"
            out.append(f"SpawnSearch({s['query']})")
        else:
            out.append(f"FilterSimilarity({s['query']})")
    elif event == "SearchStarted" and s["transport"] == "Pending":
        s["transport"] = "Running"
    elif event == "SearchSettled" and s["transport"] in ("Pending", "Running"):
        s["transport"] = "Settled"
    elif event in ("SearchCancelled", "SearchFailed"):
        s["transport"] = "Settled"
    elif event == "FireSelection":
        out.append("FireSelection")
    elif event == "EnterSimilarityMode":
        s |= {"mode": "Similarity", "transport": "Settled", "dirty": False}
        out.append("CancelSearch")
    elif event == "ExitSimilarityMode" and s["mode"] == "Similarity":
        s |= {"mode": "Remote", "transport": "Idle", "dirty": True}
    return s, out


def playback_start() -> State:
    return {"transport": "Stopped", "reverse": False, "loop": False, "pending_seek": None, "pending_restart": False}


def playback_step(s: State, event: str, payload: Any) -> Step:
    s, out, now = dict(s), [], s["transport"]
    if event == "Play" and now != "Playing":
        out.append("Start" if now == "Stopped" else "Resume")
        s["transport"] = "Playing"
    elif event == "Pause" and now == "Playing":
        s["transport"] = "Paused"
        out.append("Pause")
    elif event == "Resume" and now == "Paused":
        s["transport"] = "Playing"
        out.append("Resume")
    elif event == "Stop":
        s |= {"transport": "Stopped", "pending_seek": None, "pending_restart": False}
        out += ["Stop"] if now != "Stopped" else []
    elif event == "Seek":
        s["pending_seek"] = int(payload)
    elif event == "Restart":
        s["pending_restart"] |= now != "Stopped"
    elif event in ("ToggleReverse", "ToggleLoop"):
        s[event[6:].lower()] ^= True
    elif event in ("SetReverse", "SetLoop"):
        s[event[3:].lower()] = bool(payload)
    elif event == "ProgramEnded":
        s |= {"pending_restart": True} if s["loop"] else {"transport": "Stopped", "pending_restart": False}
    elif event == "ConsumeSeek":
        s["pending_seek"] = None
    elif event == "ConsumeRestart" and s["pending_restart"] and now == "Playing":
        s["pending_restart"] = False
    return s, out


def _bank() -> dict:
    return {"marks": [NONE] * 3, "reps": [0] * 4}


def marker_start() -> State:
    """Selection: None, 0 for the start of the file, 1 to 3 for a marker."""
    return {"selection": None, "bank": "A", "sync": True, "visible": True, "A": _bank(), "B": _bank()}


def marker_step(s: State, event: str, payload: Any) -> Step:
    s = json.loads(json.dumps(s))
    out: list[str] = []
    if event in EDITS and not s["visible"]:
        return s, out
    active, chosen = s[s["bank"]], s["selection"]
    targets = [s["A"], s["B"]] if s["sync"] else [active]
    there = [0] + [i for i in (1, 2, 3) if active["marks"][i - 1] != NONE]

    def put(i: int, value: int) -> None:
        for bank in targets:
            bank["marks"][i - 1] = value

    if event.startswith("SetMarker"):
        put(int(event[-1]), int(payload))
    elif event == "SetSelectedMarker" and chosen:
        put(chosen, int(payload))
    elif event in ("SelectNext", "SelectPrev"):
        ahead = event == "SelectNext"
        at = there.index(chosen) if chosen in there else None
        s["selection"] = there[(0 if ahead else -1) if at is None else (at + (1 if ahead else -1)) % len(there)]
    elif event == "ToggleBank":
        s["bank"] = "B" if s["bank"] == "A" else "A"
    elif event == "ToggleBankSync":
        s["sync"] ^= True
    elif event == "ClearNearest" and len(there) > 1:
        put(min(there[1:], key=lambda i: (abs(active["marks"][i - 1] - int(payload)), i)), NONE)
    elif event == "ClearBank":
        for i in (1, 2, 3):
            put(i, NONE)
    elif event in ("NudgeForward", "NudgeBackward") and chosen and active["marks"][chosen - 1] != NONE:
        step = int(payload) * (1 if event == "NudgeForward" else -1)
        put(chosen, min(max(active["marks"][chosen - 1] + step, 0), NONE - 1))
    elif event == "MarkerReset":
        start, end = payload
        quarter = (end - start) // 4
        for i, value in enumerate((start + quarter, start + (end - start) // 2, start + quarter * 3), 1):
            put(i, value)
    elif event in ("IncrementRep", "DecrementRep") and chosen is not None:
        for bank in targets:
            bank["reps"][chosen] = min(15, max(0, bank["reps"][chosen] + (1 if event == "IncrementRep" else -1)))
    elif event == "ToggleInfiniteLoop" and chosen is not None:
        value = 1 if active["reps"][chosen] == 15 else 15
        for bank in targets:
            bank["reps"][chosen] = value
    elif event == "ToggleMarkerDisplay":
        s["visible"] ^= True
        s["selection"] = chosen if s["visible"] else None
    elif event in ("ExportMarkers", "ImportMarkers"):
        out.append(f"{event}({payload})")
    elif event == "LoadConfig":
        s |= {"A": payload["A"], "B": payload["B"]}
        if chosen and s[s["bank"]]["marks"][chosen - 1] == NONE:
            s["selection"] = None
    return s, out


MACHINES: dict[str, tuple[Callable[[], State], Callable[[State, str, Any], Step]]] = {
    "search": (search_start, search_step),
    "playback": (playback_start, playback_step),
    "marker": (marker_start, marker_step),
}
OUTPUT = "session string, seq long, state string, outputs string"


def _fold(machine: str, state: State, events: pd.DataFrame) -> tuple[State, pd.DataFrame]:
    rows = []
    for e in events.sort_values("seq").itertuples():
        state, out = MACHINES[machine][1](state, e.input, json.loads(e.payload) if isinstance(e.payload, str) and e.payload else None)
        rows.append((str(e.session), int(e.seq), json.dumps(state, sort_keys=True), json.dumps(out)))
    return state, pd.DataFrame(rows, columns=["session", "seq", "state", "outputs"])


def fold(events: DataFrame, machine: str) -> DataFrame:
    """(session, seq, state, outputs) after each event (session, seq, input, payload as JSON)."""
    start = MACHINES[machine][0]
    return events.groupBy("session").applyInPandas(lambda pdf: _fold(machine, start(), pdf)[1], OUTPUT)


def fold_stream(events: DataFrame, machine: str) -> DataFrame:
    """The same over a stream, whose events come in order; a session's state is kept."""
    start = MACHINES[machine][0]

    def run(key: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(kept.get[0]) if kept.exists else start()
        state, rows = _fold(machine, state, pd.concat(list(frames)))
        kept.update((json.dumps(state),))
        yield rows

    return events.groupBy("session").applyInPandasWithState(run, OUTPUT, "state string", "append", GroupStateTimeout.NoTimeout)
