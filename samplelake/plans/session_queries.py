"""State machines over events of the driver's table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import fsm
from ..streaming.incremental import results
from .registry import query

#: Each machine's inputs; after a colon, what their payload is.
INPUTS = {
    "search": "QueryChanged:text QueryCleared DebounceTick SearchStarted SearchSettled SearchCancelled SearchFailed FireSelection EnterSimilarityMode ExitSimilarityMode".split(),
    "playback": "Play Pause Resume Stop Seek:number Restart ToggleReverse ToggleLoop SetReverse:flag SetLoop:flag ProgramEnded ConsumeSeek ConsumeRestart".split(),
    "marker": (
        "SetMarker1:number SetMarker2:number SetMarker3:number SetSelectedMarker:number SelectNext SelectPrev ToggleBank ToggleBankSync ClearNearest:number ClearBank NudgeForward:number "
        "NudgeBackward:number MarkerReset:range IncrementRep DecrementRep ToggleInfiniteLoop ToggleMarkerDisplay ExportMarkers:text ImportMarkers:text LoadConfig:banks"
    ).split(),
}


def _payload(kind: str):
    """The event's payload as JSON, from its number."""
    number = F.col("event_id") * 37 % 5000
    bank = F.format_string('{"marks": [%d, 4294967295, 900], "reps": [0, 1, 15, %d]}', number, number % 16)
    kinds = {
        "text": F.format_string('"word %d"', number), "number": number.cast("string"), "flag": F.when(number % 2 == 0, "true").otherwise("false"),
        "range": F.format_string("[%d, %d]", number, number + 4000), "banks": F.format_string('{"A": %s, "B": %s}', bank, bank),
    }
    return kinds[kind] if kind else F.lit(None).cast("string")


def _events(v, machine: str):
    inputs = [x.partition(":") for x in INPUTS[machine]]
    which = (F.xxhash64("event_id") % len(inputs) + len(inputs)) % len(inputs)
    name, payload = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (x, _, kind) in enumerate(inputs):
        name, payload = F.when(which == i, x).otherwise(name), F.when(which == i, _payload(kind)).otherwise(payload)
    return v.table("events").select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), name.alias("input"), payload.alias("payload"))


@query("e04_search_machine")
def e04(v):
    return fsm.fold(_events(v, "search"), "search")


@query("e05_marker_machine")
def e05(v):
    return fsm.fold(_events(v, "marker"), "marker")


@query("e06_playback_machine")
def e06(v):
    return fsm.fold(_events(v, "playback"), "playback")


@query("e01_result_stream")
def e01(v):
    rows = [r for r, _ in zip(results(v.samples.select("id", "path").orderBy("path")), range(50))]
    return v.spark.createDataFrame(rows, "id long, path string")
