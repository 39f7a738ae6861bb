"""The whole way from events to the flat table of validated tracks."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ptrack.operators.detect import Detection, detect
from ptrack.operators.filters import apply_filters
from ptrack.operators.track import track
from ptrack.operators.validate import export_table, validate
from ptrack.params import Params
from ptrack.session import cut_lineage


@dataclass
class Result:
    detection: Detection
    tracks: DataFrame
    checked: DataFrame
    table: DataFrame


def run(events: DataFrame, p: Params, box=None, crop=None) -> Result:
    """load -> filter -> detect -> track -> validate -> export. Each stage ends in a
    materialised table, the points at which the stages can also be saved."""
    d = detect(apply_filters(events, box, crop, p.only_positive), p)
    tracks = cut_lineage(track(d.clusters, p, d.centers))
    checked = validate(tracks, p)
    return Result(d, tracks, checked, export_table(checked))
