"""Several recordings in one table, each told apart by its ``stream_id``.

Recordings are laid side by side: each gets a room of its own on the time axis and a range of
slice numbers of its own, so that no window, link or slice reaches from one into another. Cuts
and grids stay those of a recording by itself: slices start at its first event, and it is moved by
whole steps of the point grid. What looks at all tracks (quality scores, track numbers) is
computed for each recording. Results carry the stream_id and the recording's own times."""
from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import DataFrame, functions as F

from ptrack.functions.chains import LABEL_BITS
from ptrack.functions.ordered import dense_seq
from ptrack.operators.detect import SECOND_RUN, Detection, detect
from ptrack.operators.filters import apply_filters, finite
from ptrack.operators.slicing import slice_count
from ptrack.operators.track import track
from ptrack.operators.validate import validate
from ptrack.params import Params
from ptrack.session import as_table, cut_lineage

EMPTY_SLICES = 16            # at least so many between two recordings
BROADCAST_ROWS = 100_000     # a longer list of recordings is joined by a shuffle


@dataclass
class Layout:
    """recordings: (stream_id, place, t0, t1, shift), t0 and t1 after the shift."""
    recordings: DataFrame
    count: int
    stride: int              # slice numbers of one recording

    def small(self, *cols) -> DataFrame:
        r = self.recordings.select(*cols)
        return F.broadcast(r) if self.count <= BROADCAST_ROWS else r


def lay_out(events: DataFrame, p: Params) -> Layout:
    """Rooms of equal length for all recordings. Rows without a time count for nothing, a null
    stream_id is a recording like any other."""
    rec = cut_lineage(events.where(F.col("t").isNotNull()).groupBy("stream_id")
                      .agg(F.min("t").alias("t0"), F.max("t").alias("t1")))
    n, longest, span = rec.agg(F.count(F.lit(1)), F.max(slice_count(F.struct("t0", "t1"), p.dt)),
                               F.max(F.col("t1") - F.col("t0"))).first()
    stride = 1 << ((longest or 1) + EMPTY_SLICES - 1).bit_length()
    if n * stride >= 1 << 31:
        raise ValueError(f"{n} recordings of up to {longest} slices need more than 2^31 slice numbers; run them in parts")
    reach = EMPTY_SLICES * max(p.dt * p.multi_factor, p.dt * p.nb_dt_factor, 4 * p.step)
    room = ceil(((span or 0.0) + reach) / p.step) + 1
    ids = dense_seq(rec, [], F.pmod(F.xxhash64("stream_id"), F.lit(1024)), ["stream_id"], "place")
    shift = (F.col("place") * room - F.floor(F.col("t0") / p.step)) * p.step
    ids = ids.select("stream_id", "place", (F.col("t0") + shift).alias("t0"), (F.col("t1") + shift).alias("t1"), shift.alias("shift"))
    return Layout(cut_lineage(ids), n, stride)


def side_by_side(events: DataFrame, lay: Layout) -> DataFrame:
    """Events on the common time axis with ``rec`` (t0, t1, k0) in place of the stream_id."""
    r = lay.small(F.col("stream_id").alias("_id"), "shift",
                  F.struct("t0", "t1", (F.col("place") * lay.stride).alias("k0")).alias("rec"))
    return (events.join(r, F.col("stream_id").eqNullSafe(F.col("_id")))
            .withColumn("t", F.col("t") + F.col("shift")).drop("_id", "shift", "stream_id"))


def own_times(rows: DataFrame, lay: Layout, *times: str) -> DataFrame:
    """Rows of clusters or tracks with the stream_id and the times of their recording."""
    place = F.shiftright(F.col("cluster_id").bitwiseAND(F.lit(SECOND_RUN - 1)), LABEL_BITS + lay.stride.bit_length() - 1)
    d = rows.withColumn("place", place).join(lay.small("place", "stream_id", "shift"), "place")
    return d.select("stream_id", *[(F.col(c) - F.col("shift")).alias(c) if c in times else F.col(c) for c in rows.columns])


def export_by_recording(checked: DataFrame) -> DataFrame:
    """Flat table (stream_id, t, x, y, u, v, trackid) of valid points; track ids 0, 1, … in
    each recording over the tracks that keep a point."""
    good = finite(checked.where("ok"), "t", "x", "y", "u", "v")
    key = F.coalesce(F.concat(F.lit("="), F.col("stream_id").cast("string")), F.lit(""))      # null is a key too
    ids = dense_seq(good.select(key.alias("_key"), "cluster_id").distinct(), ["_key"],
                    F.shiftright("cluster_id", 16), ["cluster_id"], "trackid").drop("_key")
    return good.join(ids, "cluster_id").select("stream_id", "t", "x", "y", "u", "v", "trackid")


@dataclass
class Recordings:
    detection: Detection
    tracks: DataFrame
    checked: DataFrame
    table: DataFrame


def run_recordings(events: DataFrame, p: Params, box=None, crop=None) -> Recordings:
    """The whole way for all recordings of (stream_id, event_idx, x, y, t, p) at once, equal to
    one run for each. event_idx tells events apart within a recording."""
    ev = as_table(apply_filters(events, box, crop, p.only_positive))
    lay = lay_out(ev, p)
    q = p.with_(slice_stride=lay.stride)
    d = detect(side_by_side(ev, lay), q)
    tracks = cut_lineage(track(d.clusters, q, d.centers))
    keyed = own_times(tracks, lay)
    checked = own_times(validate(keyed, q, ["stream_id"]).drop("stream_id"), lay, "t")
    found = Detection(own_times(d.clusters, lay, "t"), own_times(d.centers, lay, "tm"), own_times(d.steps, lay))
    return Recordings(found, own_times(tracks, lay, "t"), checked, export_by_recording(checked))
