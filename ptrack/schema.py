"""Schemas of the tables that pass between the stages."""

# µs times, 0-based pixels, velocities in px/µs
EVENTS = "event_idx bigint, x int, y int, t double, p int"
CLUSTERS = "cluster_id bigint, k int, event_idx bigint, x int, y int, t double"
CENTERS = "cluster_id bigint, k int, xm double, ym double, tm double"
TRACKS = "cluster_id bigint, seq int, t double, x double, y double, u double, v double"
