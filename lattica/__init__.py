"""Graph aggregation, attention, scheduling and sampling as DataFrame algebra over edges(eid, dst, src, val) and features(v, feat)."""
