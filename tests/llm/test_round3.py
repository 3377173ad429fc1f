"""Tests of the findings of round 3."""

from __future__ import annotations

import numpy as np

from pricelake.llm import fingerprint


def test_crowded_bands_lose_no_near_class(spark, monkeypatch):
    """A chain of near prints in one band, cut into parts of four: one class, as without the cut."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 256, fingerprint.SLOTS, dtype=np.uint8)
    rows = []
    for k in range(40):
        p = base.copy()
        p[rng.choice(fingerprint.SLOTS, 14, replace=False)] = rng.integers(0, 256, 14)
        rows.append((k, p.tobytes().hex()))
    prints = spark.createDataFrame(rows, "doc_id long, fingerprint string")
    monkeypatch.setattr(fingerprint, "band_keys", lambda found: np.zeros((len(found), 1), np.int64))
    monkeypatch.setattr(fingerprint, "BANDS", 1)
    members = fingerprint.near_classes(prints).collect()
    monkeypatch.setattr(fingerprint, "CROWD", 4)
    again = fingerprint.near_classes(prints).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, members)) and {r["class_id"] for r in again} == {0}
