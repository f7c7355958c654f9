"""A seen store in generations says what a plain one says, with few folders, also after a crash."""

import os
from datetime import datetime, timedelta

import pytest

from pagequarry.sources.generations import SeenGenerations
from pagequarry.sources.seen_store import SEEN_STORES, SeenFiles

NOW = datetime(2024, 1, 10, 12)
DAY = timedelta(days=1)


def entries(spark, urls, until):
    return spark.createDataFrame([(u, until) for u in urls], "url string, expiration_date timestamp_ntz").coalesce(1)


def seen(df):
    return {} if df is None else {r.url: r.expiration_date for r in df.collect()}


def test_generations_say_what_runs_say(spark, tmp_path):
    store, plain = SeenGenerations(f"{tmp_path}/g", ratio=2), SeenFiles(f"{tmp_path}/p")
    assert store.read(spark) is None and SEEN_STORES["generations"](f"{tmp_path}/x").read(spark) is None
    for k in range(9):
        new = entries(spark, [f"u{k % 4}", f"v{k}"], NOW + (40 - k) * DAY)
        for s in (store, plain):
            s.add(new, f"run{k}", NOW + k * DAY)
            if k == 5:  # repeated: what it had stored is replaced
                s.add(entries(spark, ["again"], NOW + 50 * DAY), "run5", NOW + 5 * DAY)
    assert seen(store.read(spark)) == seen(plain.read(spark))
    assert seen(store.read(spark, "run8")) == seen(plain.read(spark, "run8"))
    assert store.read(spark, "run*") is None
    parts = store.parts(spark)
    assert len(parts) <= 5 and sorted(r for p in parts for r in p.runs) == [f"run{k}" for k in range(9)]
    assert len(os.listdir(f"{tmp_path}/g/manifest")) <= 4 and len(os.listdir(f"{tmp_path}/g/parts")) <= 8


def test_expired_entries_go_where_they_hide_nothing(spark, tmp_path):
    store = SeenGenerations(f"{tmp_path}/g", ratio=2)
    for k in range(3):
        store.add(entries(spark, [f"u{k}"], NOW + DAY), f"run{k}", NOW + 2 * k * DAY)
    # runs 0 and 1 became the lowest generation when both had expired
    assert set(seen(store.read(spark))) == {"u2"}
    store = SeenGenerations(f"{tmp_path}/h", ratio=2)
    store.add(entries(spark, ["x"], NOW + 99 * DAY), "a", NOW)
    for k in range(4):
        store.add(entries(spark, ["x"], NOW + DAY), f"b{k}", NOW + (k + 2) * DAY)
    # a later entry that has expired still hides the earlier one
    assert seen(store.read(spark)).get("x") != NOW + 99 * DAY


def test_a_merge_that_ends_half_way(spark, tmp_path, monkeypatch):
    store = SeenGenerations(f"{tmp_path}/g", ratio=2)
    for k in range(2):
        store.add(entries(spark, [f"u{k}"], NOW + 9 * DAY), f"run{k}", NOW)
    switch, calls = SeenGenerations._switch, []

    def crash(self, spark, parts):
        calls.append(parts)
        if len(calls) == 2:
            raise RuntimeError("lost between write and switch")
        switch(self, spark, parts)

    monkeypatch.setattr(SeenGenerations, "_switch", crash)
    with pytest.raises(RuntimeError, match="lost"):
        store.add(entries(spark, ["u2"], NOW + 9 * DAY), "run2", NOW)
    assert set(seen(store.read(spark))) == {"u0", "u1", "u2"}
    left = len(os.listdir(f"{tmp_path}/g/parts"))
    # the run is repeated: it replaces its entries, the merge is done, what the crash left goes
    store.add(entries(spark, ["u2"], NOW + 9 * DAY), "run2", NOW)
    assert set(seen(store.read(spark))) == {"u0", "u1", "u2"}
    assert [p.generation for p in store.parts(spark)] == [1, 0] and left == 4
    with pytest.raises(ValueError):
        SeenGenerations("x", 1)
