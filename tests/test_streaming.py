"""Streams in several steps against what they should have seen."""

import random
from datetime import datetime, timedelta

import pytest

from ledgerlake.streaming import jobs

T0 = datetime(2024, 1, 1)


def fed(spark, tmp_path, schema, batches, job, name):
    """Run the job once for each batch on one checkpoint: state has to last between runs."""
    src, out, progress = (str(tmp_path / f"{name}-{x}") for x in ("in", "out", "progress"))
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        got = jobs.run_to(job(jobs.source(spark, src)), out, progress)
    return sorted(tuple(r) for r in got.collect())


def marked(batches, ts_at, key_at):
    """The batches, and an end mark: a row of another key, a day later."""
    last = max(r[ts_at] for b in batches for r in b)
    end = [last + timedelta(days=1) if i == ts_at else "end" if i == key_at else x for i, x in enumerate(batches[0][0])]
    return [*batches, [tuple(end)]]


FRAMES = "stream string, ts timestamp, seq long, checksum string"


def frames(*rows):
    """Frames as they were received, a second after another."""
    return [("s", T0 + timedelta(seconds=i), n, c) for i, (n, c) in enumerate(rows)]


def test_reorder(spark, tmp_path):
    sent = frames((2, "b"), (1, "a"), (5, "e"), (2, "b"), (3, "c"), (5, "x"), (4, "d"))
    got = fed(spark, tmp_path, FRAMES, marked([sent[:3], sent[3:6], sent[6:]], 1, 0), lambda s: jobs.reordered(s, "stream", "seq", "checksum"), "reorder")
    assert got == sorted([("s", n, "released") for n in range(1, 6)] + [("s", 2, "duplicate"), ("s", 5, "conflict")])


def test_reorder_gives_up_a_gap(spark, tmp_path):
    got = fed(spark, tmp_path, FRAMES, marked([frames(*[(n, "x") for n in (2, 3, 4)])], 1, 0), lambda s: jobs.reordered(s, "stream", "seq", "checksum", 2), "gap")
    assert ("s", 1, "gap") in got and ("s", 4, "released") in got


EVENTS = "event_id long, user_id string, ts timestamp, kind string"


def rules():
    return {
        "rate": lambda s: jobs.rate_limited(s, "user_id", "event_id", 0.5, 2.0),
        "lock": lambda s: jobs.lockouts(s, "user_id", "event_id", 3, 300, 900),
        "repeat": lambda s: jobs.first_of_repeats(s, "user_id", "event_id", "kind", 60),
        "reorder": lambda s: jobs.reordered(s, "user_id", "event_id", "kind", 3),
    }


def test_rate_limit_and_lockout_and_repeats(spark, tmp_path):
    events = [(i, "u", T0 + timedelta(seconds=i), "a" if i < 3 else "b") for i in range(6)]
    batches = marked([events[3:], events[:3]], 2, 1)
    limited = fed(spark, tmp_path, EVENTS, batches, rules()["rate"], "rate")
    assert [p for _, _, p in limited] == [True, True, True, False, True, False]
    locked = fed(spark, tmp_path, EVENTS, batches, rules()["lock"], "lock")
    assert [x for _, _, x in locked] == [False, False, True, True, True, True]
    fresh = fed(spark, tmp_path, EVENTS, batches, rules()["repeat"], "repeat")
    assert [i for _, i in fresh] == [0, 3]


@pytest.mark.parametrize("name", sorted(rules()))
def test_order_and_number_of_triggers_change_nothing(spark, tmp_path, name):
    """Rows of three keys over two hours, some without a kind or at the same instant: as one file, and shuffled into three."""
    r = random.Random(5)
    events = [(i // 2 if name == "reorder" else i, r.choice("uvw"), T0 + timedelta(seconds=30 * (i // 2)), r.choice(["a", "b", None])) for i in range(240)]
    job = rules()[name]
    late = [events[:90], events[90:180], events[180:]]  # within the hour that rows may be late
    for part in late:
        r.shuffle(part)
    mixed = [late[0][:60] + late[1][:20], late[0][60:] + late[1][20:70] + late[2][:10], late[1][70:] + late[2][10:]]
    one, three = (fed(spark, tmp_path, EVENTS, marked(b, 2, 1), job, name + n) for n, b in (("1", [events]), ("3", mixed)))
    assert one == three and len(one) >= 240 * (name != "repeat")


def test_rows_wait_for_the_watermark(spark, tmp_path):
    """Without an end mark the rows of the last hour are held; a slice at a time comes out."""
    events = [(i, "u", T0 + timedelta(minutes=i), "a") for i in range(300)]
    got = fed(spark, tmp_path, EVENTS, [events[:150], events[150:]], rules()["rate"], "wait")
    assert [i for _, i, _ in got] == list(range(239))


def test_sessions_and_leases(spark, tmp_path):
    schema = "user_id string, ts timestamp"
    batches = [[("u", T0), ("u", T0 + timedelta(minutes=5))], [("v", T0 + timedelta(hours=9))], [("v", T0 + timedelta(hours=20))]]
    got = fed(spark, tmp_path, schema, batches, lambda s: jobs.sessions(s, "10 minutes", ["user_id"]), "sessions")
    assert ("u", 2) in [(r[1], r[2]) for r in got]
    expired = fed(spark, tmp_path, schema, batches, lambda s: jobs.leases(s, "user_id", "ts", 3600), "lease")
    assert ("u", 2) in expired


@pytest.mark.parametrize("width", ["5 minutes", "1 hour"])
def test_tumbling(spark, tmp_path, width):
    rows = [("u", T0 + timedelta(minutes=i)) for i in range(10)] + [("u", T0 + timedelta(days=1))]
    got = fed(spark, tmp_path, "user_id string, ts timestamp", [rows, [("u", T0 + timedelta(days=2))]], lambda s: jobs.tumbling_counts(s, width, ["user_id"]), "tumble" + width[0])
    assert sum(r[2] for r in got) >= 10


def test_a_key_of_more_rows_than_a_batch(spark, tmp_path):
    """25,000 rows of one key in reverse order come in three Arrow batches, and are judged as one."""
    n = 25_000
    sent = [("s", T0 + timedelta(seconds=i), i, str(i)) for i in range(n, 0, -1)]
    got = fed(spark, tmp_path, FRAMES, marked([sent], 1, 0), lambda s: jobs.reordered(s, "stream", "seq", "checksum"), "many")
    assert got == [("s", i, "released") for i in range(1, n + 1)]
    events = marked([[(i, "u", T0 + timedelta(seconds=i), "a" if i <= n // 2 else "b") for i in range(n, 0, -1)]], 2, 1)
    assert fed(spark, tmp_path, EVENTS, events, lambda s: jobs.first_of_repeats(s, "user_id", "event_id", "kind", 60), "many-repeats") == [("u", 1), ("u", n // 2 + 1)]
    limited = fed(spark, tmp_path, EVENTS, events, lambda s: jobs.rate_limited(s, "user_id", "event_id", 0.5, 2.0), "many-rate")
    assert [i for _, i, p in limited if p][:4] == [1, 2, 3, 5] and sum(p for *_, p in limited) == pytest.approx(n / 2, abs=3)
    locked = fed(spark, tmp_path, EVENTS, events, lambda s: jobs.lockouts(s, "user_id", "event_id", 3, 300, 900), "many-lock")
    open_ids = [i for _, i, x in locked if not x]
    assert open_ids[:4] == [1, 2, 903, 904] and len(open_ids) == 2 * -(-n // 902)
