"""Steps whose cost has to grow with the rows, not with their keys; rows that a batch may not hold all of."""

import random

import pandas as pd

from ledgerlake.operators import alignment
from ledgerlake.sources import dom, shared
from ledgerlake.streaming import jobs


class Store:
    """A state store in memory that counts its calls."""

    def __init__(self):
        self.calls, self.maps, self.values, self.timers = 0, {}, {}, set()

    def getMapState(self, name, *_):
        store, kept = self, self.maps.setdefault(name, {})

        class Map:
            def keys(self):
                store.calls += 1
                return iter(list(kept))

            def getValue(self, at):
                store.calls += 1
                return kept[at]

            def containsKey(self, at):
                store.calls += 1
                return at in kept

            def updateValue(self, at, value):
                store.calls += 1
                kept[at] = value

            def removeKey(self, at):
                store.calls += 1
                del kept[at]

        return Map()

    def getValueState(self, name, *_):
        store, kept = self, self.values

        class Value:
            def exists(self):
                store.calls += 1
                return name in kept

            def get(self):
                store.calls += 1
                return kept[name]

            def update(self, value):
                store.calls += 1
                kept[name] = value

        return Value()

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


class Time:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_rows_of_many_keys_take_few_calls_of_the_state_store():
    """6,000 events of 300 keys over a month, in three shuffled parts: each key's are judged in order, a call for 20 rows at most."""
    r, hour = random.Random(3), 3600
    rows = sorted((r.randrange(30 * 24 * hour) * 1_000_000, r.randrange(300), i) for i in range(6000))
    store, rule = Store(), jobs.TokenBucket(1 / 3600, 2.0, False)
    judge = jobs._InOrder(rule, "user_id", ["event_id"], ["user_id", "event_id", "passed"], hour)
    judge.init(store)
    got, watermark = [], 0
    for part in range(4):
        new = [x for x in rows if x[0] * 3 // (30 * 24 * hour * 1_000_000) == part]
        r.shuffle(new)
        if new:
            list(judge.handleInputRows((0,), iter([pd.DataFrame(new[i : i + 700], columns=["micros", "user_id", "event_id"]) for i in range(0, len(new), 700)]), Time(watermark)))
        watermark = (part + 1) * 10 * 24 * hour * 1000 - 5_000_000 if part < 3 else 40 * 24 * hour * 1000
        for at in sorted(t for t in store.timers if t <= watermark):
            for out in judge.handleExpiredTimer((0,), Time(watermark), None):
                got += [tuple(x) for x in out.itertuples(index=False)]
            store.timers.discard(at)
    want, states = [], {}
    for micros, key, i in rows:
        states[key], found = rule.step(states.get(key, rule.fresh()), micros, (i,))
        want += [(key, *f) for f in found]
    assert sorted(got) == sorted(want) and not store.maps["held"] and not store.timers
    assert store.calls < len(rows) / 20


def test_speech_of_a_long_recording_is_one_sweep(spark):
    """20,000 turns a side: the sweep looks at the turns that are open, not at all turns for each slice."""
    turns = [("r", "ref", f"s{i % 3}", 10.0 * i, 10.0 * i + 6) for i in range(20_000)] + [("r", "hyp", f"t{i % 3}", 10.0 * i + 2, 10.0 * i + 9) for i in range(20_000)]
    looked = [0]

    class Counted(float):
        def __lt__(self, other):
            looked[0] += 1
            return float(self) < float(other)

    assert alignment.speech_errors([(side, who, Counted(lo), Counted(hi)) for _, side, who, lo, hi in turns]) == (40_000.0, 60_000.0, 0.0, 120_000.0)
    assert looked[0] < 100 * len(turns)
    odd = [("q", "ref", "a", 0.0, 4.0), ("q", "ref", "a", 2.0, 6.0), ("q", "ref", "b", 5.0, 5.0), ("q", "hyp", "x", 1.0, 3.0), ("q", "hyp", "y", 3.0, 7.0), ("q", "hyp", "y", 9.0, 8.0)]
    found = alignment.diarisation_errors(spark.createDataFrame(odd + turns[:8], "recording string, side string, speaker string, lo double, hi double"))
    assert {r.recording: tuple(r)[1:] for r in found.collect()}["q"] == (1.0, 1.0, 2.0, 6.0)


def test_references_without_an_end_stay_text():
    """A heading cut within a reference, an unknown name, a query string; whole references are read."""
    nodes = dom.tree_of('<h1 id="a&copy=1">x &amp; y &lt;b&gt; &#65;&#x42; &notit; &amp</h1><p>R&D &copy 2020 &am</p>')
    assert [n[7] for n in nodes if n[7]] == ["x & y <b> AB &notit; &amp", "R&D &copy 2020 &am"] and nodes[0][5] == "a&copy=1"


def test_a_batch_of_pages_gives_frames_of_bounded_size():
    """The rows of many texts are made one frame after the other."""
    made = []
    rows = (made.append(i) or (i,) for i in range(3 * shared.FRAME))
    frames = shared.in_frames(rows, ["i"])
    first = next(frames)
    assert len(first) == shared.FRAME == len(made) and sum(map(len, frames)) == 2 * shared.FRAME
