import pytest

from trialloom.functions.alignment import AlignmentError, EventRef, parse
from trialloom.operators import binning, windows


def test_parse_forms():
    a = parse("Target-100:Go+100 @ Go")
    assert (a.start, a.stop, a.zero) == (EventRef("Target", "1", -100.0), EventRef("Go", "1", 100.0), EventRef("Go"))
    assert parse("@Go").start.name == "TrialStart" and parse("@Go").zero.name == "Go"
    assert parse("Go").start == parse("Go").stop == parse("Go").zero == EventRef("Go")
    assert parse("-100:Go").start == EventRef("Go", "1", -100.0)
    assert parse("Go:+100").stop == EventRef("Go", "1", 100.0)
    b = parse("500:800")
    assert b.start == EventRef("TrialStart", "1", 500.0) and b.stop == EventRef("TrialStart", "1", 800.0)
    c = parse("A(2):B(end) @ A, before C, after D, exclude E, mark F as f, pad [10:20]")
    assert c.stop.index == "end" and c.truncate_after[0].index == "1" and c.truncate_before[0].index == "end"
    assert c.invalidate[0].index == ":" and c.mark[0].label == "f" and (c.pre, c.post) == (10.0, 20.0)


@pytest.mark.parametrize("text", ["", "A:B:C", "A, foo B", "A(x)", "A@B@C", "A, pad 3"])
def test_parse_errors(text):
    with pytest.raises(AlignmentError):
        parse(text)


@pytest.fixture(scope="module")
def tables(spark):
    trials = spark.createDataFrame([(i, 0.0, 1000.0) for i in range(1, 6)], "trial_id long, t_start double, t_end double")
    events = [(1, "go", 1, 500.0), (1, "go", 2, 700.0), (1, "stop", 1, 800.0), (2, "go", 1, 50.0), (3, "stop", 1, 10.0), (4, "go", 1, 900.4), (4, "stop", 1, 100.0), (5, "go", 1, 300.0), (5, "err", 1, 320.0), (5, "err", 2, 5.0)]
    return trials, spark.createDataFrame(events, "trial_id long, event string, occ int, t double")


def rows(df):
    return {r.trial_id: r for r in df.collect()}


def test_truncate_invalidate_ignore(tables):
    got = rows(windows.align(*tables, "go-100:go+200"))
    assert (got[1].start, got[1].stop, got[1].zero) == (400, 700, 500)
    assert (got[2].start, got[2].stop) == (0, 250)
    assert not got[3].valid and got[3].cause == "missing zero event" and got[3].start is None
    assert got[4].stop == 1000 and abs(got[4].start - 800.4) < 1e-9
    assert rows(windows.align(*tables, "go-100:go+200", outside="invalidate"))[2].cause == "outside trial"
    assert rows(windows.align(*tables, "go-100:go+200", outside="ignore"))[2].start == -50


def test_padding_moves_inward(tables):
    got = rows(windows.align(*tables, "go-100:go+200, pad [30:40]"))
    assert (got[1].start_pad, got[1].start, got[1].stop, got[1].stop_pad) == (370, 400, 700, 740)
    assert (got[2].start_pad, got[2].start) == (0, 30)


def test_clamps_and_causes(tables):
    got = rows(windows.align(*tables, "go:go+400, truncateAfter stop, invalidate err"))
    assert got[1].stop == 800 and got[5].cause == "overlaps err" and got[2].valid
    assert rows(windows.align(*tables, "go:stop"))[4].cause == "start after stop"
    assert rows(windows.align(*tables, "go:stop"))[2].cause == "missing stop event"
    assert rows(windows.align(*tables, "go:go+20", min_duration=30))[1].cause == "too short"
    assert rows(windows.align(*tables, "go(2):go(end)"))[1].start == 700
    assert rows(windows.align(*tables, "go(end-1)"))[1].start == 500


def test_bins_and_edges(spark, tables):
    trials, events = tables
    pts = spark.createDataFrame([(1, 400.0), (1, 499.9), (1, 500.0), (1, 600.0), (1, 399.9), (1, 700.0)], "trial_id long, t double")
    al = windows.align(trials, events, "go-100:go+200").where("trial_id = 1")
    got = {r.bin: r.n for r in binning.binned_counts(pts, al, 100.0, "acausal").collect()}
    assert got == {-1: 2, 0: 1, 1: 1, 2: 1}
    padded = windows.align(trials, events, "go-100:go+200, pad 100:0").where("trial_id = 1")
    got = {r.bin: r.n for r in binning.binned_counts(pts, padded, 100.0, "causal").collect()}
    assert got == {-1: 1, 0: 2, 1: 1, 2: 2}  # the last bin is closed on the right
    rate = {r.bin: r.rate for r in binning.smooth(binning.binned_counts(pts, al, 100.0, "acausal"), [(0, 0.5), (1, 0.5)], 100.0).collect()}
    assert rate == {0: 15.0, 1: 10.0, 2: 10.0}
    r = rows(binning.mean_rate(pts, windows.align(trials, events, "go-100:go+200")))
    assert r[1].n == 5 and abs(r[1].rate - 5 / 300 * 1000) < 1e-9 and r[2].n == 0 and r[3].n is None
    single = rows(binning.mean_rate(pts, windows.align(trials, events, "go")))
    assert single[1].rate is None


def test_align_all_and_marks(tables):
    trials, events = tables
    got = windows.align_all(trials, events, ["go", "stop"])
    assert got.count() == 10 and {r.align_id for r in got.collect()} == {0, 1}
    m = windows.marks(trials, events, windows.align(trials, events, "go-100:go+300"), "stop").collect()
    assert [(r.trial_id, r.t) for r in m] == [(1, 300.0)]
