"""Cubes of conditions: wildcards, lists, occupied combinations, and cubes brought together."""

import pytest

from trialloom.operators import cubes
from trialloom.operators.cubes import ANY, Axis, Cube


@pytest.fixture(scope="module")
def trials(spark):
    rows = [(1, True, "None", "Up"), (2, True, "Left", "Up"), (3, False, "Left", "Down"), (4, True, "Right", "Down"), (5, True, "None", "Down"), (6, True, None, "Up"), (7, True, "Left", None)]
    return spark.createDataFrame(rows, "trial_id int, success boolean, perturb string, target string")


def held(cube, trials):
    out = {}
    for r in cube.members(trials).collect():
        out.setdefault(r.cond, set()).add(r.trial_id)
    return out


def test_members(trials):
    c = Cube().by("target", ["Up", "Down"]).by("perturb", [["Left", "Right"], None, ANY])
    # the first axis runs fastest; None in a list of cells is anything
    assert held(c, trials) == {0: {2}, 1: {3, 4}, 2: {1, 2, 6}, 3: {3, 4, 5}, 4: {1, 2, 6}, 5: {3, 4, 5}}
    assert held(Cube().by("perturb", [[None, "Left"]]), trials) == {0: {2, 3, 6, 7}}
    assert held(Cube().filtered(success=True).by("perturb", ["Left"]), trials) == {0: {2, 7}}
    assert held(Cube(), trials) == {0: {1, 2, 3, 4, 5, 6, 7}}


def test_axes_of_several_attributes(trials):
    c = Cube().by(["perturb", "target"], [{"perturb": "Left", "target": "Up"}, {"target": "Down"}])
    assert held(c, trials) == {0: {2}, 1: {3, 4, 5}}
    assert c.conditions() == [{"perturb": ("Left",), "target": ("Up",)}, {"perturb": None, "target": ("Down",)}]


def test_product(trials):
    a, b = Cube().filtered(success=True).by("target", ["Up", "Down"]), Cube().filtered(success=[True, False]).by("perturb", ["Left", "Right"])
    assert held(a * b, trials) == {0: {2}, 3: {4}}
    assert held(a * b, trials) == held(Cube().filtered(success=True).by("target", ["Up", "Down"]).by("perturb", ["Left", "Right"]), trials)
    with pytest.raises(ValueError):
        a * a


def test_occupied_and_frozen(trials):
    c = Cube().by_values(trials, "perturb", "target")
    assert len(c.axes[0].cells) == 7
    full = Cube().by_values(trials, "perturb", "target", occupied=False)
    assert len(full.axes[0].cells) == 12 and len(full.occupied(trials)) == 7
    less = trials.where("trial_id > 3")
    assert len(c.occupied(less)) == 4 and len(c.conditions()) == 7  # the cube stays as it was
    assert Cube().filtered(success=False).by_values(trials, "perturb").conditions() == [{"perturb": ("Left",)}]


def test_expand_to_match(trials):
    t = Cube().filtered(success=True, perturb="None", target=["Up", "Down"]).by("target", ["Up", "Down"])
    p = Cube().filtered(success=True).by("perturb", ["Left", "Right"]).by("target", ["Up", "Down"])
    a, b = cubes.expand_to_match([t, p])
    assert [x.attributes for x in a.axes] == [x.attributes for x in b.axes] == [("target",), ("perturb",)]
    # what the first cube only filtered by is the one value of its new axis
    assert a.conditions() == [{"perturb": ("None",), "target": ("Up",)}, {"perturb": ("None",), "target": ("Down",)}]
    assert held(a, trials) == held(t, trials)
    assert sorted(map(sorted, held(b, trials).values())) == sorted(map(sorted, held(p, trials).values()))
    wide, _ = cubes.expand_to_match([Cube().by("target", ["Up"]), p])
    assert wide.conditions() == [{"perturb": None, "target": ("Up",)}]
    assert cubes.matches(wide, b) == [(0, 0), (0, 2)]
    assert cubes.matches(a, b) == []


def test_attributes_join_an_axis_or_fail():
    both = Cube().by(["x", "y"], [{"x": 1, "y": 2}])
    one = Cube().by("x", [1, 3])
    a, b = cubes.expand_to_match([one, both])
    assert a.axes[0] == Axis(("x", "y"), (((1,), None), ((3,), None))) and b.axes[0].attributes == ("x", "y")
    assert cubes.matches(a, b) == [(0, 0)]
    with pytest.raises(ValueError, match="several axes"):
        cubes.expand_to_match([Cube().by("x", [1]).by("y", [2]), both])
    with pytest.raises(ValueError, match="several axes"):
        cubes.expand_to_match([both, Cube().by("x", [1]).by("y", [2])])


def test_matched_difference(spark):
    a = Cube().by("g", ["u", "v"]).by("h", [1, 2])
    b = Cube().by("g", ["v", "u"])
    x = spark.createDataFrame([(0, 1.0, 3.0), (1, 2.0, 0.0), (2, 3.0, 0.0)], "cond int, mean double, sem double")
    y = spark.createDataFrame([(0, 10.0, 4.0), (1, 20.0, 4.0)], "cond int, mean double, sem double")
    got = sorted(map(tuple, cubes.matched_difference(a, x, b, y).collect()))
    assert got == [(0, 1, -19.0, 5.0), (1, 0, -8.0, 4.0), (2, 1, -17.0, 4.0)]
