"""Target files, their rules and edges."""

from __future__ import annotations

import itertools

from sightline.operators import targets as ops
from sightline.sources import targets

FILE = """dictionary = 3

[[markers]]
id = 0
size_m = 0.1

[[markers]]
id = 4
size_m = 0.1

[[markers]]
id = 7
size_m = 0.25
static = true

[[links]]
marker_a = 0
marker_b = 4
distance_m = 1.5

[[links]]
marker_a = 4
corner_a = 2
marker_b = 0
corner_b = 1
distance_m = 1.25
sigma_m = 0.004

[[mirror_pairs]]
marker_a = 0
anchor_corner_a = 1
marker_b = 4
anchor_corner_b = 0
thickness_m = 0.0
"""


def test_marker_sets_go_round(spark, tmp_path):
    first, second = str(tmp_path / "a.toml"), str(tmp_path / "b.toml")
    (tmp_path / "a.toml").write_text(FILE)
    found = targets.read_marker_set(spark, first)
    targets.write_marker_set(found, second)
    assert (tmp_path / "b.toml").read_text() == FILE
    again = targets.read_marker_set(spark, second)
    for name in ("markers", "links", "pairs"):
        assert getattr(again, name).collect() == getattr(found, name).collect()
    (tmp_path / "c.toml").write_text("dictionary = 1\n[[links]]\nmarker_a = 1\nmarker_b = 2\nseparation_m = 0.1\n")
    old = targets.read_marker_set(spark, str(tmp_path / "c.toml"))
    assert old.links.count() == 0 and old.markers.count() == 0 and ops.problems(old.markers, old.links, old.pairs, 50).count() == 0
    # Two faces of no thickness that a link joins as well break two rules.
    got = {(r["problem"], r["object_id"], r["other"]) for r in ops.problems(found.markers, found.links, found.pairs, 5).collect()}
    assert got == {("beyond the dictionary", 7, None), ("link and pair", 0, 4), ("link to a remapped face", 4, None)}


def test_every_rule(spark):
    markers = spark.createDataFrame([(0, 0.1, False), (1, 0.2, None), (2, 0.1, True), (3, 0.0, False), (3, None, False), (4, float("nan"), False), (None, 0.1, False)], targets.MARKERS)
    links = spark.createDataFrame([(0, 1, 1, 2, 0.5, None), (1, 2, 0, 1, 0.5, 0.1), (0, 0, 9, 0, 1.0, 0.0), (1, None, 1, None, 1.0, 0.1), (0, 0, 2, None, -1.0, 0.1), (1, 4, 0, 0, None, 0.1), (None, 0, 0, 0, 1.0, 0.1)], targets.LINKS)
    pairs = spark.createDataFrame([(0, 0, 1, 0, 0.1, None), (2, 0, 0, 0, -0.1, None), (5, None, 5, 7, 0.0, 0.1)], targets.PAIRS)
    got = {(r["problem"], r["object_id"], r["other"]) for r in ops.problems(markers, links, pairs, 50).collect()}
    assert got == {
        ("bad side", 3, None), ("bad side", 4, None), ("beyond the dictionary", None, None), ("repeated marker", 3, None),
        ("unknown marker in a link", 9, None), ("unknown marker in a link", None, None), ("link of one marker", 1, None), ("bad corner of a link", 0, 1), ("static and mobile link", 0, 2),
        ("bad sigma of a link", 0, 9), ("link with one corner", 0, 2), ("bad distance", 0, 2), ("bad distance", 0, 1), ("repeated link", 0, 1),
        ("unknown marker in a pair", 5, None), ("pair of one marker", 5, None), ("bad corner of a pair", 5, 5), ("static and mobile pair", 0, 2), ("pair without a corner", 5, 5), ("bad thickness", 0, 2),
        ("unequal sides of a pair", 0, 1), ("several mirror pairs", 0, None), ("link and pair", 0, 1), ("link and pair", 0, 2),
    }


def test_boards(spark, tmp_path):
    path = str(tmp_path / "board.toml")
    for board in ({"columns": 4, "rows": 5, "board_height": 11.0, "board_width": 8.5, **targets.BOARD_DEFAULTS, "inverted": True}, {"rows": 6, "columns": 9, "square_size_cm": 2.5}, {"rows": 6, "columns": 9, "square_size_cm": None}):
        targets.write_board(board, path)
        assert targets.read_board(path) == board
    boards = spark.createDataFrame([(0, 3, 4, "DICT_4X4"), (1, 1, 1, "DICT_5X5"), (2, 15, 20, "DICT_6X6"), (3, 50, 60, "DICT_4X4"), (4, 3, 3, "DICT_OTHER"), (5, 0, 3, None)], "board_id long, columns int, rows int, family string")
    got = {r["board_id"]: (r["n_markers"], r["dictionary"]) for r in ops.fitting_pools(boards, ops.pools(spark)).collect()}
    assert got == {0: (6, "DICT_4X4_50"), 1: (0, "DICT_5X5_50"), 2: (150, "DICT_6X6_250"), 3: (1500, None), 4: (4, None), 5: (0, None)}
    edges = {tuple(r) for r in ops.chessboard_edges(boards.filter("board_id < 2")).collect()}
    want = {(0, a, b) for a, b in itertools.combinations(range(12), 2) if (b == a + 1 and b % 3) or b == a + 3}
    assert edges == want
    corners = [(0, k, 0.1 * (k % 3), 0.1 * (k // 3)) for k in range(12)] + [(1, 0, None, float("nan")), (1, 1, None, float("nan"))]
    lines = {tuple(r) for r in ops.line_edges(spark.createDataFrame(corners + corners[:2], "board_id long, keypoint_id long, obj_loc_x double, obj_loc_y double")).collect()}
    assert lines == {(0, a, b) for a, b in itertools.combinations(range(12), 2) if a % 3 == b % 3 or a // 3 == b // 3}


def test_places_and_segments(spark, tmp_path):
    points = spark.createDataFrame([(0, 0, 1), (1, 2, 2), (8, 0, 3), (0, 9, 4), (None, 0, 5)], "object_id long, keypoint_id long, n int")
    markers = spark.createDataFrame([(0, 0.2, False), (1, 0.4, False)], targets.MARKERS)
    back = spark.createDataFrame([(1, 0.01)], "object_id long, thickness double")
    got = {r["n"]: (r["obj_loc_x"], r["obj_loc_y"], r["obj_loc_z"]) for r in ops.placed(points, markers, back).collect()}
    assert got == {1: (-0.1, 0.1, 0.0), 2: (0.2, -0.2, 0.01), 3: (None,) * 3, 4: (None,) * 3, 5: (None,) * 3}
    assert {tuple(r) for r in ops.unknown_markers(points, markers).collect()} == {(8, 1), (None, 1)}
    (tmp_path / "w.toml").write_text('[points]\nnose = 0\n[arm]\ncolor = "r"\npoints = ["shoulder", "elbow"]\n')
    assert [tuple(r) for r in targets.read_segments(spark, str(tmp_path / "w.toml")).collect()] == [("arm", "r", "shoulder", "elbow")]


def test_placing_joins_a_row_a_marker(spark):
    """Markers aren't multiplied by their corners before the join."""
    points = spark.createDataFrame([(7, k, 1) for k in (-1, 0, 3, 4, None)] + [(8, 0, 1), (9, 1, 1)], "object_id long, keypoint_id long, n long")
    markers = spark.createDataFrame([(7, 2.0, False), (9, None, False)], "object_id long, side double, static boolean")
    found = ops.placed(points, markers)
    assert "Generate" not in found._jdf.queryExecution().toString()
    none = (None, None, None)
    want = {(7, -1): none, (7, 0): (-1.0, 1.0, 0.0), (7, 3): (-1.0, -1.0, 0.0), (7, 4): none, (7, None): none, (8, 0): none, (9, 1): (None, None, 0.0)}
    assert {(r["object_id"], r["keypoint_id"]): (r["obj_loc_x"], r["obj_loc_y"], r["obj_loc_z"]) for r in found.collect()} == want
