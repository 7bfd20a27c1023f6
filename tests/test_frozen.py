"""Frozen pixels over all frames of a clip."""

from framegrid.operators import quality as Q


def test_frozen_over_all_frames(spark):
    def at(x, frame):
        a, r, g, b = 255, 10, 20, 30
        if x == 2 and frame == 3:
            r = 11
        if x == 3 and frame == 2:
            a = 0
        if x == 4 and frame == 3:
            b = 31
        return ("c", frame, 1, x, a, r, g, b)

    px = spark.createDataFrame([at(x, f) for x in range(5) for f in range(4)], "clip_id string, frame_idx int, y int, x int, a int, r int, g int, b int")
    got = Q.frozen(px, ("r", "g", "b")).first()
    assert (got.n, got.x0, got.y0, got.x1, got.y1) == (2, 0, 1, 1, 1)
