"""Boxes against the loop over the whole overlap matrix."""

import random

from ledgerloom.operators import boxes

SCHEMA = "doc long, id long, x1 double, y1 double, x2 double, y2 double, p string, t string, a string, px string"


def iou(a, b):
    wide, high = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(0, wide) * max(0, high)
    return both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both) if both else 0.0


def greedy(first, second, least):
    left = {(i, j): iou(a, b) for i, a in first.items() for j, b in second.items()}
    out = []
    while left:
        (i, j), most = min(left.items(), key=lambda x: (-x[1], x[0]))
        if most < least:
            break
        out.append((i, j, round(most, 9)))
        left = {k: v for k, v in left.items() if k[0] != i and k[1] != j}
    return sorted(out)


def test_like_a_loop(spark):
    rng = random.Random(2)

    def box(scale):
        x, y = rng.uniform(-50, 50), rng.uniform(-50, 50)
        return (x, y, x + scale * rng.uniform(0.3, 3), y + scale * rng.uniform(0.3, 3))

    docs = {}
    for d in range(30):
        first = {i: box(rng.choice([0.01, 1, 7, 60, 4000])) for i in range(rng.randrange(0, 14))}
        second = {}
        for b in list(first.values()) * 3:
            size = b[2] - b[0]
            if rng.random() < 0.8:
                second[len(second)] = tuple(v + size * rng.uniform(-0.2, 0.2) for v in b)
        if d % 3 == 0:  # integer boxes: many equal overlaps
            first = {i: (rng.randrange(3), rng.randrange(3), rng.randrange(4, 6), rng.randrange(4, 6)) for i in range(8)}
            second = {i: (rng.randrange(3), rng.randrange(3), rng.randrange(4, 6), rng.randrange(4, 6)) for i in range(8)}
        docs[d] = ({i: b for i, b in first.items() if b[2] > b[0] and b[3] > b[1]}, {i: b for i, b in second.items() if b[2] > b[0] and b[3] > b[1]})
    rows = lambda k: [(d, i, *map(float, b), "p", "t", "a", "px") for d, two in docs.items() for i, b in two[k].items()]
    odd = [(0, 900, None, 0.0, 1.0, 1.0, "", "", "", ""), (0, 901, 1.0, 1.0, 1.0, 5.0, "", "", "", ""), (0, 902, float("nan"), 0.0, 1.0, 1.0, "", "", "", ""), (0, 903, 0.0, 0.0, float("inf"), 1.0, "", "", "", ""), (None, 904, 0.0, 0.0, 1.0, 1.0, "", "", "", "")]
    first, second = spark.createDataFrame(rows(0) + odd, SCHEMA), spark.createDataFrame(rows(1) + odd, SCHEMA)
    for least in (0.5, 0.7):
        got = {}
        for r in boxes.matched(first, second, least).collect():
            got.setdefault(r.doc, []).append((r.p, r.t, round(r.iou, 9)))
        assert {d: sorted(x) for d, x in got.items()} == {d: m for d, (a, b) in docs.items() if (m := greedy(a, b, least))}
        seen = [(r.doc, r.p, r.t) for r in boxes.candidates(first, second, least).collect()]
        assert len(seen) == len(set(seen)) == sum(iou(a, b) >= least for one, two in docs.values() for a in one.values() for b in two.values())
    assert boxes.matched(first.where("doc < 0"), second).count() == 0


def test_both_ways_agree(spark):
    rng = random.Random(4)
    box = lambda: (float(rng.randrange(4)), float(rng.randrange(4)), float(rng.randrange(5, 8)), float(rng.randrange(5, 8)))
    rows = [[(d, i, *box(), "p", "t", "a", "px") for d in range(12) for i in range(1 + 2 * d)] for _ in range(2)]
    first, second = (spark.createDataFrame(r, SCHEMA) for r in rows)
    got = [sorted(map(tuple, boxes.matched(first, second, 0.5, limit).collect())) for limit in (10**6, 100, 0)]  # rows, both, rounds
    assert got[0] == got[1] == got[2] and len(got[0]) > 60


def test_few_boxes_are_not_copied_over_cells(spark):
    box = lambda n: spark.range(n).selectExpr("id div 4 doc", "id", "0D x1", "0D y1", "1D x2", "1D y2", "'' p", "'' t", "'' a", "'' px")
    plan = boxes.matched(box(40), box(40))._jdf.queryExecution().optimizedPlan().toString()
    assert "gx" not in plan and plan.count("Generate") == 1  # the matching itself
