"""Product codes against plain rounds of Lloyd over Python integers."""

import hashlib
import math

import numpy as np
import pytest

from strikehaz.llm import vector_codes as vc

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, vector string, error double, key int, n int"
SMALL = vc.Settings(parts=2, entries=3, rounds=3, scale=4)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", "y", 1.0, 2, 3) for i, v, y in rows], SCHEMA).repartition(3)


def plain(rows, s):
    """(rows of the result, codebooks) by full scans."""
    held = [(i, [math.floor(s.scale * float(np.float32(x))) for x in v], y) for i, v, y in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    firsts = sorted((i, v) for i, v, _ in held if i is not None)[: s.entries]
    size = len(firsts[0][1])
    held = [(i, v + [0] * (-size % s.parts), y) for i, v, y in held if len(v) == size]
    width = -(-size // s.parts)

    def part(v, p):
        return v[p * width : (p + 1) * width]

    books = [[part(v + [0] * (-size % s.parts), p) for _, v in firsts if len(v) == size] for p in range(s.parts)]

    def assign():
        out = []
        for _, v, _ in held:
            out.append([min((sum((a - b) ** 2 for a, b in zip(part(v, p), e)), k) for k, e in enumerate(books[p])) for p in range(s.parts)])
        return out

    for _ in range(s.rounds):
        near = assign()
        for p in range(s.parts):
            for k in range(len(books[p])):
                mine = [part(v, p) for (_, v, _), c in zip(held, near) if c[p][1] == k]
                if mine:
                    books[p][k] = [sum(column) // len(mine) for column in zip(*mine)]
    near = assign()
    errors = [sum(d for d, _ in c) for c in near]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(
        (str(i), "".join(f"{k:02x}" for _, k in c), e, sum(f for f, (_, _, z) in zip(errors, held) if z == y), digest)
        for (i, _, y), c, e in zip(held, near, errors))


def got(df):
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


def test_codes_equal_plain_rounds(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), rng.normal(0, 2, 6).tolist(), int(i) % 4 if i % 5 else None) for i in rng.permutation(300)]
    rows += [(1000 + i, [0.25] * 6, 1) for i in range(150)]  # a hot vector, and ties
    assert got(vc.vector_codes(frame(spark, rows), SMALL)) == plain(rows, SMALL)


def test_edge_rows(spark):
    inf, nan = math.inf, math.nan
    rows = [
        (5, [1.0, 2.0, 3.0, 4.0, 5.0], 1), (5, [1.0, 2.0, 3.0, 4.0, 5.0], 1), (7, None, 1), (8, [1.0, None, 3.0, 4.0, 5.0], 2), (9, [nan, 0.0, 0.0, 0.0, 0.0], 2),
        (10, [inf, 0.0, 0.0, 0.0, 0.0], 2), (11, [0.0, 0.0], 2), (None, [-0.1, 0.1, 0.0, 9.0, 2.0], None), (12, [], 3), (13, [-1.0, 2.5, 3.0, 4.0, 5.0], None), (14, [0.3] * 5, 7),
    ]
    assert got(vc.vector_codes(frame(spark, rows), SMALL)) == plain(rows, SMALL)
    assert got(vc.vector_codes(frame(spark, rows[:1]), SMALL)) == plain(rows[:1], SMALL)
    assert vc.vector_codes(frame(spark, rows).where("false"), SMALL).count() == 0
    empty = vc.vector_codes(frame(spark, [(1, [], 1), (2, [], 1)]), SMALL).collect()
    assert [(r.code, r.error) for r in empty] == [("0000", 0)] * 2
    huge = vc.vector_codes(frame(spark, [(1, [3e38, -3e38, 0.0, 1.0], 1), (2, [0.0] * 4, 1)]), SMALL).collect()
    assert len(huge) == 2 and all(r.error >= 0 for r in huge)


@pytest.mark.parametrize("reach", [50, 1 << 27])
def test_active_entries_give_the_codes_of_a_full_scan_with_fewer_distances(reach):
    rng = np.random.default_rng(reach)
    parts = rng.integers(-reach, reach, (500, 4))
    book = parts[:40].copy()
    codes, dists = vc.nearest(parts, book, np.arange(40))
    for moving in (0, 1, 5, 40):
        after = book.copy()
        which = rng.choice(40, moving, replace=False)
        after[which] += rng.integers(-reach // 4, reach // 4, (moving, 4))
        after[which[: moving // 2]] = after[0]  # equal entries: ties go to the lower index
        c, d, n = vc.reassigned(parts, codes, dists, after, (after != book).any(1))
        full = ((parts[:, None, :] - after[None]) ** 2).sum(2)
        assert (c == full.argmin(1)).all() and (d == full.min(1)).all()
        assert n <= 500 * 40 and (n < 500 * 40 or moving == 40)


def test_later_rounds_scan_less(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 10, (12, 4))
    rows = [(i, (centres[i % 12] + rng.normal(0, 0.1, 4)).tolist(), 0) for i in range(400)]
    state, books = vc.compressed(frame(spark, rows), vc.Settings(parts=2, entries=12, rounds=6, scale=100))
    assert state.groupBy().sum("scanned").first()[0] < 400 * 2 * 12 and books.shape == (2, 12, 2)


def test_rare_and_hot_labels_meet_their_sums(spark):
    rows = spark.range(5000).selectExpr("id AS vec_id", "IF(id < 3000, 1, IF(id < 3100, NULL, id)) AS label", "id AS error")
    out = {r.vec_id: r.label_error for r in vc._with_label_sums(rows).collect()}
    assert len(out) == 5000 and out[0] == sum(range(3000)) and out[3050] == sum(range(3000, 3100)) and out[4000] == 4000
