import numpy as np
import pytest

from attestry.llm.lattice import LatticeParams, cells, decode_e8, near_vectors


def model(rows, cosine=0.95):
    """n_links and component of each (id, vector), by all pairs."""
    use = [i for i, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)]
    links = {i: set() for i in range(len(rows))}
    for a in use:
        for b in use:
            if a != b and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[i][1], float) / np.abs(rows[i][1]).max() for i in (a, b))
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                    links[a].add(b)
    out = []
    for i, (vec_id, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out.append((vec_id, len(links[i]), min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)))
    return out


def near(rng, v, cosine):
    r = rng.normal(size=v.shape)
    r -= r @ v * v
    return cosine * v + np.sqrt(1 - cosine ** 2) * r / np.linalg.norm(r)


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 8)) * 2
    p = decode_e8(x)
    doubled = np.rint(p * 2).astype(int)
    assert ((doubled % 2 == 0).all(axis=1) | (doubled % 2 == 1).all(axis=1)).all() and (p.sum(axis=1) % 2 == 0).all()
    roots = np.unique(decode_e8(rng.normal(size=(200_000, 8))), axis=0)
    roots = roots[np.isclose((roots ** 2).sum(axis=1), 2)]
    assert len(roots) == 240                            # E8 has 240 shortest vectors; no step to one brings a point nearer
    assert (((x[:, None] - p[:, None] - roots[None]) ** 2).sum(axis=2).min(axis=1) >= ((x - p) ** 2).sum(axis=1) - 1e-9).all()


def test_recall_at_the_threshold():
    rng, p = np.random.default_rng(2), LatticeParams()
    a = rng.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = np.stack([near(rng, v, 0.95) for v in a])
    hit = np.zeros(len(a), bool)
    for t in range(p.tables):
        x, y = cells(a, t, p), cells(b, t, p)
        hit |= (x[:, :, None] == y[:, None, :]).any(axis=(1, 2))
    assert hit.mean() > 0.97


@pytest.mark.parametrize("tile", [2048, 8])
def test_odd_vectors(spark, tile):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    unit = base[0] / np.linalg.norm(base[0])
    rows += [(100 + i, near(rng, unit, 0.99).tolist()) for i in range(30)]              # a crowd of different vectors
    rows += [(200 + i, (unit * (i + 1)).tolist()) for i in range(3)] + [(300, rows[5][1])] * 3 + [(None, rows[5][1]), (None, rows[6][1])]
    rows += [(400, None), (401, []), (402, [0.0] * 16), (403, [float("nan")] * 16), (404, [1.0, None]), (405, [float("inf"), 1.0]), (406, [1e300] * 16), (407, [-1e300] * 16),
             (408, [2e300] * 16), (409, [1.0] * 4), (410, [1.0] * 4)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cls int, component int").repartition(4)
    got = near_vectors(df, LatticeParams(tile=tile)).collect()
    key = lambda r: (str(r[0]), r[1], str(r[2]))
    assert sorted(map(key, got)) == sorted(map(key, model(rows)))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert near_vectors(df.limit(0)).collect() == []
