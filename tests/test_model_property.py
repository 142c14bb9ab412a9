"""Random trees of tables against a plain pandas full outer join: pruning, NULL rows, distinct elimination."""

import numpy as np
import pandas as pd
import pytest
from test_cube import rows

from starloom import Hypercube


def random_model(rng):
    """Tables t0.. linked to an earlier one by a column (some share one), with dangling values, NULLs and repeats."""
    n = int(rng.integers(2, 5))
    cols = {f"t{i}": {} for i in range(n)}
    links = []
    for i in range(1, n):
        j = int(rng.integers(0, i))
        old = [k for k in links if f"t{j}" in k[1]]
        if old and rng.random() < 0.3:
            old[0][1].append(f"t{i}")
        else:
            links.append((f"k{i}", [f"t{j}", f"t{i}"]))
    tables = {}
    for t in cols:
        size = int(rng.integers(1, 5))
        frame = {f"v_{t}": rng.integers(0, 3, size)}
        for k, members in links:
            if t in members:
                unique = rng.random() < 0.4
                values = rng.permutation(6)[:size] if unique else rng.integers(0, 4, size)
                frame[k] = [None if rng.random() < 0.1 else int(v) for v in values]
        tables[t] = pd.DataFrame({c: pd.array(v, dtype="Int64") for c, v in frame.items()})
    return tables, links


def oracle(tables, links):
    """The full outer join over surrogate keys, NULL being a key value like others."""
    frames = {}
    for t, df in tables.items():
        df = df.copy()
        df[f"_i_{t}"] = range(len(df))
        for k, members in links:
            if t in members:
                df[f"s_{k}"] = [-1 if pd.isna(v) else int(v) for v in df[k]]
                df = df.drop(columns=k)
        frames[t] = df
    done, out = {"t0"}, frames["t0"]
    while len(done) < len(tables):
        for k, members in links:
            for t in members:
                if t not in done and done & set(members):
                    right = frames[t].rename(columns={f"s_{k}": "_r"})
                    left = out[out[f"s_{k}"].notna()]
                    rest = out[out[f"s_{k}"].isna()]
                    merged = left.merge(right, how="outer", left_on=f"s_{k}", right_on="_r")
                    merged[f"s_{k}"] = merged[f"s_{k}"].fillna(merged["_r"])
                    out = pd.concat([merged.drop(columns="_r"), rest], ignore_index=True)
                    done.add(t)
    for k, _ in links:
        out[k] = [None if pd.isna(v) or v == -1 else int(v) for v in out[f"s_{k}"]]
    return out


def plain(values):
    return tuple(None if v is None or pd.isna(v) else int(v) for v in values)


@pytest.mark.parametrize("seed", range(10))
def test_random_trees(spark, seed):
    rng = np.random.default_rng(seed)
    tables, links = random_model(rng)
    cube = Hypercube({t: spark.createDataFrame(df.astype(object).where(df.notna(), None), ", ".join(f"{c} long" for c in df.columns)) for t, df in tables.items()}, spark=spark, statistics="declared" if seed % 3 == 2 else "auto")
    if seed % 3 == 1:
        cube.analyze()
    full = oracle(tables, links)
    names = [f"v_{t}" for t in tables] + [k for k, _ in links]
    dims = list(rng.permutation(names)[: int(rng.integers(1, 3))])
    assert rows(cube.dimensions(dims)) == {plain(r) for r in full[dims].drop_duplicates().itertuples(index=False)}, (tables, dims)
    fact = str(rng.choice(list(tables)))
    dim = str(rng.choice([n for n in names if n != f"v_{fact}"]))
    for how in ("sum", "count", "size"):
        cube.define_metric(how, f"[v_{fact}]", how)
    grain = full[[dim, f"v_{fact}", f"_i_{fact}"]].drop_duplicates()
    want = {}
    for _, r in grain.iterrows():
        key = plain([r[dim]])
        s, c, n = want.get(key, (0, 0, 0))
        v = r[f"v_{fact}"]
        want[key] = (s, c, n + 1) if pd.isna(v) else (s + int(v), c + 1, n + 1)
    assert rows(cube.query(options={"dimensions": [dim], "metrics": ["sum", "count", "size"]})) == {k + v for k, v in want.items()}, (tables, dim, fact)
    assert {r[:3] for r in rows(cube.query(options={"dimensions": [dim], "metrics": ["sum", "count"]}))} == {k + v[:2] for k, v in want.items()}
