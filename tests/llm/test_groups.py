"""Near-duplicates and neighbours against all pairs."""

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from tests.llm.cases import frame, of, plain_bytes, rows
from tickloom.llm import neighbours, simhash
from tickloom.llm.components import components, forest
from tickloom.llm.embeddings import near_vectors, visited
from tickloom.llm.neighbours import hadamard, nearest_neighbours
from tickloom.session import session_settings


def smallest(nodes, links):
    found = {node: node for node in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(found[a], found[b])
            changed |= found[a] != low or found[b] != low
            found[a] = found[b] = low
    return found


def plain_fingerprint(text, size=3):
    given = plain_bytes(text).lower().split()
    if not given:
        return 0
    shingles = [b" ".join(given[at : at + size]) for at in range(max(1, len(given) - size + 1))]
    hashes = [xxh64_intdigest(shingle, 42) for shingle in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def test_simhash(spark):
    marks = {(row[0], row[1]): plain_fingerprint(row[1]) for row in rows()}
    values = set(marks.values())
    links = [(a, b) for a in values for b in values if (a ^ b).bit_count() <= 2]
    found = smallest(values, links)
    ids = {}
    for (doc_id, _), mark in marks.items():
        if doc_id is not None:
            ids[found[mark]] = min(ids.get(found[mark], doc_id), doc_id)
    wanted = [(row[0], marks[row[0], row[1]], ids.get(found[marks[row[0], row[1]]])) for row in rows()]
    got = [(row[0], row[1] % 2**64, row[2]) for row in simhash.near_duplicates(frame(spark)).collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)


def test_simhash_of_no_rows(spark):
    assert of(simhash.near_duplicates(frame(spark, []))) == []


@pytest.mark.parametrize("flipped_from", [10**9, 2])
def test_close_pairs_both_ways(monkeypatch, flipped_from):
    monkeypatch.setattr(simhash, "FLIPPED_FROM", flipped_from)
    monkeypatch.setattr(simhash, "BLOCK", 7)
    random = np.random.default_rng(3)
    base = random.integers(0, 2**64, 12, dtype=np.uint64)
    values = [base] + [base ^ (np.uint64(1) << random.integers(0, 64, 12, dtype=np.uint64)) for _ in range(6)]
    values = np.unique(np.concatenate(values))
    wanted = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if int(values[i] ^ values[j]).bit_count() <= 2}
    pairs = list(simhash.close_pairs(values, 2, simhash.pivots()))
    assert {tuple(sorted(pair)) for a, b in pairs for pair in zip(a.tolist(), b.tolist(), strict=True)} == wanted


def test_components(spark):
    chain = [(at, at + 1) for at in range(100, 140)]
    links = [*chain, (5, 3), (3, 4), (7, 7), (200, 100), (1, 900), (900, 2), (3, 5)]
    nodes = {node for link in links for node in link} - {7}
    found = dict(of(components(spark.createDataFrame(links, "a long, b long"))))
    assert found == smallest(nodes, [link for link in links if 7 not in link])
    assert of(components(spark.createDataFrame([], "a long, b long"))) == []
    members, roots = forest(6, np.array([5, 3, 4]), np.array([4, 1, 3]))
    assert dict(zip(members.tolist(), roots.tolist(), strict=True)) == {3: 1, 4: 1, 5: 1}


def vectors(spark, number=240, dim=12):
    random = np.random.default_rng(1)
    base = random.normal(size=(number // 4, dim))
    made = np.concatenate([base, base * 2, base + random.normal(size=base.shape) * 0.1, random.normal(size=base.shape)]).astype("f4")
    given = [(at, row.tolist(), at % 3) for at, row in enumerate(made)]
    given += [(1000, given[0][1], 0), (1001, given[0][1], None), (1002, None, 0), (1003, [0.0] * dim, 0), (1050, [], 1)]
    given += [(1004, [float("nan")] * dim, 0), (1005, [float("inf")] * dim, 0), (1006, [None] * dim, 0), (1007, [1.0, 2.0], 0)]
    given += [given[3], (None, given[6][1], 0), (1100, given[0][1], 0)]
    table = spark.createDataFrame(given, "vec_id long, embedding array<float>, label int")
    return given, table.selectExpr("*", "'clash' as cell", "'clash' as share", "'clash' as dim", "'clash' as score", "1 as rank")


def fit(vector):
    return bool(vector) and None not in vector and np.isfinite(vector).all() and np.any(vector)


def cosine(a, b):
    a, b = np.array(a, float), np.array(b, float)
    return float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))


def test_near_vectors(spark):
    given, table = vectors(spark)
    usable = [at for at, row in enumerate(given) if fit(row[1]) and row[2] is not None and row[0] is not None]
    links = [
        (i, j) for i in usable for j in usable
        if i != j and given[i][2] == given[j][2] and len(given[i][1]) == len(given[j][1]) and cosine(given[i][1], given[j][1]) >= 0.98
    ]
    assert len(links) > 100
    component = smallest({row[0] for row in given if row[0] is not None}, [(given[i][0], given[j][0]) for i, j in links])
    wanted = []
    for at, (vec_id, _, _) in enumerate(given):
        number = sum(1 for i, _ in links if i == at)
        wanted.append((vec_id, number, component.get(vec_id), vec_id is None or component[vec_id] == vec_id))
    assert of(near_vectors(table)) == sorted(wanted, key=repr)
    assert of(near_vectors(table.where("false"))) == []


def test_every_link_meets_in_a_cell():
    random = np.random.default_rng(2)
    one = random.normal(size=(300, 8))
    one /= np.linalg.norm(one, axis=1)[:, None]
    two = one + random.normal(size=one.shape) * 0.08
    two /= np.linalg.norm(two, axis=1)[:, None]
    books = random.normal(size=(6, 4)) * 0.5, random.normal(size=(5, 4)) * 0.5
    near = np.linalg.norm(one - two, axis=1)
    for pair in range(300):
        cells = [set(visited(row[pair : pair + 1], books, near[pair] / 2)[1].tolist()) for row in (one, two)]
        assert cells[0] & cells[1]


def test_nearest_neighbours(spark):
    given, table = vectors(spark)
    queries = table.where("vec_id % 50 = 0")
    found = {}
    for row in nearest_neighbours(table, queries, tables=12, probes=24).collect():
        found.setdefault(row["query_id"], []).append((row["rank"], row["vec_id"], row["score"]))
    asked = {row[0]: row[1] for row in given if row[0] is not None and row[0] % 50 == 0 and fit(row[1])}
    assert set(found) == set(asked)
    hits = 0
    for query, vector in asked.items():
        others = {row[0]: row[1] for row in given if row[0] not in (None, query) and fit(row[1]) and len(row[1]) == len(vector)}
        best = sorted((-round(cosine(vector, other), 12), vec_id) for vec_id, other in others.items())[:5]
        got = sorted(found[query])
        assert [rank for rank, _, _ in got] == [1, 2, 3, 4, 5]
        assert all(abs(cosine(vector, others[vec_id]) - score) < 1e-12 for _, vec_id, score in got)
        assert [(-round(score, 12), vec_id) for _, vec_id, score in got] == sorted((-round(score, 12), vec_id) for _, vec_id, score in got)
        hits += len({vec_id for _, vec_id in best} & {vec_id for _, vec_id, _ in got})
    assert hits >= 0.9 * 5 * len(asked)
    assert of(nearest_neighbours(table.where("false"), queries)) == []


def test_recall_with_two_hashes(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BUCKET_ROWS", 9)
    made = np.random.default_rng(4).normal(size=(2000, 16)).astype("f4")
    assert round(np.log(2000 / 9) / np.log(32)) == 2
    table = spark.createDataFrame([(at, row.tolist()) for at, row in enumerate(made)], "vec_id long, embedding array<float>")
    found = {(row["query_id"], row["vec_id"]) for row in nearest_neighbours(table, table.where("vec_id % 50 = 0"), tables=2).collect()}
    units = made / np.linalg.norm(made, axis=1)[:, None]
    cosines = units[::50] @ units.T
    cosines[np.arange(40), np.arange(0, 2000, 50)] = -2
    wanted = {(50 * at, int(vec_id)) for at, row in enumerate(cosines) for vec_id in np.argsort(-row)[:5]}
    assert len(found & wanted) >= 0.9 * len(wanted)


def test_visits_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LOT_ROWS", 300, raising=False)
    made = np.random.default_rng(6).normal(size=(2000, 16)).astype("f4")
    table = spark.createDataFrame([(at, row.tolist()) for at, row in enumerate(made)], "vec_id long, embedding array<float>")
    with session_settings(spark, {"spark.sql.maxBroadcastTableSize": "32m"}):
        found = of(nearest_neighbours(table, table.where("vec_id % 2 = 0"), probes=32))
    units = made.astype(float) / np.sqrt((made.astype(float) ** 2).sum(axis=1))[:, None]
    cosines = units[::2] @ units.T
    cosines[np.arange(1000), np.arange(0, 2000, 2)] = -2
    assert [row[:3] for row in found] == sorted(
        ((2 * at, rank + 1, int(vec_id)) for at, row in enumerate(cosines) for rank, vec_id in enumerate(np.argsort(-row)[:5])), key=repr
    )


def test_lots_in_turns_with_shares(spark, monkeypatch):
    given, table = vectors(spark)
    whole = of(nearest_neighbours(table, table, tables=3))
    monkeypatch.setattr(neighbours, "LOT_ROWS", 20)
    monkeypatch.setattr(neighbours, "TURN_FLOATS", 1)
    monkeypatch.setattr(neighbours, "LOT_PAIRS", 7)
    monkeypatch.setattr(neighbours, "HELD_PAIRS", 30)
    assert of(nearest_neighbours(table, table, tables=3)) == whole


def test_hadamard():
    rows = np.random.default_rng(0).normal(size=(3, 8))
    full = np.array([[(-1) ** (i & j).bit_count() for j in range(8)] for i in range(8)]) / np.sqrt(8)
    assert np.allclose(hadamard(rows), rows @ full)
