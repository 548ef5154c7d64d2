"""Top-k search, whitening and conversation repair against brute force."""

import hashlib
import itertools
import re
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import dialogue, impact, whiten
from tessella.llm.queries import QUERIES

VECTORS = "vec_id long, embedding array<float>, label int, id string, tag string, shard string, weight string, vector string, x string, dim string"


def vectors_frame(spark, rows):
    return spark.createDataFrame([(i, v, None, "a", "b", "c", "d", "e", "f", "g") for i, v in rows], VECTORS)


@pytest.fixture(scope="module")
def odd_vectors(spark):
    """Nulls, empty, zero, non-finite and huge vectors, ties, repeated rows, other lengths, clashing names."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.2, 8).tolist()) for i in range(300)]
    rows += [(i, rows[i % 7][1]) for i in range(300, 420)] + [rows[0], rows[50], rows[100]]
    rows += [(None, rows[1][1]), (500, None), (501, [None] + [0.0] * 7), (502, [float("nan")] + [0.0] * 7), (503, [float("inf")] + [0.0] * 7),
             (550, [0.0] * 8), (551, []), (600, []), (601, [1.0, 2.0]), (650, [2.0, -1.0]), (700, [1e30] + [0.0] * 7), (50, rows[3][1])]
    return vectors_frame(spark, rows)


def best_by_brute_force(rows, top=5):
    good = [(i, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, v in rows
            if i is not None and v is not None and all(c is not None and abs(c) < 2**20 for c in v)]
    out = set()
    for i, q in {(i, q.tobytes()): (i, q) for i, q in good if i % 50 == 0}.values():
        scores = sorted((-int(q @ x), j) for j, x in good if j != i and len(x) == len(q))[:top]
        out |= {(i, q.tobytes(), k + 1, j, -s) for k, (s, j) in enumerate(scores)}
    return sorted((i, k, j, s) for i, _, k, j, s in out)


@pytest.mark.parametrize("shard_rows", [16_384, 64])
def test_topk_search(spark, odd_vectors, monkeypatch, shard_rows):
    monkeypatch.setattr(impact, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(impact, "LANE_SHARDS", 3)
    rows = [(r.vec_id, r.embedding) for r in odd_vectors.collect()]
    index = impact.build_index(odd_vectors)
    got = impact.search(index, odd_vectors.where("vec_id % 50 = 0"))
    assert sorted(tuple(r) for r in got.collect()) == best_by_brute_force(rows)
    assert index.agg(F.sum("n")).first()[0] == len([1 for i, v in rows if i is not None and v is not None and all(c is not None and abs(c) < 2**20 for c in v)])


def test_topk_search_stops_on_proof_only(monkeypatch):
    """Early ends leave few vectors, and the best are always among them."""
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.normal(0, 0.125, (4000, 64))).astype(np.int32)
    x[1000:1400] = x[7]
    batch = impact._shard(1, np.arange(len(x)), x)
    shard = impact.Shard(*(batch.column(name)[0].as_py() for name in ("dim", "n", "ids", "kind", "vectors", "postings", "ends")))
    for own in [*range(0, 4000, 97), 7, 1001]:
        ids, scores = shard.search(x[own], own, 5, None)
        exact = x.astype(np.int64) @ x[own].astype(np.int64)
        want = sorted((-int(exact[j]), j) for j in range(len(x)) if j != own)[:5]
        order = impact.best(ids, scores, 5)
        assert list(zip((-scores[order]).tolist(), ids[order].tolist(), strict=True)) == want
        limit = -want[-1][0]
        again, _ = shard.search(x[own], own, 5, limit)
        assert set(again) >= {j for _, j in want}


def test_topk_search_of_empty_tables(odd_vectors):
    none = odd_vectors.where("false")
    assert impact.search(impact.build_index(none), none).count() == 0
    assert impact.search(impact.build_index(odd_vectors), none).count() == 0
    assert impact.search(impact.build_index(none), odd_vectors).count() == 0


def whitened_by_brute_force(x, counted):
    fit = x if counted else np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    c = (x * n - sums) / n
    f = (fit * n - sums) / n
    values, axes = np.linalg.eigh(f.T @ f / n)
    values, axes = values[::-1][:32], axes[:, ::-1][:, :32]
    return n, ((x * n - sums) ** 2).sum(1), c @ axes / np.sqrt(values), values / np.trace(f.T @ f / n)


@pytest.mark.parametrize("counted", [True, False])
def test_whitening(spark, counted):
    rng = np.random.default_rng(2)
    base = (rng.normal(0, 0.2, (500, 40)) * np.linspace(1, 3, 40)).astype(np.float32)
    base[100:300] = base[3]  # one vector makes up two fifths
    frame = vectors_frame(spark, [(i if i % 9 else None, v.tolist()) for i, v in enumerate(base)] + [(900, None), (901, [None] * 40), (902, [float("nan")] * 40)])
    x = np.floor(64 * base.astype(float)).astype(np.int64) + 1_000_000
    n, deviation, white, explained = whitened_by_brute_force(x, counted)
    got = whiten.whiten(frame.repartition(5), counts=counted).collect()
    assert len(got) == 500
    by_deviation = defaultdict(list)
    for k in range(500):
        by_deviation[int(deviation[k])].append(k)
    signs = None
    for r in got:
        k = by_deviation[r.deviation][0]
        mine = np.array(r.whitened)
        signs = np.sign(mine * white[k]) if signs is None else signs
        assert r.n == n and np.allclose(mine, white[k] * signs, atol=1e-7) and np.allclose(r.explained, explained, rtol=1e-9) and r.identity_error < 1e-8


def test_whitening_of_odd_tables(spark, odd_vectors):
    got = whiten.whiten(odd_vectors).collect()
    rows = [(r.vec_id, r.embedding) for r in odd_vectors.collect()]
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) and abs(c) < 2**56 for c in v)]
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in kept)
    assert all(r.identity_error < 1e-4 for r in got) and {len(r.whitened) for r in got if r.vec_id in (551, 600)} == {0}
    assert whiten.whiten(odd_vectors.where("false")).count() == 0
    single = whiten.whiten(odd_vectors.where("vec_id = 7")).first()
    assert single.n == 1 and single.deviation == 0 and single.whitened == []


def test_whitening_is_exact_beyond_64_bits():
    x = np.array([[2**61, -(2**61)], [5, 7]], np.int64)
    c, squares = whiten.centred(x, (3, [2**61 + 10, 14 - 2**61]))
    assert squares[0] is None and c.shape == (2, 2) and np.isfinite(c).all()
    c, squares = whiten.centred(np.array([[1_000_003, 1_000_001]]), (2, [2_000_005, 2_000_003]))
    assert squares == [2] and c.tolist() == [[0.5, -0.5]]


GOAL = re.compile("(s?(ua)+)?")


def cheapest_by_brute_force(rows):
    """All edits with up to two inserts at each place; rows are (initial, must go, truncated)."""
    best = None
    for letters in itertools.product("DKR", repeat=len(rows)):
        if any(must and letter != "D" for letter, (_, must, _) in zip(letters, rows, strict=True)):
            continue
        for inserts in itertools.product(range(3), repeat=len(rows) + 1):
            audit = "I" * inserts[0] + "".join(letter + "I" * k for letter, k in zip(letters, inserts[1:], strict=True))
            cost = 2 * sum(inserts) + sum({"D": 3, "K": cut, "R": 2 + cut}[letter] for letter, (_, _, cut) in zip(letters, rows, strict=True))
            if best is not None and (cost, audit) >= best:
                continue
            kept = "".join("*" * inserts[0] + {"D": "", "K": initial, "R": "*"}[letter] + "*" * k for letter, k, (initial, _, _) in zip(letters, inserts[1:], rows, strict=True)) if rows else "*" * inserts[0]
            if rows:
                kept = "*" * inserts[0] + "".join({"D": "", "K": initial, "R": "*"}[letter] + "*" * k for letter, k, (initial, _, _) in zip(letters, inserts[1:], rows, strict=True))
            goal = ("s" if len(kept) % 2 else "") + "ua" * (len(kept) // 2)
            if all(a == b or (a == "*" and b != "s") for a, b in zip(kept, goal, strict=True)) and goal != "s":
                best = (cost, audit)
    return best


def test_repair_is_the_cheapest():
    rng = np.random.default_rng(7)
    for size in (0, 1, 2, 3, 4):
        for _ in range(1 if not size else 40):
            codes = rng.integers(0, 12, size).tolist()
            cost, audit, _ = dialogue.cheapest(dialogue.parse(codes, None, dialogue.START))
            rows = [("sua?"[c // 3], c % 3 == 2, c % 3 == 1) for c in codes]
            assert (cost, dialogue.letters(audit)) == cheapest_by_brute_force(rows), codes


def linear_repair(rows):
    """Rows (role, text) in order to the report, by dynamic programming over plain strings."""
    seen, faults = set(), []
    for role, text in rows:
        bare = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    # States: nothing yet, after s, expecting a, after a pair.
    def moves(state, symbol):
        return {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, symbol))

    def close(heads):
        for _ in range(4):
            for state, (cost, audit, out) in list(heads.items()):
                for symbol in "ua":
                    new = moves(state, symbol)
                    made = (cost + 2, audit + "I", out + (("user" if symbol == "u" else "assistant", ""),))
                    if new is not None and made < heads.get(new, (10**9,)):
                        heads[new] = made
        return heads

    heads = close({0: (0, "", ())})
    for (role, text), fault in zip(rows, faults, strict=True):
        after = {}

        def put(state, made):
            if state is not None and made < after.get(state, (10**9,)):
                after[state] = made

        for state, (cost, audit, out) in heads.items():
            put(state, (cost + 3, audit + "D", out))
            if fault not in ("blank", "duplicate"):
                more = int(fault == "truncated")
                put(moves(state, role[:1]), (cost + more, audit + "K", out + ((role, text),)))
                for name in ("user", "assistant"):
                    put(moves(state, name[0]), (cost + 2 + more, audit + "R", out + ((name, text),)))
        heads = close(after)
    cost, audit, out = min(heads[s] for s in (0, 3) if s in heads)
    initials = [role[:1] for role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    counts = [faults.count(name) for name in ("blank", "duplicate", "truncated")]
    return (*counts, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def report_by_brute_force(table):
    groups = defaultdict(list)
    for conv, turn, role, text in table:
        groups[conv]
        kind = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        groups[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = {t for t, _, _ in rows if t is not None}
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *linear_repair([r[1:] for r in rows]))
    return out


CONVERSATIONS = "conv_id long, turn long, role string, text string, at string, conv string, place string, code string, edits string"


@pytest.fixture(scope="module")
def odd_conversations():
    """Nulls everywhere, blanks, odd roles, ties, repeated rows, a long conversation and a very long text."""
    rng = np.random.default_rng(11)
    roles, texts = ["user", "assistant", "system", "tool", "", None], ["Yes.", "No", " \t\n", "", "What?", None, "So!\n", "café…", "a.b ", "x "]
    rows = [(int(c), None if t == 9 else int(t), roles[r], texts[k]) for c, t, r, k in zip(rng.integers(0, 200, 1500), rng.integers(0, 10, 1500), rng.integers(0, 6, 1500), rng.integers(0, 10, 1500), strict=True)]
    rows += [(None, 1, "user", "Hi."), (None, None, None, None), (300, 2**40, "user", "far."), (300, 1, "assistant", "w" * 1_000_000)]
    rows += [(301, t, ["user", "assistant"][t % 2], f"turn {t}.") for t in range(700)] + [(302, None, "user", "same.")] * 400 + [(302, None, "user", f"other {k}.") for k in range(200)]
    return rows


@pytest.mark.parametrize("fragment", [4096, 50, 1])
def test_repair_of_conversations(spark, odd_conversations, monkeypatch, tmp_path, fragment):
    monkeypatch.setattr(dialogue, "FRAGMENT_ROWS", fragment)
    frame = spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in odd_conversations], CONVERSATIONS)
    frame.repartition(7).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in QUERIES["op13_conversation_repair"](spark, str(tmp_path)).collect()}
    want = report_by_brute_force(odd_conversations)
    assert got.keys() == want.keys() and [c for c in want if got[c] != want[c]] == []


def test_repair_of_the_given_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in QUERIES["op13_conversation_repair"](spark, folder).collect()}
    assert got == report_by_brute_force(rows)


def test_repair_returns_rows(spark):
    rows = [(1, 1, "assistant", "First."), (1, 2, "user", "Second."), (1, 3, "assistant", "Third")]
    report, repaired = dialogue.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert report.first().audit in ("DKK", "IKKK") and report.first().cost == 3
    made = [(r.role, r.text) for r in repaired.orderBy("place", "part").collect()]
    assert made == ([("user", "Second."), ("assistant", "Third")] if report.first().audit == "DKK" else [("user", ""), *[(r[2], r[3]) for r in rows]])
    assert dialogue.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).report.count() == 0
