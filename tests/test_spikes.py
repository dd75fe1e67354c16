import numpy as np

from cohortloom.operators import spikes as S

HOUR = 3_600_000_000


def readings(n, seed=1, level=98.0, scatter=0.3):
    rng = np.random.default_rng(seed)
    return [(k * 6 * HOUR, float(level + rng.normal(0, scatter))) for k in range(n)]


def frame(spark, sources):
    rows = [(f"{name}-{k}", name, t, v) for name, r in sources.items() for k, (t, v) in enumerate(r)]
    return spark.createDataFrame(rows, "id string, source string, utc_us bigint, value double")


def put(r, **values):
    r = list(r)
    for k, v in values.items():
        r[int(k[1:])] = (r[int(k[1:])][0], v)
    return r


def test_rules(spark):
    sources = {
        "spike": put(readings(60), _30=105.0), "pair": put(readings(60, 2), _10=91.0, _11=90.0), "three": put(readings(60, 3), _20=104.0, _21=104.2, _22=104.5),
        "stuck": put(readings(60, 4), **{f"_{k}": 98.25 for k in range(20, 28)}), "seven": put(readings(60, 5), **{f"_{k}": 98.25 for k in range(20, 27)}),
        "impossible": put(readings(60, 6), _5=37.0, _6=140.0), "celsius": put(readings(60, 7, 36.7, 0.15), _9=98.0, _20=40.5),
        "fever": put(readings(60, 8), _30=99.5, _31=101.0, _32=102.3, _33=101.2, _34=99.4), "few": put(readings(19, 9), _5=140.0), "shifted": readings(60, 10, 101.0),
    }
    got = {(r.id, r.reason) for r in S.score_readings(frame(spark, sources), flagged_only=True).collect()}
    want = {("spike-30", "spike"), ("pair-10", "spike"), ("pair-11", "spike"), *((f"stuck-{k}", "stuck") for k in range(20, 28)), ("impossible-5", "impossible"), ("impossible-6", "impossible"), ("celsius-9", "impossible"), ("celsius-20", "spike")}
    assert got == want


def test_every_reading_has_a_score(spark):
    got = S.score_readings(frame(spark, {"a": put(readings(50), _5=140.0)})).collect()
    assert len(got) == 50 and all(0 < r.score < 1 for r in got)
    assert max(got, key=lambda r: r.score).id == "a-5"


def test_the_forest_decides(spark):
    """A fever's peak lies a jump away, for one reading; only the forest tells it from a spike. A stuck run needs its score, too."""
    df = frame(spark, {"fever": put(readings(60, 8), _30=99.5, _31=101.0, _32=102.3, _33=101.2, _34=99.4), "spike": put(readings(60), _30=102.6), "stuck": put(readings(60, 4), **{f"_{k}": 98.25 for k in range(20, 28)})})
    flagged = lambda **more: {r.id for r in S.score_readings(df, flagged_only=True, **more).collect()}
    stuck = {f"stuck-{k}" for k in range(20, 28)}
    assert flagged() == {"spike-30"} | stuck
    assert flagged(cutoff=0.0) == {"spike-30", "fever-32"} | stuck
    assert flagged(cutoff=1.0) == stuck and flagged(stuck_cutoff=1.0) == {"spike-30"}


def test_scores_are_those_of_drawn_samples():
    """The counted probabilities are the mean over drawn samples."""
    rng = np.random.default_rng(3)
    features = np.clip(rng.integers(0, 6, (40, 4)) + np.where(np.arange(40)[:, None] < 3, 24, 0), 0, S.GRID)
    got = S.forest_scores(np.zeros(40, int), features, np.ones(40), 1, S.ASKED, trees=6)
    path, draws = np.zeros(40), 3000
    for t in range(6):
        feature, at = S._tree(t, S.ASKED, S.DEPTH)
        nodes = [np.zeros(40, int)]
        for _ in range(S.DEPTH):
            nodes.append(2 * nodes[-1] + 1 + (features[np.arange(40), feature[nodes[-1]]] > at[nodes[-1]]))
        for i in range(0, 40, 13):
            others = np.delete(np.arange(40), i)
            seen = rng.choice(others, (draws, S.SEEN))
            met = [(n[seen] == n[i]).any(axis=1).mean() for n in nodes[1:]]
            path[i] += sum(met) + met[-1] * S._average_path(S.SEEN)
    want = 2 ** (-(1 + path / 6) / S._average_path(S.SEEN))
    assert np.allclose(got[::13], want[::13], atol=0.01)


def test_levels_of_hot_sources_are_exact(spark):
    df = frame(spark, {"hot": [(t, v + (1.0 if (t // (6 * HOUR)) % 4 == 1 else 0)) for t, v in readings(700, 3)]})
    scores = lambda **more: {r.id: (r.level, r.scatter) for r in S.score_readings(df, **more).collect()}
    whole, cut = scores(), scores(chunk=150)
    assert whole.keys() == cut.keys() and all(np.allclose(whole[k], cut[k], atol=1e-9) for k in whole)
    assert all(np.allclose(whole[k], v, atol=1e-9) for k, v in scores(chunk=150, sizes=df.groupBy("source").count().withColumnRenamed("count", "n")).items())


def test_hot_sources_beyond_the_limit_are_joined(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT_LIMIT", 0)
    df = frame(spark, {"hot": put(readings(300, 11), _99=105.0), "cold": put(readings(60, 12), _30=105.0)})
    assert {r.id for r in S.score_readings(df, chunk=100, flagged_only=True).collect()} == {"hot-99", "cold-30"}


def test_chunks_of_a_hot_source_find_the_same(spark):
    hot = put(readings(900, 11), _99=105.0, _100=91.0, _450=104.5, **{f"_{k}": 98.25 for k in range(195, 206)})
    df = frame(spark, {"hot": hot, "cold": put(readings(60, 12), _30=105.0)})
    whole = {(r.id, r.reason) for r in S.score_readings(df, flagged_only=True).collect()}
    cut = {(r.id, r.reason) for r in S.score_readings(df, chunk=100, block=150, flagged_only=True).collect()}
    assert whole == cut and len(S.score_readings(df, chunk=100, block=150).collect()) == 960


def test_nulls_repeats_and_empty(spark):
    df = frame(spark, {"a": put(readings(60), _30=105.0)})
    odd = spark.createDataFrame([(None, "a", 1, 1.0), ("n1", None, 1, 1.0), ("n2", "a", None, 1.0), ("n3", "a", 1, None)], df.schema)
    again = df.filter("id = 'a-30'").selectExpr("concat(id, '-again') as id", "source", "utc_us", "value")
    got = S.score_readings(df.union(df).union(odd).union(again), flagged_only=True).collect()
    assert sorted(r.id for r in got) == ["a-30", "a-30-again"]
    assert S.score_readings(df.limit(0)).collect() == []
