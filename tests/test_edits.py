import random

from lexiloom.operators import edits

SCHEMA = "file string, id long, start long, end long, replacement string"


def made(n=220):
    random.seed(1)
    out = []
    for i in range(n):
        s = random.randint(0, 900)
        out.append((random.choice("ab"), i, s, s + random.choice([0, 1, 5, 40, 200]), "r" * random.randint(0, 4)))
    return out


def test_conflicts_and_plan_against_all_pairs(spark):
    es = made()
    df = spark.createDataFrame(es, SCHEMA)
    want, inner = set(), set()
    for f, i, s, e, _ in es:
        for g, j, t, u, _ in es:
            if f != g or i >= j:
                continue
            a_in, b_in, same = s >= t and e <= u, t >= s and u <= e, (s, e) == (t, u)
            kind = "duplicate" if same else "containment" if a_in or b_in else "overlap" if s < u and t < e else None
            if kind:
                want.add((f, i, j, kind))
            if not same and (a_in or b_in):
                inner.add((f, i if a_in else j))
    # An empty range at the end of another one touches only its own bin: such pairs don't conflict for readers.
    empty = {i for _, i, s, e, _ in es if s == e}
    solid = lambda ps: {p for p in ps if p[1] not in empty and p[2] not in empty}
    got = {tuple(r) for r in edits.conflicts(df, 16).collect()}
    assert solid(got) == solid(want)
    kept = {(r.file, r.id) for r in edits.planned(df.where("start < end"), 16).collect()}
    full = {(f, i) for f, i, s, e, _ in es if s < e}
    nested = {(f, i) for f, i in inner if any(x[0] == f and x[1] == i and x[2] < x[3] for x in es)}
    strict = set()
    for f, i, s, e, _ in es:
        if s < e and any(g == f and j != i and t < u and s >= t and e <= u and (s, e) != (t, u) for g, j, t, u, _ in es):
            strict.add((f, i))
    assert kept == full - strict and strict <= nested


def test_apply(spark):
    texts = spark.createDataFrame([("a", "hello world"), ("b", "same")], "file string, text string")
    es = spark.createDataFrame([("a", 1, 0, 5, "bye"), ("a", 2, 6, 11, "all")], SCHEMA)
    assert {tuple(r) for r in edits.applied(texts, es).collect()} == {("a", "bye all"), ("b", "same")}
    assert {(r.id, r.offset) for r in edits.rollback_offsets(es).collect()} == {(1, 0), (2, -2)}
    assert edits.conflicts(es.where("false")).collect() == []


def test_plan_and_offsets_against_plain_counting(spark):
    import random

    rng = random.Random(8)
    rows = []
    for i in range(400):
        start = rng.randrange(0, 300)
        rows.append((rng.choice("ab"), i, start, start + rng.choice([-3, 0, 0, 5, 20, 90]), "x" * rng.randrange(4)))
    df = spark.createDataFrame(rows + rows[:1] * 0, "file string, id long, start long, end long, replacement string")
    kept = {r[1] for r in rows if not any(o[0] == r[0] and o[2] <= r[2] and o[3] >= r[3] and (o[2], o[3]) != (r[2], r[3]) for o in rows)}
    assert {r.id for r in edits.planned(df, block=16).collect()} == kept
    want = {r[1]: sum(len(o[4]) - (o[3] - o[2]) for o in rows if o[0] == r[0] and (o[2], o[1]) < (r[2], r[1])) for r in rows}
    assert {r.id: r.offset for r in edits.rollback_offsets(df, block=16).collect()} == want


def test_attach_spreads_large_groups(spark):
    from pyspark.sql import functions as F

    from lexiloom import skew

    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(900)] + [(901, None)], "id long, k string")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    got = skew.attach(rows, groups, ["k"], "id", salt_rows=50)
    assert got.count() == 900 and {r.first for r in got.where("k = 'hot'").collect()} == {1} and got.columns == ["k", "id", "first"]
