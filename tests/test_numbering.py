import random

from tracewright.operators.numbering import number_rows


def test_numbers_follow_the_order_within_groups(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None, "hot", "hot", "hot"]), rng.randrange(10**6), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v long, number long").repartition(7)
    got = number_rows(df, ["v"], within=["g"]).collect()
    assert len(got) == len(rows)
    for g in ("a", "b", None, "hot"):
        mine = sorted((r.number, r.v) for r in got if r.g == g)
        assert [n for n, _ in mine] == list(range(1, len(mine) + 1))
        assert [v for _, v in mine] == sorted(v for x, v, _ in rows if x == g)


def test_numbers_of_the_whole_table(spark):
    df = spark.range(5000).selectExpr("id", "cast(id % 3 as string) as k").repartition(5)
    got = number_rows(df, [df.id.desc()], "rank").collect()
    assert all(r.rank == 5000 - r.id for r in got)
    assert number_rows(df.limit(0), ["id"]).columns == ["id", "k", "number"] and number_rows(df.limit(0), ["id"], within=["k"]).count() == 0
