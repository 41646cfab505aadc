import random

from adlens.operators import group_lists as GL

SCHEMA = "client_id string, account_id string, keyword string, state string, at long"


def plain(rows, segment):
    """Lists in record order, cut into segments."""
    lists = {}
    for client, account, keyword, state, at in sorted(
            rows, key=lambda r: (r[4] is not None, r[4] or 0, r[2] is not None, r[2] or "")):
        if state == "enabled":
            lists.setdefault((client, account), []).append(keyword)
    return sorted((str(k), i // segment, len(x[i:i + segment]), x[i:i + segment])
                  for k, x in lists.items() for i in range(0, len(x), segment))


def got(df, segment):
    return sorted((str((r.client_id, r.account_id)), r.segment, r.n, r.keywords)
                  for r in GL.keyword_lists(df, ["at"], segment).collect())


def rows_of(n, seed=1):
    """A third of the records in one campaign; ties and repeated records among them."""
    rng = random.Random(seed)
    return [("hot" if i % 3 == 0 else f"c{rng.randrange(40)}", "a", f"kw {rng.randrange(30)}",
             "paused" if i % 11 == 0 else "enabled", rng.randrange(n)) for i in range(n)]


def test_lists_keep_the_order(spark):
    rows = rows_of(3000)
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(7), 64) == plain(rows, 64)


def test_nulls_ties_and_no_rows(spark):
    rows = [(None, "a", "x", "enabled", 1), (None, "a", None, "enabled", 2), ("c", None, "y", "enabled", None),
            ("c", None, "y", "enabled", None), ("c", None, "b", "enabled", None), ("c", "a", "z", None, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df, 2) == plain(rows, 2)
    assert got(df.limit(0), 2) == []


def test_rows_come_back(spark):
    rows = rows_of(500, 2)
    lists = GL.keyword_lists(spark.createDataFrame(rows, SCHEMA), ["at"], 16, state=None)
    back = GL.list_rows(lists, 16).collect()
    assert sorted((r.client_id, r.keyword) for r in back) == sorted((r[0], r[2]) for r in rows)
    assert sorted(r.position for r in back if r.client_id == "hot") == list(range(sum(r[0] == "hot" for r in rows)))


def test_hot_campaign_is_many_parts_and_segments(spark):
    rows = rows_of(6000)
    df = spark.createDataFrame(rows, SCHEMA)
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "64"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():  # small parts would be merged
        spark.conf.set(k, v)
    try:
        lists = GL.keyword_lists(df, ["at"], 64).cache()
        plan = GL.positions(df, ["at"])._jdf.queryExecution().executedPlan().toString()
        tasks = max(len(x) for x in GL.positions(df, ["at"]).rdd.glom().collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    hot = lists.where("client_id = 'hot'").collect()
    assert len(hot) > 20 and max(r.n for r in hot) <= 64
    assert "SinglePartition" not in plan
    assert tasks < 6000 // 8  # the hot campaign has a third
