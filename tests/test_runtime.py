"""Session services and the driver contract."""

import pytest

import __spark_entry__
from lattica import runtime


class Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


class Session:
    def __init__(self, master, **conf):
        self.conf = Conf(conf)
        self.sparkContext = type("Context", (), {"master": master})()


def test_shared_folder_comes_from_the_session():
    assert runtime.shared_dir(Session("yarn", **{runtime.CHECKPOINT_CONF: "hdfs://x/y/"})) == "hdfs://x/y"
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://h:7077"):
        with pytest.raises(RuntimeError):
            runtime.shared_dir(Session(master))


def test_fresh_names_never_clash():
    assert runtime.fresh_name(["a", "_RANK"], "_rank") == "_rank_"
    assert runtime.fresh_name([], "x") == "x"


def test_stored_tables_read_back(spark):
    df = spark.createDataFrame([(1, ["a"], None), (2, [], b"x")], "a long, b array<string>, c binary")
    assert sorted(runtime.stored(df).collect()) == sorted(df.collect())
    assert runtime.stored(df.limit(0)).schema == df.schema


def test_driver_contract(spark):
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 75
    assert __spark_entry__.entry(spark).columns == ["id", "score"]


@pytest.mark.parametrize("name", ["bm25_top10", "in_degree_all", "innermost_span", "unique_name_resolve", "session_close_2h"])
def test_a_query_of_each_family_equals_its_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in "region nation customer supplier part orders lineitem events documents pages".split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    got = __spark_entry__.queries()[name](spark, sf)
    cur = con.execute(__spark_entry__.oracle_sql()[name])
    order = [[d[0] for d in cur.description].index(c) for c in got.columns]
    want = sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
