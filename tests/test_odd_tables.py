"""Queries and their SQL on tables that the given ones do not show: names and keys with years in them, pages cut inside a character reference."""

import duckdb
import pytest

from test_queries import DATA, TABLES, rows
from wattline.operators import matching as ma
from wattline.plans import catalog
from wattline.sources import fixtures as fx

#: The years that orders ask for stand at the end, inside and at the beginning of the names' digits.
ODD = {
    "customer": "SELECT * REPLACE ('Customer#' || CASE c_custkey % 4 WHEN 0 THEN '00000' || y WHEN 1 THEN '000' || y || '34' WHEN 2 THEN y || '34567' ELSE y || '7' || y END AS c_name) FROM (SELECT *, cast(1992 + c_custkey % 9 AS string) y FROM source UNION ALL SELECT * REPLACE (c_custkey + 2000 AS c_custkey), '1992' FROM source WHERE c_custkey < 40) x",
    "orders": "SELECT * REPLACE (cast(row_number() OVER (ORDER BY o_orderkey) AS bigint) AS o_orderkey, c_custkey AS o_custkey) FROM source JOIN (SELECT c_custkey FROM '{DATA}/customer.parquet' WHERE c_custkey < 36) c ON true WHERE o_orderkey < 200",
    "supplier": "SELECT * REPLACE (s_suppkey + 2010 AS s_suppkey) FROM source UNION ALL SELECT * FROM source",  # an address with 2018 in it
    "pages": """SELECT * REPLACE (CASE page_id % 3 WHEN 0 THEN '<head><title>A&amp;B &amp;amp; C &lt D&#39;s &#39</title></head><p>x &copy 1 &ampx &#x27;</p>y &amp' WHEN 1 THEN '<head><title>cut &amp</title></head>&quot;&hellip; &amp;lt; &#x27' ELSE html END AS html) FROM source""",
}


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    folder, con = tmp_path_factory.mktemp("odd"), duckdb.connect()
    for t in TABLES:
        sql = ODD.get(t, "SELECT * FROM source").replace("{DATA}", DATA).replace("source", f"'{DATA}/{t}.parquet'")
        if t == "orders":
            sql = f"SELECT * EXCLUDE (c_custkey) FROM ({sql}) z"
        con.sql(f"COPY ({sql}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("key", ["html_tables", "html_text", "rank_sources", "relevance"])
def test_odd_tables(spark, odd, key):
    folder, con = odd
    frame, want = catalog.QUERIES[key](spark, folder), con.sql(catalog.ORACLES[key])
    got, expected = rows(frame.columns, frame.collect()), rows(list(want.columns), want.fetchall())
    assert set(got) - set(expected) == set(expected) - set(got) == set()
    assert got == expected


@pytest.mark.parametrize("name", sorted(fx.SPARK_FRAMES))
def test_frames_of_spark(spark, tmp_path, name):
    """Frames that Spark makes in its own way are those of the SQL: repeated lines, and nulls in every key."""
    con, source = duckdb.connect(), f"'{DATA}/lineitem.parquet'"
    lines = f"""SELECT * REPLACE (cast(row_number() OVER () AS double) AS l_extendedprice) FROM (SELECT * FROM {source} UNION ALL SELECT * REPLACE (CASE WHEN l_partkey % 2 = 0 THEN l_suppkey END AS l_suppkey, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_partkey END AS l_partkey,
        CASE WHEN l_partkey % 5 <> 1 THEN l_orderkey END AS l_orderkey, CASE WHEN l_partkey % 7 = 2 THEN NULL WHEN l_partkey % 7 = 3 THEN -1 WHEN l_partkey % 7 = 4 THEN 14 ELSE l_linenumber END AS l_linenumber, CASE WHEN l_partkey % 4 <> 1 THEN l_shipdate END AS l_shipdate) FROM {source}) x"""
    orders = f"SELECT * REPLACE (CASE WHEN o_orderkey % 9 = 4 THEN NULL WHEN o_orderkey % 9 = 5 THEN -o_orderkey ELSE o_orderkey END AS o_orderkey) FROM '{DATA}/orders.parquet' UNION ALL SELECT * FROM '{DATA}/orders.parquet' WHERE o_orderkey % 11 = 3"
    for t, sql in (("lineitem", lines), ("orders", orders)):
        con.sql(f"COPY ({sql}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    frame, want = fx.frame(spark, str(tmp_path), name), con.sql(fx.with_(name) + f"SELECT * FROM {name}")
    assert sorted(frame.columns) == sorted(want.columns)
    got, expected = rows(frame.columns, frame.collect()), rows(list(want.columns), want.fetchall())
    assert len(got) == len(expected) > 1000
    assert set(got) ^ set(expected) == set()
    assert got == expected


def test_names_asked_for_often(spark):
    """Many that ask for a name of many stations are no row for each pair; together both tables are all pairs. Parts are found by runs of each length."""
    stations = spark.createDataFrame([(f"s{i}", "Old Mill", None, f"River Dam Number {i}|Xy{i}") for i in range(40)], "entity_id string, canonical_name string, local_name string, aliases string")
    asked = ["old  MILL"] * 50 + ["d mi", "ver dam number 3", "r dam number 39", "xy1", "xy12", "number", "mill!", "ld", " ", None]
    names, members = ma.match_names(spark.createDataFrame(list(enumerate(asked)), "ask_id int, name string"), stations)
    forms = {f"s{i}": {"old mill", f"river dam number {i}", f"xy{i}"} for i in range(40)}
    want = set()
    for i, x in enumerate(asked):
        n = " ".join((x or "").lower().split())
        strict = {s for s, f in forms.items() if n in f}
        fits = strict or {s for s, f in forms.items() if len(n) >= 4 and any(n in y for y in f)}
        want |= {(i, s, "strict" if strict else "contains", len(fits)) for s in fits}
    rows_, member = names.collect(), {r.ask_id: r.first for r in members.collect()}
    assert len(rows_) == len({(r.first, r.entity_id) for r in rows_}) == len({(asked[i] if i >= 50 else "", s) for i, s, *_ in want})
    assert {(i, r.entity_id, r.how, r.hits) for i, f in member.items() for r in rows_ if r.first == f} == want


def test_every_asked_name_has_its_matches(spark, odd):
    """A row for each pair of an asked name and a station that it fits, in the query and in its SQL."""
    folder, con = odd
    asked, stations = (con.sql(fx.with_(n) + f"SELECT {c} FROM {n}").fetchall() for n, c in (("asked_names", "ask_id, name"), ("named_stations", "entity_id, canonical_name, local_name, aliases")))
    norm = lambda x: " ".join((x or "").lower().split())
    forms = {s: {norm(x) for x in (a, b, *c.replace("；", ";").replace("|", ";").split(";"))} - {""} for s, a, b, c in stations}
    want = []
    for i, x in asked:
        n = norm(x)
        strict = [s for s, f in forms.items() if n in f]
        fits = strict or [s for s, f in forms.items() if len(n) >= 4 and any(n in y for y in f)]
        want += [(i, s, "strict" if strict else "contains", len(fits)) for s in fits]
    assert len(forms) == len(stations) and len(want) > 2 * len(asked)
    columns = ["ask_id", "entity_id", "how", "hits"]
    frame, sql = catalog.QUERIES["entity_match_list"](spark, folder), con.sql(catalog.ORACLES["entity_match_list"])
    assert frame.columns == list(sql.columns) == columns
    assert rows(columns, frame.collect()) == rows(columns, sql.fetchall()) == rows(columns, want)


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_groups_of_a_name(spark, monkeypatch, size):
    """Groups of any size make each pair once, also for ids that ask for several names or for one again."""
    monkeypatch.setattr(ma, "GROUP", size)
    stations = spark.createDataFrame([(f"s{i}", "Old Mill", None, f"River Dam {i}") for i in range(30)], "entity_id string, canonical_name string, local_name string, aliases string")
    asked = [(i % 20, "old mill") for i in range(40)] + [(3, "river dam"), (3, "river dam 29"), (4, None), (5, "none")]
    got = sorted(tuple(r) for r in ma.match_entities(spark.createDataFrame(asked, "ask_id int, name string"), stations).collect())
    want = [(i % 20, f"s{s}", "strict", 30) for i in range(40) for s in range(30)] + [(3, f"s{s}", "contains", 30) for s in range(30)] + [(3, "s29", "strict", 1)]
    assert got == sorted(want)
