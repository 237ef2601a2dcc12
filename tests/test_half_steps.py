"""Returns on half of a sixth decimal: Spark's figures are the SQL's, once both multiply row by row.

Windows of the SQL's engine multiply in blocks that depend on which other series
there are. Its setting debug_window_mode lets the same SQL multiply each frame
row by row; nothing else is changed.
"""

import duckdb
import pytest
from pyspark.sql import functions as F

from strandline.functions import stats
from strandline.plans.oracles import SQL, P
from strandline.plans.queries import QUERIES
from strandline.plans.queries import rounded as rounded_rows
from tests.compare import rows


@pytest.fixture(scope="module")
def lines(tmp_path_factory):
    """12 brands, 300 days, 64 lines a brand and day: half of all mean discounts make a half step."""
    folder = tmp_path_factory.mktemp("half")
    con = duckdb.connect()
    con.execute(f"COPY (SELECT b AS p_partkey, 'Brand#' || b AS p_brand, 'T' || b % 3 AS p_type FROM range(1, 13) t(b)) TO '{folder}/part.parquet'")
    discount = "(('0x' || substr(md5(concat_ws(':', b, d, k)), 1, 8))::BIGINT % 11 / 100)::DOUBLE"
    con.execute(f"""COPY (SELECT b AS l_partkey, {discount} AS l_discount, CASE WHEN k % 2 = 0 THEN 'F' ELSE 'O' END AS l_linestatus, DATE '1996-01-01' + d::INT AS l_shipdate
        FROM range(1, 13) t(b), range(300) u(d), range(64) v(k)) TO '{folder}/lineitem.parquet'""")
    return str(folder)


def by_sql(folder, sql):
    con = duckdb.connect()
    con.execute("PRAGMA debug_window_mode = 'separate'")
    for name in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con.execute(sql).fetchdf()


def test_the_lines_make_half_steps(lines):
    found = by_sql(lines, P + " SELECT count(*) AS n FROM every WHERE abs(abs(m) * 1000000 % 1 - 0.5) < 0.000001")
    assert found.n[0] > 1500


@pytest.mark.parametrize("name", ["f1_returns", "c12_hero_curve", "f3_any_start", "s7_results_round_trip", "w12_momentum_1d", "w16_strategies"])
def test_half_steps_row_by_row(spark, lines, name):
    found, wanted = rows(QUERIES[name](spark, lines).toPandas()), rows(by_sql(lines, SQL[name]))
    assert len(found) > 100 and found == wanted


def test_doubles_are_rounded_as_in_sql(spark):
    # 41 / 640 = 0.0640625 and 333 / 640 = 0.5203125, but 520312.49999999994 millionths
    values = [k / n for n in (640, 1280, 1920) for k in range(1, n)] + [-333 / 640, 1e305, -1e305, float("inf"), float("nan"), 0.0, None]
    asked = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    frame = asked.toPandas()  # noqa: F841
    for digits in (4, 6, 10):
        wanted = duckdb.sql(f"SELECT i, round(x, {digits}) + 0.0::DOUBLE AS x FROM frame").df()
        assert rows(rounded_rows(asked, digits).toPandas()) == rows(wanted)
    assert asked.where("i = 0").select(stats.rounded(F.lit(333 / 640), 6)).first()[0] == 0.520312
