"""The SQL gate: what runs, what is refused, and what it leaves behind."""

import pytest
from pyspark.sql import functions as F

from planframe.sheet import PlanError
from planframe.sqlgate import run_sql

ALLOWED = [
    'SELECT id AS load FROM t',
    'SELECT load FROM t WHERE load > 1',
    'SELECT name, count(*) AS n, sum(load) OVER () FROM t GROUP BY name, load',
    'WITH a AS (SELECT * FROM t), b AS (SELECT * FROM a) SELECT b.id, u.v FROM b JOIN u USING (id)',
    'SELECT * FROM t WHERE id IN (SELECT id FROM u) AND EXISTS (SELECT 1 FROM u WHERE u.id=t.id)',
    'SELECT (SELECT max(id) FROM u) AS m',
    "SELECT '--' AS a, upper(name) AS b, '/* x */' AS c FROM t",
    'SELECT t.id, x FROM t LATERAL VIEW explode(array(1,2)) y AS x',
    'SELECT * FROM range(3)',
    'SELECT id FROM t UNION ALL SELECT id FROM u ORDER BY id LIMIT 3',
    "SELECT CASE WHEN id > 1 THEN 'a' END AS c, CAST(id AS STRING) AS s, date_add(DATE '2020-01-01', id) d, round(load,1) r, transform(array(1), q -> q+1) z, extract(year from current_date()) y FROM t",
    'SELECT * FROM (VALUES (1,2)) AS v(a,b)',
    'SELECT id, row_number() OVER (PARTITION BY name ORDER BY id) AS r FROM t',
    'SELECT "id" FROM t;',
    "select `name` from T where name like 'a%' and name rlike 'x' or id between 1 and 2",
    'SELECT DISTINCT id FROM t',
    "SELECT id, percentile_approx(load,0.5), any_value(name), count(distinct name) filter (where id>1), listagg(name, ',') FROM t GROUP BY ALL",
    "SELECT * FROM t PIVOT (sum(load) FOR name IN ('a','b'))",
    'WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n+1 FROM r WHERE n<3) SELECT * FROM r',
    "SELECT coalesce(load,0)+1, id % 2, -id, not true, id <=> 2, name || 'x', xxhash64(id), md5(name), sha2(name,256), typeof(id), from_json('{}','a int'), regexp_replace(name,'a','b'), concat(name,'d'), substring(name,1,1), substr(name,2), if(id>1,1,2), ifnull(load,1), try_divide(1,0), least(1,2), now(), date_trunc('month', current_timestamp()), rank() over (order by id) from t",
]
REFUSED = [
    "SELECT `reflect`('java.lang.System','getProperty','user.home')",
    "SELECT '/*' AS a, reflect('java.lang.System','getProperty','user.home') AS b, '*/' AS c",
    "SELECT '--' AS a, reflect('java.lang.System','getProperty','user.home')",
    "SELECT java_method('java.lang.System','getProperty','user.home')",
    "SELECT try_reflect('a','b')",
    'SELECT input_file_name() FROM t',
    'SELECT * FROM mine',
    'SELECT * FROM parquet.`/root/testdata/sf0.001/nation.parquet`',
    'SELECT * FROM default.t',
    'DROP TABLE t',
    'INSERT INTO t SELECT * FROM u',
    'SELECT 1; SELECT 2',
    'SET x=1',
    'SHOW TABLES',
    'CREATE TABLE a AS SELECT 1',
    "SELECT * FROM IDENTIFIER('mine')",
    "SELECT IDENTIFIER('id') FROM t",
    'SELECT * FROM (WITH mine AS (SELECT 1) SELECT 1 AS a), mine',
    "SELECT * FROM read_files('/x')",
    'SELECT current_user()',
    'SELECT version()',
    'SELECT id FROM t QUALIFY 1',
    'FROM t INSERT INTO u SELECT *',
    "SELECT TRANSFORM(id) USING 'cat' FROM t",
    'EXPLAIN SELECT 1',
    'SELECT * FROM python_worker_logs()',
    "SELECT system.builtin.reflect('a','b')",
    "SELECT raise_error('x')",
    'DESCRIBE t',
    "SELECT (SELECT reflect('java.lang.System','getProperty','user.home'))",
    "SELECT id FROM t ORDER BY reflect('java.lang.System','getProperty','user.home')",
    "SELECT id, sum(id) OVER (PARTITION BY reflect('java.lang.System','getProperty','user.home')) FROM t",
    'SELECT * FROM t WHERE id IN (SELECT z FROM mine)',
]


@pytest.fixture(scope="module")
def tables(spark):
    t = spark.createDataFrame([(1, "a", 2.5), (2, "b", None)], "id int, name string, load double")
    spark.createDataFrame([(7,)], "z int").createOrReplaceTempView("mine")
    yield {"t": t, "u": spark.createDataFrame([(1, "x")], "id int, v string")}
    spark.catalog.dropTempView("mine")


def test_queries_run(spark, tables):
    for sql in ALLOWED:
        run_sql(spark, sql, tables).collect()
    assert run_sql(spark, "SELECT '--' AS a, upper(name) AS b, '/* x */' AS c FROM t WHERE id = 1", tables).first().asDict() == {"a": "--", "b": "A", "c": "/* x */"}


@pytest.mark.parametrize("sql", REFUSED)
def test_anything_else_is_refused(spark, tables, sql):
    with pytest.raises(PlanError):
        run_sql(spark, sql, tables)


def test_views_of_the_session_stay_as_they_were(spark, tables):
    spark.createDataFrame([(9,)], "z int").createOrReplaceTempView("t")
    later = run_sql(spark, "SELECT id FROM t", tables)
    assert sorted(r[0] for r in later.collect()) == [1, 2] and [r[0] for r in spark.table("t").collect()] == [9]
    assert "u" not in {x.name for x in spark.catalog.listTables()}
    spark.catalog.dropTempView("t")


def test_large_results_are_refused(spark, tables):
    many = {"n": spark.range(200_001).withColumn("x", F.lit(1))}
    with pytest.raises(PlanError, match="more than 200000 rows"):
        run_sql(spark, "SELECT id FROM n", many)
    assert run_sql(spark, "SELECT id FROM n", many, most=None).count() == 200_001
    assert run_sql(spark, "SELECT sum(x) AS n FROM n", many).first()[0] == 200_001
