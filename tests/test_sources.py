import pytest

from haulage.sources import jdbc
from haulage.sources.load import clean_query, load, retype_via_text, run_script
from haulage.specs import Source


def test_clean_query():
    assert clean_query("  SELECT 1 ;; ") == "SELECT 1"
    with pytest.raises(ValueError):
        clean_query("  ; ")


def test_dispatch(spark, small):
    assert load(spark, Source(kind="parquet", path=f"{small}/region.parquet")).count() == 5
    assert load(spark, {"kind": "sql", "query": "SELECT COUNT(*) AS n FROM region",
                        "tables": {"region": f"{small}/region.parquet"}}).first().n == 5
    with pytest.raises(ValueError):
        Source(kind="http")


def test_script_then_query(spark, scratch):
    script = (f"CREATE TABLE haulage_script_t (k INT, label STRING) USING parquet LOCATION '{scratch}/t'; "
              "INSERT INTO haulage_script_t SELECT id AS k, concat('row;', id) AS label FROM range(4) WHERE id > 1")
    try:
        rows = run_script(spark, script, "SELECT * FROM haulage_script_t ORDER BY k;").collect()
        assert [(r.k, r.label) for r in rows] == [(2, "row;2"), (3, "row;3")]
    finally:
        spark.sql("DROP TABLE IF EXISTS haulage_script_t")


def test_retype_via_text_changes_types(spark, scratch):
    df = spark.createDataFrame([("007", "2024-01-01")], "code string, day string")
    back = retype_via_text(df, scratch + "/retype").first()
    assert back.code == 7  # leading zeros are lost, as with any CSV round trip with inference


def test_jdbc_url_and_options():
    s = Source(kind="jdbc", db_type="PostgreSQL", username="u", password="p?w", host="h", port="5432",
               db_name="db", query="SELECT 1", connection_parameters="?sslmode=require")
    assert jdbc.jdbc_url(s) == "jdbc:postgresql://h:5432/db?sslmode=require"
    opts = jdbc.jdbc_options(s)
    assert opts["password"] == "p?w" and "p?w" not in opts["url"] and opts["user"] == "u"
    ms = Source(kind="jdbc", db_type="mssql", host="h", port="1433", db_name="ledger", query="SELECT 2",
                driver="ODBC Driver 18 for SQL Server", connection_parameters="&encrypt=false")
    assert jdbc.jdbc_url(ms) == "jdbc:sqlserver://h:1433;databaseName=ledger;encrypt=false"
    assert jdbc.jdbc_options(ms)["driver"] == "com.microsoft.sqlserver.jdbc.SQLServerDriver"
    assert "*****" in repr(s) and "p?w" not in repr(s)
    with pytest.raises(ValueError):
        jdbc.jdbc_url(Source(kind="jdbc", db_type="nosuchdb", query="x"))


def test_table_and_csv_sources(spark, small, scratch):
    from haulage.sinks.writers import write_csv

    nation = spark.read.parquet(f"{small}/nation.parquet")
    nation.createOrReplaceTempView("nation_view")
    assert load(spark, Source(kind="table", path="nation_view")).count() == 25
    path = write_csv(nation, scratch + "/nation_csv")
    back = load(spark, Source(kind="csv", path=path, options={"inferSchema": "true"}))
    assert back.count() == 25 and back.columns == nation.columns
    with pytest.raises(ValueError):
        load(spark, Source(kind="parquet"))
