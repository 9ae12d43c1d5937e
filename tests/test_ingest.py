import json

import pytest
from pyspark.sql import functions as F

from basketwise import batches
from basketwise.plans import ingest
from basketwise.session import STAGED
from basketwise.sinks import mark_duplicates, to_json_records, write_csv
from basketwise.sources import csv_files, tables
from tests.conftest import as_dicts

# The header names of the extracts; the rows are made up.
TRANSACTIONS = (
    "BASKET_NUM       ,HSHD_NUM   ,PURCHASE_,PRODUCT_NUM   ,     SPEND,     UNITS,STORE_R,  WEEK_NUM,YEAR\r\n"
    "501,71,03-Mar-17,1,12.40,3,NORTH,9,2017\r\n"
    "502,72,05-Apr-17,2,7.05,2,SOUTH  ,14,2017\r\n"
    "503,x,06-Apr-17,3,1.10,1,NORTH,14,2017\r\n"
    "504,73,someday,3,1.10,1,NORTH,14,2017\r\n"
    "505,73,21-May-98,3,n/a,many,COAST,21.5,NULL \r\n"
    "506,73,21-May-98,3,1.00,1,COAST,21,1998,surplus\r\n"
    "507,73,21-May-98\r\n"
)
HOUSEHOLDS = (
    "HSHD_NUM   ,L,AGE_RANGE                ,MARITAL,INCOME_RANGE  ,HOMEOWNER,HSHD_COMPOSITION,HH_SIZE    ,CHILDREN\r\n"
    "71,N,25-34      ,Single   ,75-99k    ,Owner,Two Adults,4+  ,2\r\n"
    "72,Y,65+      ,null      ,35-49k    ,Owner,Two Adults,3  ,null\r\n"
    "72,Y,65+      ,null      ,35-49k    ,Owner,Two Adults,3  ,null\r\n"
    "72,Y,19-24      ,null      ,35-49k    ,Owner,Two Adults,3  ,null\r\n"
)
PRODUCTS = (
    "PRODUCT_NUM,DEPARTMENT      ,COMMODITY     ,BRAND_TY,NATURAL_ORGANIC_FLAG\r\n"
    '1,GARDEN    ,SEEDS      ,NATIONAL ,Y\r\n2,"TOYS, ""big"" ",GAMES      ,NATIONAL ,Y\r\nbad,TOYS,GAMES,NATIONAL,Y\r\n?,TOYS,DOLLS,NATIONAL,Y\r\n'
)


@pytest.fixture
def paths(tmp_path):
    files = {"transactions": TRANSACTIONS, "households": HOUSEHOLDS, "products": PRODUCTS}
    for kind, content in files.items():
        (tmp_path / f"{kind}.csv").write_bytes(content.encode())
    return {kind: str(tmp_path / f"{kind}.csv") for kind in files}


def test_all_three_files_are_required(spark, paths, tmp_path):
    with pytest.raises(ValueError, match="all three"):
        ingest.ingest(spark, {**paths, "products": ""}, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def counts_of(counts):
    """(input, stored, rejected, duplicate) rows by table."""
    return {r["table_name"]: tuple(r)[1:] for r in counts.collect()}


def test_ingest(spark, paths, tmp_path):
    target = str(tmp_path / "out")
    counts = counts_of(ingest.ingest(spark, paths, target))
    assert counts == {"transactions": (7, 3, 4, 0), "households": (4, 4, 0, 0), "products": (4, 4, 0, 0)}
    loaded = tables.load_tables(spark, target)
    assert {kind: df.count() for kind, df in loaded.items()} == {"transactions": 3, "households": 4, "products": 4}
    rows = {r["basket_num"]: r for r in loaded["transactions"].collect()}
    assert sorted(rows) == [501, 502, 505]
    assert rows[502]["store_region"] == "SOUTH"
    last = rows[505]
    assert (str(last["purchase_date"]), str(last["spend"]), last["units"], last["week_num"], last["year"]) == (
        "1998-05-21",
        "0.00",
        0,
        21,
        0,
    )
    homes = {r["hshd_num"]: r for r in loaded["households"].collect()}
    assert (homes[71]["hshd_size"], homes[71]["age_range"], homes[72]["children"]) == (0, "25-34", 0)
    products = {r["product_num"]: r["department"] for r in loaded["products"].where("product_num > 0").collect()}
    assert products == {1: "GARDEN", 2: 'TOYS, "big"'}
    rejects = tables.load_rejects(spark, target, "transactions")
    assert sorted(r["reject_reason"] for r in rejects.collect()) == [
        "hshd_num missing or unreadable",
        "purchase_date missing or unreadable",
        "wrong number of fields",
        "wrong number of fields",
    ]


def test_loading_twice(spark, paths, tmp_path):
    target = str(tmp_path / "out")
    ingest.ingest(spark, paths, target)
    ingest.ingest(spark, paths, target)
    loaded = tables.load_tables(spark, target)
    assert {kind: df.count() for kind, df in loaded.items()} == {"transactions": 6, "households": 8, "products": 8}


def test_one_row_per_key_on_request(spark, paths, tmp_path):
    target = str(tmp_path / "out")
    keys = {"households": ["hshd_num"], "products": ["product_num"]}
    first = counts_of(ingest.ingest(spark, paths, target, keys))
    assert first == {"transactions": (7, 3, 4, 0), "households": (4, 2, 0, 2), "products": (4, 3, 0, 1)}
    second = counts_of(ingest.ingest(spark, paths, target, keys))
    assert second == {"transactions": (7, 3, 4, 0), "households": (4, 0, 0, 4), "products": (4, 0, 0, 4)}
    homes = {r["hshd_num"]: r["age_range"] for r in tables.load_tables(spark, target)["households"].collect()}
    assert homes == {71: "25-34", 72: "65+"}
    rejects = tables.load_rejects(spark, target, "households")
    assert sorted(r["reject_reason"] for r in rejects.collect()) == ["key already stored"] * 4 + ["key repeated in the file"] * 2


class Killed(Exception):
    pass


def test_a_load_that_dies_leaves_nothing_and_can_be_repeated(spark, paths, tmp_path):
    target = str(tmp_path / "out")

    def die(kind):
        if kind == "households":
            raise Killed

    with pytest.raises(Killed):
        ingest.ingest(spark, paths, target, batch="monday", on_stored=die)
    assert batches.committed(spark, target) == []
    assert all(df.isEmpty() for df in tables.load_tables(spark, target).values())
    first = counts_of(ingest.ingest(spark, paths, target, batch="monday"))
    again = counts_of(ingest.ingest(spark, paths, target, batch="monday"))
    assert first == again == {"transactions": (7, 3, 4, 0), "households": (4, 4, 0, 0), "products": (4, 4, 0, 0)}
    ingest.ingest(spark, paths, target, batch="tue/sday ü")
    assert {b.name for b in batches.committed(spark, target)} == {"monday", "tue/sday ü"}
    loaded = tables.load_tables(spark, target)
    assert {kind: df.count() for kind, df in loaded.items()} == {"transactions": 6, "households": 8, "products": 8}


def test_an_attempt_that_was_killed_outright_is_not_read(spark, tmp_path):
    target = str(tmp_path / "out")

    def write(folder):
        spark.range(3).write.parquet(f"{folder}/part")
        return {"rows": 3}

    # What a killed process leaves: an attempt without a manifest, and a manifest cut short.
    write(f"{target}/batches/a/dead")
    (tmp_path / "out" / "batches" / "a" / "COMMITTED").write_text('{"attempt": "dead"')
    assert batches.paths(spark, target, "part") == []
    batch = batches.store(spark, target, "a", write)
    assert batch.notes == {"rows": 3} and batch == batches.find(spark, target, "a")
    assert spark.read.parquet(*batches.paths(spark, target, "part")).count() == 3


def test_of_two_writers_of_a_batch_one_wins(spark, tmp_path):
    target = str(tmp_path / "out")

    def slow(folder):
        # Another writer commits the same name meanwhile.
        batches.store(spark, target, "a", lambda place: {"by": "fast"} if spark.range(1).write.parquet(place) is None else {})
        spark.range(5).write.parquet(folder)
        return {"by": "slow"}

    assert batches.store(spark, target, "a", slow).notes == {"by": "fast"}
    [batch] = batches.committed(spark, target)
    assert batch.notes == {"by": "fast"} and len(list((tmp_path / "out" / "batches" / "a").iterdir())) <= 3


def test_one_key_with_most_rows_is_marked_in_parts(spark):
    rows = [(0, k % 7, None) for k in range(300)] + [(k, 1, None) for k in range(1, 20)] + [(None, 1, "bad")] * 3
    frame = spark.createDataFrame(rows, "key long, value int, reason string").repartition(8)
    marked = mark_duplicates(frame, spark.createDataFrame([(3,), (4,)], "key long"), ["key"], "reason")
    found = {(r.key, r.value if r.reason is None else None, r.reason): r["count"] for r in marked.groupBy("key", "value", "reason").count().collect()}
    assert found[(0, 6, None)] == 1 and marked.count() == len(rows)
    assert marked.where("reason = 'key already stored'").count() == 2
    assert marked.where("reason = 'key repeated in the file'").count() == 299 and marked.where("reason = 'bad'").count() == 3


def test_no_stored_copy_remains(spark, paths, tmp_path):
    before = list(STAGED.get(spark, []))
    ingest.ingest(spark, paths, str(tmp_path / "out"))
    with pytest.raises(Exception):
        ingest.ingest(spark, {**paths, "products": str(tmp_path / "missing.csv")}, str(tmp_path / "out"))
    assert STAGED.get(spark, []) == before


def test_quoted_line_ends(spark, paths, tmp_path):
    path = tmp_path / "products.csv"
    path.write_text(PRODUCTS.replace("GARDEN    ", '"GARDEN\nHOUSE"'))
    rows = csv_files.read_retail_csv(spark, str(path), "products", multi_line=True).collect()
    assert [r.department.strip() for r in rows if r.product_num == "1"] == ["GARDEN\nHOUSE"]
    assert all(r[csv_files.MALFORMED] is None for r in rows)


def test_cleaner(spark, paths):
    cleaned = ingest.clean_transactions(csv_files.read_csv_text(spark, paths["transactions"]))
    rows = {r["BASKET_NUM"]: r for r in cleaned.collect()}
    assert cleaned.columns[:4] == ["BASKET_NUM", "HSHD_NUM", "PURCHASE_", "PRODUCT_NUM"]
    assert (rows["502"]["STORE_R"], rows["502"]["WEEK_NUM"], str(rows["502"]["PURCHASE_"])) == ("SOUTH", 14, "2017-04-05")
    assert (rows["505"]["WEEK_NUM"], rows["505"]["YEAR"], rows["504"]["PURCHASE_"]) == (None, None, None)
    assert rows["505"]["SPEND"] == "n/a"


def test_csv_sink(spark, paths, tmp_path):
    frame = csv_files.read_retail_csv(spark, paths["products"], "products").drop(csv_files.MALFORMED)
    write_csv(frame, str(tmp_path / "csv"))
    again = csv_files.read_csv_text(spark, str(tmp_path / "csv"))
    assert again.columns == frame.columns and sorted(again.collect()) == sorted(frame.collect())


def test_csv_sink_keeps_blanks_and_quotes(spark, tmp_path):
    frame = spark.createDataFrame([("  pad  ", 'a "b", c')], "`A  ` string, B string")
    write_csv(frame, str(tmp_path / "csv"))
    again = csv_files.read_csv_text(spark, str(tmp_path / "csv"))
    assert again.columns == ["A  ", "B"] and [tuple(r) for r in again.collect()] == [("  pad  ", 'a "b", c')]


def test_json_rows(spark):
    frame = spark.createDataFrame([(1, None)], "a int, b string")
    assert json.loads(to_json_records(frame).first()["json"]) == {"a": 1, "b": None}


def test_jdbc_options():
    parallel = {"partitionColumn": "basket_num", "lowerBound": "1", "upperBound": "9", "numPartitions": "8"}
    options = {"url": "jdbc:x", "user": "u", "products.dbtable": "dbo.Products"}
    with pytest.raises(ValueError, match="one task"):
        tables.jdbc_options(options, "transactions")
    options |= {f"transactions.{k}": v for k, v in parallel.items()}
    assert tables.jdbc_options(options, "transactions") == {"url": "jdbc:x", "user": "u", "dbtable": "transactions", **parallel}
    assert tables.jdbc_options(options, "products")["dbtable"] == "dbo.Products"


def test_out_of_range_is_rejected(spark):
    raw = spark.createDataFrame(
        [("1", "1", "17-Aug-18", "1", "99999999999999.99", "1", "W", "1", "2018"), ("1", "1", "17-Aug-18", "1", "1", "3e9", "W", "1", "2018")],
        "basket_num string, hshd_num string, purchase_date string, product_num string, spend string, units string, store_region string, week_num string, year string",
    )
    good, rejects = ingest.split_valid(ingest.type_rows(raw, "transactions"))
    assert good.count() == 0
    assert sorted(r["reject_reason"] for r in as_dicts(rejects)) == ["spend out of range", "units out of range"]
    assert rejects.where(F.col("spend").isNull()).count() == 0


def test_the_reject_test_stays_above_the_joins(spark):
    """Its columns would be converted anew in the condition of the join."""
    numbers = spark.range(20).select(F.col("id").cast("string").alias("basket_num"), (F.col("id") % 4).alias("key"))
    homes = spark.range(4).select(F.col("id").alias("key"), F.when(F.col("id") > 0, F.col("id").cast("string")).alias("hshd_num"))
    raw = numbers.join(homes, "key").drop("key").withColumns(
        {c: F.lit("2018-01-01" if c == "purchase_date" else "1") for c in ("purchase_date", "product_num", "spend", "units", "store_region", "week_num", "year")}
    )
    good, rejects = ingest.split_valid(ingest.type_rows(raw, "transactions"))
    assert good.count() == 15 and {r.reject_reason for r in rejects.collect()} == {"hshd_num missing or unreadable"}
    for frame in (good, rejects):
        joins = [line for line in frame._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join " in line]
        assert joins and not any("RLIKE" in line for line in joins)
